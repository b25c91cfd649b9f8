"""Structure repair and the prefix trie against brute force; the SQL covers the shared tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from gradewell.llm import prefix_trie, structure_repair as sr

SCHEMA = "conv_id long, turn long, role string, text string, cost string, part int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- structure repair ------------------------------------------------------------------------------------------------

def best_by_search(rows, costs):
    """(cost, audit) over all edit lists with up to six inserts."""
    best = None

    def go(i, roles, audit, cost, inserts):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(roles)) and (best is None or (cost, audit) < best):
            best = cost, audit
        if inserts < 6:
            for role in "ua":
                go(i, [*roles, role], audit + "I", cost + costs.insert, inserts + 1)
        if i < len(rows):
            row = rows[i]
            extra = costs.truncated if row.isupper() and row != "D" else 0
            go(i + 1, roles, audit + "D", cost + costs.delete, inserts)
            if row != "D":
                go(i + 1, [*roles, row.lower()], audit + "K", cost + costs.keep + extra, inserts)
                for role in "ua":
                    go(i + 1, [*roles, role], audit + "R", cost + costs.rerole + extra, inserts)

    go(0, [], "", 0, 0)
    return best


@pytest.mark.parametrize("prime", [sr._PRIME, 7])
def test_cheapest_and_smallest_audits(prime):
    """Also with a hash that nearly always collides, and with the rows cut into two parts."""
    rng = random.Random(prime)
    for _ in range(150):
        rows = "".join(rng.choice("ssuuaauaxSUAXD") for _ in range(rng.randint(0, 4)))
        costs = rng.choice([sr.COSTS, sr.Costs(0, 2, 3, 1, 1), sr.Costs(1, 1, 2, 2, 0), sr.Costs(0, 3, 6, 1, 4)])
        want = best_by_search(rows, costs)
        lists = sr.part_lists(rows, sr.START, costs, sr.Audits(prime))
        assert min(lists[q] for q in sr.ACCEPTED if lists[q]) == want, (rows, costs)
        at = rng.randint(0, len(rows))
        parts = [[sr.part_lists(p, q, costs, sr.Audits(prime)) for q in range(4)] for p in (rows[:at], rows[at:]) if p]
        assert not parts or sr.join_parts(parts, sr.Audits(prime)) == want


def test_free_inserts_are_refused():
    with pytest.raises(ValueError):
        sr.Costs(insert=0)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repaired_by_hand(rows):
    """One conversation's contract columns, by the definition."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    seen, letters, counts = set(), [], [0, 0, 0]
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else 3
        seen.add((role, text))
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        letters.append("D" if fault < 2 else letter.upper() if fault == 2 else letter)
        if fault < 3:
            counts[fault] += 1
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = {r[1] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    lists = sr.part_lists(letters, sr.START)
    cost, audit = min(lists[q] for q in sr.ACCEPTED if lists[q])
    text = "\n".join(f"{role}:{text}" for role, text in sr.repaired([(r[2], r[3]) for r in rows], audit))
    return (gaps, *counts, illegal, cost, audit, sha(text))


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.choice([1, 2, 5, 9])):
            role = rng.choice(["user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "", "  \t", None, "Why?", "é!", "same.", "x" * 3_000 + "."])
            rows += [(conv, rng.choice([turn, turn + 1, None]), role, text)] * rng.choice([1, 1, 1, 2])
    return rows


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_of_nulls_ties_and_repeats(spark):
    rows = conversations(1, 60)
    by = defaultdict(list)
    for row in damaged(rows):
        by[row[0]].append(row)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)
    found = sr.repair_damaged(df.repartition(7)).collect()
    assert len(found) == len({r[0] for r in rows})
    for r in found:
        assert tuple(r[c] for c in COLUMNS) == repaired_by_hand(by[r["conv_id"]]), r["conv_id"]


def test_a_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(sr, "ROWS_PER_PART", 50)
    rng = random.Random(4)
    rows = [(7, i // 2, rng.choice(["user", "assistant", "user", "system"]), f"text {i % 300}" + rng.choice([".", ".", ""])) for i in range(2_000)]
    rows += [(c, i, "user", f"{i}.") for c in (6, 8) for i in range(3)]
    found = {r["conv_id"]: r for r in sr.repair_damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv in (6, 7, 8):
        want = repaired_by_hand([r for r in damaged(rows) if r[0] == conv])
        assert tuple(found[conv][c] for c in COLUMNS) == want


def test_undamaged_and_empty_tables(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (2, 0, "user", "Hm")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: (r["cost"], r["audit"]) for r in sr.repair(sr.undamaged(df)).collect()}
    assert found == {1: (0, "KK"), 2: (2, "D")}
    assert sr.repair_damaged(df.limit(0)).count() == 0


# --- prefix trie -----------------------------------------------------------------------------------------------------

def trie_by_hand(rows):
    """The contract's rows from the definition."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    members, enders = defaultdict(list), defaultdict(list)
    for c in turns:
        head = zlib.crc32(str(c).encode()) % 4
        path = (turns.get(c - c % 20, [])[:head] + turns[c][head:])
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        enders[tuple(path)].append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = lambda x: [y for y in members if len(y) == len(x) + 1 and y[:-1] == x]
        saved = sum((len(members[x]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0) for x in below)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children(node)),
                    sum(not children(x) for x in below), saved, sha(",".join(map(str, sorted(enders[node]))))))
    return sorted(out, key=str)


@pytest.mark.parametrize("shards", [1, 5, 40])
def test_trie_by_definition(spark, shards):
    """Ties, nulls, copies, turnless conversations; few and many splitters, whose prefixes are the skeleton."""
    rng = random.Random(shards)
    rows = []
    for conv in [*range(0, 90, rng.choice([1, 3])), None]:
        for turn in range(rng.choice([1, 1, 2, 4, 6])):
            rows += [(conv, rng.choice([turn, turn, None]), rng.choice(["user", "u", None]), rng.choice(["a b", "c", None, " d  e "]))] * rng.choice([1, 1, 2])
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)
    found = prefix_trie.trie(prefix_trie.rebuilt_paths(df), shards)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found.columns == names
    assert sorted((tuple(r) for r in found.collect()), key=str) == trie_by_hand(rows)


def test_copies_and_cut_splitters(spark, monkeypatch):
    """Hundreds of equal conversations, and splitters cut to a single turn."""
    monkeypatch.setattr(prefix_trie, "SKELETON_BYTES", 1)
    rows = [(c, t, "user", f"turn {t if c % 3 else c % 7 + t}") for c in range(1, 200) for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt_paths(df), 9).collect()), key=str) == trie_by_hand(rows)


def test_trie_of_nothing_and_plain_paths(spark):
    df = spark.createDataFrame([(5, 0, "user", "x y"), (9, 0, "user", "x y")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.rebuilt_trie(df.limit(0)).count() == 0
    assert sorted(tuple(r)[:7] for r in prefix_trie.trie(prefix_trie.paths(df)).collect()) == [(5, 0, None, 2, 1, 1, 2), (5, 1, 5, 2, 0, 1, 2)]
    assert list(itertools.islice(prefix_trie.walk([], prefix_trie.Skeleton([])), 1)) == []
