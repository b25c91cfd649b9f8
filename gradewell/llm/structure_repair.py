"""Cheapest repair of the turn structure of conversations, by a persistent audit DP.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant turns. Rows are kept,
given another role, deleted, or joined by inserted empty turns; each edit has a cost, and of the cheapest edit lists the
one whose initials (D, I, K, R) sort first is the audit.

The DP walks the rows of a conversation with one best edit list for each of four states (nothing yet, after system,
after user, after assistant). Edit lists share prefixes as linked nodes. Each node has the number of its edits, a
rolling hash of them and its ancestors at powers of two, so that of two lists of equal cost the smaller is found by a
search for their longest common prefix; where hashes agree, the letters are compared once, so a collision costs time
and changes nothing.

A conversation of any length is spread: rows are range-partitioned by conversation and turn, and each partition turns its
part of a conversation into the best edit list for every pair of first and last state. The parts of one conversation,
one row per partition, are then joined by the same DP over longer labels. Only the audit itself, which the result holds
in one cell, grows with a conversation there. The repaired text is hashed in one pass over the conversation's rows in order;
that pass holds a batch of rows and the audit, but SHA-256 cannot be divided, so a conversation is one task's there.

Nulls: a null role, text, turn or id in the damage key is one space; a null turn sorts first and counts in no gap; rows
with a null id are a conversation of their own. Rows of one turn are ordered by role and by the MD5 of the text. Rows that
repeat are one row with a count until they are needed. An empty role has no initial, so it is next to nothing legal and
can't be kept. Empty texts are blank. Texts of any length are only hashed and searched. An empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import hand_over, partitions_for
from gradewell.plans.skew import salted_join

# Characters that a text needs one of so as not to be blank, and the ends of whole sentences.
SOLID, ENDS = r"[^\x20\x09-\x0D]", ".!?"
DAMAGE_KINDS = 20
ROWS_PER_PART = 200_000
# Rows are one letter each: an initial that is s, u, a or any other (x), in upper case for a truncated text; D for rows that
# have to go.
MUST_GO = "D"
START, SYSTEM, USER, ASSISTANT = range(4)
# Where a turn of each role leads from each state.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
# The role that rerole and insert give in each state.
ROLE_IN = ("user", "user", "assistant", "user")
ACCEPTED = (START, ASSISTANT)


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self):
        # With free inserts one list could be the start of another of equal cost, and prefixes would not decide.
        if self.insert <= 0 or min(self.keep, self.rerole, self.delete, self.truncated) < 0:
            raise ValueError("an insert must cost something and no edit less than nothing")


COSTS = Costs()
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


class Node:
    """One more label (an edit's initial, or the initials of a whole part) after ``ancestors[0]``."""

    __slots__ = ("label", "depth", "length", "digest", "ancestors")

    def __init__(self, label: str, parent: Node | None, prime: int = _PRIME):
        self.label = label
        if parent is None:
            self.depth, self.length, self.digest, self.ancestors = 0, 0, 0, ()
            return
        self.depth, self.length = parent.depth + 1, parent.length + len(label)
        digest = parent.digest
        for letter in label:
            digest = (digest * _BASE + ord(letter)) % prime
        self.digest = digest
        up, k = [parent], 0
        while k < len(up[k].ancestors):
            up.append(up[k].ancestors[k])
            k += 1
        self.ancestors = tuple(up)

    def text(self) -> str:
        parts, node = [], self
        while node.ancestors:
            parts.append(node.label)
            node = node.ancestors[0]
        return "".join(reversed(parts))


class Audits:
    """Compares edit lists that end in nodes; remembers which pairs with equal hashes were found equal."""

    def __init__(self, prime: int = _PRIME):
        self.prime = prime
        self.equal: dict[tuple[int, int], tuple[Node, Node]] = {}
        self.collisions = 0

    def root(self) -> Node:
        return Node("", None)

    def add(self, node: Node, label: str) -> Node:
        return Node(label, node, self.prime)

    def _same(self, a: Node, b: Node) -> bool:
        """Whether two nodes of equal hash stand for the same list; letters decide."""
        first = (id(a), id(b))
        pair = (a, b)
        while a is not b and (id(a), id(b)) not in self.equal:
            if a.label != b.label or not a.ancestors or not b.ancestors:
                self.collisions += 1
                return False
            a, b = a.ancestors[0], b.ancestors[0]
        self.equal[first] = pair
        return True

    def before(self, a: Node, b: Node) -> bool:
        """Whether the list of ``a`` sorts before that of ``b``."""
        x, y = a, b
        for k in range(max(len(x.ancestors), len(y.ancestors)) - 1, -1, -1):
            while x.depth - y.depth >= 1 << k:
                x = x.ancestors[k]
            while y.depth - x.depth >= 1 << k:
                y = y.ancestors[k]
        if x is y:
            return a.depth < b.depth
        if x.digest == y.digest and x.length == y.length:
            return a.depth < b.depth if self._same(x, y) else a.text() < b.text()
        for k in range(len(x.ancestors) - 1, -1, -1):
            if k < len(x.ancestors) and x.ancestors[k] is not y.ancestors[k] and x.ancestors[k].digest != y.ancestors[k].digest:
                x, y = x.ancestors[k], y.ancestors[k]
        up, vp = x.ancestors[0], y.ancestors[0]
        if not (up is vp or up.length == vp.length and self._same(up, vp)):
            return a.text() < b.text()
        if x.label.startswith(y.label) or y.label.startswith(x.label):
            return a.text() < b.text()
        return x.label < y.label


Best = list[tuple[int, Node] | None]


def _offer(best: Best, state: int, cost: int, node: Node, label: str, audits: Audits) -> bool:
    """Take the list ``node`` + ``label`` for ``state`` if it is cheaper, or as cheap and smaller."""
    old = best[state]
    if old is not None and old[0] < cost:
        return False
    new = audits.add(node, label) if label else node
    if old is not None and old[0] == cost and not audits.before(new, old[1]):
        return False
    best[state] = (cost, new)
    return True


def _insert(best: Best, costs: Costs, audits: Audits) -> Best:
    """Lists that end in inserted turns. An insert always costs something, so the improvements end."""
    open_states = [q for q in range(4) if best[q] is not None]
    while open_states:
        changed = []
        for state in open_states:
            cost, node = best[state]
            after = USER if ROLE_IN[state] == "user" else ASSISTANT
            if _offer(best, after, cost + costs.insert, node, "I", audits):
                changed.append(after)
        open_states = changed
    return best


def step(best: Best, row: str, costs: Costs, audits: Audits) -> Best:
    """The best list for each state after one more row."""
    after: Best = [None] * 4
    for state, found in enumerate(best):
        if found is None:
            continue
        cost, node = found
        _offer(after, state, cost + costs.delete, node, "D", audits)
        if row == MUST_GO:
            continue
        extra = costs.truncated if row.isupper() else 0
        kept = NEXT[state].get(row.lower())
        if kept is not None:
            _offer(after, kept, cost + costs.keep + extra, node, "K", audits)
        _offer(after, USER if ROLE_IN[state] == "user" else ASSISTANT, cost + costs.rerole + extra, node, "R", audits)
    return _insert(after, costs, audits)


def part_lists(rows: Iterable[str], first: int, costs: Costs = COSTS, audits: Audits | None = None) -> list[tuple[int, str] | None]:
    """For each last state the cheapest list over ``rows`` from state ``first``, with inserts after any row.

    Inserts before the first row of a conversation are taken if ``first`` is the start.
    """
    audits = audits or Audits()
    best: Best = [None] * 4
    best[first] = (0, audits.root())
    if first == START:
        best = _insert(best, costs, audits)
    for row in rows:
        best = step(best, row, costs, audits)
    return [None if b is None else (b[0], b[1].text()) for b in best]


def join_parts(parts: Sequence[Sequence[Sequence[tuple[int, str] | None]]], audits: Audits | None = None) -> tuple[int, str]:
    """Cost and audit of a conversation from its parts; ``parts[i][p][q]`` leads from state p to state q.

    In the first part only the start counts.
    """
    audits = audits or Audits()
    best: Best = [None] * 4
    best[START] = (0, audits.root())
    for part in parts:
        after: Best = [None] * 4
        for first, found in enumerate(best):
            if found is None:
                continue
            for last, piece in enumerate(part[first]):
                if piece is not None:
                    _offer(after, last, found[0] + piece[0], found[1], piece[1], audits)
        best = after
    ends: Best = [None]
    for state in ACCEPTED:
        if best[state] is not None:
            cost, node = best[state]
            _offer(ends, 0, cost, node, "", audits)
    return ends[0][0], ends[0][1].text()


def repaired(rows: Iterable[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """The turns (role, text) that an audit makes of a conversation's rows."""
    state, rows = START, iter(rows)
    for edit in audit:
        if edit == "D":
            next(rows)
            continue
        role, text = (ROLE_IN[state], "") if edit == "I" else next(rows)
        if edit == "R":
            role = ROLE_IN[state]
        state = NEXT[state][role[:1]]
        yield role, text


# --- the Spark job ---------------------------------------------------------------------------------------------------

def _spaced(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as the damage leaves them; ``copies`` is 0 for a dropped row."""
    kind = F.crc32(F.concat(_spaced(F.col("conv_id")), F.lit(":"), _spaced(F.col("turn"))).cast("binary")) % DAMAGE_KINDS
    text = _spaced(F.col("text"))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(_spaced(F.col("role"))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` as they are, in the form :func:`repair` takes."""
    return conversations.select(
        "conv_id", "turn", _spaced(F.col("role")).alias("role"), _spaced(F.col("text")).alias("text"), F.lit(1).cast("long").alias("copies"))


ORDER = ["conv_id", "turn", "role", "text_md5"]


def faults(rows: DataFrame) -> DataFrame:
    """One row per conv_id, turn, role and text: its copies and what is wrong with it, without the text.

    ``repeats`` says that role and text stand at an earlier turn. First turns come from a combining aggregate.
    """
    stripped = F.regexp_replace(F.col("text"), r"[\x20\x09-\x0D]+$", "")
    narrow = rows.select(
        "conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"), "copies",
        (~F.col("text").rlike(SOLID)).alias("blank"), (~F.right(stripped, F.lit(1)).isin(*ENDS)).alias("truncated"),
    )
    grouped = narrow.groupBy(*ORDER, "blank", "truncated").agg(F.sum("copies").alias("copies"))
    grouped = grouped.withColumn("key", F.sha2(F.to_json(F.struct(_spaced(F.col("conv_id")), "role", "text_md5")), 256))
    # A null turn is the earliest: it sorts before any number in a struct.
    first = grouped.where("copies > 0 AND NOT blank").groupBy("key").agg(
        F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1").drop("turns")
    marked = salted_join(grouped, first, ["key"], "left", spread=ORDER)
    later = F.col("first").isNotNull() & ~F.struct("turn").eqNullSafe(F.col("first"))
    return marked.select(*ORDER, "copies", "blank", "truncated", later.alias("repeats"))


_PART = "conv_id long, part int, rows long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, first_turn long, last_turn long, turns long, lists array<array<struct<cost: long, audit: string>>>"
_LISTS = pa.list_(pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())])))
_PART_TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int64()] * 3, _LISTS]
_PART_NAMES = [f.split()[0] for f in _PART.split(", ")[:12]] + ["lists"]
LEGAL = ("su", "ua", "au")


def _part(conv_id: int | None, part: int, rows: list[tuple], first_states: Sequence[int]) -> tuple:
    """One conversation's rows in one partition: counts, ends, and its best lists."""
    letters, counts, illegal, turns = [], [0, 0, 0], 0, []
    first_role = last_role = None
    for turn, role, copies, blank, truncated, repeats in rows:
        if not copies:
            continue
        if turn is not None and (not turns or turns[-1] != turn):
            turns.append(turn)
        initial = role[:1]
        letter = initial if initial in ("s", "u", "a") else "x"
        fault = 0 if blank else 1 if repeats else 2 if truncated else 3
        sound = letter.upper() if truncated else letter
        if fault == 3 or fault == 2:  # later copies of a row are duplicates
            letters += [sound] + [MUST_GO] * (copies - 1)
            if fault == 2:
                counts[2] += 1
            counts[1] += copies - 1
        else:
            letters += [MUST_GO] * copies
            counts[fault] += copies
        illegal += (last_role is not None and last_role + initial not in LEGAL) + (copies - 1)
        first_role, last_role = initial if first_role is None else first_role, initial
    lists = [[None] * 4 for _ in range(4)]
    for first in first_states:
        lists[first] = [None if x is None else {"cost": x[0], "audit": x[1]} for x in part_lists(letters, first)]
    ends = (turns[0], turns[-1]) if turns else (None, None)
    return (conv_id, part, len(letters), *counts, illegal, first_role, last_role, *ends, len(turns), lists)


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a range partition to one row per conversation in it.

    Only the first conversation of a partition can have begun before, so only it starts from all states.
    """
    part, current, rows, all_states, done = -1, None, [], True, []

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _PART_TYPES)], names=_PART_NAMES)

    for batch in batches:
        for part, conv_id, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and conv_id != current:
                done.append(_part(current, part, rows, range(4) if all_states else (START,)))
                all_states, rows = False, []
            current = conv_id
            rows.append(row)
        if len(done) >= 1_000:
            yield batch_of(done)
            done = []
    if rows:
        done.append(_part(current, part, rows, range(4) if all_states else (START,)))
    if done:
        yield batch_of(done)


_VERDICT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_VERDICT_TYPES = [*[pa.int64()] * 7, pa.string()]
_VERDICT_NAMES = [f.split()[0] for f in _VERDICT.split(", ")]


def _verdict(parts: list[dict]) -> tuple:
    """Counts, cost and audit of one conversation from its parts in order."""
    live = [p for p in parts if p["rows"]]
    counts = [sum(p[k] for p in live) for k in ("blank", "duplicate", "truncated", "illegal")]
    counts[3] += sum(a["last_role"] + b["first_role"] not in LEGAL for a, b in zip(live, live[1:]))
    timed = [p for p in live if p["turns"]]
    distinct = sum(p["turns"] for p in timed) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:]))
    gaps = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - distinct if timed else 0
    lists = [[[None if x is None else (x["cost"], x["audit"]) for x in (row or [None] * 4)] for row in p["lists"]] for p in live]
    return (parts[0]["conv_id"], gaps, *counts, *join_parts(lists))


def _verdicts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[dict] = []

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _VERDICT_TYPES)], names=_VERDICT_NAMES)

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if parts and row["conv_id"] != parts[-1]["conv_id"]:
                done.append(_verdict(parts))
                parts = []
            parts.append(row)
        if done:
            yield batch_of(done)
    if parts:
        yield batch_of([_verdict(parts)])


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, role, text, copies, audit), each conversation's audit before its turns, to its repaired text's hash."""
    conv_id, digest, audit, at, state, started = None, None, "", 0, START, False

    def put(role: str, text: str) -> None:
        nonlocal state, started
        digest.update(f"{chr(10) if started else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        state, started = NEXT[state][role[:1]], True

    def inserts() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put(ROLE_IN[state], "")
            at += 1

    for batch in batches:
        ids, hashes = [], []
        for row_id, role, text, copies, new_audit in zip(*(c.to_pylist() for c in batch.columns)):
            if new_audit is not None:
                if digest is not None:
                    ids.append(conv_id)
                    hashes.append(digest.hexdigest())
                conv_id, digest, audit, at, state, started = row_id, hashlib.sha256(), new_audit, 0, START, False
                inserts()
                continue
            for _ in range(copies):
                edit, at = audit[at], at + 1
                if edit != "D":
                    put(ROLE_IN[state] if edit == "R" else role, text)
                inserts()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv_id], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])


def repair(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows``, a table as :func:`damage` or :func:`undamaged` makes it."""
    spark = rows.sparkSession
    marked = hand_over(faults(rows.withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long"))), "faults")
    parts = partitions_for(spark, marked.count(), ROWS_PER_PART)
    ranged = marked.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).select(
        F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "copies", "blank", "truncated", "repeats")
    pieces = ranged.mapInArrow(_parts, _PART)
    verdicts = hand_over(
        pieces.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_verdicts, _VERDICT), "audits")
    turns = rows.where("copies > 0").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role",
        "text", "copies", F.lit(None).cast("string").alias("audit"))
    heads = verdicts.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("copies"), "audit")
    stream = heads.unionByName(turns).withColumn("text_md5", F.md5(F.col("text").cast("binary"))).repartition(parts, "conv_id")
    hashes = stream.sortWithinPartitions("conv_id", "kind", "turn", "role", "text_md5").select(
        "conv_id", "role", "text", "copies", "audit").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    named = hashes.withColumnRenamed("conv_id", "id")
    return verdicts.join(named, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The contract's table: damage, then repair."""
    return repair(damage(conversations))
