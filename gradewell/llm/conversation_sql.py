"""DuckDB SQL of the two operators on conversations."""

from __future__ import annotations

from gradewell.llm import prefix_trie, structure_repair


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII expression, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda letter: CAST(ord(letter) AS UBIGINT))"
    byte = f"list_reduce([xor(crc, code), {', '.join(['1'] * 8)}], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {codes}), lambda crc, code: {byte}), 4294967295)"


def _longer(source: str, cost: int | str, letter: str) -> str:
    """A state is its cost in six digits and its audit, or empty; one more edit."""
    return (f"CASE WHEN {source} = '' THEN NULL ELSE lpad(CAST(CAST(left({source}, 6) AS INT) + {cost} AS VARCHAR), 6, '0')"
            f" || substr({source}, 7) || '{letter}' END")


def _repair_sql() -> str:
    c = structure_repair.COSTS
    extra = f"(CASE WHEN row IN ('S', 'U', 'A', 'X') THEN {c.truncated} ELSE 0 END)"
    s = [f"s[{i}]" for i in (1, 2, 3, 4)]

    def kept(source: str, initial: str) -> str:
        return f"CASE WHEN lower(row) = '{initial}' THEN {_longer(source, f'{c.keep} + {extra}', 'K')} END"

    def turned(source: str) -> str:
        return f"CASE WHEN row <> 'D' THEN {_longer(source, f'{c.rerole} + {extra}', 'R')} END"

    gone = [_longer(x, c.delete, "D") for x in s]
    to_user = ", ".join([gone[2], *[kept(s[i], "u") for i in (0, 1, 3)], *[turned(s[i]) for i in (0, 1, 3)]])
    after_row = (f"[coalesce({gone[0]}, ''), coalesce(least({gone[1]}, {kept(s[0], 's')}), ''), coalesce(least({to_user}), ''),"
                 f" coalesce(least({gone[3]}, {kept(s[2], 'a')}, {turned(s[2])}), '')]")
    with_user = f"[t[1], t[2], coalesce(least(nullif(t[3], ''), {', '.join(_longer(f't[{i}]', c.insert, 'I') for i in (1, 2, 4))}), ''), t[4]]"
    with_both = f"[v[1], v[2], v[3], coalesce(least(nullif(v[4], ''), {_longer('v[3]', c.insert, 'I')}), '')]"

    def inserts(states: str) -> str:
        return f"list_transform(list_transform([{states}], lambda t: {with_user}), lambda v: {with_both})[1]"

    step = inserts(f"list_transform([string_split(state, '|')], lambda s: {after_row})[1]")
    start = inserts("['000000', '', '', '']")
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    solid, blank = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]+$"
    return f"""
        WITH source AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                               {crc32(key)} % {structure_repair.DAMAGE_KINDS} AS kind FROM conversations),
        damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                           unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM source),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS n FROM damaged),
        seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS time,
                        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS initial_before FROM numbered),
        faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{solid}') THEN 'blank' WHEN time > 1 THEN 'duplicate'
                          WHEN right(regexp_replace(text, '{blank}', ''), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
        lettered AS (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial FROM faulty),
        summed AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                          count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                          count(*) FILTER (initial_before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
                          list(CASE WHEN fault IN ('blank', 'duplicate') THEN 'D' WHEN fault = 'truncated' THEN upper(initial) ELSE initial END
                               ORDER BY n) AS letters
                   FROM lettered GROUP BY conv_id),
        ended AS (SELECT *, string_split(list_reduce(list_prepend(array_to_string({start}, '|'), letters),
                            lambda state, row: array_to_string({step}, '|')), '|') AS s FROM summed),
        best AS (SELECT * EXCLUDE (s, letters), least(nullif(s[1], ''), nullif(s[4], '')) AS found FROM ended),
        edits AS (SELECT conv_id, p, substr(found, 6 + p, 1) AS edit FROM best, LATERAL (SELECT unnest(range(1, len(found) - 5)) AS p)),
        placed AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS n, count(*) FILTER (edit <> 'D') OVER w AS turn FROM edits
                   WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
        turns AS (SELECT placed.conv_id, p, edit, placed.turn, role, text,
                         coalesce(first(left(role, 1) = 's' AND edit = 'K') OVER (PARTITION BY placed.conv_id ORDER BY p), FALSE) AS system
                  FROM placed LEFT JOIN numbered ON numbered.conv_id IS NOT DISTINCT FROM placed.conv_id AND numbered.n = placed.n AND edit <> 'I'
                  WHERE edit <> 'D'),
        written AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (turn - CAST(system AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END
                           || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS repaired_sha256 FROM turns GROUP BY conv_id)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(left(found, 6), '0') AS BIGINT) AS cost,
               coalesce(substr(found, 7), '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN written ON written.conv_id IS NOT DISTINCT FROM o.conv_id
    """


REPAIR = _repair_sql()

TRIE = rf"""
        WITH source AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
                               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
        turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS n FROM source),
        convs AS (SELECT DISTINCT conv_id AS c, {crc32('CAST(conv_id AS VARCHAR)')} % {prefix_trie.HEADS} AS h FROM source),
        rebuilt AS (SELECT c, 0 AS part, n, digest, words FROM convs JOIN turns ON conv_id = c - c % {prefix_trie.BLOCK} AND n <= h
                    UNION ALL SELECT c, 1, n, digest, words FROM convs JOIN turns ON conv_id = c AND n > h),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY part, n) AS d FROM rebuilt),
        members AS (SELECT c, d, words, string_agg(digest, '') OVER (PARTITION BY c ORDER BY d) AS path FROM numbered
                    UNION ALL SELECT c, 0, 0, '' FROM convs),
        nodes AS (SELECT path, d AS depth, min(c) AS conv_id, count(*) AS n, max(words) AS words FROM members GROUP BY path, d),
        ends AS (SELECT path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends_sha256
                 FROM (SELECT c, arg_max(path, d) AS path FROM members GROUP BY c) GROUP BY path),
        parents AS (SELECT left(path, len(path) - 32) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
        own AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, (n - 1) * words AS saved FROM nodes LEFT JOIN parents USING (path)),
        sums AS (SELECT left(path, 32 * up) AS path, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves
                 FROM own, LATERAL (SELECT unnest(range(0, depth + 1)) AS up) GROUP BY 1)
        SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n AS n_convs, a.n_children, leaves AS n_leaves,
               CAST(sums.saved AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
        FROM own a JOIN sums USING (path) LEFT JOIN ends USING (path)
        LEFT JOIN nodes p ON a.depth > 0 AND p.path = left(a.path, len(a.path) - 32)
    """
