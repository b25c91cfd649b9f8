"""SQL forms of the text functions, for the SQL side of the queries."""

from __future__ import annotations

from gradewell.functions.text import WHITESPACE

_WS = f"'{WHITESPACE}'"


def strip(x: str) -> str:
    return f"trim({x}, {_WS})"


def normalize(x: str) -> str:
    return f"lower(trim({strip(x)}, '.'))"


def letters(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z]+', '', 'g')"


def polarity(x: str) -> str:
    return f"CASE WHEN contains({letters(x)}, 'positive') THEN 1 WHEN contains({letters(x)}, 'negative') THEN 0 END"


def match(x: str, labels: tuple[str, ...], missing: str = "nan") -> str:
    text = normalize(f"coalesce({x}, '{missing}')")
    exact = " ".join(f"WHEN {text} = '{n}' THEN '{n}'" for n in labels)
    inside = " ".join(f"WHEN contains({text}, '{n}') THEN '{n}'" for n in labels)
    return f"CASE {exact} {inside} ELSE '__invalid__' END"


def resolve(x: str, gold: str) -> str:
    text = normalize(x)
    return (
        f"CASE WHEN contains({text}, 'depression') THEN 'depression' WHEN contains({text}, 'normal') THEN 'normal' "
        f"WHEN {gold} = 'depression' THEN 'normal' ELSE 'depression' END"
    )


def option(x: str) -> str:
    return (
        f"nullif(regexp_extract(upper({x}), '(?:^|[^\\p{{L}}\\p{{N}}_])([A-D])(?:$|[^\\p{{L}}\\p{{N}}_])', 1), '')"
    )


def boolean(x: str) -> str:
    return f"CASE WHEN contains(lower({x}), 'true') THEN TRUE WHEN contains(lower({x}), 'false') THEN FALSE END"


def numbers(x: str) -> str:
    plain = f"replace(replace(coalesce({x}, ''), ',', ''), '$', '')"
    return f"CAST(regexp_extract_all({plain}, '[0-9]+\\.?[0-9]*') AS DOUBLE[])"


def capitalized(x: str) -> str:
    return f"upper(substr({strip(x)}, 1, 1)) || lower(substr({strip(x)}, 2))"


def finance_form(x: str) -> str:
    return (
        f"CASE dataset WHEN 'cfa_1000' THEN upper({strip(x)}) WHEN 'fiqasa' THEN lower({strip(x)}) "
        f"WHEN 'german_400' THEN lower({strip(x)}) ELSE {capitalized(x)} END"
    )


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


def macro(source: str, by: str = "dataset, model", weight: str = "1") -> str:
    """CTEs from (by, gold, pred) to ``label_scores`` and ``macro``: per-label scores and their plain means."""
    return f"""label_sums AS (
  SELECT {by}, label, CAST(sum(g) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted,
         CAST(sum(t) AS BIGINT) AS tp
  FROM (SELECT {by}, gold AS label, {weight} AS g, 0 AS p, CASE WHEN gold = pred THEN {weight} ELSE 0 END AS t
        FROM {source}
        UNION ALL
        SELECT {by}, pred AS label, 0, {weight}, 0 FROM {source})
  GROUP BY {by}, label),
label_scores AS (
  SELECT {by}, label, {div('tp', 'predicted')} AS precision, {div('tp', 'support')} AS recall,
         {div('2 * tp', 'support + predicted')} AS f1, support, tp FROM label_sums),
macro AS (
  SELECT {by}, CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy, avg(precision) AS precision,
         avg(recall) AS recall, avg(f1) AS f1, CAST(sum(support) AS BIGINT) AS scored
  FROM label_scores GROUP BY {by})"""
