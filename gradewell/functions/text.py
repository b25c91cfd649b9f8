"""Cleaning and parsing of answer text: Column in, Column out, no Python workers.

``null_as_text`` keeps the older convention in which a missing value is read as the word
``nan``; the default leaves null as null.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a missing cell in a CSV file, and the word for a missing value.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
NULL_WORD = "nan"
INVALID = "__invalid__"
ERROR_PREFIX = "[Error] "

# Every character that Unicode-aware stripping removes, and every decimal digit outside 0-9.
WHITESPACE = "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())
_FOREIGN_DIGITS = "".join(
    chr(i) for i in range(128, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd"
)
_ASCII_DIGITS = "".join(str(unicodedata.decimal(d)) for d in _FOREIGN_DIGITS)

_NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
_NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"
_SPACE = r"[\s\x1c-\x1f]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c: Column | str, null_as_text: bool = False) -> Column:
    """Text form of a column; with ``null_as_text`` a missing value becomes ``nan``."""
    text = _col(c).cast("string")
    return F.coalesce(text, F.lit(NULL_WORD)) if null_as_text else text


def null_tokens_to_null(c: Column | str, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Cells holding a missing-value token become null."""
    c = _col(c)
    return F.when(c.isin(list(tokens)), F.lit(None)).otherwise(c)


def strip(c: Column | str) -> Column:
    """Remove Unicode white space on both ends."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def normalize_answer(c: Column | str, null_as_text: bool = False) -> Column:
    """strip space, then dots, then lower; a blank before a removed dot stays."""
    return F.lower(F.btrim(strip(as_text(c, null_as_text)), F.lit(".")))


def letters_only(c: Column | str, null_as_text: bool = False) -> Column:
    """lower case, keep a to z."""
    return F.regexp_replace(F.lower(as_text(c, null_as_text)), "[^a-z]+", "")


def polarity(c: Column | str, ignore_spacing: bool = True) -> Column:
    """1 if the text contains "positive", else 0 if it contains "negative", else null.

    With ``ignore_spacing`` only letters count, so "posi-tive" and "posi tive" match too.
    """
    text = letters_only(c) if ignore_spacing else F.lower(_col(c))
    return F.when(text.contains("positive"), 1).when(text.contains("negative"), 0)


def match_label(c: Column | str, labels: Sequence[str], null_as_text: bool = True) -> Column:
    """the exact label, else the first label in list order inside the text, else ``__invalid__``."""
    text = normalize_answer(c, null_as_text)
    found = [F.when(text == label, F.lit(label)) for label in labels]
    found += [F.when(text.contains(label), F.lit(label)) for label in labels]
    return F.coalesce(*found, F.lit(INVALID))


def resolve_or_wrong(
    c: Column | str, gold: Column | str, positive: str = "depression", negative: str = "normal"
) -> Column:
    """the label inside the text; an answer with neither is turned into the opposite of gold."""
    text, gold = normalize_answer(c), _col(gold)
    return (
        F.when(text == positive, positive)
        .when(text == negative, negative)
        .when(text.contains(positive), positive)
        .when(text.contains(negative), negative)
        .when(gold == positive, negative)
        .otherwise(positive)
    )


def normalize_prediction(c: Column | str, labels: Sequence[str] = ("depression", "normal")) -> Column:
    """one plain word is lowered, else a contained label, else the text unchanged."""
    c = _col(c)
    text = F.lower(strip(c))
    out = F.when(text.rlike("^[a-z]+$"), text)
    for label in labels:
        out = out.when(text.contains(label), label)
    return out.otherwise(c)


def extract_option(c: Column | str) -> Column:
    """first stand-alone letter A to D of the upper-cased text (so the article "a" counts)."""
    pattern = f"{_NOT_AFTER_WORD}([A-D]){_NOT_BEFORE_WORD}"
    return F.nullif(F.regexp_extract(F.upper(_col(c).cast("string")), pattern, 1), F.lit(""))


def extract_bool(c: Column | str) -> Column:
    """F8: true if the text contains "true", else false if it contains "false", else null."""
    text = F.lower(_col(c).cast("string"))
    return F.when(text.contains("true"), True).when(text.contains("false"), False)


def _number_text(c: Column | str, any_script: bool) -> Column:
    """Text in which numbers are runs of ASCII digits with an optional point."""
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    for sign in (",", "$"):
        text = F.replace(text, F.lit(sign), F.lit(""))
    if any_script:
        foreign = (F.octet_length(text) != F.length(text)) & text.rlike(r"[\p{Nd}&&[^0-9]]")
        text = F.when(foreign, F.translate(text, _FOREIGN_DIGITS, _ASCII_DIGITS)).otherwise(text)
    return text


def extract_numbers(c: Column | str, any_script: bool = True) -> Column:
    """all unsigned numbers after dropping ``,`` and ``$``, as array<double>; null gives no numbers.

    ``any_script`` also reads decimal digits of other scripts. Only texts with non-ASCII bytes can hold them, which
    two lengths tell without a scan for the digits.
    """
    return F.regexp_extract_all(_number_text(c, any_script), F.lit(r"([0-9]+\.?[0-9]*)"), F.lit(1)).cast("array<double>")


def first_number(c: Column | str, any_script: bool = True) -> Column:
    """F9, its first number only; null without any."""
    return F.nullif(F.regexp_extract(_number_text(c, any_script), r"([0-9]+\.?[0-9]*)", 1), F.lit("")).cast("double")


def case_form(c: Column | str, form: str, null_as_text: bool = False) -> Column:
    """upper, lower or capitalised (first letter only) text after stripping."""
    text = strip(as_text(c, null_as_text))
    if form == "upper":
        return F.upper(text)
    if form == "lower":
        return F.lower(text)
    if form == "capitalize":
        return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))
    raise ValueError(f"unknown case form {form!r}")


def drop_answer_cue(c: Column | str) -> Column:
    """strip, then drop a closing "Answer:"."""
    pattern = f"(?iU){_NOT_AFTER_WORD}answer{_SPACE}*[:：]?{_SPACE}*\\z"
    return strip(F.regexp_replace(strip(c), pattern, ""))


def trimmed(c: Column | str) -> Column:
    """missing becomes empty, then strip."""
    return strip(F.coalesce(_col(c), F.lit("")))


def first_nonblank(first: Column | str, second: Column | str) -> Column:
    """the first text, or the second where the first is empty."""
    first = _col(first)
    return F.when(F.length(first) > 0, first).otherwise(_col(second))


def last_letter(c: Column | str) -> Column:
    """F16: last character of the stripped, lowered text; empty if there is none."""
    return F.right(F.lower(strip(F.coalesce(_col(c), F.lit("")))), F.lit(1))


def chosen_value(answer: Column | str, value_a: Column | str, value_b: Column | str) -> Column:
    """the value of choice a, or of choice b for every other answer."""
    return F.when(_col(answer) == "a", _col(value_a)).otherwise(_col(value_b))


def after_marker(c: Column | str, marker: str = "assistant") -> Column:
    """lowered text after the first marker, or the text as it is where there is none."""
    c = _col(c)
    lowered = F.lower(strip(c))
    start = F.instr(lowered, marker)
    return F.when(start > 0, strip(F.substr(lowered, start + F.lit(len(marker))))).otherwise(strip(c))


def is_error(c: Column | str) -> Column:
    """the answer is a recorded failure."""
    return F.coalesce(_col(c).startswith(ERROR_PREFIX.strip()), F.lit(False))


def sibling_path(c: Column | str, suffix: str) -> Column:
    """``x.csv`` becomes ``x`` + suffix, as in ``.invalid.csv`` or ``.processed.csv``."""
    return F.replace(_col(c), F.lit(".csv"), F.lit(suffix))


def dataset_of_file(c: Column | str) -> Column:
    """file name without ``_results.csv``."""
    return F.replace(_col(c), F.lit("_results.csv"), F.lit(""))


def presentation(c: Column | str, places: int = 4) -> Column:
    """rounding for reports only; metrics themselves stay unrounded."""
    return F.round(_col(c), places)


def checked_label(c: Column | str, allowed: Sequence[str], default: str) -> Column:
    """lowered, stripped answer of a labeller; anything unexpected becomes the default."""
    text = F.lower(strip(c))
    return F.when(text.isin(list(allowed)), text).otherwise(F.lit(default))


def map_label(c: Column | str, labels: Mapping[str, str] | None, default: str | None = None) -> Column:
    """Label code to name; an unknown code becomes null, or the default if one is given."""
    text = _col(c).cast("string")
    if labels is None:
        return text
    pairs = reduce(lambda acc, item: acc + [F.lit(item[0]), F.lit(item[1])], labels.items(), [])
    name = F.create_map(*pairs)[text]
    return F.coalesce(name, F.lit(default)) if default is not None else name


def contains_any(c: Column | str, labels: Sequence[str]) -> Column:
    """True where the text contains one of the labels; a missing text contains none."""
    c = _col(c)
    hits = [c.contains(label) for label in labels]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False)) if hits else F.lit(False)


def smoothed(p: Column | str, epsilon: float = 1e-12) -> Column:
    """a zero share is replaced by epsilon, without renormalising."""
    p = _col(p)
    return F.when(p == 0, F.lit(epsilon)).otherwise(p)


def ratio(a: Column | str, b: Column | str, empty: float | None = 0.0) -> Column:
    """A / b as double; a zero denominator gives ``empty``."""
    out = F.try_divide(_col(a).cast("double"), _col(b).cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(float(empty)))
