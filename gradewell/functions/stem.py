"""Porter stemming of English words (Porter 1980, with the extensions common in public toolkits)."""

from __future__ import annotations

from functools import lru_cache

# Irregular words and the suffix rules of the published algorithm.
IRREGULAR = {
    "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "innings": "inning", "outings": "outing",
    "cannings": "canning",
} | {word: word for word in ("sky", "news", "inning", "outing", "canning", "howe", "proceed", "exceed", "succeed")}
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
)
STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """The word as v (vowel) and c (consonant); y is a vowel after a consonant."""
    out = []
    for i, ch in enumerate(word):
        out.append("v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _ends_cvc(word: str) -> bool:
    shape = _shape(word)
    return (shape.endswith("cvc") and len(word) >= 3 and word[-1] not in "wxy") or (len(word) == 2 and shape == "vc")


def _double_consonant(word: str) -> bool:
    return len(word) >= 2 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _plural(word: str) -> str:
    if word.endswith("ies") and len(word) == 4:
        return word[:-1]
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            return word[: len(word) - len(suffix)] + new
    return word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double_consonant(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _ends_cvc(stem) else stem
    return word


def _final_y(word: str) -> str:
    stem = word[:-1]
    return stem + "i" if word.endswith("y") and len(stem) > 1 and _shape(stem)[-1] == "c" else word


def _derived(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _derived(word[:-4] + "al")
    for suffix, new in STEP2:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            measured = word[:-3] if suffix == "logi" else stem
            return stem + new if _measure(measured) > 0 else word
    return word


def _adjective(word: str) -> str:
    for suffix, new in STEP3:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


def _long_suffix(word: str) -> str:
    for suffix in STEP4:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            fits = suffix != "ion" or stem[-1:] in ("s", "t")
            return stem if _measure(stem) > 1 and fits else word
    return word


def _final_e(word: str) -> str:
    if not word.endswith("e"):
        return word
    stem = word[:-1]
    m = _measure(stem)
    return stem if m > 1 or (m == 1 and not _ends_cvc(stem)) else word


def _final_ll(word: str) -> str:
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of one lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    for step in (_plural, _past, _final_y, _derived, _adjective, _long_suffix, _final_e, _final_ll):
        word = step(word)
    return word
