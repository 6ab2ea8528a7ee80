"""Porter's stemmer word by word, as the published algorithm says it; the reference of the column chain."""

from __future__ import annotations

import re

from basketloom.functions.stems import _STEP2, _STEP3, _STEP4


def _shape(stem: str) -> str:
    """The stem as a string of c (consonant) and v (vowel)."""
    out = []
    for char in stem:
        vowel = char in "aeiou" or (char == "y" and out and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", _shape(stem))))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_ending(word: str) -> bool:
    """Consonant, vowel, consonant (not w, x or y) at the end."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, rules, least: int) -> str:
    for suffix, new in sorted(rules, key=lambda rule: -len(rule[0])):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if suffix == "ion" and not stem.endswith(("s", "t")):
                return word
            return stem + new if _measure(stem) >= least else word
    return word


def _tidy(word: str) -> str:
    """After -ed or -ing went: restore an e or undouble the last consonant."""
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if _double_consonant(word) and word[-1] not in "lsz":
        return word[:-1]
    if _measure(word) == 1 and _short_ending(word):
        return word + "e"
    return word


def porter_stem(word: str) -> str:
    word = word.lower()
    if len(word) <= 2:
        return word
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past and continuous forms
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                if _has_vowel(word[: -len(suffix)]):
                    word = _tidy(word[: -len(suffix)])
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, _STEP2, 1)
    word = _replace(word, _STEP3, 1)
    word = _replace(word, _STEP4, 2)
    # final e and double l
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_ending(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
