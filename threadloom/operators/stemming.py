"""The Porter stemmer (Porter, 1980), for a vocabulary of distinct words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = "aeiou"


def _consonant(word: str, i: int) -> bool:
    if word[i] in _VOWELS:
        return False
    return word[i] != "y" or i == 0 or not _consonant(word, i - 1)


def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    form = "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem)))
    return len(re.findall("v+c+", form))


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonant(word, len(word) - 1)


def _cvc(word: str) -> bool:
    n = len(word)
    return n > 2 and _consonant(word, n - 3) and not _consonant(word, n - 2) and _consonant(word, n - 1) and word[-1] not in "wxy"


# Suffixes and what they become, by step.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _replace(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > 0 else word
    return word


def stem(word: str) -> str:
    if len(word) > 64:
        return word
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    again = False
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and _has_vowel(word[:-2]):
        word, again = word[:-2], True
    elif word.endswith("ing") and _has_vowel(word[:-3]):
        word, again = word[:-3], True
    if again:
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _cvc(word):
            word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _STEP2), _STEP3)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or _measure(rest) == 1 and not _cvc(rest):
            word = rest
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def porter(word: str) -> Column:
    """Porter stems of a column of words."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(stem)

    return run(word)
