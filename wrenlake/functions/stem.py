"""The english analyser: suffix stripping after Porter (1980), run over distinct words only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_C, _V = "(?:[^aeiouy]|(?<=[aeiou])y|^y)", "(?:[aeiou]|(?<=[^aeiou])y)"
_MEASURE = re.compile(f"{_V}+{_C}+")
_HAS_VOWEL = re.compile(_V)
_CVC = re.compile(r"[^aeiou][aeiouy][^aeiouwxy]$")

# The published suffix pairs of steps 2 and 3, and the suffixes of step 4.
_STEP2 = dict(p.split(":") for p in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
_STEP3 = dict(p.split(":") for p in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _m(stem: str) -> int:
    return len(_MEASURE.findall(stem))


def _longest(word: str, suffixes) -> str | None:
    return max((x for x in suffixes if word.endswith(x)), key=len, default=None)


def porter(word: str) -> str:
    """The stem of a lower-case English word; words of two letters or with other characters stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) > 0 else w
    else:
        end = _longest(w, ("ed", "ing"))
        if end and _HAS_VOWEL.search(w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                w = w[:-1]
            elif _m(w) == 1 and _CVC.search(w):
                w += "e"
    if w.endswith("y") and _HAS_VOWEL.search(w[:-1]):
        w = w[:-1] + "i"
    for pairs in (_STEP2, _STEP3):
        end = _longest(w, pairs)
        if end and _m(w[: -len(end)]) > 0:
            w = w[: -len(end)] + pairs[end]
    end = _longest(w, _STEP4)
    if end and _m(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_m(w[:-1]) > 1 or (_m(w[:-1]) == 1 and not _CVC.search(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _m(w) > 1:
        w = w[:-1]
    return w


def stems(words: DataFrame) -> DataFrame:
    """(t, stem) of a one-column table of distinct words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"t": b["t"], "stem": [porter(w) for w in b["t"]]})

    return words.select(F.col(words.columns[0]).alias("t")).where("t is not null").mapInPandas(run, "t string, stem string")
