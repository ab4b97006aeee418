"""Porter's suffix stripping (1980), and the clean-up of extracted phrases that uses it."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillon.functions import text as T

#: Suffixes and what replaces them, by step; a stem needs one vowel-consonant sequence at least for both.
STEP_2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous",
    ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
STEP_3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
#: Dropped where two such sequences are left.
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """``v`` and ``c`` for vowels and consonants; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            return base + table[suffix] if _measure(base) >= least else word
    return word


@lru_cache(maxsize=1 << 16)
def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    w = _replace(word, {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}, 0)
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            base = w[: -len(suffix)]
            if w.endswith(suffix) and "v" in _shape(base):
                if base.endswith(("at", "bl", "iz")) or (_measure(base) == 1 and _cvc(base)):
                    base += "e"
                elif _double(base) and base[-1] not in "lsz":
                    base = base[:-1]
                w = base
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, STEP_2, 1), STEP_3, 1)
    last = _replace(w, {s: "" for s in STEP_4} | {"ion": "\0"}, 2)
    if not last.endswith("\0"):
        w = last
    elif last[-2:-1] in ("s", "t"):
        w = last[:-1]
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _cvc(base)):
            w = base
    return w[:-1] if _measure(w) > 1 and _double(w) and w[-1] == "l" else w


def stemmed(words: Column) -> Column:
    """Stems of an array of words, in Arrow batches; null stays null."""

    @pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda own: None if own is None else [None if w is None else porter(w.lower()) for w in own])

    return run(words)


#: Prepositions that phrases lose, with one verb that is taken for one.
_DROPPED = ("a", "an", "the")


def clean_phrase(phrase: Column, prepositions: tuple[str, ...] | None = None, stem: bool = False) -> Column:
    """An extracted phrase without time mark, slashes, short forms, punctuation, articles and prepositions; optionally stemmed."""
    from quillon.operators.attributes import CLOSED

    gone = [*_DROPPED, *(prepositions if prepositions is not None else dict(CLOSED)["IN"].split())]
    text = F.regexp_replace(phrase, "^T:", "")
    text = T.expand_contractions(F.replace(F.replace(text, F.lit("/"), F.lit(" ")), F.lit("\\"), F.lit("")))
    words = F.filter(F.split(F.lower(F.regexp_replace(text, r"[\p{Punct}]", "")), r"\s+"), lambda w: (w != "") & ~w.isin(*gone))
    return F.array_join(stemmed(words) if stem else words, " ")
