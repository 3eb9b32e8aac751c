"""Index terms as full-text tables with a Porter tokenizer make them: fold, split, stem (M. F. Porter, 1980)."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_V = "aeiou"


def _cons(w: str, i: int) -> bool:
    return w[i] not in _V and not (w[i] == "y" and i and _cons(w, i - 1))


def _measure(w: str) -> int:
    kinds = "".join("c" if _cons(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _vowel(w: str) -> bool:
    return any(not _cons(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _cons(w, n - 1) and not _cons(w, n - 2) and _cons(w, n - 3) and w[-1] not in "wxy"


#: Suffixes of the published algorithm's steps 2 to 4, longest match first.
_STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", logi="log", bli="ble", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_ENDS2, _ENDS3 = (tuple(sorted(t, key=len, reverse=True)) for t in (_STEP2, _STEP3))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
_ENDS4 = tuple(sorted(_STEP4, key=len, reverse=True))


@lru_cache(maxsize=1 << 19)
def porter(w: str) -> str:
    """The stem of a lower-case word; other than ASCII words and very short or long ones stay."""
    if len(w) < 3 or len(w) > 64 or not w.isascii() or not w.isalpha():
        return w
    for old, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")) if w.endswith("s") else ():
        if w.endswith(old):
            w = w[: len(w) - len(old)] + new
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table, ends in ((_STEP2, _ENDS2), (_STEP3, _ENDS3)):
        for old in ends if w.endswith(ends) else ():
            if w.endswith(old):
                if _measure(w[: -len(old)]) > 0:
                    w = w[: -len(old)] + table[old]
                break
    for old in _ENDS4 if w.endswith(_ENDS4) else ():
        if w.endswith(old):
            base = w[: -len(old)]
            if _measure(base) > 1 and (old != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _cvc(base):
            w = base
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


#: Combining marks, which go.
_MARKS = re.compile("[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c)) + "]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in order, without case and diacritics; underscores split."""
    if not text:
        return []
    if text.isascii():
        return re.findall(r"[a-z0-9]+", text.lower())
    return re.findall(r"[^\W_]+", _MARKS.sub("", unicodedata.normalize("NFD", text.lower())))


def terms(text: str | None) -> list[str]:
    """Stemmed index terms in order."""
    return [porter(w) for w in words(text)]


@F.pandas_udf(T.ArrayType(T.StringType()))  # type: ignore[call-overload]
def terms_col(text: pd.Series) -> pd.Series:
    return text.map(terms)
