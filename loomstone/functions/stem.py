"""Porter's suffix-stripping algorithm (M. F. Porter, 1980) over whole columns, one Arrow batch at a time."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"[^\W_]+")
# The suffix tables of the published algorithm.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(w: str) -> str:
    """The word as c and v; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _short_end(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def stem(w: str) -> str:
    """The stem of one lower-case word; words of one or two letters and words beyond a-z stay."""
    if len(w) <= 2 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        found = max((p for p in table if w.endswith(p[0])), key=lambda p: len(p[0]), default=None)
        if found and _measure(w[: -len(found[0])]) > 0:
            w = w[: -len(found[0])] + found[1]
    end = max((e for e in STEP4 if w.endswith(e)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)][-1:] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def folded(text: str) -> str:
    """Lower case without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def stems(texts: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def run(t: str) -> str:
        out = []
        for w in _WORD.findall(folded(t)):
            if w not in known:
                known[w] = stem(w)
            out.append(known[w])
        return " ".join(out)

    return texts.map(run, na_action="ignore")
