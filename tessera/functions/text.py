"""Column functions on text, all in the JVM but the stemmer."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits, in order; null and empty texts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def content_hash(*fields: Column | str) -> Column:
    """SHA-256 over length-prefixed fields (byte length, NUL, field), so that no two field lists collide; null counts as empty."""
    parts = []
    for f in fields:
        v = F.coalesce(_c(f).cast("string"), F.lit(""))
        parts += [F.octet_length(v).cast("string"), F.lit("\0"), v]
    return F.sha2(F.concat(*parts), 256)


def slug(c: Column | str) -> Column:
    """Lower case, runs of other characters than letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def first_line(c: Column | str, most: int = 140) -> Column:
    return F.substring(F.trim(F.substring_index(_c(c), "\n", 1)), 1, most)


def collapse(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def contains_literal(c: Column | str, needle: str) -> Column:
    """Literal substring without regard to case: no pattern characters."""
    return F.contains(F.lower(_c(c)), F.lit(needle.lower()))


def normalize_package(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(_c(c))), "-", "_")


def parents(c: Column | str) -> Column:
    """All dotted prefixes of a name, shortest first, the name itself last."""
    parts = F.split(_c(c), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: * and ? stay within a segment, **/ spans any number of them."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


_VOWEL = "aeiou"


def _measure(stem: str) -> int:
    shape = "".join("v" if ch in _VOWEL or (ch == "y" and i and stem[i - 1] not in _VOWEL) else "c" for i, ch in enumerate(stem))
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", shape)))


def _has_vowel(stem: str) -> bool:
    return any(ch in _VOWEL or (ch == "y" and i and stem[i - 1] not in _VOWEL) for i, ch in enumerate(stem))


def _cvc(w: str) -> bool:
    if len(w) < 3 or w[-1] in "wxy":
        return False
    con = lambda i: not (w[i] in _VOWEL or (w[i] == "y" and i and w[i - 1] not in _VOWEL))
    n = len(w)
    return con(n - 3) and not con(n - 2) and con(n - 1)


# Suffix tables of Porter's published algorithm.
_STEP2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
_STEP3 = "icate ic ative - alize al iciti ic ical ic ful - ness -".split()
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """Porter's stemmer for one lower-case English word."""
    w = word
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "lsz" and w[-1] not in _VOWEL:
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table, least in ((_STEP2, 0), (_STEP3, 0)):
        for end, new in sorted(zip(table[::2], table[1::2], strict=True), key=lambda x: -len(x[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > least:
                    w = w[: -len(end)] + ("" if new == "-" else new)
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem(c: Column | str) -> Column:
    """Stems of an array of words; Arrow batches, each distinct word of a batch stemmed once."""
    @F.pandas_udf("array<string>")
    def run(s):  # noqa: ANN001, ANN202
        seen: dict[str, str] = {}
        return s.map(lambda ws: None if ws is None else [seen[w] if w in seen else seen.setdefault(w, porter(w)) for w in ws])

    return run(_c(c))
