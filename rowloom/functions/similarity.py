"""Similarities that Spark has no expression for, as Arrow-batched functions with a memo of the pairs seen last."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.fixed import SHORT_NAMES


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one number (one addition a letter)."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@lru_cache(maxsize=1 << 16)
def indel_ratio(a: str, b: str) -> float:
    """2·LCS / (|a| + |b|); two empty texts are equal."""
    total = len(a) + len(b)
    return 2 * common_length(a, b) / total if total else 1.0


def token_sort_ratio(a: str, b: str) -> float:
    """:func:`indel_ratio` of the words in order."""
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@lru_cache(maxsize=1 << 16)
def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth of the rest per common first letter (four at most) where it is over 0.7."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free = [True] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, f in zip(b, free, strict=True) if not f]
    m, turned = len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - turned) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def within_one(a: str, b: str) -> bool:
    """At most one letter inserted, lost or replaced."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


_FULL = {k: frozenset(v.split()) for k, v in SHORT_NAMES.items()}
_KNOWN = frozenset(w for v in _FULL.values() for w in v)


def _stands_for(word: str) -> frozenset[str]:
    own = _FULL.get(word, frozenset())
    return own | {word} if word in _KNOWN else own


def _may_begin(word: str) -> set[str]:
    full = _stands_for(word)
    return {word[:1]} | {x[0] for x in full} | {k[0] for k, v in _FULL.items() if v & full}


RELATIONS = ("different", "initial", "similar", "nickname", "same")


@lru_cache(maxsize=1 << 16)
def token_relation(a: str, b: str) -> int:
    """How two given names relate, as a position in :data:`RELATIONS`."""
    if a == b:
        return 1 if len(a) == 1 else 4
    short, long = sorted((a, b), key=len)
    if len(short) == 1:
        return int(len(long) > 1 and short in _may_begin(long))
    if _stands_for(a) & _stands_for(b) or len(short) >= 3 and long.startswith(short):
        return 3
    near = len(short) >= 4 and jaro_winkler(a, b) >= 0.92 or len(short) >= 5 and within_one(a, b)
    return 2 if near else 0


def given_relation(a: list[str], b: list[str]) -> int:
    """The best relation of any two given names of two people."""
    return max((token_relation(x, y) for x in a for y in b), default=0)


def swapped(a: tuple, b: tuple) -> bool:
    """Whether two (given names, surname) are one name with the order turned."""
    return given_relation(a[0], [b[1]]) > 0 and given_relation([a[1]], b[0]) > 0


def different_people(a: tuple, b: tuple) -> bool:
    return given_relation(a[0], b[0]) == 0 and not swapped(a, b)


def _float_udf(f):  # noqa: ANN001, ANN202
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.DoubleType())


#: Column functions of two texts; null if either is
token_sort = _float_udf(token_sort_ratio)
indel = _float_udf(indel_ratio)
winkler = _float_udf(jaro_winkler)

_PERSON = T.StructType([T.StructField("relation", T.StringType()), T.StructField("surname", T.DoubleType()), T.StructField("swapped", T.BooleanType())])


@F.pandas_udf(_PERSON)
def people(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """struct(relation, surname similarity, swapped) of (given, surname, given, surname); null where either is no person."""
    for ga, sa, gb, sb in batches:
        out = []
        for a, s, b, u in zip(ga, sa, gb, sb, strict=True):
            if a is None or b is None:
                out.append((None, None, None))
                continue
            a, b = list(a), list(b)
            k = given_relation(a, b)
            out.append((RELATIONS[k], jaro_winkler(s, u), k == 0 and swapped((a, s), (b, u))))
        yield pd.DataFrame(out, columns=["relation", "surname", "swapped"])
