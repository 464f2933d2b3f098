"""Search for words that :func:`rowloom.llm.parse.close` accepts, over vocabularies of any size.

Two such words have a form in common that lacks a letter or two. The forms are not written out: each is a number computed
from sums over the beginnings of its word, for a batch of words at once, and they meet in buckets of packed numbers.
Equal numbers only propose a pair; whoever asks compares the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_R = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_BACK = pow(_R, -1, 1 << 64)
_M64 = (1 << 64) - 1
#: packed forms in a bucket, about; words whose forms are made at once; forms, and pairs of them, that are compared at once
_BUCKET, _WORDS, _AT_ONCE = 1_000_000, 5_000, 250_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _forms(words: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Numbers of the forms of words of one length, a row for each word. Words of lengths n <= m meet in the band of m: there the longer ones
    lack all letters that may be lost (one; two if both have eight or more), shorter ones as many less as they are shorter."""
    letters = _mixed(words.astype(f"U{n}").view(np.uint32).reshape(-1, n).astype(np.uint64) + np.uint64(0x1234567))
    sums = np.zeros((len(words), n + 1), np.uint64)
    np.cumsum(letters * np.array([pow(_R, k, 1 << 64) for k in range(n)], np.uint64), axis=1, out=sums[:, 1:])
    back, twice = np.uint64(_BACK), np.uint64(_BACK * _BACK & _M64)
    i = np.arange(n)
    whole = sums[:, n:]
    one = sums[:, i] + (whole - sums[:, i + 1]) * back

    def band(lost: int, m: int, forms: np.ndarray) -> np.ndarray:
        return _mixed(forms + np.uint64(_R * (2 * m + lost) & _M64))

    if n <= 8:
        yield band(0, n, one)
    if n < 8:
        yield band(0, n + 1, whole)
        return
    a, b = np.triu_indices(n, 1)
    yield band(1, n, sums[:, a] + (sums[:, b] - sums[:, a + 1]) * back + (whole - sums[:, b + 1]) * twice)
    yield band(1, n + 1, one)
    yield band(1, n + 2, whole)


def slip_numbers(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number, position of its word) of every form of words of three letters or more."""
    text = np.array(words, dtype=object)
    size = np.array([len(w) for w in words], int)
    numbers, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for n in np.unique(size[size >= 3]):
        at = np.flatnonzero(size == n)
        for forms in _forms(text[at], int(n)):
            numbers.append(forms.ravel())
            of.append(np.repeat(at, forms.shape[1]))
    return np.concatenate(numbers), np.concatenate(of)


def meeting(numbers: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (left id, right id) of different words with an equal number. The lowest bits of an id: 1 if left, 2 if right, 4 if two words written as one, of which only one may be in a pair.
    The numbers are taken in parts, so that what is held besides them does not follow their count; pairs may come once for each part."""
    parts = len(numbers) // _AT_ONCE + 1
    part = numbers % numbers.dtype.type(parts)
    for k in range(parts):
        here = np.flatnonzero(part == k)
        yield from _meeting(numbers[here], ids[here])


def _meeting(numbers: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    known, at = np.unique(ids, return_inverse=True)
    order = np.argsort(numbers, kind="stable")
    numbers, at = numbers[order], at[order]
    flags = known[at]
    l, r = at[flags & 1 > 0], at[flags & 2 > 0]
    key, other = numbers[flags & 1 > 0], numbers[flags & 2 > 0]
    first = np.searchsorted(other, key, "left")
    n = np.searchsorted(other, key, "right") - first
    l, first, n = l[n > 0], first[n > 0], n[n > 0]
    ends = np.cumsum(n)
    done = 0
    while done < len(n):
        last = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + _AT_ONCE, "right")))
        count = n[done:last]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        a, b = np.repeat(l[done:last], count), r[np.repeat(first[done:last], count) + step]
        keep = (a != b) & (known[a] & known[b] & 4 == 0)
        pair = np.unique(a[keep] * len(known) + b[keep])
        yield known[pair // len(known)], known[pair % len(known)]
        done = last


def alike(words: DataFrame) -> DataFrame:
    """(a, b): ids of the left and right words that may be close, each pair once.

    words: (id long, word string), a table that is read as often as asked; the lowest bits of an id are those of :func:`meeting`.
    """
    spark = words.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = F.length("word")
    forms = words.agg(F.sum(F.when(n < 8, n + 1).otherwise(n * (n + 1) / 2 + 1))).first()[0] or 0.0
    buckets = max(spread, int(forms / _BUCKET) + 1)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), _WORDS):
                some = batch.iloc[at : at + _WORDS]
                numbers, of = slip_numbers(some["word"].tolist())
                to = (numbers >> np.uint64(32)) % np.uint64(buckets)
                order = np.argsort(to, kind="stable")
                numbers, ids = numbers[order].astype(np.uint32), some["id"].to_numpy()[of[order]]
                cuts = np.searchsorted(to[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                yield pd.DataFrame({"bucket": full.astype(np.int32), "numbers": [numbers[cuts[k] : cuts[k + 1]].tobytes() for k in full], "ids": [ids[cuts[k] : cuts[k + 1]].tobytes() for k in full]})

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, ids = [], []
        for batch in batches:
            numbers += [np.frombuffer(x, np.uint32) for x in batch["numbers"]]
            ids += [np.frombuffer(x, np.int64) for x in batch["ids"]]
        for a, b in meeting(np.concatenate(numbers), np.concatenate(ids)):
            yield pd.DataFrame({"a": a, "b": b})

    made = words.repartition(max(spread, int(forms / _BUCKET) + 1)).mapInPandas(packed, "bucket int, numbers binary, ids binary")
    return made.groupBy("bucket").applyInPandas(met, "a long, b long").distinct()
