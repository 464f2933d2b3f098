"""Problem 8: encoding of a whole corpus by a public byte-level BPE vocabulary.

Speculate and verify. Texts are cut into words by the vocabulary's pattern. For all new words of a batch at once,
greedy longest match proposes tokens (one vectorised trie walk over all byte positions), and every adjacent pair of
proposed tokens is tested for compatibility: a sequence is the merge order's own result exactly when no pair of
neighbours would have been merged across their border. Only words with a failing pair are merged step by step.

Null and empty texts have the empty list of ids. Special tokens are never produced; their strings are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "byte_bpe_50k"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Path of the rank file of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


class Bpe:
    """Byte-level BPE with vectorised proposal and verification; one instance a worker process."""

    #: words whose ids are remembered, and the longest word that is; both only bound memory
    REMEMBER, REMEMBER_BYTES = 200_000, 48

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        n = max(self.rank.values()) + 1
        token = [b""] * n
        for b, i in self.rank.items():
            token[i] = b
        self.length = np.array([len(b) for b in token], np.int64)
        self._trie(token)
        self._splits(token)
        self.known: dict[str, np.ndarray] = {}

    def _trie(self, token: list[bytes]) -> None:
        node, edges, accepts = {b"": 0}, [], [-1]
        for t in sorted(filter(None, token), key=len):
            at = 0
            for k in range(1, len(t) + 1):
                nxt = node.get(t[:k])
                if nxt is None:
                    nxt = node[t[:k]] = len(accepts)
                    edges.append((at * 256 + t[k - 1], nxt))
                    accepts.append(-1)
                at = nxt
            accepts[at] = self.rank[t]
        edges.sort()
        self.edge = np.array([e for e, _ in edges], np.int64)
        self.child = np.array([c for _, c in edges], np.int64)
        self.accepts = np.array(accepts, np.int64)

    def _splits(self, token: list[bytes]) -> None:
        """The two tokens whose merge gives each token (itself for a single byte), and the merge table."""
        n = len(token)
        left, right = np.arange(n), np.arange(n)
        merge = {}
        for t in range(n):
            b = token[t]
            if len(b) < 2:
                continue
            parts = self._merge(b, t)
            left[t], right[t] = parts
            merge[parts[0] * n + parts[1]] = t
        self.left, self.right = left, right
        keys = np.array(sorted(merge), np.int64)
        self.pair, self.merged = keys, np.array([merge[k] for k in keys.tolist()], np.int64)

    def _merge(self, word: bytes, below: int = 1 << 30) -> list[int]:
        """Exact merging in rank order (only merges of a rank under ``below``), O(n log n)."""
        rank, n = self.rank, len(word)
        end = list(range(1, n + 1))  # end[i]: end of the part that starts at i
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n:
                r = rank.get(word[i : end[j]])
                if r is not None and r < below:
                    heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, e = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != e:
                continue
            j = end[i]
            alive[j] = False
            end[i] = e
            if e < n:
                before[e] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(rank[word[i : end[i]]])
            i = end[i]
        return out

    def _look(self, table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merge order leaves a border between token a and token b, for arrays of pairs.

        Walking both tokens back through their own merges, newest first, no token pair that ever met at the border
        may have had a merge older than the merges that hid it.
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), 1 << 40)
        while len(at):
            j, hit = self._look(self.pair, a * len(self.left) + b)
            bad = hit & (self.merged[j] < limit)
            ok[at[bad]] = False
            undo_left = a > b
            la, rb = self.right[a], self.left[b]
            single_a, single_b = la == a, rb == b
            # the newer token is split; if it is a single byte, the other one is
            use_left = np.where(undo_left, ~single_a, single_b & ~single_a)
            stop = single_a & single_b
            limit = np.where(use_left, a, b + 1)
            a, b = np.where(use_left, la, a), np.where(use_left, b, rb)
            go = ~(bad | stop)
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return ok

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        buf = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        stop = np.repeat(ends, sizes)
        at = np.arange(len(buf))
        state, best, pos = np.zeros(len(buf), np.int64), np.full(len(buf), -1, np.int64), at
        while len(at):
            j, hit = self._look(self.edge, state * 256 + buf[pos])
            at, pos, state = at[hit], pos[hit] + 1, self.child[j[hit]]
            got = self.accepts[state]
            best[at[got >= 0]] = got[got >= 0]
            more = pos < stop[at]
            at, pos, state = at[more], pos[more], state[more]
        # greedy walk, all words in step
        word, cur = np.arange(len(words)), starts.copy()
        live = cur < ends
        word, cur = word[live], cur[live]
        who, what = [], []
        while len(word):
            t = best[cur]
            who.append(word)
            what.append(t)
            cur = cur + self.length[t]
            live = cur < ends[word]
            word, cur = word[live], cur[live]
        if not who:
            return [np.zeros(0, np.int64)] * len(words)
        who, what = np.concatenate(who), np.concatenate(what)
        order = np.argsort(who, kind="stable")
        who, what = who[order], what[order]
        inner = who[1:] == who[:-1]
        bad = np.zeros(len(words), bool)
        if inner.any():
            a, b = what[:-1][inner], what[1:][inner]
            bad[who[1:][inner][~self.compatible(a, b)]] = True
        out = np.split(what, np.searchsorted(who, np.arange(1, len(words))))
        for i in np.flatnonzero(bad):
            out[i] = np.array(self._merge(words[i]), np.int64)
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text."""
        cut = [self.find(t) if t else [] for t in texts]
        known = self.known
        if len(known) > self.REMEMBER:
            known.clear()
        new = list({w for ws in cut for w in ws if w not in known})
        got = dict(zip(new, self.encode_words([w.encode("utf-8", "surrogatepass") for w in new]), strict=True))
        out = []
        for ws in cut:
            parts = [got[w] if w in got else known[w] for w in ws]
            out.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
        known.update((w, g) for w, g in got.items() if len(w) <= self.REMEMBER_BYTES)
        return out


@lru_cache(maxsize=2)
def _bpe(path: str) -> Bpe:
    return Bpe(path)


def _slices(batches: Iterator[pa.RecordBatch], most_chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most_chars`` characters or a single text."""
    for batch in batches:
        sizes = np.array([len(x or "") for x in batch.column("text").to_pylist()])
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most_chars)))
            yield batch.slice(at, n)
            at += n


def encode_corpus(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, vocabulary: str | None = None, counts_only: bool = False) -> DataFrame:
    """(id, ids) of every row, or (id, n_tokens) with ``counts_only``.

    ``vocabulary`` is the path of a rank file (default: byte_bpe_50k of public_tokenizers). Other columns are ignored,
    null and empty texts give the empty list, repeated rows are kept, an empty table gives an empty result. Whole texts
    are read; a text of any length is one row.
    """
    path = vocabulary or vocabulary_path()
    kind = documents.schema[id_column].dataType
    out = T.StructType([T.StructField(id_column, kind), T.StructField("n_tokens", T.IntegerType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in _slices(batches):
            ids = bpe.encode(batch.column("text").to_pylist())
            sizes = np.array([len(x) for x in ids], np.int32)
            if counts_only:
                col = pa.array(sizes, pa.int32())
            else:
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                col = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), col], names=[id_column, "n_tokens" if counts_only else "ids"])

    picked = documents.select(documents[id_column].alias("id"), documents[text_column].alias("text"))
    return picked.mapInArrow(run, out)


def decode_corpus(encoded: DataFrame, id_column: str = "doc_id", *, vocabulary: str | None = None) -> DataFrame:
    """(id, text) of every row of :func:`encode_corpus`: the bytes of its tokens as UTF-8 text; an empty list gives the empty text."""
    path = vocabulary or vocabulary_path()
    kind = encoded.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {i: b for b, i in _bpe(path).rank.items()}
        for batch in batches:
            texts = [b"".join(token[i] for i in ids).decode() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=[id_column, "text"])

    return encoded.select(encoded[id_column].alias("id"), "ids").mapInArrow(run, T.StructType([T.StructField(id_column, kind), T.StructField("text", T.StringType())]))
