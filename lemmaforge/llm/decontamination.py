"""Benchmark decontamination: test suffixes searched in suffix arrays of the training text.

Each run of training rows (a shard of the corpus, about half a megabyte of text)
gets a suffix array over its word positions.  Only positions that begin a word pair
of some test item can begin a match, so the array is sparse: the others are
left out before sorting.  Suffixes are sorted as deep as the longest window.
Every test suffix is then searched by bisection; its range in the array is
the set of places where its first ``window`` words stand.  From there a match
is extended as far as it goes verbatim, for locations and lengths.

The test set is written once, cut into shards of bounded size by a hash of the
items' words.  A shard is collected, indexed and broadcast on its own, and a task
goes through them one after another; where there are more than LIVE_SHARDS, it
lets go of each before the next, so neither the driver nor a task holds more
tables beside its rows, whatever the size of the test set, and takes runs of
MANY_BYTES of text, so that shards are read again less often.  Items of equal words
are one sequence with several ids.  The training texts are never shuffled.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z, compared
by 64-bit hashes.  Null, empty and wordless texts have no words and are never
hit; texts of any length are read whole, and columns other than doc_id, item_id
and text are not read, whatever their names.  An item of fewer than ``window`` words, but at least one, is one window.
Repeated rows are judged each; repeated items count once per item id.  Empty
tables give empty results or clean documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from . import words as wk
from .memory import gathered, tidied

WINDOW = 10
#: Bytes of test text in one broadcast shard.
SHARD_BYTES = 4 << 20
#: Shards that a worker keeps in memory from one run of rows to the next.
LIVE_SHARDS = 4
#: Bytes of text in a run where there are more.
MANY_BYTES = 8 << 20

_PAIR_BITS = 20


class TestSuffixes:
    """The windows of some test items, ready to be searched for."""

    __test__ = False

    def __init__(self, items: list[tuple[Any, str]], window: int = WINDOW):
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        self.window = window
        sequences: list[np.ndarray] = []
        for lo, _, off, data in wk.slices(texts):
            starts, ends, first = wk.spans(off, data, wk.ALNUM)
            h = wk.hashes(starts, ends, data)
            sequences += [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.vocabulary = np.unique(np.concatenate([*sequences, np.empty(0, wk.U)]))
        #: the different sequences of words, and the ids of the items of each
        self.sequences: list[np.ndarray] = []
        self.ids: list[list[Any]] = []
        met: dict[bytes, int] = {}
        for (i, _), s in zip(items, sequences, strict=True):
            n = met.setdefault(s.tobytes(), len(met))
            if n == len(self.sequences):
                self.sequences.append(np.searchsorted(self.vocabulary, s) + 1)
                self.ids.append([])
            self.ids[n].append(i)
        found: dict[bytes, int] = {}
        self.lengths: list[int] = []
        places: list[list[tuple[int, int]]] = []
        rows = []
        for k, s in enumerate(self.sequences):
            for j in range(max(1, len(s) - window + 1) if len(s) else 0):
                part = s[j : j + window]
                w = found.setdefault(part.tobytes(), len(found))
                if w == len(places):
                    places.append([])
                    rows.append(np.pad(part, (0, window - len(part))))
                    self.lengths.append(len(part))
                places[w].append((k, j))
        #: test items and offsets of each window
        self.place_off = np.append(0, np.cumsum([len(x) for x in places])).astype(np.int64)
        self.place = np.array([y for x in places for y in x], np.int64).reshape(-1, 2)
        self.windows = np.array(rows, np.int64).reshape(-1, window)
        self.lengths = np.array(self.lengths, np.int64)
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.per = max(1, 63 // self.bits)
        self.low = self._keys(self.windows)
        pad = np.where(np.arange(window) < self.lengths[:, None], self.windows, (1 << self.bits) - 1)
        self.high = self._keys(pad)
        # word pairs that a match begins with, as a bit table of their hashes; single words for windows of one
        self.pairs = np.zeros(1 << _PAIR_BITS, bool)
        for s in sequences:
            if len(s) > 1:
                self.pairs[self._pair(s[:-1], s[1:])] = True
        self.single = np.unique(self.windows[self.lengths == 1][:, 0]) if len(self.windows) else np.empty(0, np.int64)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * wk.U(3) + b) >> wk.U(64 - _PAIR_BITS)).astype(np.int64)

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        """Rows of word ids as byte strings that sort alike."""
        parts = []
        for lo in range(0, self.window, self.per):
            acc = np.zeros(len(rows), np.uint64)
            for j in range(lo, min(lo + self.per, self.window)):
                acc = (acc << np.uint64(self.bits)) | rows[:, j].astype(np.uint64)
            parts.append(acc)
        return np.stack(parts, 1).astype(">u8").view(f"S{8 * len(parts)}").ravel() if len(rows) else np.empty(0, f"S{8 * -(-self.window // self.per)}")

    def search(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` (rows begin at ``first``) where windows stand, and the windows."""
        none = np.empty(0, np.int64)
        if not len(self.windows) or not len(h):
            return none, none
        likely = np.zeros(len(h), bool)
        likely[:-1] = self.pairs[self._pair(h[:-1], h[1:])]
        if len(self.single):
            likely |= np.isin(h, self.vocabulary[self.single - 1])
        at = np.flatnonzero(likely)
        if not len(at):
            return none, none
        end = first[1:][np.searchsorted(first, at, side="right") - 1]
        ids = np.zeros((len(at), self.window), np.int64)
        for j in range(self.window):
            p = np.minimum(at + j, len(h) - 1)
            x = np.minimum(np.searchsorted(self.vocabulary, h[p]), len(self.vocabulary) - 1)
            ids[:, j] = np.where((at + j < end) & (self.vocabulary[x] == h[p]), x + 1, 0)
            if j == 1 and not len(self.single):  # the bit table lets some pairs through
                keep = (ids[:, 0] > 0) & (ids[:, 1] > 0)
                at, end, ids = at[keep], end[keep], ids[keep]
        keys = self._keys(ids)
        order = np.argsort(keys, kind="stable")  # the suffix array
        keys = keys[order]
        lo, hi = np.searchsorted(keys, self.low, side="left"), np.searchsorted(keys, self.high, side="right")
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return at[order[lo[which] + inner]], which


def runs(t: TestSuffixes, first: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Maximal matches as rows of (row, sequence, its first word, first word in the row, words): windows that follow one another in both."""
    size = np.diff(t.place_off)[which]
    places = t.place[np.repeat(t.place_off[which], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    at, length = np.repeat(at, size), np.repeat(t.lengths[which], size)
    row = np.searchsorted(first, at, side="right") - 1
    order = np.lexsort((at, at - places[:, 1], places[:, 0], row))
    row, k, j, at, length = row[order], places[order, 0], places[order, 1], at[order], length[order]
    begins = np.ones(len(at), bool)
    begins[1:] = (row[1:] != row[:-1]) | (k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1) | (j[1:] != j[:-1] + 1)
    start = np.flatnonzero(begins)
    last = np.append(start[1:], len(at)) - 1
    return np.stack([row[start], k[start], j[start], at[start] - first[row[start]], at[last] + length[last] - at[start]], 1) if len(at) else np.empty((0, 5), np.int64)


def shards(benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> list[Broadcast]:
    """The test set in broadcast shards of about ``shard_bytes`` of text."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // shard_bytes) + 1
    if n == 1:
        return [spark.sparkContext.broadcast(TestSuffixes([(r["item_id"], r["text"]) for r in items.collect()], window))]
    shard = F.pmod(F.xxhash64(F.lower(F.coalesce("text", F.lit("")))), F.lit(n))
    kept = store.keep(items.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard"), "test-shards")
    out = [spark.sparkContext.broadcast(TestSuffixes([(r["item_id"], r["text"]) for r in kept.filter(F.col("shard") == s).collect()], window)) for s in range(n)]
    store.drop(kept)
    return out


def _hits(column: pa.Array, tests: list[Broadcast]) -> Iterator[tuple[int, np.ndarray, np.ndarray, Iterator[tuple[TestSuffixes, np.ndarray, np.ndarray]]]]:
    """For each run of rows: its first row, word hashes, rows' first words, and one shard after another with its hits."""
    for lo, _, off, data in wk.slices(column, wk.CHUNK if len(tests) <= LIVE_SHARDS else MANY_BYTES):
        starts, ends, first = wk.spans(off, data, wk.ALNUM)
        h = wk.hashes(starts, ends, data)

        def found(h: np.ndarray = h, first: np.ndarray = first) -> Iterator[tuple[TestSuffixes, np.ndarray, np.ndarray]]:
            for t in tests:
                at, which = t.value.search(h, first)
                if len(at):
                    yield t.value, at, which
                if len(tests) > LIVE_SHARDS and hasattr(t, "_value"):
                    del t._value  # read again from the worker's copy of the broadcast

        yield lo, h, first, found()


def _runs(batches: Iterator[pa.RecordBatch], tests: list[Broadcast]) -> Iterator[pa.RecordBatch]:
    """The batches, put together where many shards are gone through for each."""
    return batches if len(tests) <= LIVE_SHARDS else gathered(batches, size=MANY_BYTES)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words in any occurrence of a window), n_items, items_sha256, contaminated, and of its
    longest verbatim match the words (longest_match), where it begins (longest_at) and the least id, as text, of its items (longest_item)."""
    tests = shards(benchmark, window)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, tests):
            total = np.zeros(batch.num_rows, np.int64)
            hit, count, longest = total.copy(), total.copy(), total.copy()
            sha = np.full(batch.num_rows, hashlib.sha256(b"").hexdigest(), object)
            where: list[int | None] = [None] * batch.num_rows
            item: list[str | None] = [None] * batch.num_rows
            for lo, h, first, found in _hits(batch.column(1), tests):
                rows = slice(lo, lo + len(first) - 1)
                total[rows] = np.diff(first)
                edge = np.zeros(len(h) + 1, np.int64)
                items: dict[int, set[str]] = {}
                for t, at, which in found:
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + t.lengths[which], -1)
                    for row, k, _, p, n in runs(t, first, at, which).tolist():
                        ids = sorted(map(str, t.ids[k]))
                        items.setdefault(row, set()).update(ids)
                        if (-n, p, ids[0]) < (-longest[lo + row], where[lo + row] or 0, item[lo + row] or ""):
                            longest[lo + row], where[lo + row], item[lo + row] = n, p, ids[0]
                sums = np.append(0, np.cumsum(np.cumsum(edge[:-1]) > 0))
                hit[rows] = sums[first[1:]] - sums[first[:-1]]
                for row, own in items.items():
                    count[lo + row] = len(own)
                    sha[lo + row] = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
            columns = {"doc_id": batch.column(0), "n_words": pa.array(total), "n_hit": pa.array(hit), "n_items": pa.array(count), "items_sha256": pa.array(sha, pa.string()), "contaminated": pa.array(hit > 0)}
            columns |= {"longest_match": pa.array(longest), "longest_at": pa.array(where, pa.int64()), "longest_item": pa.array(item, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_at long, longest_item string")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The maximal verbatim matches: doc_id, item_id, item_word and doc_word (starts, from 0), n_words (longest)."""
    tests = shards(benchmark, window)
    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", benchmark.schema["item_id"].dataType)] + [T.StructField(c, T.LongType()) for c in ("item_word", "doc_word", "n_words")])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, tests):
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for lo, _, first, found in _hits(batch.column(1), tests):
                for t, at, which in found:
                    out += [(ids[lo + row], i, j, p, n) for row, k, j, p, n in runs(t, first, at, which).tolist() for i in t.ids[k]]
            out.sort(key=str)
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, x, strict=True)) for x in out], schema=_arrow(kind))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


def _arrow(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a window of the test set, in one pass over the texts."""
    tests = shards(benchmark, window)
    text = docs.columns.index("text")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, tests):
            keep = np.ones(batch.num_rows, bool)
            for lo, _, first, found in _hits(batch.column(text), tests):
                for _, at, _ in found:
                    keep[lo + np.searchsorted(first, at, side="right") - 1] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
