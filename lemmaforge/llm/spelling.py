"""Spelling variants: words at one edit from each other, and the form that a rare word most likely stands for.

Two words are near if one inserted, deleted or replaced code point makes one of
the other: then some edit position has an equal prefix before it and an equal
suffix behind it.  For each edit position of a word, the words with its prefix
are an interval in forward order and those with its suffix an interval in
reverse order; the near words are the points of that rectangle, which a wavelet
tree over the permutation (forward rank to reverse rank) reports.

No task holds the vocabulary.  Class M has the words of M code points and of
M - 1; within it, a pair that differs at a position of [x, y) has x code points
in front and M - y behind in common.  Words are dealt by that key for the two
halves of each class, and groups above ``MOST_GROUP`` words by the halves of
their range again, until a range is one position, where a group has a word for
each code point at most.  So every near pair meets in exactly one group, and a
common prefix or suffix, however hot, is dealt out by what else the words share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import words as wk
from .memory import gathered, tidied

#: Words of a group that is searched as a whole.
MOST_GROUP = 500
#: Rows, and bytes of words, searched together (whole groups); rectangles taken at a time.
RUN_ROWS, RUN_BYTES, RUN_QUERIES = 60_000, 16 << 20, 150_000
#: Bytes of text worked on at a time.
TEXT_BYTES = 8 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _runs(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in bytes of the maximal runs of A-Z, a-z and U+00C0 to U+00FF, and each row's first run."""
    inside = _LETTER[data]
    wide = np.flatnonzero(data == 0xC3)  # the first of the two bytes of U+00C0 to U+00FF
    inside[wide] = True
    inside[wide + 1] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    cut = off[off < len(data)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, off)


def _counted(ids: list, off: np.ndarray, data: np.ndarray, modulus: int, least: int) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of at least ``least`` code points of some rows and how often each occurs, after the deletions.

    The checksum of ``<doc_id>:<run>`` is linear in its parts, so it is the
    exclusive or of one number for the run and one for the row and its length.
    """
    starts, ends, first = _runs(off, data)
    size = ends - starts
    flat_off = np.append(0, np.cumsum(size))
    at = np.repeat(starts - flat_off[:-1], size) + np.arange(flat_off[-1])
    flat = np.ascontiguousarray(wk.LOWER[data[at]])
    coded = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(flat_off.astype(np.int64)), pa.py_buffer(flat)).dictionary_encode()
    code, runs = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    raw = [x.encode() for x in runs]
    zero = {n: zlib.crc32(bytes(n)) for n in set(map(len, raw))}
    own = np.fromiter((zlib.crc32(x) ^ zero[len(x)] for x in raw), np.uint32, len(raw))
    row = np.repeat(np.arange(len(ids)), np.diff(first))
    pairs, which = np.unique(row * (int(size.max(initial=0)) + 1) + size, return_inverse=True)
    front = [zlib.crc32(f"{'' if x is None else x}:".encode()) for x in ids]
    width = int(size.max(initial=0)) + 1
    shifted = np.fromiter((zlib.crc32(bytes(n), front[r]) for r, n in zip((pairs // width).tolist(), (pairs % width).tolist(), strict=True)), np.uint32, len(pairs))
    h = own[code] ^ shifted[which]
    hit = h % np.uint32(modulus) == 0
    count = np.bincount(code[~hit], minlength=len(runs))
    out = {x: n for x, n in zip(runs, count.tolist(), strict=True) if n and len(x) >= least}
    for c, x in zip(code[hit].tolist(), h[hit].tolist(), strict=True):
        word = runs[c]
        k = x % len(word)
        word = word[:k] + word[k + 1 :]
        if len(word) >= least:
            out[word] = out.get(word, 0) + 1
    return pa.array(list(out), pa.string()), np.fromiter(out.values(), np.int64, len(out))


def vocabulary(docs: DataFrame, modulus: int = 97, least_size: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: the words of all texts of ``docs`` (doc_id, text) and how often they occur.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; a
    run whose CRC-32 of ``<doc_id>:<run>`` is a multiple of ``modulus`` loses
    one code point first.  A null text has none; a null doc_id reads as nothing.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, size=TEXT_BYTES):
            for lo, hi, off, data in wk.slices(batch.column(1), TEXT_BYTES):
                if len(data):
                    word, n = _counted(batch.column(0).slice(lo, hi - lo).to_pylist(), off, data, modulus, least_size)
                    yield pa.RecordBatch.from_arrays([word, pa.array(n)], ["word", "n"])

    found = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class WaveletTree:
    """Points (i, values[i]) of a permutation, level by level from the highest bit of the values, zeros before ones."""

    def __init__(self, values: np.ndarray):
        self.levels: list[tuple[np.ndarray, int]] = []
        seq = values.astype(np.int64)
        self.height = max(1, int(len(seq) - 1).bit_length())
        for bit in range(self.height - 1, -1, -1):
            one = (seq >> bit & 1).astype(bool)
            zeros = np.zeros(len(seq) + 1, np.int64)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((zeros, int(zeros[-1])))
            seq = np.concatenate([seq[~one], seq[one]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of all points with left <= i < right and low <= value < high, for many rectangles at once."""
        which, node = np.arange(len(left)), np.zeros(len(left), np.int64)
        for depth, (zeros, n_zeros) in enumerate(self.levels):
            span = 1 << (self.height - 1 - depth)
            l0, r0 = zeros[left], zeros[right]
            left = np.concatenate([l0, left - l0 + n_zeros])
            right = np.concatenate([r0, right - r0 + n_zeros])
            node = np.concatenate([node, node + span])
            which = np.concatenate([which, which])
            some = (left < right) & (node < high[which]) & (node + span > low[which])
            left, right, node, which = left[some], right[some], node[some], which[some]
        return which, node


def _shared(texts: list[bytes], group: np.ndarray, order: np.ndarray, limit: int = 8 << 20) -> np.ndarray:
    """Common leading bytes of each text in ``order`` and the one before it, 0 between groups and for the first."""
    out, lo, n = np.zeros(len(order), np.int64), 1, len(order)
    while lo < n:
        width, hi = 0, lo
        while hi < n and (width := max(width, len(texts[order[hi]]), len(texts[order[hi - 1]]))) * (hi - lo + 2) <= limit:
            hi += 1
        hi = max(hi, lo + 1)
        some = [texts[i] for i in order[lo - 1 : hi]]
        width = max(map(len, some)) + 1
        grid = np.array(some, f"S{width}").view(np.uint8).reshape(len(some), width)
        differs = grid[1:] != grid[:-1]
        out[lo:hi] = np.where(differs.any(1), differs.argmax(1), width)
        lo = hi
    same = group[order[1:]] == group[order[:-1]]
    out[1:][~same] = 0
    return out


class _Depth:
    """Intervals of sorted texts around one that share at least some leading bytes with it, by range minima."""

    def __init__(self, shared: np.ndarray):
        self.table = [shared]
        while (step := 1 << len(self.table) - 1) * 2 <= len(shared):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))

    def interval(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-last ranks; depth is at least 1, and ``shared`` is 0 where a group begins."""
        left, right = at.copy(), at + 1
        n = len(self.table[0])
        for k in range(len(self.table) - 1, -1, -1):
            step, least = 1 << k, self.table[k]
            # ranks left-step+1 .. left all go on
            more = left - step + 1 >= 0
            more[more] = least[left[more] - step + 1] >= depth[more]
            left = left - step * more
            more = right + step <= n
            more[more] = least[right[more]] >= depth[more]
            right = right + step * more
        return left, right


def _search(group: np.ndarray, words: list[bytes], size: np.ndarray, top: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, near row) in both directions of rows in whole groups: latin-1 words, their class ``top``, edit positions low to high."""
    n = len(words)
    back = [x[::-1] for x in words]
    g = group.tolist()
    forward = np.array(sorted(range(n), key=lambda i: (g[i], words[i])), np.int64)
    reverse = np.array(sorted(range(n), key=lambda i: (g[i], back[i])), np.int64)
    rank, back_rank = np.empty(n, np.int64), np.empty(n, np.int64)
    rank[forward], back_rank[reverse] = np.arange(n), np.arange(n)
    shared, back_shared = _shared(words, group, forward), _shared(back, group, reverse)
    most = np.maximum(shared, np.append(shared[1:], 0))[rank]
    back_most = np.maximum(back_shared, np.append(back_shared[1:], 0))[back_rank]
    # positions whose prefix and suffix both have other words; a group's rows are one interval of depth 0
    first, last = np.maximum(low, size - 1 - back_most), np.minimum(high - 1, most)
    count = np.where(size == top, np.maximum(0, last - first + 1), 0)
    group_first, group_end = np.searchsorted(group[forward], group), np.searchsorted(group[forward], group, side="right")
    tree, depth, back_depth = WaveletTree(back_rank[forward]), _Depth(shared), _Depth(back_shared)
    flat, which = b"".join(words), np.append(0, np.cumsum(size))
    flat = np.frombuffer(flat, np.uint8)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    ends = np.cumsum(count)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + RUN_QUERIES, side="right")))
        some = count[lo:hi]
        row = np.repeat(np.arange(lo, hi), some)
        at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(some) - some, some)
        if len(row):
            a, b = depth.interval(rank[row], np.maximum(at, 1))
            a, b = np.where(at == 0, group_first[row], a), np.where(at == 0, group_end[row], b)
            rest = size[row] - 1 - at
            c, d = back_depth.interval(back_rank[row], np.maximum(rest, 1))
            c, d = np.where(rest == 0, group_first[row], c), np.where(rest == 0, group_end[row], d)
            q, value = tree.report(a, b, c, d)
            mine, other, p = row[q], reverse[value], at[q]
            replaced = (mine != other) & (size[other] == size[mine])
            letter = which[mine] + p
            # the first of equal neighbouring letters stands for all of them
            deleted = (size[other] == size[mine] - 1) & ((p == 0) | (flat[letter] != flat[np.maximum(letter - 1, 0)]))
            out += [(mine[replaced], other[replaced]), (mine[deleted], other[deleted]), (other[deleted], mine[deleted])]
        lo = hi
    return tuple(np.concatenate([x[k] for x in out] or [np.empty(0, np.int64)]) for k in (0, 1))


_KEY = "xxhash64(top, low, high, substring(word, 1, low), right(word, top - high))"


def _dealt(words: DataFrame, most: int) -> DataFrame:
    """Rows of ``words`` for each class and range of edit positions, none of whose groups has over ``most`` rows and over one position."""
    size = F.length("word")
    half = F.floor(F.col("top") / 2).cast("int")
    rows = words.withColumn("top", F.explode(F.array(size, size + 1)))
    rows = rows.withColumn("part", F.explode(F.array(F.struct(F.lit(0).alias("low"), half.alias("high")), F.struct(half.alias("low"), F.col("top").alias("high")))))
    rows = rows.select("word", "n", "top", "part.low", "part.high").withColumn("key", F.expr(_KEY))
    settled = None
    kept: list[DataFrame] = []
    while True:
        large = rows.filter("high - low > 1").groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > most).select("key")
        large = store.keep(large, "spelling-large", small=True)
        if large.isEmpty():
            store.drop(large)
            break
        kept.append(large)
        few = rows.join(large, "key", "left_anti")
        settled = few if settled is None else settled.unionByName(few)
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        parts = F.explode(F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high")))
        rows = rows.join(large, "key", "left_semi").withColumn("part", parts).select("word", "n", "top", "part.low", "part.high").withColumn("key", F.expr(_KEY))
    out = rows if settled is None else settled.unionByName(rows)
    out.kept = kept
    return out


def near_pairs(words: DataFrame, most_group: int = MOST_GROUP) -> DataFrame:
    """word, n, near, near_n for each ordered pair of near words of ``words`` (distinct word, n).

    Words are of code points up to U+00FF.  ``words`` is read several times, so
    it should be a table.  Memory of a task is bounded by RUN_ROWS rows,
    RUN_BYTES of words and one group; an empty table gives an empty one.
    """
    rows = _dealt(words, most_group)
    kept = rows.kept

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            key = rows.column(0).to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            group = np.zeros(len(key), np.int64)
            group[cuts] = 1
            group = np.cumsum(group)
            live = np.flatnonzero(np.bincount(group)[group] > 1)
            if not len(live):
                return
            group, text, n = group[live], rows.column(1).take(pa.array(live)), rows.column(2).take(pa.array(live))
            words = [x.encode("latin-1") for x in text.to_pylist()]
            top, low, high = (rows.column(k).to_numpy()[live].astype(np.int64) for k in (3, 4, 5))
            a, b = _search(group, words, np.fromiter(map(len, words), np.int64, len(words)), top, low, high)
            for i in range(0, len(a), RUN_ROWS):
                x, y = pa.array(a[i : i + RUN_ROWS]), pa.array(b[i : i + RUN_ROWS])
                yield pa.RecordBatch.from_arrays([text.take(x), n.take(x), text.take(y), n.take(y)], ["word", "n", "near", "near_n"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= RUN_ROWS or sum(x.nbytes for x in held) >= RUN_BYTES:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                key = rows.column(0).to_numpy()
                last = int(np.searchsorted(key, key[-1]))  # the last group may go on
                if last:
                    yield from found(rows.slice(0, last))
                held = [rows.slice(last)]
        if held and sum(x.num_rows for x in held):
            yield from found(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    out = rows.select("key", "word", "n", "top", "low", "high").repartition("key").sortWithinPartitions("key")
    out = out.mapInArrow(run, "word string, n long, near string, near_n long")
    out.kept = kept
    return out


def forms(words: DataFrame, most_group: int = MOST_GROUP, factor: int = 2) -> DataFrame:
    """word, n, form, n_near, form_n of each word: its near word of largest n, if that is at least ``factor`` times its own.

    Ties go to the smallest word in code-point order; form and form_n are null
    where no near word is so frequent, n_near counts all near words.
    """
    near = near_pairs(words, most_group)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    out = words.join(best, "word", "left")
    form_n = -F.col("best.less")
    fits = form_n >= factor * F.col("n")
    out = out.select("word", "n", F.when(fits, F.col("best.near")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, form_n).alias("form_n"))
    out.kept = near.kept
    return out


def variants(docs: DataFrame, most_group: int = MOST_GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of ``docs`` (doc_id, text; other columns are not read).

    The root is the last word of the chain of forms from a word, itself if it
    has no form.  Counts at least double along a chain, so it ends, and pointer
    doubling takes a round for each doubling of the longest one.  Null and
    empty texts have no words; texts and words of any length are read whole;
    repeated rows count each; an empty table gives an empty one.
    """
    words = store.keep(vocabulary(docs), "spelling-words", small=True)
    found = forms(words, most_group)
    table = store.keep(found, "spelling-forms", small=True)
    store.drop(words, *found.kept)
    links = table.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    spent: list[DataFrame] = []
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = links.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        links = store.keep(step, "spelling-roots", small=True)
        store.drop(*spent)
        spent = [links]
        if links.filter("moved").isEmpty():
            break
    out = table.join(links.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = store.keep(out, "spelling-variants", small=True)
    store.drop(table, links)
    return out
