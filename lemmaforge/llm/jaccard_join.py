"""N-gram Jaccard join by T-occurrence search.

Two documents link if the Jaccard similarity of their sets of k-word shingles
reaches the threshold.  The join is exact and goes through inverted lists:

1. Documents of equal sets form a class, known by a 64-bit fingerprint of the
   set.  Everything below is about classes, so copies cost one row each.
2. A set of n shingles can only link with one that shares an element of its
   first n - T + 1 ones in any fixed global order, T being the least overlap
   that the threshold asks for.  The order puts frequent shingles last: these
   are the long lists that are not merged but probed.  (The order is a hint
   from counts over all documents in a table of bounded size; whatever it
   holds, results are the same.)
   The prefix is longer than that by a 20th of the set, so that linked sets
   share many of its elements: a class too few of whose prefix elements are in
   any other prefix can have no link and goes no further.
3. The distributed short lists (shingle -> classes) give candidates.  In a
   list of k classes each meets its neighbours in size order; where the list
   is longer than that, a second round takes every pair of it whose two sides
   are still in different components: links inside a component are of no use
   to it.  The pairs of very long lists are compared in blocks.
   Before any set moves, candidates are held against each other by parity
   bitmaps: of n elements, bit h mod b counts those with that hash, modulo 2.
   Sets whose bitmaps differ in x bits have (n + m - x) / 2 common elements at
   most; pairs below their need are gone, the others go on.
4. Candidates are grouped into cells: a few query sets and a stream of others.
   A set goes to a cell once, whatever the number of its pairs there.
   In a cell DivideSkip answers the T-occurrence problem: the query's lists
   over the others are split into short ones, merged by a heap, and the L
   longest ones, probed by bisection; sets found T - L times in the short ones
   go on, and those that reach the overlap link.
5. Links become components by large-star / small-star rounds.

Nothing is capped: lists of any length are worked off, in time linear in their
length as long as they hold copies of one another.

Defined results: a text of fewer than k words, but at least one, is its whole
sequence as one shingle; null, empty and wordless texts have no shingles and
link with nothing.  Repeated rows are in one class.  Rows of a null id are kept.
Texts of any length are read whole, an empty table gives an empty one, and
columns other than doc_id and text are not read, whatever their names
(``deduplicate`` passes them on).
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from . import words as wk
from .components import components
from .memory import gathered, tidied

K, THRESHOLD = 5, Fraction(4, 5)
#: Entries of the frequency hint (16 bytes each).
HINTS = 1 << 18
#: Words of 64 bits in the filter of needed classes.
FILTER_WORDS = 1 << 17
#: Neighbours that a class meets in a list in the first round.
NEAR = 12
#: Comparisons of places and sizes that the task of one list takes; the pairs of a longer one are compared in their cells.
MOST_COMPARISONS = 1 << 31
#: Classes on one side of a cell, and their elements (a larger set comes alone).
BLOCK, BLOCK_ELEMENTS = 256, 1 << 20

#: One in how many elements a prefix is longer than needed for one common element.
SPARE = 20

_FLUSH = 1_000_000
_LOW = (1 << 31) - 1


def _fingerprint(a: np.ndarray) -> int:
    s = wk.mix(a + wk.U(0x51ED270B)).sum(dtype=wk.U) ^ wk.U(int(np.bitwise_xor.reduce(a)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return int(wk.mix(np.array([s], wk.U) + wk.U(len(a))).view(np.int64)[0])


def parities(a: np.ndarray) -> bytes:
    """Bitmap of a set, of the power of two from twice its size on: a bit is 1 if an odd number of elements fall on it."""
    b = max(64, 1 << (2 * len(a) - 1).bit_length())
    return np.packbits(np.bincount((a & wk.U(b - 1)).astype(np.int64), minlength=b).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) as they are with fewer bits."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def may_reach(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether sets of n and m elements with bitmaps x and y (rows of 64-bit words) can have the overlap that they need."""
    words = min(x.shape[-1], y.shape[-1])
    apart = np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum(axis=-1, dtype=np.int64)
    return (n + m - apart) // 2 >= -(-t.numerator * (n + m) // (t.numerator + t.denominator))


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for lo, _, off, data in wk.slices(column):
        starts, ends, first = wk.spans(off, data, wk.BLANK)
        yield lo, wk.grams(wk.hashes(starts, ends, data), first, k)


def least_overlap(n: int, m: int, t: Fraction = THRESHOLD) -> int:
    """Common elements that sets of n and m elements need."""
    return -(-t.numerator * (n + m) // (t.numerator + t.denominator))


def prefix(n: int, t: Fraction = THRESHOLD) -> int:
    """First elements of a set of n that go to the lists."""
    return n - -(-t.numerator * n // t.denominator) + max(1, n // SPARE)


def least_shared(t: Fraction = THRESHOLD) -> Column:
    """Elements of its prefix that a set of (column) n shares with the prefix of any set that it links with."""
    smallest = F.expr(f"({t.numerator} * n + {t.denominator - 1}) div {t.denominator}")
    return F.greatest(F.lit(1), F.floor(smallest / F.lit(SPARE)))


def profile(docs: DataFrame, k: int = K) -> DataFrame:
    """Rows of two kinds: 0 = (document id, class, set size, its bitmap where the task meets the class first); 1 = (shingle, copies seen together, -, -)."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def flush() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate([*held, np.empty(0, wk.U)]), return_counts=True)
            u, c = u[c >= 3].view(np.int64), c[c >= 3]
            held.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(u), np.int8)), pa.array(u), pa.array(c.astype(np.int64)), pa.array(np.zeros(len(u), np.int64)), pa.nulls(len(u), pa.binary())], names)

        names = ["kind", "a", "b", "c", "bits"]
        for batch in batches:
            key: list[int | None] = []
            n: list[int] = []
            bits: list[bytes | None] = []
            for _, sets in _sets(batch.column(1), k):
                for a in sets:
                    n.append(len(a))
                    key.append(_fingerprint(a) if len(a) else None)
                    bits.append(None)
                    if len(a) and key[-1] not in seen:
                        seen.add(key[-1])
                        bits[-1] = parities(a)
                        held.append(a)
                        size += len(a)
                if size >= _FLUSH:
                    size = 0
                    yield flush()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int8)), batch.column(0), pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.binary())], names)
        yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "kind byte, a long, b long, c long, bits binary")


class Order:
    """The global order: shingles of the hint come last, by their counts."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        o = np.argsort(tokens)
        self.tokens, self.counts = tokens[o], counts[o]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.tokens >> wk.U(42)).astype(np.int64)] = True

    def first(self, a: np.ndarray, p: int) -> tuple[np.ndarray, int]:
        """The first p elements of the sorted set ``a``, and from where on they are in the hint."""
        if not len(self.tokens):
            return a[:p], p
        at = np.flatnonzero(self.maybe[(a >> wk.U(42)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.tokens, a[at]), len(self.tokens) - 1)
        known = self.tokens[i] == a[at]
        at, i = at[known], i[known]
        if not len(at):
            return a[:p], p
        rest = np.delete(a, at)
        if len(rest) >= p:
            return rest[:p], p
        late = a[at][np.lexsort((a[at], self.counts[i]))]
        return np.concatenate([rest, late[: p - len(rest)]]), len(rest)


def _postings(docs: DataFrame, order: Broadcast, k: int, t: Fraction) -> DataFrame:
    """token, key, at: the short lists' entries, one per class and task at most; ``at`` is the set's size << 32 | 1 << 31 if the element is in the hint | its place in the order, ``before`` the element before it, 0 if that is none of the hint's."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, sets in _sets(batch.column(0), k):
                token, key, n, count, before = [], [], [], [], []
                for a in sets:
                    if not len(a) or (f := _fingerprint(a)) in seen:
                        continue
                    seen.add(f)
                    part, hinted = order.value.first(a, prefix(len(a), t))
                    token.append(part)
                    prior = np.zeros(len(part), np.int64)
                    prior[hinted + 1 :] = part[hinted:-1].view(np.int64)
                    before.append(prior)
                    key.append(f)
                    place = np.arange(len(part))
                    n.append((len(a) << 32) + ((place >= hinted).astype(np.int64) << 31) + place)
                    count.append(len(part))
                if token:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.repeat(np.array(key, np.int64), count)), pa.array(np.concatenate(n)), pa.array(np.concatenate(before))], ["token", "key", "at", "before"])

    return docs.select("text").mapInArrow(run, "token long, key long, at long, before long")


def _common(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Common elements that the prefixes of linked sets of n and m elements have."""
    return np.maximum(1, np.minimum(n, m) // SPARE)


def _may_link(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether an element at places i and j (from 0) can be among the first common ones of linked sets of n and m elements."""
    need = -(-t.numerator * (n + m) // (t.numerator + t.denominator)) - _common(n, m) + 1
    return (t.denominator * np.minimum(n, m) >= t.numerator * np.maximum(n, m)) & (i <= n - need) & (j <= m - need)


def _near(postings: DataFrame, t: Fraction) -> DataFrame:
    """kind 0: candidate pairs (a, b) of neighbours in a list, ``at`` = the common elements that they need << 32 | 1 << 31 if the list is long or its element in the hint | those seen here; kind 1: entries (a = token, b = class, at) of the longer lists; kind 2: (a = class, b = its entries in shared lists, at)."""
    names = ["kind", "a", "b", "at", "before"]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 5
        for batch in gathered(batches):
            c = len(held[0])
            tok = np.concatenate([held[0], batch.column(0).to_numpy()])
            key = np.concatenate([held[1], batch.column(1).to_numpy()])
            n = np.concatenate([held[2], batch.column(2).to_numpy()])
            before = np.concatenate([held[4], batch.column(3).to_numpy()])
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (key[1:] != key[:-1])
            new[:c] = True
            tok, key, n, before = tok[new], key[new], n[new], before[new]
            if not len(tok):
                continue
            begins = np.ones(len(tok), bool)
            begins[1:] = tok[1:] != tok[:-1]
            start = np.maximum.accumulate(np.where(begins, np.arange(len(tok)), 0))
            rank = np.arange(len(tok)) - start
            if c:  # the held rows go on with their list
                rank[start == 0] += held[3][0]
            found = []
            for d in range(1, NEAR + 1):
                i = np.arange(max(c, d), len(tok))
                i = i[(tok[i] == tok[i - d])]
                i = i[_may_link(n[i] >> 32, n[i] & _LOW, n[i - d] >> 32, n[i - d] & _LOW, t)]
                x, y = key[i], key[i - d]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y), (_common(n[i] >> 32, n[i - d] >> 32) << 32) + (((rank[i] > NEAR) | (n[i] >> 31 & 1 > 0)).astype(np.int64) << 31)], 1))
            pairs, times = np.unique(np.concatenate(found), axis=0, return_counts=True)
            pairs[:, 2] += times
            # entries of longer lists: all rows from the one that goes beyond, and those before it
            long_ = rank > NEAR
            over = np.flatnonzero((rank == NEAR + 1) & (np.arange(len(tok)) >= c))
            early = (over[:, None] - np.arange(1, NEAR + 2)).ravel()
            late = np.flatnonzero(long_ & (np.arange(len(tok)) >= c))
            rows = np.concatenate([early, late])
            # a list is shared from its second entry on, which counts for its first as well
            here = np.arange(len(tok)) >= c
            shared = np.concatenate([np.flatnonzero(here & (rank >= 1)), np.flatnonzero(here & (rank == 1)) - 1])
            own, at, own_times = np.unique(key[shared], return_index=True, return_counts=True)
            kind = np.repeat(np.array([0, 1, 2], np.int8), [len(pairs), len(rows), len(own)])
            columns = ([pairs[:, 0], tok[rows], own], [pairs[:, 1], key[rows], own_times], [pairs[:, 2], n[rows], n[shared[at]]], [np.zeros(len(pairs)), before[rows], np.zeros(len(own))])
            yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(np.concatenate(x).astype(np.int64)) for x in columns)], names)
            tail = np.arange(max(int(start[-1]), len(tok) - NEAR - 1), len(tok))
            held = [tok[tail], key[tail], n[tail], rank[tail], before[tail]]

    return postings.repartition("token").sortWithinPartitions("token", F.shiftright("at", 32), "key").mapInArrow(run, "kind byte, a long, b long, at long, before long")


def _apart(entries: DataFrame, t: Fraction) -> DataFrame:
    """Cells of the longer lists' pairs that lie in different components.

    Rows: c1, c2, c3 (the cell: a list, a block of its queries and one of the
    others), role (0 query, 1 the others), key, comp, and of a query the keys
    ``asks`` (null: all).  A class comes once for each cell, not for each pair.
    """
    names = ["c1", "c2", "c3", "role", "key", "comp"]

    def blocks(n: np.ndarray) -> np.ndarray:
        """Where blocks begin, and the end."""
        cuts, total = [0], 0
        for i, x in enumerate(n.tolist()):
            if i > cuts[-1] and (i - cuts[-1] == BLOCK or total + x > BLOCK_ELEMENTS):
                cuts.append(i)
                total = 0
            total += x
        return np.array([*cuts, len(n)])

    def cells(tok: int, key: np.ndarray, at: np.ndarray, comp: np.ndarray, before: np.ndarray) -> Iterator[tuple]:
        _, label, size = np.unique(comp, return_inverse=True, return_counts=True)
        if len(size) < 2:
            return
        k, n, place, main = len(key), at >> 32, at & _LOW, size.argmax()
        cuts = blocks(n)
        outside = np.flatnonzero(label != main)
        if len(outside) * k <= MOST_COMPARISONS:
            own = blocks(n[outside])
            for x, (lo, hi) in enumerate(zip(own[:-1], own[1:], strict=True)):
                found = []
                for i in outside[lo:hi]:
                    fits = (label != label[i]) & _may_link(n, place, n[i], place[i], t)
                    fits &= (label == main) | (key > key[i])
                    if before[i]:  # a common hinted element before this one: its list, long or short, brings the pair
                        fits &= before != before[i]
                    if fits.any():
                        found.append((i, np.flatnonzero(fits)))
                met = np.unique(np.concatenate([np.empty(0, np.int64), *(f for _, f in found)]))
                for y in np.unique(np.searchsorted(cuts, met, side="right") - 1).tolist():
                    for i, f in found:
                        asks = f[np.searchsorted(f, cuts[y]) : np.searchsorted(f, cuts[y + 1])]
                        if len(asks):
                            yield tok, x, y, 0, int(key[i]), int(comp[i]), key[asks]
                    for j in met[np.searchsorted(met, cuts[y]) : np.searchsorted(met, cuts[y + 1])].tolist():
                        yield tok, x, y, 1, int(key[j]), int(comp[j]), None
            return
        # by blocks alone: the first elements of two blocks tell whether their sizes can fit, as the list is in order of size
        for x in range(len(cuts) - 1):
            for y in range(x, len(cuts) - 1):
                if t.denominator * n[cuts[x + 1] - 1] < t.numerator * n[cuts[y]]:
                    break
                if len(np.unique(np.concatenate([label[cuts[x] : cuts[x + 1]], label[cuts[y] : cuts[y + 1]]]))) > 1:
                    for role, z in ((0, x), (1, y)):
                        for i in range(cuts[z], cuts[z + 1]):
                            yield tok, x, y, role, int(key[i]), int(comp[i]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                rows = []
                for row in cells(last, *(np.concatenate(x) for x in zip(*held, strict=True))):
                    rows.append(row)
                    if len(rows) == 5_000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            m = np.array([x[:6] for x in rows], np.int64)
            return pa.RecordBatch.from_arrays([*(pa.array(m[:, i]) for i in range(6)), pa.array([x[6] for x in rows], pa.list_(pa.int64()))], [*names, "asks"])

        for batch in gathered(batches):
            cols = [batch.column(i).to_numpy() for i in range(5)]
            cut = np.flatnonzero(np.diff(cols[0])) + 1
            for lo, hi in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if cols[0][lo] != last:
                    yield from done()
                    held, last = [], int(cols[0][lo])
                held.append([x[lo:hi] for x in cols[1:]])
        yield from done()

    return entries.repartition("token").sortWithinPartitions("token", F.shiftright("at", 32), "key").mapInArrow(run, "c1 long, c2 long, c3 long, role long, key long, comp long, asks array<long>")


def _bitmaps(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, wk.U) for x in column.to_pylist()]


def _possible(pairs: DataFrame, bits: DataFrame, t: Fraction) -> DataFrame:
    """``pairs`` (a, b) that their bitmaps allow to link."""
    for side in ("a", "b"):
        pairs = pairs.join(bits.select(F.col("key").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"x{side}")), side)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _bitmaps(batch.column("xa")), _bitmaps(batch.column("xb"))
            n, m = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            wide = np.array([(len(v), len(w)) for v, w in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
            keep = np.zeros(batch.num_rows, bool)
            for pair in np.unique(wide, axis=0):
                at = np.flatnonzero((wide == pair).all(axis=1))
                keep[at] = may_reach(n[at], np.stack([x[i] for i in at]), m[at], np.stack([y[i] for i in at]), t)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long")


def _possible_cells(cells: DataFrame, bits: DataFrame, t: Fraction) -> DataFrame:
    """``cells`` with the classes that their bitmaps allow to link."""
    names = ["c1", "c2", "c3", "role", "key", "comp", "asks"]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple | None = None
        queries: list[tuple[int, int, frozenset[int] | None, int, np.ndarray, list[int]]] = []
        others: dict[int, list[tuple[int, int, int, np.ndarray]]] = {}
        members: dict[int, int] = {}
        rows: list[tuple] = []

        def work() -> None:
            for group in others.values():
                keys, n, comp = (np.array(x, np.int64) for x in list(zip(*group, strict=True))[:3])
                x = np.stack([g[3] for g in group])
                for own, c, asked, m, y, found in queries:
                    fits = (keys != own) & (comp != c)
                    if asked is not None:
                        fits &= np.fromiter((z in asked for z in keys.tolist()), bool, len(keys))
                    at = np.flatnonzero(fits)
                    at = at[may_reach(n[at], x[at], np.int64(m), y, t)]
                    found += keys[at].tolist()
                    members.update(zip(keys[at].tolist(), comp[at].tolist(), strict=True))
            others.clear()

        def done() -> None:
            work()
            for own, c, _, _, _, found in queries:
                if found:
                    rows.append((*cell, 0, own, c, found))
            rows.extend((*cell, 1, z, c, None) for z, c in members.items())
            queries.clear()
            members.clear()

        def batch_of() -> pa.RecordBatch:
            m = np.array([x[:6] for x in rows], np.int64).reshape(-1, 6)
            out = pa.RecordBatch.from_arrays([*(pa.array(m[:, i]) for i in range(6)), pa.array([x[6] for x in rows], pa.list_(pa.int64()))], names)
            rows.clear()
            return out

        for batch in batches:
            c1, c2, c3, role, key, comp, asks, n = (batch.column(i).to_pylist() for i in range(8))
            bitmaps, waiting = _bitmaps(batch.column(8)), 0
            for i in range(batch.num_rows):
                if (here := (c1[i], c2[i], c3[i])) != cell:
                    done()
                    cell, waiting = here, 0
                if role[i] == 0:
                    queries.append((key[i], comp[i], frozenset(asks[i]) if asks[i] is not None else None, n[i], bitmaps[i], []))
                else:
                    others.setdefault(len(bitmaps[i]), []).append((key[i], n[i], comp[i], bitmaps[i]))
                    waiting += 1
                    if waiting == BLOCK:
                        work()
                        waiting = 0
            if len(rows) >= 1000:
                yield batch_of()
        done()
        if rows:
            yield batch_of()

    filled = cells.join(bits, "key").select(*names, "n", "bits")
    return filled.repartition("c1", "c2", "c3").sortWithinPartitions("c1", "c2", "c3", "role", "key").mapInArrow(run, "c1 long, c2 long, c3 long, role long, key long, comp long, asks array<long>")


def divide_skip(query: np.ndarray, others: list[np.ndarray], needs: list[int], mu: float = 0.0085) -> list[tuple[int, int]]:
    """(index, overlap) of the ``others`` that share at least their need with ``query``.

    All are sorted distinct arrays.  The inverted lists of the query's elements
    over the others are split: the L longest are only probed by bisection, the
    rest are merged by a heap; T is the least need.
    """
    owner = np.repeat(np.arange(len(others)), [len(x) for x in others])
    token = np.concatenate([*others, np.empty(0, query.dtype)])
    at = np.minimum(np.searchsorted(query, token), len(query) - 1)
    hit = query[at] == token
    at, owner = at[hit], owner[hit]
    order = np.lexsort((owner, at))
    at, owner = at[order], owner[order]
    cut = np.flatnonzero(np.diff(at)) + 1
    flat = owner.tolist()
    lists = [flat[a:b] for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(flat)], strict=True)] if flat else []
    t = max(1, min(needs, default=1))
    if len(lists) < t:
        return []
    lists.sort(key=len, reverse=True)
    most = len(lists[0])
    n_long = min(t - 1, int(t / (mu * math.log2(most) + 1)))
    long_, short = lists[:n_long], lists[n_long:]
    out = []
    merged = heapq.merge(*short)
    current, count = next(merged, None), 1

    def probe(who: int, found: int) -> None:
        if found < t - n_long:
            return
        left = len(long_)
        for x in long_:
            if found + left < needs[who]:
                return
            left -= 1
            i = bisect_left(x, who)
            found += i < len(x) and x[i] == who
        if found >= needs[who]:
            out.append((who, found))

    for who in merged:
        if who == current:
            count += 1
        else:
            probe(current, count)
            current, count = who, 1
    if current is not None:
        probe(current, count)
    return out


def _search(cells: DataFrame, sets: DataFrame, t: Fraction, every: bool = False) -> DataFrame:
    """Links (a, b, overlap) found in the cells: ``every`` one, or a spanning forest of them where a cell has several queries."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple | None = None
        queries: list[tuple[int, np.ndarray, frozenset[int] | None]] = []
        pending: list[tuple[int, np.ndarray]] = []
        parent: dict[int, int] = {}
        links: list[tuple[int, int, int]] = []

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def batch_of() -> pa.RecordBatch:
            m = np.array(links, np.int64)
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array(m[:, i]) for i in range(3)], ["a", "b", "overlap"])

        def work() -> None:
            for own, q, asked in queries:
                kept = [(key, a) for key, a in pending if key != own and (asked is None or key in asked) and t.denominator * min(len(a), len(q)) >= t.numerator * max(len(a), len(q)) and (every or root(key) != root(own))]
                needs = [least_overlap(len(q), len(a), t) for _, a in kept]
                for i, overlap in divide_skip(q, [a for _, a in kept], needs):
                    other = kept[i][0]
                    if every or root(own) != root(other):
                        parent[root(own)] = root(other)
                        links.append((min(own, other), max(own, other), overlap))
            pending.clear()

        for batch in batches:
            c1, c2, c3, role, key, comp = (batch.column(i).to_pylist() for i in range(6))
            asks = batch.column(6)
            tokens = batch.column(7)
            off = tokens.offsets.to_numpy()
            flat = tokens.values.to_numpy().view(wk.U)
            for i in range(batch.num_rows):
                if (here := (c1[i], c2[i], c3[i])) != cell:
                    work()
                    cell, queries = here, []
                    parent.clear()
                a = flat[off[i] : off[i + 1]].copy()
                parent.setdefault(comp[i], comp[i])
                parent.setdefault(key[i], comp[i])
                if role[i] == 0:
                    queries.append((key[i], a, frozenset(asks[i].as_py()) if asks[i].is_valid else None))
                else:
                    pending.append((key[i], a))
                    if len(pending) == BLOCK:
                        work()
            if links:
                yield batch_of()
        work()
        if links:
            yield batch_of()

    filled = cells.join(sets, "key").select("c1", "c2", "c3", "role", "key", "comp", "asks", "tokens")
    return filled.repartition("c1", "c2", "c3").sortWithinPartitions("c1", "c2", "c3", "role", "key").mapInArrow(run, "a long, b long, overlap long")


def _needed_sets(docs: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """key, tokens (the whole sorted set) of the classes in ``keys``, and a few others.

    The keys go to the tasks as a bit table of fixed size; once it fills up
    it lets more classes through, which costs shuffle but no result.
    """
    spark = docs.sparkSession
    spot = F.pmod(F.shiftright("key", 6), F.lit(FILTER_WORDS))
    table = np.zeros(FILTER_WORDS, np.int64)
    for word, bits in keys.groupBy(spot.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 AS INT))")).alias("bits")).collect():
        table[word] = bits
    needed = spark.sparkContext.broadcast(table)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, sets in _sets(batch.column(0), k):
                key, kept = [], []
                for a in sets:
                    if len(a):
                        f = _fingerprint(a)
                        if int(needed.value[(f >> 6) % FILTER_WORDS]) >> (f & 63) & 1 and f not in seen:
                            seen.add(f)
                            key.append(f)
                            kept.append(a)
                if key:
                    off = np.append(0, np.cumsum([len(a) for a in kept])).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(kept).view(np.int64)))], ["key", "tokens"])

    return docs.select("text").mapInArrow(run, "key long, tokens array<long>").groupBy("key").agg(F.any_value("tokens").alias("tokens"))


def _candidates(docs: DataFrame, k: int, t: Fraction) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Members (doc_id, key, n_shingles), neighbours' pairs (a, b) that may link, the longer lists' entries, and the bitmaps of both."""
    spark = docs.sparkSession
    seen = store.keep(profile(docs, k), "jaccard-profile")
    members = seen.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("key"), F.col("c").alias("n_shingles"))
    hints = seen.filter("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).orderBy(F.desc("n"), "a").limit(HINTS).toArrow()
    order = spark.sparkContext.broadcast(Order(hints["a"].to_numpy().astype(np.int64).view(wk.U), hints["n"].to_numpy().astype(np.int64)))

    found = store.keep(_near(_postings(docs, order, k, t), t), "jaccard-lists")
    shared = found.filter("kind = 2").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("shared"), F.max(F.shiftright("at", 32)).alias("n"))
    alive = store.keep(shared.filter(F.col("shared") >= least_shared(t)).select("key"), "jaccard-alive", small=True)
    # a pair that meets in short lists of unhinted elements only has all its common elements counted; long lists come again below
    pairs = found.filter("kind = 0").groupBy("a", "b").agg(F.expr("sum(at & 2147483647)").alias("seen"), F.expr("max(at & 2147483648)").alias("long"), F.max(F.shiftright("at", 32)).alias("need"))
    pairs = pairs.filter("long > 0 OR seen >= need").select("a", "b")
    for side in ("a", "b"):
        pairs = pairs.join(alive.withColumnRenamed("key", side), side, "left_semi")
    near = store.keep(pairs.select("a", "b"), "jaccard-near", small=True)
    entries = found.filter("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("key"), "at", "before").join(alive, "key", "left_semi")
    entries = store.keep(entries, "jaccard-entries", small=True)
    keys = near.select(F.explode(F.array("a", "b")).alias("key")).unionByName(entries.select("key")).distinct()
    bits = seen.filter("kind = 0 AND bits IS NOT NULL").select(F.col("b").alias("key"), F.col("c").alias("n"), "bits")
    bits = store.keep(bits.join(keys, "key", "left_semi").groupBy("key").agg(F.any_value("n").alias("n"), F.any_value("bits").alias("bits")), "jaccard-bits", small=True)
    pairs = store.keep(_possible(near, bits, t), "jaccard-pairs", small=True)
    store.drop(found, alive, near)
    return members, pairs, entries, bits


def _of_pairs(pairs: DataFrame) -> DataFrame:
    """Cells of pairs: a class asks all that it is paired with."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    others = pairs.select(zero.alias("c1"), F.col("a").alias("c2"), zero.alias("c3"), one.alias("role"), F.col("b").alias("key"), F.col("b").alias("comp"))
    asking = others.select("c1", "c2", "c3").distinct().select("c1", "c2", "c3", zero.alias("role"), F.col("c2").alias("key"), F.col("c2").alias("comp"))
    return others.unionByName(asking).withColumn("asks", F.lit(None).cast("array<long>"))


def links(docs: DataFrame, k: int = K, threshold: Fraction = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Every linked pair of classes (a < b, overlap = common shingles), and membership (doc_id, key, n_shingles) of every row.

    Rows of one class link with each other as well; the pairs stand for all
    links between different sets, so their number may grow with the square of
    a group's classes.  Rows without shingles have no key.
    """
    t = Fraction(threshold)
    members, pairs, entries, bits = _candidates(docs, k, t)
    # each class its own component: no pair of a longer list is left out
    cells = _apart(entries.select("token", "key", "at", F.col("key").alias("comp"), "before"), t)
    cells = store.keep(_possible_cells(cells, bits, t).unionByName(_of_pairs(pairs)), "jaccard-cells", small=True)
    found = store.keep(_search(cells, _needed_sets(docs, cells, k), t, every=True).distinct(), "jaccard-every-link")
    store.drop(pairs, entries, bits, cells)
    return found, members


def link_counts(docs: DataFrame, k: int = K, threshold: Fraction = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, n_links (the other rows that it links with)."""
    pairs, members = links(docs, k, threshold)
    size = members.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("rows"))
    both = pairs.select(F.col("a").alias("of"), F.col("b").alias("key")).unionByName(pairs.select(F.col("b").alias("of"), F.col("a").alias("key")))
    beyond = both.join(size, "key").groupBy(F.col("of").alias("key")).agg(F.sum("rows").alias("beyond"))
    size = size.join(beyond, "key", "left").select("key", (F.col("rows") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"))
    return members.join(size, "key", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def join(docs: DataFrame, k: int = K, threshold: Fraction = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the least id that links lead to).

    Components need a spanning forest of the links only; ``links`` has all of them.
    """
    t = Fraction(threshold)
    members, pairs, entries, bits = _candidates(docs, k, t)
    cells = _of_pairs(pairs)
    links = store.keep(_search(cells, _needed_sets(docs, cells, k), t).select("a", "b"), "jaccard-links", small=True)
    known = components(links)
    # of the longer lists' pairs only those between components are left
    placed = entries.join(known.withColumnRenamed("node", "key"), "key", "left").select("token", "key", "at", F.coalesce("component", "key").alias("comp"), "before")
    cells = store.keep(_possible_cells(_apart(placed, t), bits, t), "jaccard-cells", small=True)
    if not cells.isEmpty():
        links = store.keep(links.unionByName(_search(cells, _needed_sets(docs, cells, k), t).select("a", "b")), "jaccard-links", small=True)
        known = components(links)
    store.drop(pairs, entries, bits, cells)

    classes = members.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"))
    classes = classes.join(known.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    # a component may hold many classes, and a class a third of all rows: both joins are on aggregates
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "component").select("key", "component_id")
    return members.join(classes, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, k: int = K, threshold: Fraction = THRESHOLD) -> DataFrame:
    """``docs`` without the ids whose component has a smaller one; of an id with several rows all stay or none, and they stay if one of them does."""
    name = "kept_id"
    while name in map(str.lower, docs.columns):
        name += "_"
    kept = join(docs, k, threshold).filter("doc_id IS NULL OR doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
