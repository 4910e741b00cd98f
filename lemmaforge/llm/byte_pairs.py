"""Byte-level BPE by a rank file: ids of texts, and texts of ids.

A text is cut into the pattern's matches (pre-tokens), each encoded on its own
in two tiers.  The first resolves whole pre-tokens that are in the vocabulary:
a minimal perfect hash (levels of bit arrays; a key's slot is the rank of its
bit) gives the one token that a pre-token could be, and comparing their bytes
says if it is.  A miss goes to the second tier: its bytes are a linked list, a
heap holds the ranks of neighbouring pairs, and the least rank, leftmost among
equals, merges until none is left; n bytes take O(n log n).

Equal stretches of text get equal ids, so a run of about ``RUN_BYTES`` is cut
before its blanks first and only distinct stretches are looked at.  Cutting,
putting ids together, decoding and digests are NumPy and Arrow passes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as wk
from .memory import gathered, tidied
from .token_files import Ragged

U = np.uint64
#: Bytes of text worked on at a time (a longer text comes alone), and pre-tokens that a worker remembers, with their longest size in characters.
RUN_BYTES = 2 << 20
KNOWN, KNOWN_SIZE = 400_000, 64
#: Bits for each key of a level of the perfect hash.
SPARSE = 2

_SYMBOL = wk.mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))
_BASE = U(0x9E3779B97F4A7C15)
#: Last bytes of the white space that is not ASCII, by what stands before them.
_WIDE_BLANKS = ((b"\xc2", b"\x85\xa0"), (b"\xe1\x9a", b"\x80"), (b"\xe2\x80", bytes([*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF])), (b"\xe2\x81", b"\x9f"), (b"\xe3\x80", b"\x80"))


def ragged_bytes(items: list[bytes]) -> Ragged:
    off = np.append(0, np.cumsum(np.fromiter(map(len, items), np.int64, len(items))))
    return Ragged(np.frombuffer(b"".join(items), np.uint8), off)


def _values(keys: Ragged) -> np.ndarray:
    """A 64-bit value of each byte string; the empty one has 0."""
    size = np.diff(keys.off)
    at = np.arange(keys.off[-1] - keys.off[0]) - np.repeat(keys.off[:-1] - keys.off[0], size)
    powers = np.cumprod(np.concatenate([[U(1)], np.full(int(size.max(initial=1)), _BASE)]))
    terms = _SYMBOL[keys.flat[keys.off[0] : keys.off[-1]]] * powers[at]
    out = np.zeros(len(keys), U)
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(terms, (keys.off[:-1] - keys.off[0])[some])
    return wk.mix(out + size.astype(U))


class PerfectHash:
    """Slots 0 .. n - 1 of n distinct byte strings, one each; any other string gets -1 or the slot of one of them."""

    def __init__(self, keys: Ragged):
        left, self.sizes, bits = np.unique(_values(keys)), [], []
        if len(left) != len(keys):
            raise ValueError("two keys are equal, or have one 64-bit value")
        while len(left):
            size = SPARSE * len(left)
            at = self._at(left, len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            self.sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        self.bits = np.concatenate([*bits, np.empty(0, bool)])
        self.rank = np.cumsum(self.bits, dtype=np.int64) - 1

    @staticmethod
    def _at(values: np.ndarray, level: int, size: int) -> np.ndarray:
        return (wk.mix(values ^ wk.mix(np.array([level + 1], U))) % U(size)).astype(np.int64)

    def slots(self, keys: Ragged) -> np.ndarray:
        values, out, base = _values(keys), np.full(len(keys), -1, np.int64), 0
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = base + self._at(values[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + size
        return out


class Codec:
    """Encoder and decoder of a rank file (lines of a base64 token and its rank) under a pattern.

    No match of the pattern may hold a character other than white space with
    white space behind it; then a text can be cut before any blank that follows
    another character.  The 256 single bytes have to be tokens.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        if any(bytes([i]) not in self.ranks for i in range(256)):
            raise ValueError("a single byte is not in the vocabulary")
        self.pattern = regex.compile(pattern)
        tokens = list(self.ranks)
        keys = ragged_bytes(tokens)
        self.longest = int(np.diff(keys.off).max())
        self.hash = PerfectHash(keys)
        slot = self.hash.slots(keys)
        order = np.empty(len(tokens), np.int64)
        order[slot] = np.arange(len(tokens))
        #: By slot: the token and its id.
        self.slot_tokens, self.slot_ids = keys.take(order), np.fromiter(self.ranks.values(), np.int64, len(tokens))[order]
        by_id = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            by_id[i] = token
        #: By id: its bytes, and its decimal digits with a space behind them.
        self.tokens, self.digits = ragged_bytes(by_id), ragged_bytes([b"%d " % i for i in range(len(by_id))])
        self.known: dict[str, int] = {}
        self.known_ids = Ragged(np.empty(0, np.int32), np.zeros(1, np.int64))

    def merged(self, piece: bytes) -> list[int]:
        """The second tier: ids of one pre-token by merging its bytes."""
        n, ranks = len(piece), self.ranks
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if part[i] is None or (j := after[i]) >= n or ranks.get(both := part[i] + part[j]) != r:
                continue  # one of the two has merged meanwhile
            part[i], part[j], after[i] = both, None, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (s := ranks.get(both + part[after[i]])) is not None:
                    heapq.heappush(heap, (s, i))
            if before[i] >= 0 and (s := ranks.get(part[before[i]] + both)) is not None:
                heapq.heappush(heap, (s, before[i]))
        return [ranks[x] for x in part if x is not None]

    def pieces(self, pieces: list[bytes]) -> Ragged:
        """ids of each pre-token."""
        keys = ragged_bytes(pieces)
        size = np.diff(keys.off)
        short = np.flatnonzero(size <= self.longest)
        found = np.full(len(pieces), -1, np.int64)
        found[short] = self.hash.slots(keys.take(short))
        maybe = np.flatnonzero(found >= 0)
        maybe = maybe[size[maybe] == np.diff(self.slot_tokens.off)[found[maybe]]]
        mine, theirs = keys.take(maybe), self.slot_tokens.take(found[maybe])
        differs = np.zeros(len(mine.flat) + 1, np.int64)
        np.cumsum(mine.flat != theirs.flat, out=differs[1:])
        hit = maybe[differs[mine.off[1:]] == differs[mine.off[:-1]]]
        lists: list = [None] * len(pieces)
        for i, x in zip(hit.tolist(), self.slot_ids[found[hit]].tolist(), strict=True):
            lists[i] = (x,)
        out = Ragged.of([self.merged(pieces[i]) if x is None else x for i, x in enumerate(lists)])
        return Ragged(out.flat.view(np.int32), out.off)

    def _learn(self, stretches: list[bytes]) -> Ragged:
        """ids of each stretch of text: those that open with a space and end otherwise are one text, in which the pattern cuts between them."""
        texts = [x.decode() for x in stretches]
        joined = [i for i, x in enumerate(texts) if x[0] == " " and not x[-1].isspace()]
        alone = sorted(set(range(len(texts))) - set(joined))
        found = self.pattern.findall("".join([texts[i] for i in joined]))
        ends = np.cumsum(np.fromiter((len(texts[i]) for i in joined), np.int64, len(joined)))
        count = np.diff(np.searchsorted(np.cumsum(np.fromiter(map(len, found), np.int64, len(found))), ends, side="right"), prepend=0)
        each = [self.pattern.findall(texts[i]) for i in alone]
        found += [x for y in each for x in y]
        ids = self._known_pieces(found)
        count = np.append(count, np.fromiter(map(len, each), np.int64, len(each)))
        out = Ragged(ids.flat, ids.off[np.append(0, np.cumsum(count))])
        return out.take(np.argsort(np.array(joined + alone, np.int64), kind="stable"))

    def _known_pieces(self, found: list[str]) -> Ragged:
        """ids of each pre-token; those met before are remembered, up to KNOWN and what one run has."""
        seen: dict[str, int] = {}
        codes = np.fromiter((seen.setdefault(x, len(seen)) for x in found), np.int64, len(found))
        held = len(self.known_ids)
        new = [x for x in seen if x not in self.known]
        ids = self.known_ids + self.pieces([x.encode() for x in new])
        place = {x: held + i for i, x in enumerate(new)}
        where = np.fromiter((self.known[x] if x in self.known else place[x] for x in seen), np.int64, len(seen))
        if held + len(new) > KNOWN:  # what this run has met stays
            kept = [(x, i) for x, i in zip(seen, where.tolist(), strict=True) if len(x) <= KNOWN_SIZE]
            self.known, self.known_ids = {x: k for k, (x, _) in enumerate(kept)}, ids.take(np.array([i for _, i in kept], np.int64))
        else:
            self.known.update((x, i) for x, i in place.items() if len(x) <= KNOWN_SIZE)
            self.known_ids = ids
        return ids.take(where[codes])

    def run(self, off: np.ndarray, data: np.ndarray) -> Ragged:
        """ids of the texts data[off[i] : off[i + 1]]."""
        n = len(data)
        cut = np.flatnonzero(data[1:] == 0x20) + 1
        last = data[cut - 1]
        cut = cut[(last > 0x20) | (last < 0x09) | ((last > 0x0D) & (last < 0x1C))]
        wide = data[cut - 1] >= 0x80
        for head, tails in _WIDE_BLANKS:
            blank = np.isin(data[cut - 1], np.frombuffer(tails, np.uint8)) & (cut > len(head))
            for k, byte in enumerate(reversed(head)):
                blank &= data[np.maximum(cut - 2 - k, 0)] == byte
            wide &= ~blank
        cut = cut[(data[cut - 1] < 0x80) | wide]
        opens = np.zeros(n, bool)
        opens[cut] = True
        opens[off[:-1][np.diff(off) > 0]] = True
        starts = np.flatnonzero(opens)
        stretches = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, n).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = stretches.dictionary_encode()
        found = self._learn(coded.dictionary.to_pylist()).take(coded.indices.to_numpy().astype(np.int64))
        return Ragged(found.flat, found.off[np.searchsorted(starts, off)])

    def column(self, column: pa.Array) -> Iterator[tuple[int, Ragged]]:
        """First row and ids of runs of rows; null reads as empty."""
        for lo, _, off, data in wk.slices(column, RUN_BYTES):
            yield lo, self.run(off, data)

    def decoded(self, ids: Ragged) -> Ragged:
        """Bytes of each list of ids."""
        out = self.tokens.take(ids.flat.astype(np.int64))
        return Ragged(out.flat, out.off[ids.off])

    def written(self, ids: Ragged) -> Ragged:
        """Decimal ids of each list, a space behind each."""
        out = self.digits.take(ids.flat.astype(np.int64))
        return Ragged(out.flat, out.off[ids.off])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """A worker's codec of a file and a pattern."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _lists(ids: Ragged) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ids.off.astype(np.int32)), pa.array(ids.flat))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of each row of ``docs`` (doc_id, text); other columns are left out, whatever their names.

    Null and empty texts have no ids.  Rows are independent: repeated rows and
    ties stay rows of their own, an empty table gives an empty one, and a text
    of any length is encoded whole.  ``path`` is one that every executor opens.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in gathered(batches, size=RUN_BYTES):
            for lo, ids in coder.column(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(ids)), _lists(ids)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of each row's ids; a null list gives none, an id outside the vocabulary is an error."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            lists = batch.column(1).fill_null([])
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and not 0 <= flat.min() <= flat.max() < len(coder.tokens):
                raise ValueError("an id is outside the vocabulary")
            off = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
            out = coder.decoded(Ragged(flat, off))
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(out), [None, pa.py_buffer(out.off), pa.py_buffer(np.ascontiguousarray(out.flat))])
            yield pa.RecordBatch.from_arrays([batch.column(0), raw.cast(pa.binary())], ["doc_id", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the decimal ids joined by spaces, and of the bytes that they decode to; rows as in ``encode``."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in gathered(batches, size=RUN_BYTES):
            for lo, ids in coder.column(batch.column(1)):
                digits, raw = coder.written(ids), coder.decoded(ids)
                sha = [[hashlib.sha256(x.flat[a : max(a, b - less)]).hexdigest() for a, b in zip(x.off[:-1].tolist(), x.off[1:].tolist(), strict=True)] for x, less in ((digits, 1), (raw, 0))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(ids)), pa.array(np.diff(ids.off)), *map(pa.array, sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
