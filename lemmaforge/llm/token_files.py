"""Token-ID output: Parquet files of token lists that can be read selectively.

Layout: the corpus is range-partitioned by document id, so files, row groups
and rows are in ascending id order.  Each row has ``doc_id``, the file's part
number, the row's first token inside the part, ``n_tokens`` and the token list.
The token list is dictionary-encoded
(ids below the vocabulary size bit-pack into about 16 bits) and falls back to
delta-packed pages under the version-2 page writer; ids and offsets are
delta-packed.  Row groups and pages have fixed byte sizes and the writer adds
page indexes, so a reader that wants lengths only, or a range of ids only,
touches those pages alone.

Tokenising is exact but pays for each distinct word about once per run of text:
a text is cut before its spaces.  Under a byte-level pre-tokenizer no piece
crosses such a cut, hence the ids of the parts, concatenated, are the ids of the
text; a text with a space between two blanks, or with the string of a special
token (which the tokenizer takes for that token), is encoded whole.  Cutting, finding
the distinct parts and putting their ids together are Arrow and NumPy passes
over a run of about ``RUN_BYTES`` of text; the tokenizer sees only parts that are
not among the last ``KNOWN`` ones.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from . import words as wk
from .memory import gathered, tidied, tidy

#: Bytes of text that are cut at a time, up to twice as many (a longer text comes alone), and parts whose ids a Python worker remembers.
RUN_BYTES = 2 << 20
KNOWN, KNOWN_BYTES = 300_000, 64
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
#: Characters of a text by which rows of one id are dealt to files.
TIE_SIZE = 64

#: A space between two blanks; the class holds every white space of Unicode.
_BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TIGHT = f"{_BLANKS} {_BLANKS}"
#: Letters with marks behind them: the marks are a piece of their own under the byte-level pre-tokenizer.
_LETTERS, _MARKS = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+", ".,;:!?%$&#*|"
_ENDED = f"{_LETTERS}[{_MARKS}]+$"


class Ragged:
    """Lists of ids one after another: list i is flat[off[i] : off[i + 1]]."""

    def __init__(self, flat: np.ndarray, off: np.ndarray):
        self.flat, self.off = flat, off

    def __len__(self) -> int:
        return len(self.off) - 1

    def take(self, index: np.ndarray) -> Ragged:
        size = self.off[index + 1] - self.off[index]
        off = np.append(0, np.cumsum(size))
        at = np.repeat((self.off[index] - off[:-1]), size)
        at += np.arange(off[-1])
        return Ragged(self.flat[at], off)

    def __add__(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.flat, other.flat]), np.concatenate([self.off, other.off[1:] + self.off[-1]]))

    @classmethod
    def of(cls, lists: list[list[int]]) -> Ragged:
        off = np.append(0, np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists))))
        return cls(np.fromiter((x for y in lists for x in y), np.uint32, off[-1]), off)


class Encoder:
    """ids of texts by a byte-level tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Their strings in a text are tokens of their own, so a text that holds one is encoded whole.
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.opens[i] = token.startswith("Ġ")
        del vocabulary
        tidy()  # parsing the file takes twice what the tokenizer keeps
        self.known, self.known_ids = pa.array([], pa.large_string()), Ragged.of([])

    def whole(self, texts: list[str]) -> Ragged:
        return Ragged.of([x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _learn(self, parts: list[str], at_once: int = 512) -> Ragged:
        """ids of ' ' + part for each of the parts."""
        odd = [i for i, x in enumerate(parts) if not x or x[0].isspace()]
        if odd:
            plain = sorted(set(range(len(parts))) - set(odd))
            both = self._learn([parts[i] for i in plain], at_once) + self.whole([" " + parts[i] for i in odd])
            return both.take(np.argsort(np.array(plain + odd), kind="stable"))
        out, off = [], [np.zeros(1, np.int64)]
        for lo in range(0, len(parts), at_once):
            some = parts[lo : lo + at_once]
            # one call for many parts; a token that opens with a space opens a part
            ids = np.asarray(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.opens[ids])
            if len(cut) != len(some):
                each = self.whole([" " + x for x in some])
                ids, cut = each.flat, each.off[:-1]
            off.append(np.append(cut[1:], len(ids)) + off[-1][-1])
            out.append(ids)
        return Ragged(np.concatenate([*out, np.empty(0, np.uint32)]), np.concatenate(off))

    def run(self, texts: pa.Array, end_id: int | None = None) -> Ragged:
        """ids of each text of a large_string array without nulls, ``end_id`` behind each."""
        tight = pc.match_substring_regex(texts, _TIGHT)
        for x in self.added:
            tight = pc.or_(tight, pc.match_substring(texts, x))
        parts = pc.split_pattern(pc.if_else(tight, "", texts), " ")
        off = parts.offsets.to_numpy().astype(np.int64)
        words = parts.values.slice(off[0], off[-1] - off[0])
        off = off - off[0]
        first = off[:-1]  # what stands before the first space, and whole texts
        heads = pc.dictionary_encode(pc.if_else(tight, texts, words.take(pa.array(first))))
        words = pc.dictionary_encode(words)
        ended = pc.match_substring_regex(words.dictionary, _ENDED)
        stems = pc.dictionary_encode(pc.if_else(ended, pc.ascii_rtrim(words.dictionary, characters=_MARKS), words.dictionary))
        tails = pc.dictionary_encode(pc.if_else(ended, pc.replace_substring_regex(words.dictionary, _LETTERS, ""), ""))
        where = pc.fill_null(pc.index_in(stems.dictionary, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(where < 0)
        where[new] = len(self.known_ids) + np.arange(len(new))
        ids = self.known_ids + self._learn(stems.dictionary.take(pa.array(new)).to_pylist())
        self._remember(stems.dictionary, where, ids)
        both = np.stack([where[stems.indices.to_numpy()], len(ids) + tails.indices.to_numpy()], 1).ravel()
        both = (ids + self.whole(tails.dictionary.to_pylist())).take(both)
        ids = Ragged(both.flat, both.off[::2])
        at = words.indices.to_numpy().astype(np.int64)
        at[first] = len(ids) + heads.indices.to_numpy()
        ids = ids + self.whole(heads.dictionary.to_pylist())
        if end_id is not None:
            at = np.insert(at, off[1:], len(ids))
            ids = ids + Ragged.of([[end_id]])
            off = off + np.arange(len(off))
        found = ids.take(at)
        return Ragged(found.flat, found.off[off])

    def _remember(self, words: pa.Array, where: np.ndarray, ids: Ragged) -> None:
        """The parts met last come first; where there are too many, those not met for longest go."""
        here = np.flatnonzero(pc.binary_length(words).to_numpy() <= KNOWN_BYTES)
        rest = np.ones(len(self.known), bool)
        rest[where[here][where[here] < len(rest)]] = False
        rest = np.flatnonzero(rest)
        self.known = pa.concat_arrays([words.take(pa.array(here)), self.known.take(pa.array(rest))]).slice(0, KNOWN)
        self.known_ids = ids.take(np.concatenate([where[here], rest])[:KNOWN])

    def column(self, column: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, Ragged]]:
        """First row and ids of runs of rows of about ``RUN_BYTES``; null reads as empty."""
        column = column.cast(pa.large_string()).fill_null("")
        for lo, hi, _, _ in wk.slices(column, 2 * RUN_BYTES):  # what was gathered up to a run and a batch more is one run
            yield lo, self.run(column.slice(lo, hi - lo), end_id)

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for _, ids in self.column(pa.array(texts, pa.large_string())):
            out += [ids.flat[a:b].tolist() for a, b in zip(ids.off[:-1], ids.off[1:], strict=True)]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 0) -> None:
    """Tokenise ``docs`` (doc_id, text) and write token files under ``path`` in ascending doc_id order.

    Null and empty texts have the end id only.  Rows of one id (ties) are
    ordered by their text and stay separate rows, dealt out by the text's
    beginning; rows with a null id come first.  Other columns, whatever their
    names, are not read.  ``tokenizer`` is a path that every executor can open.  An empty
    table gives an empty file set with the same schema.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in gathered(batches, size=RUN_BYTES):
            for lo, ids in enc.column(batch.column(1), end_id):
                n = np.diff(ids.off)
                tokens = pa.ListArray.from_arrays(pa.array(ids.off.astype(np.int32)), pa.array(ids.flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(n)), pa.array(np.full(len(n), part, np.int32)), pa.array(start + ids.off[:-1]), pa.array(n), tokens], ["doc_id", "part", "start_in_part", "n_tokens", "tokens"])
                start += int(ids.off[-1])

    (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(F.asc_nulls_first("doc_id"), F.substring("text", 1, TIE_SIZE))
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
        .mapInArrow(run, "doc_id long, part int, start_in_part long, n_tokens long, tokens array<int>")
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .parquet(path)
    )


def read(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """Rows of the token files with ``start``, the tokens of all rows before; without ``tokens`` their pages are not read."""
    files = spark.read.parquet(path)
    # one row per written part: as many as the writing job had tasks
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    base, rows = 0, []
    for x in parts:
        rows.append((x["part"], base))
        base += x["n"]
    before = spark.createDataFrame(rows, "part int, before long")
    kept = ["doc_id", "part", "start_in_part", "n_tokens"] + ["tokens"] * tokens
    return files.select(*kept).join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("start_in_part"))


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the tokens as little-endian 32-bit integers."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            off = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<i4")).cast("B")
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int | None = 0, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token files and report each row as read back from them."""
    spark = docs.sparkSession
    path = path or store.new_path(spark, "tokens")
    write(docs, tokenizer, path, end_id)
    return checksums(read(spark, path))
