"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from lemmaforge.llm import byte_pairs

PATH = P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, n_tokens long"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def corpus(seed=4):
    rng = random.Random(seed)
    letters = ["a", "b", "B", " ", "  ", " the", "1", "é", "漢", "'s", "'re", ".", "!!", "\t", "\n", "\r\n", "\x1c", "\x85", "\xa0", " ", "　", "́", "\U0001f600", "à ", "<|endoftext|>", "\x00"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", " ", "  \n ", "x" * 30_000, "ab" * 20_000, "漢字" * 9_000, " " * 5_000 + "a", "word " * 3_000, texts[3]]
    return [(i % 290, x, "clash", 1) for i, x in enumerate(texts)]


def test_report(spark, library):
    """Ids and bytes of every row, with null, empty, long and repeated rows, ties in doc_id and clashing columns."""
    rows = corpus()
    got = byte_pairs.report(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, P.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(i, len(ids := library.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, *_ in rows]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_round_trip(spark, library):
    rows = corpus(5)
    ids = byte_pairs.encode(spark.createDataFrame(rows, SCHEMA), PATH, P.PATTERN)
    assert sorted((r[0], list(r[1])) for r in ids.collect()) == sorted((i, library.encode_ordinary(t or "")) for i, t, *_ in rows)
    raw = byte_pairs.decode(ids, PATH, P.PATTERN)
    assert sorted((r[0], bytes(r[1])) for r in raw.collect()) == sorted((i, (t or "").encode()) for i, t, *_ in rows)
    some = spark.createDataFrame([(1, [0, 50255, 0]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r[0]: bytes(r[1]) for r in byte_pairs.decode(some, PATH, P.PATTERN).collect()} == {1: library.decode_bytes([0, 50255, 0]), 2: b"", 3: b""}
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_pairs.decode(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>"), PATH, P.PATTERN).collect()


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert byte_pairs.report(none, PATH, P.PATTERN).count() == byte_pairs.encode(none, PATH, P.PATTERN).count() == 0


def test_every_code_point(library):
    """The pattern's classes and the cuts before blanks agree with the library's on all of Unicode."""
    coder = byte_pairs.codec(PATH, P.PATTERN)
    texts = ["".join(f"a{chr(i)} b{chr(i)}{chr(i)}1 {chr(i)}" for i in range(k, k + 4096) if not 0xD800 <= i < 0xE000) for k in range(0, 0x110000, 4096)]
    for lo, ids in coder.column(pa.array(texts)):
        for k, (a, b) in enumerate(zip(ids.off[:-1], ids.off[1:], strict=True)):
            assert ids.flat[a:b].tolist() == library.encode_ordinary(texts[lo + k])


def test_perfect_hash():
    """Every key has a slot of its own among as many as there are keys."""
    rng = random.Random(6)
    keys = sorted({rng.randbytes(rng.randrange(12)) for _ in range(5000)})
    table = byte_pairs.PerfectHash(byte_pairs.ragged_bytes(keys))
    assert sorted(table.slots(byte_pairs.ragged_bytes(keys)).tolist()) == list(range(len(keys)))
    other = table.slots(byte_pairs.ragged_bytes([b"no key of it" * 2, b""]))
    assert ((other >= -1) & (other < len(keys))).all()


def test_forgetting(library, monkeypatch):
    """What is remembered is bounded and changes nothing."""
    monkeypatch.setattr(byte_pairs, "KNOWN", 50)
    monkeypatch.setattr(byte_pairs, "RUN_BYTES", 2000)
    coder, texts = byte_pairs.Codec(PATH, P.PATTERN), [t or "" for _, t, *_ in corpus(7)]
    for lo, ids in coder.column(pa.array(texts)):
        for k, (a, b) in enumerate(zip(ids.off[:-1], ids.off[1:], strict=True)):
            assert ids.flat[a:b].tolist() == library.encode_ordinary(texts[lo + k])
    assert set(coder.known.values()) <= set(range(len(coder.known_ids))) and len(coder.known_ids) < 1000


def test_a_byte_without_a_token(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="single byte"):
        byte_pairs.Codec(str(path), P.PATTERN)
