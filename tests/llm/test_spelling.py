"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lemmaforge.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, word string, n long"


def counts(rows):
    out = Counter()
    for doc_id, text in rows:
        for x in RUN.findall(text or ""):
            x = x.translate(AZ)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{x}".encode())
            if h % 97 == 0:
                x = x[: h % len(x)] + x[h % len(x) + 1 :]
            out[x] += 1
    return {x: n for x, n in out.items() if len(x) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(words):
    out = {}
    for x, n in words.items():
        all_near = [y for y in words if near(x, y)]
        best = min(all_near, key=lambda y: (-words[y], y), default=None)
        out[x] = [best if best is not None and words[best] >= 2 * n else None, n, len(all_near)]
    for x in out:
        root = x
        while out[root][0]:
            root = out[root][0]
        form = out[x][0]
        out[x] = (form, root, out[x][1], out[x][2], words[form] if form else None)
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abeé") for _ in range(rng.randrange(3, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaabaaaaaa", "ÿÿÿÿÿ", "ÿÿÿÿ÷ÿ", "prefix" * 5]
    words = []
    for x in stems:
        words += [x] * rng.choice([3, 8, 40, 200])
        for _ in range(3):
            k, c = rng.randrange(len(x) + 1), rng.choice("abcÿ")
            words += [rng.choice([x[:k] + c + x[k:], x[:k] + x[k + 1 :], x[:k] + c + x[k + 1 :], x.upper()])] * rng.choice([1, 3, 9])
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::40])) for i in range(40)]
    return rows + [(None, "aaaaaa bbbbb"), (50, None), (51, ""), (52, "a" * 3000 + "1" + "a" * 2999 + " " + "b" * 20000), (53, "a" * 3000 + "é a" + "ā" + "a" * 2999), (54, "a" * 3000 + "-" + "a" * 2999), (55, "x1-2 3́é"), (3, rows[3][1])]


@pytest.mark.parametrize("most_group", [2, 7, 10_000])
def test_variants(spark, most_group, monkeypatch):
    """Any bound of groups, and runs of few rows, give what comparing all pairs gives; clashing columns are not read."""
    if most_group == 7:
        monkeypatch.setattr(spelling, "RUN_QUERIES", 5)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    want = brute(counts(rows))
    got = spelling.variants(docs, most_group).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want and len(got) == len(want)
    assert sum(x[0] is not None for x in want.values()) > 20 and any(x[1] != x[0] is not None for x in want.values())


def test_no_words(spark):
    for rows in ([], [(1, None, "w", 1), (2, "a b c", "w", 1)]):
        out = spelling.variants(spark.createDataFrame(rows, SCHEMA))
        assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0


def test_chain_of_forms(spark):
    """Counts double from each word to its form; the root is the last of seven."""
    words = ["aaaaaaaaaa"[:k] + "bbbbbbbbbb"[k:] for k in range(8)]
    docs = spark.createDataFrame([(i, " ".join([w] * (4 << i)), "", 0) for i, w in enumerate(words)], SCHEMA)
    got = {r["word"]: r["root"] for r in spelling.variants(docs).collect()}
    assert {got[w] for w in words} == {words[-1]}


def test_one_hot_half(spark):
    """All words share a long prefix: no group is searched beyond its bound, and no pair is lost."""
    rng = random.Random(5)
    words = {"commonstem" + "".join(rng.choice("abcdef") for _ in range(6)): 3 for _ in range(400)}
    table = spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n long, low int").select("word", "n")
    groups = spelling._dealt(table, 20).filter("high - low > 1").groupBy("key").count().agg({"count": "max"}).first()[0]
    assert groups <= 20
    got = sorted((r["word"], r["near"]) for r in spelling.near_pairs(table, 20).collect())
    assert got == sorted((a, b) for a in words for b in words if near(a, b))


def test_wavelet_tree():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 64, 1000):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        box = np.sort(rng.integers(0, n + 1, (4, 50)).reshape(2, 2, 50), axis=1).reshape(4, 50)
        which, value = tree.report(*box)
        for q in range(50):
            a, b, c, d = box[:, q]
            assert sorted(value[which == q]) == sorted(v for v in values[a:b] if c <= v < d)


def test_folders_left(spark):
    """A finished run leaves its result alone, and that goes when asked."""
    from lemmaforge.llm import store

    store.clear(spark)
    docs = spark.createDataFrame([(1, "aaaaa aaaaa aaaaa bbbbb bbbbb bbbbb", "", 0)], SCHEMA)
    assert spelling.variants(docs).count() == 2
    assert len(store._named) == 1 and store.clear(spark) == 1 and store.clear(spark) == 0
