"""The training-data operators against brute force on small tables."""

import hashlib
import json
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lemmaforge.llm import chat, decontamination, fingerprints, jaccard_join, licenses, mixing, quality, queries, token_files, toxicity, url_filter
from lemmaforge.llm import words as wk
from lemmaforge.llm.components import components

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mix_id long"


def corpus(n=60, seed=1):
    """Texts with copies, near copies, nulls, empty, short and long ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 1 and texts:
            t = rng.choice([x for x in texts if x] or ["a"])
        elif kind == 2 and any(texts):
            w = rng.choice([x for x in texts if x]).split()
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            t = " ".join(w)
        else:
            t = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 40, 120])))
        texts.append(t)
    texts += [None, "", " \n\t", "One two", "ONE  two", "x" * 5000, "word " * 3000, "a b   c"]
    return [(i, t, "en", rng.choice(["s1", "s2", None]), len(t or ""), 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = BLANK.findall((text or "").translate(AZ))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_words_kernel():
    texts = ["", "Ab aB  ab", None, "é É 1", "x" * 70000 + " y", "a-b", " "]
    column = pa.array(texts, pa.string())
    for kind, rx in ((wk.BLANK, BLANK), (wk.ALNUM, re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+"))):
        got, hashes = [], {}
        for _, _, off, data in wk.slices(column, 16):
            s, e, first = wk.spans(off, data, kind)
            h = wk.hashes(s, e, data)
            for a, b in zip(first[:-1], first[1:], strict=True):
                got.append([bytes(data[x:y]).decode() for x, y in zip(s[a:b], e[a:b], strict=True)])
                for w, x in zip(got[-1], h[a:b], strict=True):
                    assert hashes.setdefault(w.translate(AZ), x) == x
        assert got == [rx.findall(t or "") for t in texts] and len(set(hashes.values())) == len(hashes)


def test_jaccard_join(spark, docs, empty):
    rows = corpus()
    sets = {r[0]: shingles(r[1]) for r in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs).collect()}
    assert found == {i: (len(s), root(i)) for i, s in sets.items()}
    assert {r["doc_id"] for r in jaccard_join.deduplicate(docs).collect()} == {i for i in sets if root(i) == i}
    assert jaccard_join.join(empty).count() == 0 and jaccard_join.deduplicate(docs).columns == docs.columns


def reach(nodes, links):
    """The least node that each one reaches."""
    near = {x: set() for x in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for x in sorted(nodes):
        todo = [x] if x not in out else []
        while todo:
            y = todo.pop()
            if y not in out:
                out[y] = x
                todo += near[y]
    return out


def test_components(spark):
    """Forests in one task and star rounds, on paths, stars and random links."""
    rng = random.Random(7)
    graphs = [[(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 50)], [(rng.randrange(300), rng.randrange(300)) for _ in range(250)], []]
    for links in graphs:
        df = spark.createDataFrame(links, "a long, b long").repartition(3)
        nodes = {x for p in links if p[0] != p[1] for x in p}
        for one_task in (10**6, 0):
            found = components(df, one_task=one_task).collect()
            assert {r["node"]: r["component"] for r in found} == reach(nodes, [p for p in links if p[0] != p[1]]) and len(found) == len(nodes)


@pytest.mark.parametrize("comparisons", [1 << 31, 0])
def test_long_lists(spark, monkeypatch, comparisons):
    """A group of near copies beyond the neighbours of the first round, with outsiders; lists compared whole and in blocks."""
    monkeypatch.setattr(jaccard_join, "MOST_COMPARISONS", comparisons)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            w[rng.randrange(100)] = f"u{i}_{rng.random()}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(90) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.join(df).collect()} == reach(range(90), links)


def test_jaccard_repeated_rows(spark):
    """Repeated ids, null ids and a clashing column."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, 5), (1, text, 6), (2, text + " z", 7), (None, text, 8), (3, "other words", 9), (3, text, 10), (4, None, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id int").withColumn("Kept_id_", F.lit(1))
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(df).collect()), key=str)
    assert found == sorted([(1, 26, 1), (1, 26, 1), (2, 27, 1), (None, 26, 1), (3, 1, 3), (3, 26, 1), (4, 0, 4)], key=str)
    kept = jaccard_join.deduplicate(df)
    assert kept.columns == df.columns and sorted(r["kept_id"] for r in kept.collect()) == [5, 6, 8, 9, 10, 11]


def test_every_link(spark, docs, empty):
    """Pairs, overlaps and link counts of groups, copies and outsiders against brute force."""
    rng = random.Random(5)
    texts = {}
    for i in range(130):
        w = [f"g{i % 2}_{j}" for j in range(100)]
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            w[rng.randrange(100)] = f"u{i}_{rng.random()}"
        texts[i] = " ".join(w)
    for rows, df in ((texts, spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)), ({r[0]: r[1] for r in corpus()}, docs)):
        sets = {i: shingles(t) for i, t in rows.items()}
        expected = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
        pairs, members = jaccard_join.links(df)
        of = {}
        for r in members.collect():
            of.setdefault(r["key"], []).append(r["doc_id"])
        of.pop(None, None)
        found = {(min(x, y), max(x, y)): r["overlap"] for r in pairs.collect() for x in of[r["a"]] for y in of[r["b"]]}
        assert found == {p: n for p, n in expected.items() if sets[p[0]] != sets[p[1]]} and found
        counts = {r["doc_id"]: (r["n_shingles"], r["n_links"]) for r in jaccard_join.link_counts(df).collect()}
        assert counts == {i: (len(sets[i]), sum(i in p for p in expected)) for i in sets}
    assert jaccard_join.link_counts(empty).count() == 0


def test_divide_skip():
    rng = np.random.default_rng(0)
    for _ in range(50):
        q = np.unique(rng.integers(0, 60, 30))
        others = [np.unique(rng.integers(0, 60, int(rng.integers(1, 40)))) for _ in range(12)]
        need = [int(x) for x in rng.integers(1, 25, 12)]
        exact = [(i, len(np.intersect1d(q, o))) for i, o in enumerate(others)]
        assert sorted(jaccard_join.divide_skip(q, others, need)) == [(i, c) for i, c in exact if c >= need[i]]


def test_parities():
    """The bound never falls below the true overlap, and is that of equal and of very different sets."""
    rng = np.random.default_rng(1)
    t, told = Fraction(4, 5), 0
    for _ in range(300):
        pool = wk.mix(rng.integers(0, 1 << 62, 1200).astype(wk.U))
        n = int(rng.integers(1, 500))
        a = np.unique(pool[:n])
        b = np.unique(np.concatenate([a[: int(n * rng.random())], pool[600 : 600 + int(rng.integers(1, 100))]]))
        x, y = (np.frombuffer(jaccard_join.parities(s), wk.U) for s in (a, b))
        possible = jaccard_join.may_reach(np.int64(len(a)), x, np.int64(len(b)), y, t)
        links = 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
        assert possible or not links
        told += not possible
    assert told > 150


def test_mixing(spark, docs, empty):
    assert mixing.sainte_lague([53, 24, 23], 7) == [3, 2, 2] and mixing.sainte_lague([1, 1], 3, [1, 9]) == [1, 2] and mixing.sainte_lague([], 3) == []
    for votes in ([5, 3, 1], [10, 10, 10], [1000, 1, 1]):
        seats = [0] * 3
        for _ in range(11):
            seats[max(range(3), key=lambda i: (votes[i] / (2 * seats[i] + 1), -i))] += 1
        assert mixing.sainte_lague(votes, 11) == seats
    assert mixing.capped_shares([10, 10], [5, 1], 30, 2) == [20.0, 10.0]
    rows = corpus()
    for block in (None, 7):
        plan = mixing.plan(docs, block=block).collect()
        again = mixing.plan(docs.repartition(5), block=block).collect()
        key = lambda r: (r["doc_id"], r["size"], r["taken"])
        assert sorted(map(key, plan)) == sorted(map(key, again)) and len(plan) == len(rows)
        own = {}
        for r in plan:
            assert r["size"] == len(BLANK.findall(rows[r["doc_id"]][1] or "")) and 0 <= r["taken"] <= 2 * r["size"]
            own[r["source"]] = own.get(r["source"], 0) + r["size"]
        expected = shares(own)
        for source in own:
            mine = [r for r in plan if r["source"] == source]
            assert {r["source_size"] for r in mine} == {own[source]} and all(r["target"] == pytest.approx(expected[source]) for r in mine)
            assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(2 * (block or 1), 0.02 * mine[0]["target"])
        mixed = mixing.mixture(docs, block=block)
        assert mixed.columns == docs.columns
        taken = {}
        for r in mixed.collect():
            words = BLANK.findall(r["text"])
            taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(words)
            assert r["n_chars"] == len(r["text"]) and " ".join(words) in " ".join(BLANK.findall(rows[r["doc_id"]][1]))
        assert taken == {r["doc_id"]: r["taken"] for r in plan if r["taken"]}
    assert mixing.plan(empty).count() == 0 and mixing.mixture(empty).count() == 0


def shares(sizes):
    """Targets, one source after another: scale all that are open, fix the largest excess first."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(order)}
    fixed = {}
    while True:
        left, open_ = Fraction(3, 2) * sum(sizes.values()) - sum(fixed.values()), [x for x in order if x not in fixed]
        want = {x: left * weight[x] / sum(weight[y] for y in open_) for x in open_}
        above = [x for x in open_ if want[x] > 2 * sizes[x]]
        if not above:
            return {x: float(y) for x, y in (want | fixed).items()}
        fixed |= {x: 2 * sizes[x] for x in above}


def test_mixing_many_shards(spark):
    """Cells and groups of cells, rows equal in id and text, clashing column names."""
    rng = random.Random(9)
    rows = [(i // 2, " ".join(["w"] * rng.randrange(1, 9)), rng.choice(["a", "a", "a", "b", None]), i % 3) for i in range(600)]
    rows += [(5, "x y z", "b", 7)] * 4 + [(5, "x y z", "b", 8)] * 4
    names = ["piece", "part", "cell", "mix_tie", "tie", "whole", "size", "from", "to", "key", "target", "taken", "doc", "words", "q"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").selectExpr("*", *[f"extra AS `{x}`" for x in names])
    old = mixing.CELL_ROWS, mixing.GROUP_CELLS, mixing.MOST_BROADCAST
    mixing.CELL_ROWS, mixing.GROUP_CELLS, mixing.MOST_BROADCAST = 10, 4, 1
    try:
        plan = mixing.plan(df, block=5).collect()
        mixed = mixing.mixture(df, block=5).collect()
    finally:
        mixing.CELL_ROWS, mixing.GROUP_CELLS, mixing.MOST_BROADCAST = old
    assert len(plan) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in plan)
    for source in ("a", "b", None):
        mine = [r for r in plan if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.1 * mine[0]["target"]
        words = sum(len(r["text"].split()) for r in mixed if r["source"] == source)
        assert words == sum(r["taken"] for r in mine)
    assert all(r[x] == r["extra"] for r in mixed for x in names)
    for extra in (7, 8):  # rows that differ in a column only are taken each, and none more than twice
        assert sum(len(r["text"].split()) for r in mixed if r["extra"] == extra) <= 24
    assert {r["extra"] for r in mixed if r["doc_id"] == 5} >= {7, 8}


def license_spans(words, k=3):
    """Label, base, votes, cover and first word of every span, by the rules of the docstring."""
    for label, base, t in licenses.templates(k):
        size = len(t) - k + 1
        lines = {}
        for p in range(len(words) - k + 1):
            for q in range(size):
                if words[p : p + k] == t[q : q + k]:
                    lines.setdefault(p - q, []).append((p, q))
        found, before = [], None
        for d in sorted(lines):
            votes = {q for _, q in lines[d]}
            if base or before is None or d - before[0] > licenses.NEAR_DIAGONALS or votes & before[1]:
                found.append([])
            found[-1] += lines[d]
            before = d, votes
        for span in found:
            n = len({q for _, q in span})
            first, last = min(span)[0], max(span)[0]
            yield label, base, n, n / max(size, last - first + 1), first, size


def test_licenses(docs, spark, empty):
    phrases = ["Released under the MIT License.", "Apache License, Version 2.0", "CC BY-NC", "under the mit, license", "licensed under the GNU General Public License version 3", "cc byK nc", "this work is " * 8, "this work is x " * 8]
    notice = licenses.TEMPLATES["mit"][2].split()
    phrases += [" ".join(notice), " ".join(notice[:20] + ["really"] + notice[20:]), " ".join(notice[:30] + notice[32:]), " ".join(notice[:12]), " ".join(reversed(notice)), " ".join(x for w in notice for x in (w, "and"))]
    rng = random.Random(11)
    words = sorted({w for _, _, t in licenses.templates() for w in t[:8]})
    mixed = [" ".join(rng.choice(phrases[:5] + [rng.choice(words) for _ in range(6)]) for _ in range(40)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate([*phrases, " ".join(phrases * 3), None, "", "cc by", *mixed, "cc by nc " * 20000])] + [(0, phrases[0])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS w", "2 AS row", "3 AS p", "4 AS template")).collect()
    found = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for i, t in rows:
        w = ALNUM.findall((t or "").translate(AZ))
        own = list(license_spans(w))
        places = [first for _, base, n, _, first, size in own if base and n == size]
        labels = {label for label, base, n, _, _, size in own if base and n == size}
        every = labels | {label for label, base, _, cover, _, _ in own if not base and cover >= licenses.LEAST_COVER}
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert (r["labels"], r["score"]) == (",".join(sorted(every)), pytest.approx(max((x[3] for x in own), default=0)))
    assert "gpl-3" in found[4]["labels"] and found[6]["labels"] == found[7]["labels"] == "" and [found[i]["labels"] for i in (8, 9, 10, 11)] == ["mit", "mit", "mit", ""]
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0


def labelled(spark):
    rng = random.Random(2)
    good = ["the", "of", "and", "with", "from", "tion", "anly", "there", "heron", "ingly"]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(good) + rng.choice(good) for _ in range(40)]
        toxic, bad = i % 5 == 0, i % 7 == 0
        if toxic:
            w[rng.randrange(40)] = rng.choice(["idiot", "moron", "stupid"])
        text = " ".join(w)
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text + "."))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, empty):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.scores(docs, model).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.98
    for text in ("you 1d10t", "an i d i o t", "idiooooot here", "such a m.o.r.o.n", "$tupid"):
        assert model.score(text) >= 0.5, text
    assert model.score("") == pytest.approx(model.base) and model.score("theof andwith") < 0.5
    assert {r["doc_id"] for r in toxicity.reject(docs, model).collect()} == {r["doc_id"] for r in rows if not r["predicted"]}
    assert toxicity.scores(empty, toxicity.fit(empty, labels)).count() == 0


def test_toxicity_spaced(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs.selectExpr("doc_id", "concat('a ', text) AS text"), labels)
    for text in ("such a m o r o n here", "(m o r o n)", "an (i d i o t)", "i d i o t.", "i  d  i  o  t", "$ t u p i d", "a s t u p i d m o r o n"):
        assert model.score(text) >= 0.5, text
    assert {"idiot", "moron"} <= toxicity.restored("i d i o t m o r o n", model.chars)
    assert model.score("x y z a b c") < 0.5 and model.score("a") == pytest.approx(model.base)


def test_toxicity_decodes_every_token(spark):
    model = toxicity.fit(*labelled(spark))
    long = "..." + "_" * 30 + "/theofandwithfrom/1d10t/" + "." * 10
    for text in ("stuupid", "iiddiioott", "!diot", "(!diot)", "m0r0n!", long, "i" * 30 + "d" * 30 + "iot", "theof|1d10t|andwith", "theofandwith,/stuupid/" * 3):
        assert model.score(text) >= 0.5, text
    for text, word in (("as$", "ass"), ("(lown", "clown"), ("|oser", "loser")):
        assert word in toxicity.restored(text, toxicity.CharModel(np.ones(729))), text
    assert model.score("theof andwith!! (heronanly) 2024") < 0.5


def test_quality(spark, empty):
    docs, labels = labelled(spark)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.scores(docs, quality.fit(docs, labels)).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert quality.scores(empty, quality.fit(empty, labels)).count() == 0


def test_quality_by_hand(spark):
    """Votes of a small model, ties, and edge cases through Spark."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        c = rng.integers(0, 6, (5, 40)).astype(np.float32)
        k = int(rng.integers(1, 40))
        want = [sorted(sorted(range(40), key=lambda j, row=row: (-row[j], j))[:k]) for row in c]
        assert quality.nearest(c, k).tolist() == want
    axes = np.eye(quality.FEATURES, dtype=np.float32)[:, :3]
    vectors = np.array([[1, 0, 0], [1, 0, 0], [0, 1, 0], [0.6, 0.8, 0]], np.float32)
    model = quality.QualityModel(0.25, np.ones(quality.FEATURES, np.float32), axes, vectors, np.array([1.0, 0.0, 0.0, 1.0]))
    x = np.zeros((3, quality.FEATURES), np.float32)
    x[0, 0], x[1, 1], x[1, 2] = 2.0, 3.0, 4.0
    got = model.score(x, neighbours=2, prior=0.5)
    w = [0.6**8, 0.48**8]  # of the second text: 0.6 with the third vector, 0.48 with the fourth
    assert got == pytest.approx([(1 + 0.5 * 0.25) / 2.5, (w[1] + 0.5 * 0.25) / (sum(w) + 0.5), 0.25], rel=1e-4)
    docs, labels = labelled(spark)
    fitted = quality.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema)))
    odd = [(1, None), (1, None), (2, ""), (3, " \n"), (None, "some text"), (4, "x" * 2_000_000), (5, "word " * 300_000), (1, "same text."), (1, "same text.")]
    rows = quality.scores(spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS held_out"), fitted).collect()
    assert len(rows) == len(odd) and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["score"] for r in rows if r["doc_id"] == 2] == [pytest.approx(fitted.base)] and len({r["score"] for r in rows if r["doc_id"] == 1}) == 2


def test_quality_of_equal_texts():
    """A row has one score to the last bit, alone, in a full block, and anywhere in one."""
    rng = np.random.default_rng(17)
    vectors = rng.normal(size=(900, 48)).astype(np.float32)
    model = quality.QualityModel(0.4, rng.random(quality.FEATURES).astype(np.float32), rng.normal(size=(quality.FEATURES, 48)).astype(np.float32), vectors / np.linalg.norm(vectors, axis=1, keepdims=True), rng.integers(0, 2, 900).astype(float))
    x = rng.random((700, quality.FEATURES)).astype(np.float32)
    whole = model.score(x)
    for part in (range(1), range(1, 4), range(5, 260), range(250, 700), range(699, 700)):
        assert np.array_equal(model.score(x[list(part)]), whole[list(part)])
    assert np.array_equal(model.score(x[rng.permutation(700)[:300]][:0]), np.empty(0))


def test_toxicity_by_hand(spark):
    """The score is the noisy-or of the heaviest term of each word; edge cases through Spark."""
    chars = toxicity.CharModel(np.ones(729))
    model = toxicity.ToxicityModel(chars, 0.1, {"bad": 0.5, "wors*": 0.6, "worst": 0.9, "worse": 0.2})
    assert model.score("bad") == pytest.approx(1 - 0.9 * 0.5) and model.score("worse bad") == pytest.approx(1 - 0.9 * 0.4 * 0.5)
    assert model.score("Worst worst") == pytest.approx(1 - 0.9 * 0.1) and model.score("fine") == pytest.approx(0.1)
    docs, labels = labelled(spark)
    fitted = toxicity.fit(docs, labels)
    odd = [(1, None), (1, None), (2, ""), (3, " \n"), (None, "you idiot"), (4, "x" * 1_000_000), (5, "i d i o t " * 20_000), (6, "you idiot"), (6, "you idiot"), (7, "1d10t-" + "x" * 70)]
    df = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS term", "3 AS y")
    rows = toxicity.scores(df, fitted).collect()
    assert len(rows) == len(odd) and [r["predicted"] for r in sorted(rows, key=lambda r: (r["doc_id"] or 0))] == [1, 0, 0, 0, 0, 0, 1, 1, 1, 1]
    assert toxicity.reject(df, fitted).columns == df.columns and toxicity.reject(df, fitted).count() == 5


def test_url_filter(spark):
    urls = ["http://WWW.Example.com/en/1?x", "https://a.example.com/en/", "http://x.net/es/a", "http://net/fr/", "ftp://b.com", "b.com/en/", None, "", "http://evilexample.com/en/", "http://a.org/example.com/en/", "http://spam-farm.example.org/q", "http://é.com/ü", "http:///en/", "http://" + "a" * 3000 + ".com/"]
    urls += ["http://x.casino-win.org/a", "http://my-ads.org", "http://a.org/b/c.zip?d", "http://a.org/cgi-bin/x", "http://roads.org/essex/zip", "http://spam.net/es/1", "http://a.org/" + "b/" * 20000 + "counter"]

    def own(host, path):
        parts = set(re.split(r"[.-]", host))
        named = any(x in host for x in queries.URL_CONTAINS) or parts & set(queries.URL_PARTS)
        return named or any(path.endswith(x) for x in queries.URL_ENDS) or set(path.split("/")[1:]) & set(queries.URL_FOLDERS)

    rows = queries.url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.URL_RULES, queries.URL_OWN).collect()
    for r in rows:
        url = urls[r["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(AZ)
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [x for x in queries.URL_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best.name if best else None)
        assert r["verdict"] == (best.verdict if best else "block" if own(host, path) else "allow"), url
    assert {r["page_id"] for r in rows if r["rule"] is None and r["verdict"] == "block"} >= {10, 14, 15, 16, 17}
    assert queries.url_filter.judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES, queries.URL_OWN).count() == 0
    repeated = spark.createDataFrame([(1, "http://a.net/es/", "x")] * 2 + [(None, "http://ads.org", "y")], "page_id long, url string, host string")
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in queries.url_filter.judge(repeated, queries.URL_RULES, queries.URL_OWN).collect()) == [(0, "block"), (1, "block"), (1, "block")]


def test_automaton_against_regex():
    rng = random.Random(0)
    globs = ["".join(rng.choice("ab/*") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randrange(0, 12))) for _ in range(200)]
    hit = url_filter.Automaton(globs).match([t.encode() for t in texts])
    for k, g in enumerate(globs):
        rx = re.compile("".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.findall(r"\*\*|\*|[^*]", g)))
        assert [bool(rx.fullmatch(t)) for t in texts] == hit[:, k].tolist(), g


def test_fingerprints(spark, docs, empty):
    rows = {r[0]: r[1] or "" for r in corpus()}
    ids = sorted(rows, reverse=True)
    following = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    got = fingerprints.report(docs).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        t = rows[r["doc_id"]]
        half = len(t) // 2
        edited = t[: len(t) - half] + rows[following[r["doc_id"]]][:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    # any window of consecutive hashes has a chosen position
    w, k = fingerprints.W, fingerprints.K
    for r in fingerprints.fingerprints(docs).collect():
        n = len(re.findall(fingerprints.TOKEN, rows[r["doc_id"]])) - k + 1
        at = set(r["positions"])
        assert all(at & set(range(i, i + w)) for i in range(n - w + 1))
    assert fingerprints.report(empty).count() == 0


def spark_hash(parts):
    """Spark's xxhash64 of strings, one seeding the next."""
    import xxhash

    h = 42
    for x in parts:
        h = xxhash.xxh64(x.encode(), seed=h).intdigest()
    return h


def winnowed(text, k=3, w=4):
    """(hash, position) chosen by windows, rightmost of equal ones, by brute force."""
    tokens = re.findall(fingerprints.TOKEN, text)
    runs = [spark_hash(tokens[i : i + k]) & 0xFFFFFFFF for i in range(len(tokens) - k + 1)]
    if not runs:
        return None  # a short text's one hash is of the array
    chosen = []
    for i in range(max(1, len(runs) - w + 1)):
        window = runs[i : i + w]
        low = min(window)
        at = i + max(j for j, x in enumerate(window) if x == low)
        if (low, at) not in chosen:
            chosen.append((low, at))
    return chosen


def test_fingerprints_by_hand(spark):
    """Fingerprints with ties, edited ones and likenesses against brute force; repeated ids, clashing columns."""
    rng = random.Random(13)
    texts = {i: " ".join(rng.choice(["a", "b", "cc", "the", "日本語のとても長い文字列"]) for _ in range(rng.choice([3, 5, 20, 60]))) for i in range(40)}
    rows = [(i, t) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS head", "2 AS lent", "3 AS tie", "4 AS part", "5 AS need").repartition(3)
    got = {r["doc_id"]: r for r in fingerprints.report(df).collect()}
    ids = sorted(texts, reverse=True)
    like = lambda a, b: len({h for h, _ in a} & {h for h, _ in b}) / max(1, len({h for h, _ in a} | {h for h, _ in b}))
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        t = texts[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[after][:half]
        a, b, c = winnowed(t), winnowed(edited), winnowed(texts[after])
        assert got[i]["fingerprint"] == ",".join(f"{h:x}@{p}" for h, p in a)
        if b:
            assert got[i]["edited_fingerprint"] == ",".join(f"{h:x}@{p}" for h, p in b) and got[i]["near_edited"] == pytest.approx(like(a, b))
        assert got[i]["near_next"] == pytest.approx(like(a, c))
    twice = fingerprints.report(df.unionByName(df.filter("doc_id < 3")).unionByName(spark.createDataFrame([(None, "a b c"), (None, None)], "doc_id long, text string"), allowMissingColumns=True)).collect()
    assert len(twice) == 45 and len({r["fingerprint"] for r in twice if r["doc_id"] == 2}) == 1


def test_fingerprints_without_blanks(spark):
    """A passage without blanks has the same hashes wherever it begins."""
    rng = random.Random(6)
    passage = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(400))
    texts = [passage, "一" + passage, "https://a.example/" + passage, "".join(chr(0x6E00 + rng.randrange(2000)) for _ in range(400)), "twelveletter", "twelveletter thirteenletterwords, \U00020001ab\u0e01", "x" * 30]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}

    def like(a, b):
        x, y = set(got[a]["hashes"]), set(got[b]["hashes"])
        return len(x & y) / len(x | y)

    assert like(0, 1) > 0.97 and like(0, 2) > 0.85 and like(0, 3) == 0
    tokens = [re.findall(fingerprints.TOKEN, t) for t in texts[4:]]
    assert tokens == [["twelveletter"], ["twelveletter", "thirteenletterwords,", "\U00020001", "ab", "\u0e01"], ["x" * 30]]  # of any length
    assert got[5]["fingerprint"] == ",".join(f"{h:x}@{p}" for h, p in winnowed(texts[5]))


def test_decontamination(spark, docs, empty, monkeypatch):
    rng = random.Random(3)
    item = [f"q{i}" for i in range(25)]
    items = [(1, " ".join(item)), (2, "Tiny item"), (10, " ".join(item[:12])), (4, None), (5, "--"), (6, "solo"), (1, "Tiny, item"), (11, " ".join(item)), (11, " ".join(item))]
    texts = [" ".join(rng.choice(item) for _ in range(30)), "x " + " ".join(item[3:20]) + " y", "TINY, item! tiny item", "the solo act", None, "", " ".join(item) * 2, " ".join(item[:9]), " ".join([*item[2:13], "gap", *item[5:21]]), " ".join([*item, "x"]) * 400]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    windows = set()
    for i, t in items:
        w = ALNUM.findall((t or "").translate(AZ))
        for j in range(max(1, len(w) - 9) if w else 0):
            windows.add((i, tuple(w[j : j + 10])))
    for tests in (None, 40):
        if tests:
            monkeypatch.setattr(decontamination.shards, "__defaults__", (10, tests))
            monkeypatch.setattr(decontamination, "LIVE_SHARDS", 1)
        for r in decontamination.report(d, b).collect():
            w = ALNUM.findall((texts[r["doc_id"]] or "").translate(AZ))
            hit, own, longest = set(), set(), (0, 0, "")
            for i, t in items:
                x = ALNUM.findall((t or "").translate(AZ))
                for p in range(len(w)):
                    for j in range(len(x)):
                        if w[p] == x[j] and not (p and j and w[p - 1] == x[j - 1]):
                            n = next((n for n in range(min(len(w) - p, len(x) - j)) if w[p + n] != x[j + n]), min(len(w) - p, len(x) - j))
                            if n >= min(10, len(x)):
                                longest = min(longest, (-n, p, str(i)))
            assert (-r["longest_match"], r["longest_at"] or 0, r["longest_item"] or "") == longest
            for i, x in windows:
                for j in range(len(w) - len(x) + 1):
                    if tuple(w[j : j + len(x)]) == x:
                        hit |= set(range(j, j + len(x)))
                        own.add(str(i))
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(own), bool(hit))
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
    assert {(r["item_id"], r["item_word"], r["doc_word"], r["n_words"]) for r in decontamination.matches(d, b).filter("doc_id = 1").collect()} == {(1, 3, 1, 17), (11, 3, 1, 17)}
    assert {r["doc_id"] for r in decontamination.decontaminate(d, b).collect()} == {0, 4, 5, 7}
    clash = d.selectExpr("*", "1 AS n_words", "2 AS item_id", "3 AS contaminated")
    assert decontamination.report(clash.unionByName(clash), b).filter("contaminated").count() == 2 * (len(texts) - 4) and decontamination.decontaminate(clash, b).columns == clash.columns
    assert decontamination.report(empty, b).count() == 0 and decontamination.report(d, b.limit(0)).filter("contaminated").count() == 0


def test_chat(spark):
    call = json.dumps({"content": "c", "tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "x", "limit": "3"}}, {"id": "b", "name": "zap", "arguments": {}}]})
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", call), (1, 0, "tool", '{"tool_call_id":"b","content":"early"}'), (1, 5, "tool", '{"tool_call_id":"q"}'), (2, 0, None, None), (2, 1, "user", "{broken")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r["conv_id"], r["turn"], r["role"]): r for r in chat.format_messages(df, spark.createDataFrame(queries.TOOLS, chat.SCHEMA_COLUMNS)).collect()}
    assert out[1, 1, "assistant"]["problems"] == "type of limit; unknown tool zap"
    assert json.loads(out[1, 1, "assistant"]["json"])["tool_calls"][0] == {"arguments": {"limit": "3", "query": "x"}, "id": "a", "name": "search"}
    early = out[1, 0, "tool"]
    assert (early["after"], early["step"], early["linked_turn"]) == (1, 1, 1) and out[1, 5, "tool"]["problems"] == "no call"
    assert out[2, 0, None]["json"] == '{"turn":0}' and json.loads(out[2, 1, "user"]["json"])["content"] == "{broken"
    assert chat.format_messages(df.limit(0)).count() == 0


def test_chat_chains(spark):
    def message(of, *ids):
        return json.dumps({"tool_call_id": of, "tool_calls": [{"id": i, "name": "search", "arguments": {"query": "x"}} for i in ids]} if of else {"tool_calls": [{"id": i, "name": "search", "arguments": {"query": "x"}} for i in ids]})

    rows = [(1, 7, message(None, "x")), (1, 5, message("x", "y")), (1, 6, message("y", "z")), (1, 2, message("z")), (1, 9, message("y", "w")), (1, 3, message("w")), (1, 8, "plain")]
    rows += [(2, 4, message("b", "a")), (2, 3, message("a", "b", "c")), (2, 1, message("c", "d")), (2, 0, message("d")), (2, 6, message("s", "s"))]
    rows += [(3, 1, message(None, "x")), (3, 2, '\n\t\r {"tool_call_id":"x","content":"late"}')]
    df = spark.createDataFrame([(c, t, "tool", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    out = chat.format_messages(df).collect()
    place = {(r["conv_id"], r["turn"]): (r["after"], r["step"]) for r in out}
    assert [place[1, t] for t in (7, 5, 6, 2, 9, 3, 8)] == [(7, 0), (7, 1), (7, 2), (7, 3), (9, 1), (9, 2), (8, 0)]
    assert {(r["conv_id"], r["turn"]) for r in out if "cycle" in r["problems"]} == {(2, 4), (2, 3), (2, 6)} and len(out) == len(rows)
    assert place[2, 3] < place[2, 1] < place[2, 0]
    late = next(r for r in out if (r["conv_id"], r["turn"]) == (3, 2))
    assert (late["linked_turn"], late["problems"], json.loads(late["json"])["content"]) == (1, "", "late")


def test_chat_long_chains(spark):
    """A chain of 150 links with turns up and down, a call made twice at one turn, and a tail behind a cycle, in few rounds."""
    rng = random.Random(18)
    text = lambda of, *ids: json.dumps(({"tool_call_id": of} if of else {}) | {"tool_calls": [{"id": i, "name": "search", "arguments": {}} for i in ids]})
    turns = [rng.randrange(100) for _ in range(150)]
    rows = [(1, t, "tool", text(f"c{k - 1}" if k else None, f"c{k}")) for k, t in enumerate(turns)]
    rows += [(2, 5, "a", text(None, "x")), (2, 3, "b", text(None, "y")), (2, 9, "c", text("x", "z")), (2, 9, "d", text("y", "z")), (2, 4, "e", text("z", "w"))]
    rows += [(3, 1, "t", text("q", "p")), (3, 2, "t", text("p", "q")), *((3, 3 + k, "t", text(f"t{k - 1}" if k else "q", f"t{k}")) for k in range(20))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = chat.format_messages(df).collect()
    place, want = {(r["conv_id"], r["turn"], r["role"], r["linked_turn"]): (r["after"], r["step"]) for r in out}, []
    at = (turns[0], 0)
    for k, t in enumerate(turns[1:], 1):
        at = (t, 1) if t > at[0] else (at[0], at[1] + 1)
        want.append((1, t, "tool", turns[k - 1], *at))
    assert sorted(want) == sorted((*key, r["after"], r["step"]) for r in out if r["conv_id"] == 1 and r["linked_turn"] is not None for key in [(1, r["turn"], "tool", r["linked_turn"])])
    assert place[2, 4, "e", 9] == (9, 2) and {r["turn"] for r in out if r["conv_id"] == 3 and "cycle" in r["problems"]} == {1, 2}
    tail = sorted((r["turn"], r["after"], r["step"]) for r in out if r["conv_id"] == 3 and r["turn"] > 2)
    assert tail == [(3 + k, 3 + k, 1) for k in range(20)]


def test_chat_keeps_every_key(spark):
    """Further keys stay in canonical order, arguments in a string are read, very long texts pass."""
    told = {"tool_calls": [{"id": "a", "name": "search", "arguments": '{"query":"x","limit":3}'}, {"id": "b", "name": "search", "arguments": "no object"}], "name": "bob", "zeta": {"b": [1, None], "a": "é"}, "alpha": None, "role": "other", "turn": 99}
    long = "y" * 1_000_000
    rows = [(1, 0, "assistant", json.dumps(told)), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": long, "name": "search", "at": 1.5})), (1, 2, "user", long), (1, 3, "user", json.dumps({"name": "plain"}))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["turn"]: r for r in chat.format_messages(df, spark.createDataFrame(queries.TOOLS, chat.SCHEMA_COLUMNS)).collect()}
    assert out[0]["problems"] == "missing query"
    calls = [{"arguments": {"limit": 3, "query": "x"}, "id": "a", "name": "search"}, {"arguments": "no object", "id": "b", "name": "search"}]
    assert out[0]["json"] == json.dumps({"alpha": None, "name": "bob", "role": "assistant", "tool_calls": calls, "turn": 0, "zeta": {"a": "é", "b": [1, None]}}, separators=(",", ":"), ensure_ascii=False)
    assert out[1]["json"] == json.dumps({"at": 1.5, "content": long, "name": "search", "role": "tool", "tool_call_id": "a", "turn": 1}, separators=(",", ":"))
    assert json.loads(out[2]["json"]) == {"content": long, "role": "user", "turn": 2} and json.loads(json.loads(out[3]["json"])["content"]) == {"name": "plain"}


def chat_places(rows):
    """after, step, linked turn and problems of every message, one conversation after another, by following links."""
    calls = {}
    for n, (conv, turn, _, text) in enumerate(rows):
        try:
            v = json.loads(text or "")
        except ValueError:
            continue
        for c in v.get("tool_calls", []) if isinstance(v, dict) else []:
            calls.setdefault((conv, c.get("id")), []).append((turn, n))

    def place(n, seen=()):
        conv, turn, _, text = rows[n]
        try:
            of = json.loads(text or "").get("tool_call_id")
        except (ValueError, AttributeError):
            of = None
        if of is None or conv is None or (conv, of) not in calls:
            return (turn, 0)
        caller = min(calls[conv, of])[1]
        after, step = place(caller)
        return (max(turn, after), 1 if turn > after else step + 1)

    return [place(n) for n in range(len(rows))], calls


def test_chat_against_links_followed_by_hand(spark):
    """Random conversations: chains, orphans, repeated ids (of results without calls), repeated rows, ties in turns, nulls."""
    rng = random.Random(12)
    rows = []
    for conv in range(40):
        ids = 0
        for turn in rng.sample(range(30), 8):
            kind = rng.randrange(5)
            message = {}
            if kind in (1, 3):
                message["tool_calls"] = [{"id": f"i{ids + j}", "name": "search", "arguments": {"query": "x"}} for j in range(rng.randrange(1, 3))]
                ids += len(message["tool_calls"])
            if kind in (2, 3) and ids > 2:  # of an earlier message's call, so that no cycle comes about
                message["tool_call_id"] = f"i{rng.randrange(ids - 2)}" if rng.random() < 0.9 else "none"
            rows.append((conv, turn, "tool", json.dumps(message) if message else rng.choice(["plain", None, "", "{x"])))
    rows += [rows[0], rows[0]] if "tool_calls" not in (rows[0][3] or "") else []
    rows += [(50, 3, "a", json.dumps({"tool_calls": [{"id": "b", "name": "zap", "arguments": {}}]})), (50, 3, "b", '{"tool_call_id":"q"}'), (None, 1, "c", '{"tool_call_id":"b"}'), (None, 1, "c", json.dumps({"tool_calls": [{"name": "zap", "arguments": {}}]}))]
    want, calls = chat_places(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS id", "2 AS message", "3 AS place").repartition(3)
    got = chat.format_messages(df, spark.createDataFrame(queries.TOOLS, chat.SCHEMA_COLUMNS)).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r["conv_id"], r["turn"], r["role"], r["after"], r["step"]) for r in got), key=key) == sorted(((c, t, role, *p) for (c, t, role, _), p in zip(rows, want, strict=True)), key=key)
    by = {(r["conv_id"], r["role"], r["n_calls"]): r["problems"] for r in got if r["conv_id"] in (50, None)}
    assert by == {(50, "a", 1): "unknown tool zap", (50, "b", 0): "no call", (None, "c", 0): "no call", (None, "c", 1): "no id; unknown tool zap"}
    ordered = sorted((r for r in got if r["conv_id"] is not None), key=lambda r: (r["conv_id"], r["after"], r["step"], r["turn"]))
    at = {(r["conv_id"], r["turn"]): i for i, r in enumerate(ordered)}
    assert all(at[r["conv_id"], r["linked_turn"]] < at[r["conv_id"], r["turn"]] for r in ordered if r["linked_turn"] is not None and r["linked_turn"] != r["turn"])


def test_token_output(spark, docs, empty, tmp_path):
    path = queries.tokenizer_path()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    assert plain.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [31373, 220, 50256, 995]
    odd = ["hello <|endoftext|> world", "a  <|endoftext|>  b", "<|endoftext|>", "a  b", "x \n y", "  ", "a\n\n b 's it's  don't 12 3.5 <|endoftext|>", "日本語 テスト\t\tz  ", "\n a", "trail ", "😀 😀x", "Émile, ça! va?"]
    enc = token_files.Encoder(path)
    assert enc.encode(odd) == [x.ids for x in plain.encode_batch(odd, add_special_tokens=False)]
    rng = random.Random(8)
    atoms = ["a", "bc", " ", "  ", "\n", "\t", "'s", ".", ",;", "12", "é", "日", "<|endoftext|>", "\x0b", "\x1f", "\x85", "\u3000", "Ġ", "word, "]
    mixed = ["".join(rng.choice(atoms) for _ in range(rng.randrange(14))) for _ in range(3000)]
    old, token_files.RUN_BYTES = token_files.RUN_BYTES, 500  # many runs: remembered parts come back
    assert enc.encode(mixed) == [x.ids for x in plain.encode_batch(mixed, add_special_tokens=False)]
    token_files.RUN_BYTES = old
    files = str(tmp_path / "tokens")
    rows = sorted(token_files.token_output(docs, path, path=files).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, (_, text, *_) in zip(rows, corpus(), strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert "tokens" not in token_files.read(spark, files, tokens=False).columns
    assert token_files.token_output(empty, path).count() == 0


def test_token_files(spark, tmp_path):
    """Ties in id order by text, clashing columns, and the layout that the files are promised to have."""
    import glob

    import pyarrow.parquet as pq

    path = queries.tokenizer_path()
    rows = [(7, "b c"), (7, "a"), (None, "z"), (7, "a"), (3, None), (9, "word " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS start", "3 AS tokens", "4 AS n_tokens").repartition(3)
    files = str(tmp_path / "files")
    got = sorted(token_files.token_output(df, path, path=files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 3, 7, 7, 7, 9] and [r["n_tokens"] for r in got[1:5]] == [1, 2, 2, 3]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
    seen = 0
    for name in sorted(glob.glob(f"{files}/*.parquet")):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            for c in columns.values():
                assert c.has_offset_index and c.has_column_index, c.path_in_schema
            tokens = next(c for n, c in columns.items() if n.startswith("tokens"))
            assert "RLE_DICTIONARY" in tokens.encodings or "DELTA_BINARY_PACKED" in tokens.encodings
            seen += meta.row_group(g).num_rows
    assert seen == len(rows)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark)
    docs = docs.selectExpr("doc_id", "text", "'en' AS lang", "concat('s', doc_id % 3) AS source", "length(text) AS n_chars")
    item = docs.filter("doc_id = 11").first()["text"]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.unionByName(docs.filter("doc_id = 12").selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in rows}
    assert not ids & {i for i in range(600) if i % 5 == 0} and 11 not in ids and 1012 not in ids and len(ids) > 200
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "mixing", "token output"]


def test_pipeline_stage_by_stage(spark, tmp_path):
    """run() against the stages by hand: scores, shingle sets, windows, the mixture's rows and the plain tokenizer."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs, labels = labelled(spark)
    rng = random.Random(14)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()][:200]
    for i in range(60):  # near copies, some of them too far off
        w = rows[rng.randrange(200)][1].split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"new{i}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, "short one")]
    items = [(1, rows[7][1]), (2, "short one"), (3, " ".join(rows[8][1].split()[5:20]))]
    frame = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = toxicity.fit(frame, labels)
    left = {i: t for i, t in rows if model.score(t or "") < 0.5}
    sets = {i: shingles(t) for i, t in left.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    least = reach(sets, links)
    left = {i: t for i, t in left.items() if least[i] == i}
    windows = set()
    for _, t in items:
        w = ALNUM.findall(t.translate(AZ))
        windows |= {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9))}

    def clean(t):
        w = ALNUM.findall((t or "").translate(AZ))
        return not any(tuple(w[j : j + n]) in windows for n in {len(x) for x in windows} for j in range(len(w) - n + 1))

    left = {i: t for i, t in left.items() if clean(t)}
    assert 7 not in left and 2002 not in left and len(left) > 100
    mixed = mixing.mixture(frame.filter(F.col("doc_id").isin(list(left)))).collect()
    assert {r["doc_id"] for r in mixed} <= set(left)
    plain = Tokenizer.from_file(queries.tokenizer_path())
    plain.encode_special_tokens = True
    want = sorted((r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in mixed for ids in [[*plain.encode(r["text"], add_special_tokens=False).ids, 0]])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_threshold_is_exact():
    assert jaccard_join.least_overlap(10, 10, Fraction(4, 5)) == 9 and jaccard_join.least_overlap(5, 4, Fraction(4, 5)) == 4
