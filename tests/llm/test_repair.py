"""Repair of conversations against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from lemmaforge.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, part int"
RIGHT = re.compile("(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}


def brute(rows):
    """gaps, faults, cost, audit and hash by trying every edit of (turn, role, text) rows in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    for inserted in itertools.product([x for k in range(3) for x in itertools.product("ua", repeat=k)], repeat=len(rows) + 1):
        for edits in itertools.product(*("D" if f in ("b", "d") and f else "DKua" for f in faults)):
            cost, audit, out = 3 * sum(map(len, inserted)), "I" * len(inserted[0]), [(NAMES[x], "") for x in inserted[0]]
            for e, f, (_, role, text), more in zip(edits, faults, rows, inserted[1:], strict=True):
                cost += {"D": 4, "K": 0}.get(e, 3) + 3 * (f == "t" and e != "D")
                audit += (e if e in "DK" else "R") + "I" * len(more)
                out += [] if e == "D" else [(role if e == "K" else NAMES[e], text)]
                out += [(NAMES[x], "") for x in more]
            if RIGHT.fullmatch("".join(r[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())
    turns = [r[0] for r in rows if r[0] is not None]
    letters = [r[1][:1] for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(letters))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in "bdt"), illegal, *best)


def conversations(rng, n, most):
    out = []
    for c in range(n):
        turn = 0
        for _ in range(rng.randint(1, most)):
            turn += rng.choice([0, 1, 1, 1, 3])
            out.append((c, turn, rng.choice(["user", "assistant", "system", "tool", "user"]), rng.choice(["A b.", "A b.", "so!", "cut", "", " \n", "why?\n"])))
    return out


def in_order(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{r[2]}\0{r[3]}".encode()).digest())
    return sorted(([c, t, " " if r is None else r, " " if x is None else x] for c, t, r, x in rows), key=key)


def wanted(rows, judge=brute):
    return {c: judge([tuple(r[1:]) for r in in_order([r for r in rows if r[0] == c])]) for c in {r[0] for r in rows}}


def found(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_against_every_edit(spark):
    """Short conversations with null and equal turns, unknown and null roles, null texts, a null id; other columns are not read."""
    rng = random.Random(1)
    rows = conversations(rng, 25, 3) + [(100, None, "user", "a."), (100, None, None, "b."), (101, None, "user", None), (102, 1, "user", "x."), (102, 1, "assistant", "y."), (None, 5, "assistant", "z."), (None, 9, "system", "z."), (103, 0, "", "e."), (103, 1, "user", "e."), (104, 2, "user", "u" * 20_000)]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA).repartition(3)
    out = repair.report(df)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert found(out) == wanted(rows)


@pytest.mark.parametrize(("size", "width"), [(1, 1 << 20), (2, 1 << 20), (256, 9)])
def test_segments_do_not_matter(spark, monkeypatch, size, width):
    """One conversation with most of the rows, over many partitions and segments of few rows, is parsed as in one piece."""
    rng = random.Random(2)
    rows = [(0, t, *r[2:]) for t, r in enumerate(conversations(rng, 60, 5))] + conversations(rng, 12, 9)[:40]
    rows = [(c, t, r, x + str(i % 41) * (len(x) > 3 and i % 3) + "." * (i % 2)) for i, (c, t, r, x) in enumerate(rows)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    whole = found(repair.report(df))
    monkeypatch.setattr(repair, "SEGMENT_ROWS", size)
    monkeypatch.setattr(repair, "SEGMENT_BYTES", width)
    assert found(repair.report(df)) == whole
    grammar = repair.Grammar()
    for c, got in whole.items():
        mine, seen, parsed = in_order([r for r in rows if r[0] == c]), set(), []
        for _, _, role, text in mine:
            bare = text.strip(repair.BLANKS)
            parsed.append((role[:1], not bare or (role, text) in seen, bare[-1:] not in (".", "!", "?")))
            seen.add((role, text))
        last = repair.chart(parsed, "S", grammar)
        assert got[5:7] == min(last[x] for x in last if grammar.final(x))


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "assistant", "b."), (1, 3, "user", ""), (2, 0, "user", "q?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = sorted(repair.repaired(df).collect(), key=lambda r: (r["part"], r["seq"], r["place"]))
    assert [tuple(r)[4:] for r in out if r["conv_id"] == 1] == [("K", "system", "s."), ("R", "user", "a."), ("K", "assistant", "b."), ("D", None, None)]
    assert [tuple(r)[4:] for r in out if r["conv_id"] == 2] == [("K", "user", "q?"), ("I", "assistant", "")]
    digests = {r["conv_id"]: (r["audit"], r["repaired_sha256"]) for r in repair.report(df).collect()}
    for c in (1, 2):
        mine = [r for r in out if r["conv_id"] == c]
        text = "\n".join(f"{r['role']}:{r['text']}" for r in mine if r["role"] is not None)
        assert digests[c] == ("".join(r["edit"] for r in mine), hashlib.sha256(text.encode()).hexdigest())


def test_damage(spark):
    rng = random.Random(3)
    rows = conversations(rng, 40, 6) + [(None, None, None, None), (200, None, "user", "a.!?b"), (201, 7, None, None)]
    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        want += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    key = lambda r: tuple((v is not None, v or type(v)()) if v is not None else (False,) for v in r)
    assert sorted(map(tuple, repair.damage(df).collect()), key=key) == sorted(want, key=key)


def test_conversations_without_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(none).count() == 0 and repair.repaired(none).count() == 0
    some = spark.createDataFrame([(5,), (5,), (None,)], "conv_id long")
    assert found(repair.report(none, some)) == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in (5, None)}


def test_equal_rows_of_one_turn(spark):
    """Many copies of one row: one stays, the others go, wherever they lie."""
    df = spark.createDataFrame([(1, 0, "user", "q?")] * 700 + [(1, 1, "assistant", "a.")], "conv_id long, turn long, role string, text string").repartition(5)
    (r,) = repair.report(df).collect()
    assert r["duplicate"] == 699 and r["cost"] == 4 * 699 and sorted(r["audit"]) == sorted("KK" + "D" * 699) and r["illegal"] == 699


def test_grammars():
    with pytest.raises(ValueError, match="tell apart"):
        repair.Grammar(rules={"S": [("u", "S"), ("a", "S"), None]})
    with pytest.raises(ValueError, match="cost"):
        repair.Grammar(insert=0)
    pairs = repair.Grammar(rules={"S": [None, ("q", "R")], "R": [("r", "S")]}, start="S", roles={"q": "question", "r": "reply"}, delete=9)
    assert repair.chart([("r", False, False)], "S", pairs)["S"] == (3, "IK")
