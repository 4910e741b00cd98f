"""The hypothesis lattice on signatures.

A row's signature is the string of its flags, as bits.  The closure of a
hypothesis, a conjunction of flags, is the set of flags that every row it
selects has: the bitwise and of those rows' signatures.  Two hypotheses select
the same rows where their closures are equal, and one lies inside another where
its closure holds the other's, so equality, inclusion and dominance need a
support and a closure for each hypothesis, aggregates of the table signature ->
rows that one aggregation with map-side combine makes.  Up to MOST_SIGNATURES of
them come to the driver; more stay in Spark and are asked there.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..pred import TRUE, Flag, Pred, conj


def classify(df: DataFrame, exclude: Sequence[str] = ("name", "Unnamed: 0")) -> tuple[list[str], list[str]]:
    """(numeric, boolean) columns by type alone, from the schema."""
    kinds = dict(df.dtypes)
    numeric = [c for c, t in kinds.items() if c not in exclude and t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    return numeric, [c for c, t in kinds.items() if c not in exclude and t == "boolean"]


def boolean_like(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Per boolean or numeric column: whether its values are all 0 or 1, and there are some.  One pass."""
    numeric, boolean = classify(df, exclude)
    cols = [c for c in df.columns if c in numeric or c in boolean]
    one = lambda c: F.col(f"`{c}`").cast("double")
    stats = df.agg(*[x for i, c in enumerate(cols) for x in (F.count(one(c)).alias(f"n{i}"), F.coalesce(F.bool_and(one(c).isin(0.0, 1.0)), F.lit(False)).alias(f"b{i}"))])
    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), (F.col(f"b{i}") & (F.col(f"n{i}") > 0)).alias("boolean_like")) for i, c in enumerate(cols)])
    return stats.select(F.explode(listed).alias("x")).select("x.*")


def partition(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[Flag], list[str]]:
    """Flags (boolean-like columns) and the other numeric columns."""
    kinds = dict(df.dtypes)
    flags = [Flag(r["column"], "boolean" if kinds[r["column"]] == "boolean" else "number") for r in boolean_like(df, exclude).collect() if r["boolean_like"]]
    numeric, _ = classify(df, exclude)
    return flags, [c for c in numeric if c not in {f.name for f in flags}]


def signature(flags: Sequence[Pred]) -> Column:
    return F.concat(F.lit(""), *[F.when(p.column(), "1").otherwise("0") for p in flags])


#: Flags in one word of a signature, signatures that come to the driver, and hypotheses asked in one pass over those that do not.
WORD, MOST_SIGNATURES, ASKED = 62, 50_000, 200


def words(preds: Sequence[Pred]) -> list[Column]:
    """The truth values of predicates as bits of longs."""
    out = []
    for lo in range(0, len(preds), WORD):
        bits = [F.when(p.column(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, p in enumerate(preds[lo : lo + WORD])]
        out.append(_sum(bits))
    return out or [F.lit(0).cast("long")]


def _sum(columns: list[Column]) -> Column:
    """Their sum as a balanced tree."""
    while len(columns) > 1:
        columns = [a + b for a, b in zip(columns[::2], columns[1::2], strict=False)] + columns[len(columns) // 2 * 2 :]
    return columns[0]


def _bits_of(values: Sequence[int]) -> frozenset[int]:
    return frozenset(w * WORD + i for w, v in enumerate(values) for i in range(WORD) if v >> i & 1)


def _words_of(bits: Iterable[int], n: int) -> list[int]:
    out = [0] * n
    for i in bits:
        out[i // WORD] |= 1 << i % WORD
    return out


@dataclass(frozen=True)
class Hypothesis:
    seq: int
    pred: Pred
    bits: frozenset[int]

    @property
    def arity(self) -> int:
        return len(self.bits)

    def label(self) -> str:
        return self.pred.label()


@dataclass(frozen=True)
class Cover:
    """What a hypothesis selects: how many rows, and the flags that all of them have."""

    support: int
    closure: frozenset[int]

    def __bool__(self) -> bool:
        return self.support > 0

    def __lt__(self, other: Cover) -> bool:
        """Whether these rows are some, but not all, of the other's."""
        if not self.support or not other.support:
            return self.support < other.support
        return self.closure > other.closure


class Lattice:
    """Signature counts of a table and the hypotheses over its flags."""

    def __init__(self, df: DataFrame, flags: Sequence[Pred], base: Pred | None = None):
        self.flags = sorted(flags, key=lambda p: p.label())
        named = [w.alias(f"w{i}") for i, w in enumerate(words(self.flags))]
        self._names = [f"w{i}" for i in range(len(named))]
        self._table = df.select(*named).groupBy(*self._names).agg(F.count("*").alias("n")).persist()
        some = self._table.limit(MOST_SIGNATURES + 1).collect()
        self._few = len(some) <= MOST_SIGNATURES
        if self._few:
            self._table.unpersist()
            self._words = np.array([[r[n] for n in self._names] for r in some], np.int64).reshape(len(some), len(self._names))
            self._rows = np.array([r["n"] for r in some], np.int64)
        self._memo: dict[frozenset[int], Cover] = {}
        every = self._measured([frozenset()])[0]
        self.n = every.support
        always = every.closure if self.n else frozenset()
        self.base = Hypothesis(0, conj([self.flags[i] for i in sorted(always)]) if always else TRUE, always)
        if base is not None and base in self.flags:
            i = self.flags.index(base)
            self.base = Hypothesis(0, base, frozenset({i}))

    def _measured(self, asked: Sequence[frozenset[int]]) -> list[Cover]:
        """Covers of conjunctions of flags, those not known yet in few passes."""
        new = [b for b in dict.fromkeys(asked) if b not in self._memo]
        everything = frozenset(range(len(self.flags)))
        if self._few:
            for bits in new:
                mask = np.array(_words_of(bits, len(self._names)), np.int64)
                on = ((self._words & mask) == mask).all(axis=1)
                closure = _bits_of(np.bitwise_and.reduce(self._words[on], axis=0).tolist()) if on.any() else everything
                self._memo[bits] = Cover(int(self._rows[on].sum()), closure)
        else:
            for lo in range(0, len(new), ASKED):
                part, cols = new[lo : lo + ASKED], []
                for i, bits in enumerate(part):
                    test = F.lit(True)
                    for n, mask in zip(self._names, _words_of(bits, len(self._names)), strict=True):
                        test = test & (F.col(n).bitwiseAND(F.lit(mask).cast("long")) == mask) if mask else test
                    cols += [F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias(f"n{i}"), *(F.bit_and(F.when(test, F.col(n))).alias(f"{n}_{i}") for n in self._names)]
                row = self._table.agg(*cols).first()
                for i, bits in enumerate(part):
                    self._memo[bits] = Cover(row[f"n{i}"], _bits_of([row[f"{n}_{i}"] for n in self._names]) if row[f"n{i}"] else everything)
        return [self._memo[b] for b in asked]

    def covers(self, hyps: Sequence[Hypothesis]) -> list[Cover]:
        return self._measured([h.bits for h in hyps])

    def cover(self, h: Hypothesis) -> Cover:
        return self.covers([h])[0]

    def support(self, h: Hypothesis) -> int:
        return self.cover(h).support

    def _conjunction(self, flags: Sequence[int], seq: int) -> Hypothesis:
        return Hypothesis(seq, conj([self.base.pred, *(self.flags[i] for i in flags)]), self.base.bits | set(flags))

    def conjunctions(self, max_arity: int = 2) -> list[Hypothesis]:
        """base ∧ p1 .. pk for every choice of up to ``max_arity`` further flags, the base first."""
        rest = [i for i in range(len(self.flags)) if i not in self.base.bits]
        out = [self.base]
        for k in range(1, max_arity + 1):
            for c in combinations(rest, k):
                out.append(self._conjunction(c, len(out)))
        return out

    def generators(self, max_arity: int = 2) -> list[tuple[tuple[int, ...], Cover]]:
        """Choices of further flags that select some rows, and other rows than any part of them does; level by level.

        Every part of such a choice is one itself, so a level is built from the
        one before, and a choice with a flag that the closure of the others
        holds is left out without being counted.
        """
        rest = [i for i in range(len(self.flags)) if i not in self.base.bits]
        top = self.cover(self.base)
        if not top:
            return []
        level: dict[tuple[int, ...], Cover] = {(): top}
        out = [((), top)]
        for k in range(1, max_arity + 1):
            if k == 1:
                asked = [(i,) for i in rest if i not in top.closure]
            else:
                by_head: dict[tuple[int, ...], list[int]] = {}
                for c in level:
                    by_head.setdefault(c[:-1], []).append(c[-1])
                asked = [(*head, a, b) for head, ends in by_head.items() for a, b in combinations(sorted(ends), 2)]
                asked = [c for c in asked if all((part := c[:j] + c[j + 1 :]) in level and c[j] not in level[part].closure for j in range(k))]
            found = self._measured([self.base.bits | set(c) for c in asked])
            level = {c: x for c, x in zip(asked, found, strict=True) if x}
            out += sorted(level.items())
        return out

    def redundant(self, hyps: Sequence[Hypothesis]) -> list[tuple[Hypothesis, Hypothesis]]:
        """Pairs (redundant, kept): a conjunction that selects what a strict part of it does."""
        same: dict[Cover, list[Hypothesis]] = {}
        for h, c in zip(hyps, self.covers(hyps), strict=True):
            same.setdefault(c, []).append(h)
        out = []
        for h, c in zip(hyps, self.covers(hyps), strict=True):
            part = next((g for g in same[c] if g.bits < h.bits), None)
            if part is not None:
                out.append((h, part))
        return out

    def equivalent(self, hyps: Sequence[Hypothesis]) -> list[list[Hypothesis]]:
        """Groups of one arity that select the same rows."""
        groups: dict[tuple, list[Hypothesis]] = {}
        for h, c in zip(hyps, self.covers(hyps), strict=True):
            groups.setdefault((h.arity, c), []).append(h)
        return [g for g in groups.values() if len(g) > 1]

    def by_generality(self, hyps: Sequence[Hypothesis]) -> list[Hypothesis]:
        self.covers(hyps)
        return sorted(sorted(hyps, key=lambda h: h.label(), reverse=True), key=lambda h: -self.support(h))

    def driver(self, max_arity: int = 2) -> list[Hypothesis]:
        """Non-empty, different selections; of equal ones the smallest arity, then the first; base first."""
        rest = [i for i in range(len(self.flags)) if i not in self.base.bits]
        at = {i: k for k, i in enumerate(rest)}
        seen: dict[Cover, Hypothesis] = {}
        for c, cover in self.generators(max_arity):
            if cover not in seen:
                seen[cover] = self._conjunction(c, _place([at[i] for i in c], len(rest))) if c else self.base
        return list(seen.values())

    def register(self, hyps: Sequence[Hypothesis]) -> list[Hypothesis]:
        """One of each group of equal selections (shortest, then first label), without those strictly inside a kept one.

        Kept closures are listed by flag: one that lies in a closure is met as
        often as it has flags.
        """
        rep: dict[Cover, Hypothesis] = {}
        self.covers(hyps)
        for h in sorted(hyps, key=lambda h: (-self.support(h), len(h.label()), h.label())):
            rep.setdefault(self.cover(h), h)
        kept: list[tuple[Hypothesis, Cover]] = []
        lists: dict[int, list[int]] = {}
        bare = False  # a kept one without flags in its closure holds every other
        for c, h in rep.items():
            met: dict[int, int] = {}
            for i in c.closure:
                for k in lists.get(i, ()):
                    met[k] = met.get(k, 0) + 1
            if bare or any(n == len(kept[k][1].closure) and c < kept[k][1] for k, n in met.items()):
                continue
            for i in c.closure:
                lists.setdefault(i, []).append(len(kept))
            bare = bare or not c.closure
            kept.append((h, c))
        return [h for h, _ in kept]

    def frame(self, df: DataFrame, hyps: Sequence[Hypothesis]) -> DataFrame:
        return df.sparkSession.createDataFrame([(h.seq, h.label(), h.arity, self.support(h)) for h in hyps], "hyp_id int, hypothesis string, arity int, support long")

    def roll_up(self, per_signature: DataFrame, hyps: Sequence[Hypothesis]) -> DataFrame:
        """Rows of (sig, ...) once for each hypothesis that holds there; no join, the hypotheses are conditions on the signature."""
        tests = [F.struct(F.lit(i).alias("hyp"), F.lit(h.label()).alias("hypothesis"), _test(h).alias("ok")) for i, h in enumerate(hyps)]
        rows = per_signature.withColumn("_h", F.explode(F.filter(F.array(*tests), lambda x: x["ok"])))
        return rows.withColumns({"hyp": F.col("_h.hyp"), "hypothesis": F.col("_h.hypothesis")}).drop("_h")


def _place(choice: Sequence[int], n: int) -> int:
    """The place of a choice of 0 .. n - 1, in order, among all choices by size and then by order; the empty one is 0."""
    k, out, last = len(choice), 0, -1
    for j, c in enumerate(choice):
        out += sum(comb(n - x - 1, k - j - 1) for x in range(last + 1, c))
        last = c
    return out + sum(comb(n, j) for j in range(k))


def _test(h: Hypothesis) -> Column:
    out = F.lit(True)
    for i in sorted(h.bits):
        out = out & (F.substring("sig", i + 1, 1) == "1")
    return out
