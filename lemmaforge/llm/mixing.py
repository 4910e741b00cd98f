"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Each document has a size in words and belongs to a shard of its source (a
   hash of its id; the number of shards follows the number of documents, so a
   cell (source, shard) stays bounded however large a source is).
2. Targets: the budget is shared over the sources by weight; no target exceeds
   ``repeats`` times its source's size, and what is above goes to the others
   by weight until none is above.
3. A block is ``block`` consecutive words of a cell's stream, the cell's
   documents one after another in seeded order.  Blocks go to the sources by
   the highest quotients target / (2 n + 1), then within each source to its
   groups of shards and within a group to its shards by the highest quotients
   of their sizes: integer quotas.
4. A cell with B blocks and quota q takes every block q // B times, and q % B
   blocks once more: block j is drawn if (a j + c) mod B < q % B, for a seeded
   a without common divisor with B and a seeded c, a permutation of the blocks.

``plan`` shuffles ids, sources and sizes, never texts; ``mixture`` sends each
row once to its cell.  One row per source and per GROUP_CELLS cells comes to the
driver (the weights are given per source there as well).

Defined results: null text has size 0; a null source is a source of its own
and the last in order; repeated rows (equal in every column) count each; empty
tables give empty results; other columns are ignored by ``plan`` and kept by
``mixture``, whatever their names.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that a cell holds about.
CELL_ROWS = 2_000
#: Cells that one task deals blocks to.
GROUP_CELLS = 1_000
#: Sources up to which their table is broadcast; beyond, rows and sources are joined by shuffles.
MOST_BROADCAST = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_shares(sizes: Sequence[int], weights: Sequence[float], budget: float, repeats: float) -> list[float]:
    """Targets by weight, none above ``repeats`` times its size."""
    target = [0.0] * len(sizes)
    open_, left = [i for i in range(len(sizes))], float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / total > repeats * sizes[i]]
        if not above:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in above:
            target[i] = float(repeats * sizes[i])
        left -= sum(target[i] for i in above)
        gone = set(above)
        open_ = [i for i in open_ if i not in gone]
    return target


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2 n + 1); ties go to the earlier entry; ``most`` limits an entry.

    A bisection finds a divisor just above the last seat's quotient, so the
    loop over single seats is left with a few.
    """
    v = np.asarray(votes, float)
    limit = np.full(len(v), seats, np.int64) if most is None else np.asarray(most, np.int64)
    limit = np.where(v > 0, limit, 0)
    seats = int(min(seats, limit.sum()))
    if seats <= 0:
        return [0] * len(v)
    give = lambda d: np.minimum(np.floor(v / d / 2 + 0.5).astype(np.int64), limit)  # noqa: E731  seats with a quotient of d at least
    lo, hi = v[v > 0].min() / (2.0 * seats + 2) / 2, v.max() * 2 + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if give(mid).sum() >= seats:
            lo = mid
        else:
            hi = mid
    got = give(hi)
    quotients = sorted((-v[i] / (2 * int(got[i]) + 1), i) for i in range(len(v)) if got[i] < limit[i])
    while got.sum() < seats:
        _, i = quotients.pop(0)
        got[i] += 1
        if got[i] < limit[i]:
            bisect.insort(quotients, (-v[i] / (2 * int(got[i]) + 1), i))
    return [int(x) for x in got]


def _sized(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """doc_id, source, size, tie (a hash of the whole row), and ``more``."""
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), *hashed).alias("tie"), *more)


def _quotas(sized: DataFrame, weights: Sequence[float], budget: Fraction, repeats: int, seed: int, block: int | None) -> tuple[DataFrame, DataFrame, int]:
    """Sources (key, source_size, target, shards, first_cell), cells (cell, words, blocks, q, factor, shift), and the block size."""
    spark = sized.sparkSession
    totals = sorted(sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"] or 0) for r in totals]
    target = capped_shares(sizes, [weights[i % len(weights)] for i in range(len(totals))], float(budget * sum(sizes)), repeats)
    shards = [max(1, -(-int(r["rows"]) // CELL_ROWS)) for r in totals]
    if block is None:
        block = max(1, int(min((t / (1000 * s) for t, s in zip(target, shards, strict=True) if t > 0), default=1)))
    # a source may have no more blocks than its cells have, repeated
    quota = sainte_lague(target, round(sum(target) / block), [repeats * -(-n // block) for n in sizes])
    # a source's cells are numbered from a multiple of GROUP_CELLS on
    groups = np.cumsum([0, *(-(-n // GROUP_CELLS) for n in shards)])
    sources = spark.createDataFrame([(r["source"], n, t, c, int(g) * GROUP_CELLS) for r, n, t, c, g in zip(totals, sizes, target, shards, groups, strict=False)], "key string, source_size long, target double, shards long, first_cell long")
    if len(totals) <= MOST_BROADCAST:
        sources = F.broadcast(sources)
    cells = store.keep(_in_cells(sized, sources, seed).groupBy("cell").agg(F.sum("size").alias("words")), "mix-cells", small=True)
    group = F.expr(f"cell div {GROUP_CELLS}")
    words = {r["g"]: int(r["n"]) for r in cells.groupBy(group.alias("g")).agg(F.sum("words").alias("n")).collect()}
    seats: dict[int, int] = {}
    for i, q in enumerate(quota):
        mine = range(int(groups[i]), int(groups[i + 1]))
        have = [words.get(g, 0) for g in mine]
        # a cell's last block may be short, so that a group may have a block more for each of its cells
        most = [repeats * (-(-n // block) + (GROUP_CELLS if len(mine) > 1 else 0)) for n in have]
        seats |= dict(zip(mine, sainte_lague(have, q, most), strict=True))
    given = spark.createDataFrame([(g, n) for g, n in seats.items()], "g long, seats long")

    def deal(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("cell")
        blocks = (-(-one["words"] // block)).astype("int64")
        q = sainte_lague(one["words"].tolist(), int(one["seats"].iloc[0]), (repeats * blocks).tolist())
        factor, shift = [], []
        for cell, n in zip(one["cell"], blocks, strict=True):
            rng = np.random.default_rng([seed, int(cell)])
            a = 1
            while n > 2:
                a = int(rng.integers(1, n))
                if math.gcd(a, int(n)) == 1:
                    break
            factor.append(a)
            shift.append(int(rng.integers(0, n)) if n else 0)
        return pd.DataFrame({"cell": one["cell"], "words": one["words"], "blocks": blocks, "q": q, "factor": factor, "shift": shift})

    cells = cells.withColumn("g", group).join(given, "g").groupBy("g").applyInPandas(deal, "cell long, words long, blocks long, q long, factor long, shift long")
    return sources, store.keep(cells, "mix-quotas", small=True), block


def _in_cells(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """``rows`` with source_size, target and cell."""
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("key"))).drop("key")
    return rows.withColumn("cell", F.col("first_cell") + F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tie"), F.col("shards"))).drop("first_cell", "shards")


def _taken(rows: DataFrame, cells: DataFrame, block: int, seed: int) -> DataFrame:
    """``rows`` (in cells) with ``whole``, how often the whole document is taken, ``pieces``, its further word ranges (from, to), and ``taken``."""
    rows = rows.join(cells, "cell")
    order = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "tie"), "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    col, b = F.col, F.lit(block).cast("long")
    rows = rows.withColumn("to", F.sum("size").over(order)).withColumn("from", col("to") - col("size"))
    rows = rows.withColumn("whole", F.when(col("blocks") > 0, F.expr("q div blocks")).otherwise(0)).withColumn("extra", F.when(col("blocks") > 0, F.expr("q % blocks")).otherwise(0))
    low, high = F.expr(f"`from` div {block}"), F.expr(f"(`to` - 1) div {block}")
    drawn = lambda j: F.pmod(j * col("factor") + col("shift"), col("blocks")) < col("extra")
    some = (col("size") > 0) & (col("extra") > 0)
    edges = lambda step, last: F.filter(F.sequence(low, high), lambda j: drawn(j) & ((j == last) | ~drawn(j + step)))
    piece = lambda i, j: F.struct((F.greatest(i * b, col("from")) - col("from")).alias("from"), (F.least((j + 1) * b, col("to")) - col("from")).alias("to"))
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    rows = rows.withColumn("pieces", F.when(some, F.zip_with(edges(-1, low), edges(1, high), piece)).otherwise(none))
    length = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    return rows.withColumn("taken", col("whole") * col("size") + length)


def plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: Fraction = Fraction(3, 2), repeats: int = 2, seed: int = 17, block: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, taken, and the parts taken.

    ``whole`` is how often the whole document is taken; ``pieces`` are structs
    (from, to) of further word ranges.  Weights are dealt to the sources by code
    point, repeating.  ``block`` defaults to the size that keeps rounding below
    a thousandth of the least target.
    """
    sized = store.keep(_sized(docs, seed), "mix-sizes")
    sources, cells, block = _quotas(sized, weights, budget, repeats, seed, block)
    rows = _taken(_in_cells(sized, sources, seed), cells, block, seed)
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "whole", "pieces")


def mixture(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: Fraction = Fraction(3, 2), repeats: int = 2, seed: int = 17, block: int | None = None) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, a row for each time that a document, or a range of its words, is taken.

    A whole document keeps its text as it is; a range is the text from its
    first to its last word.  ``n_chars``, where there is one, follows the text.
    Documents not taken, and those without words, are gone.  ``docs`` is read
    twice; each row is shuffled once, to its cell, and needs no join by id.
    """
    sized = store.keep(_sized(docs, seed).select("doc_id", "source", "size", "tie"), "mix-sizes")
    sources, cells, block = _quotas(sized, weights, budget, repeats, seed, block)
    rows = _sized(docs, seed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).filter("size > 0")
    # rows without words take no place in a cell's stream
    rows = _taken(_in_cells(rows, sources, seed), cells, block, seed).filter("taken > 0")
    text = F.col("doc.text")
    cut = lambda w: F.transform("pieces", lambda x: F.regexp_replace(F.array_join(F.slice(w, (x["from"] + 1).cast("int"), (x["to"] - x["from"]).cast("int")), ""), r"^[\x20\x09-\x0D]+", ""))
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    parts = F.when(F.size("pieces") > 0, F.element_at(F.transform(F.array(words), cut), 1)).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc", F.explode(F.concat(F.array_repeat(text, F.col("whole").cast("int")), parts)).alias("part"))
    changed = {"text": F.col("part")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length("part").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("doc").getField(c).alias(c) for c in docs.columns])
