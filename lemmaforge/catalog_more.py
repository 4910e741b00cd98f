"""Queries over the smaller parts of the engine: forms, predicates, quantifiers, filters, sources and sinks."""

from __future__ import annotations

import uuid
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import relation
from .expr import Col, Const, Linear, Log, Un, resolve
from .export import text
from .operators import filters, lattice
from .plans.session import Session
from .pred import TRUE, Compare, Flag, Not, all_finite, batch_where, disj, is_finite, is_nan, row_where, some_divergent
from .relation import All, Any_, Statement
from .sources import tables
from .streaming import monitor

Rows = DataFrame


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under the session's shared one; the warehouse's where none is named."""
    place = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{place.rstrip('/')}/scratch-{uuid.uuid4().hex}"


_S, _P = Col("p_size"), Col("p_retailprice")
_FORMS = {
    "power": (_S**3, "pow(p_size, 3)"),
    "inverse_power": (_S ** Const(-1), "1.0 / p_size"),
    "raised": (Un("ceil", _P / 7), "ceil(p_retailprice / 7)"),
    "grown": (Un("exp", _S / 50), "exp(p_size / 50.0)"),
    "turned": (-_P, "-p_retailprice"),
    "clamped": (Log(_S - 25, 2, 1e-6), "ln(greatest(p_size - 25, 1e-6)) / ln(2)"),
    "natural": (Log(_P), "ln(p_retailprice)"),
    "no_base": (Log(_P, 1), "NULL"),
    "gap": (resolve("abs_p_size_minus_p_retailprice", ["p_size", "p_retailprice"]), "abs(p_size - p_retailprice)"),
    "least_of": (resolve("min(p_size, p_retailprice)", ["p_size", "p_retailprice"]), "least(p_size, p_retailprice)"),
    "largest_of": (resolve("max(p_size, p_retailprice)", ["p_size", "p_retailprice"]), "greatest(p_size, p_retailprice)"),
    "missing_root": (Un("sqrt", _S - 25), "CASE WHEN p_size >= 25 THEN sqrt(p_size - 25) END"),
    "lenient": (Linear(Fraction(1), ((Fraction(2), Un("sqrt", _S - 25)), (Fraction(3), _S)), True), "1 + 3 * p_size + coalesce(2 * CASE WHEN p_size >= 25 THEN sqrt(p_size - 25) END, 0)"),
    "strict": (Linear(Fraction(1), ((Fraction(2), Un("sqrt", _S - 25)), (Fraction(3), _S))), "1 + 3 * p_size + 2 * CASE WHEN p_size >= 25 THEN sqrt(p_size - 25) END"),
}


def further_forms(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", *[F.round(e.column().cast("double"), 4).alias(n) for n, (e, _) in _FORMS.items()])


FORMS_SQL = "SELECT p_partkey, " + ", ".join(f"round(CAST({s} AS DOUBLE), 4) AS {n}" for n, (_, s) in _FORMS.items()) + " FROM part"

_SMALL, _DEAR = Compare("<", _S, Const(10)), Compare(">", _P, Const(950))
_ROOT = Un("sqrt", _S - 25)
_PREDS = {
    "xor": (_SMALL ^ _DEAR, "(p_size < 10) <> (p_retailprice > 950)"),
    "implied": (_SMALL >> _DEAR, "NOT (p_size < 10) OR p_retailprice > 950"),
    "negated": (~Compare("<=", _S, Const(20)), "p_size > 20"),
    "negated_missing": (~Compare("<=", _ROOT, Const(2)), "coalesce(sqrt(CASE WHEN p_size >= 25 THEN p_size - 25 END) > 2, FALSE)"),
    "missing": (is_nan(_ROOT), "p_size < 25"),
    "whole_finite": (is_finite(_ROOT), "p_size >= 25"),
    "all_finite": (all_finite(_ROOT), "p_size >= 25"),
    "some_divergent": (some_divergent(_ROOT), "p_size < 25"),
    "by_batch": (batch_where("by_batch", lambda f: f["p_size"] % 3 == 0, ["p_size"]), "p_size % 3 = 0"),
    "by_row": (row_where("by_row", lambda r: r["p_size"] > 40, ["p_size"]), "p_size > 40"),
    "number_flag": (Flag("zero_or_size", "number"), "p_size % 2 <> 0"),
    "text_flag": (Flag("empty_or_brand", "string"), "p_size % 5 <> 0"),
    "nested": (Not(disj([_SMALL, ~_DEAR])), "NOT (p_size < 10 OR p_retailprice <= 950)"),
    "unequal": (Compare("!=", _S, Const(7)), "p_size <> 7"),
    "all_of": (All((Compare(">=", _S, Const(5)), Compare("<=", _S, Const(30)))), "p_size >= 5 AND p_size <= 30"),
    "any_of": (Any_((Compare("<=", _S, Const(5)), Compare(">=", _S, Const(30)))), "p_size <= 5 OR p_size >= 30"),
}


def further_predicates(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "part").withColumns({"zero_or_size": F.when(F.col("p_size") % 2 == 0, 0).otherwise(F.col("p_size")), "empty_or_brand": F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_brand"))})
    return df.select("p_partkey", *[p.column().alias(n) for n, (p, _) in _PREDS.items()])


PREDS_SQL = "SELECT p_partkey, " + ", ".join(f"({s}) AS {n}" for n, (_, s) in _PREDS.items()) + " FROM part"


def predicate_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The SQL text of predicates and forms, run as SQL: rows of each."""
    df = read(spark, sf, "part")
    kept = {n: p for n, (p, _) in _PREDS.items() if n not in ("by_batch", "by_row", "number_flag", "text_flag")}
    row = spark.sql(f"SELECT {', '.join(f'count_if({p.sql()}) AS {n}' for n, p in kept.items())} FROM {{d}}", d=df).first()
    return spark.createDataFrame([(n, row[n]) for n in kept], "name string, rows long")


TEXTS_SQL = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER ({s}) AS rows FROM part" for n, (_, s) in _PREDS.items() if n not in ("by_batch", "by_row", "number_flag", "text_flag"))


def coerced_values(spark: SparkSession, sf: str) -> DataFrame:
    """Texts and booleans as numbers, wherever they read as such."""
    df = read(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("t"), (F.col("p_size") > 9).alias("b"))
    session = Session(df, exclude=("p_partkey",))
    from .functions import numeric as nf

    session.convert_columns({"t": nf.number, "b": nf.number})
    return session.df


COERCED_SQL = "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS t, CASE WHEN p_size > 9 THEN 1.0 ELSE 0.0 END AS b FROM part"


def quantified(spark: SparkSession, sf: str) -> DataFrame:
    """For all, exists, and the number of witnesses."""
    df = read(spark, sf, "part")
    preds = {"positive": Compare(">", _S, Const(0)), "small": _SMALL, "huge": Compare(">", _S, Const(10_000))}
    return spark.createDataFrame([(n, relation.for_all(df, p), relation.exists(df, p), relation.witnesses(df, p).count()) for n, p in preds.items()], "name string, for_all boolean, some boolean, rows long")


QUANTIFIED_SQL = " UNION ALL ".join(f"SELECT '{n}' AS name, bool_and({c}) AS for_all, bool_or({c}) AS some, count(*) FILTER ({c}) AS rows FROM part" for n, c in (("positive", "p_size > 0"), ("small", "p_size < 10"), ("huge", "p_size > 10000")))

#: Bounds on a part's size: (hypothesis, its SQL, side, number).
_BOUNDS = [("TRUE", "TRUE", "<=", 50), ("dear", "p_retailprice > 950", "<=", 50), ("TRUE", "TRUE", ">=", 1), ("dear", "p_retailprice > 950", "<=", 40), ("odd", "p_size % 2 = 1", "<=", 49), ("TRUE", "TRUE", "<=", 50), ("odd", "p_size % 2 = 1", "<=", 50), ("odd", "p_size % 2 = 1", ">=", 1)]


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, list[Statement]]:
    df = read(spark, sf, "part").withColumns({"dear": F.col("p_retailprice") > 950, "odd": F.col("p_size") % 2 == 1})
    return df, [Statement(TRUE if h == "TRUE" else Flag(h), Compare(op, _S, Const(v)), name=str(i)) for i, (h, _, op, v) in enumerate(_BOUNDS)]


def ranked_statements(spark: SparkSession, sf: str) -> DataFrame:
    """Different statements with a touch, by touches, then support; their accuracy and place."""
    df, made = _parts(spark, sf)
    kept = filters.ranked(df, filters.unique(made), "touch", 1)
    return spark.createDataFrame([(i, m["touch"], m["support"], round(m["accuracy"], 6)) for i, (_, m) in enumerate(kept)], "place int, touch long, support long, accuracy double")


_ONCE = [b for i, b in enumerate(_BOUNDS) if b not in _BOUNDS[:i]]
RANKED_SQL = "WITH m AS (" + " UNION ALL ".join(f"SELECT {i} AS seq, count(*) FILTER ({c} AND p_size = {v}) AS touch, count(*) FILTER ({c}) AS support, round(count(*) FILTER ({c} AND p_size {op} {v}) / count(*) FILTER ({c}), 6) AS accuracy FROM part" for i, (_, c, op, v) in enumerate(_ONCE)) + ") SELECT CAST(row_number() OVER (ORDER BY touch DESC, support DESC, seq) - 1 AS INTEGER) AS place, touch, support, accuracy FROM m WHERE touch >= 1"


def accepted_by_generality(spark: SparkSession, sf: str) -> DataFrame:
    """One after another: statements that no accepted one of the same conclusion and a larger hypothesis makes needless; as a batch as well."""
    df, made = _parts(spark, sf)
    kept: list[Statement] = []
    for s in filters.unique(made):
        if filters.morgan_accept(df, s, kept):
            kept.append(s)
    batch = {s.name for s in filters.morgan(df, filters.unique(made))}
    return spark.createDataFrame([(int(s.name), s.name in batch) for s in kept], "seq int, in_batch boolean")


_SEQ = [i for i, b in enumerate(_BOUNDS) if b not in _BOUNDS[:i]]
# an accepted statement counts whatever was accepted after it; TRUE strictly holds every other hypothesis here
GENERALITY_SQL = "WITH n AS (SELECT count(*) AS n, count(*) FILTER (p_retailprice > 950) AS dear, count(*) FILTER (p_size % 2 = 1) AS odd FROM part) SELECT seq, seq NOT IN (SELECT s.seq FROM s s JOIN s g ON s.c = g.c AND g.h = 'TRUE' AND s.h <> 'TRUE', n WHERE CASE s.h WHEN 'dear' THEN dear ELSE odd END < n.n) AS in_batch FROM s WHERE NOT EXISTS (SELECT 1 FROM s g, n WHERE g.seq < s.seq AND g.c = s.c AND g.h = 'TRUE' AND s.h <> 'TRUE' AND CASE s.h WHEN 'dear' THEN dear ELSE odd END < n.n)"
GENERALITY_SQL = GENERALITY_SQL.replace("WITH n AS", "WITH s AS (" + " UNION ALL ".join(f"SELECT {i} AS seq, '{_BOUNDS[i][0]}' AS h, '{_BOUNDS[i][2]}{_BOUNDS[i][3]}' AS c" for i in _SEQ) + "), n AS")


def accepted_by_significance(spark: SparkSession, sf: str) -> DataFrame:
    """One after another: true bounds that are sharper somewhere than those accepted before for the same rows and side."""
    df, made = _parts(spark, sf)
    kept: list[Statement] = []
    for s in made:
        if filters.dalmatian_accept(df, s, kept):
            kept.append(s)
    return spark.createDataFrame([(int(s.name),) for s in kept], "seq int")


SIGNIFICANCE_SQL = "WITH s AS (" + " UNION ALL ".join(f"SELECT {i} AS seq, '{h}{op}' AS g, {v if op == '<=' else -v} AS v, bool_and(NOT ({c}) OR p_size {op} {v}) AND count(*) FILTER ({c}) > 0 AS holds FROM part" for i, (h, c, op, v) in enumerate(_BOUNDS)) + ") SELECT CAST(seq AS INTEGER) AS seq FROM s WHERE holds AND NOT EXISTS (SELECT 1 FROM s p WHERE p.seq < s.seq AND p.g = s.g AND p.holds AND p.v <= s.v)"


def contrapositives(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each turned statement's hypothesis and its violations."""
    df, made = _parts(spark, sf)
    found = relation.evaluate(df, filters.contrapositives(filters.unique(made)))
    return spark.createDataFrame([(i, m["support"], m["violations"]) for i, m in found.items()], "seq int, support long, violations long")


CONTRAPOSITIVES_SQL = " UNION ALL ".join(f"SELECT {i} AS seq, count(*) FILTER (NOT (p_size {op} {v})) AS support, count(*) FILTER (NOT (p_size {op} {v}) AND ({c})) AS violations FROM part" for i, (_, c, op, v) in enumerate(_ONCE))


def pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Statements by what their hypotheses select, the sharper of two bounds of one side."""
    df, made = _parts(spark, sf)
    found = filters.merged_by_hypothesis(df, [*made, Statement(Flag("odd"), Compare("<=", _S, Linear(Fraction(2), ((Fraction(1), _S),)))), Statement(Flag("odd"), Compare("<=", _S, Linear(Fraction(1), ((Fraction(1), _S),))))])
    return spark.createDataFrame([(h.label(), len(kept)) for h, kept in found], "hypothesis string, kept int")


PRUNED_SQL = "SELECT h AS hypothesis, CAST(count(DISTINCT c) + max(extra) AS INTEGER) AS kept FROM (" + " UNION ALL ".join(f"SELECT '{h}' AS h, '{op}{v}' AS c, {int(h == 'odd')} AS extra" for h, _, op, v in _BOUNDS) + ") GROUP BY h"


def sources_and_sinks(spark: SparkSession, sf: str) -> DataFrame:
    """All parts by CSV with and without a schema, their prices by size from memory, and all through a session that got a row more and was reset."""
    df = read(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    path = scratch(spark)
    df.write.option("header", True).csv(path)
    sizes = df.groupBy("p_size").agg(F.sum("p_retailprice").alias("p_retailprice")).toPandas()  # fifty sizes
    memory = tables.memory_table(spark, {c: sizes[c].tolist() for c in sizes})
    session = Session(df)
    session.append_row({"p_partkey": -1, "p_size": 1, "p_retailprice": 2.0})
    rows = [("csv", tables.csv_table(spark, path)), ("csv with schema", tables.csv_table(spark, path, "p_partkey long, p_size int, p_retailprice double")), ("memory", memory), ("appended", session.df)]
    session.reset()
    rows.append(("reset", session.df))
    out = None
    for name, d in rows:
        one = d.agg(F.lit(name).alias("source"), F.count("*").alias("rows"), F.sum("p_size").cast("long").alias("sizes"), F.round(F.sum("p_retailprice"), 4).alias("prices"))
        out = one if out is None else out.unionByName(one)
    return out


_SIZES = "(SELECT p_size, sum(p_retailprice) AS p_retailprice FROM part GROUP BY p_size)"
SOURCES_SQL = " UNION ALL ".join(f"SELECT '{n}' AS source, count(*) + {k} AS rows, CAST(sum(p_size) + {k} AS BIGINT) AS sizes, round(sum(p_retailprice) + {2 * k}, 4) AS prices FROM {t}" for n, t, k in (("csv", "part", 0), ("csv with schema", "part", 0), ("memory", _SIZES, 0), ("appended", "part", 1), ("reset", "part", 0)))


def edge_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of orders to suppliers in text files, a graph for each return flag in as many as there are tasks, read back."""
    path = scratch(spark)
    lines = read(spark, sf, "lineitem").select("l_returnflag", F.concat_ws("  ", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("value"))
    for flag in ("A", "N", "R"):
        lines.filter(F.col("l_returnflag") == flag).select("value").unionByName(spark.createDataFrame([("",)], "value string")).write.text(f"{path}/{flag}.txt")
    found = tables.edge_lists(spark, path)
    return found.agg(F.count_distinct("graph").alias("graphs"), F.count("*").alias("edges"), F.sum("src").alias("sources"), F.sum("dst").alias("targets"))


EDGES_SQL = "SELECT count(DISTINCT l_returnflag) AS graphs, count(*) AS edges, CAST(sum(l_orderkey) AS BIGINT) AS sources, CAST(sum(l_suppkey) AS BIGINT) AS targets FROM lineitem"


def written_statements(spark: SparkSession, sf: str) -> DataFrame:
    """Statements written as JSON and as CSV, read back."""
    df, made = _parts(spark, sf)
    out = None
    for kind in ("json", "csv"):
        path = scratch(spark)
        tables.write_statements(df, filters.unique(made), path, kind)
        back = (spark.read.json(path) if kind == "json" else spark.read.option("header", True).csv(path)).select(F.lit(kind).alias("kind"), "hypothesis", F.round(F.col("accuracy").cast("double"), 6).alias("accuracy"))
        out = back if out is None else out.unionByName(back)
    return out


WRITTEN_SQL = " UNION ALL ".join(f"SELECT '{kind}' AS kind, '{h}' AS hypothesis, round(count(*) FILTER ({c} AND p_size {op} {v}) / count(*) FILTER ({c}), 6) AS accuracy FROM part" for kind in ("json", "csv") for h, c, op, v in _ONCE)


def running_extrema(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.running_extrema(read(spark, sf, "lineitem"), "l_returnflag", "l_quantity")


EXTREMA_SQL = "SELECT l_returnflag, count(l_quantity) AS n, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1"


def negated_hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """Supports of flags, their negations, and hypotheses in order of generality."""
    df, _ = _parts(spark, sf)
    flags = [Flag("dear"), Flag("odd")]
    found = lattice.Lattice(df, [*flags, *(Not(f) for f in flags)])
    hyps = found.by_generality(found.conjunctions(1)[1:])
    return spark.createDataFrame([(i, found.support(h)) for i, h in enumerate(hyps)], "place int, support long")


NEGATED_SQL = "WITH n AS (" + " UNION ALL ".join(f"SELECT count(*) FILTER ({c}) AS support FROM part" for c in ("p_retailprice > 950", "p_size % 2 = 1", "NOT p_retailprice > 950", "NOT p_size % 2 = 1")) + ") SELECT CAST(row_number() OVER (ORDER BY support DESC) - 1 AS INTEGER) AS place, support FROM n WHERE support < (SELECT count(*) FROM part)"


def lean_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Theorem stubs of the true bounds: parts of their text."""
    df, made = _parts(spark, sf)
    rows = []
    for s in filters.unique(made):
        if relation.evaluate(df, [s])[0]["violations"] == 0:
            stub = text.lean(s, f"t{s.name}", df.columns)
            rows.append((int(s.name), "≤" if "≤" in stub else "≥", stub.startswith(f"theorem t{s.name}") and stub.endswith("sorry"), stub.count("(h")))
    return spark.createDataFrame(rows, "seq int, side string, whole boolean, given int")


LEAN_SQL = " UNION ALL ".join(f"SELECT {i} AS seq, '{'≤' if _BOUNDS[i][2] == '<=' else '≥'}' AS side, TRUE AS whole, {int(_BOUNDS[i][0] != 'TRUE')} AS given FROM part HAVING bool_and(NOT ({_BOUNDS[i][1]}) OR p_size {_BOUNDS[i][2]} {_BOUNDS[i][3]})" for i in _SEQ)


def from_pandas(spark: SparkSession, sf: str) -> DataFrame:
    """A pandas frame as a table, with the flags that a session finds in it."""
    frame = pd.DataFrame([(r["n_nationkey"], r["n_regionkey"], int(r["n_regionkey"] > 1)) for r in read(spark, sf, "nation").collect()], columns=["k", "r", "far"])
    session = Session(tables.memory_table(spark, frame))
    return spark.createDataFrame([(f.name, session.lattice.support(lattice.Hypothesis(0, f, frozenset({i})))) for i, f in enumerate(session.lattice.flags)], "flag string, support long")


PANDAS_SQL = "SELECT 'far' AS flag, count(*) FILTER (n_regionkey > 1) AS support FROM nation"

_ALL = [
    (further_forms, FORMS_SQL), (further_predicates, PREDS_SQL), (predicate_texts, TEXTS_SQL), (coerced_values, COERCED_SQL), (quantified, QUANTIFIED_SQL), (ranked_statements, RANKED_SQL), (accepted_by_generality, GENERALITY_SQL),
    (accepted_by_significance, SIGNIFICANCE_SQL), (contrapositives, CONTRAPOSITIVES_SQL), (pruned, PRUNED_SQL), (sources_and_sinks, SOURCES_SQL), (edge_lists, EDGES_SQL), (written_statements, WRITTEN_SQL), (running_extrema, EXTREMA_SQL),
    (negated_hypotheses, NEGATED_SQL), (lean_texts, LEAN_SQL), (from_pandas, PANDAS_SQL),
]
QUERIES = {f.__name__: f for f, _ in _ALL}
SQL = {f.__name__: sql for f, sql in _ALL}
