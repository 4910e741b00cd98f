"""The registered queries of the core engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from fractions import Fraction
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_fits, catalog_live, catalog_more, relation
from .export import text as export
from .expr import Bin, Col, Const, Linear, Log, Un, max_, min_
from .functions import numeric as nf
from .operators import bounds, filters, fits, lattice, statistics, sufficient
from .plans.session import Session, Stage, necessary_bounds, sufficient_conditions
from .pred import TRUE, Between, Compare, Flag, In, Not, conj, disj, is_int
from .relation import Equivalence, Inclusion, Statement
from .sources import tables
from .streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return put


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_objects(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order with lines: invariants and properties.  Sums do not depend on the order of lines, so every pass has the same ones."""
    lines = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n_lines"), nf.steady_sum(F.col("l_quantity")).alias("qty"), nf.steady_sum(F.col("l_extendedprice")).alias("gross"), F.max("l_linenumber").cast("long").alias("max_line"), F.max((F.col("l_returnflag") == "R")).alias("has_return")
    )
    orders = read(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("t"), (F.col("o_orderstatus") == "F").alias("is_final"), (F.col("o_orderpriority") == "1-URGENT").alias("is_urgent"))
    return orders.join(lines, "o_orderkey").withColumns({"single_line": F.col("n_lines") == 1, "always": F.lit(True)})


OBJ = """obj AS (
  SELECT o.o_orderkey, o.o_totalprice AS t, o.o_orderstatus = 'F' AS is_final, o.o_orderpriority = '1-URGENT' AS is_urgent,
         count(*) AS n_lines, sum(l.l_quantity) AS qty, sum(l.l_extendedprice) AS gross, CAST(max(l.l_linenumber) AS BIGINT) AS max_line,
         max(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 AS has_return, count(*) = 1 AS single_line, TRUE AS always
  FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
  GROUP BY o.o_orderkey, o.o_totalprice, o.o_orderstatus, o.o_orderpriority)"""

_FLAGS = [Flag("has_return"), Flag("is_final")]
_HYP = """hyp AS (SELECT 'TRUE' AS hypothesis, * FROM obj UNION ALL SELECT 'has_return', * FROM obj WHERE has_return
  UNION ALL SELECT 'is_final', * FROM obj WHERE is_final UNION ALL SELECT '(has_return ∧ is_final)', * FROM obj WHERE has_return AND is_final)"""
_FEATURES = {n: Col(n) for n in ("n_lines", "qty", "gross")}
_LONG = "lng AS (" + " UNION ALL ".join(f"SELECT hypothesis, t, '{n}' AS feature, CAST({n} AS DOUBLE) AS x FROM hyp" for n in _FEATURES) + ")"


def _lattice(df: DataFrame) -> tuple[lattice.Lattice, list[lattice.Hypothesis]]:
    found = lattice.Lattice(df, _FLAGS)
    return found, found.conjunctions(2)


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(f"""WITH {OBJ}, {_HYP}, {_LONG},
bnd AS (SELECT hypothesis, feature, count(*) AS support, min(t / x) AS cmin, max(t / x) AS cmax FROM lng WHERE x <> 0 GROUP BY ALL)
SELECT b.hypothesis, b.feature, b.support, round(b.cmin, 6) AS cmin, round(b.cmax, 6) AS cmax,
       CAST(sum(CASE WHEN l.t / l.x = b.cmin THEN 1 ELSE 0 END) AS BIGINT) AS touch_lower, CAST(sum(CASE WHEN l.t / l.x = b.cmax THEN 1 ELSE 0 END) AS BIGINT) AS touch_upper
FROM bnd b JOIN lng l USING (hypothesis, feature) WHERE l.x <> 0 GROUP BY b.hypothesis, b.feature, b.support, b.cmin, b.cmax""")
def ratio_bounds_slice(spark: SparkSession, sf: str) -> DataFrame:
    df = order_objects(spark, sf)
    found, hyps = _lattice(df)
    return _round(bounds.ratio_touches(df, found, hyps, Col("t"), _FEATURES), "cmin", "cmax")


@query(f"""WITH {OBJ}, {_HYP}, {_LONG} SELECT hypothesis, feature, count(*) AS support, round(min(t / x), 6) AS cmin, round(max(t / x), 6) AS cmax FROM lng WHERE x <> 0 GROUP BY ALL""")
def ratio_bounds(spark: SparkSession, sf: str) -> DataFrame:
    df = order_objects(spark, sf)
    found, hyps = _lattice(df)
    return _round(bounds.ratio_bounds(df, found, hyps, Col("t"), _FEATURES), "cmin", "cmax")


@query(f"""WITH {OBJ}, {_HYP}, {_LONG} SELECT hypothesis, feature, count(x) AS support, CAST(floor(min(x)) AS BIGINT) AS low, CAST(ceil(max(x)) AS BIGINT) AS high FROM lng WHERE feature <> 'gross' GROUP BY ALL""")
def constant_bounds(spark: SparkSession, sf: str) -> DataFrame:
    df = order_objects(spark, sf)
    found, hyps = _lattice(df)
    return bounds.constant_bounds(df, found, hyps, {n: Col(n) for n in ("n_lines", "qty")})


@query("""WITH l AS (SELECT CAST(l_linenumber AS DOUBLE) AS line, l_quantity AS quantity, round(l_discount * 100) AS percent FROM lineitem),
p AS (SELECT 'line' AS num, 'quantity' AS den, line / quantity AS r FROM l WHERE quantity > 0 UNION ALL SELECT 'quantity', 'line', quantity / line FROM l WHERE line > 0
  UNION ALL SELECT 'line', 'percent', line / percent FROM l WHERE percent > 0 UNION ALL SELECT 'percent', 'line', percent / line FROM l WHERE line > 0
  UNION ALL SELECT 'quantity', 'percent', quantity / percent FROM l WHERE percent > 0 UNION ALL SELECT 'percent', 'quantity', percent / quantity FROM l WHERE quantity > 0),
b AS (SELECT num, den, count(*) AS support, min(r) AS cmin, max(r) AS cmax FROM p GROUP BY ALL)
SELECT num, den, support, round(cmin, 6) AS cmin, round(cmax, 6) AS cmax, count(*) FILTER (r = cmin) AS touch_min, count(*) FILTER (r = cmax) AS touch_max,
       round(count(*) FILTER (r = cmin) / support, 6) AS rate_min, round(count(*) FILTER (r = cmax) / support, 6) AS rate_max
FROM b JOIN p USING (num, den) GROUP BY num, den, support, cmin, cmax""")
def ratio_touch_rates(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "lineitem").select(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.round(F.col("l_discount") * 100).alias("percent"))
    return _round(statistics.ratio_table(df, {n: Col(n) for n in df.columns}), "cmin", "cmax", "rate_min", "rate_max")


_STATEMENTS = [
    Statement(TRUE, Compare("<=", Col("n_lines"), Col("max_line"))),
    Statement(Flag("is_final"), Compare(">=", Col("qty"), Col("n_lines"))),
    Statement(Flag("has_return"), Compare("<=", Col("n_lines"), Const(4))),
    Statement(conj([Flag("has_return"), Flag("is_urgent")]), Compare(">=", Col("qty"), Linear(Fraction(1, 2), ((Fraction(3, 2), Col("n_lines")),)))),
]
_STATEMENT_SQL = [("TRUE", "n_lines", "<=", "max_line"), ("is_final", "qty", ">=", "n_lines"), ("has_return", "n_lines", "<=", "4"), ("has_return AND is_urgent", "qty", ">=", "(0.5 + 1.5 * n_lines)")]


def _metric_sql(i: int, h: str, a: str, op: str, b: str) -> str:
    slack = f"CAST({b} AS DOUBLE) - {a}" if op == "<=" else f"CAST({a} AS DOUBLE) - {b}"
    return f"SELECT {i} AS conj_id, count(*) FILTER ({h}) AS support, count(*) FILTER (({h}) AND {a} {op} {b}) AS holds, count(*) FILTER (({h}) AND NOT ({a} {op} {b})) AS violations, count(*) FILTER (({h}) AND abs({slack}) <= 1e-12) AS touch, count(*) FILTER ({slack} = 0) AS touch_all, round(min({slack}) FILTER ({h}), 6) AS min_slack, round(avg({slack}) FILTER ({h}), 6) AS avg_slack, round(max({slack}) FILTER ({h}), 6) AS max_slack, round(coalesce(count(*) FILTER (({h}) AND {a} {op} {b}) / nullif(count(*) FILTER ({h}), 0), 0), 6) AS accuracy FROM obj"


@query(f"WITH {OBJ} " + " UNION ALL ".join(_metric_sql(i, *s) for i, s in enumerate(_STATEMENT_SQL)))
def conjecture_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = relation.metrics_frame(order_objects(spark, sf), _STATEMENTS).drop("hypothesis", "conclusion")
    return _round(out, "min_slack", "avg_slack", "max_slack", "accuracy")


@query(f"WITH {OBJ} SELECT o_orderkey, n_lines, CAST(4 - n_lines AS DOUBLE) AS __slack__ FROM obj WHERE has_return AND NOT (n_lines <= 4)")
def counterexamples(spark: SparkSession, sf: str) -> DataFrame:
    return _STATEMENTS[2].failures(order_objects(spark, sf)).select("o_orderkey", "n_lines", "__slack__")


@query(f"WITH {OBJ} SELECT round(avg(qty - n_lines), 6) AS avg_slack, round(min(qty - n_lines), 6) AS min_slack, round(max(qty - n_lines), 6) AS max_slack FROM obj WHERE is_final")
def slack_summary(spark: SparkSession, sf: str) -> DataFrame:
    sql = export.slack_sql(_STATEMENTS[1], "{objects}")
    return _round(spark.sql(sql, objects=order_objects(spark, sf)), "avg_slack", "min_slack", "max_slack")


@query(f"WITH {OBJ} SELECT o_orderkey FROM obj WHERE has_return AND NOT (n_lines <= 4)")
def exported_sql(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(export.select_sql(_STATEMENTS[2], "{objects}"), objects=order_objects(spark, sf)).select("o_orderkey")


@query("""SELECT 'doc_id' AS "column", count(doc_id) AS n, coalesce(bool_and(doc_id IN (0, 1)), FALSE) AND count(doc_id) > 0 AS boolean_like FROM labels
UNION ALL SELECT 'quality', count(quality), coalesce(bool_and(quality IN (0, 1)), FALSE) AND count(quality) > 0 FROM labels
UNION ALL SELECT 'toxic', count(toxic), coalesce(bool_and(toxic IN (0, 1)), FALSE) AND count(toxic) > 0 FROM labels""")
def boolean_like(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.boolean_like(read(spark, sf, "labels"))


_ALL_FLAGS = ["always", "has_return", "is_final", "is_urgent", "single_line"]


@query(f"WITH {OBJ} " + " UNION ALL ".join(f"SELECT '{f}' AS flag, bool_and({f}) AS in_base FROM obj" for f in _ALL_FLAGS))
def base_hypothesis(spark: SparkSession, sf: str) -> DataFrame:
    found = lattice.Lattice(order_objects(spark, sf), [Flag(f) for f in _ALL_FLAGS])
    return spark.createDataFrame([(p.label(), i in found.base.bits) for i, p in enumerate(found.flags)], "flag string, in_base boolean")


def _conjunctions() -> list[tuple[str, ...]]:
    rest = _ALL_FLAGS[1:]
    return [("always",), *((("always", f)) for f in rest), *(("always", a, b) for i, a in enumerate(rest) for b in rest[i + 1 :])]


def _label(parts: tuple[str, ...]) -> str:
    return parts[0] if len(parts) == 1 else "(" + " ∧ ".join(sorted(parts)) + ")"


@query(f"WITH {OBJ} " + " UNION ALL ".join(f"SELECT '{_label(c)}' AS hypothesis, {len(c)} AS arity, count(*) FILTER ({' AND '.join(c)}) AS support FROM obj" for c in _conjunctions()))
def hypothesis_support(spark: SparkSession, sf: str) -> DataFrame:
    df = order_objects(spark, sf)
    found = lattice.Lattice(df, [Flag(f) for f in _ALL_FLAGS])
    return found.frame(df, found.by_generality(found.conjunctions(2))).drop("hyp_id")


_FEW = ["few", "has_return", "single_line"]


@query(f"WITH {OBJ}, w AS (SELECT *, n_lines <= 2 AS few FROM obj) " + " UNION ALL ".join(f"SELECT '{_label((a, b))}' AS redundant FROM w HAVING count(*) FILTER ({a} AND NOT {b}) = 0 OR count(*) FILTER ({b} AND NOT {a}) = 0" for a, b in combinations(_FEW, 2)))
def hypothesis_redundancy(spark: SparkSession, sf: str) -> DataFrame:
    df = order_objects(spark, sf).withColumn("few", F.col("n_lines") <= 2)
    found = lattice.Lattice(df, [Flag(f) for f in _FEW])
    rows = [(a.label(),) for a, _ in found.redundant(found.conjunctions(2)) if a.arity == 2]
    return spark.createDataFrame(rows, "redundant string")


@query(f"""WITH {OBJ}, h AS (SELECT 'single_line' AS hypothesis, * FROM obj WHERE single_line UNION ALL SELECT 'TRUE', * FROM obj),
l AS (SELECT hypothesis, 'n_lines' AS feature, CAST(n_lines AS DOUBLE) AS x FROM h UNION ALL SELECT hypothesis, 'max_line', CAST(max_line AS DOUBLE) FROM h)
SELECT hypothesis, feature, (min(x) + max(x)) / 2 AS value FROM l GROUP BY ALL HAVING min(x) = max(x)""")
def constant_columns(spark: SparkSession, sf: str) -> DataFrame:
    df = order_objects(spark, sf)
    found = lattice.Lattice(df, [Flag("single_line")])
    return bounds.constant_columns(df, found, found.conjunctions(1), {n: Col(n) for n in ("n_lines", "max_line")})


@query(f"""WITH {OBJ}, c AS (SELECT count(*) FILTER (single_line AND NOT (n_lines = 1 AND n_lines = n_lines)) AS a, count(*) FILTER ((n_lines = 1) <> single_line) AS b, count(*) FILTER (is_final AND NOT has_return) AS c FROM obj)
SELECT 'single_line ⊆ n_lines == 1' AS relation, a AS violations, a = 0 AS holds_all FROM c UNION ALL SELECT 'n_lines == 1 ≡ single_line', b, b = 0 FROM c UNION ALL SELECT 'is_final ⊆ has_return', c, c = 0 FROM c""")
def class_relations(spark: SparkSession, sf: str) -> DataFrame:
    one = Compare("==", Col("n_lines"), Const(1))
    return relation.class_relation_counts(order_objects(spark, sf), [Inclusion(Flag("single_line"), one), Equivalence(one, Flag("single_line")), Inclusion(Flag("is_final"), Flag("has_return"))])


_PAIRS = [("n_lines", "qty"), ("n_lines", "max_line"), ("qty", "max_line")]
_THREE = {n: Col(n) for n in ("n_lines", "qty", "max_line")}


@query(f"WITH {OBJ} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b FROM obj HAVING bool_or({a} < {b}) AND bool_or({a} > {b})" for a, b in _PAIRS))
def noncomparable_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.noncomparable(order_objects(spark, sf), _THREE)


@query(f"WITH {OBJ} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS support, count(*) FILTER ({a} < {b}) AS below, count(*) FILTER ({a} > {b}) AS above, round(count(*) FILTER ({a} < {b}) / count(*), 6) AS rate_below, round(count(*) FILTER ({a} > {b}) / count(*), 6) AS rate_above, round(median(abs(CAST({a} AS DOUBLE) - {b})), 6) AS median_gap, round(avg(abs(CAST({a} AS DOUBLE) - {b})), 6) AS mean_gap FROM obj" for a, b in _PAIRS))
def incomparability(spark: SparkSession, sf: str) -> DataFrame:
    out = statistics.incomparability(order_objects(spark, sf), _THREE)
    return _round(out.drop("n", "balance"), "rate_below", "rate_above", "median_gap", "mean_gap")


@query(f"WITH {OBJ}, c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, count(*) AS n, corr({n}, t) AS corr FROM obj" for n in ("n_lines", "qty", "gross", "max_line")) + ") SELECT feature, n, round(corr, 6) AS corr FROM c WHERE abs(corr) >= 0.001")
def corr_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    out = statistics.correlations(order_objects(spark, sf), Col("t"), {n: Col(n) for n in ("n_lines", "qty", "gross", "max_line")}, least=0.001)
    return _round(out, "corr")


_MORGAN_HYPS = {"TRUE": "TRUE", "is_final": "is_final", "single_line": "single_line", "(is_final ∧ single_line)": "(is_final AND single_line)"}


@query(f"""WITH {OBJ}, s AS ({" UNION ALL ".join(f"SELECT '{h}' AS hypothesis, o_orderkey AS k FROM obj WHERE {c}" for h, c in _MORGAN_HYPS.items() if h != "TRUE")}),
n AS (SELECT hypothesis, count(*) AS n FROM s GROUP BY 1),
sub AS (SELECT x.hypothesis AS a, y.hypothesis AS b FROM n x JOIN n y ON x.hypothesis <> y.hypothesis AND x.n < y.n
        WHERE NOT EXISTS (SELECT 1 FROM s p WHERE p.hypothesis = x.hypothesis AND NOT EXISTS (SELECT 1 FROM s q WHERE q.hypothesis = y.hypothesis AND q.k = p.k)))
SELECT hypothesis FROM n WHERE hypothesis NOT IN (SELECT a FROM sub)""")
def morgan_maximal(spark: SparkSession, sf: str) -> DataFrame:
    same = Compare("<=", Col("n_lines"), Col("max_line"))
    hyps = [Flag("is_final"), Flag("single_line"), conj([Flag("is_final"), Flag("single_line")])]
    kept = filters.morgan(order_objects(spark, sf), [Statement(h, same) for h in hyps])
    return spark.createDataFrame([(s.hypothesis.label(),) for s in kept], "hypothesis string")


_RHS = ["n_lines + 30", "n_lines + 40", "qty * 2", "max_line * 20", "n_lines * 50"]
_RHS_EXPR = [Col("n_lines") + 30, Col("n_lines") + 40, Col("qty") * 2, Col("max_line") * 20, Col("n_lines") * 50]


@query(f"""WITH {OBJ}, l AS ({" UNION ALL ".join(f"SELECT o_orderkey AS k, {i} AS seq, CAST({r} AS DOUBLE) AS v FROM obj WHERE is_final" for i, r in enumerate(_RHS))}),
e AS (SELECT seq, v, min(v) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM l)
SELECT seq FROM e GROUP BY seq HAVING bool_or(p IS NULL OR v < p - 1e-9)""")
def dalmatian_envelope(spark: SparkSession, sf: str) -> DataFrame:
    statements = [Statement(Flag("is_final"), Compare("<=", Col("qty"), e), name=str(i)) for i, e in enumerate(_RHS_EXPR)]
    kept = filters.dalmatian(order_objects(spark, sf), statements)
    return spark.createDataFrame([(int(s.name),) for s in kept], "seq int")


@query(f"WITH {OBJ} SELECT 'single_line' AS hypothesis, 'n_lines' AS lhs FROM obj HAVING count(*) FILTER (single_line) > 0 AND count(*) FILTER (single_line AND n_lines <> 1) = 0 UNION ALL SELECT 'is_final', 'n_lines' FROM obj HAVING count(*) FILTER (is_final) > 0 AND count(*) FILTER (is_final AND n_lines <> 1) = 0")
def equalities(spark: SparkSession, sf: str) -> DataFrame:
    statements = [Statement(Flag(h), Compare(">=", Col("n_lines"), Const(1))) for h in ("single_line", "is_final")]
    equal, _ = filters.equalities(order_objects(spark, sf), statements)
    return spark.createDataFrame([(s.hypothesis.label(), s.conclusion.a.label()) for s in equal], "hypothesis string, lhs string")


_TIGHT = {"TRUE": "TRUE", "few": "few", "has_return": "has_return", "single_line": "single_line"}


@query(f"""WITH {OBJ}, w AS (SELECT *, n_lines <= 2 AS few FROM obj),
b AS ({" UNION ALL ".join(f"SELECT '{h}' AS h, floor(min(n_lines)) AS low, ceil(max(n_lines)) AS high FROM w WHERE {c}" for h, c in _TIGHT.items())})
SELECT DISTINCT CASE WHEN x.h = 'TRUE' THEN y.h WHEN y.h IN ('TRUE', x.h) THEN x.h ELSE '(' || least(x.h, y.h) || ' ∧ ' || greatest(x.h, y.h) || ')' END AS hypothesis, CAST(x.high AS BIGINT) AS value
FROM b x JOIN b y ON x.high = y.low""")
def strengthened_equalities(spark: SparkSession, sf: str) -> DataFrame:
    df = order_objects(spark, sf).withColumn("few", F.col("n_lines") <= 2)
    found = lattice.Lattice(df, [Flag(f) for f in _FEW])
    made = bounds.constant_statements(df, found, found.conjunctions(1), Col("n_lines"))
    return spark.createDataFrame([(s.hypothesis.label(), int(s.conclusion.b.value)) for s in filters.strengthened(made)], "hypothesis string, value long")


_EVENTS = {"==": "abs(n_lines - max_line) <= 1e-4 + 1e-9 * abs(max_line)", "<": "n_lines < max_line - 1e-4", ">": "n_lines > max_line + 1e-4", "<=": "n_lines <= max_line", ">=": "n_lines >= max_line"}
_TARGETS = {"single_line": "single_line", "¬(single_line)": "NOT single_line", "has_return": "has_return"}


def _sophie(spark: SparkSession, sf: str) -> tuple[list, list, dict[str, int]]:
    events = sufficient.events(Statement(TRUE, Compare("<=", Col("n_lines"), Col("max_line"))), 1e-4)
    targets = [Flag("single_line"), Not(Flag("single_line")), Flag("has_return")]
    return targets, events, sufficient.signature_counts(order_objects(spark, sf), [*targets, *events])


@query(f"WITH {OBJ} " + " UNION ALL ".join(f"SELECT '{t}' AS property, '{e}' AS event, count(*) FILTER ({ec}) AS support_h, count(*) FILTER (({ec}) AND {tc}) AS coverage, count(*) FILTER ({tc}) AS target_size, count(*) FILTER (({ec}) AND NOT ({tc})) AS violations FROM obj" for t, tc in _TARGETS.items() for e, ec in _EVENTS.items()))
def sophie_candidates(spark: SparkSession, sf: str) -> DataFrame:
    targets, events, counts = _sophie(spark, sf)
    size = lambda f: sum(n for s, n in counts.items() if f(s))
    rows = [(t.label(), op, size(lambda s: s[3 + j] == "1"), size(lambda s: s[3 + j] == "1" == s[i]), size(lambda s: s[i] == "1"), size(lambda s: s[3 + j] == "1" and s[i] == "0")) for i, t in enumerate(targets) for j, op in enumerate(_EVENTS)]
    return spark.createDataFrame(rows, "property string, event string, support_h long, coverage long, target_size long, violations long")


_COVER_EVENTS = [(f"n_lines {op} max_line", c) for op, c in _EVENTS.items()] + [(f"max_line {op} 1", c.replace("max_line", "m1").replace("n_lines", "max_line").replace("m1", "1")) for op, c in _EVENTS.items()] + [(f"n_lines {op} 1", c.replace("max_line", "1")) for op, c in _EVENTS.items()]
_COVER_TARGETS = [("single_line", "single_line"), ("has_return", "has_return"), ("¬(single_line)", "NOT single_line"), ("¬(has_return)", "NOT has_return"), ("(has_return ∧ single_line)", "has_return AND single_line")]


def _cover_sql(rounds: int = 8) -> str:
    """The greedy cover round by round over signatures of events and properties; more rounds than it can take are empty."""
    bits = ", ".join([*(f"({c}) AS e{k}" for k, (_, c) in enumerate(_COVER_EVENTS)), *(f"({c}) AS p{k}" for k, (_, c) in enumerate(_COVER_TARGETS))])
    out = [
        OBJ, f"sig AS (SELECT row_number() OVER () AS s, * FROM (SELECT {bits}, count(*) AS n FROM obj GROUP BY ALL))",
        "ek AS (" + " UNION ALL ".join(f"SELECT {k} AS k, '{label}' AS event, s, n FROM sig WHERE e{k}" for k, (label, _) in enumerate(_COVER_EVENTS)) + ")",
        "tp0 AS (" + " UNION ALL ".join(f"SELECT {k} AS p, '{label}' AS property, s, n FROM sig WHERE p{k}" for k, (label, _) in enumerate(_COVER_TARGETS)) + ")",
        # of properties of the same rows the first
        "st AS (SELECT p, any_value(property) AS property, sum(n) AS target_size, list(s ORDER BY s) AS rows FROM tp0 GROUP BY p), kept AS (SELECT * FROM st x WHERE target_size >= 5 AND NOT EXISTS (SELECT 1 FROM st y WHERE y.rows = x.rows AND y.p < x.p))",
        "tp AS (SELECT p, s, n FROM tp0 WHERE p IN (SELECT p FROM kept)), se AS (SELECT k, any_value(event) AS event, sum(n) AS support_h FROM ek GROUP BY k)",
        "both_ AS (SELECT p, k, sum(tp.n) AS total FROM tp JOIN ek USING (s) GROUP BY p, k), cand AS (SELECT p, k, total, support_h, event FROM both_ JOIN se USING (k) WHERE support_h >= 3 AND support_h = total)",
        "cov0 AS (SELECT p, s FROM tp WHERE FALSE)",
    ]
    for j in range(1, rounds + 1):
        out.append(f"pick{j} AS (SELECT * FROM (SELECT p, k, sum(tp.n) AS coverage, any_value(c.total) AS total, any_value(c.support_h) AS support_h, any_value(c.event) AS event FROM cand c JOIN ek USING (k) JOIN tp USING (p, s) WHERE NOT EXISTS (SELECT 1 FROM cov{j - 1} v WHERE v.p = tp.p AND v.s = tp.s) GROUP BY p, k) QUALIFY row_number() OVER (PARTITION BY p ORDER BY coverage DESC, support_h DESC, k) = 1)")
        out.append(f"cov{j} AS (SELECT p, s FROM cov{j - 1} UNION SELECT p, s FROM pick{j} JOIN ek USING (k))")
    every = " UNION ALL ".join(f"SELECT * FROM pick{j}" for j in range(1, rounds + 1))
    return f"WITH {', '.join(out)} SELECT property, event, CAST(support_h AS BIGINT) AS support_h, CAST(coverage AS BIGINT) AS coverage, CAST(target_size AS BIGINT) AS target_size, CAST(support_h - total AS BIGINT) AS violations, total = target_size AND total = support_h AS both_ways FROM ({every}) JOIN kept USING (p)"


@query(_cover_sql())
def sophie_cover(spark: SparkSession, sf: str) -> DataFrame:
    df = order_objects(spark, sf)
    statements = [Statement(TRUE, Compare("<=", Col("n_lines"), Col("max_line"))), Statement(TRUE, Compare(">=", Col("max_line"), Const(1))), Statement(TRUE, Compare("<=", Col("n_lines"), Const(1)))]
    found = sufficient.discover(df, [Flag("single_line"), Flag("has_return")], statements)
    rows = [(c.property.label(), c.event.label(), c.support_h, c.coverage, c.target_size, c.violations, c.both_ways) for c in found]
    return spark.createDataFrame(rows, "property string, event string, support_h long, coverage long, target_size long, violations long, both_ways boolean")


def _supplier(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("x"), F.sum("l_quantity").alias("y"))
    return lines.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def _lp1_sql(upper: bool) -> str:
    better, keep = ("max", ">=") if upper else ("min", "<=")
    return f"""WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS x, sum(l_quantity) AS y FROM lineitem GROUP BY l_suppkey), m AS (SELECT avg(x) AS c FROM s),
r AS (SELECT x, {better}(y) AS y FROM s GROUP BY x),
e AS (SELECT a.x AS x1, a.y AS y1, (b.y - a.y) / (b.x - a.x) AS w FROM r a JOIN r b ON a.x < b.x, m WHERE a.x <= c AND b.x >= c),
f AS (SELECT w, y1 - w * x1 AS b FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE NOT (w * r.x + y1 - w * x1 {keep} r.y - {'' if upper else '-'}1e-9)))
SELECT round(min(w * c + b), 4) AS at_mean FROM f, m"""


def _lp1(spark: SparkSession, sf: str, upper: bool) -> DataFrame:
    df = _supplier(spark, sf)
    mean = df.agg(F.avg("x")).first()[0]
    rows = [(round(f.weights[0] * mean + f.intercept, 4),) for f in fits.fit(df, Col("y"), [Col("x")], [TRUE], [fits.Candidate(0, (0,))]) if f.upper == upper]
    return spark.createDataFrame(rows, "at_mean double")


@query(_lp1_sql(True))
def lp1_upper(spark: SparkSession, sf: str) -> DataFrame:
    return _lp1(spark, sf, True)


@query(_lp1_sql(False))
def lp1_lower(spark: SparkSession, sf: str) -> DataFrame:
    return _lp1(spark, sf, False)


@query("""WITH s AS (SELECT CAST(c_nationkey AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS y FROM customer GROUP BY c_nationkey),
e AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, (b.y - a.y) / (b.x - a.x) AS w FROM s a JOIN s b ON a.x < b.x),
k AS (SELECT DISTINCT round(w, 6) AS slope, round(y1 - w * x1, 6) AS intercept, NOT EXISTS (SELECT 1 FROM s WHERE s.y > w * s.x + y1 - w * x1 + 1e-9) AS up, NOT EXISTS (SELECT 1 FROM s WHERE s.y < w * s.x + y1 - w * x1 - 1e-9) AS down FROM e)
SELECT slope, intercept, '<=' AS op FROM k WHERE up UNION ALL SELECT slope, intercept, '>=' FROM k WHERE down""")
def hull2d_facets(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("x")).agg(F.count("*").alias("y"))
    found = fits.convex_hull(df, Col("y"), [Col("x")], TRUE)
    # facets that round to the same are one row; no -0.0
    rows = {(round(float(s.conclusion.b.terms[0][0]) if s.conclusion.b.terms else 0.0, 6) + 0.0, round(float(s.conclusion.b.intercept), 6) + 0.0, s.conclusion.op) for s in found}
    return spark.createDataFrame(sorted(rows), "slope double, intercept double, op string")


_P = {n: Col(n) for n in ("p_size", "p_retailprice")}
_FORMS = {
    "product": (_P["p_size"] * _P["p_retailprice"], "p_size * p_retailprice"),
    "square": (Un("square", _P["p_size"]), "CAST(p_size AS DOUBLE) * p_size"),
    "root": (Un("sqrt", _P["p_size"]), "sqrt(p_size)"),
    "log2": (Log(_P["p_size"], 2), "ln(p_size) / ln(2)"),
    "gap": (abs(_P["p_size"] - _P["p_retailprice"]), "abs(p_size - p_retailprice)"),
    "low": (min_(_P["p_size"], _P["p_retailprice"]), "least(p_size, p_retailprice)"),
    "high": (max_(_P["p_size"], _P["p_retailprice"]), "greatest(p_size, p_retailprice)"),
    "quotient": (_P["p_retailprice"] / (_P["p_size"] - 5), "CASE WHEN p_size <> 5 THEN p_retailprice / (p_size - 5) END"),
    "remainder": (Bin("%", Const(3) - _P["p_size"], Const(7)), "(3 - p_size) - floor((3 - p_size) / 7.0) * 7"),
    "whole": (Un("floor", _P["p_retailprice"] / 7), "floor(p_retailprice / 7)"),
    "linear": (Linear(Fraction(-1, 2), ((Fraction(3, 4), _P["p_size"]),)), "-0.5 + 0.75 * p_size"),
}


@query("SELECT p_partkey, " + ", ".join(f"round(CAST({s} AS DOUBLE), 6) AS {n}" for n, (_, s) in _FORMS.items()) + " FROM part")
def scalar_forms(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", *[F.round(e.column(), 6).alias(n) for n, (e, _) in _FORMS.items()])


_MASKS = {
    "between": (Between(Col("p_size"), Const(10), Const(20), (True, False)), "p_size >= 10 AND p_size < 20"),
    "either": (disj([Compare("<", Col("p_size"), Const(5)), In("p_brand", ("Brand#11", "Brand#12"))]), "p_size < 5 OR p_brand IN ('Brand#11', 'Brand#12')"),
    "whole": (is_int(Col("p_retailprice") * 10), "p_retailprice * 10 - floor(p_retailprice * 10) <= 1e-9"),
    "neither": (~disj([Compare("<", Col("p_size"), Const(5)), Compare(">", Col("p_size"), Const(40))]), "NOT (p_size < 5 OR p_size > 40)"),
}


@query("SELECT p_partkey, " + ", ".join(f"({s}) AS m_{n}" for n, (_, s) in _MASKS.items()) + " FROM part")
def predicate_masks(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", *[p.column().alias(f"m_{n}") for n, (p, _) in _MASKS.items()])


@query("""WITH RECURSIVE k AS (SELECT p_partkey AS n FROM part WHERE p_partkey >= 1), m AS (SELECT CAST(unnest(range(1, (SELECT max(n) FROM k) + 1)) AS BIGINT) AS n), d AS (SELECT a.n AS n, b.n AS d FROM m a JOIN m b ON b.n <= a.n AND a.n % b.n = 0),
s AS (SELECT n, count(*) AS divisor_count, CAST(sum(d) AS BIGINT) AS sum_divisors FROM d GROUP BY n), o AS (SELECT d.n, count(*) AS distinct_primes, CAST(max(d.d) AS DOUBLE) AS largest FROM d JOIN s ON s.n = d.d AND s.divisor_count = 2 GROUP BY d.n),
f AS (SELECT d.n, count(*) AS prime_factor_count FROM d JOIN o ON o.n = d.d AND o.distinct_primes = 1 GROUP BY d.n), fib(a, b) AS (SELECT CAST(1 AS BIGINT), CAST(2 AS BIGINT) UNION ALL SELECT b, a + b FROM fib WHERE b < 1000000000),
walk(n, x, steps) AS (SELECT n, n, 0 FROM k UNION ALL SELECT n, CASE WHEN x % 2 = 0 THEN x // 2 ELSE 3 * x + 1 END, steps + 1 FROM walk WHERE x > 1)
SELECT k.n, round(sqrt(k.n), 6) AS sqrt_n, round(ln(k.n), 6) AS log_n, coalesce(prime_factor_count, 0) AS prime_factor_count, largest AS largest_prime_factor, divisor_count, sum_divisors, CAST(w.steps AS BIGINT) AS collatz_steps, divisor_count = 2 AS is_prime, k.n % 2 = 0 AS is_even, round(sqrt(k.n)) * round(sqrt(k.n)) = k.n AS is_square,
  k.n IN (SELECT a FROM fib) AS is_fibonacci, sum_divisors = 2 * k.n AS is_perfect, CAST(k.n AS VARCHAR) = reverse(CAST(k.n AS VARCHAR)) AS is_palindrome, bit_count(k.n) = 1 AS is_power_of_two
FROM k JOIN s ON s.n = k.n LEFT JOIN o ON o.n = k.n LEFT JOIN f ON f.n = k.n JOIN (SELECT n, max(steps) AS steps FROM walk GROUP BY n) w ON w.n = k.n""")
def integer_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Number theory of the parts' keys."""
    found = tables.number_theory(read(spark, sf, "part").select(F.col("p_partkey").alias("n")))
    return found.select("n", F.round("sqrt_n", 6).alias("sqrt_n"), F.round("log_n", 6).alias("log_n"), "prime_factor_count", "largest_prime_factor", "divisor_count", "sum_divisors", "collatz_steps", "is_prime", "is_even", "is_square", "is_fibonacci", "is_perfect", "is_palindrome", "is_power_of_two")


@query(f"WITH {OBJ} SELECT o_orderkey, statement FROM (SELECT o_orderkey, 2 AS statement FROM obj WHERE has_return AND NOT (n_lines <= 4) UNION ALL SELECT o_orderkey, 3 FROM obj WHERE has_return AND is_urgent AND NOT (qty >= 0.5 + 1.5 * n_lines) UNION ALL SELECT o_orderkey, 0 FROM obj WHERE NOT (n_lines <= max_line) UNION ALL SELECT o_orderkey, 1 FROM obj WHERE is_final AND NOT (qty >= n_lines))")
def monitored_counterexamples(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.counterexamples(order_objects(spark, sf), _STATEMENTS).select("o_orderkey", "statement")


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` kept for the passes over it, and let go."""
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def _mined(spark: SparkSession, df: DataFrame, statements: list[Statement]) -> DataFrame:
    return relation.metrics_frame(df, statements).select("hypothesis", "conclusion", "support", "touch", "violations")


def _small(spark: SparkSession, sf: str) -> DataFrame:
    return order_objects(spark, sf).select("n_lines", "qty", "max_line", "is_final", "has_return")


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with six invariants besides ``qty`` of like size (price in thousands, rates in hundredths), for the forms of three and four features."""
    lines = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max(F.col("l_quantity").cast("double")).alias("max_qty"), F.min(F.col("l_quantity").cast("double")).alias("min_qty"), F.sum(100 * F.col("l_discount").cast("double")).alias("discount"), F.sum(100 * F.col("l_tax").cast("double")).alias("tax")
    )
    df = order_objects(spark, sf).join(lines, "o_orderkey")
    return df.select("n_lines", F.col("qty").cast("double").alias("qty"), (F.col("gross").cast("double") / 1000).alias("price"), "max_qty", "min_qty", "discount", "tax", "is_final", "has_return")


@query()
def stage_mixed(spark: SparkSession, sf: str) -> DataFrame:
    with held(_wide(spark, sf).select("n_lines", "qty", "max_qty", "min_qty", "is_final")) as df:
        session = Session(df, max_arity=1, min_touches=1)
        found = session.conjecture("qty", stages=[Stage.MIXED], with_conditions=False, quick=False, products=False, absolute=False, extremes=False, logs=False)
        return _mined(spark, df, [s for s, _ in found.statements])


@query()
def mine_subsets(spark: SparkSession, sf: str) -> DataFrame:
    """Forms of up to four features: fitted, rounded, verified, by touch."""
    with held(_wide(spark, sf)) as df:
        session = Session(df, max_arity=0, min_touches=1)
        found = session.conjecture("qty", stages=[Stage.LP2, Stage.LP3, Stage.LP4], with_conditions=False, quick=False, products=False, absolute=False, extremes=False, logs=False)
        return _mined(spark, df, [s for s, _ in found.statements])


def _mine_fast_sql() -> str:
    """Constant, ratio and one-feature bounds of each hypothesis, rounded; per stage the true ones that are met, of the largest hypotheses, each sharper somewhere than those before it."""
    hyps, features = (("TRUE", "TRUE"), ("has_return", "has_return"), ("is_final", "is_final")), ("n_lines", "max_line")
    ctes = [f"{OBJ}, s AS (SELECT CAST(n_lines AS DOUBLE) AS n_lines, CAST(max_line AS DOUBLE) AS max_line, CAST(qty AS DOUBLE) AS t, is_final, has_return, row_number() OVER () AS id FROM obj), q20 AS (SELECT unnest(range(1, 21)) AS q)"]
    constant, ratio, lp, n = [], [], [], 0
    for h, cond in hyps:
        for side, value in ((">=", "floor(min(t))"), ("<=", "ceil(max(t))")):
            constant.append(f"SELECT {n} AS n, 0 AS stage, '{h}' AS h, '{side}' AS side, '' AS x, CAST(0 AS DOUBLE) AS w, CAST({value} AS DOUBLE) AS b FROM s WHERE {cond}")
            n += 1
    for h, cond in hyps:
        for x in features:
            for side, fn in ((">=", "min"), ("<=", "max")):
                ratio.append(f"SELECT {n} AS n, '{h}' AS h, '{side}' AS side, '{x}' AS x, {fn}(t / {x}) AS c FROM s WHERE {cond} AND {x} > 0 HAVING count(*) >= 5")
                n += 1
    for h, cond in hyps:
        for x in features:
            tag = f"{h}_{x}"
            ctes.append(f"m_{tag} AS (SELECT avg({x}) AS c, count(*) AS rows FROM s WHERE {cond})")
            for side, end, keep, sign in ((">=", "min", "max", -1), ("<=", "max", "min", 1)):
                one = f"{tag}_{end}"
                ctes.append(f"r_{one} AS (SELECT {x} AS x, {end}(t) AS y FROM s WHERE {cond} GROUP BY 1), e_{one} AS (SELECT (q.y - p.y) / (q.x - p.x) AS w, p.x AS x1, p.y AS y1 FROM r_{one} p JOIN r_{one} q ON p.x < q.x, m_{tag} WHERE p.x <= c AND q.x >= c)")
                ctes.append(f"f_{one} AS (SELECT w, y1 - w * x1 AS b FROM e_{one} WHERE NOT EXISTS (SELECT 1 FROM r_{one} r WHERE {sign} * (r.y - w * r.x - y1 + w * x1) > 1e-9))")
                lp.append(f"SELECT {n} AS n, '{h}' AS h, '{side}' AS side, '{x}' AS x, arg_{keep}(w, w * c + b) AS w, arg_{keep}(b, w * c + b) AS b FROM f_{one}, m_{tag} WHERE rows >= 8")
                n += 1
    value = "b + w * CASE x " + " ".join(f"WHEN '{x}' THEN {x}" for x in features) + " ELSE 0 END"
    rest = "t - w * CASE x " + " ".join(f"WHEN '{x}' THEN {x}" for x in features) + " END"
    given = " OR ".join(f"(c.h = '{h}' AND {cond if cond == 'TRUE' else 's.' + cond})" for h, cond in hyps)
    inside = " UNION ALL ".join(f"SELECT '{g}' AS small, '{h}' AS large FROM s HAVING count(*) FILTER ({gc} AND NOT {hc}) = 0 AND count(*) FILTER ({hc} AND NOT {gc}) > 0" for g, gc in hyps for h, hc in hyps if g != h)
    ctes += [
        f"ratio0 AS ({' UNION ALL '.join(ratio)})", "ratio1 AS (SELECT r.*, round(c * q) / q AS near, CASE WHEN side = '<=' THEN ceil(c * q) / q ELSE floor(c * q) / q END AS outer_, row_number() OVER (PARTITION BY n ORDER BY abs(round(c * q) / q - c), q) AS k FROM ratio0 r, q20 WHERE abs(c) <= 4)",
        "ratio2 AS (SELECT n, any_value(h) AS h, any_value(side) AS side, any_value(x) AS x, any_value(c) AS c, max(near) FILTER (k = 1) AS near, min(outer_) AS least_, max(outer_) AS most FROM ratio1 GROUP BY n)",
        "ratio_ AS (SELECT n, 1 AS stage, h, side, x, CASE WHEN side = '<=' AND near < c - 1e-9 THEN least_ WHEN side = '>=' AND near > c + 1e-9 THEN most ELSE near END AS w, CAST(0 AS DOUBLE) AS b FROM ratio2)",
        f"lp0 AS ({' UNION ALL '.join(lp)})", "lp1_ AS (SELECT n, h, side, x, round(w * q) / q AS w, q FROM lp0, q20 WHERE abs(w) <= 4 AND abs(b) <= 8 AND abs(w) >= 1e-8 QUALIFY row_number() OVER (PARTITION BY n ORDER BY abs(round(w * q) / q - w), q) = 1)",
        f"lp2_ AS (SELECT c.n, any_value(c.h) AS h, any_value(c.side) AS side, any_value(c.x) AS x, any_value(w) AS w, max({rest}) AS hi, min({rest}) AS lo FROM lp1_ c JOIN s ON {given} WHERE q < 20 AND w <> 0 GROUP BY c.n)",
        "lp3_ AS (SELECT *, CASE WHEN side = '<=' THEN hi ELSE lo END AS r FROM lp2_)",
        "lp_ AS (SELECT n, 2 AS stage, h, side, x, w, CASE WHEN abs(round(r * q) / q - r) <= 1e-9 THEN round(r * q) / q WHEN side = '<=' THEN ceil(r * 20) / 20 ELSE floor(r * 20) / 20 END AS b FROM lp3_, q20 QUALIFY row_number() OVER (PARTITION BY n ORDER BY abs(round(r * q) / q - r), q) = 1)",
        f"cand AS ({' UNION ALL '.join(constant)} UNION ALL SELECT * FROM ratio_ WHERE w <> 0 UNION ALL SELECT * FROM lp_)",
        f"v AS (SELECT c.*, id, t, {value} AS v FROM cand c JOIN s ON {given})",
        "met AS (SELECT n, count(*) AS support, count(*) FILTER (abs(v - t) <= 1e-12) AS touch, count(*) FILTER (CASE side WHEN '<=' THEN t > v ELSE t < v END) AS violations, min(CASE side WHEN '<=' THEN v - t ELSE t - v END) AS least_ FROM v GROUP BY n)",
        f"ok AS (SELECT c.*, support, touch, violations FROM cand c JOIN met USING (n) WHERE least_ >= -1e-9 AND touch >= 1), inside AS ({inside})",
        "general AS (SELECT k.*, row_number() OVER (PARTITION BY stage ORDER BY touch DESC, support DESC, n) AS place FROM ok k WHERE NOT EXISTS (SELECT 1 FROM ok o JOIN inside i ON i.small = k.h AND i.large = o.h WHERE o.stage = k.stage AND o.side = k.side AND o.x = k.x AND o.w = k.w AND o.b = k.b))",
        "u AS (SELECT g.n, g.stage, g.side, g.h, g.place, v.id, CASE g.side WHEN '<=' THEN v.v ELSE -v.v END AS u FROM general g JOIN v USING (n))",
        "sharp AS (SELECT DISTINCT n FROM (SELECT n, u, min(u) OVER (PARTITION BY stage, side, h, id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u) WHERE before IS NULL OR u < before - 1e-9)",
    ]
    return f"WITH {', '.join(ctes)} SELECT h AS hypothesis, side, x AS feature, round(w, 4) AS slope, round(b, 4) AS intercept, any_value(support) AS support, any_value(touch) AS touch, any_value(violations) AS violations FROM general WHERE n IN (SELECT n FROM sharp) GROUP BY h, side, x, w, b"


@query(_mine_fast_sql())
def mine_fast(spark: SparkSession, sf: str) -> DataFrame:
    with held(_small(spark, sf)) as df:
        found = [s for s, _ in Session(df, max_arity=1, min_touches=1, use_morgan=True, use_dalmatian=True).conjecture("qty", mode="fast", quick=False).statements]
        met = relation.evaluate(df, found)
        rows = []
        for i, s in enumerate(found):
            b = s.conclusion.b
            terms, intercept = (b.terms, float(b.intercept)) if isinstance(b, Linear) else ((), float(b.value))
            rows.append((s.hypothesis.label(), s.conclusion.op, terms[0][1].label() if terms else "", round(float(terms[0][0]), 4) if terms else 0.0, round(intercept, 4), met[i]["support"], met[i]["touch"], met[i]["violations"]))
    return spark.createDataFrame(rows, "hypothesis string, side string, feature string, slope double, intercept double, support long, touch long, violations long")


def _packaged_sql() -> str:
    """Ratio and least-slack bounds of each feature under each flag, the true ones that are somewhere sharper than the rest of their side, without those of a smaller hypothesis."""
    hyps, features = ("is_final", "has_return"), ("n_lines", "max_line")
    made = [f"{OBJ}, s AS (SELECT CAST(n_lines AS DOUBLE) AS n_lines, CAST(max_line AS DOUBLE) AS max_line, CAST(qty AS DOUBLE) AS t, is_final, has_return, row_number() OVER () AS id FROM obj)"]
    rows = []
    for h in hyps:
        for x in features:
            tag = f"{h}_{x}"
            rows.append(f"SELECT '{h}' AS h, '{x}' AS x, '>=' AS side, 'ratio' AS kind, min(t / {x}) AS w, CAST(0 AS DOUBLE) AS b FROM s WHERE {h} AND {x} <> 0 UNION ALL SELECT '{h}', '{x}', '<=', 'ratio', max(t / {x}), 0 FROM s WHERE {h} AND {x} <> 0")
            made.append(f"m_{tag} AS (SELECT avg({x}) AS c FROM s WHERE {h})")
            for side, end, keep, sign in (("<=", "max", "min", 1), (">=", "min", "max", -1)):
                one = f"{tag}_{end}"
                made.append(f"r_{one} AS (SELECT {x} AS x, {end}(t) AS y FROM s WHERE {h} GROUP BY 1)")
                made.append(f"e_{one} AS (SELECT (q.y - p.y) / (q.x - p.x) AS w, p.x AS x1, p.y AS y1 FROM r_{one} p JOIN r_{one} q ON p.x < q.x, m_{tag} WHERE p.x <= c AND q.x >= c)")
                made.append(f"f_{one} AS (SELECT w, y1 - w * x1 AS b FROM e_{one} WHERE NOT EXISTS (SELECT 1 FROM r_{one} r WHERE {sign} * (r.y - w * r.x - y1 + w * x1) > 1e-9))")
                # slopes and intercepts are whole numbers over differences of up to six lines
                rows.append(f"SELECT '{h}', '{x}', '{side}', 'lp', round(arg_{keep}(w, w * c + b) * 60) / 60, round(arg_{keep}(b, w * c + b) * 60) / 60 FROM f_{one}, m_{tag}")
    held = " OR ".join(f"(c.h = '{h}' AND s.{h})" for h in hyps)
    value = "b + w * CASE x " + " ".join(f"WHEN '{x}' THEN {x}" for x in features) + " END"
    made += [
        f"cand AS ({' UNION ALL '.join(rows)})", f"v AS (SELECT c.*, id, t, {value} AS v FROM cand c JOIN s ON {held})",
        "met AS (SELECT h, x, side, kind, any_value(w) AS w, any_value(b) AS b, count(*) AS support, count(*) FILTER (abs(v - t) <= 1e-12) AS touch, count(*) FILTER (CASE side WHEN '<=' THEN t > v ELSE t < v END) AS violations FROM v GROUP BY h, x, side, kind)",
        "true_ AS (SELECT m.* FROM met m WHERE violations = 0)", "w_ AS (SELECT v.h, v.x, v.side, v.kind, v.id, CASE v.side WHEN '<=' THEN v.v ELSE -v.v END AS u FROM v JOIN true_ USING (h, x, side, kind))",
        "low AS (SELECT h, side, id, min(u) AS u, count(*) FILTER (u = least_) AS n FROM (SELECT *, min(u) OVER (PARTITION BY h, side, id) AS least_ FROM w_) GROUP BY h, side, id)",
        "sharp AS (SELECT DISTINCT w_.h, w_.x, w_.side, w_.kind FROM w_ JOIN low ON low.h = w_.h AND low.side = w_.side AND low.id = w_.id AND low.u = w_.u AND low.n = 1)",
        "kept AS (SELECT t.* FROM true_ t JOIN sharp USING (h, x, side, kind))",
        "inside AS (" + " UNION ALL ".join(f"SELECT '{g}' AS small, '{h}' AS large FROM s HAVING count(*) FILTER ({g} AND NOT {h}) = 0 AND count(*) FILTER ({h} AND NOT {g}) > 0" for g in hyps for h in hyps if g != h) + ")",
    ]
    return f"WITH {', '.join(made)} SELECT h AS hypothesis, side, x AS feature, round(w, 4) AS slope, round(b, 4) AS intercept, support, touch, violations FROM kept k WHERE NOT EXISTS (SELECT 1 FROM kept o JOIN inside i ON i.small = k.h AND i.large = o.h WHERE o.x = k.x AND o.side = k.side AND o.w = k.w AND o.b = k.b)"


@query(_packaged_sql())
def packaged_necessary(spark: SparkSession, sf: str) -> DataFrame:
    with held(_small(spark, sf)) as df:
        found = necessary_bounds(df, "qty")
        met = relation.evaluate(df, found)
        rows = [(s.hypothesis.label(), s.conclusion.op, s.conclusion.b.terms[0][1].label(), round(float(s.conclusion.b.terms[0][0]), 4), round(float(s.conclusion.b.intercept), 4), met[i]["support"], met[i]["touch"], met[i]["violations"]) for i, s in enumerate(found)]
    return spark.createDataFrame(rows, "hypothesis string, side string, feature string, slope double, intercept double, support long, touch long, violations long")


def _sufficient_sql() -> str:
    """Ratio bounds outside each flag, the true ones that are somewhere sharper than the rest of their side; turned round, each covers a row that none before it does."""
    flags, features = {"few": "n_lines <= 2", "many": "qty > 150"}, ("n_lines", "max_line")
    base = f"{OBJ}, s AS (SELECT CAST(n_lines AS DOUBLE) AS n_lines, CAST(max_line AS DOUBLE) AS max_line, CAST(qty AS DOUBLE) AS t, {', '.join(f'({c}) AS {f}' for f, c in flags.items())}, row_number() OVER () AS id FROM obj)"
    rows = " UNION ALL ".join(f"SELECT '{f}' AS h, '{x}' AS x, '{side}' AS side, {fn}(t / {x}) AS w, {n} AS n FROM s WHERE NOT {f} AND {x} <> 0" for n, (x, f, side, fn) in enumerate((x, f, side, fn) for x in features for f in flags for side, fn in ((">=", "min"), ("<=", "max"))))
    outside = " OR ".join(f"(c.h = '{f}' AND NOT s.{f})" for f in flags)
    value = "w * CASE x " + " ".join(f"WHEN '{x}' THEN {x}" for x in features) + " END"
    inside = " UNION ALL ".join(f"SELECT '{g}' AS small, '{h}' AS large FROM s HAVING count(*) FILTER (NOT {g} AND {h}) = 0 AND count(*) FILTER (NOT {h} AND {g}) > 0" for g in flags for h in flags if g != h)
    parts = [
        base, f"cand AS ({rows})", f"every AS (SELECT c.*, id, t, {value} AS v, {outside} AS given FROM cand c, s)",
        "met AS (SELECT n, any_value(h) AS h, any_value(x) AS x, any_value(side) AS side, any_value(w) AS w, count(*) FILTER (given) AS support, count(*) FILTER (v = t) AS touch_all, count(*) FILTER (given AND CASE side WHEN '<=' THEN t > v ELSE t < v END) AS violations FROM every GROUP BY n)",
        "w_ AS (SELECT e.h, e.side, e.n, e.id, CASE e.side WHEN '<=' THEN e.v ELSE -e.v END AS u FROM every e JOIN met m ON m.n = e.n AND m.violations = 0 WHERE given)",
        "low AS (SELECT h, side, id, min(u) AS u, count(*) FILTER (u = least_) AS k FROM (SELECT *, min(u) OVER (PARTITION BY h, side, id) AS least_ FROM w_) GROUP BY h, side, id)",
        "kept0 AS (SELECT * FROM met WHERE n IN (SELECT w_.n FROM w_ JOIN low USING (h, side, id) WHERE low.u = w_.u AND low.k = 1))", f"inside AS ({inside})",
        "kept AS (SELECT *, row_number() OVER (ORDER BY touch_all DESC, support DESC, n) AS place FROM kept0 k WHERE NOT EXISTS (SELECT 1 FROM kept0 o JOIN inside i ON i.small = k.h AND i.large = o.h WHERE o.x = k.x AND o.side = k.side AND o.w = k.w))",
        "turned AS (SELECT k.n, k.h, k.place, e.id FROM kept k JOIN every e ON e.n = k.n WHERE CASE e.side WHEN '<=' THEN e.t > e.v ELSE e.t < e.v END)",
        "first_ AS (SELECT n FROM turned QUALIFY row_number() OVER (PARTITION BY h, id ORDER BY place) = 1)",
    ]
    return f"WITH {', '.join(parts)} SELECT h AS property, CASE side WHEN '<=' THEN '>' ELSE '<' END AS side, x AS feature, round(w, 4) AS slope, (SELECT count(*) FROM turned t WHERE t.n = k.n) AS support, CAST(0 AS BIGINT) AS violations FROM kept k WHERE n IN (SELECT n FROM first_)"


@query(_sufficient_sql())
def packaged_sufficient(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of orders that are not short, or not large, turned round."""
    df = order_objects(spark, sf).select("n_lines", "qty", "max_line", (F.col("n_lines") <= 2).alias("few"), (F.col("qty") > 150).alias("many"))
    found = sufficient_conditions(df, "qty")
    metrics = relation.evaluate(df, found)
    rows = [(s.conclusion.label(), s.hypothesis.op, s.hypothesis.b.terms[0][1].label(), round(float(s.hypothesis.b.terms[0][0]), 4), metrics[i]["support"], metrics[i]["violations"]) for i, s in enumerate(found)]
    return spark.createDataFrame(rows, "property string, side string, feature string, slope double, support long, violations long")


def _lift_sql() -> str:
    part = lambda f, k: f"({k} + {f})" if k else f
    shifts = (0, -2, -1, 1, 2)
    every = [(f"({part(f, x)} / {part(g, y)})", f"CASE WHEN {g} + {y} <> 0 THEN ({f} + {x}) / ({g} + {y}) END") for f, g in (("a", "b"), ("b", "a")) for x in shifts for y in shifts]
    every += [(f"(1 / {part(f, x)})", f"CASE WHEN {f} + {x} <> 0 THEN 1 / ({f} + {x}) END") for f in "ab" for x in shifts]
    every += [("(1 / (a + b))", "1 / (a + b)"), ("(a / (a + b))", "a / (a + b)"), ("(b / (a + b))", "b / (a + b)"), ("((a + b) / a)", "(a + b) / a"), ("((a + b) / b)", "(a + b) / b")]
    rows = " UNION ALL ".join(f"SELECT '{label}' AS ratio, b AS t, a AS x, a <= 25 AS special, {value} AS e FROM l" for label, value in every)
    return f"""WITH l AS (SELECT CAST(l_quantity AS DOUBLE) AS a, least(CAST(l_quantity AS DOUBLE), 25.0) AS b FROM lineitem), e AS ({rows})
SELECT ratio, count(*) FILTER (e * x = t) AS met, round(avg(e * x - t), 6) AS slack FROM e GROUP BY ratio HAVING max(e) FILTER (special) - min(e) FILTER (special) <= 1e-3 AND abs((max(e) FILTER (special) + min(e) FILTER (special)) / 2 - 1) <= 1e-3 AND min(e * x - t) >= -1e-8"""


@query(_lift_sql())
def ratio_lift(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios of two invariants that are 1 on small lines and bound the smaller invariant on all: the ratios, rows where they meet it, and mean slack."""
    df = read(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("a"), F.least(F.col("l_quantity").cast("double"), F.lit(25.0)).alias("b"))
    found = fits.ratio_lift(df, Col("b"), Col("a"), 1.0, Compare("<=", Col("a"), Const(25)), TRUE, {"a": Col("a"), "b": Col("b")})
    met = relation.evaluate(df, found)
    return spark.createDataFrame([(s.conclusion.b.a.label(), met[i]["touch_all"], round(met[i]["avg_slack"], 6)) for i, s in enumerate(found)], "ratio string, met long, slack double")


for _part in (catalog_fits, catalog_more, catalog_live):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
