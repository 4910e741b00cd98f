"""Generators called from SQL against the generators themselves."""

import numpy as np
import pytest

from lemmaforge.expr import Col
from lemmaforge.functions import table_functions
from lemmaforge.operators import fits, hull
from lemmaforge.pred import TRUE, Flag


@pytest.fixture(scope="module")
def objects(spark):
    table_functions.register(spark)
    rng = np.random.default_rng(9)
    rows = [(float(x) if x else None, float(y), float(z), bool(p)) for x, y, z, p in zip(rng.integers(-3, 9, 400), rng.normal(size=400), rng.uniform(1, 2, 400), rng.random(400) < 0.3, strict=True)]
    df = spark.createDataFrame([*rows, (float("nan"), 1.0, 1.0, True), (2.0, None, 1.0, True)], "x double, t double, z double, p boolean").repartition(5)
    df.createOrReplaceTempView("objects_plain")
    spark.sql("SELECT h AS hypothesis, t, x, z FROM objects_plain LATERAL VIEW explode(filter(array('TRUE', if(p, 'p', NULL)), v -> v IS NOT NULL)) AS h").createOrReplaceTempView("objects")
    return df


@pytest.mark.parametrize("call", ["TABLE(SELECT * FROM objects)", "TABLE(SELECT * FROM objects) PARTITION BY hypothesis"])
def test_ratio_generator_from_sql(spark, objects, call):
    """Rows of the SQL call, merged over tasks, are the generator's statements."""
    rows = spark.sql(f"SELECT e.hypothesis, b.side, b.statement, b.condition FROM (SELECT hypothesis, feature, min(low) AS low, max(high) AS high FROM ratio_ends({call}) GROUP BY ALL) e, LATERAL bounds_of('t', e.feature, e.low, e.high) b").collect()
    got = sorted((r["hypothesis"], r["statement"]) for r in rows)
    want = sorted((h.label(), s.conclusion.label()) for h in (TRUE, Flag("p")) for s in fits.ratios(objects, Col("t"), [Col("x"), Col("z")], h))
    assert got == want and len(got) == 8
    for r in rows:
        assert spark.sql(f"SELECT count(*) FROM objects_plain WHERE {r['condition']}").first()[0] >= 0


def test_hull_corners_from_sql(spark, objects):
    got = spark.sql("SELECT * FROM hull_corners(TABLE(SELECT * FROM hull_corners(TABLE(SELECT hypothesis, z, t FROM objects))) PARTITION BY hypothesis)").collect()
    for h, df in (("TRUE", objects), ("p", objects.filter("p"))):
        want = hull.corners(df.select("z", "t").filter("NOT isnan(z)").dropna())
        assert sorted((r["x"], r["y"]) for r in got if r["hypothesis"] == h) == sorted(map(tuple, want.tolist()))


def test_no_rows_and_wrong_calls(spark, objects):
    assert spark.sql("SELECT * FROM ratio_ends(TABLE(SELECT * FROM objects WHERE false))").count() == 0
    assert spark.sql("SELECT * FROM bounds_of('t', 'x', CAST(NULL AS DOUBLE), 0.5D)").count() == 1
    assert [(r["numerator"], r["denominator"]) for r in spark.sql("SELECT * FROM bounds_of('t', 'x', 0.333D, 0.5D, 10)").collect()] == [(1, 3), (1, 2)]
    for call in ("bounds_of(1, 'x', 0.5D, 1.0D)", "bounds_of('t', 'x', 0.5D, 1.0D, 0)"):
        with pytest.raises(Exception, match="bounds_of takes|largest denominator"):
            spark.sql(f"SELECT * FROM {call}").collect()
