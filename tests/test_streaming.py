"""Bounds over a stream against bounds over all its rows."""

import numpy as np
import pytest

from lemmaforge.expr import Col
from lemmaforge.operators import fits
from lemmaforge.pred import TRUE, Flag
from lemmaforge.relation import evaluate
from lemmaforge.streaming.maintain import Watched, maintain

KIND = "x double, z double, t double, p boolean"


def table(spark, rng, n, scale=1.0):
    rows = [(float(a * scale), float(b * scale) if rng.random() > 0.1 else None, float(c * scale), bool(rng.random() < 0.4)) for a, b, c in rng.uniform(1, 5, (n, 3))]
    return spark.createDataFrame(rows, KIND)


def watched(path):
    return Watched(Col("t"), (Col("x"), Col("z")), (TRUE, Flag("p")), ((0,), (0, 1)), str(path))


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    parts = [table(spark, rng, n, s) for n, s in ((60, 1.0), (40, 0.9), (50, 1.4), (30, 1.0))]
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{tmp_path}/source/part={i}")
    stream = spark.readStream.schema(KIND + ", part int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/source")
    w = watched(tmp_path / "state")
    query = maintain(stream, w, str(tmp_path / "checkpoint"))
    assert query.awaitTermination(120) and query.exception() is None
    rows = spark.read.schema(KIND).parquet(*[f"{tmp_path}/source/part={i}" for i in range(4)])
    want = fits.fit(rows, Col("t"), [Col("x"), Col("z")], [TRUE, Flag("p")], [fits.Candidate(h, s) for h in range(2) for s in w.subsets])
    key = lambda f: (f.candidate.hyp, f.candidate.features, f.upper)
    got = {key(f): f for f in w.forms(spark)}
    assert set(got) == {key(f) for f in want}
    for f in want:
        g = got[key(f)]
        assert np.allclose([*g.weights, g.intercept], [*f.weights, f.intercept], atol=1e-6) and g.rows == f.rows
    assert all(m["violations"] == 0 or m["min_slack"] > -1e-6 for m in evaluate(rows, w.statements(spark)).values())
    row = rows.selectExpr("min(t) AS a", "max(t) AS b", "min(t / x) AS c", "max(t / z) AS d", "count(*) AS n").first()
    (e,) = [r for r in w.extrema(spark).collect() if r["hypothesis"] == TRUE.label()]
    assert (e["lo_y"], e["hi_y"], e["lo_0"], e["hi_1"], e["n"]) == pytest.approx(tuple(row))
    assert len(w.versions(spark)) == 2


def test_hulls_are_solved_again_only_when_broken(spark, tmp_path):
    """A batch inside every hull leaves corners alone; a batch run twice counts once; a batch without rows changes nothing."""
    rng = np.random.default_rng(5)
    w = watched(tmp_path / "state")
    first = table(spark, rng, 200)
    w.update(first, 0)
    w.update(spark.createDataFrame([(3.0, 3.0, 3.0, True), (2.9, None, 3.1, False)], KIND), 1)
    assert {s for _, s in w._corners(spark, 1).values()} == {0}
    for _ in range(2):
        w.update(spark.createDataFrame([(3.0, 3.0, 90.0, True)], KIND), 2)
    assert {s for _, s in w._corners(spark, 2).values()} == {2}
    w.update(spark.createDataFrame([], KIND), 3)
    (e,) = [r for r in w.extrema(spark).collect() if r["hypothesis"] == TRUE.label()]
    assert e["n"] == 203 and e["hi_y"] == 90.0 and e["hi_0"] == 30.0
    assert {k: (p.tolist(), s) for k, (p, s) in w._corners(spark, 3).items()} == {k: (p.tolist(), s) for k, (p, s) in w._corners(spark, 2).items()}


def test_hulls_see_few_rows_of_equal_features(spark, tmp_path, monkeypatch):
    """Of many rows with the same features only the ends reach the passes over hulls, and the corners are those of all rows."""
    from lemmaforge.operators import hull

    rng = np.random.default_rng(6)
    rows = [(float(a), float(b), float(t), bool(p)) for a, b, p, t in zip(rng.integers(1, 4, 900), rng.integers(1, 3, 900), rng.integers(0, 2, 900), rng.uniform(1, 5, 900), strict=True)]
    df = spark.createDataFrame([*rows, (None, 2.0, 9.0, True), (2.0, None, 0.5, False)], KIND).coalesce(1)
    seen, real = [], hull.corners_many
    monkeypatch.setattr(hull, "corners_many", lambda points, *rest: seen.append(points.count()) or real(points, *rest))
    w = watched(tmp_path / "state")
    w.update(df, 0)
    assert seen and max(seen) <= 2 * (3 * 2 * 2 + 2)
    m = w.matrix(df)
    whole = real(m, w._points_of(), {(h, c): len(s) + 1 for h in range(2) for c, s in enumerate(w.subsets)}, {})
    held = w._corners(spark, 0)
    assert set(held) == set(whole)
    for k, (own, _) in held.items():
        for p, q in ((own, whole[k]), (whole[k], own)):
            normals, offsets, spanned = hull.planes(p)
            assert spanned and (q @ normals.T <= offsets + 1e-6).all()
