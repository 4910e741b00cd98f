"""Every stage of the pipeline on odd rows: nulls, empty and very long texts, ties, repeated rows, further columns, no rows."""

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, taken long, score double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("stages")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    rows = [(i, 0, int(i % 5 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def rows():
    plain = [(i, " ".join(f"w{i}x{j}" for j in range(20)) + (" you idiot moron" if i % 5 == 0 else ""), "en", f"s{i % 2}", 100, 7, 8, 0.5) for i in range(40)]
    odd = [(None, None, None, None, None, None, None, None), (50, None, "en", "s1", 0, 1, 1, 1.0), (51, "", "en", "s1", 0, 1, 1, 1.0), (52, " \n\t", "en", None, 3, 1, 1, 1.0)]
    long = [(60, "long " * 200_000, "en", "s0", 1_000_000, 1, 1, 1.0), (61, "x" * 500_000, "en", "s0", 500_000, 1, 1, 1.0)]
    same = [(70, "said again and again and again once more", "en", "s0", 40, 1, 1, 1.0)] * 3 + [(70, "a tie of one id and other words than those", "en", "s0", 42, 1, 1, 1.0)]
    tested = [(80, "so ONE two three four five six seven eight nine ten eleven it is", "en", "s1", 60, 1, 1, 1.0)]
    return plain + odd + long + same + tested


def test_odd_rows(spark, folder):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "token output":
            assert out.columns == docs.columns, name
        got = out.collect()
        ids = [r["doc_id"] for r in got]
        if name == "toxicity":
            assert len(got) == sum(r[0] is None or r[0] >= 40 or r[0] % 5 != 0 for r in rows())
        elif name == "near duplicates":
            assert ids.count(70) == 4 and {None, 50, 51, 52, 60, 61, 80} <= set(ids)
        elif name == "decontamination":
            assert 80 not in ids and len(ids) == len(rows()) - 1
        elif name == "mixing":
            assert not {50, 51, 52} & set(ids) and all(r["text"].strip() for r in got)
        else:
            assert len(got) == len(rows()) and all(r["n_tokens"] >= 1 for r in got) and [r["start"] for r in sorted(got, key=lambda r: r["start"])][0] == 0


def test_no_rows(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name
