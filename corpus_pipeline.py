"""A training-data pipeline over ``documents``: each stage's table is written and read again as the next one's input.

Every stage takes texts of any length whole, passes further columns on whatever
their names (the last one reads doc_id and text alone), and gives an empty
table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lemmaforge.llm import decontamination, jaccard_join, mixing, queries, store, token_files, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts, fitted on these documents and the labels.

    Null, empty and blank texts score the base rate; repeated rows are judged each; labels without id or value are left out.
    """
    return toxicity.reject(docs, toxicity.fit(docs, queries.table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    Documents without words are near none and stay, and so do those without an id; of an id with several rows all stay or none.
    """
    return jaccard_join.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark; null and wordless texts have none and stay, repeated rows are judged each."""
    return decontamination.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by source weights: rows repeated or cut to the words taken.

    Rows without words go; a null source is one of its own, the last; equal rows are taken each.
    """
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, reported as read back; null and empty texts are the end id alone, rows of one id follow by text."""
    return token_files.token_output(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token output", tokens),
]

#: Viterbi decoding, components and tokenising have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    spent = None
    for name, stage in STAGES[:-1]:
        docs = store.keep(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if spent is not None:
            store.drop(spent)  # the stage before has been read for the last time
        spent = docs
    return STAGES[-1][1](spark, docs, sf_dir)
