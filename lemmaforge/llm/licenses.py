"""License scans by diagonal voting, in DataFrame operations only.

All rolling k-word hashes of a text are joined with the template positions
that have them.  A hit at text position p and template position q votes for
the diagonal p - q; votes are aggregated by (document, template, diagonal).  The
words behind each vote are compared as text with the template's, so only true
ones count.  Neighbouring diagonals of one template are merged: a few words left
out or put in shift the diagonal, not the match.  Two lines are merged if their
numbers differ by NEAR_DIAGONALS at most and they vote for different template
positions: the same words said again are another span.  A span is verified as a
whole: its cover is the number of distinct template positions in it over the
larger of the template's length and its own, so neither repetition nor distance
adds to it.  A span that covers enough of its template gives the template's
label.

The templates are a constant of this module (some hundred positions), which is
what is broadcast.  Template positions of a span are bits of one long: texts of
more than MOST_GRAMS k-grams are cut into several templates.  Each text is split
once, in the task that reads it; only hits and one row per document are shuffled.

Null, empty and wordless texts have no words, spans or labels and score 0.  Of
several labels all are given.  Repeated rows are told apart by a row number.
Texts of any length are read whole, an empty table gives an empty one, and other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
#: Template positions that a long has bits for.
MOST_GRAMS = 62
#: Base phrases: fixed values.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Templates of the method's own labels: license notices as they are commonly written (fixed values).
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nd": ["licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "gpl-3": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
    ],
    "gpl-2": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"],
    "lgpl": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "agpl-3": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"],
}
#: Share of a template's k-grams that a span needs for the label, and how far merged diagonals may lie apart.
LEAST_COVER, NEAR_DIAGONALS = 0.7, 4


def words_of(text: Column) -> Column:
    """The words of a text, A-Z (and no other letters) lower-cased."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def templates(k: int = K) -> list[tuple[str, bool, list[str]]]:
    """Label, whether a base phrase, and words, of MOST_GRAMS k-grams at most."""
    out = [(label, True, text.split()) for label, text in PHRASES.items()]
    for label, texts in TEMPLATES.items():
        for w in map(str.split, texts):
            n = -(-(len(w) - k + 1) // MOST_GRAMS)
            size = -(-(len(w) - k + 1) // n)
            out += [(label, False, w[i * size : (i + 1) * size + k - 1]) for i in range(n)]
    return out


def template_positions(spark: SparkSession, k: int = K) -> DataFrame:
    """template (number), label, base, size (k-grams), q, gram and its hash h for every template position."""
    rows = [(n, label, base, len(w) - k + 1, q, " ".join(w[q : q + k])) for n, (label, base, w) in enumerate(templates(k)) for q in range(len(w) - k + 1)]
    frame = spark.createDataFrame(rows, "template int, label string, base boolean, size int, q int, gram string")
    parts = F.split("gram", " ")
    return frame.withColumn("h", F.xxhash64(*[parts[i] for i in range(k)]))


def hits(docs: DataFrame, k: int = K) -> DataFrame:
    """One row per document (template null, with n_words) and one per verified vote: row, doc_id, n_words, p, template, ..."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), words_of(F.col("text")).alias("w"))
    grams = F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(k)])))
    rows = rows.select("row", "doc_id", "w", F.size("w").cast("long").alias("n_words"), grams.alias("g"))
    placed = rows.select("row", "doc_id", "w", "n_words", F.posexplode_outer("g").alias("p", "h"))
    # the templates are this module's: broadcasting them is bounded by its text
    met = placed.join(F.broadcast(template_positions(spark, k)), "h", "left").filter("template IS NOT NULL OR coalesce(p, 0) = 0")
    text = F.concat_ws(" ", *[F.get("w", F.col("p") + j) for j in range(k)])
    true = F.coalesce((text == F.col("gram")), F.lit(False))
    return met.select("row", "doc_id", "n_words", F.coalesce("p", F.lit(0)).cast("long").alias("p"), *[F.when(true, F.col(c)).alias(c) for c in ("template", "label", "base", "size", "q")])


def _merged(found: DataFrame, keys: list[str]) -> DataFrame:
    """Votes by diagonal, and neighbouring diagonals of one template in one span: first and last text position, votes, cover."""
    one = [*keys, "template", "label", "base", "size"]
    bit = F.expr("shiftleft(1L, q)")
    lines = found.withColumn("diagonal", F.col("p") - F.col("q")).groupBy(*one, "diagonal").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.bit_or(bit).alias("voted"))
    # in order of number: one document's lines of one template; base phrases have to stand as they are
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR_DIAGONALS) | (F.lag("voted").over(order).bitwiseAND(F.col("voted")) != 0)
    lines = lines.withColumn("span", F.sum(F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).over(order))
    merged = lines.groupBy(*one, "span").agg(F.min("low").alias("first"), F.max("high").alias("last"), F.bit_count(F.bit_or("voted")).alias("votes"))
    return merged.withColumn("cover", F.col("votes") / F.greatest(F.col("size"), F.col("last") - F.col("first") + 1))


def spans(found: DataFrame, k: int = K) -> DataFrame:
    """Merged spans of votes: row, template, label, base, size, first and last text word, votes, cover (0 to 1)."""
    merged = _merged(found.filter("template IS NOT NULL"), ["row"])
    return merged.withColumn("last", F.col("last") + k - 1)


def scan(docs: DataFrame, k: int = K, least_cover: float = LEAST_COVER) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best cover)."""
    # votes and document rows meet per document, then per merged diagonal; one pass over the texts
    merged = _merged(hits(docs, k), ["row", "doc_id", "n_words"])
    full = F.col("base") & (F.col("votes") == F.col("size"))
    own = ~F.col("base") & (F.col("cover") >= least_cover)
    out = merged.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(full).alias("n_base"),
        F.min(F.when(full, F.col("first"))).alias("first_word"),
        F.max(F.when(full, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(full, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(full | own, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("template").isNotNull(), F.col("cover"))), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")
