"""Document fingerprints by winnowing, in DataFrame operations only.

A text is cut into tokens: runs of code points that are not blank, and the
single code points of scripts that are written without blanks (Han, kana, Thai,
Lao, Myanmar, Khmer), whose tokens thus do not depend on where a run begins.
Every run of k tokens has a hash; of every window of w consecutive hashes the
least is chosen, of equal ones the rightmost.  The chosen hashes with their
positions are the fingerprint.

Guarantees: any run of w + k - 1 tokens that two texts share gives them a
common hash; a shared run of fewer than k tokens never does.

A hash (32 bits) and its position (31) are packed into one long, the hash above,
the position's complement below, so the least of a window is the rightmost least.

A text of fewer than k tokens has one hash, that of all its tokens; one of
fewer than w hashes one window.  Null reads as empty; empty and blank texts
have the empty fingerprint, which is like another empty one (1) and unlike any
other (0).  An empty table gives an empty one; texts of any length are taken
whole; columns other than doc_id and text are not read, whatever their names.
Rows of a doc_id that stands several times are edited with the row of
least text hash of the next id; rows of a null id have no next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

K, W = 3, 4
#: Code points of scripts without blanks.
UNSPACED = "\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\U00020000-\U0003FFFF"
TOKEN = f"[^\\x20\\x09-\\x0D{UNSPACED}]+|[{UNSPACED}]"
#: Bits of a packed value that hold the position (any that a text can have), and those of the hash above them.
_POS, _HASH = 31, 32
_MASK = (1 << _POS) - 1


def packed(text: Column, k: int = K) -> Column:
    """Array of hash-and-position longs of all k-token runs."""

    def of(tokens: Column) -> Column:
        n = F.size(tokens)
        pack = lambda h, p: F.shiftleft(h.bitwiseAND(F.lit((1 << _HASH) - 1)), _POS).bitwiseOR(F.lit(_MASK).cast("long") - p.cast("long"))
        runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: pack(F.xxhash64(*[F.get(tokens, i + j) for j in range(k)]), i))
        return F.when(n >= k, runs).when(n > 0, F.array(pack(F.xxhash64(tokens), F.lit(0)))).otherwise(F.array().cast("array<long>"))

    return _let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), of)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def winnow(values: Column, w: int = W) -> Column:
    """The least values of all windows, each once, in text order."""

    def of(v: Column) -> Column:
        n = F.size(v)
        windows = F.transform(F.sequence(F.lit(0), n - w), lambda i: F.least(*[F.get(v, i + j) for j in range(w)]))
        return F.when(n >= w, F.array_distinct(windows)).when(n > 0, F.array(F.array_min(v))).otherwise(v)

    return _let(values, of)


def hashes(chosen: Column) -> Column:
    """The distinct hashes of a fingerprint, without positions."""
    return F.array_distinct(F.transform(chosen, lambda x: (F.shiftrightunsigned(x, _POS) - F.lit(1 << 31)).cast("int")))


def positions(chosen: Column) -> Column:
    """The first token of each chosen run."""
    return F.transform(chosen, lambda x: (F.lit(_MASK).cast("long") - x.bitwiseAND(F.lit(_MASK).cast("long"))).cast("int"))


def as_text(chosen: Column) -> Column:
    """A fingerprint as a string: hash@position, comma-joined."""
    return F.array_join(F.transform(chosen, lambda x: F.concat(F.lower(F.hex(F.shiftrightunsigned(x, _POS))), F.lit("@"), (F.lit(_MASK).cast("long") - x.bitwiseAND(F.lit(_MASK).cast("long"))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both))


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, chosen (packed), hashes, positions, fingerprint for every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), winnow(packed(F.col("text"), k), w).alias("chosen"))
    return rows.select("doc_id", "n_chars", "chosen", hashes(F.col("chosen")).alias("hashes"), positions(F.col("chosen")).alias("positions"), as_text(F.col("chosen")).alias("fingerprint"))


def following(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (largest of the id), next_id in descending order, the last followed by the first.

    Ids are range-partitioned; a window runs inside each part, and the parts'
    ends are joined through a table with one row per part.
    """
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.char_length(F.coalesce("text", F.lit("")))).cast("long").alias("n_chars"))
    ids = store.keep(ids.filter("doc_id IS NOT NULL").repartitionByRange(F.desc("doc_id")).withColumn("part", F.spark_partition_id()), "fingerprint-ids")
    inside = ids.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy(F.desc("doc_id"))))
    ends = ids.groupBy("part").agg(F.max("doc_id").alias("first"))
    everything = Window.partitionBy(F.lit(0)).orderBy("part")  # one row per part
    ends = ends.select("part", F.coalesce(F.lead("first").over(everything), F.first("first").over(everything)).alias("onward"))
    return inside.join(ends, "part").select("doc_id", "n_chars", F.coalesce("next_id", "onward").alias("next_id"))


def edits(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Each text, its edited text, and their fingerprints.

    The edited text has its last floor(n_chars / 2) code points replaced by
    the first as many (or all) of the next document in descending doc_id order.
    Of the next document a row brings the part that is needed and the hashes
    of its fingerprint, not its whole text.
    """
    order = following(docs)
    # a cast that changes nothing leaves an alias on one side only, and the exchange would not be shared
    same = docs.schema["doc_id"].dataType.simpleString() == "bigint"
    every = docs.select("doc_id" if same else F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    text = every.filter("doc_id IS NOT NULL")  # both joins below read one exchange of it
    asked = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("asker"), F.expr("cast(n_chars div 2 AS INT)").alias("need"))
    lent = text.join(asked, "doc_id").select(F.col("asker").alias("doc_id"), F.substring("text", F.lit(1), F.col("need")).alias("head"), hashes(winnow(packed(F.col("text"), k), w)).alias("next_hashes"), F.xxhash64("text").alias("tie"))
    # of several rows of the next id, the one of least text hash
    lent = lent.groupBy("doc_id").agg(F.min(F.struct("tie", "head", "next_hashes")).alias("lent"))
    rows = text.join(lent, "doc_id", "left").select("doc_id", "text", "lent.head", "lent.next_hashes")
    lone = every.filter("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("string").alias("head"), F.lit(None).cast("array<int>").alias("next_hashes"))
    rows = rows.unionByName(lone).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.expr("cast(n_chars - n_chars div 2 AS INT)")
    return rows.select("doc_id", "text", "n_chars", F.concat(F.substring("text", F.lit(1), half), F.expr("coalesce(substring(head, 1, cast(n_chars div 2 AS INT)), '')")).alias("edited"), "next_hashes")


def report(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = edits(docs, k, w)
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), winnow(packed(F.col("text"), k), w).alias("a"), winnow(packed(F.col("edited"), k), w).alias("b"), F.coalesce("next_hashes", F.array().cast("array<int>")).alias("next_hashes"))
    rows = rows.select("*", hashes(F.col("a")).alias("ha"), hashes(F.col("b")).alias("hb"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"), likeness(F.col("ha"), F.col("hb")).alias("near_edited"), likeness(F.col("ha"), F.col("next_hashes")).alias("near_next"))
