"""Exact dedup by skew-safe combining, in DataFrame functions only.

1. Each map task combines its own equal texts (partial aggregation on digest, whole text and salt).
2. Salted groups are merged: the salt is the map task's number modulo ``salts``, so a text that a third of all
   rows share reaches ``salts`` reducers, each with one row for a map task.
3. The at most ``salts`` winners of a text are combined.
Every stage groups by the whole normalised text beside its digest. Members then find their group by the SHA-256
digest; the job fails (it never merges) if two texts shared one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters of [\x20\x09-\x0D], which normalisation deletes.
BLANKS = " \t\n\u000b\f\r"
#: 2^63 - 1, the largest id, and 2^65, above every place.
_TOP = "9223372036854775807BD"
_ABOVE = "36893488147419103232BD"


def _rank(n: Column, doc_id: Column) -> Column:
    """One decimal that orders by code points, then by smaller id; a null id comes last."""
    place = F.coalesce(F.expr(_TOP) - doc_id.cast("decimal(20,0)") + F.lit(1), F.lit(0).cast("decimal(22,0)"))
    return (n.cast("decimal(12,0)") * F.expr(_ABOVE) + place).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    place = rank % F.expr(_ABOVE)
    return F.when(place > 0, (F.expr(_TOP) - place + F.lit(1)).cast("long"))


def _normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("n"), F.translate(text, BLANKS, "").alias("norm"))


def _winners(base: DataFrame, salts: int) -> DataFrame:
    """(text_sha256, rank, group_size) of every group of equal texts."""
    keyed = base.withColumn("digest", F.unhex(F.sha2("norm", 256)))
    salted = (
        keyed.withColumn("salt", F.spark_partition_id() % F.lit(salts))
        .groupBy("digest", "norm", "salt")
        .agg(F.max(_rank(F.col("n"), F.col("doc_id"))).alias("rank"), F.count(F.lit(1)).alias("rows"))
    )
    return (
        salted.groupBy("digest", "norm")
        .agg(F.max("rank").alias("rank"), F.sum("rows").alias("rows"))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("texts"), F.max("rank").alias("rank"), F.sum("rows").alias("rows"))
        .select(
            F.lower(F.hex("digest")).alias("text_sha256"),
            "rank",
            F.when(F.col("texts") == 1, F.col("rows")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest"))).cast("long").alias("group_size"),
        )
    )


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; the longest original, then the smallest id, stays.
    Null text counts as empty. A row repeated with its id counts each time and every repeat of the winner is kept.
    A null id loses every tie; a group of null ids only has keep_id null and kept false. Other columns are ignored.
    An empty table gives an empty result.
    """
    base = _normalised(docs, id_col, text_col)
    winners = _winners(base, salts).select("text_sha256", _id_of(F.col("rank")).alias("keep_id"), "group_size")
    # joined by another column than the winners are grouped by, so that both sides are dealt anew and Spark may split a hot group
    members = base.select("doc_id", F.sha2("norm", 256).alias("text_sha256"))
    return members.join(winners, "text_sha256").select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """The rows of ``docs``, whole, that stay: exactly one of each group of equal texts, as ``dedup_exact`` ranks them.

    Rows are told apart by text, length and id together, so neither null ids nor an id of several texts matter; a null
    id loses every tie, but stands for a text that has no other. Of rows that tie in all three, one stays.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.sha2(F.translate(text, BLANKS, ""), 256)
    winners = _winners(_normalised(docs, id_col, text_col), salts).select(F.col("text_sha256").alias("_text"), F.col("rank").alias("_rank"))
    keyed = docs.withColumn("_text", own).withColumn("_rank", _rank(F.length(text), F.col(id_col).cast("long")))
    return keyed.join(winners, ["_text", "_rank"], "left_semi").dropDuplicates(["_text"]).select(*docs.columns)
