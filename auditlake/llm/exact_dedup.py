"""Operator 5, exact dedup by content sort, in DataFrame functions only.

Texts are range-partitioned by the head of their normalised bytes (a hash of the whole orders those with one head) with
splitters that Spark samples, each partition is sorted externally by all bytes, and the window over the sorted run compares every text in full with its neighbour. A text
that very many rows share would fill one partition; such texts are known beforehand from a count of 64-bit
hashes (pre-aggregated before its shuffle) and their rows carry a salt in the sort key, so that splitters fall
inside the run. The parts of a salted run are joined by SHA-256 afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stash, table, unused

#: A text is hot at HOT_LEAST rows and one HOT_SHARE-th of all rows; so at most HOT_SHARE texts can be hot, and are broadcast by hash.
HOT_LEAST, HOT_SHARE, SALTS = 2000, 1 << 16, 64
#: Characters of a splitter; Spark's sample of splitters goes to the driver, so these are bounded and a hash stands for the rest.
HEAD = 64


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts equal the empty text. Null ids sort lowest. Rows repeated under one id are each counted, and each
    is kept if that id is the group's keep_id. Texts of any length are compared whole. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    keep: "max" or "min", which id of a group stays.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(text).alias("norm"))
    least = max(HOT_LEAST, -(-docs.count() // HOT_SHARE))
    hot = rows.groupBy(F.xxhash64("norm").alias("h")).agg(F.count("*").alias("n")).where(F.col("n") >= least).select("h", F.lit(True).alias("hot"))
    rows = rows.join(F.broadcast(hot), F.xxhash64("norm") == hot["h"], "left").select(  # at most HOT_SHARE rows
        "doc_id", F.left("norm", F.lit(HEAD)).alias("head"), F.xxhash64("norm").alias("tie"), "norm", F.when(F.col("hot"), F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(SALTS)) + 1).otherwise(F.lit(0)).alias("salt")
    )
    in_run = Window.partitionBy("head", "tie", "norm", "salt").orderBy("doc_id")
    run = in_run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pick = F.max if keep == "max" else F.min
    part = stash(
        rows.repartitionByRange("head", "tie", "salt").select(
            "doc_id", F.sha2("norm", 256).alias("text_sha256"), "salt", F.count("*").over(run).alias("size"), pick("doc_id").over(run).alias("keep"), F.row_number().over(in_run).alias("nth")
        )
    )
    whole = part.where("salt > 0 and nth = 1").groupBy("text_sha256").agg(F.sum("size").alias("hot_size"), pick("keep").alias("hot_keep"))
    out = part.join(F.broadcast(whole), "text_sha256", "left")  # at most HOT_SHARE rows
    keep_id = F.when(F.col("salt") > 0, F.col("hot_keep")).otherwise(F.col("keep"))
    size = F.when(F.col("salt") > 0, F.col("hot_size")).otherwise(F.col("size"))
    return out.select("doc_id", keep_id.alias("keep_id"), size.alias("group_size"), keep_id.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The pipeline stage: documents without the copies, columns unchanged. Of equal texts one row with the largest doc_id stays.

    A row is known by its id and its normalised text, so other texts under a repeated id stay; of rows that agree in both
    one stays, the first by a hash of all columns. Null texts equal the empty one. Null ids sort lowest. Columns may have any
    name; an empty table gives an empty result.
    """
    own, digest, kept, sha, nth = (unused(docs, x) for x in ("own_id", "own_sha", "kept_id", "kept_sha", "nth"))
    groups = exact_groups(docs).where("kept").select(F.col("doc_id").alias(kept), F.col("text_sha256").alias(sha)).distinct()
    rows = docs.withColumns({own: F.col("doc_id"), digest: F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)})
    rows = rows.join(groups, F.col(own).eqNullSafe(F.col(kept)) & (F.col(digest) == F.col(sha)), "left_semi")
    first = Window.partitionBy(own, digest).orderBy(F.xxhash64(*[F.to_json(F.struct(c)) for c in docs.columns]))
    return rows.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(own, digest, nth)


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLES = {
    "op5_exact_dedup": """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
       doc_id is not distinct from max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from d"""
}
