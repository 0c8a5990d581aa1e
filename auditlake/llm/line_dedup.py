"""Operator 10, line dedup by content-defined chunks of lines, in DataFrame functions only.

A text is split at line feeds. A rolling hash covers the last WINDOW lines; a chunk ends after a line whose rolling hash is a local
minimum, so an inserted line moves only the boundaries near it, and no two boundaries are neighbours: a chunk has two lines at
least, three on average (a text of one line is one chunk, and is left alone). A chunk whose bytes occur more than once in the
corpus is removed everywhere but at its first place (smallest doc_id, then position). Repeats are found by 64-bit hash among small
rows; then the bytes of all candidates are compared, and a candidate goes only if its bytes equal those of the place that stays.
Of a passage that different texts surround, the lines before its first and behind its last boundary stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, table

#: Lines under the rolling hash.
WINDOW = 2
#: A hash is hot at HOT_LEAST places and one HOT_SHARE-th of all; so at most HOT_SHARE hashes are broadcast.
HOT_LEAST, HOT_SHARE = 1000, 1024


def _behind(values: Column, by: int, fill: Column) -> Column:
    """The values moved back by so many places; fill stands where none is. Element i of the result is element i - by."""
    return F.slice(F.concat(F.array_repeat(fill, by), values), 1, F.size(values))


def _with_chunks(docs: DataFrame, window: int) -> DataFrame:
    """Adds lines and chunks: array of (at, n, h) with the first line's index, the number of lines, and the hash of the bytes.

    Every array is made from whole arrays, so the work is linear in the lines.
    """
    none = F.lit(0).cast("long")
    out = docs.withColumn("lines", F.split(F.col("text"), "\n"))
    out = out.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x)))
    rolled = F.col("hashes")
    for k in range(1, window):
        rolled = F.zip_with(rolled, _behind(F.col("hashes"), k, none), lambda x, y: F.xxhash64(x, y))
    out = out.withColumn("rolled", rolled)
    falls = F.zip_with(F.col("rolled"), _behind(F.col("rolled"), 1, none), lambda x, y: x < y)
    low = F.zip_with(falls, F.zip_with(F.col("rolled"), F.slice(F.concat("rolled", F.array(none)), 2, F.size("rolled")), lambda x, y: x <= y), lambda x, y: x & y)
    inside = F.filter(F.transform(low, lambda x, i: F.when(x & (i >= 1) & (i <= F.size("lines") - 3), i).otherwise(-1)), lambda i: i >= 0)
    out = out.withColumn("ends", F.concat(inside, F.array(F.size("lines") - 1)))
    chunk = lambda e, was: F.struct((was + 1).alias("at"), (e - was).alias("n"), F.xxhash64(_lines("lines", was + 1, e - was)).alias("h"))
    return out.withColumn("chunks", F.zip_with(F.col("ends"), _behind(F.col("ends"), 1, F.lit(-1)), chunk))


def _lines(lines: str, at: Column, n: Column) -> Column:
    return F.array_join(F.slice(lines, at + 1, n), "\n")


def _places(cut: DataFrame) -> DataFrame:
    """(doc_id, rk, k, at, h) of chunks of two lines or more; k is the chunk's place among its text's chunks."""
    each = cut.select("doc_id", "rk", F.posexplode_outer("chunks").alias("k", "c"))  # (for an inner one, a filter on the chunks' size is made beneath, which computes them twice)
    return each.where("c.n >= 2").select("doc_id", "rk", "k", F.col("c.at").alias("at"), F.col("c.h").alias("h"))


def _repeated(places: DataFrame) -> DataFrame:
    """places of hashes that have several, with stays: whether it is the first. Hot hashes meet by broadcast, the others by shuffling."""
    total = places.count()
    # (null sorts before every id in a struct)
    sizes = stash(places.groupBy("h").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "at")).alias("first")).where("times > 1"))
    hot = sizes.where(F.col("times") >= max(HOT_LEAST, -(-total // HOT_SHARE)))
    cold = sizes.join(F.broadcast(hot.select("h")), "h", "left_anti")
    found = places.join(F.broadcast(hot), "h").unionByName(places.join(F.broadcast(hot.select("h")), "h", "left_anti").join(cold, "h"))
    return found.select("doc_id", "rk", "k", "at", "h", F.struct("doc_id", "at").eqNullSafe(F.col("first")).alias("stays"))


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, text (what is left), n_lines, n_chunks, n_removed_lines.

    Null texts stay null with zero counts; the empty text is one empty line and stays. A row is known by its id and text: rows
    repeated in both count once and end alike, other texts under one id are documents of their own (of places that tie in
    id and position both stay). Null ids are one id, the smallest. Texts of any length are cut whole, in time linear in their lines.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("rk", F.xxhash64("text"))
    cut = _with_chunks(slim.where(F.col("text").isNotNull()), window)
    places = stash(_places(cut))
    found = stash(_repeated(places.distinct()))
    marks = found.groupBy(F.col("doc_id").alias("mark_id"), F.col("rk").alias("mark_rk")).agg(F.collect_set(F.struct("k", "h")).alias("marks"))  # at most the chunks of one document
    # The byte comparison: all candidates of one hash against each other, as their least and their greatest text.
    own = cut.join(marks.hint("merge"), F.col("doc_id").eqNullSafe(F.col("mark_id")) & (F.col("rk") == F.col("mark_rk"))).select("doc_id", "rk", "lines", "chunks", F.explode("marks").alias("m"))
    own = own.select("doc_id", "rk", F.col("m.k").alias("k"), F.col("m.h").alias("h"), "lines", F.element_at("chunks", F.col("m.k") + 1).alias("c"))
    texts = own.select("doc_id", "rk", "k", "h", F.col("c.at").alias("at"), _lines("lines", F.col("c.at"), F.col("c.n")).alias("bytes"))
    checked = stash(texts.groupBy("h").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi")).select("h", (F.col("lo") == F.col("hi")).alias("same")))
    clash = checked.where("not same").select("h")
    sure = found.where("not stays")
    if clash.head(1):  # two texts under one hash: these few are grouped by their bytes themselves
        rare = texts.join(clash, "h")
        least = rare.groupBy("h", "bytes").agg(F.min(F.struct("doc_id", "at")).alias("first"))
        later = rare.join(least, ["h", "bytes"]).where(~F.struct("doc_id", "at").eqNullSafe(F.col("first")))
        sure = sure.join(clash, "h", "left_anti").select("doc_id", "rk", "k").unionAll(later.select("doc_id", "rk", "k"))
    gone = sure.groupBy(F.col("doc_id").alias("gone_id"), F.col("rk").alias("gone_rk")).agg(F.collect_set("k").alias("gone"))
    return _without(slim, gone, window)


def _without(slim: DataFrame, gone: DataFrame, window: int) -> DataFrame:
    joined = _with_chunks(slim.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("rk") == F.col("gone_rk")), "left"), window)
    joined = joined.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("chunks") - 1), F.coalesce("gone", F.array().cast("array<int>"))))
    chunk = lambda k: F.element_at("chunks", k + 1)
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("kept", lambda k: _lines("lines", chunk(k)["at"], chunk(k)["n"])), "\n"))
    left = F.aggregate("kept", F.lit(0), lambda a, k: a + chunk(k)["n"])
    some = lambda x: F.coalesce(F.when(F.col("text").isNotNull(), x), F.lit(0)).cast("long")
    return joined.select("doc_id", text.alias("text"), some(F.size("lines")).alias("n_lines"), some(F.size("chunks")).alias("n_chunks"), some(F.size("lines") - left).alias("n_removed_lines"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_chunks(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed_lines", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLES: dict[str, str] = {}
