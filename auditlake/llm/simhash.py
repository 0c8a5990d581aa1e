"""Operator 1, SimHash near-dedup with pigeonring filtering.

A text's fingerprint holds the majority bit of the XXH64 of its word shingles. The 64 bits are a ring of SEGMENTS equal
segments. If two fingerprints differ in at most T bits, there is a segment from which every chain of l consecutive
segments differs in at most l*T/SEGMENTS bits. As long as that budget is under one bit the chain must be equal, so its
segments together are the join key, once for each start; longer chains are checked on each pair of a key before the
full Hamming distance. Only distinct fingerprints are joined, and a key with many of them (near copies of one text
fall close together) is handled without pairs: two fingerprints differ in at most two bits exactly if some value
differs in at most one bit from both, so each links to the least fingerprint around each of its 65 such values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingle_join
from .common import components, stash, table, unused

SHINGLE, SEED, DISTANCE, SEGMENTS = 3, 42, 2, 8
#: Fingerprints under one key beyond which neighbourhoods take the place of pairs.
CROWDED = 64
_ROWS = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a UTF-8 text; zero if it has no word."""
    words = (text or b"").lower().split()  # of bytes: A-Z and \\x20 \\x09-\\x0D alone
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))]
    h = np.array(hashes, "<u8")
    ones = sum(np.unpackbits(h[i : i + _ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(h), _ROWS))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): one row per input row, fp as a signed long. Null texts count as having no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, shingle, seed) for x in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def _rotated(fp: Column, bits: int) -> Column:
    return fp if bits == 0 else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def close_pairs(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) whose closure equals that of all pairs of distinct fps at most distance bits apart. segments must divide 64."""
    if 64 % segments or segments <= distance:
        raise ValueError("segments must divide 64 and exceed the distance")
    size = 64 // segments
    budget = [chain * distance // segments for chain in range(segments + 1)]
    equal = max(k for k in range(1, segments) if budget[k] == 0)
    starts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _rotated(F.col("fp"), i * size).alias("ring")) for i in range(segments)]))
    rings = fps.select("fp", starts.alias("r")).select("fp", "r.i", "r.ring").withColumn("key", F.shiftrightunsigned("ring", 64 - equal * size))
    sizes = rings.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stash(rings.join(sizes, ["i", "key"]))
    few = shared.where(F.col("n") <= crowded) if distance == 2 else shared
    x = F.col("x.ring").bitwiseXOR(F.col("y.ring"))
    chain = [F.bit_count(F.shiftrightunsigned(x, 64 - k * size)) <= budget[k] for k in range(equal + 1, segments)]
    ok = F.bit_count(x) <= distance
    for c in reversed(chain):
        ok = c & ok
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.i") == F.col("y.i")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp"))).where(ok)
    links = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    if distance != 2:
        return links
    many = shared.where(F.col("n") > crowded).select("fp").distinct()
    around = many.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)])).alias("at"))
    least = around.groupBy("at").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    stars = around.join(least, "at").where("fp != least").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()
    return links.unionAll(stars)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, fp, component_id), one row per input row; component_id is the smallest doc_id reachable over links.

    Documents without words share the fingerprint zero and are linked like others. Null ids have the smallest other id
    of their group, or null. Rows repeated under one id stay rows. Texts of any length are read whole; ties of a bit's
    majority give zero. Other columns are ignored, whatever their names; empty gives empty.
    """
    prints = stash(fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(close_pairs(distinct.select("fp"), distance, segments))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    member = named.join(first, "root").select("fp", "component_id")
    return prints.join(member, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = shingle_join.SHINGLE, similarity: float = shingle_join.SIMILARITY) -> DataFrame:
    """The pipeline stage: of each group of near duplicates the document with the smallest id stays, columns unchanged.

    Near are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Such fingerprints lie
    up to 14 of 64 bits apart, where equal segments single out next to nothing, so the sets themselves are joined.
    Documents without words have no shingles to compare and all stay, and so do those without an id. A row is known by its id
    and its text: unrelated texts under one id stay, and so do repeated rows of a text that stays. Texts of any length are read
    whole; columns may have any name; an empty table gives an empty result.
    """
    near = shingle_join.near_copies(docs, shingle, similarity)
    gone, rk = unused(docs, "gone_id"), unused(docs, "gone_rk")
    copies = stash(near.where("doc_id != least").select(F.col("doc_id").alias(gone), F.col("rk").alias(rk)).distinct())
    copies = F.broadcast(copies) if copies.count() <= shingle_join.FEW else copies
    return docs.join(copies, (F.col("doc_id") == F.col(gone)) & (F.xxhash64("text") == F.col(rk)), "left_anti")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
