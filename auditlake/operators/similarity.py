"""Similarity joins over vectors: nearest neighbours and thresholds, in blocks of a grid of tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components  # noqa: F401

#: Vectors of one side in a task.
BLOCK = 4096


def similarity_join(queries: DataFrame, base: DataFrame, k: int | None = None, low: float = -2.0, high: float = 2.0, block: int = BLOCK, on: str | None = None) -> DataFrame:
    """(qid, bid, sim): cosines in [low, high) of each query with the base, its own id left out; with k the k largest, ties by id.

    queries: (qid, vec), base: (bid, vec). Each task holds one block of both sides; only its own best k travel on.
    on: a column of both sides that must agree; blocks are then formed within its values, so no other pair is computed.
    """
    nq, nb = (max(1, -(-d.count() // block)) for d in (queries, base))
    own = [on] if on else []
    q = queries.select(*own, "qid", F.col("vec").alias("qvec"), F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int").alias("qb")).withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    b = base.select(*own, "bid", F.col("vec").alias("bvec"), F.pmod(F.xxhash64("bid"), F.lit(nb)).cast("int").alias("bb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def unit(col: pd.Series) -> np.ndarray:
        x = np.array(list(col), dtype=np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1)[:, None], 1e-300)

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qid": [], "bid": [], "sim": []})]
        if len(left) and len(right):
            right = right.sort_values("bid")
            x, y, ids = unit(left["qvec"]), unit(right["bvec"]), right["bid"].to_numpy()
            for at in range(0, len(x), 512):
                own = left["qid"].to_numpy()[at : at + 512]
                sim = x[at : at + 512] @ y.T
                ok = (sim >= low) & (sim < high) & (own[:, None] != ids[None])
                if k is not None and k < len(ids):
                    kth = -np.partition(-np.where(ok, sim, -3.0), k - 1, axis=1)[:, k - 1]
                    ok &= sim >= kth[:, None]
                i, j = np.nonzero(ok)
                out.append(pd.DataFrame({"qid": own[i], "bid": ids[j], "sim": sim[i, j]}))
        return pd.concat(out)

    found = q.groupBy(*own, "qb", "bb").cogroup(b.groupBy(*own, "qb", "bb")).applyInPandas(lambda x, y: pair(x, y), "qid long, bid long, sim double")
    if k is None:
        return found
    best = Window.partitionBy("qid").orderBy(F.desc(F.round("sim", 12)), "bid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def kernel_mean(queries: DataFrame, base: DataFrame, gamma: float = 4.0, block: int = BLOCK) -> float:
    """Mean of exp(-gamma (1 - cos)) over all pairs, each vector with itself too; a pair of blocks returns one sum."""
    nq, nb = (max(1, -(-d.count() // block)) for d in (queries, base))
    q = queries.select(F.col("vec").alias("qvec"), F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int").alias("qb")).withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    b = base.select(F.col("vec").alias("bvec"), F.pmod(F.xxhash64("bid"), F.lit(nb)).cast("int").alias("bb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        total = 0.0
        if len(left) and len(right):
            x, y = (np.array(list(v), float) for v in (left["qvec"], right["bvec"]))
            x, y = (v / np.maximum(np.linalg.norm(v, axis=1)[:, None], 1e-300) for v in (x, y))
            total = sum(float(np.exp(-gamma * (1 - x[at : at + 512] @ y.T)).sum()) for at in range(0, len(x), 512))
        return pd.DataFrame({"total": [total], "n": [len(left) * len(right)]})

    sums = q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInPandas(lambda x, y: pair(x, y), "total double, n long").agg(F.sum("total"), F.sum("n")).first()
    return sums[0] / sums[1] if sums[1] else 0.0
