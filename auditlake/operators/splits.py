"""Whole-group splits, budgets and coverage. Groups are rows; trials are worked off side by side, each over the small table of groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OVERSHOOT = 1.05


def pack(order: list, sizes: dict, budget: float, chosen: tuple = ()) -> list:
    """Groups in order, but for those that would pass the budget by over a twentieth, until it is reached."""
    out, used = list(chosen), sum(sizes[g] for g in chosen)
    for g in order:
        if used >= budget:
            break
        if g not in chosen and used + sizes[g] <= budget * OVERSHOOT:
            out.append(g)
            used += sizes[g]
    return out


def shuffled(groups: DataFrame, trials: int, key: str) -> DataFrame:
    """(trial, place, columns of groups): each trial has the groups in the order of a hash of trial and key. groups is small."""
    own = groups.join(F.broadcast(groups.sparkSession.range(trials).withColumnRenamed("id", "trial")))
    order = Window.partitionBy("trial").orderBy(F.md5(F.concat_ws("-", F.col("trial").cast("string"), F.col(key).cast("string"))))
    return own.withColumn("place", F.row_number().over(order))


def budget_draws(groups: DataFrame, trials: int, budget: float, key: str = "grp", size: str = "n") -> DataFrame:
    """(trial, key): what each shuffled order packs into the budget."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        got = pack(part[key].tolist(), dict(zip(part[key], part[size], strict=True)), budget)
        return pd.DataFrame({"trial": part["trial"].iloc[0], key: got})

    return shuffled(groups.select(key, size), trials, key).groupBy("trial").applyInPandas(one, f"trial long, {key} long")


def stratified_split(groups: DataFrame, shares: dict[str, float], trials: int, key: str = "grp", feats: tuple[str, ...] = ("n",)) -> DataFrame:
    """(key, split): whole groups dealt greedily to the split that lacks most of their features; the shuffled order with least deviation wins."""
    names, ratio = list(shares), np.array(list(shares.values()))
    totals = groups.agg(*[F.sum(c).alias(c) for c in feats]).first()
    total = np.array([float(totals[c] or 0) for c in feats]) + 1e-9

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        have, dealt = np.zeros((len(names), len(feats))), []
        for own in part[list(feats)].to_numpy(float):
            lack = ((ratio[:, None] - have / total) * (own / total)).sum(1)
            k = int(lack.argmax())
            have[k] += own
            dealt.append(names[k])
        return pd.DataFrame({"trial": part["trial"], key: part[key], "split": dealt, "off": np.abs(have / total - ratio[:, None]).sum()})

    tried = shuffled(groups.select(key, *feats), trials, key).groupBy("trial").applyInPandas(one, f"trial long, {key} long, split string, off double")
    best = tried.groupBy().agg(F.min(F.struct(F.round("off", 12).alias("off"), "trial")).alias("b")).select("b.trial")
    return tried.join(F.broadcast(best), "trial").select(key, "split")


def greedy_cover(gains: pd.DataFrame, sizes: dict, budget: float) -> list:
    """Groups by gain of coverage per member. gains: a row for each group, a column for each target, its largest similarity."""
    best = np.full(gains.shape[1], -1.0)
    out, used = [], 0
    size = np.array([sizes[g] for g in gains.index], float)
    table = gains.to_numpy(float)
    while used < budget:
        gain = (np.maximum(table, best) - best).sum(1) / size
        gain[[i for i, g in enumerate(gains.index) if g in out]] = -np.inf
        gain[used + size > budget * OVERSHOOT] = -np.inf
        k = int(gain.argmax())
        if not np.isfinite(gain[k]):
            break
        out.append(gains.index[k])
        used += size[k]
        best = np.maximum(best, table[k])
    return out


def distance_sampling(patterns: np.ndarray, owner: np.ndarray, count: int, seed: int = 0) -> list:
    """Owners drawn with chances by the squared distance of their patterns (unit vectors) from what is chosen."""
    rng = np.random.default_rng(seed)
    names = np.unique(owner)
    out = [names[rng.integers(len(names))]]
    far = 1 - (patterns @ patterns[owner == out[0]].T).max(1)
    while len(out) < min(count, len(names)):
        weight = np.clip(far, 0, None) ** 2
        weight[np.isin(owner, out)] = 0
        if weight.sum() <= 0:
            weight = (~np.isin(owner, out)).astype(float)
        out.append(owner[rng.choice(len(owner), p=weight / weight.sum())])
        far = np.minimum(far, 1 - (patterns @ patterns[owner == out[-1]].T).max(1))
    return out
