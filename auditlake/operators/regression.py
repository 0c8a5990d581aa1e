"""Slopes with two-way fixed effects, and logistic regression on fractional targets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import stash


def demeaned(rows: DataFrame, by: tuple[str, str], cols: list[str], rounds: int = 200, tolerance: float = 1e-10) -> DataFrame:
    """The columns without the effects of both groupings, by projecting them out in turn until no value moves."""
    for _ in range(rounds):
        was = {c: f"was_{c}" for c in cols}
        now = rows.withColumns({w: F.col(c) for c, w in was.items()})
        for group in by:
            now = now.withColumns({c: F.col(c) - F.avg(c).over(Window.partitionBy(group)) for c in cols})
        now = stash(now)
        moved = now.agg(F.max(F.greatest(*[F.abs(F.col(c) - F.col(w)) for c, w in was.items()], F.lit(0.0)))).first()[0]
        rows = now.drop(*was.values())
        if moved is None or moved < tolerance:
            return rows
    raise RuntimeError(f"the effects didn't settle in {rounds} rounds")


def slopes(rows: DataFrame, y: str, xs: list[str], by: tuple[str, str]) -> np.ndarray:
    """Coefficients of xs on y with fixed effects of both groupings: normal equations from sums over the demeaned rows."""
    own = demeaned(rows.select(*by, *[F.col(c).cast("double").alias(c) for c in (y, *xs)]), by, [y, *xs])
    sums = own.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a in xs for b in (*xs, y)]).first()
    left = np.array([[sums[f"{a}|{b}"] for b in xs] for a in xs])
    return np.linalg.lstsq(left, np.array([sums[f"{a}|{y}"] for a in xs]), rcond=None)[0]


def dummy_slopes(panel: pd.DataFrame, y: str, xs: list[str], by: tuple[str, str]) -> np.ndarray:
    """The same by least squares with a column for each group, for panels that fit in memory."""
    dummies = [pd.get_dummies(panel[g], dtype=float).to_numpy()[:, (k > 0) :] for k, g in enumerate(by)]
    return np.linalg.lstsq(np.hstack([panel[xs].to_numpy(float), *dummies]), panel[y].to_numpy(float), rcond=None)[0][: len(xs)]


def fractional_logistic(rows: DataFrame, target: str, xs: list[str], strength: float = 1e-3) -> tuple[np.ndarray, float]:
    """(coefficients of the standardised xs, intercept): each row counts as a success with weight target and a failure with the rest."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    one = VectorAssembler(inputCols=xs, outputCol="raw").transform(rows)
    one = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(one).transform(one)
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col(target).alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - F.col(target)).alias("w"))))
    both = one.select("features", sides.alias("s")).select("features", "s.label", "s.w").where("w > 0")
    model = LogisticRegression(weightCol="w", regParam=strength, standardization=False, tol=1e-9, maxIter=200).fit(both)
    return np.array(model.coefficients), float(model.intercept)
