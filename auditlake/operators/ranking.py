"""Running sums and average precision along a ranking. Ranks are worked off in buckets of the score, so no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def running_sums(rows: DataFrame, by: list[str], sums: dict[str, str], score: str = "conf", tie: str = "pred") -> DataFrame:
    """Adds for each name the sum of its column over the rows of the group up to this one, by falling score, ties by the tie column."""
    bucket = F.least(F.greatest(F.floor(F.col(score) * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1))
    rows = rows.withColumn("bucket", bucket)
    upto = Window.partitionBy(*by, "bucket").orderBy(F.desc(score), tie).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*by).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows at most
    totals = rows.groupBy(*by, "bucket").agg(*[F.sum(c).alias(f"t_{n}") for n, c in sums.items()])
    before = totals.select(*by, "bucket", *[F.coalesce(F.sum(f"t_{n}").over(above), F.lit(0)).alias(f"b_{n}") for n in sums])
    inside = rows.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()})
    joined = inside.join(before, [*by, "bucket"])
    return joined.withColumns({n: F.col(n) + F.col(f"b_{n}") for n in sums}).drop("bucket", *[f"b_{n}" for n in sums])


def grid_place(recall: Column) -> Column:
    """The last of the 101 points i * 0.01 that the recall reaches."""
    i = F.floor(recall * 100)
    return F.least(F.when((i + 1) * F.lit(0.01) <= recall, i + 1).when(i * F.lit(0.01) <= recall, i).otherwise(i - 1), F.lit(100))


def mean_over_grid(points: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """(by, ap): at each grid point the best precision among the points (rec, prec) that reach it, or 0; their mean. Groups come from totals."""
    best = points.groupBy(*by, grid_place(F.col("rec")).alias("g")).agg(F.max("prec").alias("prec"))
    w = Window.partitionBy(*by).orderBy(F.desc("g"))  # 101 rows at most
    steps = best.select(*by, "g", F.max("prec").over(w).alias("env"), F.coalesce(F.lead("g").over(w), F.lit(-1)).alias("under"))
    ap = steps.groupBy(*by).agg((F.sum(F.col("env") * (F.col("g") - F.col("under"))) / 101).alias("ap"))
    return totals.select(*by).join(ap, by, "left").select(*by, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def average_precision(rows: DataFrame, totals: DataFrame, by: list[str], recall: str = "tp", hit: str = "tp", count: str | None = None) -> DataFrame:
    """(by, n, ap): 101-point AP of each group. rows: by, pred, conf; recall sums the column recall over n, precision hit over count (1)."""
    rows = rows.withColumns({"r_": F.col(recall), "h_": F.col(hit), "c_": F.col(count) if count else F.lit(1)})
    run = running_sums(rows, by, {"sr": "r_", "sh": "h_", "sc": "c_"}).join(totals, by).where("sc > 0")
    points = run.select(*by, (F.col("sr") / F.col("n")).alias("rec"), (F.col("sh") / F.col("sc")).alias("prec"))
    return totals.join(mean_over_grid(points, totals, by), by)
