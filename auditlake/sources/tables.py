"""Sources: the driver's tables, and box views derived from them by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_rows(spark: SparkSession, path: str, mode: str = "drop") -> DataFrame:
    """Label files `cls cx cy w h`, one row a box. mode: drop rows that haven't five tokens, or take the first five of longer ones."""
    t = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), t.alias("t"))
    lines = lines.where(F.size("t") == 5 if mode == "drop" else F.size("t") >= 5)
    return lines.select("file", F.col("t")[0].cast("int").alias("cls"), *[F.col("t")[i + 1].cast("double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))])


def prediction_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map {image: [[x1, y1, x2, y2, conf, cls]]} as one row a prediction; pred_idx keeps the order."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<array<double>>>").alias("m"))
    rows = doc.select(F.explode("m").alias("image_id", "preds")).select("image_id", F.posexplode("preds").alias("pred_idx", "p"))
    return rows.select("image_id", "pred_idx", *[F.col("p")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2", "conf"))], F.col("p")[5].cast("int").alias("cls"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount")
    li = li.where("l_linenumber in (1, 2)").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return li.selectExpr(
        "l_orderkey ok", "l_linenumber ln", "l_orderkey % 400 img", "l_suppkey % 5 cls", "(l_partkey * 37) % 500 x", "(l_partkey * 53) % 500 y",
        "20 + int(round(l_quantity)) w", "20 + l_partkey % 40 h", "int(round(l_tax * 100)) - 4 dx", "int(round(l_discount * 100)) - 5 dy",
    )


def truth_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, cls, gt, x1, y1, x2, y2)."""
    return _lines(spark, sf_dir).where("ln = 1 and ok % 4 = 0").selectExpr("img", "cls", "ok gt", "double(x) x1", "double(y) y1", "double(x + w) x2", "double(y + h) y2")


def predicted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, cls, pred, conf, x1, y1, x2, y2)."""
    own = _lines(spark, sf_dir).where("(ln = 1 and ok % 8 <> 0) or (ln = 2 and ok % 16 = 1)")
    return own.selectExpr("img", "cls", "ok * 10 + ln pred", "((ok * 7919 + ln * 104729) % 9973) / double(9973) conf", "double(x + dx) x1", "double(y + dy) y1", "double(x + dx + w) x2", "double(y + dy + h) y2")


#: The same views in DuckDB's SQL.
BOX_SQL = """
li as (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_tax, l_discount) rn from lineitem),
bx as (select l_orderkey ok, l_linenumber ln, l_orderkey % 400 img, l_suppkey % 5 cls, (l_partkey * 37) % 500 x, (l_partkey * 53) % 500 y,
  20 + cast(round(l_quantity) as integer) w, 20 + l_partkey % 40 h, cast(round(l_tax * 100) as integer) - 4 dx, cast(round(l_discount * 100) as integer) - 5 dy from li where rn = 1),
gt as (select img, cls, ok gt, x::double x1, y::double y1, (x + w)::double x2, (y + h)::double y2 from bx where ln = 1 and ok % 4 = 0),
pr as (select img, cls, ok * 10 + ln pred, ((ok * 7919 + ln * 104729) % 9973) / 9973::double conf, (x + dx)::double x1, (y + dy)::double y1, (x + dx + w)::double x2, (y + dy + h)::double y2
  from bx where (ln = 1 and ok % 8 <> 0) or (ln = 2 and ok % 16 = 1))"""
