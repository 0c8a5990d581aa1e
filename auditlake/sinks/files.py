"""Sinks: tables, reports, name lists, data sets and view exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """With a header, ordered by the columns; one_file: for small tables that other programs read."""
    (df.coalesce(1).sortWithinPartitions(*df.columns) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.write.mode("overwrite").json(path)


def write_names(df: DataFrame, path: str, name: str = "name") -> None:
    """One name a line, in order."""
    df.select(F.col(name).cast("string").alias("value")).orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def markdown(df: DataFrame, title: str, digits: int = 4, most: int = 1000) -> str:
    """A small table as a Markdown report; raises beyond `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")
    show = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)]) + "\n"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text file, in any file system that Spark writes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def materialise(labels: DataFrame, path: str, names: list[str], splits: dict[str, str], classes: dict[int, int] | None = None) -> None:
    """Writes a data set's label rows by split and image, and its catalogue. labels: split, image, cls, cx, cy, w, h (cls null: no label).

    classes maps old numbers to new ones; rows of others are left out. splits: name in the catalogue to the folder; only these are written.
    """
    rows = labels.where(F.col("split").isin(list(splits.values())))
    if classes is not None:
        new = F.element_at(F.create_map(*[F.lit(x) for kv in classes.items() for x in kv]), F.col("cls"))
        rows = rows.withColumn("cls", new)
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "cls", "cx", "cy", "w", "h")
    rows.where("cls is not null").select("split", "image", line.alias("value")).repartition("split", "image").sortWithinPartitions("split", "image", "value").write.mode("overwrite").partitionBy("split", "image").text(f"{path}/labels")
    rows.select("split", "image").distinct().write.mode("overwrite").parquet(f"{path}/images")
    head = "".join(f"{k}: {v}/images\n" for k, v in splits.items())
    write_text(labels.sparkSession, f"path: .\n{head}nc: {len(names)}\nnames: {json.dumps(names)}\n", f"{path}/data.yaml")


def merge_status(new: DataFrame, old: DataFrame, overwrite: bool = False) -> DataFrame:
    """(path, status): what merging files (path, sha256) into others does: new, same, replaced or, unless overwrite, conflict; kept are the old ones."""
    j = new.select("path", F.col("sha256").alias("n")).join(old.select("path", F.col("sha256").alias("o")), "path", "full")
    status = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "kept").when(F.col("n") == F.col("o"), "same").otherwise("replaced" if overwrite else "conflict")
    return j.select("path", status.alias("status"))


def export_views(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of different photos with paths under images/, the images they use): image_a, image_b, same_photo and further columns."""
    short = lambda c: F.concat(F.lit("images/"), F.regexp_replace(F.col(c), "/images/", "/"))
    real = pairs.where(F.col("same_photo").cast("string") == "0")
    used = real.select(F.explode(F.array("image_a", "image_b")).alias("image")).distinct().withColumn("target", short("image"))
    return real.withColumns({"image_a": short("image_a"), "image_b": short("image_b")}), used
