"""Scans of data-set files: images and labels, annotations, tables, catalogues, lists, reports, view graphs and manifests.

A data set is a folder with <split>/images and <split>/labels; a label file is named like its image and has rows `cls cx cy w h`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.views import MAP, none_of
from .tables import prediction_map

SIDE = 640
VOC = "size struct<width: int, height: int>, object array<struct<name: string, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"


def _part(path: Column, back: int) -> Column:
    return F.element_at(F.split(path, "/"), -back)


def _stem(path: Column) -> Column:
    return F.regexp_replace(_part(path, 1), r"\.[^.]*$", "")


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(image, split, stem, width, height) of PNG and JPEG files by their headers; other files give null sizes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = [header_size(bytes(x)) for x in b["content"]]
            yield pd.DataFrame({"image": b["path"], "width": pd.array([w for w, _ in sizes], "Int32"), "height": pd.array([h for _, h in sizes], "Int32")})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "image string, width int, height int").select("image", _part(F.col("image"), 3).alias("split"), _stem(F.col("image")).alias("stem"), "width", "height")


def header_size(data: bytes) -> tuple[int | None, int | None]:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame header
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + size
    return None, None


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """(split, stem, cls, cx, cy, w, h), one row a label; blank lines are left out."""
    t = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.input_file_name().alias("path"), t.alias("t"))
    return rows.select(_part(F.col("path"), 3).alias("split"), _stem(F.col("path")).alias("stem"), F.col("t")[0].cast("double").cast("int").alias("cls"), *[F.col("t")[i + 1].cast("double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))])


def scan(spark: SparkSession, root: str, split: str = "*", side: int | None = SIDE) -> DataFrame:
    """(image, split, stem, width, height, scale, cls, x1, y1, x2, y2): every image with its labels, one row a label; cls is null without any.

    side: the longer side that boxes are scaled to; None keeps pixels.
    """
    images, labels = image_sizes(spark, f"{root}/{split}/images"), label_files(spark, f"{root}/{split}/labels")
    scale = F.lit(1.0) if side is None else side / F.greatest("width", "height")
    at = lambda c, w, n, s: (F.col(c) + s * F.col(w) / 2) * F.col(n) * F.col("scale")
    j = images.withColumn("scale", scale).join(labels, ["split", "stem"], "left")
    return j.select("image", "split", "stem", "width", "height", "scale", "cls", at("cx", "w", "width", -1).alias("x1"), at("cy", "h", "height", -1).alias("y1"), at("cx", "w", "width", 1).alias("x2"), at("cy", "h", "height", 1).alias("y2"))


def class_rows(spark: SparkSession, path: str) -> DataFrame:
    """(split, stem, cls): the classes alone."""
    return label_files(spark, path).select("split", "stem", "cls")


def voc(spark: SparkSession, path: str, row: str = "annotation") -> DataFrame:
    """(stem, width, height, name, x1, y1, x2, y2) of annotation files, clipped to the image; degenerate boxes go, files without objects too."""
    rows = spark.read.format("xml").option("rowTag", row).schema(VOC).load(path).select(_stem(F.input_file_name()).alias("stem"), "size.width", "size.height", F.explode("object").alias("o"))
    low = lambda c: F.greatest(F.lit(0.0), F.col(f"o.bndbox.{c}"))
    high = lambda c, n: F.least(F.col(n).cast("double"), F.col(f"o.bndbox.{c}"))
    out = rows.select("stem", "width", "height", F.trim("o.name").alias("name"), low("xmin").alias("x1"), low("ymin").alias("y1"), high("xmax", "width").alias("x2"), high("ymax", "height").alias("y2"))
    return out.where("x2 > x1 and y2 > y1")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header. Columns are found by their names; those that the schema lacks are dropped, missing ones raise."""
    names = spark.read.option("header", True).csv(path).columns
    rows = spark.read.option("header", True).schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    wanted = spark.createDataFrame([], schema).schema
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(id, name): the classes of a data set's catalogue, whose names are a list, in one line or several, or a map of numbers."""
    lines = [r.value for r in spark.read.text(path, wholetext=True).collect()][0].splitlines()  # one small file
    at = next((i for i, x in enumerate(lines) if x.startswith("names:")), None)
    if at is None:
        raise ValueError("the catalogue has no names")
    bare = lambda x: x.strip().strip("'\"")
    inline = lines[at].removeprefix("names:").strip()
    if inline.startswith("["):
        names = dict(enumerate(bare(x) for x in inline.strip("[]").split(",") if x.strip()))
    elif inline.startswith("{"):
        names = {int(k): bare(v) for k, v in (x.split(":", 1) for x in inline.strip("{}").split(","))}
    else:
        names = {}
        for line in lines[at + 1 :]:
            item = re.fullmatch(r"\s*-\s+(.+)|\s+(\d+):\s*(.+)", line)
            if not item:
                break
            names[len(names) if item[1] else int(item[2])] = bare(item[1] or item[3])
    return spark.createDataFrame(sorted(names.items()), "id int, name string")


def predictions(spark: SparkSession, path: str, images: DataFrame) -> DataFrame:
    """The predictions of a JSON map {image: rows}; raises if one of the images (image_id) has no entry. An entry may be empty."""
    keys = spark.read.text(path, wholetext=True).select(F.explode(F.map_keys(F.from_json("value", "map<string, array<array<double>>>"))).alias("image_id"))
    none_of(images.select("image_id").join(keys, "image_id", "left_anti"), "images without predictions")
    return prediction_map(spark, path).join(images.select("image_id").distinct(), "image_id", "left_semi")


def matching_cache(spark: SparkSession, paths: list[str], images: DataFrame) -> str | None:
    """The first of the files whose images are exactly these."""
    want = images.select("image_id").distinct()
    for path in paths:
        keys = spark.read.text(path, wholetext=True).select(F.explode(F.map_keys(F.from_json("value", "map<string, array<array<double>>>"))).alias("image_id"))
        if not keys.join(want, "image_id", "left_anti").head(1) and not want.join(keys, "image_id", "left_anti").head(1):
            return path
    return None


def image_list(spark: SparkSession, path: str, train: str) -> DataFrame:
    """(path): a line with a slash is a path of the project, another one an image of the train folder."""
    line = F.trim("value")
    return spark.read.text(path).where(line != "").select(F.when(F.contains(line, F.lit("/")), line).otherwise(F.concat(F.lit(f"{train}/"), line)).alias("path"))


def sources(spark: SparkSession, roots: dict[str, str], side: int | None = SIDE) -> DataFrame:
    """scan() of several data sets, with a column source."""
    out = None
    for name, root in roots.items():
        own = scan(spark, root, side=side).withColumn("source", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def best_epoch(spark: SparkSession, path: str, metric: str, epoch: str = "epoch") -> DataFrame:
    """(epochs, best, value): of a CSV of metrics, whose rows without the metric don't count; the first of equal epochs."""
    rows = csv_table(spark, path, f"`{epoch}` int, `{metric}` double").toDF("epoch", "value").where("value is not null")
    best = F.max_by(F.struct("epoch", "value"), F.struct("value", (-F.col("epoch")).alias("i")))
    return rows.agg((F.max("epoch") + 1).alias("epochs"), best.alias("b")).select("epochs", (F.col("b.epoch") + 1).alias("best"), "b.value")


def pipe_table(spark: SparkSession, path: str, after: str | None = None) -> DataFrame:
    """(line, cells): the rows of the pipe tables of a Markdown file without rules; after: of the first table below that line."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))  # one document
    row = lines.where(F.trim("text").startswith("|"))
    if after is not None:
        start = lines.where(F.trim("text") == after).agg(F.min("line").alias("start"))
        gap = (F.col("line") - F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("line"))).alias("block")  # the lines of one file
        row = row.join(F.broadcast(start)).where("line > start").select("line", "text", gap)
        row = row.join(F.broadcast(row.agg(F.min("block").alias("first"))), F.col("block") == F.col("first"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("text"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    return row.select("line", cells.alias("cells")).where(~F.forall("cells", lambda x: x.rlike("^:?-+:?$")))


def view_graph(spark: SparkSession, path: str) -> DataFrame:
    """(img, src, inliers, flip, coverage and the map's numbers): a JSON map {image: [[source, inliers, flip, [[a, b, tx], [c, d, ty]], coverage]]}."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    rows = doc.select(F.explode("m").alias("img", "views")).select("img", F.explode("views").alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [json.loads(v) for v in b["v"]]
            own = [(img, str(v[0]), int(v[1]), None if v[2] is None else int(v[2]), float(v[4]), *(x for r in v[3] for x in r)) for img, v in zip(b["img"], found, strict=True) if v[3] is not None]
            yield pd.DataFrame(own, columns=["img", "src", "inliers", "flip", "coverage", *MAP]).astype({"flip": "Int32"})

    return rows.mapInPandas(run, "img string, src string, inliers int, flip int, coverage double, " + ", ".join(f"{k} double" for k in MAP))


def first_root(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists, in any file system that Spark reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return path
    raise FileNotFoundError(", ".join(paths))


def verify_manifest(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """(path, status): files against (path, sha256), paths relative to root: same, differs, missing, or unlisted."""
    name = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").removeprefix("file://").removeprefix("file:")) + "/", "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(name.alias("path"), F.sha2("content", 256).alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.lower("sha256") == F.col("found"), "same").otherwise("differs")
    return manifest.select("path", "sha256").join(files, "path", "full").select("path", status.alias("status"))


def pair_list(pairs: DataFrame, base: str, mode: str = "real") -> DataFrame:
    """Pairs (image_a, image_b, same_photo, flip, M) with another photo and a map. real: the pairs; synthetic: the images in them, once.
    Relative paths are under base."""
    full = lambda c: F.when(F.col(c).startswith("/"), F.col(c)).otherwise(F.concat(F.lit(f"{base}/"), F.col(c))).alias(c)
    some = F.coalesce(F.col("same_photo").cast("string"), F.lit("0")) == "0"
    rows = pairs.where(some & F.col("M").isNotNull() & ~F.col("M").isin("", "null", "None")).select(full("image_a"), full("image_b"), "flip", "M")
    if mode == "real":
        return rows.withColumn("M", F.from_json("M", "array<array<double>>"))
    return rows.select(F.explode(F.array("image_a", "image_b")).alias("image")).distinct()
