"""Queries that write files from the tables, read them with the scans, and give the tables' rows again, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import scratch
from ..sinks import files as sinks
from ..sources import files as sources
from ..sources.tables import BOX_SQL, predicted_boxes, table, truth_boxes


def csv_round_trip(spark, sf_dir):
    path = scratch(spark)
    sinks.write_csv(truth_boxes(spark, sf_dir).groupBy("img", "cls").agg(F.count("*").alias("boxes")), path)
    return sources.csv_table(spark, path, "cls long, boxes long, img long").groupBy("cls").agg(F.sum("boxes").alias("boxes"), F.count("*").alias("images"))


def voc_round_trip(spark, sf_dir):
    """Labels written as annotations, and read again: clipped to a frame of 500."""
    path = scratch(spark)
    box = F.struct(*[F.col(c).alias(n) for c, n in (("x1", "xmin"), ("y1", "ymin"), ("x2", "xmax"), ("y2", "ymax"))])
    own = truth_boxes(spark, sf_dir).groupBy("img").agg(F.collect_list(F.struct(F.concat(F.lit(" c"), F.col("cls")).alias("name"), box.alias("bndbox"))).alias("object"))  # one annotation's boxes
    own.select(F.struct(F.lit(500).alias("width"), F.lit(500).alias("height")).alias("size"), "object").write.format("xml").option("rowTag", "annotation").option("rootTag", "annotations").save(path)
    return sources.voc(spark, path).groupBy("name").agg(F.count("*").alias("boxes"), F.round(F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))), 3).alias("area"))


def prediction_round_trip(spark, sf_dir):
    """Predictions of the first images as a JSON map, checked for completeness."""
    path = scratch(spark)
    pr = predicted_boxes(spark, sf_dir).where("img < 40")
    row = F.array("x1", "y1", "x2", "y2", "conf", F.col("cls").cast("double"))
    own = pr.groupBy(F.col("img").cast("string").alias("image_id")).agg(F.sort_array(F.collect_list(F.struct("pred", row.alias("r")))).alias("p"))
    doc = own.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("image_id", F.transform("p", lambda x: x["r"]))))).alias("value"))  # forty images
    doc.coalesce(1).write.text(path)
    got = sources.predictions(spark, path, pr.select(F.col("img").cast("string").alias("image_id")).distinct())
    return got.groupBy("image_id").agg(F.count("*").alias("boxes"), F.round(F.sum("conf"), 6).alias("conf"))


def label_round_trip(spark, sf_dir):
    """A data set of label files by split and image, classes remapped, and its classes counted from the files alone."""
    path = scratch(spark)
    gt = truth_boxes(spark, sf_dir)
    mid = lambda a, b: (F.col(a) + F.col(b)) / 1280
    rows = gt.select(F.when(F.col("img") % 16 < 8, "train").otherwise("val").alias("split"), F.col("img").alias("image"), F.col("cls").cast("int").alias("cls"), mid("x1", "x2").alias("cx"), mid("y1", "y2").alias("cy"), ((F.col("x2") - F.col("x1")) / 640).alias("w"), ((F.col("y2") - F.col("y1")) / 640).alias("h"))
    sinks.materialise(rows, path, ["a", "b"], {"train": "train", "val": "val"}, {0: 0, 1: 1, 3: 1})
    got = spark.read.text(f"{path}/labels")  # split and image are the folders
    names = sources.catalogue(spark, f"{path}/data.yaml")
    return got.select("split", F.split("value", " ")[0].cast("int").alias("id")).groupBy("split", "id").agg(F.count("*").alias("labels")).join(F.broadcast(names), "id").select("split", "name", "labels")


def report_round_trip(spark, sf_dir):
    """Counts as a Markdown report, and its table read again."""
    path = scratch(spark)
    counts = truth_boxes(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("boxes")).orderBy("cls")
    sinks.write_text(spark, sinks.markdown(counts, "Boxes"), path)
    rows = sources.pipe_table(spark, path, after="# Boxes").where("cells[0] <> 'cls'")
    return rows.select(F.col("cells")[0].cast("long").alias("cls"), F.col("cells")[1].cast("long").alias("boxes"))


def metrics_round_trip(spark, sf_dir):
    """Days as epochs with their mean value, and the best of them."""
    path = scratch(spark)
    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(F.round(F.avg("value"), 6).alias("val"))
    first = days.agg(F.min("d").alias("first"))
    sinks.write_csv(days.join(F.broadcast(first)).select(F.datediff(F.to_date("d"), F.to_date("first")).alias("epoch"), "val"), path)
    return sources.best_epoch(spark, path, "val").select("epochs", "best", "value")


def manifest_status(spark, sf_dir):
    """Name lists of each language, verified against the hashes that their ids give; one is missing and one differs."""
    path = scratch(spark)
    docs = table(spark, sf_dir, "documents").where("lang is not null").groupBy("lang").agg(F.array_join(F.sort_array(F.collect_list(F.lpad(F.col("doc_id").cast("string"), 9, "0"))), "\n").alias("text"))
    small = docs.where("lang <> 'es'").collect()  # a row for each language
    for r in small:
        sinks.write_text(spark, r.text, f"{path}/{r.lang}.txt")
    said = F.sha2(F.when(F.col("lang") == "de", "other").otherwise(F.col("text")), 256)
    return sources.verify_manifest(spark, path, docs.select(F.concat("lang", F.lit(".txt")).alias("path"), said.alias("sha256")))


def merge_conflicts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    new = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("+"))).otherwise(F.col("text")), 256).alias("sha256"))
    old = d.where("doc_id % 3 <> 1").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    out = sinks.merge_status(new.where("sha256 is not null"), old.where("sha256 is not null"))
    return out.groupBy("status").agg(F.count("*").alias("rows"))


_TABLE = {
    "s6_csv_round_trip": (csv_round_trip, f"with {BOX_SQL}, n as (select img, cls, count(*) b from gt group by 1, 2) select cls, sum(b)::bigint boxes, count(*) images from n group by 1"),
    "s5_voc_round_trip": (voc_round_trip, f"""with {BOX_SQL}, c as (select cls, x1, y1, least(x2, 500) x2, least(y2, 500) y2 from gt)
      select 'c' || cls as name, count(*) boxes, round(sum((x2 - x1) * (y2 - y1)), 3) area from c where x2 > x1 and y2 > y1 group by 1"""),
    "s8_prediction_round_trip": (prediction_round_trip, f"with {BOX_SQL} select img::varchar image_id, count(*) boxes, round(sum(conf), 6) conf from pr where img < 40 group by 1"),
    "k4_label_round_trip": (label_round_trip, f"""with {BOX_SQL} select case when img % 16 < 8 then 'train' else 'val' end split, case when cls = 0 then 'a' else 'b' end as name, count(*) labels from gt
        where cls in (0, 1, 3) group by 1, 2"""),
    "s14_report_round_trip": (report_round_trip, f"with {BOX_SQL} select cls, count(*) boxes from gt group by 1"),
    "s13_metrics_round_trip": (metrics_round_trip, """with d as (select ts::date d, round(avg(value), 6) v from events group by 1),
      e as (select d - (select min(d) from d) epoch, v from d)
      select max(epoch) + 1 epochs, (select epoch + 1 from e order by v desc, epoch limit 1) best, max(v) as value from e"""),
    "s17_manifest_status": (manifest_status, """select distinct lang || '.txt' path, case lang when 'es' then 'missing' when 'de' then 'differs' else 'same' end status from documents where lang is not null"""),
    "k6_merge_conflicts": (merge_conflicts, """with n as (select doc_id, sha256(case when doc_id % 5 = 0 then text || '+' else text end) n from documents where doc_id % 3 <> 0 and text is not null),
      o as (select doc_id, sha256(text) o from documents where doc_id % 3 <> 1 and text is not null)
      select case when o is null then 'new' when n is null then 'kept' when n = o then 'same' else 'conflict' end status, count(*) as \"rows\" from n full
        join o using (doc_id) group by 1"""),
}
QUERIES = {k: f for k, (f, _) in _TABLE.items()}
ORACLES = {k: s for k, (_, s) in _TABLE.items()}
