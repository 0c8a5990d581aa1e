"""Queries of the engine over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import inside, intersection, iou, iou_sql
from ..operators import similarity
from ..operators.ranking import average_precision
from ..sources.tables import BOX_SQL, predicted_boxes, table, truth_boxes

#: Same-scene cosine for these vectors, neighbours of each, and the split by id.
SCENE, NEIGHBOURS = 0.40, 10
#: Words of a run that documents and items are met on; items that are broadcast.
WORDS, FEW_ITEMS = 4, 100_000
_SPLIT = "case when vec_id % 20 < 14 then 'train' when vec_id % 20 < 17 then 'val' else 'test' end"
_COS = """with e as (select vec_id, embedding, label, {s} split from embeddings),
      p as (select a.vec_id qid, b.vec_id bid, a.split qs, b.split bs, list_dot_product(a.embedding::double[],
        b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(b.embedding::double[],
        b.embedding::double[])) sim from e a, e b where a.vec_id <> b.vec_id)""".format(s=_SPLIT)
_KNN = _COS + ", k as (select *, row_number() over (partition by qid order by round(sim, 12) desc, bid) rank from p)"


def _vectors(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding vec", "label", f"{_SPLIT} split")


def _sides(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    return e.selectExpr("vec_id qid", "vec"), e.selectExpr("vec_id bid", "vec")


def knn_join(spark, sf_dir):
    return similarity.similarity_join(*_sides(_vectors(spark, sf_dir)), k=NEIGHBOURS).select("qid", "bid", F.col("rank").cast("long").alias("rank"), F.round("sim", 6).alias("sim"))


def threshold_join(spark, sf_dir):
    return similarity.similarity_join(*_sides(_vectors(spark, sf_dir)), low=SCENE).where("qid < bid").select("qid", "bid", F.round("sim", 6).alias("sim"))


def scene_edges(spark, sf_dir) -> DataFrame:
    """Edges that either side retrieves among its nearest, at SCENE or more."""
    k = similarity.similarity_join(*_sides(_vectors(spark, sf_dir)), k=NEIGHBOURS).where(F.col("sim") >= SCENE)
    return k.select(F.least("qid", "bid").alias("a"), F.greatest("qid", "bid").alias("b")).distinct()


def scene_groups(spark, sf_dir):
    e = _vectors(spark, sf_dir).select("vec_id")
    roots = similarity.components(scene_edges(spark, sf_dir))
    return e.join(roots, F.col("vec_id") == F.col("node"), "left").select("vec_id", F.coalesce("root", "vec_id").alias("group_id"))


def leak_report(spark, sf_dir):
    """Held-out vectors with a same-scene vector in train, per split."""
    e = _vectors(spark, sf_dir)
    held, train = e.where("split <> 'train'"), e.where("split = 'train'")
    near = similarity.similarity_join(*_sides(e), k=NEIGHBOURS).where(F.col("sim") >= SCENE)
    leaked = near.join(train.select(F.col("vec_id").alias("bid")), "bid", "left_semi").select(F.col("qid").alias("vec_id")).distinct()
    return held.join(leaked.withColumn("leaked", F.lit(1)), "vec_id", "left").groupBy("split").agg(F.count("*").alias("n"), F.sum(F.coalesce("leaked", F.lit(0))).alias("leaked"))


def proximity(spark, sf_dir):
    """Mean of the three largest cosines of a held-out vector with train vectors of its own label; null without any."""
    e = _vectors(spark, sf_dir)
    train, held = e.where("split = 'train'"), e.where("split <> 'train'")
    top = similarity.similarity_join(held.selectExpr("vec_id qid", "vec", "label"), train.selectExpr("vec_id bid", "vec", "label"), k=3, on="label")
    return held.select("vec_id").join(top.groupBy(F.col("qid").alias("vec_id")).agg(F.round(F.avg("sim"), 6).alias("proximity")), "vec_id", "left")


def split_report(spark, sf_dir):
    """Vectors of each label in each split, zeros too."""
    e = _vectors(spark, sf_dir)
    n = e.groupBy("split", "label").agg(F.count("*").alias("n"))
    all_ = n.select("split").distinct().join(F.broadcast(n.select("label").distinct()))  # splits by labels
    return all_.join(n, ["split", "label"], "left").na.fill(0, ["n"])


def best_overlap(spark, sf_dir):
    """Per label the largest IoU of its class and of any class; 0 without one."""
    gt, pr = truth_boxes(spark, sf_dir).alias("g"), predicted_boxes(spark, sf_dir).alias("p")
    j = gt.join(pr, F.col("g.img") == F.col("p.img"), "left")
    own = F.when(F.col("g.cls") == F.col("p.cls"), iou("g", "p"))
    return j.groupBy("g.gt").agg(F.round(F.coalesce(F.max(own), F.lit(0.0)), 6).alias("same"), F.round(F.coalesce(F.max(iou("g", "p")), F.lit(0.0)), 6).alias("any"))


def unique_match(spark, sf_dir) -> DataFrame:
    """Matches at IoU 0.5: each prediction keeps its best label, then each label its lowest prediction."""
    gt, pr = truth_boxes(spark, sf_dir).alias("g"), predicted_boxes(spark, sf_dir).alias("p")
    j = gt.join(pr, (F.col("g.img") == F.col("p.img")) & (F.col("g.cls") == F.col("p.cls"))).select("g.gt", "p.pred", iou("g", "p").alias("iou")).where("iou >= 0.5")
    best = j.withColumn("r", F.row_number().over(Window.partitionBy("pred").orderBy(F.desc(F.round("iou", 12)), "gt"))).where("r = 1")
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("gt").orderBy("pred"))).where("r = 1")
    return best.select("gt", "pred", F.round("iou", 6).alias("iou"))


def class_ap(spark, sf_dir):
    gt, pr = truth_boxes(spark, sf_dir), predicted_boxes(spark, sf_dir)
    imgs = gt.select("img").distinct()
    flags = pr.join(imgs, "img", "left_semi").join(unique_match(spark, sf_dir).select("pred", F.lit(1).alias("m")), "pred", "left").select("cls", "pred", "conf", F.coalesce("m", F.lit(0)).alias("tp"))
    ap = average_precision(flags, gt.groupBy("cls").agg(F.count("*").alias("n")), ["cls"])
    return ap.select("cls", "n", F.round("ap", 6).alias("ap"))


def consensus(spark, sf_dir):
    """conf + 0.1 * the confidences of other predictions of the image at IoU 0.5."""
    p, q = predicted_boxes(spark, sf_dir).alias("p"), predicted_boxes(spark, sf_dir).alias("q")
    near = F.when((F.col("p.pred") != F.col("q.pred")) & (iou("p", "q") >= 0.5), F.col("q.conf")).otherwise(0.0)
    return p.join(q, F.col("p.img") == F.col("q.img")).groupBy("p.pred").agg(F.round(F.first("p.conf") + 0.1 * F.sum(near), 6).alias("score"))


def error_anatomy(spark, sf_dir):
    """Labels by what the best prediction at IoU 0.5 is: hit, other class, or no box."""
    gt, pr = truth_boxes(spark, sf_dir).alias("g"), predicted_boxes(spark, sf_dir).alias("p")
    ok = iou("g", "p") >= 0.5
    j = gt.join(pr, F.col("g.img") == F.col("p.img"), "left").groupBy("g.gt", "g.cls").agg(F.max(F.when(ok & (F.col("g.cls") == F.col("p.cls")), 2).when(ok, 1).otherwise(0)).alias("s"))
    return j.groupBy("cls").agg(F.count("*").alias("n"), *[F.sum((F.col("s") == v).cast("long")).alias(c) for c, v in (("hit", 2), ("other_class", 1), ("no_box", 0))])


def false_alarms(spark, sf_dir):
    """Predictions under IoU 0.1 with every class-0 label of their image and under half within these labels."""
    gt, pr = truth_boxes(spark, sf_dir).where("cls = 0").alias("g"), predicted_boxes(spark, sf_dir).alias("p")
    j = pr.join(gt, F.col("g.img") == F.col("p.img"), "left").groupBy("p.pred", "p.conf")
    j = j.agg(F.coalesce(F.max(iou("g", "p")), F.lit(0.0)).alias("best"), F.coalesce(F.sum(inside("p", "g")), F.lit(0.0)).alias("cover"))
    return j.where("best < 0.1 and cover < 0.5").select("pred", F.round("conf", 6).alias("conf"))


def box_stats(spark, sf_dir):
    gt = truth_boxes(spark, sf_dir)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return gt.groupBy("cls").agg(F.count("*").alias("n"), F.countDistinct("img").alias("images"), F.round(F.avg(F.log(w * h)), 6).alias("log_area"), F.round(F.avg(F.log(w / h)), 6).alias("log_aspect"), F.round(F.median(w * h), 6).alias("median_area"))


def miss_curve(spark, sf_dir):
    """Share of labels without a same-class prediction over each threshold, on a grid."""
    gt, pr = truth_boxes(spark, sf_dir).alias("g"), predicted_boxes(spark, sf_dir).alias("p")
    flag = gt.join(pr, (F.col("g.img") == F.col("p.img")) & (F.col("g.cls") == F.col("p.cls")), "left").groupBy("g.gt").agg(F.coalesce(F.max(F.when(intersection("g", "p") > 0, F.col("p.conf"))), F.lit(0.0)).alias("conf"))
    grid = flag.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(20))))
    return grid.groupBy("t").agg(F.round(F.avg((F.col("conf") < F.col("t") / 20).cast("double")), 6).alias("miss"))


def conformal_threshold(spark, sf_dir):
    """The last grid threshold before the corrected miss rate first passes 0.1; the first one if none is good."""
    n = truth_boxes(spark, sf_dir).agg(F.count("*").alias("n"))
    c = miss_curve(spark, sf_dir).join(F.broadcast(n)).withColumn("bad", (F.col("n") * F.col("miss") + 1) / (F.col("n") + 1) > 0.1)
    first = F.min(F.when(F.col("bad"), F.col("t")))
    return c.agg(F.coalesce(F.greatest(first - 1, F.lit(0)), F.max("t")).cast("long").alias("t"))


def status_crosstab(spark, sf_dir):
    """Documents of each source by what the label table says, with a row for all."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "none").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "kept").otherwise("low")
    name = F.when(F.col("whole") == 1, "all").otherwise(F.coalesce("source", F.lit("(null)")))
    return d.withColumn("status", status).rollup("source").agg(*[F.sum((F.col("status") == s).cast("long")).alias(s) for s in ("kept", "low", "toxic", "none")], F.grouping("source").alias("whole")).select(name.alias("source"), "kept", "low", "toxic", "none")


def provenance_key(spark, sf_dir):
    """The page's key: host without www. or m., and the path without query, fragment or trailing slash."""
    u = F.regexp_replace(F.lower("url"), r"^[a-z]+://(www\.|m\.)?", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), "/+$", "").alias("key"))


def contained_benchmark(spark, sf_dir):
    """Benchmark items whose whole text a document contains: documents are met on one run of WORDS inner words of the item.

    The run is the item's smallest by hash; only its hash is compared with the runs of the documents, where they are read, as long as
    the items can be broadcast. Items with fewer inner words are short; they are looked up one by one.
    """
    words = lambda text: F.split(F.col(text), r"\s+").alias("w")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"), words("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", words("text"))
    run = lambda i: F.xxhash64(F.array_join(F.slice("w", i + 1, WORDS), " "))
    runs = lambda inner: F.transform(F.sequence(F.lit(inner), F.size("w") - WORDS - inner), run)
    keyed = b.where(F.size("w") >= WORDS + 2).select("item_id", "item", F.array_min(runs(1)).alias("run"))
    few = b.count() <= FEW_ITEMS
    own = d.where(F.size("w") >= WORDS).select("doc_id", "text", F.explode(F.array_distinct(runs(0))).alias("run"))
    met = own.join(F.broadcast(keyed) if few else keyed, "run").where(F.contains("text", "item")).select("item_id", "doc_id")
    short = d.join(F.broadcast(b.where(F.size("w") < WORDS + 2).select("item_id", "item")), F.contains("text", "item")).select("item_id", "doc_id")
    return met.unionAll(short).groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


def scene_counts(spark, sf_dir):
    e = _vectors(spark, sf_dir).select("vec_id", "label")
    return scene_groups(spark, sf_dir).join(e, "vec_id").groupBy("label").agg(F.countDistinct("group_id").alias("scenes"), F.count("*").alias("vectors"))


def tie_ranks(spark, sf_dir):
    """Average and ordinal ranks of the orders of one customer by price, the two kinds used for rank correlations."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice", -4).alias("p"))
    by = Window.partitionBy("o_custkey")
    avg = F.rank().over(by.orderBy("p")) + (F.count("*").over(Window.partitionBy("o_custkey", "p")) - 1) / 2
    return o.select("o_custkey", "o_orderkey", F.round(avg, 6).alias("average_rank"), F.row_number().over(by.orderBy("p", "o_orderkey")).cast("long").alias("ordinal_rank"))


def first_copy(spark, sf_dir):
    """Documents of each exact text: the first and the number."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")


def day_counters(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


def sample_weights(spark, sf_dir):
    n = F.count("*").over(Window.partitionBy("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(1 / n, 9).alias("weight"))


_I, _P = iou_sql("g", "p"), iou_sql("p", "q")
_INT = "(greatest(least(g.x2, p.x2) - greatest(g.x1, p.x1), 0.0) * greatest(least(g.y2, p.y2) - greatest(g.y1, p.y1), 0.0))"
_MATCH = f"""{BOX_SQL}, j as (select g.gt, p.pred, {_I} iou from gt g join pr p on g.img = p.img and g.cls = p.cls where {_I} >= 0.5),
b as (select *, row_number() over (partition by pred order by round(iou, 12) desc, gt) r from j), m as (select *, row_number() over (partition by gt order by pred) r2 from b where r = 1)"""
_MISS = f"""{BOX_SQL}, f as (select g.gt, coalesce(max(case when {_INT} > 0 then p.conf end), 0.0) conf from gt g left join pr p on g.img = p.img and g.cls = p.cls group by g.gt),
      c as (select t, round(avg(case when conf < t / 20::double then 1.0::double else 0.0 end), 6) miss from f, range(21) r(t) group by t)"""
_EDGES = _KNN + f", ed as (select distinct least(qid, bid) a, greatest(qid, bid) b from k where rank <= {NEIGHBOURS} and sim >= {SCENE})"
_GROUPS = _EDGES.replace("with e as", "with recursive e as", 1) + """, r as (select vec_id, vec_id root from e union select case when r.vec_id = ed.a then ed.b else ed.a end, r.root from r join ed on r.vec_id in (ed.a, ed.b)),
      gr as (select vec_id, min(root) group_id from r group by 1)"""

_TABLE = {
    "leak_report": (leak_report, _KNN + f""", l as (select distinct qid from k where rank <= {NEIGHBOURS} and sim >= {SCENE} and bs = 'train')
      select split, count(*) n, sum(case when qid is null then 0 else 1 end)::bigint leaked from e left join l on vec_id = qid where split <> 'train' group by split"""),
    "j1_knn_join": (knn_join, _KNN + f" select qid, bid, rank, round(sim, 6) sim from k where rank <= {NEIGHBOURS}"),
    "j3_threshold_join": (threshold_join, _COS + f" select qid, bid, round(sim, 6) sim from p where qid < bid and sim >= {SCENE}"),
    "j15_proximity": (proximity, _COS + """, s as (select p.*, row_number() over (partition by qid order by sim desc, bid) r from p join e x on x.vec_id = qid join e y on y.vec_id = bid
        where x.label = y.label and p.qs <> 'train' and p.bs = 'train')
      select e.vec_id, round(avg(sim), 6) proximity from e left join s on s.qid = e.vec_id and r <= 3 where e.split <> 'train' group by 1"""),
    "g2_scene_groups": (scene_groups, _GROUPS + " select vec_id, group_id from gr"),
    "a13_scene_counts": (scene_counts, _GROUPS + " select label, count(distinct group_id) scenes, count(*) vectors from gr join e using (vec_id) group by label"),
    "a24_split_report": (split_report, f"""with e as (select {_SPLIT} split, label from embeddings)
      select split, label, count(e2.l) n from (select distinct split from e) cross join (select distinct label from e) left join (select split s, label l
        from e) e2 on e2.s = split and e2.l = label group by 1, 2"""),
    "j10_best_overlap": (best_overlap, f"""with {BOX_SQL} select g.gt, round(coalesce(max(case when g.cls = p.cls then {_I} end), 0.0), 6) same, round(coalesce(max({_I}), 0.0), 6) \"any\" from gt g left
        join pr p on g.img = p.img group by 1"""),
    "j8_unique_match": (unique_match, f"with {_MATCH} select gt, pred, round(iou, 6) iou from m where r2 = 1"),
    "a2_class_ap": (class_ap, f"""with {_MATCH}, fl as (select p.cls, p.pred, p.conf, case when m.gt is null then 0 else 1 end tp from pr p left join (select * from m where r2 = 1) m using (pred) where p.img in (select img from gt)),
n as (select cls, count(*) n from gt group by 1), rn as (select fl.cls, n.n, sum(tp) over w / n.n::double rec, sum(tp) over w / (row_number() over w)::double prec, row_number() over w k from fl join n using (cls) window w as (partition by fl.cls order by conf desc, pred)),
ev as (select *, max(prec) over (partition by cls order by k rows between current row and unbounded following) env from rn), gd as (select cls, i * 0.01::double x from n, range(101) t(i)),
pt as (select gd.cls, gd.x, coalesce(max(env), 0.0) env from gd left join ev on ev.cls = gd.cls and ev.rec >= gd.x group by 1, 2) select n.cls, n.n, round(sum(env) / 101, 6) ap from n join pt using (cls) group by 1, 2"""),
    "j17_consensus": (consensus, f"""with {BOX_SQL} select p.pred, round(any_value(p.conf) + 0.1::double * sum(case when p.pred <> q.pred and {_P} >= 0.5 then q.conf else 0.0 end), 6) score
        from pr p join pr q on p.img = q.img group by 1"""),
    "a11_error_anatomy": (error_anatomy, f"""with {BOX_SQL}, s as (select g.gt, g.cls, max(case when {_I} >= 0.5 and g.cls = p.cls then 2 when {_I} >= 0.5 then 1 else 0 end) s from gt g left
        join pr p on g.img = p.img group by 1, 2)
      select cls, count(*) n, sum((s = 2)::int)::bigint hit, sum((s = 1)::int)::bigint other_class, sum((s = 0)::int)::bigint no_box from s group by 1"""),
    "f5_false_alarms": (false_alarms, f"""with {BOX_SQL}, s as (select p.pred, p.conf, coalesce(max({_I}), 0.0) best, coalesce(sum({_INT} / ((p.x2 - p.x1) * (p.y2 - p.y1) + 1e-9)), 0.0) cover
        from pr p left join gt g on g.img = p.img and g.cls = 0 group by 1, 2)
      select pred, round(conf, 6) conf from s where best < 0.1 and cover < 0.5"""),
    "a17_box_stats": (box_stats, f"""with {BOX_SQL} select cls, count(*) n, count(distinct img) images, round(avg(ln((x2 - x1) * (y2 - y1))), 6) log_area, round(avg(ln((x2 - x1) / (y2 - y1))),
        6) log_aspect, round(median((x2 - x1) * (y2 - y1)), 6) median_area from gt group by 1"""),
    "a16_miss_curve": (miss_curve, f"with {_MISS} select t::integer t, miss from c"),
    "e8_conformal": (conformal_threshold, f"""with {_MISS}, n as (select count(*) n from gt),
      b as (select t, (n * miss + 1) / (n + 1) > 0.1 bad from c, n)
      select coalesce(greatest(min(case when bad then t end) - 1, 0), max(t)) t from b"""),
    "a12_status_crosstab": (status_crosstab, """with s as (select source, case when quality is null then 'none' when toxic = 1 then 'toxic' when quality = 1 then 'kept' else 'low' end st from documents left
        join labels using (doc_id))
      select case when grouping(source) = 1 then 'all' else coalesce(source, '(null)') end source, """ + ", ".join(f"sum((st = '{x}')::int)::bigint as \"{x}\"" for x in ("kept", "low", "toxic", "none")) + " from s group by rollup (source)"),
    "p11_provenance_key": (provenance_key, r"select page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://(www\.|m\.)?', ''), '[?#].*$', ''), '/+$', '') as key from pages"),
    "g5_contained_benchmark": (contained_benchmark, "select item_id, count(*) documents, min(doc_id) first_doc from documents d join benchmark b on contains(d.text, b.text) group by 1"),
    "w5_tie_ranks": (tie_ranks, """select o_custkey, o_orderkey, round(rank() over (partition by o_custkey order by p) + (count(*) over (partition by o_custkey, p) - 1) / 2, 6) average_rank,
        row_number() over (partition by o_custkey order by p, o_orderkey) ordinal_rank from (select o_custkey, o_orderkey, round(o_totalprice, -4) p from orders)"""),
    "w6_first_copy": (first_copy, "select sha256(text) sha, min(doc_id) first_doc, count(*) copies from documents group by 1 having count(*) > 1"),
    "i3_day_counters": (day_counters, "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) n from events group by 1, 2"),
    "r12_sample_weights": (sample_weights, "select doc_id, round(1 / count(*) over (partition by lang), 9) weight from documents"),
}
QUERIES = {k: f for k, (f, _) in _TABLE.items()}
ORACLES = {k: s for k, (_, s) in _TABLE.items()}
