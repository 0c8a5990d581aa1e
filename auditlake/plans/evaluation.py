"""Queries over boxes, operating points, bootstraps, coverage and merges, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import area, intersection, iou, iou_sql
from ..operators import similarity
from ..operators.ranking import average_precision, running_sums
from ..sources.tables import BOX_SQL, predicted_boxes, table, truth_boxes
from .audit import _COS, _sides, _vectors

#: Image side of the box views; replicates and scenes of the bootstrap.
SIDE, REPLICATES, SCENES = 500, 200, 40
_BAND = "case when (x2 - x1) * (y2 - y1) < 1000 then 'small' when (x2 - x1) * (y2 - y1) < 2000 then 'medium' else 'large' end"


def _r(col, name: str, digits: int = 6):
    return F.round(col, digits).alias(name)


def _pairs(spark, sf_dir, how: str = "inner", same_class: bool = True) -> DataFrame:
    """Labels g with the predictions p of their image."""
    gt, pr = truth_boxes(spark, sf_dir).alias("g"), predicted_boxes(spark, sf_dir).alias("p")
    on = F.col("g.img") == F.col("p.img")
    return gt.join(pr, on & (F.col("g.cls") == F.col("p.cls")) if same_class else on, how)


def centre_rows(spark, sf_dir):
    """Corners to normalised centre rows, clipped to the image; boxes under a pixel go."""
    b = truth_boxes(spark, sf_dir).withColumn("x2", F.least("x2", F.lit(float(SIDE)))).withColumn("y2", F.least("y2", F.lit(float(SIDE))))
    b = b.where("x2 - x1 >= 1 and y2 - y1 >= 1")
    return b.select("gt", _r((F.col("x1") + F.col("x2")) / (2 * SIDE), "cx"), _r((F.col("y1") + F.col("y2")) / (2 * SIDE), "cy"), _r((F.col("x2") - F.col("x1")) / SIDE, "w"), _r((F.col("y2") - F.col("y1")) / SIDE, "h"))


def scaled_boxes(spark, sf_dir):
    """Boxes scaled by 1.5 about their centre, and mirrored."""
    half = lambda a, b: (F.col(b) - F.col(a)) * 0.75
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    return truth_boxes(spark, sf_dir).select(
        "gt", *[_r(mid(a, b) - half(a, b), f"s{a}") for a, b in (("x1", "x2"), ("y1", "y2"))], *[_r(mid(a, b) + half(a, b), f"s{b}") for a, b in (("x1", "x2"), ("y1", "y2"))],
        _r(SIDE - F.col("x2"), "m1"), _r(SIDE - F.col("x1"), "m2"),
    )


def affine_hull(spark, sf_dir):
    """Hulls of the four corners moved by a 2 x 3 matrix."""
    m = ((0.9, -0.2, 30.0), (0.2, 0.9, -12.0))
    corners = [(x, y) for x in ("x1", "x2") for y in ("y1", "y2")]
    moved = [[F.col(x) * a + F.col(y) * b + c for x, y in corners] for a, b, c in m]
    return truth_boxes(spark, sf_dir).select("gt", _r(F.least(*moved[0]), "hx1"), _r(F.least(*moved[1]), "hy1"), _r(F.greatest(*moved[0]), "hx2"), _r(F.greatest(*moved[1]), "hy2"))


def axis_angle(spark, sf_dir):
    """Degrees between the nearest axis and the line from the image's centre to the box's corner."""
    turned = F.pmod(F.degrees(F.atan2(F.col("y1") - SIDE / 2, F.col("x1") - SIDE / 2)), F.lit(90.0))
    return truth_boxes(spark, sf_dir).select("gt", _r(F.least(turned, 90.0 - turned), "degrees"))


def overlaps(spark, sf_dir):
    """Pairs of an image's labels that share over a tenth of the smaller box."""
    gt = truth_boxes(spark, sf_dir)
    j = gt.alias("g").join(gt.alias("p"), (F.col("g.img") == F.col("p.img")) & (F.col("g.gt") < F.col("p.gt")))
    return j.where(intersection("g", "p") > 0.1 * F.least(area("g"), area("p"))).select(F.col("g.gt").alias("a"), F.col("p.gt").alias("b"))


def class_probs(spark, sf_dir):
    """Softmax over an image's classes of the best confidence, and its geometric blend with it."""
    best = predicted_boxes(spark, sf_dir).groupBy("img", "cls").agg(F.max("conf").alias("conf"))
    e = F.exp(10 * (F.col("conf") - F.max("conf").over(Window.partitionBy("img"))))
    p = best.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy("img")))
    return p.select("img", "cls", _r(F.col("p"), "p"), _r(F.sqrt(F.col("conf") * F.col("p")), "score"))


def rerank_features(spark, sf_dir):
    n = truth_boxes(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("n"))
    c = F.least(F.greatest("conf", F.lit(1e-6)), F.lit(1 - 1e-6))
    p = predicted_boxes(spark, sf_dir).join(n, "cls", "left").select("pred", "cls", F.log(c / (1 - c)).alias("logit"), F.log1p(F.coalesce("n", F.lit(0))).alias("logn"))
    return p.select("pred", _r(F.col("logit"), "logit"), _r(F.col("logn"), "logn"), _r(F.col("logit") * F.col("logn"), "both"), *[(F.col("cls") == i).cast("int").alias(f"c{i}") for i in range(5)])


def class_thresholds(spark, sf_dir):
    """max(tau * beta / (2 - beta), floor), beta being the class's share of the most frequent class's sure predictions."""
    n = predicted_boxes(spark, sf_dir).groupBy("cls").agg(F.count_if(F.col("conf") >= 0.5).alias("n"))
    beta = F.col("n") / F.max("n").over(Window.partitionBy(F.lit(1)))  # one row a class
    return n.withColumn("beta", beta).select("cls", _r(F.greatest(0.5 * F.col("beta") / (2 - F.col("beta")), F.lit(0.25)), "threshold"))


def uncertainty(spark, sf_dir):
    u = F.coalesce(1 - F.max(F.when(F.col("conf") >= 0.05, F.col("conf"))), F.lit(1.0))
    return predicted_boxes(spark, sf_dir).groupBy("img").agg(_r(u, "uncertainty"))


def scene_rank(spark, sf_dir):
    """Scenes by mean uncertainty, ties by index."""
    s = uncertainty(spark, sf_dir).groupBy((F.col("img") % SCENES).alias("scene")).agg(_r(F.avg("uncertainty"), "mean", 5))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("mean"), "scene")).cast("long"))  # one row a scene


def grid_cells(spark, sf_dir):
    """The class of the smallest box over each grid cell's centre. Boxes are dealt to their cells: no range join."""
    cells = lambda a, b: F.filter(F.sequence(F.lit(0), F.lit(13)), lambda i: (i * 40 + 20 >= F.col(a)) & (i * 40 + 20 < F.col(b)))
    b = truth_boxes(spark, sf_dir).withColumn("ix", F.explode(cells("x1", "x2"))).withColumn("iy", F.explode(cells("y1", "y2")))
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return b.groupBy("img", "ix", "iy").agg(F.min_by("cls", F.struct(size.alias("size"), "gt")).alias("cls"))


def flip_fusion(spark, sf_dir):
    """Each prediction of one view with the best one of its class of the other view at IoU 0.5: their mean, or 0."""
    pr = predicted_boxes(spark, sf_dir)
    p, q = pr.where("pred % 20 < 10").alias("p"), pr.where("pred % 20 >= 10").alias("q")
    j = p.join(q, (F.col("p.img") == F.col("q.img")) & (F.col("p.cls") == F.col("q.cls")) & (iou("p", "q") >= 0.5), "left")
    best = F.max_by("q.conf", F.struct(F.round(iou("p", "q"), 12).alias("i"), (-F.col("q.pred")).alias("j")))
    return j.groupBy("p.pred").agg(_r(F.coalesce((F.first("p.conf") + best) / 2, F.lit(0.0)), "score"))


def click_boxes(spark, sf_dir):
    """A click in the middle of each label takes the surest prediction of its class around it, else a box of the class's median size."""
    gt = truth_boxes(spark, sf_dir)
    sizes = gt.groupBy("cls").agg(F.median(F.col("x2") - F.col("x1")).alias("mw"), F.median(F.col("y2") - F.col("y1")).alias("mh"))
    g = gt.select("gt", "img", "cls", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy")).join(sizes, "cls").alias("g")
    p = predicted_boxes(spark, sf_dir).alias("p")
    at = (F.col("g.img") == F.col("p.img")) & (F.col("g.cls") == F.col("p.cls")) & F.col("cx").between(F.col("p.x1"), F.col("p.x2")) & F.col("cy").between(F.col("p.y1"), F.col("p.y2"))
    best = g.join(p, at, "left").groupBy("g.gt", "cx", "cy", "mw", "mh").agg(F.max_by(F.struct("p.x1", "p.y1", "p.x2", "p.y2", "p.pred"), F.struct("p.conf", (-F.col("p.pred")).alias("i"))).alias("b"))
    own = lambda c, m, w, s: _r(F.coalesce(F.col(f"b.{c}"), F.col(m) + s * F.col(w) / 2), c)
    return best.select("gt", F.col("b.pred").isNotNull().cast("int").alias("detected"), own("x1", "cx", "mw", -1), own("y1", "cy", "mh", -1), own("x2", "cx", "mw", 1), own("y2", "cy", "mh", 1))


def class_deficit(spark, sf_dir):
    n = truth_boxes(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("n"))
    m = F.median("n").over(Window.partitionBy(F.lit(1)))  # one row a class
    return n.select("cls", "n", _r(F.least(F.greatest(m - F.col("n"), F.lit(0.0)), F.col("n").cast("double")), "deficit"))


def _flags(spark, sf_dir, levels: int) -> DataFrame:
    """(cls, i, pred, conf, tp) at the IoU thresholds 0.50, 0.55 and on."""
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("i")
    j = _pairs(spark, sf_dir).select("g.gt", "p.pred", iou("g", "p").alias("iou")).where("iou >= 0.5").select("*", level).where("iou >= (50 + 5 * i) / 100D")
    best = j.withColumn("r", F.row_number().over(Window.partitionBy("i", "pred").orderBy(F.desc(F.round("iou", 12)), "gt"))).where("r = 1")
    hit = best.withColumn("r", F.row_number().over(Window.partitionBy("i", "gt").orderBy("pred"))).where("r = 1").select("i", "pred", F.lit(1).alias("m"))
    pr = predicted_boxes(spark, sf_dir).join(truth_boxes(spark, sf_dir).select("img").distinct(), "img", "left_semi").select("cls", "pred", "conf", level)
    return pr.join(hit, ["i", "pred"], "left").select("cls", "i", "pred", "conf", F.coalesce("m", F.lit(0)).alias("tp"))


def mean_ap(spark, sf_dir):
    """Per class the mean AP over the thresholds 0.50 to 0.95."""
    totals = truth_boxes(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("n")).select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    return average_precision(_flags(spark, sf_dir, 10), totals, ["cls", "i"]).groupBy("cls").agg(_r(F.avg("ap"), "map"), _r(F.max(F.when(F.col("i") == 0, F.col("ap"))), "ap50"))


def operating_point(spark, sf_dir):
    """Per class the confidence of the largest F1, the first of equal ones."""
    run = running_sums(_flags(spark, sf_dir, 1).select("cls", "conf", "pred", "tp", F.lit(1).alias("one")), ["cls"], {"tps": "tp", "k": "one"})
    run = run.join(truth_boxes(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("n")), "cls").withColumn("f1", F.round(2 * F.col("tps") / (F.col("k") + F.col("n")), 12))
    return run.groupBy("cls").agg(_r(F.max("f1"), "f1"), _r(F.max_by("conf", F.struct("f1", (-F.col("k")).alias("j"))), "conf"))


def banded_sizes(spark, sf_dir):
    b = truth_boxes(spark, sf_dir).selectExpr(f"{_BAND} band", "(x2 - x1) * (y2 - y1) size")
    return b.groupBy("band").agg(F.count("*").alias("n"), _r(F.median("size"), "median_area"))


def recall_any(spark, sf_dir):
    """Share of labels that any prediction of the class meets at IoU 0.5."""
    hit = _pairs(spark, sf_dir, "left").groupBy("g.gt", "g.cls").agg(F.coalesce(F.max((iou("g", "p") >= 0.5).cast("int")), F.lit(0)).alias("hit"))
    return hit.groupBy("cls").agg(F.count("*").alias("n"), _r(F.avg("hit"), "ar50"))


def outcome_rollup(spark, sf_dir):
    """Outcomes by stratum and class, with rows for all."""
    ok = iou("g", "p") >= 0.5
    s = F.max(F.when(ok & (F.col("g.cls") == F.col("p.cls")), 2).when(ok, 1).otherwise(0)).alias("s")
    own = _pairs(spark, sf_dir, "left", False).groupBy("g.gt", "g.cls", "g.x1", "g.y1", "g.x2", "g.y2").agg(s).selectExpr(f"{_BAND} stratum", "cls", "s")
    out = own.rollup("stratum", "cls").agg(F.count("*").alias("n"), F.count_if(F.col("s") == 2).alias("agree"), F.count_if(F.col("s") == 1).alias("class_conflict"), F.grouping("stratum").alias("g"), F.grouping("cls").alias("h"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("stratum")).alias("stratum"), F.when(F.col("h") == 1, -1).otherwise(F.col("cls")).alias("cls"), "n", "agree", "class_conflict", _r(F.col("agree") / F.col("n"), "rate"))


def covered_classes(spark, sf_dir):
    """Classes with five labels or more in each of three subsets."""
    n = truth_boxes(spark, sf_dir).groupBy("cls").agg(*[F.count_if(F.col("img") % 3 == i).alias(f"n{i}") for i in range(3)])
    return n.where("least(n0, n1, n2) >= 5")


def lagged_counts(spark, sf_dir):
    """A day's count of each event type beside the day before's."""
    n = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n"))
    was = n.select(F.date_add("d", 1).alias("d"), "event_type", F.col("n").alias("before"))
    return n.join(was, ["d", "event_type"], "left").select(F.date_format("d", "yyyy-MM-dd").alias("day"), "event_type", "n", F.coalesce("before", F.lit(0)).alias("before"))


def merge_status(spark, sf_dir):
    """What merging one version of a table into another would do with each row."""
    d = table(spark, sf_dir, "documents")
    new = d.where("doc_id % 3 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("+"))).otherwise(F.col("text")), 256).alias("n"))
    old = d.where("doc_id % 3 <> 1").select("doc_id", F.sha2("text", 256).alias("o"))
    status = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "kept").when(F.col("n") == F.col("o"), "same").otherwise("replaced")
    return new.join(old, "doc_id", "full").groupBy(status.alias("status")).agg(F.count("*").alias("rows"))


def first_status(spark, sf_dir):
    """Documents by the first rule that applies."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(1).alias("bad")), "doc_id", "left")
    status = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "empty").when(F.col("bad") == 1, "toxic").when(F.length("text") < 200, "short").otherwise("kept")
    return d.groupBy(status.alias("status")).agg(F.count("*").alias("rows"))


def soft_coverage(spark, sf_dir):
    """Per label the mean over held-out vectors of the largest cosine with a train vector."""
    e = _vectors(spark, sf_dir)
    q, b = _sides(e.where("split <> 'train'"))[0], _sides(e.where("split = 'train'"))[1]
    best = similarity.similarity_join(q, b, k=1).select(F.col("qid").alias("vec_id"), "sim")
    return best.join(e.select("vec_id", "label"), "vec_id").groupBy("label").agg(F.count("*").alias("n"), _r(F.avg("sim"), "coverage"))


def capped_vote(spark, sf_dir):
    """Share of each label among the five nearest train vectors under a cap, of 64 fetched for each held-out vector."""
    e = _vectors(spark, sf_dir)
    q, b = _sides(e.where("split <> 'train'"))[0], _sides(e.where("split = 'train'"))[1]
    near = similarity.similarity_join(q, b, k=64).where(F.round("sim", 9) <= 0.35)
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where("r <= 5")
    n = near.join(e.select(F.col("vec_id").alias("bid"), "label"), "bid").groupBy("qid", "label").agg(F.count("*").alias("n"))
    return n.select("qid", "label", _r(F.col("n") / F.sum("n").over(Window.partitionBy("qid")), "share"))


def closest_pairs(spark, sf_dir):
    """The twelve closest pairs of a held-out and a train vector."""
    e = _vectors(spark, sf_dir)
    found = similarity.similarity_join(_sides(e.where("split <> 'train'"))[0], _sides(e.where("split = 'train'"))[1], k=12)
    return found.select("qid", "bid", _r(F.col("sim"), "sim")).orderBy(F.desc("sim"), "qid", "bid").limit(12)


def _recall_draws(spark, sf_dir) -> DataFrame:
    """(rep, cls, recall): recall over scenes drawn with replacement. Labels are summed by scene before they meet the draws."""
    hit = _pairs(spark, sf_dir, "left").groupBy("g.gt", "g.cls", "g.img").agg(F.coalesce(F.max((iou("g", "p") >= 0.5).cast("int")), F.lit(0)).alias("hit"))
    scenes = hit.groupBy((F.col("img") % SCENES).alias("scene"), "cls").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    draws = spark.range(REPLICATES).selectExpr("id rep", f"explode(sequence(0, {SCENES - 1})) j").selectExpr("rep", f"((rep * 7919 + j * 104729 + rep * j * 31) % 9973) % {SCENES} scene")
    weights = draws.groupBy("rep", "scene").agg(F.count("*").alias("w"))
    return scenes.join(weights, "scene").groupBy("rep", "cls").agg((F.sum(F.col("w") * F.col("hits")) / F.sum(F.col("w") * F.col("n"))).alias("recall"))


def bootstrap_interval(spark, sf_dir):
    q = F.percentile("recall", F.array(F.lit(0.025), F.lit(0.975)))
    out = _recall_draws(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("reps"), F.avg("recall").alias("m"), q.alias("q"))
    return out.select("cls", "reps", _r(F.col("m"), "mean"), _r(F.col("q")[0], "low"), _r(F.col("q")[1], "high"))


def paired_difference(spark, sf_dir):
    """Each class against class 0 on the same draws: mean difference and the share of draws without a gain."""
    d = _recall_draws(spark, sf_dir)
    j = d.where("cls > 0").join(d.where("cls = 0").select("rep", F.col("recall").alias("base")), "rep").withColumn("d", F.round(F.col("recall") - F.col("base"), 12))
    return j.groupBy("cls").agg(_r(F.avg("d"), "difference"), _r(F.avg((F.col("d") <= 0).cast("int")), "p_not_better"))


def wasserstein(spark, sf_dir):
    """Distance between the sizes of labels and of predictions, per class: the area between their distribution functions."""
    size = ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("v")
    both = truth_boxes(spark, sf_dir).select("cls", size, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(predicted_boxes(spark, sf_dir).select("cls", size, F.lit(0), F.lit(1)))
    at = both.groupBy("cls", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))  # equal sizes meet before the window
    w, full = Window.partitionBy("cls").orderBy("v"), Window.partitionBy("cls")
    run = lambda c: F.sum(c).over(w) / F.sum(c).over(full)
    return at.select("cls", (F.abs(run("a") - run("b")) * (F.lead("v").over(w) - F.col("v"))).alias("d")).groupBy("cls").agg(_r(F.sum("d"), "distance", 4))


def group_prefixes(spark, sf_dir):
    """Labels and class-0 labels up to each scene, in a fixed shuffled order of the scenes."""
    s = truth_boxes(spark, sf_dir).groupBy((F.col("img") % SCENES).alias("scene")).agg(F.count("*").alias("n"), F.count_if(F.col("cls") == 0).alias("c0"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("scene") * 7919 % 9973)  # one row a scene
    return s.select("scene", F.sum("n").over(w).alias("labels"), F.sum("c0").over(w).alias("labels0"))


def unlabelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


def key_sets(spark, sf_dir):
    """Sizes of the union, the intersection and both differences of two tables' keys."""
    a = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("a")).distinct()
    b = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("b")).distinct()
    j = a.join(b, "doc_id", "full")
    return j.agg(F.count("*").alias("either"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"))


_G, _PQ, _GP = iou_sql("g", "p"), iou_sql("p", "q"), "(greatest(least(g.x2, p.x2) - greatest(g.x1, p.x1), 0.0) * greatest(least(g.y2, p.y2) - greatest(g.y1, p.y1), 0.0))"
_SAME = "g.img = p.img and g.cls = p.cls"
_FLAGS = f"""{BOX_SQL}, t as (select i, (50 + 5 * i) / 100::double th from range({{levels}}) r(i)), n as (select cls, count(*) n from gt group by 1),
j as (select g.gt, p.pred, i, {_G} iou from gt g join pr p on {_SAME} join t on {_G} >= th), b as (select *, row_number() over (partition by i, pred order by round(iou, 12) desc, gt) r from j),
m as (select *, row_number() over (partition by i, gt order by pred) r2 from b where r = 1),
fl as (select p.cls, t.i, p.pred, p.conf, case when m.gt is null then 0 else 1 end tp from pr p cross join t left join m on m.pred = p.pred and m.i = t.i and m.r2 = 1 where p.img in (select img from gt)),
k as (select cls, i, conf, sum(tp) over w tps, row_number() over w kk from fl window w as (partition by cls, i order by conf desc, pred))"""
_UNC = f"{BOX_SQL}, u as (select img, round(coalesce(1 - max(case when conf >= 0.05 then conf end), 1.0), 6) uncertainty from pr group by 1)"
_HELD = _COS + ", h as (select *, row_number() over (partition by qid order by round(sim, 12) desc, bid) r from p where qs <> 'train' and bs = 'train')"
_DRAWS = f"""{BOX_SQL}, hit as (select g.gt, g.cls, g.img, coalesce(max(case when {_G} >= 0.5 then 1 else 0 end), 0) hit from gt g left join pr p on {_SAME} group by 1, 2, 3),
dr as (select rep, ((rep * 7919 + j * 104729 + rep * j * 31) % 9973) % {SCENES} scene from range({REPLICATES}) a(rep), range({SCENES}) b(j)),
rc as (select rep, cls, sum(hit) / count(*)::double recall from hit join dr on hit.img % {SCENES} = dr.scene group by 1, 2)"""

_TABLE = {
    "p4_centre_rows": (centre_rows, f"""with {BOX_SQL}, c as (select gt, x1, y1, least(x2, {SIDE}) x2, least(y2, {SIDE}) y2 from gt)
      select gt, round((x1 + x2) / {2 * SIDE}, 6) cx, round((y1 + y2) / {2 * SIDE}, 6) cy, round((x2 - x1) / {SIDE}, 6) w, round((y2 - y1) / {SIDE}, 6) h
        from c where x2 - x1 >= 1 and y2 - y1 >= 1"""),
    "p5_scaled_boxes": (scaled_boxes, f"""with {BOX_SQL} select gt, round(x1 * 1.25 - x2 * 0.25, 6) sx1, round(y1 * 1.25 - y2 * 0.25, 6) sy1, round(x2 * 1.25 - x1 * 0.25, 6) sx2,
        round(y2 * 1.25 - y1 * 0.25, 6) sy2, {SIDE} - x2 m1, {SIDE} - x1 m2 from gt"""),
    "p6_affine_hull": (affine_hull, f"""with {BOX_SQL} select gt, round(0.9 * x1 - 0.2 * y2 + 30, 6) hx1, round(0.2 * x1 + 0.9 * y1 - 12, 6) hy1, round(0.9 * x2 - 0.2 * y1 + 30, 6) hx2,
        round(0.2 * x2 + 0.9 * y2 - 12, 6) hy2 from gt"""),
    "p8_axis_angle": (axis_angle, f"with {BOX_SQL}, a as (select gt, degrees(atan2(y1 - {SIDE / 2}, x1 - {SIDE / 2})) + 360 d from gt) select gt, round(least(d % 90, 90 - d % 90), 6) degrees from a"),
    "p9_overlaps": (overlaps, f"""with {BOX_SQL} select g.gt a, p.gt b from gt g join gt p on g.img = p.img and g.gt < p.gt where {_GP} > 0.1::double * least((g.x2 - g.x1) * (g.y2 - g.y1),
        (p.x2 - p.x1) * (p.y2 - p.y1))"""),
    "p14_class_probs": (class_probs, f"""with {BOX_SQL}, b as (select img, cls, max(conf) conf from pr group by 1, 2),
      e as (select *, exp(10 * conf) / sum(exp(10 * conf)) over (partition by img) p from b)
      select img, cls, round(p, 6) p, round(sqrt(conf * p), 6) score from e"""),
    "p15_rerank_features": (rerank_features, f"""with {BOX_SQL}, n as (select cls, count(*) n from gt group by 1),
      f as (select pred, cls, ln(c / (1 - c)) l, ln(1 + coalesce(n, 0)) q from (select *, least(greatest(conf, 1e-6), 1 - 1e-6) c from pr) left join n using (cls))
      select pred, round(l, 6) logit, round(q, 6) logn, round(l * q, 6) \"both\", """ + ", ".join(f"(cls = {i})::int c{i}" for i in range(5)) + " from f"),
    "p16_class_thresholds": (class_thresholds, f"""with {BOX_SQL}, n as (select cls, sum((conf >= 0.5)::int)::double n from pr group by 1),
      b as (select cls, n / (select max(n) from n) b from n)
      select cls, round(greatest(0.5 * b / (2 - b), 0.25), 6) threshold from b"""),
    "p17_uncertainty": (uncertainty, f"with {_UNC} select img, uncertainty from u"),
    "t5_scene_rank": (scene_rank, f"""with {_UNC}, s as (select img % {SCENES} scene, round(avg(uncertainty), 5) mean from u group by 1)
      select scene, mean, row_number() over (order by mean desc, scene) rank from s"""),
    "p21_grid_cells": (grid_cells, f"""with {BOX_SQL}, c as (select img, ix::int ix, iy::int iy, cls, row_number() over (partition by img, ix, iy order by (x2 - x1) * (y2 - y1), gt) r from gt,
        range(14) a(ix), range(14) b(iy) where ix * 40 + 20 >= x1 and ix * 40 + 20 < x2 and iy * 40 + 20 >= y1 and iy * 40 + 20 < y2)
      select img, ix, iy, cls from c where r = 1"""),
    "j11_flip_fusion": (flip_fusion, f"""with {BOX_SQL}, b as (select p.pred, p.conf, q.conf qc, row_number() over (partition by p.pred order by round({_PQ}, 12) desc, q.pred) r from pr p left
        join pr q on p.img = q.img and p.cls = q.cls and q.pred % 20 >= 10 and {_PQ} >= 0.5 where p.pred % 20 < 10)
      select pred, round(coalesce((conf + qc) / 2, 0.0), 6) score from b where r = 1"""),
    "j12_click_boxes": (click_boxes, f"""with {BOX_SQL}, s as (select cls, median(x2 - x1) mw, median(y2 - y1) mh from gt group by 1),
      g as (select gt, img, cls, (x1 + x2) / 2 cx, (y1 + y2) / 2 cy, mw, mh from gt join s using (cls)),
      b as (select g.*, p.pred, p.x1, p.y1, p.x2, p.y2, row_number() over (partition by gt order by p.conf desc, p.pred) r from g left join pr p on {_SAME}
        and cx between p.x1 and p.x2 and cy between p.y1 and p.y2)
      select gt, (pred is not null)::int detected, round(coalesce(x1, cx - mw / 2), 6) x1, round(coalesce(y1, cy - mh / 2), 6) y1, round(coalesce(x2, cx + mw / 2),
        6) x2, round(coalesce(y2, cy + mh / 2), 6) y2 from b where r = 1"""),
    "a1_class_deficit": (class_deficit, f"""with {BOX_SQL}, n as (select cls, count(*) n from gt group by 1)
      select cls, n, least(greatest((select median(n) from n) - n, 0.0), n::double) deficit from n"""),
    "a3_mean_ap": (mean_ap, f"""with {_FLAGS.format(levels=10)}, q as (select k.cls, i, kk, tps / n::double rec, tps / kk::double prec from k join n using (cls)),
      e as (select cls, i, rec, max(prec) over (partition by cls, i order by kk desc rows unbounded preceding) env from q),
      v as (select n.cls, t.i, x, coalesce(max(env), 0.0) v from n cross join t cross join range(101) g(x) left join e on e.cls = n.cls and e.i = t.i
        and e.rec >= x * 0.01::double group by 1, 2, 3),
      a as (select cls, i, sum(v) / 101 ap from v group by 1, 2)
      select cls, round(avg(ap), 6) map, round(max(case when i = 0 then ap end), 6) ap50 from a group by 1"""),
    "a10_operating_point": (operating_point, f"""with {_FLAGS.format(levels=1)}, f as (select cls, conf, kk, round(2 * tps / (kk + n)::double, 12) f1 from k join n using (cls)),
      r as (select *, row_number() over (partition by cls order by f1 desc, kk) r from f)
      select cls, round(f1, 6) f1, round(conf, 6) conf from r where r = 1"""),
    "a19_banded_sizes": (banded_sizes, f"with {BOX_SQL} select {_BAND} band, count(*) n, median((x2 - x1) * (y2 - y1)) median_area from gt group by 1"),
    "a26_recall_any": (recall_any, f"with {BOX_SQL} select g.cls, count(*) n, round(avg(exists (select 1 from pr p where {_SAME} and {_G} >= 0.5)::int), 6) ar50 from gt g group by 1"),
    "a20_outcome_rollup": (outcome_rollup, f"""with {BOX_SQL}, s as (select g.gt, g.cls, g.x1, g.x2, g.y1, g.y2, max(case when {_G} >= 0.5 and g.cls = p.cls then 2 when {_G} >= 0.5 then 1 else 0 end) s
        from gt g left join pr p on g.img = p.img group by all),
      o as (select {_BAND} stratum, cls, s from s)
      select case when grouping(stratum) = 1 then 'all' else stratum end stratum, case when grouping(cls) = 1 then -1 else cls end cls, count(*) n,
        sum((s = 2)::int)::bigint agree, sum((s = 1)::int)::bigint class_conflict, round(avg((s = 2)::int), 6) rate from o group by rollup (stratum, cls)"""),
    "f8_covered_classes": (covered_classes, f"with {BOX_SQL} select cls, " + ", ".join(f"sum((img % 3 = {i})::int)::bigint n{i}" for i in range(3)) + " from gt group by 1 having least(n0, n1, n2) >= 5"),
    "i2_lagged_counts": (lagged_counts, """with n as (select ts::date d, event_type, count(*) n from events group by 1, 2)
      select strftime(a.d, '%Y-%m-%d') as day, a.event_type, a.n, coalesce(b.n, 0) before from n a left join n b on b.d + 1 = a.d and a.event_type = b.event_type"""),
    "k6_merge_status": (merge_status, """with n as (select doc_id, sha256(case when doc_id % 5 = 0 then text || '+' else text end) n from documents where doc_id % 3 <> 0),
      o as (select doc_id, sha256(text) o from documents where doc_id % 3 <> 1)
      select case when o is null then 'new' when n is null then 'kept' when n = o then 'same' else 'replaced' end status, count(*) as \"rows\" from n full
        join o using (doc_id) group by 1"""),
    "f3_first_status": (first_status, """select case when coalesce(length(text), 0) = 0 then 'empty' when l.toxic = 1 then 'toxic' when length(text) < 200 then 'short' else 'kept' end status,
        count(*) as \"rows\" from documents d left join labels l on l.doc_id = d.doc_id and l.toxic = 1 group by 1"""),
    "a18_soft_coverage": (soft_coverage, _HELD + " select label, count(*) n, round(avg(sim), 6) coverage from h join e on vec_id = qid where r = 1 group by 1"),
    "j16_capped_vote": (capped_vote, _HELD + """, c as (select *, row_number() over (partition by qid order by r) r2 from h where r <= 64 and round(sim, 9) <= 0.35),
      n as (select qid, label, count(*) n from c join e on vec_id = bid where r2 <= 5 group by 1, 2)
      select qid, label, round(n / sum(n) over (partition by qid), 6) share from n"""),
    "t2_closest_pairs": (closest_pairs, _HELD + " select qid, bid, round(sim, 6) sim from h order by 3 desc, 1, 2 limit 12"),
    "r7_bootstrap_interval": (bootstrap_interval, f"""with {_DRAWS} select cls, count(*) reps, round(avg(recall), 6) mean, round(quantile_cont(recall, 0.025), 6) low, round(quantile_cont(recall, 0.975), 6) high
        from rc group by 1"""),
    "r9_paired_difference": (paired_difference, f"""with {_DRAWS}, d as (select a.cls, round(a.recall - b.recall, 12) d from rc a join rc b using (rep) where a.cls > 0 and b.cls = 0)
      select cls, round(avg(d), 6) difference, round(avg((d <= 0)::int), 6) p_not_better from d group by 1"""),
    "e6_wasserstein": (wasserstein, f"""with {BOX_SQL}, s as (select cls, (x2 - x1) * (y2 - y1) v, 1 a, 0 b from gt
      union all select cls, (x2 - x1) * (y2 - y1), 0, 1 from pr),
      c as (select cls, v, sum(sum(a)) over w / sum(sum(a)) over (partition by cls) fa, sum(sum(b)) over w / sum(sum(b)) over (partition by cls) fb,
        lead(v) over w nv from s group by cls, v window w as (partition by cls order by v))
      select cls, round(sum(abs(fa - fb) * (nv - v)), 4) distance from c group by 1"""),
    "w8_group_prefixes": (group_prefixes, f"""with {BOX_SQL}, s as (select img % {SCENES} scene, count(*) n, sum((cls = 0)::int) c0 from gt group by 1)
      select scene, sum(n) over w::bigint labels, sum(c0) over w::bigint labels0 from s window w as (order by scene * 7919 % 9973)"""),
    "u3_unlabelled": (unlabelled, "select doc_id from documents where doc_id not in (select doc_id from labels)"),
    "u4_key_sets": (key_sets, """with a as (select distinct doc_id from documents),
      b as (select distinct doc_id from labels)
      select count(*) either, sum((a.doc_id is not null and b.doc_id is not null)::int)::bigint \"both\", sum((b.doc_id is null)::int)::bigint left_only,
        sum((a.doc_id is null)::int)::bigint right_only from a full join b on a.doc_id = b.doc_id"""),
}
QUERIES = {k: f for k, (f, _) in _TABLE.items()}
ORACLES = {k: s for k, (_, s) in _TABLE.items()}
