"""Queries over boxes: sequential matching, average precision in its variants, regions, outcomes and views, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import area, inside, intersection, iou, iou_sql
from ..operators import matching, similarity
from ..operators.ranking import average_precision, mean_over_grid
from ..sources.tables import BOX_SQL, predicted_boxes, truth_boxes

#: Image side; raster cell; finer raster of a label; replicates; scenes; score of a hit and predictions in the top list.
SIDE, CELL, FINE, REPLICATES, SCENES, SURE, TOP = 500, 20, 16, 20, 40, 0.5, 20
#: Labels closer than this touch; a region's boxes fill this share of its hull.
GAP, FILL = 8, 0.6


def _r(col, name: str, digits: int = 6) -> Column:
    return F.round(col, digits).alias(name)


def _boxes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return truth_boxes(spark, sf_dir), predicted_boxes(spark, sf_dir)


def _labelled(gt: DataFrame, pr: DataFrame) -> DataFrame:
    return pr.join(gt.select("img").distinct(), "img", "left_semi")


def greedy_match(spark, sf_dir):
    """Predictions by the number of the ten thresholds at which they take a label, in order of confidence."""
    gt, pr = _boxes(spark, sf_dir)
    hits = matching.greedy_match(gt, pr).groupBy("pred").agg(F.count("*").alias("hits"), F.max((F.col("i") == 0).cast("int")).alias("tp50"))
    none = F.lit(0).cast("long")
    return _labelled(gt, pr).join(hits, "pred", "left").select("pred", F.coalesce("hits", none).alias("hits"), F.coalesce("tp50", F.lit(0)).alias("tp50"))


def suppression(spark, sf_dir):
    return matching.suppress(predicted_boxes(spark, sf_dir), top=TOP).select("pred")


def tolerant_match(spark, sf_dir):
    gt, pr = _boxes(spark, sf_dir)
    return matching.tolerant_match(gt, pr)


def weighted_ap(spark, sf_dir):
    """AP of tolerant matches: recall counts labels, precision predictions; fragments of found labels don't count."""
    gt, pr = _boxes(spark, sf_dir)
    rows = _labelled(gt, pr).select("cls", "pred", "conf").join(matching.tolerant_match(gt, pr), "pred", "left").na.fill({"weight": 0, "tp": 0, "keep": 1})
    ap = average_precision(rows.where("keep = 1"), gt.groupBy("cls").agg(F.count("*").alias("n")), ["cls"], recall="weight")
    return ap.select("cls", "n", _r(F.col("ap"), "ap"))


def _flags(gt: DataFrame, pr: DataFrame) -> DataFrame:
    """(img, cls, pred, conf, tp) at the threshold 0.5."""
    hit = matching.greedy_match(gt, pr, (0.5,)).select("pred", F.lit(1).alias("tp"))
    return _labelled(gt, pr).select("img", "cls", "pred", "conf").join(hit, "pred", "left").na.fill({"tp": 0})


def _draws(spark, groups: int, step: int, salt: int = 0) -> DataFrame:
    """(rep, unit, w): how often each of the groups 0, step, ... is drawn, with replacement, in each replicate."""
    at = f"((rep * 7919 + (j + {salt}) * 104729 + rep * (j + {salt}) * 31) % 9973) % {groups}"
    draws = spark.range(REPLICATES).selectExpr("id rep", f"explode(sequence(0, {groups - 1})) j").selectExpr("rep", f"{step} * ({at}) unit")
    return draws.groupBy("rep", "unit").agg(F.count("*").alias("w"))


def _replicated(flags: DataFrame, gt: DataFrame, draws: DataFrame, unit: Column) -> DataFrame:
    """(rep, map50): mean over classes of the AP with images weighted by the draws. Only multiplicities meet the rows."""
    weigh = lambda rows: rows.withColumn("unit", unit).join(F.broadcast(draws), "unit")
    totals = weigh(gt.select("img", "cls")).groupBy("rep", "cls").agg(F.sum("w").alias("n"))
    rows = weigh(flags).withColumn("hit", F.col("w") * F.col("tp"))
    return average_precision(rows, totals, ["rep", "cls"], recall="hit", hit="hit", count="w").groupBy("rep").agg(F.avg("ap").alias("map50"))


def image_weighted_ap(spark, sf_dir):
    gt, pr = _boxes(spark, sf_dir)
    return _replicated(_flags(gt, pr), gt, _draws(spark, 100, 4), F.col("img")).select("rep", _r(F.col("map50"), "map50"))


def _interval(reps: DataFrame, name: str) -> DataFrame:
    q = F.percentile(name, F.array(F.lit(0.025), F.lit(0.975)))
    return reps.agg(F.count("*").alias("reps"), F.avg(name).alias("m"), q.alias("q")).select("reps", _r(F.col("m"), "mean"), _r(F.col("q")[0], "low"), _r(F.col("q")[1], "high"))


def image_interval(spark, sf_dir):
    gt, pr = _boxes(spark, sf_dir)
    return _interval(_replicated(_flags(gt, pr), gt, _draws(spark, 100, 4), F.col("img")), "map50")


def scene_interval(spark, sf_dir):
    """The same with whole scenes drawn."""
    gt, pr = _boxes(spark, sf_dir)
    return _interval(_replicated(_flags(gt, pr), gt, _draws(spark, 10, 4), F.col("img") % SCENES), "map50")


def interaction(spark, sf_dir):
    """Gain of all predictions over the first ones alone, in two subsets of images resampled apart, and the difference of the gains."""
    gt, pr = _boxes(spark, sf_dir)
    own = []
    for k, salt in ((0, 0), (4, 50)):
        part = gt.where(f"img % 8 = {k}")
        reps = [_replicated(_flags(part, p), part, _draws(spark, 50, 8, salt).withColumn("unit", F.col("unit") + k), F.col("img")) for p in (pr, pr.where("pred % 10 = 1"))]
        own.append(reps[0].join(reps[1].withColumnRenamed("map50", "base"), "rep").select("rep", F.round(F.col("map50") - F.col("base"), 12).alias(f"d{k}")))
    both = own[0].join(own[1], "rep").withColumn("x", F.col("d0") - F.col("d4"))
    return both.agg(_r(F.avg("d0"), "gain_a"), _r(F.avg("d4"), "gain_b"), _r(F.avg("x"), "interaction"), _r(F.avg((F.col("x") > 0).cast("int")), "p_positive"))


def trapezoid_ap(spark, sf_dir):
    """Area under the linearly interpolated envelope of precision over recall, by the trapezoid rule on the 101 points."""
    from pyspark.sql import Window

    from ..operators.ranking import running_sums

    gt, pr = _boxes(spark, sf_dir)
    totals = gt.groupBy("cls").agg(F.count("*").alias("n"))
    run = running_sums(_flags(gt, pr).withColumn("one", F.lit(1)), ["cls"], {"tps": "tp", "k": "one"}).join(totals, "cls")
    steps = run.groupBy("cls", (F.col("tps") / F.col("n")).alias("rec")).agg(F.max(F.col("tps") / F.col("k")).alias("top"), F.min(F.col("tps") / F.col("k")).alias("low"))
    ends = totals.select("cls", F.explode(F.array(*[F.struct(F.lit(r).alias("rec"), F.lit(t).alias("top"), F.lit(0.0).alias("low")) for r, t in ((0.0, 1.0), (1.0, 0.0))])).alias("e")).select("cls", "e.*")
    points = steps.unionAll(ends).groupBy("cls", "rec").agg(F.max("top").alias("top"), F.min("low").alias("low"))
    down = Window.partitionBy("cls").orderBy(F.desc("rec"))  # one row for each label that is found
    points = points.select("cls", "rec", F.max("top").over(down).alias("first"), F.coalesce(F.lead("rec").over(Window.partitionBy("cls").orderBy("rec")), F.lit(9.0)).alias("next"), "low")
    after = F.coalesce(F.lag("first").over(down), F.lit(0.0))
    points = points.withColumn("after", after).withColumn("last", F.when(F.col("rec") >= 1, 0.0).otherwise(F.greatest("low", "after")))
    grid = points.withColumn("x", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: i * F.lit(0.01)), lambda x: (x >= F.col("rec")) & (x < F.col("next")))))
    y = F.when(F.col("next") > 1, F.col("last")).otherwise(F.col("last") + (F.col("x") - F.col("rec")) / (F.col("next") - F.col("rec")) * (F.col("after") - F.col("last")))
    weight = F.when((F.col("x") == 0) | (F.col("x") >= 1), 0.005).otherwise(0.01)
    return grid.groupBy("cls").agg(_r(F.sum(y * weight), "ap", 5))


def _cells(rows: DataFrame, by_round: bool = True) -> DataFrame:
    """Adds ix, iy of the raster cells of each box: by its rounded edges, or the cells whose centres it holds."""
    n = SIDE // CELL
    if by_round:
        edge = lambda c: F.least(F.greatest(F.bround(F.col(c) / CELL), F.lit(0)), F.lit(n)).cast("int")
        span = lambda a, b: F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i >= edge(a)) & (i < edge(b)))
    else:
        span = lambda a, b: F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i * CELL + CELL / 2 >= F.col(a)) & (i * CELL + CELL / 2 <= F.col(b)))
    return rows.withColumn("ix", F.explode(span("x1", "x2"))).withColumn("iy", F.explode(span("y1", "y2")))


def region_ap(spark, sf_dir):
    """AP of the union of predicted boxes as raster cells, at twenty thresholds: a cell is predicted from its surest box down."""
    gt, pr = _boxes(spark, sf_dir)
    at = ["img", "cls", "ix", "iy"]
    g = _cells(gt).select(*at).distinct().withColumn("g", F.lit(1))
    p = _cells(pr).groupBy(*at).agg(F.floor(F.max("conf") * 20).alias("t"))
    cells = g.join(p, at, "full").groupBy("cls", F.coalesce("t", F.lit(-1)).alias("t")).agg(F.count_if(F.col("t").isNotNull()).alias("p"), F.sum(F.when(F.col("t").isNotNull(), F.col("g"))).alias("i"), F.sum("g").alias("g"))
    grid = cells.select("cls").distinct().select("cls", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    sums = grid.join(cells, "cls").groupBy("cls", "k").agg(*[F.coalesce(F.sum(F.when(F.col("t") >= F.col("k"), F.col(c))), F.lit(0)).alias(c) for c in "pi"], F.coalesce(F.sum("g"), F.lit(0)).alias("g"))
    points = sums.where("g > 0").select("cls", (F.col("i") / F.col("g")).alias("rec"), F.when(F.col("p") > 0, F.col("i") / F.col("p")).otherwise(1.0).alias("prec"))
    return mean_over_grid(points, gt.select("cls").distinct(), ["cls"]).select("cls", _r(F.col("ap"), "ap"))


def region_f1(spark, sf_dir):
    """Per image the mean over the classes present of F1 between the rasters of labels and of sure predictions."""
    gt, pr = _boxes(spark, sf_dir)
    at = ["img", "cls", "ix", "iy"]
    g, p = (_cells(x, False).select(*at).distinct().withColumn(c, F.lit(1)) for x, c in ((gt, "g"), (pr.where(F.col("conf") >= SURE), "p")))
    counts = g.join(p, at, "full").groupBy("img", "cls").agg(F.count("g").alias("g"), F.count("p").alias("p"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"))
    return counts.groupBy("img").agg(_r(F.avg(2 * F.col("tp") / (F.col("g") + F.col("p"))), "f1"))


def histogram_ap(spark, sf_dir):
    """AP from counts in a hundred bins of the log score: bounded memory, no sort of the rows."""
    gt, pr = _boxes(spark, sf_dir)
    from pyspark.sql import Window

    place = F.least(F.floor(F.round((F.greatest(F.log(F.greatest("conf", F.lit(1e-30))), F.lit(-8.0)) + 8) / 8 * 100, 9)), F.lit(99))
    bins = _flags(gt, pr).groupBy("cls", place.alias("bin")).agg(F.sum("tp").alias("tp"), F.count("*").alias("n"))
    w = Window.partitionBy("cls").orderBy(F.desc("bin"))  # a hundred rows
    whole = F.sum("tp").over(Window.partitionBy("cls"))
    parts = bins.select("cls", (F.sum("tp").over(w) / F.sum("n").over(w) * F.col("tp") / whole).alias("x"))
    return parts.groupBy("cls").agg(_r(F.sum("x"), "ap"))


def anatomy(spark, sf_dir):
    """Labels by outcome: a sure hit, a hit ranked low, another class only, no box; the share in the image's top list; scores and ranks of low hits."""
    from pyspark.sql import Window

    gt, pr = _boxes(spark, sf_dir)
    pr = pr.withColumn("place", F.row_number().over(Window.partitionBy("img").orderBy(F.desc("conf"), "pred")))
    g, p = gt.alias("g"), pr.alias("p")
    near = g.join(p, (F.col("g.img") == F.col("p.img")) & (iou("g", "p") >= 0.5)).select("g.gt", (F.col("g.cls") == F.col("p.cls")).alias("same"), F.col("p.cls").alias("pc"), "p.conf", "p.place")
    best = near.where("same").groupBy("gt").agg(F.max("conf").alias("s"), F.min("place").alias("place"))
    rank = near.join(best.select("gt", "s"), "gt").where("conf > s").groupBy("gt").agg((1 + F.countDistinct("pc")).alias("rank"))
    any_ = near.select("gt").distinct().withColumn("some", F.lit(True))
    rows = gt.select("gt", "cls").join(best, "gt", "left").join(rank, "gt", "left").join(any_, "gt", "left")
    low = F.col("s") < SURE
    state = F.when(F.col("s") >= SURE, "hit").when(F.col("s").isNotNull(), "low").when(F.col("some"), "other").otherwise("none")
    return rows.withColumn("o", state).groupBy("cls").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("o") == x).alias(x) for x in ("hit", "low", "other", "none")],
        _r(F.avg(F.coalesce((F.col("place") <= TOP).cast("int"), F.lit(0))), "in_top"), _r(F.median(F.when(low, F.col("s"))), "low_score"), _r(F.median(F.when(low, F.coalesce("rank", F.lit(1)))), "low_rank"),
    )


def touching_regions(spark, sf_dir):
    """Each label's box, or the hull of the labels of its class that touch it, directly or through others, if they fill the hull."""
    gt = truth_boxes(spark, sf_dir)
    a, b = gt.alias("a"), gt.alias("b")
    apart = lambda lo, hi: F.least(f"a.{hi}", f"b.{hi}") - F.greatest(f"a.{lo}", f"b.{lo}") + GAP > 0
    edges = a.join(b, (F.col("a.img") == F.col("b.img")) & (F.col("a.cls") == F.col("b.cls")) & (F.col("a.gt") < F.col("b.gt")) & apart("x1", "x2") & apart("y1", "y2"))
    roots = similarity.components(edges.select(F.col("a.gt").alias("a"), F.col("b.gt").alias("b")))
    own = gt.join(roots, F.col("gt") == F.col("node"), "left").withColumn("root", F.coalesce("root", "gt"))
    hull = own.groupBy("root").agg(F.min("x1").alias("h1"), F.min("y1").alias("v1"), F.max("x2").alias("h2"), F.max("y2").alias("v2"), F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("filled"))
    hull = hull.withColumn("ok", F.col("filled") / ((F.col("h2") - F.col("h1")) * (F.col("v2") - F.col("v1"))) >= FILL)
    pick = lambda h, x: F.when(F.col("ok"), F.col(h)).otherwise(F.col(x)).alias(x)
    return own.join(hull, "root").select("gt", pick("h1", "x1"), pick("v1", "y1"), pick("h2", "x2"), pick("v2", "y2"))


def label_outcomes(spark, sf_dir):
    """Each prediction as a label from another view, against the labels of its image: agree, class_conflict, split, missing or loose."""
    gt, pr = _boxes(spark, sf_dir)
    own = pr.alias("p").join(gt.alias("g"), F.col("p.img") == F.col("g.img"))
    same = F.col("p.cls") == F.col("g.cls")
    edge = lambda c, lo, hi: F.least(F.greatest((F.col(f"g.{c}") - F.col(f"p.{lo}")) * FINE / (F.col(f"p.{hi}") - F.col(f"p.{lo}")), F.lit(0)), F.lit(FINE)).cast("int")
    rows = own.select("p.pred", same.alias("same"), iou("g", "p").alias("iou"), inside("g", "p").alias("lin"), (intersection("g", "p") / area("p")).alias("share"),
                      edge("x1", "x1", "x2").alias("a1"), edge("y1", "y1", "y2").alias("b1"), edge("x2", "x1", "x2").alias("a2"), edge("y2", "y1", "y2").alias("b2"))
    hit = F.col("same") & (F.col("a2") > F.col("a1")) & (F.col("b2") > F.col("b1"))
    span = lambda lo, hi: F.explode(F.sequence(F.col(lo), F.col(hi) - 1))
    cells = rows.where(hit).withColumn("ix", span("a1", "a2")).withColumn("iy", span("b1", "b2")).groupBy("pred").agg((F.count_distinct("ix", "iy") / (FINE * FINE)).alias("covered"))
    s = rows.groupBy("pred").agg(
        F.max((F.col("same") & (F.col("iou") >= 0.5)).cast("int")).alias("agree"), F.max((~F.col("same") & (F.col("iou") >= 0.5)).cast("int")).alias("conflict"),
        F.count_if("same").alias("peers"), F.count_if(hit).alias("hits"), F.count_if(F.col("same") & (F.col("lin") >= 0.5)).alias("within"), F.max("iou").alias("best"), F.sum("share").alias("share"),
    )
    s = pr.select("pred").join(s, "pred", "left").join(cells, "pred", "left")
    split = (F.col("peers") >= 2) & (((F.col("hits") >= 2) & (F.coalesce("covered", F.lit(0.0)) >= 0.5)) | (F.col("within") >= 2))
    outcome = F.when(F.col("best").isNull(), "missing").when(F.col("agree") == 1, "agree").when(F.col("conflict") == 1, "class_conflict").when(split, "split")
    return s.select("pred", outcome.when((F.col("best") < 0.1) & (F.col("share") < 0.2), "missing").otherwise("loose").alias("outcome"))


_I = iou_sql("g", "p")
_INT = "(greatest(least(g.x2, p.x2) - greatest(g.x1, p.x1), 0.0) * greatest(least(g.y2, p.y2) - greatest(g.y1, p.y1), 0.0))"
_AREA = lambda s: f"(({s}.x2 - {s}.x1) * ({s}.y2 - {s}.y1))"
_SAME = "g.img = p.img and g.cls = p.cls"


def _greedy_sql(name: str, pr: str = "pr", gt: str = "gt", levels: int = 10) -> str:
    """Tables {name}j, {name}c and {name}s: a row of {name}s with a pick is a match (pred, i, pick)."""
    return f"""{name}j as materialized (select p.img, p.cls, p.pred, p.conf, g.gt, round({_I}, 12) iou from {gt} g join {pr} p on {_SAME} where round({_I}, 12) >= 0.5),
{name}c as materialized (select img, cls, pred, cand, row_number() over (partition by img, cls order by conf desc, pred) k from (select img, cls, pred, any_value(conf) conf, list({{'gt': gt, 'iou': iou}} order by iou desc, gt) cand from {name}j group by 1, 2, 3)),
{name}s(img, cls, i, k, pred, used, pick) as (select img, cls, i, 0::bigint, null::bigint, []::bigint[], null::bigint from (select distinct img, cls from {name}c), range({levels}) t(i) union all
  select img, cls, i, k, pred, case when pick is null then used else list_append(used, pick) end, pick from (select s.img, s.cls, s.i, c.k, c.pred, s.used,
    list_filter(c.cand, lambda x: x.iou >= (50 + 5 * s.i) / 100::double and not list_contains(s.used, x.gt))[1].gt pick from {name}s s join {name}c c on c.img = s.img and c.cls = s.cls and c.k = s.k + 1))"""


_GREEDY = f"with recursive {BOX_SQL}, {_greedy_sql('m')}"
_FLAGS = f"""{_GREEDY.replace('range(10)', 'range(1)')}, n as (select cls, count(*) n from gt group by 1),
      fl as (select p.img, p.cls, p.pred, p.conf, (m.pred is not null)::int tp from pr p left join (select pred from ms where pick is not null) m using (pred)
        where p.img in (select img from gt))"""
_TOLERANT = f"""with recursive {BOX_SQL}, tj as materialized (select p.img, p.cls, p.pred, p.conf, g.gt, round({_I}, 12) iou, round({_INT} / ({_AREA('g')} + 1e-9), 12) lin, round({_INT} / ({_AREA('p')} + 1e-9), 12) pin, g.x1, g.y1, g.x2, g.y2, p.x1 a1, p.y1 b1, p.x2 a2, p.y2 b2
  from gt g join pr p on {_SAME} where {_INT} > 0),
tc as materialized (select *, row_number() over (partition by img, cls order by conf desc, pred) k from (select img, cls, pred, any_value(conf) conf, any_value(a1) a1, any_value(b1) b1, any_value(a2) a2, any_value(b2) b2,
  list({{'gt': gt, 'iou': iou, 'lin': lin, 'pin': pin, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} order by iou desc, gt) cand from tj group by 1, 2, 3)),
ts(img, cls, k, pred, used, won, keep) as (select distinct img, cls, 0::bigint, null::bigint, []::bigint[], []::bigint[], 1 from tc union all
  select img, cls, k, pred, list_concat(used, won), won, (len(won) > 0 or not frag)::int from (select *, case when len(grp) > 1 and round(ov / (hull + a - ov + 1e-9), 12) >= 0.5 then list_transform(grp, lambda x: x.gt) when single is not null then [single.gt] else []::bigint[] end won from (
   select *, (h2 - h1) * (v2 - v1) hull, (a2 - a1) * (b2 - b1) a, greatest(least(h2, a2) - greatest(h1, a1), 0) * greatest(least(v2, b2) - greatest(v1, b1), 0) ov from (
    select *, list_min(list_transform(grp, lambda x: x.x1)) h1, list_min(list_transform(grp, lambda x: x.y1)) v1, list_max(list_transform(grp, lambda x: x.x2)) h2, list_max(list_transform(grp, lambda x: x.y2)) v2 from (
     select s.img, s.cls, c.k, c.pred, s.used, c.a1, c.b1, c.a2, c.b2, list_filter(c.cand, lambda x: not list_contains(s.used, x.gt) and (x.iou >= 0.5 or x.lin >= 0.5)) grp,
       list_filter(c.cand, lambda x: not list_contains(s.used, x.gt) and x.iou >= 0.5)[1] single, len(list_filter(c.cand, lambda x: list_contains(s.used, x.gt) and x.pin >= 0.5)) > 0 frag
     from ts s join tc c on c.img = s.img and c.cls = s.cls and c.k = s.k + 1)))))"""


def _grid_sql(rows: str, by: str = "cls") -> str:
    """Tables for the 101-point mean of rows ({by}, rec, prec): a({by}, ap). Groups come from n."""
    on = " and ".join(f"q.{c.strip()} = n.{c.strip()}" for c in by.split(","))
    keys = ", ".join(f"n.{c.strip()}" for c in by.split(","))
    return f"""q as ({rows}),
      v as (select {keys}, x, coalesce(max(prec), 0.0) v from n cross join range(101) g(x) left join q on {on} and q.rec >= x * 0.01::double group by all),
      a as (select {by}, sum(v) / 101 ap from v group by all)"""


def _weighted_sql(flags: str, gt: str, groups: int, step: int, unit: str, salt: int = 0, plus: int = 0, tag: str = "") -> str:
    """Tables {tag}r(rep, map50) of the replicates."""
    at = f"((rep * 7919 + (j + {salt}) * 104729 + rep * (j + {salt}) * 31) % 9973) % {groups}"
    return f"""{tag}d as (select rep, {step} * ({at}) + {plus} unit, count(*) w from range({REPLICATES}) a(rep), range({groups}) b(j) group by 1, 2), {tag}n as (select rep, cls, sum(w) n from {gt} g join {tag}d on {unit} = unit group by 1, 2),
{tag}k as (select rep, cls, sum(w * tp) over o st, sum(w) over o sw from {flags} f join {tag}d on {unit} = unit window o as (partition by rep, cls order by conf desc, pred)),
{tag}v as (select n.rep, n.cls, x, coalesce(max(st / sw), 0.0) v from {tag}n n cross join range(101) g(x) left join {tag}k k on k.rep = n.rep and k.cls = n.cls and k.st / n.n::double >= x * 0.01::double group by all),
{tag}r as (select rep, avg(ap) map50 from (select rep, cls, sum(v) / 101 ap from {tag}v group by 1, 2) group by 1)"""


_PARTS = [
    (k, salt, _greedy_sql(f"{t}{k}x", "pr" if t == "u" else "pb", f"gt{k}", 1), f"""{t}{k}f as (select p.img, p.cls, p.pred, p.conf, (m.pred is not null)::int tp from {'pr' if t == 'u' else 'pb'} p left join (select pred from {t}{k}xs
        where pick is not null) m using (pred) where p.img in (select img from gt{k}))""", t)
    for k, salt in ((0, 0), (4, 50))
    for t in "ub"
]
_INTERACTION = f"with recursive {BOX_SQL}, pb as (select * from pr where pred % 10 = 1), gt0 as (select * from gt where img % 8 = 0), gt4 as (select * from gt where img % 8 = 4), " + ", ".join(
    f"{m}, {f}, {_weighted_sql(f'{t}{k}f', f'gt{k}', 50, 8, 'img', salt, k, f'{t}{k}')}" for k, salt, m, f, t in _PARTS
)
_N = "n as (select cls, count(*) n from gt group by 1)"
_CLIP = lambda c, n: f"least(greatest(round_even({c} / {CELL}, 0), 0), {n})"
_ROUNDED = lambda t: f"ix >= {_CLIP(t + '.x1', 25)} and ix < {_CLIP(t + '.x2', 25)} and iy >= {_CLIP(t + '.y1', 25)} and iy < {_CLIP(t + '.y2', 25)}"
_CENTRED = lambda t: f"ix * {CELL} + {CELL / 2} between {t}.x1 and {t}.x2 and iy * {CELL} + {CELL / 2} between {t}.y1 and {t}.y2"
_EDGE = lambda c, lo, hi: f"trunc(least(greatest((g.{c} - p.{lo}) * {FINE} / (p.{hi} - p.{lo}), 0), {FINE}))::int"

_TABLE = {
    "j7_greedy_match": (greedy_match, f"""{_GREEDY}, h as (select pred, count(*) hits, max((i = 0)::int) tp50 from ms where pick is not null group by 1)
      select pred, coalesce(hits, 0) hits, coalesce(tp50, 0) tp50 from pr left join h using (pred) where img in (select img from gt)"""),
    "j19_suppression": (suppression, f"""with recursive {BOX_SQL}, o as materialized (select *, row_number() over (partition by img, cls order by conf desc, pred) k from pr),
e as materialized (select p.img, p.cls, p.k, p.pred, coalesce(list(q.pred) filter (where round({iou_sql('p', 'q')}, 12) > 0.5), []) nb from o p left join o q on p.img = q.img and p.cls = q.cls and q.k < p.k group by 1, 2, 3, 4),
s(img, cls, k, pred, kept, ok) as (select distinct img, cls, 0::bigint, null::bigint, []::bigint[], false from e union all select img, cls, k, pred, case when ok then list_append(kept, pred) else kept end, ok from (select s.img, s.cls, e.k, e.pred, s.kept, not list_has_any(s.kept, e.nb) ok from s join e on e.img = s.img and e.cls = s.cls and e.k = s.k + 1)),
r as (select pred, row_number() over (partition by pr.img order by conf desc, pred) r from pr join (select pred from s where ok) using (pred)) select pred from r where r <= {TOP}"""),
    "j9_tolerant_match": (tolerant_match, f"{_TOLERANT} select pred, len(won) weight, (len(won) > 0)::bigint tp, keep::bigint keep from ts where k > 0"),
    "a4_weighted_ap": (weighted_ap, f"""{_TOLERANT}, {_N}, f as (select p.cls, p.pred, p.conf, coalesce(len(won), 0) weight, coalesce(len(won) > 0, false)::int tp from pr p left join (select *
        from ts where k > 0) t using (pred) where p.img in (select img from gt) and coalesce(keep, 1) = 1), """ + _grid_sql("""select f.cls, sum(weight) over w / n::double rec, sum(tp) over w / (row_number() over w)::double prec from f
        join n using (cls) window w as (partition by f.cls order by conf desc, pred)""") + " select cls, n, round(ap, 6) ap from a join n using (cls)"),
    "a5_image_weighted_ap": (image_weighted_ap, f"{_FLAGS}, {_weighted_sql('fl', 'gt', 100, 4, 'img', tag='z')} select rep, round(map50, 6) map50 from zr"),
    "r8_image_interval": (image_interval, f"""{_FLAGS}, {_weighted_sql('fl', 'gt', 100, 4, 'img', tag='z')} select count(*) reps, round(avg(map50), 6) mean, round(quantile_cont(map50, 0.025), 6) low,
        round(quantile_cont(map50, 0.975), 6) high from zr"""),
    "r7_scene_interval": (scene_interval, f"""{_FLAGS}, {_weighted_sql('fl', 'gt', 10, 4, f'img % {SCENES}', tag='z')} select count(*) reps, round(avg(map50), 6) mean, round(quantile_cont(map50, 0.025), 6) low,
        round(quantile_cont(map50, 0.975), 6) high from zr"""),
    "r9_interaction": (interaction, f"""{_INTERACTION}, z as (select rep, round(a.map50 - b.map50, 12) d0, round(c.map50 - d.map50, 12) d4 from u0r a join b0r b using (rep) join u4r c using (rep)
        join b4r d using (rep))
      select round(avg(d0), 6) gain_a, round(avg(d4), 6) gain_b, round(avg(d0 - d4), 6) interaction, round(avg((d0 - d4 > 0)::int), 6) p_positive from z"""),
    "a6_trapezoid_ap": (trapezoid_ap, f"""{_FLAGS}, k as (select fl.cls, row_number() over w kk, sum(tp) over w / n::double rec, sum(tp) over w / (row_number() over w)::double prec from fl join n using (cls) window w as (partition by fl.cls order by conf desc, pred)),
m as (select cls, 0 kk, 0.0::double rec, 1.0::double prec from n union all select cls, kk, rec, prec from k union all select cls, 1000000000, 1.0, 0.0 from n), e as (select cls, kk, rec, max(prec) over (partition by cls order by kk desc rows unbounded preceding) env from m),
l as (select *, lead(rec) over (partition by cls order by kk) nr, lead(env) over (partition by cls order by kk) ne from e), y as (select cls, x, case when nr is null then env else env + (x * 0.01::double - rec) / (nr - rec) * (ne - env) end y from l, range(101) g(x) where rec <= x * 0.01::double and (nr is null or x * 0.01::double < nr))
select cls, round(sum(y * case when x in (0, 100) then 0.005::double else 0.01::double end), 5) ap from y group by 1"""),
    "a7_region_ap": (region_ap, f"""with {BOX_SQL}, {_N}, gc as (select distinct img, cls, ix, iy from gt, range(25) a(ix), range(25) b(iy) where {_ROUNDED('gt')}), pc as (select img, cls, ix, iy, floor(max(conf) * 20) t from pr, range(25) a(ix), range(25) b(iy) where {_ROUNDED('pr')} group by 1, 2, 3, 4),
lab as (select cls, count(*) lab from gc group by 1), s as (select c.cls, k, count(pc.img) p, count(gc.img) i from lab c cross join range(20) t(k) left join pc on pc.cls = c.cls and pc.t >= k left join gc on gc.img = pc.img and gc.cls = pc.cls and gc.ix = pc.ix and gc.iy = pc.iy group by 1, 2), """ + _grid_sql("select s.cls, i / lab::double rec, case when p > 0 then i / p::double else 1.0 end prec from s join lab using (cls)") + " select cls, round(ap, 6) ap from a"),
    "a8_region_f1": (region_f1, f"""with {BOX_SQL}, gc as (select distinct img, cls, ix, iy, 1 g from gt, range(25) a(ix), range(25) b(iy) where {_CENTRED('gt')}),
      pc as (select distinct img, cls, ix, iy, 1 p from pr, range(25) a(ix), range(25) b(iy) where conf >= {SURE} and {_CENTRED('pr')}),
      c as (select img, cls, 2 * count(case when g = 1 and p = 1 then 1 end) / (count(g) + count(p))::double f from gc full join pc using (img, cls, ix,
        iy) group by 1, 2)
      select img, round(avg(f), 6) f1 from c group by 1"""),
    "a9_histogram_ap": (histogram_ap, f"""{_FLAGS}, b as (select cls, least(floor(round((greatest(ln(greatest(conf, 1e-30)), -8.0) + 8) / 8 * 100, 9)), 99) bin, sum(tp) tp, count(*) n from fl group by 1, 2),
      x as (select cls, sum(tp) over w / sum(n) over w * tp / sum(tp) over (partition by cls) x from b window w as (partition by cls order by bin desc))
      select cls, round(sum(x), 6) ap from x group by 1"""),
    "a11_anatomy": (anatomy, f"""with {BOX_SQL}, o as (select *, row_number() over (partition by img order by conf desc, pred) place from pr), nr as (select g.gt, g.cls = p.cls same, p.cls pc, p.conf, p.place from gt g join o p on g.img = p.img and {_I} >= 0.5),
b as (select gt, max(conf) s, min(place) place from nr where same group by 1), rk as (select gt, 1 + count(distinct pc) rk from nr join b using (gt) where conf > s group by 1), rw as (select gt.cls, s, b.place, rk, case when s >= {SURE} then 'hit' when s is not null then 'low' when gt.gt in (select gt from nr) then 'other' else 'none' end o from gt left join b using (gt) left join rk using (gt))
select cls, count(*) n, """ + ", ".join(f"sum((o = '{x}')::int)::bigint \"{x}\"" for x in ("hit", "low", "other", "none")) + f", round(avg(coalesce((place <= {TOP})::int, 0)), 6) in_top, round(median(case when s < {SURE} then s end), 6) low_score, round(median(case when s < {SURE} then coalesce(rk, 1) end), 6) low_rank from rw group by 1"),
    "g6_touching_regions": (touching_regions, f"""with recursive {BOX_SQL}, e as materialized (select a.gt a, b.gt b from gt a join gt b on a.img = b.img and a.cls = b.cls and a.gt <> b.gt where least(a.x2, b.x2) - greatest(a.x1, b.x1) + {GAP} > 0 and least(a.y2, b.y2) - greatest(a.y1, b.y1) + {GAP} > 0),
r as (select gt, gt root from gt union select e.b, r.root from r join e on e.a = r.gt), c as (select gt, min(root) root from r group by 1), h as (select root, min(x1) h1, min(y1) v1, max(x2) h2, max(y2) v2, sum((x2 - x1) * (y2 - y1)) / ((max(x2) - min(x1)) * (max(y2) - min(y1))) >= {FILL} ok from gt join c using (gt) group by 1)
select gt, case when ok then h1 else x1 end x1, case when ok then v1 else y1 end y1, case when ok then h2 else x2 end x2, case when ok then v2 else y2 end y2 from gt join c using (gt) join h using (root)"""),
    "p10_label_outcomes": (label_outcomes, f"""with {BOX_SQL}, j as (select p.pred, g.cls = p.cls same, {_I} iou, {_INT} / ({_AREA('g')} + 1e-9) lin, {_INT} / {_AREA('p')} share, {_EDGE('x1', 'x1', 'x2')} a1, {_EDGE('y1', 'y1', 'y2')} b1, {_EDGE('x2', 'x1', 'x2')} a2, {_EDGE('y2', 'y1', 'y2')} b2 from pr p join gt g on g.img = p.img),
c as (select pred, count(distinct ix * 100 + iy) / {FINE * FINE}::double covered from j, range({FINE}) a(ix), range({FINE}) b(iy) where same and ix >= a1 and ix < a2 and iy >= b1 and iy < b2 group by 1),
s as (select pred, max((same and iou >= 0.5)::int) agree, max((not same and iou >= 0.5)::int) conflict, sum(same::int) peers, sum((same and a2 > a1 and b2 > b1)::int) hits, sum((same and lin >= 0.5)::int) inw, max(iou) best, sum(share) share from j group by 1)
select pred, case when best is null then 'missing' when agree = 1 then 'agree' when conflict = 1 then 'class_conflict' when peers >= 2 and ((hits >= 2 and coalesce(covered, 0) >= 0.5) or inw >= 2) then 'split' when best < 0.1 and share < 0.2 then 'missing' else 'loose' end outcome from pr left join s using (pred) left join c using (pred)"""),
}
QUERIES = {k: f for k, (f, _) in _TABLE.items()}
ORACLES = {k: s for k, (_, s) in _TABLE.items()}
