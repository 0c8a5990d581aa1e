"""Queries of resampling, calibration, regressions, splits and budgets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import inside, intersection, iou, iou_sql
from ..operators import regression, similarity, splits
from ..operators.graph import stash
from ..sources.tables import BOX_SQL, predicted_boxes, table, truth_boxes
from .audit import _COS, _SPLIT, _vectors
from .detection import FINE, _flags, _greedy_sql, _r, average_precision

SCENES, TRIALS, PERMUTATIONS, CALIBRATION, ALPHA = 40, 50, 300, 30, 0.4
#: A label is flagged where predictions cover this many of its FINE * FINE cells.
COVERED = FINE * FINE // 2


# -- flags, units, alarms ---------------------------------------------------------------------------------------------


def _defects(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Labels of class 0, the defects, and all predictions."""
    return truth_boxes(spark, sf_dir).where("cls = 0"), predicted_boxes(spark, sf_dir)


def _flag_confs(gt: DataFrame, pr: DataFrame) -> DataFrame:
    """(img, gt, conf): the highest threshold at which predictions of any class cover half the label's cells; 0 if none does."""
    at = lambda c, lo, hi: (F.col(f"p.{c}") - F.col(f"g.{lo}")) * FINE / (F.col(f"g.{hi}") - F.col(f"g.{lo}"))
    clip = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(FINE)).cast("int")
    both = gt.alias("g").join(pr.alias("p"), (F.col("g.img") == F.col("p.img")) & (intersection("g", "p") > 0))
    rows = both.select("g.gt", "p.conf", clip(at("x1", "x1", "x2")).alias("a1"), clip(at("y1", "y1", "y2")).alias("b1"), clip(F.ceil(at("x2", "x1", "x2"))).alias("a2"), clip(F.ceil(at("y2", "y1", "y2"))).alias("b2"))
    rows = rows.where("a2 > a1 and b2 > b1").withColumn("ix", F.explode(F.sequence("a1", F.col("a2") - 1))).withColumn("iy", F.explode(F.sequence("b1", F.col("b2") - 1)))
    cells = rows.groupBy("gt", "ix", "iy").agg(F.max("conf").alias("conf"))
    place = F.row_number().over(Window.partitionBy("gt").orderBy(F.desc("conf"), "ix", "iy"))  # FINE * FINE rows a label
    flagged = cells.withColumn("r", place).where(F.col("r") == COVERED).select("gt", "conf")
    return gt.select("img", "gt").join(flagged, "gt", "left").na.fill({"conf": 0.0})


def _alarms(gt: DataFrame, pr: DataFrame) -> DataFrame:
    """(img, conf) of predictions on no defect."""
    j = pr.alias("p").join(gt.alias("g"), F.col("g.img") == F.col("p.img"), "left").groupBy("p.img", "p.pred", "p.conf")
    j = j.agg(F.coalesce(F.max(iou("g", "p")), F.lit(0.0)).alias("best"), F.coalesce(F.sum(inside("p", "g")), F.lit(0.0)).alias("cover"))
    return j.where("best < 0.1 and cover < 0.5").select("img", "conf")


def flag_confidence(spark, sf_dir):
    return _flag_confs(*_defects(spark, sf_dir)).select("gt", _r(F.col("conf"), "conf"))


def units(spark, sf_dir):
    """Scenes with defects: how many, the share missed at one half, and alarms an image at 0.3 or more."""
    gt, pr = _defects(spark, sf_dir)
    scene = (F.col("img") % SCENES).alias("unit")
    flags = _flag_confs(gt, pr).groupBy(scene).agg(F.count("*").alias("defects"), _r(F.avg((F.col("conf") < 0.5).cast("int")), "missed"))
    alarms = _alarms(gt, pr).where("conf >= 0.3").groupBy(scene).agg(F.count("*").alias("a"))
    images = pr.groupBy(scene).agg(F.count_distinct("img").alias("images"))
    return flags.join(images, "unit").join(alarms, "unit", "left").select("unit", "defects", "missed", "images", _r(F.coalesce("a", F.lit(0)) / F.col("images"), "alarms"))


def alarm_matrix(spark, sf_dir):
    """Alarms an image at or above each tenth, for each scene with defects."""
    gt, pr = _defects(spark, sf_dir)
    scene = (F.col("img") % SCENES).alias("unit")
    images = pr.groupBy(scene).agg(F.count_distinct("img").alias("images")).join(gt.select(scene).distinct(), "unit")
    grid = images.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(10))))
    steps = _alarms(gt, pr).groupBy(scene, F.floor(F.col("conf") * 10).alias("step")).agg(F.count("*").alias("a"))  # few rows meet the grid
    hit = grid.join(steps, "unit", "left").groupBy("unit", "t", "images").agg(F.coalesce(F.sum(F.when(F.col("step") >= F.col("t"), F.col("a"))), F.lit(0)).alias("a"))
    return hit.select("unit", "t", _r(F.col("a") / F.col("images"), "alarms"))


def calibration_draws(spark, sf_dir):
    """Thresholds calibrated on drawn units (images): the mean step, the miss rate they give on all units, and how often it passes ALPHA."""
    flags = _flag_confs(*_defects(spark, sf_dir))
    grid = flags.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(20))))
    loss = stash(grid.groupBy("img", "t").agg(F.avg((F.col("conf") < F.col("t") / 20).cast("int")).alias("loss")))
    drawn = splits.shuffled(flags.select("img").distinct(), TRIALS, "img").where(F.col("place") <= CALIBRATION).select("trial", "img")
    mean = loss.join(F.broadcast(drawn), "img").groupBy("trial", "t").agg(F.avg("loss").alias("m"), F.count("*").alias("n"))
    bad = F.round((F.col("n") * F.col("m") + 1) / (F.col("n") + 1), 12) > ALPHA
    step = mean.groupBy("trial").agg(F.coalesce(F.greatest(F.min(F.when(bad, F.col("t"))) - 1, F.lit(0)), F.max("t")).alias("t"))
    all_ = loss.groupBy("t").agg(F.avg("loss").alias("miss"))
    return step.join(all_, "t").agg(_r(F.avg("t"), "step"), _r(F.avg("miss"), "miss"), _r(F.avg((F.round("miss", 12) > ALPHA).cast("int")), "violations"))


# -- regressions and tests --------------------------------------------------------------------------------------------


def _panel(spark, sf_dir) -> DataFrame:
    """(scene, cls, x, y): labels in hundreds and mean box area in thousands; a full panel."""
    gt = truth_boxes(spark, sf_dir).withColumn("scene", F.col("img") % SCENES)
    own = gt.groupBy("scene", "cls").agg((F.count("*") / 100).alias("x"), F.avg((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / 1000).alias("y"))
    every = gt.select("scene").distinct().join(F.broadcast(gt.select("cls").distinct()))  # scenes by classes
    return every.join(own, ["scene", "cls"], "left").na.fill(0.0, ["x", "y"])


def two_way_slope(spark, sf_dir):
    beta = regression.slopes(_panel(spark, sf_dir), "y", ["x"], ("scene", "cls"))
    return spark.createDataFrame([(round(float(beta[0]), 5),)], "slope double")


def dummy_slope(spark, sf_dir):
    """The same by dummies: a row for each scene and class fits in the driver."""
    beta = regression.dummy_slopes(_panel(spark, sf_dir).toPandas(), "y", ["x"], ("scene", "cls"))
    return spark.createDataFrame([(round(float(beta[0]), 5),)], "slope double")


def fractional_logistic(spark, sf_dir):
    """Share of the ten thresholds that a label's best overlap passes, on its log size and class."""
    gt, pr = truth_boxes(spark, sf_dir).alias("g"), predicted_boxes(spark, sf_dir).alias("p")
    best = gt.join(pr, (F.col("g.img") == F.col("p.img")) & (F.col("g.cls") == F.col("p.cls")), "left").groupBy("g.gt", "g.cls", "g.x1", "g.y1", "g.x2", "g.y2").agg(F.coalesce(F.max(iou("g", "p")), F.lit(0.0)).alias("best"))
    rows = best.select((F.least(F.greatest(F.floor((F.col("best") - 0.45) / 0.05), F.lit(0)), F.lit(10)) / 10).alias("t"), F.log((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("size"), F.col("cls").cast("double").alias("cls"))
    beta, intercept = regression.fractional_logistic(rows, "t", ["size", "cls"])
    return spark.createDataFrame([(n, float(b)) for n, b in (("size", beta[0]), ("cls", beta[1]), ("intercept", intercept))], "name string, coefficient double")


def kernel_distance(spark, sf_dir):
    """Squared mean discrepancy between held-out and train vectors under exp(-4 (1 - cos)): means over blocks of pairs, never the pairs."""
    e = _vectors(spark, sf_dir)
    a, b = e.where("split <> 'train'"), e.where("split = 'train'")
    mean = lambda x, y: similarity.kernel_mean(x.selectExpr("vec_id qid", "vec"), y.selectExpr("vec_id bid", "vec"))
    return spark.createDataFrame([(round(mean(a, a) + mean(b, b) - 2 * mean(a, b), 8),)], "mmd2 double")


def clusters(spark, sf_dir):
    """Sizes of eight clusters of the vectors, by their number of members."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = _vectors(spark, sf_dir).select("vec_id", array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=8, seed=1, maxIter=20).fit(rows)
    return model.transform(rows).groupBy("prediction").agg(F.count("*").alias("n"))


def permutation_test(spark, sf_dir):
    """Spearman's correlation of a scene's labels with its mean area, and the share of permutations as far from zero."""
    gt = truth_boxes(spark, sf_dir).withColumn("scene", F.col("img") % SCENES)
    s = gt.groupBy("scene").agg(F.count("*").alias("x"), F.round(F.avg((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))), 6).alias("y"))
    rank = lambda c: F.rank().over(Window.partitionBy(F.lit(1)).orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2  # noqa: E731  one row a scene
    own = stash(s.select("scene", rank("x").alias("rx"), rank("y").alias("ry"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("scene")).alias("place")))
    r = own.agg(F.corr("rx", "ry").alias("r"))
    moved = splits.shuffled(own.select("scene", "ry"), PERMUTATIONS, "scene").select("trial", "place", "ry")
    null = moved.join(F.broadcast(own.select("place", "rx")), "place").groupBy("trial").agg(F.corr("rx", "ry").alias("null"))
    return null.join(F.broadcast(r)).groupBy(_r(F.col("r"), "rho")).agg(_r(F.avg((F.abs("null") >= F.abs("r") - 1e-12).cast("int")), "p"))


# -- splits and budgets -----------------------------------------------------------------------------------------------


def _scenes(spark, sf_dir) -> DataFrame:
    """(grp, n, c0, c1): scenes with their labels and those of the first two classes."""
    return truth_boxes(spark, sf_dir).groupBy((F.col("img") % SCENES).alias("grp")).agg(F.count("*").alias("n"), *[F.count_if(F.col("cls") == k).alias(f"c{k}") for k in (0, 1)])


def group_packing(spark, sf_dir):
    """Scenes by their number of labels, most first, packed into two fifths of all labels."""
    s = _scenes(spark, sf_dir).orderBy(F.desc("n"), "grp").toPandas()  # a row for each scene
    got = splits.pack(s["grp"].tolist(), dict(zip(s["grp"], s["n"], strict=True)), 0.4 * s["n"].sum())
    return spark.createDataFrame([(int(g),) for g in got], "grp long")


def budget_draws(spark, sf_dir):
    """How often each scene is packed into a quarter of the labels, over shuffled orders."""
    s = _scenes(spark, sf_dir)
    total = s.agg(F.sum("n")).first()[0]
    return splits.budget_draws(s, TRIALS, 0.25 * total).groupBy("grp").agg(F.count("*").alias("draws"))


def class_matched_draw(spark, sf_dir):
    """The draw whose share of class 0 is nearest to that of all labels; the first of equal ones."""
    s = stash(_scenes(spark, sf_dir))
    total, own = s.agg(F.sum("n"), F.sum("c0")).first()
    drawn = stash(splits.budget_draws(s, TRIALS, 0.25 * total).join(F.broadcast(s), "grp"))
    best = drawn.groupBy("trial").agg((F.sum("c0") / F.sum("n")).alias("share")).groupBy().agg(F.min(F.struct(F.round(F.abs(F.col("share") - own / total), 12).alias("off"), "trial")).alias("b"))
    return drawn.join(F.broadcast(best.select("b.trial")), "trial").select("trial", "grp", "n")


def nested_prefixes(spark, sf_dir):
    """The shuffled order of scenes whose prefixes at a quarter and a half of the labels match the share of class 0 best, and where they end."""
    s = stash(_scenes(spark, sf_dir))
    total, own = s.agg(F.sum("n"), F.sum("c0")).first()
    upto = Window.partitionBy("trial").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # one row a scene
    run = splits.shuffled(s, TRIALS, "grp").withColumns({"cn": F.sum("n").over(upto), "c": F.sum("c0").over(upto)})
    cut = run.withColumn("f", F.explode(F.array(F.lit(0.25), F.lit(0.5)))).where(F.col("cn") >= F.col("f") * total)
    cut = cut.groupBy("trial", "f").agg(F.min(F.struct("place", "cn", "c")).alias("m")).withColumn("off", F.abs(F.col("m.c") / F.col("m.cn") - own / total))
    best = cut.groupBy("trial").agg(F.round(F.sum("off"), 12).alias("off")).groupBy().agg(F.min(F.struct("off", "trial")).alias("b")).select("b.trial")
    return cut.join(F.broadcast(best), "trial").select("trial", _r(F.col("f"), "fraction", 2), F.col("m.place").cast("long").alias("scenes"), F.col("m.cn").alias("labels"))


def stratified_split(spark, sf_dir):
    return splits.stratified_split(_scenes(spark, sf_dir), {"train": 0.7, "val": 0.15, "test": 0.15}, TRIALS, feats=("c0", "c1", "n"))


def held_out_draw(spark, sf_dir):
    """A tenth of the documents of each language, by a hash of the id."""
    order = Window.partitionBy("lang").orderBy(F.md5(F.concat_ws("-", F.lit("7"), F.col("doc_id").cast("string"))))
    d = table(spark, sf_dir, "documents").where("lang is not null").select("lang", "doc_id")
    n = d.groupBy("lang").agg(F.count("*").alias("n"))
    return d.withColumn("r", F.row_number().over(order)).join(F.broadcast(n), "lang").where("r <= ceil(n / 10)").select("lang", "doc_id")


def scene_cover(spark, sf_dir):
    """Groups of vectors chosen for the coverage of eight targets, within a fifth of the vectors."""
    e = _vectors(spark, sf_dir)
    sims = similarity.similarity_join(e.where("vec_id >= 8").selectExpr("vec_id qid", "vec"), e.where("vec_id < 8").selectExpr("vec_id bid", "vec"))
    by = sims.groupBy((F.col("qid") % SCENES).alias("grp"), "bid").agg(F.max("sim").alias("sim")).toPandas()  # groups by targets
    sizes = {r.grp: r.n for r in e.groupBy((F.col("vec_id") % SCENES).alias("grp")).agg(F.count("*").alias("n")).collect()}
    got = splits.greedy_cover(by.pivot(index="grp", columns="bid", values="sim").sort_index(), sizes, 0.2 * sum(sizes.values()))
    return spark.createDataFrame([(int(g), i) for i, g in enumerate(got)], "grp long, place int")


def pattern_draw(spark, sf_dir):
    """Twenty labels' vectors drawn by squared distance, from a sample of four vectors a label at most."""
    import numpy as np

    e = _vectors(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy(F.col("vec_id") % 100).orderBy("vec_id"))).where("r <= 4").orderBy("vec_id").toPandas()  # 400 rows at most
    x = np.array(list(e["vec"]), float)
    got = splits.distance_sampling(x / np.linalg.norm(x, axis=1)[:, None], (e["vec_id"] % 100).to_numpy(), 20)
    return spark.createDataFrame([(int(g), i) for i, g in enumerate(got)], "grp long, place int")


def cross_fit(spark, sf_dir):
    """Mean overlap of a label's class in the other fold of scenes, beside its own: folds alternate over the scenes."""
    gt, pr = truth_boxes(spark, sf_dir).alias("g"), predicted_boxes(spark, sf_dir).alias("p")
    best = gt.join(pr, (F.col("g.img") == F.col("p.img")) & (F.col("g.cls") == F.col("p.cls")), "left").groupBy("g.gt", "g.cls", "g.img").agg(F.coalesce(F.max(iou("g", "p")), F.lit(0.0)).alias("best"))
    scenes = best.groupBy((F.col("img") % SCENES).alias("scene")).agg(F.min("gt").alias("first"))
    fold = F.pmod(F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("first")), F.lit(2)).alias("fold")  # one row a scene
    rows = best.withColumn("scene", F.col("img") % SCENES).join(F.broadcast(scenes.select("scene", fold)), "scene")
    mean = rows.groupBy("cls", "fold").agg(F.avg("best").alias("m"), F.count("*").alias("n"))
    other = mean.select("cls", (1 - F.col("fold")).alias("fold"), F.col("m").alias("fitted"))
    return mean.join(other, ["cls", "fold"]).select("cls", F.col("fold").cast("long").alias("fold"), "n", _r(F.col("m"), "own"), _r(F.col("fitted"), "fitted"))


def clicks(spark, sf_dir):
    """A point in each label, by a hash of its id."""
    u = lambda salt: (F.pmod(F.col("gt") * 7919 + salt, F.lit(997)) + 0.5) / 997
    at = lambda lo, hi, salt: F.col(lo) + u(salt) * (F.col(hi) - F.col(lo))
    return truth_boxes(spark, sf_dir).select("gt", _r(at("x1", "x2", 13), "cx"), _r(at("y1", "y2", 41), "cy"))


def placements(spark, sf_dir):
    """For each image a box of 40 by 30: the first of twelve places that shares at most a tenth of it with every label."""
    gt = truth_boxes(spark, sf_dir)
    tries = gt.select("img").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11))))
    x, y = F.pmod(F.col("img") * 37 + F.col("k") * 113, F.lit(460)).cast("double"), F.pmod(F.col("img") * 53 + F.col("k") * 197, F.lit(470)).cast("double")
    tries = tries.select("img", "k", x.alias("x1"), y.alias("y1"), (x + 40).alias("x2"), (y + 30).alias("y2"))
    hit = tries.alias("p").join(gt.alias("g"), (F.col("p.img") == F.col("g.img")) & (intersection("g", "p") > 0.1 * 1200)).select("p.img", "p.k")
    free = tries.join(hit, ["img", "k"], "left_anti")
    return free.groupBy("img").agg(F.min_by(F.struct("k", "x1", "y1"), "k").alias("m")).select("img", F.col("m.k").cast("long").alias("tries"), "m.x1", "m.y1")


# -- summaries --------------------------------------------------------------------------------------------------------


def subset_properties(spark, sf_dir):
    """Of each split of the vectors: rows, distinct labels, the least label's rows, labels with ten rows or more, and the entropy of the labels."""
    n = _vectors(spark, sf_dir).groupBy("split", "label").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("split")))  # one row a label
    return p.groupBy("split").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.min("n").alias("least"), F.count_if(F.col("n") >= 10).alias("covered"), _r(-F.sum(F.col("p") * F.log("p")), "entropy"))


def _class_ap(spark, sf_dir, part: str) -> DataFrame:
    gt, pr = truth_boxes(spark, sf_dir), predicted_boxes(spark, sf_dir).where(part)
    return average_precision(_flags(gt, pr), gt.groupBy("cls").agg(F.count("*").alias("n")), ["cls"])


def count_contrast(spark, sf_dir):
    """Gains of all predictions over the first ones, in classes with fewer labels than the mean and in the others; a rule that takes them only there."""
    a, b = _class_ap(spark, sf_dir, "true"), _class_ap(spark, sf_dir, "pred % 10 = 1").select("cls", F.col("ap").alias("base"))
    mean = a.agg(F.avg("n").alias("m"))  # one row
    j = a.join(b, "cls").join(F.broadcast(mean)).select((F.col("n") < F.col("m")).alias("low"), F.round(F.col("ap") - F.col("base"), 12).alias("d"))
    own = lambda low: F.avg(F.when(F.col("low") == low, F.col("d")))
    return j.agg(_r(own(True), "low"), _r(own(False), "high"), _r(own(True) - own(False), "contrast"), _r(F.avg(F.when(F.col("low"), F.col("d")).otherwise(0.0)), "gated"), _r(F.avg("d"), "fixed"))


def family_means(spark, sf_dir):
    """AP of four runs (predictions above quarter steps of the score) over classes: mean, and classes in which each is best."""
    runs = None
    for k in range(4):
        own = _class_ap(spark, sf_dir, f"conf >= {k} / 8D").select(F.lit(k).cast("long").alias("run"), "cls", F.round("ap", 12).alias("ap"))
        runs = own if runs is None else runs.unionAll(own)
    best = runs.withColumn("top", F.max("ap").over(Window.partitionBy("cls")))  # four rows a class
    return best.groupBy("run").agg(_r(F.avg("ap"), "mean"), F.count_if(F.col("ap") == F.col("top")).alias("wins"))


def decision_rules(spark, sf_dir):
    """Rules stated beforehand, each a predicate over the results."""
    r = family_means(spark, sf_dir).groupBy().pivot("run", list(range(4))).agg(F.max("mean").alias("m"))
    rules = {"loses_under_a_point": F.col("0") - F.col("1") < 0.01, "falls_with_the_bar": (F.col("0") >= F.col("1")) & (F.col("1") >= F.col("2")), "half_is_kept": F.col("2") >= 0.5 * F.col("0")}
    return r.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("passed")) for k, v in rules.items()])).alias("x")).select("x.*")


def leave_one_out(spark, sf_dir):
    """The mean AP without each class, and how far it lies under the mean of all."""
    a = _class_ap(spark, sf_dir, "true").select("cls", "ap")
    s = a.agg(F.sum("ap").alias("s"), F.count("*").alias("k"))  # one row
    j = a.join(F.broadcast(s)).withColumn("rest", (F.col("s") - F.col("ap")) / (F.col("k") - 1))
    return j.select("cls", _r(F.col("rest"), "rest"), _r(F.col("s") / F.col("k") - F.col("rest"), "gap"))


def subset_gains(spark, sf_dir):
    """mAP of all predictions and of the first ones, in two subsets of the images."""
    out = None
    for k in (0, 4):
        gt = truth_boxes(spark, sf_dir).where(f"img % 8 = {k}")
        n = gt.groupBy("cls").agg(F.count("*").alias("n"))
        maps = [average_precision(_flags(gt, predicted_boxes(spark, sf_dir).where(p)), n, ["cls"]).agg(F.avg("ap").alias(c)) for p, c in (("true", "a"), ("pred % 10 = 1", "b"))]
        own = maps[0].join(F.broadcast(maps[1])).select(F.lit(k).cast("long").alias("subset"), _r(F.col("a"), "all"), _r(F.col("a") - F.col("b"), "gain"))
        out = own if out is None else out.unionAll(own)
    return out


_I = iou_sql("g", "p")
_INT = "(greatest(least(g.x2, p.x2) - greatest(g.x1, p.x1), 0.0) * greatest(least(g.y2, p.y2) - greatest(g.y1, p.y1), 0.0))"
_AT = lambda c, lo, hi: f"(p.{c} - g.{lo}) * {FINE} / (g.{hi} - g.{lo})"
_CL = lambda x: f"trunc(least(greatest({x}, 0), {FINE}))::int"
_UNITS = f"""{BOX_SQL}, g0 as (select * from gt where cls = 0), cr as (select g.gt, p.conf, {_CL(_AT('x1', 'x1', 'x2'))} a1, {_CL(_AT('y1', 'y1', 'y2'))} b1, {_CL('ceil(' + _AT('x2', 'x1', 'x2') + ')')} a2, {_CL('ceil(' + _AT('y2', 'y1', 'y2') + ')')} b2 from g0 g join pr p on g.img = p.img and {_INT} > 0),
ce as (select gt, ix, iy, max(conf) conf from cr, range({FINE}) a(ix), range({FINE}) b(iy) where ix >= a1 and ix < a2 and iy >= b1 and iy < b2 group by 1, 2, 3),
fc as (select g0.img, g0.gt, coalesce(c.conf, 0.0) conf from g0 left join (select gt, conf from (select *, row_number() over (partition by gt order by conf desc, ix, iy) r from ce) where r = {COVERED}) c using (gt)),
al as (select img, conf from (select p.img, p.pred, p.conf, coalesce(max({_I}), 0.0) best, coalesce(sum({_INT} / ((p.x2 - p.x1) * (p.y2 - p.y1) + 1e-9)), 0.0) cover from pr p left join g0 g on g.img = p.img group by 1, 2, 3) where best < 0.1 and cover < 0.5),
im as (select img % {SCENES} unit, count(distinct img) images from pr group by 1)"""
_PANEL = f"""with {BOX_SQL}, o as (select img % {SCENES} scene, cls, count(*) / 100.0::double x, avg((x2 - x1) * (y2 - y1) / 1000) y from gt group by 1, 2), pn as (select s.scene, c.cls, coalesce(x, 0) x, coalesce(y, 0) y from (select distinct img % {SCENES} scene from gt) s cross join (select distinct cls from gt) c left join o on o.scene = s.scene and o.cls = c.cls),
dm as (select x - avg(x) over (partition by scene) - avg(x) over (partition by cls) + avg(x) over () x, y - avg(y) over (partition by scene) - avg(y) over (partition by cls) + avg(y) over () y from pn) select round(sum(x * y) / sum(x * x), 5) slope from dm"""
_GRP = f"{BOX_SQL}, gr as (select img % {SCENES} grp, count(*) n, sum((cls = 0)::int) c0 from gt group by 1), tt as (select sum(n) t, sum(c0) t0 from gr)"
_ORDERED = f"od as materialized (select trial, grp, n, c0, row_number() over (partition by trial order by md5(concat_ws('-', trial::varchar, grp::varchar))) place from gr, range({TRIALS}) r(trial))"
_PACKED = f"""with recursive {_GRP}, {_ORDERED}, pk(trial, place, grp, used, took) as (select trial, 0::bigint, null::bigint, 0::hugeint, false from range({TRIALS}) r(trial) union all
select p.trial, o.place, o.grp, case when p.used < 0.25 * t and p.used + o.n <= 0.25 * t * 1.05 then p.used + o.n else p.used end, p.used < 0.25 * t and p.used + o.n <= 0.25 * t * 1.05 from pk p join od o on o.trial = p.trial and o.place = p.place + 1, tt)"""


def _ap_sql(name: str, where: str, gt: str = "gt", n: str = "n") -> str:
    """Tables ending in {name}a(cls, ap): AP of the predictions under a condition, matched in order by a recursion."""
    part = f"{name}p as (select * from pr where {where}), " + _greedy_sql(name, f"{name}p", gt, 1)
    flags = f"""{name}f as (select p.cls, p.pred, p.conf, (m.pred is not null)::int tp from {name}p p left join (select pred from {name}s
        where pick is not null) m using (pred) where p.img in (select img from {gt}))"""
    rows = f"""{name}q as (select f.cls, sum(tp) over w / n::double rec, sum(tp) over w / (row_number() over w)::double prec from {name}f f
        join {n} n using (cls) window w as (partition by f.cls order by conf desc, pred))"""
    return f"""{part}, {flags}, {rows}, {name}a as (select cls, sum(v) / 101 ap from (select n.cls, x, coalesce(max(prec), 0.0) v from {n} n cross join range(101) g(x) left
        join {name}q q on q.cls = n.cls and q.rec >= x * 0.01::double group by 1, 2) group by 1)"""


_NC = f"with recursive {BOX_SQL}, n as (select cls, count(*) n from gt group by 1)"
_FAMILY = f"{_NC}, " + ", ".join(_ap_sql(f"r{k}", f"conf >= {k} / 8::double") for k in range(4)) + ", rs as (" + " union all ".join(f"select {k}::bigint run, cls, round(ap, 12) ap from r{k}a" for k in range(4)) + """),
      fm as (select run, round(avg(ap), 6) mean, sum((ap = top)::int)::bigint wins from (select *, max(ap) over (partition by cls) top from rs) group by 1)"""
_PERM = f"""with {BOX_SQL}, s as (select img % {SCENES} scene, count(*) x, round(avg((x2 - x1) * (y2 - y1)), 6) y from gt group by 1), o as (select scene, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2 ry, row_number() over (order by scene) place from s),
m as (select trial, ry, row_number() over (partition by trial order by md5(concat_ws('-', trial::varchar, scene::varchar))) place from o, range({PERMUTATIONS}) r(trial)), z as (select trial, corr(o.rx, m.ry) z from m join o using (place) group by 1), r as (select corr(rx, ry) r from o)
select round(r, 6) rho, round(avg((abs(z) >= abs(r) - 1e-12)::int), 6) p from z, r group by r"""

_TABLE = {
    "a14_flag_confidence": (flag_confidence, f"with {_UNITS} select gt, round(conf, 6) conf from fc"),
    "a15_units": (units, f"""with {_UNITS}, f as (select img % {SCENES} unit, count(*) defects, round(avg((conf < 0.5)::int), 6) missed from fc group by 1),
      a as (select img % {SCENES} unit, count(*) a from al where conf >= 0.3 group by 1)
      select unit, defects, missed, images, round(coalesce(a, 0) / images, 6) alarms from f join im using (unit) left join a using (unit)"""),
    "a16_alarm_matrix": (alarm_matrix, f"""with {_UNITS} select unit, t, round(count(al.conf) / any_value(images), 6) alarms from (select im.* from im where unit in (select img % {SCENES}
        from g0)) u cross join range(11) g(t) left join al on al.img % {SCENES} = u.unit and floor(al.conf * 10) >= t group by 1, 2"""),
    "r11_calibration_draws": (calibration_draws, f"""with {_UNITS}, ls as (select img, t, avg((conf < t / 20::double)::int) loss from fc, range(21) g(t) group by 1, 2), dr as (select * from (select trial, img, row_number() over (partition by trial order by md5(concat_ws('-', trial::varchar, img::varchar))) place from (select distinct img from fc), range({TRIALS}) r(trial)) where place <= {CALIBRATION}),
mn as (select trial, t, avg(loss) m, count(*) n from ls join dr using (img) group by 1, 2), st as (select trial, coalesce(greatest(min(case when round((n * m + 1) / (n + 1), 12) > {ALPHA} then t end) - 1, 0), max(t)) t from mn group by 1), al2 as (select t, avg(loss) miss from ls group by 1)
select round(avg(t), 6) step, round(avg(miss), 6) miss, round(avg((round(miss, 12) > {ALPHA})::int), 6) violations from st join al2 using (t)"""),
    "e1_dummy_slope": (dummy_slope, _PANEL),
    "e2_two_way_slope": (two_way_slope, _PANEL),
    "e3_fractional_logistic": (fractional_logistic, None),
    "e5_kernel_distance": (kernel_distance, _COS.replace(" where a.vec_id <> b.vec_id", "") + """, k as (select (qs = 'train') q, (bs = 'train') b, avg(exp(-4 * (1 - sim))) m from p group by 1, 2)
      select round(sum(case when q = b then m else -m end), 8) mmd2 from k"""),
    "e7_clusters": (clusters, None),
    "r10_permutation_test": (permutation_test, _PERM),
    "t4_group_packing": (group_packing, f"""with recursive {_GRP}, od as (select grp, n, row_number() over (order by n desc, grp) place from gr),
      pk(place, grp, used, took) as (select 0::bigint, null::bigint, 0::hugeint, false
      union all select o.place, o.grp, case when p.used < 0.4 * t and p.used + o.n <= 0.4 * t * 1.05 then p.used + o.n else p.used end, p.used < 0.4 * t
        and p.used + o.n <= 0.4 * t * 1.05 from pk p join od o on o.place = p.place + 1, tt)
      select grp from pk where took"""),
    "r3_budget_draws": (budget_draws, f"{_PACKED} select grp, count(*) draws from pk where took group by 1"),
    "r3_class_matched": (class_matched_draw, f"""{_PACKED}, d as (select pk.trial, gr.* from pk join gr using (grp) where took),
      b as (select trial from (select trial, round(abs(sum(c0) / sum(n)::double - any_value(t0) / any_value(t)::double), 12) off from d, tt
        group by 1) order by off, trial limit 1)
      select trial, grp, n from d where trial in (select trial from b)"""),
    "r2_nested_prefixes": (nested_prefixes, f"""with {_GRP}, {_ORDERED}, rn as (select trial, place, sum(n) over w cn, sum(c0) over w c from od window w as (partition by trial order by place)), ct as (select trial, f, min(place) place, min(cn) cn, arg_min(c, place) c from rn, tt, (values (0.25::double), (0.5::double)) v(f) where cn >= f * t group by 1, 2),
sc as (select trial, round(sum(abs(c / cn::double - t0 / t::double)), 12) off from ct, tt group by 1), b as (select trial from sc order by off, trial limit 1) select trial, round(f, 2) fraction, place scenes, cn::bigint labels from ct where trial in (select trial from b)"""),
    "r1_stratified_split": (stratified_split, None),
    "r6_held_out_draw": (held_out_draw, """select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by md5(concat_ws('-', '7', doc_id::varchar))) r,
        count(*) over (partition by lang) n from documents where lang is not null) where r <= ceil(n / 10)"""),
    "r4_scene_cover": (scene_cover, None),
    "r5_pattern_draw": (pattern_draw, None),
    "r15_cross_fit": (cross_fit, f"""with {BOX_SQL}, b as (select g.gt, g.cls, g.img % {SCENES} scene, coalesce(max({_I}), 0.0) best from gt g left join pr p on g.img = p.img and g.cls = p.cls group by 1, 2, 3), f as (select scene, dense_rank() over (order by m) % 2 fold from (select scene, min(gt) m from b group by 1)), m as (select cls, fold, avg(best) m, count(*) n from b join f using (scene) group by 1, 2)
select a.cls, a.fold, a.n, round(a.m, 6) own, round(b.m, 6) fitted from m a join m b on a.cls = b.cls and a.fold = 1 - b.fold"""),
    "r13_clicks": (clicks, f"with {BOX_SQL} select gt, round(x1 + ((gt * 7919 + 13) % 997 + 0.5) / 997 * (x2 - x1), 6) cx, round(y1 + ((gt * 7919 + 41) % 997 + 0.5) / 997 * (y2 - y1), 6) cy from gt"),
    "r14_placements": (placements, f"""with {BOX_SQL}, p as (select img, k, x1, y1, x1 + 40 x2, y1 + 30 y2 from (select distinct img, k, ((img * 37 + k * 113) % 460)::double x1, ((img * 53 + k * 197) % 470)::double y1 from gt, range(12) r(k))), f as (select * from p where not exists (select 1 from gt g where g.img = p.img and {_INT} > 120::double))
select img, min(k) tries, arg_min(x1, k) x1, arg_min(y1, k) y1 from f group by 1"""),
    "a21_subset_properties": (subset_properties, f"""with n as (select {_SPLIT} split, label, count(*) n from embeddings group by 1, 2),
      p as (select *, n / sum(n) over (partition by split) p from n)
      select split, sum(n)::bigint n, count(*) labels, min(n) least, sum((n >= 10)::int)::bigint covered, round(-sum(p * ln(p)), 6) entropy from p group by 1"""),
    "a22_count_contrast": (count_contrast, f"""{_NC}, {_ap_sql('u', 'true')}, {_ap_sql('b', 'pred % 10 = 1')}, d as (select n.n < (select avg(n) from n) low, round(ua.ap - ba.ap, 12) d from ua
        join ba using (cls) join n using (cls))
      select round(avg(d) filter (where low), 6) low, round(avg(d) filter (where not low), 6) high, round(avg(d) filter (where low) - avg(d) filter (where not low),
        6) contrast, round(avg(case when low then d else 0.0 end), 6) gated, round(avg(d), 6) fixed from d"""),
    "a23_family_means": (family_means, f"{_FAMILY} select run, mean, wins from fm"),
    "e9_decision_rules": (decision_rules, f"""{_FAMILY}, m as (select max(mean) filter (where run = 0) a, max(mean) filter (where run = 1) b, max(mean) filter (where run = 2) c from fm)
      select 'loses_under_a_point' rule, a - b < 0.01::double passed from m
      union all select 'falls_with_the_bar', a >= b and b >= c from m
      union all select 'half_is_kept', c >= 0.5 * a from m"""),
    "e11_leave_one_out": (leave_one_out, f"""{_NC}, {_ap_sql('u', 'true')}, s as (select sum(ap) s, count(*) k from ua)
      select cls, round((s - ap) / (k - 1), 6) rest, round(s / k - (s - ap) / (k - 1), 6) gap from ua, s"""),
    "e10_subset_gains": (subset_gains, f"with recursive {BOX_SQL}, " + ", ".join(f"t{k} as (select * from gt where img % 8 = {k}), n{k} as (select cls, count(*) n from t{k} group by 1), " + ", ".join(_ap_sql(f"{x}{k}", w, f"t{k}", f"n{k}") for x, w in (("u", "true"), ("b", "pred % 10 = 1"))) for k in (0, 4)) + " " + " union all ".join(f"select {k}::bigint subset, round((select avg(ap) from u{k}a), 6) \"all\", round((select avg(ap) from u{k}a) - (select avg(ap) from b{k}a), 6) gain" for k in (0, 4))),
}
QUERIES = {k: f for k, (f, _) in _TABLE.items()}
ORACLES = {k: s for k, (_, s) in _TABLE.items() if s}
