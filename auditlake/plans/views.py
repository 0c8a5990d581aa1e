"""Queries over views, vectors as images, evidence graphs, audits of splits and pools, and keys, with their SQL."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import iou, iou_sql
from ..operators import similarity, views
from ..operators.graph import components, stash
from ..sources.tables import BOX_SQL, predicted_boxes, table, truth_boxes
from .audit import _COS, _KNN, _SPLIT, NEIGHBOURS, SCENE, _sides, _vectors
from .detection import _flags, _greedy_sql, _r

SIDE, TWIN, GRID = 500, 0.45, 8


# -- geometry ---------------------------------------------------------------------------------------------------------


def inside_image(spark, sf_dir):
    """Share of each label inside the image."""
    cut = lambda lo, hi: F.greatest(F.least(F.col(hi), F.lit(float(SIDE))) - F.greatest(F.col(lo), F.lit(0.0)), F.lit(0.0))
    return truth_boxes(spark, sf_dir).select("gt", _r(cut("x1", "x2") * cut("y1", "y2") / F.greatest((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), F.lit(1e-9)), "share"))


def _maps(gt: DataFrame) -> dict[str, Column]:
    """A map for each label: turned, scaled, and shifted to the label's corner."""
    a, b = 0.3 + (F.col("gt") % 9) / 10, ((F.col("gt") % 5) - 2) / 10
    return {"a": a, "b": -b, "tx": F.col("x1") - 100, "c": b, "d": a, "ty": F.col("y1") - 100}


def view_coverage(spark, sf_dir):
    """Share of a frame that a moved frame covers, by its clamped polygon and by a grid, and whether the map's scale is sane."""
    gt = truth_boxes(spark, sf_dir)
    m = _maps(gt)
    s = views.scale_of(m)
    return gt.select("gt", _r(views.clamped_coverage(m, SIDE), "polygon"), _r(views.grid_coverage(m, SIDE, GRID), "grid"), ((s > 0.33) & (s < 3)).cast("int").alias("sane"))


def moved_boxes(spark, sf_dir):
    """Predictions moved into another view, by what becomes of them there."""
    pr = predicted_boxes(spark, sf_dir)
    box = {"x1": F.col("x1") * 0.9 + 40, "y1": F.col("y1") * 1.1 - 20, "x2": F.col("x2") * 0.9 + 40, "y2": F.col("y2") * 1.1 - 20}
    there = pr.select("pred", "cls", "conf", *[v.alias(k) for k, v in box.items()])
    outcome = views.transfer_outcome(("x1", "y1", "x2", "y2"), "conf", 0.2 + 0.1 * F.col("cls"), (100.0, 100.0, 420.0, 420.0), agreement=(F.col("pred") * 31 % 100) / 100)
    return there.select("cls", outcome.alias("outcome")).groupBy("cls", "outcome").agg(F.count("*").alias("n"))


def local_support(spark, sf_dir):
    """Labels with centres of two predictions or more in the box widened by a tenth, and four fifths inside the image."""
    gt, pr = truth_boxes(spark, sf_dir), predicted_boxes(spark, sf_dir)
    wide = lambda c, w, s: F.col(f"g.{c}") + s * 0.05 * (F.col(f"g.{w}2") - F.col(f"g.{w}1"))
    cx, cy = (F.col("p.x1") + F.col("p.x2")) / 2, (F.col("p.y1") + F.col("p.y2")) / 2
    at = (F.col("g.img") == F.col("p.img")) & cx.between(wide("x1", "x", -1), wide("x2", "x", 1)) & cy.between(wide("y1", "y", -1), wide("y2", "y", 1))
    n = gt.alias("g").join(pr.alias("p"), at).groupBy("g.gt").agg(F.count("*").alias("support"))
    return n.where("support >= 2").join(inside_image(spark, sf_dir).where("share >= 0.8"), "gt").select("gt", "support")


def gated_blend(spark, sf_dir):
    """Predictions blended half and half with their refined box where the two agree at 0.8, and as they are elsewhere."""
    pr = predicted_boxes(spark, sf_dir)
    shift = lambda c, k: F.col(c) + (F.col("pred") * k % 13) - 6
    fine = pr.where("pred % 3 <> 0").select("img", "pred", *[shift(c, k).alias(c) for c, k in (("x1", 3), ("y1", 5), ("x2", 7), ("y2", 11))])
    j = pr.alias("p").join(fine.alias("q"), (F.col("p.img") == F.col("q.img")) & (F.col("p.pred") == F.col("q.pred")), "left")
    ok = F.coalesce(iou("p", "q") >= 0.8, F.lit(False))
    return j.select("p.pred", ok.cast("int").alias("refined"), *[F.when(ok, (F.col(f"p.{c}") + F.col(f"q.{c}")) / 2).otherwise(F.col(f"p.{c}")).alias(c) for c in ("x1", "y1", "x2", "y2")])


def view_fusion(spark, sf_dir):
    """Predictions of an image fused with those of two other views."""
    pr = predicted_boxes(spark, sf_dir)
    imgs = pr.select("img").distinct()
    link = lambda step, a, tx, stratum: imgs.select("img", F.pmod(F.col("img") + step, F.lit(400)).alias("src"), F.lit(stratum).alias("stratum"), F.lit(a).alias("a"), F.lit(0.0).alias("b"), F.lit(tx).alias("tx"), F.lit(0.0).alias("c"), F.lit(a).alias("d"), F.lit(0.0).alias("ty"))
    graph = link(4, 1.0, 60.0, "other").unionAll(link(8, 0.9, 0.0, "same"))
    return views.fuse(pr, graph, side=float(SIDE), weight=0.5).groupBy("img").agg(F.count("*").alias("boxes"), _r(F.sum("conf"), "mass"))


def view_pairs(spark, sf_dir):
    """Pairs of same-scene vectors, each in both directions."""
    k = similarity.similarity_join(*_sides(_vectors(spark, sf_dir)), k=NEIGHBOURS).where(F.col("sim") >= SCENE).select("qid", "bid")
    return k.unionAll(k.select("bid", "qid")).distinct().toDF("a", "b")


def best_setting(spark, sf_dir):
    """The score bar with the largest F1 on one part of the images, the first of equal ones, and what it gives on another part."""
    gt, pr = truth_boxes(spark, sf_dir), predicted_boxes(spark, sf_dir)
    flags = _flags(gt, pr).withColumn("part", F.col("img") % 16).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(9)))).where(F.col("conf") >= F.col("t") / 10)
    n = gt.groupBy((F.col("img") % 16).alias("part")).agg(F.count("*").alias("n"))
    f1 = flags.groupBy("part", "t").agg(F.sum("tp").alias("tp"), F.count("*").alias("k")).join(n, "part").select("part", "t", F.round(2 * F.col("tp") / (F.col("k") + F.col("n")), 9).alias("f1"))
    best = f1.where("part = 4").agg(F.max_by("t", F.struct("f1", (-F.col("t")).alias("i"))).alias("t"))
    return f1.join(F.broadcast(best), "t").groupBy("t").agg(_r(F.max(F.when(F.col("part") == 4, F.col("f1"))), "chosen_on"), _r(F.max(F.when(F.col("part") == 12, F.col("f1"))), "reported"))


# -- vectors as small images ------------------------------------------------------------------------------------------


def centred_vectors(spark, sf_dir):
    """Mean and length of each vector, and the first entry once centred and scaled to length one."""
    v = F.transform("vec", lambda x: x.cast("double"))
    e = _vectors(spark, sf_dir).select("vec_id", v.alias("v")).withColumn("m", F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v"))
    e = e.withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m")))))
    return e.select("vec_id", _r(F.col("m"), "mean"), _r(F.col("n"), "length"), _r((F.col("v")[0] - F.col("m")) / F.col("n"), "first"))


def turns(side: int = GRID) -> list[list[int]]:
    """The eight turned and mirrored orders of a square's cells."""
    out = []
    for swap in (False, True):
        for down in (False, True):
            for back in (False, True):
                cells = [(j, i) if swap else (i, j) for i in range(side) for j in range(side)]
                out.append([(side - 1 - i if down else i) * side + (side - 1 - j if back else j) for i, j in cells])
    return out


def dihedral_match(spark, sf_dir):
    """For each test vector, as a square image in eight positions, the train vector with the largest correlation."""
    e = _vectors(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: x.cast("double")))
    centred = lambda c: F.transform(c, lambda x: x - F.aggregate(c, F.lit(0.0), lambda a, y: a + y) / F.size(c))
    e = e.select("vec_id", "split", centred(F.col("vec")).alias("vec"))
    spun = F.explode(F.array(*[F.struct(F.lit(k).alias("v"), F.transform(F.array(*map(F.lit, order)), lambda i: F.element_at("vec", i + 1)).alias("vec")) for k, order in enumerate(turns())])).alias("s")
    q = e.where("split = 'test'").select("vec_id", spun).select((F.col("vec_id") * 8 + F.col("s.v")).alias("qid"), F.col("s.vec").alias("vec"))
    base = e.where("split = 'train'").select((-F.col("vec_id") - 1).alias("bid"), "vec")  # its own range of ids
    best = similarity.similarity_join(q, base, k=1).select(F.floor(F.col("qid") / 8).alias("vec_id"), (F.col("qid") % 8).alias("turn"), (-F.col("bid") - 1).alias("match"), F.round("sim", 9).alias("sim"))
    top = best.groupBy("vec_id").agg(F.max(F.struct("sim", (-F.col("turn")).alias("t"), (-F.col("match")).alias("m"))).alias("b"))
    return top.select("vec_id", _r(F.col("b.sim"), "sim"), (-F.col("b.m")).alias("match"))


def masked_correlation(spark, sf_dir):
    """Correlation of neighbouring vectors over a mask of their entries; null where the mask leaves under forty or one side is flat."""
    e = _vectors(spark, sf_dir).select("vec_id", F.posexplode("vec").alias("i", "x"))
    j = e.alias("p").join(e.alias("q"), (F.col("q.vec_id") == F.col("p.vec_id") + 1) & (F.col("p.i") == F.col("q.i")))
    j = j.where((F.col("p.i") * 7 + F.col("p.vec_id")) % 3 < F.when(F.col("p.vec_id") % 10 == 0, 1).otherwise(2))
    c = j.groupBy("p.vec_id").agg(F.count("*").alias("n"), F.corr(F.col("p.x").cast("double"), F.col("q.x").cast("double")).alias("r"))
    return c.select("vec_id", "n", _r(F.when(F.col("n") >= 40, F.col("r")), "zncc"))


def box_means(spark, sf_dir):
    """Mean of the cells in a box of each vector's square, or its middle cell where the box is empty."""
    x1, y1 = F.col("vec_id") % 5, F.floor(F.col("vec_id") / 5) % 5
    x2, y2 = x1 + F.col("vec_id") % 4, y1 + 1 + F.col("vec_id") % 3
    e = _vectors(spark, sf_dir).select("vec_id", "vec", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    cells = F.filter(F.sequence(F.lit(0), F.lit(GRID * GRID - 1)), lambda k: (k % GRID >= F.col("x1")) & (k % GRID < F.col("x2")) & (F.floor(k / GRID) >= F.col("y1")) & (F.floor(k / GRID) < F.col("y2")))
    e = e.withColumn("cells", cells)
    total = F.aggregate("cells", F.lit(0.0), lambda a, k: a + F.element_at("vec", k.cast("int") + 1))
    middle = F.element_at("vec", GRID * GRID // 2 + GRID // 2 + 1).cast("double")
    return e.select("vec_id", F.size("cells").cast("long").alias("cells"), _r(F.when(F.size("cells") > 0, total / F.size("cells")).otherwise(middle), "mean"))


# -- evidence, splits, pools ------------------------------------------------------------------------------------------


def evidence_groups(spark, sf_dir):
    """Groups joined by a shared source key, by verified pairs, or by same-scene neighbours. A key's members hang on its smallest."""
    e = _vectors(spark, sf_dir)
    key = e.where("vec_id % 7 = 0").select("vec_id", F.concat_ws(":", "label", F.floor(F.col("vec_id") / 50)).alias("key"))
    star = key.select(F.min("vec_id").over(Window.partitionBy("key")).alias("a"), F.col("vec_id").alias("b"))
    sims = stash(similarity.similarity_join(*_sides(e), k=NEIGHBOURS))
    checked = sims.where((F.col("sim") >= 0.38) & ((F.col("qid") + F.col("bid")) % 11 == 0))
    edges = star.unionAll(checked.select("qid", "bid")).unionAll(sims.where(F.col("sim") >= SCENE).select("qid", "bid"))
    roots = components(edges)
    return e.select("vec_id").join(roots, F.col("vec_id") == F.col("node"), "left").select("vec_id", F.coalesce("root", "vec_id").alias("group_id"))


def split_audit(spark, sf_dir):
    """Splits whole groups, joins the groups of held-out and train vectors that match, and splits anew until none match.

    Each round with a match joins two groups at least, so it ends; about two fifths of the open pairs are met in a round, so rounds
    grow with the logarithm of their number.
    """
    e = stash(_vectors(spark, sf_dir).select("vec_id", "vec"))
    pairs = stash(similarity.similarity_join(*_sides(e), low=TWIN).where("qid < bid").select("qid", "bid"))
    used = pairs.limit(0)
    for round_ in itertools.count(1):
        roots = components(used)
        group = stash(e.select("vec_id").join(roots, F.col("vec_id") == F.col("node"), "left").select("vec_id", F.coalesce("root", "vec_id").alias("grp")))
        held = group.withColumn("held", F.pmod(F.xxhash64(F.lit(round_), "grp"), F.lit(10)) >= 7)
        x, y = held.toDF("qid", "qg", "qh"), held.toDF("bid", "bg", "bh")
        bad = stash(pairs.join(x, "qid").join(y, "bid").where("qh <> bh").select("qid", "bid"))
        if not bad.head(1):
            return held.agg(F.count_distinct("grp").alias("groups"), F.count("*").alias("vectors"), F.lit(0).cast("long").alias("matches"))
        used = stash(used.unionAll(bad))


def decontaminated(spark, sf_dir):
    """Train vectors by status: twin of a test vector, in the closure of twins, or kept; with the round and the match found first.

    Each round joins only what the round before found with what is left, and ends when nothing is found.
    """
    e = _vectors(spark, sf_dir)
    left = stash(e.where("split = 'train'").selectExpr("vec_id qid", "vec"))
    front = stash(e.where("split = 'test'").selectExpr("vec_id bid", "vec"))
    found = None
    for round_ in range(1, 1 + left.count()):
        near = similarity.similarity_join(left, front, low=TWIN)
        best = near.groupBy("qid").agg(F.max(F.struct(F.round("sim", 9).alias("sim"), (-F.col("bid")).alias("b"))).alias("m"))
        new = stash(best.select("qid", F.lit(round_).cast("long").alias("round"), (-F.col("m.b")).alias("match"), F.col("m.sim").alias("sim")))
        if not new.head(1):
            break
        found = new if found is None else found.unionAll(new)
        front = stash(left.join(new.select("qid"), "qid", "left_semi").selectExpr("qid bid", "vec"))
        left = stash(left.join(new.select("qid"), "qid", "left_anti"))
    rows = e.where("split = 'train'").select("vec_id")
    found = found if found is not None else spark.createDataFrame([], "qid long, round long, match long, sim double")
    status = F.when(F.col("round") == 1, "twin").when(F.col("round") > 1, "closure").otherwise("kept")
    return rows.join(found, F.col("vec_id") == F.col("qid"), "left").select("vec_id", status.alias("status"), "round", "match", _r(F.col("sim"), "sim"))


def pool_audit(spark, sf_dir):
    """How near the kept vectors come to any test vector: the largest cosine, percentiles, and how many pass the bar."""
    e = _vectors(spark, sf_dir)
    best = similarity.similarity_join(_sides(e.where("split = 'train'"))[0], _sides(e.where("split = 'test'"))[1], k=1)
    q = F.percentile("sim", F.array(F.lit(0.999), F.lit(0.99), F.lit(0.5))).alias("q")
    s = best.agg(F.count("*").alias("kept"), F.max("sim").alias("m"), q, F.count_if(F.col("sim") >= TWIN).alias("twins"))
    return s.select("kept", _r(F.col("m"), "largest"), *[_r(F.col("q")[i], n) for i, n in enumerate(("p999", "p99", "p50"))], "twins")


def _overlap_pairs(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.selectExpr("doc_id a", "text x").join(d.selectExpr("doc_id - 1 a", "doc_id b", "text y"), "a").where("x is not null and y is not null")


def word_overlap(pairs: pd.DataFrame) -> pd.Series:
    """Jaccard similarity of the words of both texts."""
    sets = [(set(x.split(" ")), set(y.split(" "))) for x, y in zip(pairs["x"], pairs["y"], strict=True)]
    return pd.Series([len(a & b) / len(a | b) for a, b in sets], index=pairs.index, dtype=float)


def verified_pairs(spark, sf_dir):
    """Neighbouring documents verified by their words; pairs that a cache has aren't verified again."""
    pairs = _overlap_pairs(spark, sf_dir)
    cache = pairs.where("a % 4 = 0").select("b", "a", F.lit(-1.0).alias("score"))
    return views.verified(pairs, word_overlap, cache).select("a", "b", _r(F.col("score"), "score"))


# -- keys -------------------------------------------------------------------------------------------------------------


def scene_rule(spark, sf_dir):
    """Documents of even id are allowed only from a train group: kept, from another group, or of no known group."""
    g = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(g, "doc_id", "left")
    status = F.when((F.col("doc_id") % 2 == 1) | (F.col("q") == 1), "kept").when(F.col("q").isNull(), "no_group").otherwise("scene")
    return d.groupBy("source", status.alias("status")).agg(F.count("*").alias("n"))


def partner_flags(spark, sf_dir):
    """Held-out vectors by whether a train vector of the same scene exists; null where none could be assessed (every fifth here)."""
    e = _vectors(spark, sf_dir)
    near = similarity.similarity_join(_sides(e.where("split <> 'train' and vec_id % 5 <> 0"))[0], _sides(e.where("split = 'train'"))[1], k=1)
    return e.where("split <> 'train'").select("vec_id").join(near.select(F.col("qid").alias("vec_id"), (F.round("sim", 9) >= SCENE).cast("int").alias("leaked")), "vec_id", "left")


def key_lookup(spark, sf_dir):
    """Keys asked for, found once, several times, or missing."""
    ask = table(spark, sf_dir, "labels").select((F.col("doc_id") + F.when(F.col("doc_id") % 9 == 0, 1_000_000).otherwise(0)).alias("doc_id")).distinct()
    n = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count("*").alias("n"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "found").otherwise("several")
    return ask.join(n, "doc_id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("keys"))


def integrity(spark, sf_dir):
    """Checks that must count nothing: labelled images without predictions, labels outside a document, vectors without an entry."""
    gt, pr = truth_boxes(spark, sf_dir), predicted_boxes(spark, sf_dir)
    counts = {
        "images_without_predictions": gt.select("img").distinct().join(pr.select("img").distinct(), "img", "left_anti"),
        "labels_without_document": table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id", "left_anti"),
        "empty_vectors": table(spark, sf_dir, "embeddings").where(F.size("embedding") == 0),
    }
    out = None
    for name, rows in counts.items():
        one = rows.agg(F.lit(name).alias("check"), F.count("*").alias("rows"))
        out = one if out is None else out.unionAll(one)
    return out


def evaluation_keys(spark, sf_dir):
    """Distinct keys that any of three sources names, by source."""
    a = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.lit("documents").alias("source"), F.col("doc_id").alias("key"))
    b = table(spark, sf_dir, "labels").where("toxic = 1").select(F.lit("documents").alias("source"), F.col("doc_id").alias("key"))
    c = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("source"), F.col("item_id").alias("key"))
    return a.unionByName(b).unionByName(c).distinct().groupBy("source").agg(F.count("*").alias("keys"))


def numeric_order(spark, sf_dir):
    """The first thirty file names by the number in them."""
    names = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")).alias("name"))
    return names.orderBy(F.regexp_extract("name", r"_([0-9]+)\.", 1).cast("long")).limit(30)


def path_parts(spark, sf_dir):
    """Base name, stem and extension of each page's path, and the path flattened to one name."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return table(spark, sf_dir, "pages").select("page_id", base.alias("base"), F.regexp_replace(base, r"\.[^.]*$", "").alias("stem"), F.regexp_extract(base, r"(\.[^.]*)$", 1).alias("ext"), F.regexp_replace(path, "/", "__").alias("flat"))


def class_slots(spark, sf_dir):
    """Labels by class after a remap to slots, some dropped, and with all classes as one."""
    slots = spark.createDataFrame([(0, 10), (1, 10), (2, 12), (4, 14)], "cls long, slot long")
    own = truth_boxes(spark, sf_dir).join(F.broadcast(slots), "cls", "left")
    return own.groupBy("slot").agg(F.count("*").alias("n"), F.count_distinct("cls").alias("classes"), F.min(F.lit(0)).cast("long").alias("agnostic"))


_EDGES3 = f"""with recursive e as (select vec_id, embedding, label, {_SPLIT} split from embeddings), p as (select a.vec_id qid, b.vec_id bid, list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(b.embedding::double[], b.embedding::double[])) sim from e a, e b where a.vec_id <> b.vec_id),
k as (select * from (select *, row_number() over (partition by qid order by round(sim, 12) desc, bid) r from p) where r <= {NEIGHBOURS}), ky as (select vec_id, label || ':' || (vec_id // 50) key from e where vec_id % 7 = 0),
ed as materialized (select a, b from (select min(vec_id) over (partition by key) a, vec_id b from ky) where a <> b union select qid, bid from k where (sim >= 0.38 and (qid + bid) % 11 = 0) or sim >= {SCENE}),
r as (select vec_id, vec_id root from e union select case when r.vec_id = ed.a then ed.b else ed.a end, r.root from r join ed on r.vec_id in (ed.a, ed.b))"""
_ORDERS = "(values " + ", ".join(f"({k}, {order})" for k, order in enumerate(turns())) + ") t(turn, ord)"
_CENTRED = "list_transform(embedding::double[], lambda x: x - list_avg(embedding::double[]))"
_SQ = lambda v: f"list_dot_product({v}, {v})"

_TABLE = {
    "p3_inside_image": (inside_image, f"""with {BOX_SQL} select gt, round(greatest(least(x2, {SIDE}) - greatest(x1, 0), 0) * greatest(least(y2, {SIDE}) - greatest(y1, 0),
        0) / greatest((x2 - x1) * (y2 - y1), 1e-9), 6) share from gt"""),
    "p7_view_coverage": (view_coverage, f"""with {BOX_SQL}, m as (select gt, 0.3::double + (gt % 9) / 10 a, ((gt % 5) - 2) / 10 b, x1 - 100 tx, y1 - 100 ty from gt),
c as (select gt, a, b, tx, ty, least(greatest(tx, 0), 500) px1, least(greatest(ty, 0), 500) py1, least(greatest(500 * a + tx, 0), 500) px2, least(greatest(500 * b + ty, 0), 500) py2, least(greatest(500 * a - 500 * b + tx, 0), 500) px3, least(greatest(500 * b + 500 * a + ty, 0), 500) py3, least(greatest(-500 * b + tx, 0), 500) px4, least(greatest(500 * a + ty, 0), 500) py4 from m),
g as (select gt, avg((x >= 0 and x < 500 and y >= 0 and y < 500)::int) grid from (select gt, round((a * (u - tx) + b * (v - ty)) / (a * a + b * b), 9) x, round((-b * (u - tx) + a * (v - ty)) / (a * a + b * b), 9) y from m, (select (i + 0.5::double) * 500 / {GRID} u from range({GRID}) r(i)), (select (i + 0.5::double) * 500 / {GRID} v from range({GRID}) r(i))) group by 1)
select gt, round(abs(px1 * py2 - px2 * py1 + px2 * py3 - px3 * py2 + px3 * py4 - px4 * py3 + px4 * py1 - px1 * py4) / 2 / 250000, 6) polygon, round(grid, 6) grid, (sqrt(a * a + b * b) > 0.33 and sqrt(a * a + b * b) < 3)::int sane from c join g using (gt)"""),
    "f6_moved_boxes": (moved_boxes, f"""with {BOX_SQL}, m as (select pred, cls, conf, x1 * 0.9::double + 40 x1, y1 * 1.1::double - 20 y1, x2 * 0.9::double + 40 x2, y2 * 1.1::double - 20 y2 from pr),
      w as (select *, least(x2, 420) - greatest(x1, 100) w, least(y2, 420) - greatest(y1, 100) h from m)
      select cls, case when conf < 0.2::double + 0.1::double * cls then 'unsure' when w < 4 or h < 4 then 'outside' when w * h / ((x2 - x1) * (y2 - y1)) < 0.5 or pred * 31 % 100 < 50 then 'ignored' else 'kept' end outcome, count(*) n from w group by 1, 2"""),
    "f4_local_support": (local_support, f"""with {BOX_SQL}, s as (select g.gt, count(*) support from gt g join pr p on g.img = p.img and (p.x1 + p.x2) / 2 between g.x1 - 0.05::double * (g.x2 - g.x1)
        and g.x2 + 0.05::double * (g.x2 - g.x1) and (p.y1 + p.y2) / 2 between g.y1 - 0.05::double * (g.y2 - g.y1) and g.y2 + 0.05::double * (g.y2 - g.y1) group by 1)
      select gt, support from s join gt using (gt) where support >= 2 and greatest(least(x2, {SIDE}) - x1, 0) * greatest(least(y2, {SIDE}) - y1,
        0) / ((x2 - x1) * (y2 - y1)) >= 0.8"""),
    "j21_gated_blend": (gated_blend, f"""with {BOX_SQL}, q as (select img, pred, x1 + pred * 3 % 13 - 6 x1, y1 + pred * 5 % 13 - 6 y1, x2 + pred * 7 % 13 - 6 x2, y2 + pred * 11 % 13 - 6 y2 from pr
        where pred % 3 <> 0),
      j as (select p.*, q.x1 a, q.y1 b, q.x2 c, q.y2 d, coalesce({iou_sql('p', 'q')} >= 0.8, false) ok from pr p left join q on p.img = q.img and p.pred = q.pred)
      select pred, ok::int refined, case when ok then (x1 + a) / 2 else x1 end x1, case when ok then (y1 + b) / 2 else y1 end y1,
        case when ok then (x2 + c) / 2 else x2 end x2, case when ok then (y2 + d) / 2 else y2 end y2 from j"""),
    "j18_view_fusion": (view_fusion, None),
    "j20_view_pairs": (view_pairs, _KNN + f", q as (select qid, bid from k where rank <= {NEIGHBOURS} and sim >= {SCENE}) select qid a, bid b from q union select bid, qid from q"),
    "t3_best_setting": (best_setting, f"""with recursive {BOX_SQL}, {_greedy_sql('m', levels=1)}, f as (select p.img % 16 part, t, (m.pred is not null)::int tp from pr p cross join range(10) r(t) left
        join (select pred from ms where pick is not null) m using (pred) where p.img in (select img from gt) and conf >= t / 10::double),
      n as (select img % 16 part, count(*) n from gt group by 1),
      s as (select part, t, round(2 * sum(tp) / (count(*) + any_value(n))::double, 9) f1 from f join n using (part) group by 1, 2),
      b as (select t from s where part = 4 order by f1 desc, t limit 1)
      select t, round(max(case when part = 4 then f1 end), 6) chosen_on, round(max(case when part = 12 then f1 end), 6) reported from s join b using (t) group by 1"""),
    "p18_centred_vectors": (centred_vectors, f"""with c as (select vec_id, list_avg(embedding::double[]) m, {_CENTRED} v from embeddings)
      select vec_id, round(m, 6) mean, round(sqrt({_SQ('v')}), 6) length, round(v[1] / sqrt({_SQ('v')}), 6) first from c"""),
    "j4_dihedral_match": (dihedral_match, f"""with e as (select vec_id, {_SPLIT} split, {_CENTRED} v from embeddings),
      q as (select vec_id, turn, list_transform(ord, lambda i: v[i + 1]) v from e, {_ORDERS} where split = 'test'),
      s as (select q.vec_id, q.turn, b.vec_id match, round(list_dot_product(q.v, b.v) / sqrt({_SQ('q.v')} * {_SQ('b.v')}), 9) sim from q, e b where b.split = 'train')
      select vec_id, round(sim, 6) sim, match from (select *, row_number() over (partition by vec_id order by sim desc, turn, match) r from s) where r = 1"""),
    "p20_masked_correlation": (masked_correlation, """with x as (select vec_id, generate_subscripts(embedding, 1) - 1 i, unnest(embedding)::double x from embeddings),
      c as (select p.vec_id, count(*) n, corr(p.x, q.x) r from x p join x q on q.vec_id = p.vec_id + 1 and q.i = p.i where (p.i * 7 + p.vec_id) % 3 <
        case when p.vec_id % 10 = 0 then 1 else 2 end group by 1)
      select vec_id, n, round(case when n >= 40 then r end, 6) zncc from c"""),
    "p22_box_means": (box_means, f"""with b as (select vec_id, embedding::double[] v, vec_id % 5 x1, vec_id // 5 % 5 y1, vec_id % 5 + vec_id % 4 x2, vec_id // 5 % 5 + 1 + vec_id % 3 y2 from embeddings),
      c as (select vec_id, v[k + 1] x from b, range({GRID * GRID}) r(k) where k % {GRID} >= x1 and k % {GRID} < x2 and k // {GRID} >= y1 and k // {GRID} < y2)
      select b.vec_id, count(x) cells, round(coalesce(avg(x), any_value(v[{GRID * GRID // 2 + GRID // 2 + 1}])), 6) mean from b left join c using (vec_id) group by 1"""),
    "g3_evidence_groups": (evidence_groups, _EDGES3 + " select vec_id, min(root) group_id from r group by 1"),
    "g4_split_audit": (split_audit, None),
    "g5_decontaminated": (decontaminated, _COS.replace("with e as", "with recursive e as", 1) + f""", ed as materialized (select qid, bid, round(sim, 9) sim from p where sim >= {TWIN} and qs = 'train' and bs in ('train', 'test')),
l(vec_id, lvl) as (select vec_id, 0 from e where split = 'test' union select ed.qid, l.lvl + 1 from l join ed on ed.bid = l.vec_id where l.lvl < 40), f as (select vec_id, min(lvl) lvl from l group by 1),
m as (select a.vec_id, ed.bid, ed.sim, row_number() over (partition by a.vec_id order by ed.sim desc, ed.bid) r from f a join ed on ed.qid = a.vec_id join f b on b.vec_id = ed.bid and b.lvl = a.lvl - 1 where a.lvl > 0)
select e.vec_id, case when lvl = 1 then 'twin' when lvl > 1 then 'closure' else 'kept' end status, lvl::bigint round, m.bid as match, round(m.sim, 6) sim from e left join f using (vec_id) left join m on m.vec_id = e.vec_id and r = 1 where split = 'train'"""),
    "g7_pool_audit": (pool_audit, _COS + f""", b as (select qid, max(sim) sim from p where qs = 'train' and bs = 'test' group by 1)
      select count(*) kept, round(max(sim), 6) largest, round(quantile_cont(sim, 0.999), 6) p999, round(quantile_cont(sim, 0.99), 6) p99, round(quantile_cont(sim,
        0.5), 6) p50, sum((sim >= {TWIN})::int)::bigint twins from b"""),
    "j6_verified_pairs": (verified_pairs, """with p as (select a.doc_id a, b.doc_id b, list_distinct(string_split(a.text, ' ')) x, list_distinct(string_split(b.text, ' ')) y from documents a
        join documents b on b.doc_id = a.doc_id + 1 where a.text is not null and b.text is not null),
      i as (select a, b, len(list_intersect(x, y)) i, len(x) + len(y) s from p)
      select a, b, case when a % 4 = 0 then -1.0 else round(i / (s - i), 6) end score from i"""),
    "f2_scene_rule": (scene_rule, """with g as (select doc_id, max(quality) q from labels group by 1)
      select source, case when doc_id % 2 = 1 or q = 1 then 'kept' when q is null then 'no_group' else 'scene' end status, count(*) n from documents left
        join g using (doc_id) group by 1, 2"""),
    "j13_partner_flags": (partner_flags, _COS + f""", b as (select qid, max(round(sim, 9)) sim from p where qs <> 'train' and bs = 'train' and qid % 5 <> 0 group by 1)
      select vec_id, (sim >= {SCENE})::int leaked from e left join b on qid = vec_id where split <> 'train'"""),
    "j14_key_lookup": (key_lookup, """with a as (select distinct doc_id + case when doc_id % 9 = 0 then 1000000 else 0 end doc_id from labels),
      n as (select doc_id, count(*) n from documents group by 1)
      select case when n is null then 'missing' when n = 1 then 'found' else 'several' end state, count(*) as \"keys\" from a left join n using (doc_id) group by 1"""),
    "f9_integrity": (integrity, f"""with {BOX_SQL} select 'images_without_predictions' as \"check\", count(distinct img) as \"rows\" from gt where img not in (select img from pr)
      union all select 'labels_without_document', count(*) from labels where doc_id not in (select doc_id from documents)
      union all select 'empty_vectors', count(*) from embeddings where len(embedding) = 0"""),
    "u1_evaluation_keys": (evaluation_keys, """select source, count(*) as \"keys\" from (select 'documents' source, doc_id k from documents where lang = 'en' union select 'documents', doc_id from labels
        where toxic = 1 union select 'benchmark', item_id from benchmark) group by 1"""),
    "t6_numeric_order": (numeric_order, "select 'doc_' || doc_id || '.txt' as name from documents order by doc_id limit 30"),
    "p12_path_parts": (path_parts, r"""with p as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') path from pages),
      b as (select page_id, path, regexp_extract(path, '([^/]*)$', 1) base from p)
      select page_id, base, regexp_replace(base, '\.[^.]*$', '') stem, regexp_extract(base, '(\.[^.]*)$', 1) ext, replace(path, '/', '__') flat from b"""),
    "p13_class_slots": (class_slots, f"""with {BOX_SQL}, s as (select * from (values (0, 10), (1, 10), (2, 12), (4, 14)) v(cls, slot))
      select slot::bigint slot, count(*) n, count(distinct cls) classes, 0::bigint agnostic from gt left join s using (cls) group by 1"""),
}
QUERIES = {k: f for k, (f, _) in _TABLE.items()}
ORACLES = {k: s for k, (_, s) in _TABLE.items() if s}
