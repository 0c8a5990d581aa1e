"""The queries without SQL: what must hold of their rows."""

import math

from auditlake import registry

DIR = "/root/testdata/sf0.01"


def rows(spark, name):
    return registry.QUERIES[name](spark, DIR).collect()


def test_all_queries_without_sql_are_here():
    named = {"e3_fractional_logistic", "e4_pixel_probe", "e7_clusters", "g4_split_audit", "j18_view_fusion", "r1_stratified_split", "r4_scene_cover", "r5_pattern_draw"}
    assert set(registry.QUERIES) - set(registry.ORACLES) == named


def test_fitted_models(spark):
    assert {r.name: math.isfinite(r.coefficient) for r in rows(spark, "e3_fractional_logistic")} == {"size": True, "cls": True, "intercept": True}
    sizes = [r.n for r in rows(spark, "e7_clusters")]
    assert len(sizes) == 8 and sum(sizes) == spark.read.parquet(f"{DIR}/embeddings.parquet").count() and min(sizes) > 0
    assert all(0 <= r.right <= r.n for r in rows(spark, "e4_pixel_probe"))


def test_splits_and_draws(spark):
    (audit,) = rows(spark, "g4_split_audit")
    assert audit.matches == 0 and 1 < audit.groups <= audit.vectors
    assert {r.split for r in rows(spark, "r1_stratified_split")} <= {"train", "val", "test"}
    cover, drawn = rows(spark, "r4_scene_cover"), rows(spark, "r5_pattern_draw")
    assert [r.place for r in cover] == list(range(len(cover))) and len({r.grp for r in cover}) == len(cover)
    assert len({r.grp for r in drawn}) == 20 and drawn == rows(spark, "r5_pattern_draw")


def test_view_fusion(spark):
    got = rows(spark, "j18_view_fusion")
    assert len({r.img for r in got}) == len(got) and all(0 < r.boxes <= 300 and 0 < r.mass for r in got)
