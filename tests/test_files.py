"""Scans and sinks over small files with expected rows."""

import hashlib
import json
import struct

import pytest

from auditlake.sinks import files as sinks
from auditlake.sources import files, tables


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height) + b"\x08\x02\0\0\0"


def jpeg(width, height):
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"\0" * 14 + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, height, width) + b"\0" * 10


@pytest.fixture
def data(tmp_path):
    for split, images in (("train", {"a.png": png(200, 100), "b.jpg": jpeg(50, 100)}), ("val", {"c.png": png(10, 10)})):
        for d in ("images", "labels"):
            (tmp_path / split / d).mkdir(parents=True)
        for name, content in images.items():
            (tmp_path / split / "images" / name).write_bytes(content)
    (tmp_path / "train" / "labels" / "a.txt").write_text("1 0.5 0.5 0.5 0.2\n\n0 0.25 0.5 0.5 1\n")
    (tmp_path / "train" / "labels" / "b.txt").write_text("")
    return str(tmp_path)


def test_scan(spark, data):
    rows = {(r.stem, r.cls, r.x1, r.y1, r.x2, r.y2) for r in files.scan(spark, data, "train").collect()}
    assert rows == {("a", 1, 160.0, 128.0, 480.0, 192.0), ("a", 0, 0.0, 0.0, 320.0, 320.0), ("b", None, None, None, None, None)}
    every = files.scan(spark, data, side=None).collect()
    assert {(r.split, r.stem, r.width, r.height, r.x2) for r in every} == {("train", "a", 200, 100, 150.0), ("train", "a", 200, 100, 100.0), ("train", "b", 50, 100, None), ("val", "c", 10, 10, None)}
    assert {(r.stem, r.cls) for r in files.class_rows(spark, f"{data}/train/labels").collect()} == {("a", 0), ("a", 1)}
    both = files.sources(spark, {"x": data, "y": data})
    assert both.groupBy("source").count().collect() == [("x", 4), ("y", 4)] or both.count() == 8


def test_label_modes(spark, tmp_path):
    (tmp_path / "l.txt").write_text("1 .1 .2 .3 .4\n2 .1 .2 .3 .4 .9\n3 .1\n")
    drop, first = ({r.cls for r in tables.label_rows(spark, str(tmp_path), mode).collect()} for mode in ("drop", "first"))
    assert drop == {1} and first == {1, 2}


def test_voc(spark, tmp_path):
    box = lambda name, *b: f"<object><name> {name} </name><bndbox>" + "".join(f"<{k}>{v}</{k}>" for k, v in zip(("xmin", "ymin", "xmax", "ymax"), b, strict=True)) + "</bndbox></object>"
    (tmp_path / "7.xml").write_text("<annotation><size><width>100</width><height>50</height></size>" + box("dent", -5, 1, 120, 20) + box("flat", 5, 9, 5, 20) + "</annotation>")
    (tmp_path / "8.xml").write_text("<annotation><size><width>9</width><height>9</height></size></annotation>")
    assert [tuple(r) for r in files.voc(spark, str(tmp_path)).collect()] == [("7", 100, 50, "dent", 0.0, 1.0, 100.0, 20.0)]


def test_tables_and_lists(spark, tmp_path):
    (tmp_path / "t.csv").write_text('name,subset,extra\n"a, b",train,1\nc,,2\n')
    assert [tuple(r) for r in files.csv_table(spark, str(tmp_path / "t.csv"), "subset string, name string").collect()] == [("train", "a, b"), (None, "c")]
    for k, text in enumerate(("names: ['x', \"y\"]", "names: {0: x, 1: y}", "nc: 2\nnames:\n  0: x\n  1: y\nend: 1", "names:\n- x\n- y\n")):
        (tmp_path / f"{k}.yaml").write_text(text)
        assert [tuple(r) for r in files.catalogue(spark, str(tmp_path / f"{k}.yaml")).collect()] == [(0, "x"), (1, "y")]
    (tmp_path / "l.txt").write_text("a.png\ndir/b.png\n\n")
    assert {r.path for r in files.image_list(spark, str(tmp_path / "l.txt"), "train/images").collect()} == {"train/images/a.png", "dir/b.png"}
    (tmp_path / "m.csv").write_text("epoch,val\n0,0.5\n1,0.9\n2,0.9\n3,\n")
    assert tuple(files.best_epoch(spark, str(tmp_path / "m.csv"), "val").first()) == (3, 2, 0.9)
    (tmp_path / "r.md").write_text("| q |\n|---|\n| 0 |\n\n## Runs\n\n| Run | Best |\n|:--|--:|\n| a | 1 |\n| b | 2 |\n\ntext\n| z |\n")
    assert [r.cells for r in files.pipe_table(spark, str(tmp_path / "r.md"), "## Runs").orderBy("line").collect()] == [["Run", "Best"], ["a", "1"], ["b", "2"]]
    assert files.first_root(spark, [str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        files.first_root(spark, [str(tmp_path / "no")])


def test_predictions(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"a": [[1, 2, 3, 4, 0.5, 1]], "b": []}))
    (tmp_path / "q.json").write_text(json.dumps({"a": []}))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "image_id string")
    got = files.predictions(spark, str(tmp_path / "p.json"), ids("a", "b")).collect()
    assert [(r.image_id, r.x2, r.conf, r.cls) for r in got] == [("a", 3.0, 0.5, 1)]
    with pytest.raises(ValueError, match="without predictions: 1"):
        files.predictions(spark, str(tmp_path / "q.json"), ids("a", "b"))
    paths = [str(tmp_path / x) for x in ("q.json", "p.json")]
    assert files.matching_cache(spark, paths, ids("a", "b")) == paths[1] and files.matching_cache(spark, paths, ids("z")) is None


def test_view_graph_and_pairs(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"b": [["a", 30, None, [[1, 0, 300], [0, 1, 0]], 0.4], ["c", 5, 1, None, 0.0]]}))
    assert [tuple(r) for r in files.view_graph(spark, str(tmp_path / "g.json")).collect()] == [("b", "a", 30, None, 0.4, 1.0, 0.0, 300.0, 0.0, 1.0, 0.0)]
    rows = [("x/images/a", "/y/b", "0", None, "[[1,0,0],[0,1,0]]"), ("x/images/a", "c", "1", "0", "[[1,0,0],[0,1,0]]"), ("d", "e", "0", "0", "null")]
    pairs = spark.createDataFrame(rows, "image_a string, image_b string, same_photo string, flip string, M string")
    real = files.pair_list(pairs, "/base").collect()
    assert [(r.image_a, r.image_b, r.M[0]) for r in real] == [("/base/x/images/a", "/y/b", [1.0, 0.0, 0.0])]
    assert {r.image for r in files.pair_list(pairs, "/base", "synthetic").collect()} == {"/base/x/images/a", "/y/b"}
    kept, used = sinks.export_views(pairs)
    assert {r.image_a for r in kept.collect()} == {"images/x/a", "images/d"} and used.count() == 4


def test_manifest_and_sinks(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for name, text in (("a", "1"), ("b", "2"), ("d", "4")):
        (tmp_path / "f" / name).write_text(text)
    said = spark.createDataFrame([("a", hashlib.sha256(b"1").hexdigest()), ("b", "0" * 64), ("c", "1" * 64)], "path string, sha256 string")
    assert {tuple(r) for r in files.verify_manifest(spark, str(tmp_path / "f"), said).collect()} == {("a", "same"), ("b", "differs"), ("c", "missing"), ("d", "unlisted")}
    df = spark.createDataFrame([("y", 2.5), ("x", None)], "name string, v double")
    sinks.write_names(df, str(tmp_path / "n"))
    assert spark.read.text(str(tmp_path / "n")).count() == 2
    sinks.write_json(df, str(tmp_path / "j"))
    assert {tuple(r) for r in spark.read.schema("name string, v double").json(str(tmp_path / "j")).collect()} == {("y", 2.5), ("x", None)}
    assert sinks.markdown(df, "T").splitlines()[2:] == ["| name | v |", "| --- | --- |", "| y | 2.5000 |", "| x |  |"]
    with pytest.raises(ValueError):
        sinks.markdown(df, "T", most=1)
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("k", "9")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "path string, sha256 string")
    want = {("a", "same"), ("c", "new"), ("k", "kept")}
    assert {tuple(r) for r in sinks.merge_status(new, old).collect()} == want | {("b", "conflict")} and {tuple(r) for r in sinks.merge_status(new, old, True).collect()} == want | {("b", "replaced")}
