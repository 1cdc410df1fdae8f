import json
from datetime import datetime

from baglight.operators.nested import found_objects, nested_table

AT = datetime(2024, 1, 1)
SHAPES = {"imagePath": "..\\Images\\a.jpg", "imageWidth": 10, "shapes": [{"label": "Gun", "points": [[1, 2], [3, 4.5]]}, None, {"label": None, "points": None}]}
LINKED = {"images": [{"id": 7, "file_name": "x/b.jpg"}, {"id": "8", "file_name": "c.jpg"}], "categories": [{"id": "1", "name": "Knife"}], "annotations": [{"image_id": "7", "category_id": 1, "segmentation": [[0, 1, 2, 3]]}, {"image_id": 99}, {"image_id": 8.0}, {}]}
TREE = {"export": {"batches": {"images": [{"objects": {"parts": [{"label": {"name": "p"}, "parts": {"geometry": {"rings": [[[0, 0], [1, 1]]]}}}], "label": {"name": "o"}}, "file_name": "d.jpg"}, {"file_name": None, "objects": [{}]}, {"file_name": "e.jpg", "objects": [{}]}]}}}


def files(spark, texts):
    return spark.createDataFrame([(i, t, AT, "extra") for i, t in texts], "file_id long, payload string, read_at timestamp, label string")


def test_layouts_wrapping_and_broken_texts(spark):
    d = json.dumps
    df = files(spark, [(1, d(SHAPES)), (2, "﻿ " + d(d(LINKED)) + "\n"), (3, d(TREE)), (4, d(SHAPES)[:-1]), (5, None), (6, ""), (7, "[1]"), (8, d({"imagePath": "f.jpg", "shapes": {"label": "x"}})), (9, d({"imagePath": None, "shapes": [{}]})), (1, d(SHAPES))])
    got = sorted(tuple(r) for r in found_objects(df).collect())
    assert got == [(1, "a.jpg", 1), (1, "a.jpg", 3), (2, "b.jpg", 1), (2, "c.jpg", 3), (3, "d.jpg", 1), (3, "d.jpg", 2), (3, "d.jpg", 3), (3, "e.jpg", 5), (8, "f.jpg", 1)]
    o = {(r.file_id, r.object_no): r for r in nested_table(df, "object").collect()}
    assert o[3, 2].parent_no == 1 and o[3, 3].parent_no == 2 and o[3, 1].parent_no is None and o[3, 1].label == "o"
    assert o[2, 1].label == "Knife" and o[2, 2].image_no is None
    points = {(r.file_id, r.object_no, r.point_no): (r.x, r.y) for r in nested_table(df, "point").collect()}
    assert points == {(1, 1, 1): (1.0, 2.0), (1, 1, 2): (3.0, 4.5), (2, 1, 1): (0.0, 1.0), (2, 1, 2): (2.0, 3.0), (3, 3, 1): (0.0, 0.0), (3, 3, 2): (1.0, 1.0)}
    assert {(r.file_id, r.image_name) for r in nested_table(df, "image").collect()} >= {(1, "a.jpg"), (2, "b.jpg"), (3, "e.jpg")}


def test_the_newest_text_of_a_file_counts_and_empty_tables_work(spark):
    df = spark.createDataFrame([(1, json.dumps(SHAPES), AT), (1, "{", datetime(2024, 1, 2))], "file_id long, payload string, read_at timestamp")
    assert found_objects(df).count() == 0
    assert nested_table(df.limit(0), "ring").count() == 0


def test_very_deep_and_long_texts(spark):
    part = {"label": {"name": "x"}}
    for _ in range(200):
        part = {"parts": [part]}
    wide = {"imagePath": "w.jpg", "shapes": [{"points": [[i, i]]} for i in range(20000)]}
    df = files(spark, [(1, json.dumps({"export": {"batches": [{"images": [{"file_name": "z.jpg", "objects": [part]}]}]}})), (2, json.dumps(wide))])
    got = found_objects(df).groupBy("file_id").count().collect()
    assert {r.file_id: r["count"] for r in got} == {1: 201, 2: 20000}
