import json

import numpy as np
import pytest

from baglight.operators import patches, pixels
from baglight.operators.objects import extract_objects, flatten
from baglight.plans import registry
from baglight.streaming.incremental import process_new


def found(root):
    return [(name, box, raw) for _, name, _, box, raw, _, _ in flatten([json.dumps(root).encode()])]


@pytest.mark.parametrize(
    "root, want",
    [
        ({"shapes": [{"label": "gun", "shape_type": "rectangle", "points": [[5, 6], [1, 2]]}]}, [("gun", [1, 2, 5, 6], None)]),
        ({"shapes": [{"label": "c", "shape_type": "circle", "points": [[0, 0], [3, 4]]}, {"label": "p", "shape_type": "point", "points": [[1, 1], [2, 2], [3, 3]]}]}, [("c", [-5, -5, 5, 5], None)]),
        ({"categories": [{"id": 3, "name": "knife"}], "annotations": [{"category_id": 3, "bbox": [1, 2, 3, 4]}]}, [("knife", [1, 2, 4, 6], None)]),
        ({"a.jpg": {"regions": [{"shape_attributes": {"name": "rect", "x": 1, "y": 2, "width": 3, "height": 4}, "region_attributes": {"type": "saw"}}]}}, [("saw", [1, 2, 4, 6], None)]),
        ([{"annotations": [{"label": "x", "coordinates": {"x": 10, "y": 10, "width": 4, "height": 2}}]}], [("x", [8, 9, 12, 11], None)]),
        ({"boxes": [[1, 2, 3, 4]], "labels": ["a"]}, [("a", None, [1, 2, 3, 4])]),
        ({"name": "outer", "inner": {"thing": {"BBOX": [0, 0, 1, 1]}}}, [(None, None, [0, 0, 1, 1])]),
        ({"top": {"name": "outer", "inner": {"bbox": [0, 0, 1, 1]}}}, [("outer", None, [0, 0, 1, 1])]),
        ({"o": {"label": "n", "x_min": 1, "y_min": 2, "x_max": 3, "y_max": 4}}, [("n", [1, 2, 3, 4], None)]),
        ({"o": {"label": "s", "segmentation": [[0, 0, 4, 0, 4, 4]]}}, [("s", [0, 0, 4, 4], None)]),
        ([1, 2, 3, 4], [(None, None, [1, 2, 3, 4])]),
        (None, []),
        ({"bbox": [1, 2, 3, float("inf")]}, []),
    ],
)
def test_dialects(root, want):
    assert found(root) == want


def test_many_texts_at_once():
    a = {"categories": [{"id": 1, "name": "saw"}], "annotations": [{"category_id": 1, "bbox": [1, 2, 3, 4], "segmentation": [[0, 0, 1, 0, 1, 1], [5, 5]]}, {"category_id": 9, "bbox": [0, 0, 1, 1]}]}
    b = {"label": "out", "list": [{"points": [1, 2, 3, 4]}, {"points": [[1, 2], ["x", 4]]}, {"cx": 5, "cy": 5, "w": 2, "h": 4}, {"bndbox": {"XMin": 1, "y_min": 2, "xmax": 3, "ymax": 4}}]}
    c = {"v": {"label": "mine", "list": [{"points": [1, 2, 3, 4]}]}, "shapes": [{"label": "m", "shape_type": "mask", "mask": "zz", "points": [[0, 0], [2, 3]]}]}
    texts = [json.dumps(a), "{", "", json.dumps(b), "7", json.dumps(c), json.dumps({"bbox": [1, 2, 3]}), json.dumps({"shape_attributes": {"name": "blob"}, "bbox": [1, 2, 3, 4]})]
    got = flatten([t.encode() for t in texts])
    assert got == [
        (0, "saw", None, [1, 2, 4, 6], None, [[[0, 0], [1, 0], [1, 1]]], None),
        (0, "9", None, [0, 0, 1, 1], None, [], None),
        (3, None, None, [1, 2, 3, 4], None, [], None),
        (3, None, None, [4, 3, 6, 7], None, [], None),
        (3, None, None, [1, 2, 3, 4], None, [], None),
        (5, "mine", None, [1, 2, 3, 4], None, [], None),
        (5, "m", "mask", [0, 0, 2, 3], None, [], "zz"),
    ]


def test_depth_is_limited():
    deep = {"bbox": [0, 0, 1, 1]}
    for _ in range(13):
        deep = {"k": deep}
    assert found(deep) == [] and len(found(deep["k"])) == 1


def test_extraction_from_texts(spark):
    df = spark.createDataFrame([(1, json.dumps({"shapes": [{"label": "a", "points": [[0, 0], [1, 0], [1, 1]]}]})), (2, "{"), (3, None), (4, "")], "file_id long, payload string")
    r = extract_objects(df).collect()
    assert [(x.file_id, x.object_no, x.label, x.box) for x in r] == [(1, 1, "a", [0.0, 0.0, 1.0, 1.0])] and r[0].rings == [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]]


def test_signatures_of_pictures(spark):
    g = np.full((40, 40), 255, np.uint8)
    g[10:30, 10:30] = np.arange(20)[None, :] * 10
    moved = np.full((60, 50), 255, np.uint8)
    moved[35:55, 5:25] = g[10:30, 10:30]
    df = spark.createDataFrame([("a", 40, 40, bytearray(g.tobytes())), ("b", 60, 50, bytearray(moved.tobytes())), ("c", 3, 3, bytearray(b"x")), ("d", None, None, None)], "uid string, height int, width int, pixels binary")
    got = {r.uid: (r.sig_d, r.sig_a) for r in pixels.image_signatures(df).collect()}
    assert got["a"] == got["b"] and got["a"][0] == -1 and got["c"] == got["d"] == (None, None)


def test_rasters_and_regions():
    m = pixels.rasterise([np.array([[1, 1], [5, 1], [5, 4], [1, 4]]), np.array([[0, 0], [1, 1]])], 6, 8)
    assert m.sum() == 12 and m[1:4, 1:5].all()
    v = np.zeros((6, 6))
    v[0, 0], v[1, 1], v[4, 4], v[4, 5] = 0.9, 0.5, 0.7, 0.8
    assert pixels.regions(v, 0.5, 2) == [(0.9, 0, 0, 2, 2), (0.8, 4, 4, 6, 5)]


def test_background_boxes_are_clear_of_true_ones(spark, small):
    r = registry.QUERIES["background_boxes"](spark, small).collect()
    assert r and all(b.x2 - b.x1 in (32, 48, 64) for b in r)
    many = spark.createDataFrame([(f"u{i}", i, "g") for i in range(50)], "uid string, k int, g string")
    assert patches.capped(many, ["g"], 7, "uid", "k").count() == 7


def test_new_files_are_worked_off_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    one = spark.createDataFrame([(1, "x")], "id int, v string")
    one.write.mode("append").parquet(source)
    run = lambda: process_new(spark, source, one.schema, lambda df: df.filter("id > 0"), target, mark)
    run()
    run()
    assert spark.read.parquet(target).count() == 1
    spark.createDataFrame([(2, "y"), (-1, "z")], "id int, v string").write.mode("append").parquet(source)
    run()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2]


def png(lines, w, colour):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, len(lines), 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(bytes(x) for x in lines))) + chunk(b"IEND", b"")


def test_masks_in_base64():
    import base64

    want = [[1, 2, 3], [1, 2, 3], [5, 5, 5], [7, 9, 0], [4, 4, 4]]
    lines = [[0, 1, 2, 3], [2, 0, 0, 0], [1, 5, 0, 0], [3, 5, 3, 249], [4, 253, 251, 0]]
    data = png(lines, 3, 0)
    assert pixels.decode_png(data)[:3, :, 0].tolist() == want[:3]
    assert pixels.decode_png(data).shape == (5, 3, 1)
    assert pixels.mask_of(base64.b64encode(png([[0, 0, 7], [0, 0, 0]], 2, 0)).decode()).tolist() == [[0, 1], [0, 0]]
    assert pixels.mask_of("no picture") is None and pixels.mask_of(None) is None and pixels.decode_png(data[:-30]) is None
    assert pixels.decode_png(png([[0, 1, 2, 3, 4, 5, 6]], 2, 2)).tolist() == [[[1, 2, 3], [4, 5, 6]]]


def test_clutter_of_pictures():
    rgb = np.full((60, 80, 3), 255, np.uint8)
    rgb[20:40, 20:60] = 100
    density, bag = pixels.clutter_map(rgb, 32)
    assert bag[16, 16] and not bag[0, 0] and density[16, 16] > density[2, 2]
    plain, inside = pixels.ring_clutter(rgb, (30, 25, 40, 35))
    assert inside == pytest.approx(1 - 100 / 255) and plain == pytest.approx(1 - 100 / 255)
    assert pixels.ring_clutter(rgb, (100, 100, 110, 110)) == (None, None)
