import json
import random
import struct
from collections import Counter, defaultdict

from baglight.operators import splits
from baglight.sources.corpus import build_index

PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 31, 17) + b"\0" * 9


def put(root, path, data):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data if isinstance(data, bytes) else json.dumps(data).encode() if not isinstance(data, str) else data.encode())


def test_index_of_a_folder_tree(spark, tmp_path):
    shape = lambda *names: {"shapes": [{"label": n, "shape_type": "rectangle", "points": [[1, 1], [9, 9]]} for n in names]}
    put(tmp_path, "My_TrainSet/Images/Class 2_Gun/a b.png", PNG)
    put(tmp_path, "My_TrainSet/Json_BB/class-2_gun/a b.json", shape("pistol", "knife"))
    put(tmp_path, "My_TrainSet/Segmentation/Class 2_Gun/a b_mask.png", PNG)
    put(tmp_path, "My_TrainSet/Images/Class 21_Multi/m.png", PNG)
    put(tmp_path, "My_TrainSet/Json/Class 21_Multi/m.json", shape("needle", "class 20", "needle"))
    put(tmp_path, "My_TrainSet/Images/Class 22_Non Threat/n.png", PNG)
    put(tmp_path, "My_TestSet/Images/Class 4_Knife/k.png", PNG)
    put(tmp_path, "My_TestSet/Json_BB/Class 4_Knife/k.json", "{broken")
    put(tmp_path, "My_TestSet/Images/Class 99_Other/x.png", PNG)
    put(tmp_path, "My_TestSet/Images/Class 4_Knife/notes.txt", "no picture")
    put(tmp_path, "My_TrainSet/Captions/Class 2_Gun.csv", "a b.png,a gun lies in a bag under a towel\n")
    got = {r.uid: r for r in build_index(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["test_04_k", "train_02_a_b", "train_21_m", "train_22_n"]
    gun = got["train_02_a_b"]
    assert (gun.labels, gun.issue, gun.n_objects, gun.img_w, gun.img_h, gun.caption) == ([1], "label_conflict", 2, 31, 17, "a gun lies in a bag under a towel")
    assert gun.seg_path.endswith("a%20b_mask.png") or gun.seg_path.endswith("a b_mask.png")
    assert got["train_21_m"].labels == [8, 19] and got["train_22_n"].labels == [] and not got["train_22_n"].is_threat
    assert got["test_04_k"].labels == [3] and got["test_04_k"].n_objects == 0


def test_subset_and_grouped_split(spark):
    rng = random.Random(11)
    rows = [(f"u{i}", f"g{rng.randint(0, 900)}", [rng.randint(0, 5)] if i % 4 else None) for i in range(3000)] + [(f"h{i}", "huge", [1]) for i in range(900)]
    df = spark.createDataFrame(rows, "uid string, group string, labels array<int>")
    kept = splits.subset(df, 0.25).collect()
    whole, part = (Counter(str(r[2]) for r in x) for x in (rows, [(r.uid, r.group, r.labels) for r in kept]))
    assert all(abs(part[k] - n * 0.25) <= 2 for k, n in whole.items())
    assert splits.subset(df, 1.0).count() == len(rows) and splits.subset(df.limit(0), 0.5).count() == 0
    side = {r.uid: r.side for r in splits.grouped_split(df, 0.2).collect()}
    of = defaultdict(set)
    for uid, group, _ in rows:
        of[group].add(side[uid])
    assert len(side) == len(rows) and all(len(s) == 1 for s in of.values()) and of["huge"] == {"train"}
    n = sum(s == "val" for u, s in side.items() if u[0] == "u")
    assert abs(n / 3000 - 0.2) < 0.02


def test_both_annotation_files_of_a_scan(spark, tmp_path):
    shape = lambda *names: {"shapes": [{"label": n, "shape_type": "polygon", "points": [[1, 1], [9, 2], [5, 9]]} for n in names]}
    multi = "TrainSet/{}/Class 21_Multi/{}"
    for stem, boxes, outlines in (
        ("both", {"objects": [{"label": "gun", "bbox": [20, 10, 5, 4]}]}, shape("knife", "thing")),
        ("broken", "{broken", shape("hammer")),
        ("empty", {"shapes": []}, shape("pliers", "odd")),
        ("tiny", {"objects": [{"label": "gun", "xmin": 1, "ymin": 1, "xmax": 1.5, "ymax": 9}]}, shape("wrench")),
    ):
        put(tmp_path, multi.format("Images", f"{stem}.png"), PNG)
        put(tmp_path, multi.format("Json_BB", f"{stem}.json"), boxes)
        put(tmp_path, multi.format("Json", f"{stem}.json"), outlines)
    put(tmp_path, "TrainSet/Images/Class 22_Non Threat/n.png", PNG)
    put(tmp_path, "TrainSet/Json/Class 22_Non Threat/n.json", shape("odd"))
    put(tmp_path, "TrainSet/Images/Class 2_Gun/bare.png", b"no picture")
    put(tmp_path, "TrainSet/Json_BB/Class 2_Gun/bare.json", {"objects": [{"label": "knife", "xmin": 90, "ymin": 10, "xmax": 70, "ymax": 30}]})
    got = {r.uid.split("_", 2)[2]: r for r in build_index(spark, str(tmp_path)).collect()}
    assert {k: (r.labels, [tuple(b) for b in r.boxes], r.n_objects, r.label_source, r.mask_source, r.issues) for k, r in got.items()} == {
        "both": ([1, 3], [(20, 10, 25, 14, 1)], 1, "annotation", "poly", "no_seg_png"),
        "broken": ([14], [(1, 1, 9, 9, 14)], 1, "annotation", "poly", "no_seg_png"),
        "empty": ([15], [(1, 1, 9, 9, 15)], 2, "annotation", "poly", "unmapped_label;no_seg_png"),
        "tiny": ([16], [(1, 1, 9, 9, 16)], 1, "annotation", "poly", "no_seg_png"),
        "n": ([], [], 1, "benign", "none", "benign_with_objects"),
        "bare": ([1], [(70, 10, 90, 30, 1)], 1, "folder", "box", "img_unreadable;no_seg_png"),
    }
    assert all(r.n_boxes == len(r.boxes) for r in got.values())


def test_files_below_class_folders_and_sheets_of_any_name(spark, tmp_path):
    root = tmp_path / "train_data" / "images"
    shape = {"shapes": [{"label": "gun", "points": [[1, 1], [9, 9]]}]}
    put(root, "My_TrainSet/Images/Class 2_Gun/day 1/images/a.png", PNG)
    put(root, "My_TrainSet/Images/Class 2_Gun/b.tiff", b"II*\0")
    put(root, "My_TrainSet/Images/Class 2_Gun/c_gt.tif", b"II*\0")
    put(root, "My_TrainSet/Images/Class 3_3D Gun/c_gt.png", PNG)
    put(root, "My_TrainSet/Images/loose.png", PNG)
    put(root, "My_TrainSet/Json_BB/Class 2_Gun/more/still more/a.json", shape)
    put(root, "My_TrainSet/Json_BB/Class 2_Gun/more/a.jpg", b"no annotation")
    put(root, "My_TrainSet/Segmentation/Class 2_Gun/x/a_mask.tif", b"II*\0")
    put(root, "My_TrainSet/Captions/part/all.csv", "a.png,an old text of a bag with a gun\nb.tiff,a text that is given only once\nc_gt.png,a text of one of two pictures\nc_gt.tif,a text of the other of two pictures\n")
    put(root, "My_TrainSet/Captions/Class 2_Gun.csv", "x/a.png,the text of the class of this picture\n")
    put(root, "My_TestSet/Captions/all.csv", "b.tiff,a text of the other split of the data\n")
    got = {r.uid: r for r in build_index(spark, str(root)).collect()}
    assert {k: r.caption for k, r in got.items()} == {
        "train_02_a": "the text of the class of this picture",
        "train_02_b": "a text that is given only once",
        "train_02_c_gt": None,
        "train_03_c_gt": None,
    }
    a = got["train_02_a"]
    assert a.n_boxes == 1 and a.bb_path.endswith("a.json") and a.seg_path.endswith("a_mask.tif") and a.folder_name == "Class 2_Gun"


def test_size_from_the_box_file(spark, tmp_path):
    put(tmp_path, "TrainSet/Images/Class 2_Gun/a.png", b"no picture")
    put(tmp_path, "TrainSet/Json_BB/Class 2_Gun/a.json", {"imageWidth": 40, "imageHeight": 30, "objects": [{"label": "gun", "bbox": [0.5, 0.5, 1, 1]}]})
    (r,) = build_index(spark, str(tmp_path)).collect()
    assert (r.img_w, r.img_h, [tuple(b) for b in r.boxes]) == (40, 30, [(20, 15, 40, 30, 1)])
