"""A corpus of pictures on disk as the scan index.

A split folder holds `Images` and, under their own names, outlines, boxes, masks and caption sheets, each
with one folder a class and any folders below it. Files are listed by Spark and joined by split, class and
stem; nothing is walked on the driver. File contents are read only where a column needs them.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baglight.functions.geometry import resolve_box
from baglight.functions.labels import folder_class, label_class, safe_name, stem_key
from baglight.functions.stage import stage
from baglight.operators.ingest import box_layout, by_stem, folder_rules, safe_uids
from baglight.operators.objects import extract_objects, picture_sizes
from baglight.sources.annotations import caption_lines, caption_rows, decoded, files, image_sizes

#: Names of the sub-folders, whatever their capitals.
KINDS = {"images": ("images", "image", "imgs"), "outlines": ("json", "jsons", "polygons", "json_mask", "json_masks"), "boxes": ("json_bb", "jsonbb", "json_bbox", "bb", "bbox"), "masks": ("segmentation", "segmentations", "masks", "mask", "seg", "gt"), "captions": ("captions", "caption")}
PICTURES = r"\.(jpg|jpeg|png|bmp|tif|tiff)$"


def _parts(path: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), "^file:/+", "/"), "/")


def _depth(spark: SparkSession, root: str) -> int:
    """Parts of the root's own path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return len(re.sub("^file:/+", "/", full).rstrip("/").split("/"))


def listed(spark: SparkSession, root: str, splits: list[str]) -> DataFrame:
    """path, split, kind, folder_name, folder_id, stem, key of every file, however deep, in a sub-folder of a split's folder.

    The split's folder is the root or a folder below it whose name holds a split's name (the first of the
    list that fits); the kind's folder is the first one right below such a folder, and the class folder
    comes right after it. Sheets of captions have the class of their own name, else of the folder.
    Files elsewhere are passed over. The key is the stem without a mask suffix.
    """
    rows = files(spark, root).select("path", _parts(F.col("path")).alias("parts"))
    lower, last = F.transform("parts", F.lower), F.size("parts")
    known = [x for spellings in KINDS.values() for x in spellings]
    held = lambda name: reduce(lambda a, b: a | b, [name.contains(s.lower()) for s in splits])
    spots = F.filter(F.sequence(F.lit(_depth(spark, root) + 1), F.greatest(last - 1, F.lit(_depth(spark, root) + 1))), lambda i: (i < last) & F.get(lower, i - 1).isin(*known) & held(F.get(lower, i - 2)))
    rows = rows.withColumn("at", F.get(spots, F.lit(0))).filter("at is not null")
    folder, holder = F.lower(F.get("parts", F.col("at") - 1)), F.lower(F.get("parts", F.col("at") - 2))
    kind, split = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, spellings in KINDS.items():
        kind = F.when(folder.isin(*spellings), name).otherwise(kind)
    for s in reversed(splits):
        split = F.when(holder.contains(s.lower()), s).otherwise(split)
    rows = rows.withColumn("kind", kind).withColumn("split", split)
    above = F.when(F.col("at") < last - 1, F.get("parts", F.col("at")))
    sheet = F.when(F.col("kind") == "captions", F.regexp_replace(F.get("parts", last - 1), r"\.[^.]*$", ""))
    rows = rows.withColumn("folder_name", F.when(folder_class(sheet)["id"].isNotNull() | above.isNull(), sheet).otherwise(above)).filter("folder_name is not null")
    return rows.select("path", "split", "kind", "folder_name", folder_class(F.col("folder_name"))["id"].alias("folder_id"), F.regexp_replace(F.lower(F.get("parts", last - 1)), r"\.[^.]*$", "").alias("stem"), stem_key(F.col("path")).alias("key"))


def scan_captions(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds caption to scans (split, folder_id, stem): that of the class and stem, of several the last; else that of the stem where the split's sheets have just one.

    lines are path, line, name, caption of the sheets with split and folder_id.
    """
    base = F.trim(F.element_at(F.split(F.translate("name", "\\", "/"), "/"), -1))
    lines = lines.withColumn("stem", F.regexp_replace(F.lower(base), PICTURES, ""))
    of_class = lines.filter("folder_id is not null").groupBy("split", "folder_id", "stem").agg(F.max_by("caption", F.struct("path", "line")).alias("by_class"))
    of_stem = lines.groupBy("split", "stem").agg(F.max("caption").alias("by_stem"), F.count("*").alias("n")).filter("n = 1").drop("n")
    rows = rows.join(of_class, ["split", "folder_id", "stem"], "left").join(of_stem, ["split", "stem"], "left")
    return rows.withColumn("caption", F.coalesce("by_class", "by_stem")).drop("by_class", "by_stem")


def scan_objects(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """uid, source ('boxes' or 'outlines'), object_no, cls, status, box, raw, outlined of the objects in both annotation files of scans (uid, bb_path, json_path); texts are path, payload."""
    both = F.array(F.struct(F.lit("boxes").alias("source"), F.col("bb_path").alias("path")), F.struct(F.lit("outlines").alias("source"), F.col("json_path").alias("path")))
    source = rows.select("uid", F.inline(both)).filter("path is not null").join(texts, "path").select("uid", "source", F.xxhash64("uid", "source").alias("file_id"), "payload")
    found = source.select("uid", "source", "file_id").join(extract_objects(source), "file_id")
    outlined = (F.coalesce(F.size("rings"), F.lit(0)) > 0) | F.col("mask").isNotNull()
    return found.withColumn("m", label_class(F.col("label"))).select("uid", "source", "object_no", "m.cls", "m.status", "box", "raw", outlined.alias("outlined"))


def raw_layout(objects: DataFrame) -> DataFrame:
    """One row: layout of the raw boxes of the box files; a scan with one such box and outlines is a witness (ingest.box_layout)."""
    raw, box = F.col("raw"), F.col("box")
    one = objects.groupBy("uid").agg(
        F.count_if((F.col("source") == "boxes") & box.isNull()).alias("n"),
        F.bool_or(F.when((F.col("source") == "boxes") & box.isNull(), (raw[2] < raw[0]) | (raw[3] < raw[1]))).alias("wrong"),
        F.any_value(F.when((F.col("source") == "boxes") & box.isNull(), raw), True).alias("v"),
        *[f(F.when(F.col("source") == "outlines", box[i])).alias(x) for i, (f, x) in enumerate(((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2")))],
    )
    vote = box_layout(one.filter("n = 1 and x1 is not null").select(*[F.col("v")[i].alias(f"v{i + 1}") for i in range(4)], "x1", "y1", "x2", "y2")).select(F.col("layout").alias("voted"))
    wrong = one.agg(F.coalesce(F.bool_or("wrong"), F.lit(False)).alias("wrong"))
    return wrong.crossJoin(vote).select(F.when(F.col("wrong"), "xywh").otherwise(F.col("voted")).alias("layout"))


def scan_boxes(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """uid, read, outline_cls, outlined, n_objects of scans (uid, img_w, img_h): read are the boxes (object_no, x1, y1, x2, y2, cls) of the box file, of the outlines where it gives none.

    Labels that mean no threat give no box, nor do boxes of less than a pixel; without a picture's size nothing is cut off.
    """
    sized = objects.join(rows.select("uid", "img_w", "img_h"), "uid").crossJoin(F.broadcast(raw_layout(objects)))
    raw, w, h = F.col("raw"), F.col("img_w"), F.col("img_h")
    v = F.coalesce("box", F.when(F.col("layout") == "xywh", F.array(raw[0], raw[1], raw[0] + raw[2], raw[1] + raw[3])).otherwise(raw))
    v = [v[i] for i in range(4)]
    ends = (F.least(v[0], v[2]), F.least(v[1], v[3]), F.greatest(v[0], v[2]), F.greatest(v[1], v[3]))
    free = F.when((ends[2] - ends[0] >= 1) & (ends[3] - ends[1] >= 1), F.struct(*[e.alias(x) for e, x in zip(ends, ("x1", "y1", "x2", "y2"), strict=True)]))
    at = F.when((w > 0) & (h > 0), resolve_box(v, "xyxy", w.cast("double"), h.cast("double"))).otherwise(free)
    sized = sized.withColumn("at", F.when(F.col("status") != "ignore", at))
    of = lambda s: F.col("source") == s
    kept = lambda s: F.array_sort(F.collect_list(F.when(of(s) & F.col("at").isNotNull(), F.struct("object_no", "at.x1", "at.y1", "at.x2", "at.y2", "cls"))))  # noqa: E731 - the boxes of one scan
    per = sized.groupBy("uid").agg(
        kept("boxes").alias("own"), kept("outlines").alias("other"), F.collect_set(F.when(of("outlines") & (F.col("cls") >= 0), F.col("cls"))).alias("outline_cls"),
        F.bool_or(of("outlines") & F.col("outlined")).alias("outlined"), F.count_if(of("boxes")).alias("n_own"), F.count_if(of("outlines")).alias("n_other"),
    )
    stand_in = (F.size("own") == 0) & (F.col("n_other") > 0)
    return per.select("uid", F.when(stand_in, F.col("other")).otherwise(F.col("own")).alias("read"), "outline_cls", "outlined", F.when(stand_in, F.col("n_other")).otherwise(F.col("n_own")).alias("n_objects"))


def build_index(spark: SparkSession, root: str, splits: list[str] = ["train", "test"]) -> DataFrame:  # noqa: B006
    """uid, split, folder_id, folder_name, stem, img_path, json_path, bb_path, seg_path, img_w, img_h, labels, n_labels, is_threat, boxes, n_boxes, n_objects, label_source, mask_source, caption, issue, issues.

    The first file of a stem counts; a class folder that isn't one of 1 to 22 is left out; boxes come
    from the box file, from the outlines where it gives none; labels follow the folder's rules, and
    outlines add theirs in the folder of several classes; a picture without a readable size takes that
    of its box file; a broken annotation gives no objects; of
    several pictures of one name the later ones get _2, _3, ... to their uid. `issue` is that of the
    folder's rules, `issues` names all defects of the scan, joined by `;`.
    """
    all_ = stage(listed(spark, root, splits), "listed")
    keys = ["split", "folder_id", "stem"]
    rows = all_.filter((F.col("kind") == "images") & F.col("folder_id").between(1, 22) & F.lower("path").rlike(PICTURES)).withColumnRenamed("path", "img_path").drop("kind", "key")
    for kind, column, ending in (("outlines", "json_path", r"\.json$"), ("boxes", "bb_path", r"\.json$"), ("masks", "seg_path", PICTURES)):
        fit = all_.filter((F.col("kind") == kind) & F.lower("path").rlike(ending)).withColumnRenamed("path", column)
        rows = by_stem(rows, fit.withColumn("stem", F.explode(F.array_distinct(F.array("stem", "key")))), keys, column)
    name = F.concat_ws("_", "split", F.lpad(F.col("folder_id").cast("string"), 2, "0"), safe_name(F.col("stem")))
    rows = safe_uids(rows.withColumn("name", name), "name", "img_path").drop("name")

    content = files(spark, root)
    sizes = image_sizes(content.filter(F.lower("path").rlike(PICTURES))).toDF("img_path", "img_w", "img_h")
    rows = rows.join(sizes, "img_path", "left")
    texts = content.filter(F.lower("path").endswith(".json")).select("path", decoded(F.col("content")).alias("payload"))
    unsized = rows.filter("img_w is null and bb_path is not null").select("uid", F.col("bb_path").alias("path")).join(texts, "path")
    given = picture_sizes(unsized).select("uid", F.col("width").cast("long").alias("w"), F.col("height").cast("long").alias("h"))
    rows = stage(rows.join(given, "uid", "left").withColumn("img_w", F.coalesce("img_w", "w")).withColumn("img_h", F.coalesce("img_h", "h")).drop("w", "h"), "scans")
    objects = stage(scan_objects(rows, texts), "objects")
    rows = rows.join(scan_boxes(rows, objects), "uid", "left").withColumn("n_objects", F.coalesce("n_objects", F.lit(0)))
    multi, benign = F.col("folder_id") == 21, F.col("folder_id") == 22
    classes = F.transform("read", lambda b: b["cls"])
    rows = rows.withColumn("found", F.when(multi, F.array_union(classes, "outline_cls")).otherwise(classes))
    rows = rows.join(folder_rules(rows.select("uid", "folder_id", "found")), "uid")

    bare = lambda b, cls: F.struct(b["x1"].alias("x1"), b["y1"].alias("y1"), b["x2"].alias("x2"), b["y2"].alias("y2"), cls.cast("int").alias("cls"))
    none = F.filter(F.transform("read", lambda b: bare(b, b["cls"])), lambda b: F.lit(False))
    mapped = F.transform(F.filter("read", lambda b: b["cls"] >= 0), lambda b: bare(b, b["cls"]))
    own = F.transform("read", lambda b: bare(b, F.col("folder_id") - 1))
    rows = rows.withColumn("read", F.coalesce("read", F.array())).withColumn("boxes", F.when(benign, none).when(multi, mapped).otherwise(own))
    n_boxes, n, masked = F.size("boxes"), F.size("labels"), F.col("seg_path").isNotNull()
    rows = rows.withColumn("label_source", F.when(benign, "benign").when(multi, "annotation").otherwise("folder"))
    rows = rows.withColumn("mask_source", F.when(masked, "png").when(benign, "none").when(F.col("outlined"), "poly").when(n_boxes > 0, "box").otherwise("none"))
    defects = {
        "img_unreadable": F.col("img_w").isNull(), "benign_with_objects": benign & (F.size("read") > 0), "unmapped_label": multi & F.exists("read", lambda b: b["cls"] < 0), "multi_no_labels": multi & (n == 0),
        "no_boxes": ~benign & (n_boxes == 0), "no_json_bb": ~benign & F.col("bb_path").isNull(), "no_seg_png": ~benign & ~masked,
    }
    rows = rows.withColumn("issues", F.concat_ws(";", *[F.when(c, d) for d, c in defects.items()]))

    sheets = all_.filter(F.col("kind") == "captions").select("path", "split", "folder_id")
    lines = caption_lines(caption_rows(content.filter(F.lower("path").rlike(r"(\.xlsx|\.csv)$")))).join(sheets, "path")
    rows = scan_captions(rows, lines)
    return rows.select("uid", "split", "folder_id", "folder_name", "stem", "img_path", "json_path", "bb_path", "seg_path", "img_w", "img_h", "labels", n.alias("n_labels"), (n > 0).alias("is_threat"), "boxes", n_boxes.alias("n_boxes"), "n_objects", "label_source", "mask_source", "caption", "issue", "issues")
