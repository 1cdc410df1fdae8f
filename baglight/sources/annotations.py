"""Files around annotations: pictures' sizes, JSON texts, caption sheets, and label lines as a sink."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length, content of every file below a folder whose name fits; Spark passes over files without bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length", "content")


def decoded(content) -> object:
    """Text of file bytes: UTF-8 without byte-order mark, or Latin-1 where the bytes aren't UTF-8."""
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return F.ltrim(F.coalesce(utf8, F.decode(content, "ISO-8859-1")), F.lit("﻿"))


def image_sizes(rows: DataFrame) -> DataFrame:
    """path, width, height of pictures (path, content) from the headers of PNG, GIF, BMP, JPEG and TIFF; null for others.

    The first bytes are looked at; Python gets the whole of a picture only where they don't hold its size.
    """
    head = 1 << 16

    @F.pandas_udf("width long, height long")
    def sizes(content: pd.Series) -> pd.DataFrame:
        s = [image_size(bytes(c)) if c is not None else (None, None) for c in content]
        return pd.DataFrame({"width": pd.array([w for w, _ in s], "Int64"), "height": pd.array([h for _, h in s], "Int64")})

    rows = rows.select("path", "content").withColumn("s", sizes(F.substring("content", 1, head)))
    rest = F.when(F.col("s.width").isNull() & (F.length("content") > head), F.col("content"))
    return rows.withColumn("r", sizes(rest)).select("path", F.coalesce("s.width", "r.width").alias("width"), F.coalesce("s.height", "r.height").alias("height"))


def image_size(head: bytes) -> tuple[int | None, int | None]:
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM" and len(head) >= 26:
        w, h = struct.unpack("<ii", head[18:26])
        return w, abs(h)
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(head):
            if head[at] != 0xFF:
                at += 1
                continue
            kind = head[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", head[at + 5 : at + 9])
                return w, h
            if kind == 0xDA:  # pixels begin
                break
            at += 2 if kind == 0xFF or 0xD0 <= kind <= 0xD9 else 2 + int.from_bytes(head[at + 2 : at + 4], "big")
    if head[:4] in (b"II*\0", b"MM\0*") and len(head) >= 8:
        order = "<" if head[:1] == b"I" else ">"
        first = struct.unpack(f"{order}I", head[4:8])[0]
        count = struct.unpack(f"{order}H", head[first : first + 2])[0] if first + 2 <= len(head) else 0
        found: dict[int, int] = {}
        for at in range(first + 2, min(first + 2 + 12 * count, len(head) - 11), 12):
            tag, kind = struct.unpack(f"{order}HH", head[at : at + 4])
            if tag in (256, 257) and kind in (3, 4):
                found[tag] = struct.unpack(f"{order}{'H' if kind == 3 else 'I'}", head[at + 8 : at + (10 if kind == 3 else 12)])[0]
        return (found[256], found[257]) if len(found) == 2 else (None, None)
    return None, None


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """Cells of the first sheet of an xlsx file, as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{SHEET}t")))
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        out = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{SHEET}row"):
            cells: dict[int, str | None] = {}
            for c in row.iter(f"{SHEET}c"):
                letters = re.match(r"[A-Z]+", c.get("r") or "")
                at = len(cells)
                if letters:
                    at = 0
                    for x in letters.group():
                        at = at * 26 + ord(x) - 64
                    at -= 1
                v = c.find(f"{SHEET}v")
                if c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
                elif v is not None and v.text is not None:
                    cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return out


def caption_rows(rows: DataFrame) -> DataFrame:
    """path, line, cells of caption sheets (path, content), xlsx or csv, a list of cells a line; empty lines are left out."""
    import csv

    def parse(frames):
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"], strict=True):
                data = bytes(content)
                try:
                    lines = sheet_rows(data) if data[:2] == b"PK" else list(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"))))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError):
                    lines = []
                out += [(path, i, cells) for i, cells in enumerate(lines) if any(c not in (None, "") for c in cells)]
            yield pd.DataFrame(out, columns=["path", "line", "cells"])

    return rows.select("path", "content").mapInPandas(parse, "path string, line long, cells array<string>")


def caption_lines(sheet: DataFrame) -> DataFrame:
    """path, line, name, caption of caption_rows: of each sheet, the column of the longest texts is the caption, the shortest of the others the name.

    A heading line is left out; a sheet of one column gives nothing.
    """
    cells = sheet.select("path", "line", F.posexplode("cells").alias("column", "text")).filter("text is not null and trim(text) <> ''")
    size = cells.groupBy("path", "column").agg(F.avg(F.length("text")).alias("size"))
    pick = size.groupBy("path").agg(F.max_by("column", F.struct("size", -F.col("column"))).alias("long"), F.min_by("column", F.struct("size", "column")).alias("short"), F.count("*").alias("n")).filter("n > 1")
    wide = cells.join(pick, "path").groupBy("path", "line").agg(F.max(F.when(F.col("column") == F.col("short"), F.col("text"))).alias("name"), F.max(F.when(F.col("column") == F.col("long"), F.col("text"))).alias("caption"))
    return wide.filter("name is not null and caption is not null").filter(~(F.col("name").rlike(r"(?i)^\s*(image|file|name|id)\b.*") & F.col("caption").rlike(r"(?i)^\s*(caption|text|description)s?\s*$")))


def captions(sheet: DataFrame) -> DataFrame:
    """path, name, caption of caption_lines; of several lines of a name the last counts."""
    last = F.row_number().over(Window.partitionBy("path", "name").orderBy(F.desc("line")))
    return caption_lines(sheet).withColumn("n", last).filter("n = 1").select("path", "name", "caption")


def yolo_lines(boxes: DataFrame) -> DataFrame:
    """uid, text: a line `class cx cy w h` a box (uid, k, cls, x1, y1, x2, y2, img_w, img_h), in shares of the picture with six digits."""
    w, h = F.col("img_w"), F.col("img_h")
    shares = ((F.col("x1") + F.col("x2")) / 2 / w, (F.col("y1") + F.col("y2")) / 2 / h, (F.col("x2") - F.col("x1")) / w, (F.col("y2") - F.col("y1")) / h)
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "cls", *[F.round(x, 6) for x in shares])
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"])  # the boxes of one scan
    return boxes.filter("cls >= 0").groupBy("uid").agg(F.concat_ws("\n", lines).alias("text"))


def write_yolo(boxes: DataFrame, path: str) -> None:
    """Label lines as text, a folder a scan."""
    yolo_lines(boxes).write.partitionBy("uid").mode("overwrite").text(path)
