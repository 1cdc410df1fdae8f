import struct
import zipfile

from baglight.sources.annotations import caption_rows, captions, decoded, files, image_size, image_sizes
from pyspark.sql import functions as F

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_sizes_from_the_first_bytes(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 31, 17) + b"\0" * 9
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 9, 12) + b"\0" * 9
    for name, data in (("a.png", png), ("b.jpg", jpg), ("c.txt", b"hello"), ("d.bin", b"\xff\xd8")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in image_sizes(files(spark, str(tmp_path))).collect()}
    assert got == {"a.png": (31, 17), "b.jpg": (12, 9), "c.txt": (None, None), "d.bin": (None, None)}
    assert image_size(b"BM") == (None, None)


def test_texts_in_two_encodings(spark, tmp_path):
    (tmp_path / "u.json").write_bytes("﻿{\"a\": \"é\"}".encode())
    (tmp_path / "l.json").write_bytes('{"a": "é"}'.encode("latin-1"))
    got = {r.path[-6:]: r.t for r in files(spark, str(tmp_path)).select("path", decoded(F.col("content")).alias("t")).collect()}
    assert got == {"u.json": '{"a": "é"}', "l.json": '{"a": "é"}'}


def test_caption_sheets(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>Image Name</t></si><si><t>Caption</t></si><si><t>a.jpg</t></si></sst>")
        cell = '<c r="A{0}" t="s"><v>{1}</v></c><c r="B{0}" t="inlineStr"><is><t>{2}</t></is></c>'
        body = "".join(f'<row r="{i}">{cell.format(i, s, t)}</row>' for i, s, t in ((1, 0, "Caption"), (2, 2, "an old text that is long"), (3, 2, "a new text that is longer")))
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
    (tmp_path / "t.csv").write_text("b.jpg,a caption from a file\n,\nc.jpg,another caption\n")
    (tmp_path / "broken.xlsx").write_bytes(b"PK nothing")
    got = {(r.name, r.caption) for r in captions(caption_rows(files(spark, str(tmp_path)))).collect()}
    assert got == {("a.jpg", "a new text that is longer"), ("b.jpg", "a caption from a file"), ("c.jpg", "another caption")}


def test_sizes_behind_the_first_bytes(spark, tmp_path):
    jpg = b"\xff\xd8" + (b"\xff\xe2" + struct.pack(">H", 60002) + b"\0" * 60000) * 2 + b"\xff\xc2\x00\x0b\x08" + struct.pack(">HH", 9, 12) + b"\0" * 9
    entry = lambda tag, kind, value: struct.pack("<HHI", tag, kind, 1) + struct.pack("<I", value)
    tif = b"II*\0" + struct.pack("<I", 70008) + b"\0" * 70000 + struct.pack("<H", 2) + entry(256, 3, 21) + entry(257, 4, 33)
    for name, data in (("a.jpg", jpg), ("b.tif", tif), ("c.jpg", b"\xff\xd8\xff\xda" + b"\0" * 70000)):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in image_sizes(files(spark, str(tmp_path))).collect()}
    assert got == {"a.jpg": (12, 9), "b.tif": (21, 33), "c.jpg": (None, None)}
