"""Deeply nested annotation texts as flat tables.

The current text of each file is indexed structurally (baglight.functions.structure) and its images,
objects, rings and points come out as rows that name their parents by number: a ring its object, an
object its image and, for parts, the object it is part of. Three layouts are read: shapes with one
imagePath; images, categories and annotations linked by ids; and a tree of batches, images and
objects with parts to any depth.

Numbers count from 1 within a file, in document order; an object comes before its parts.

Defined cases: a byte-order mark, blanks around the text and wrapping in a JSON string, any number
of times, change nothing; texts that aren't valid JSON, aren't an object or are null give no rows; a
lone object stands for a list of one; missing and null lists are empty; list elements that aren't
objects keep their place but give no row; unknown fields are passed over; ids are equal if they
differ only in JSON type; the first of several images with one id counts; an object without image
or with a dangling id has a null image; the last of repeated keys of an object counts; a null
imagePath or file_name is no image.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baglight.functions.structure import LIST, OBJECT, SCALAR, STRING, Index, structural_index
from baglight.operators.rows import latest

BLANK = b" \t\n\r"
MARK = "﻿".encode()
#: Texts are indexed together up to about so many bytes.
BLOCK = 4 << 20
TABLES = {
    "image": {"image_no": "long", "image_name": "string", "path": "string", "width": "double", "height": "double"},
    "object": {"object_no": "long", "parent_no": "long", "image_no": "long", "image_name": "string", "label": "string"},
    "ring": {"object_no": "long", "ring_no": "long"},
    "point": {"object_no": "long", "ring_no": "long", "point_no": "long", "x": "double", "y": "double"},
}
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


class Walk:
    """Lookups over an index, each for many rows at once. Row -1 is a missing value."""

    def __init__(self, index: Index):
        self.ix = index
        n = len(index.text)
        self.key_id: dict[bytes, int] = {}
        has = np.flatnonzero(index.key_first >= 0)
        raw, known = index.raw, self.key_id
        ids = np.fromiter((known.setdefault(raw[a + 1 : z], len(known)) for a, z in zip(index.key_first[has].tolist(), index.key_last[has].tolist(), strict=True)), np.int64, len(has))
        by_name: dict[str, int] = {}
        same = np.arange(len(known))
        for k, i in list(known.items()):  # one name may be spelt in several ways
            name = json.loads(b'"' + k + b'"') if b"\\" in k else k.decode()
            same[i] = by_name.setdefault(name, i)
        self.names = by_name
        self.span = len(known) + 1
        code = index.parent[has] * self.span + (same[ids] if len(ids) else ids)
        order = np.argsort(code, kind="stable")
        self.code, self.coded = code[order], has[order]
        self.kids = np.argsort(index.parent, kind="stable")
        parent = index.parent[self.kids]
        self.kid_lo = np.searchsorted(parent, np.arange(n), side="left")
        self.kid_hi = np.searchsorted(parent, np.arange(n), side="right")

    def get(self, rows: np.ndarray, name: str) -> np.ndarray:
        """The value of a key of each object row, -1 where there is none."""
        k = self.names.get(name)
        if k is None or not len(self.code):
            return np.full(len(rows), -1, np.int64)
        want = rows * self.span + k
        at = np.searchsorted(self.code, want, side="right") - 1
        hit = (rows >= 0) & (at >= 0) & (self.code[np.maximum(at, 0)] == want)
        hit &= self.kind(rows) == OBJECT
        return np.where(hit, self.coded[np.maximum(at, 0)], -1)

    def kind(self, rows: np.ndarray) -> np.ndarray:
        return np.where(rows >= 0, self.ix.kind[np.maximum(rows, 0)], 0)

    def items(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Elements of lists, or a lone object: (position in rows, row of the element, place from 0)."""
        kind = self.kind(rows)
        lone = np.flatnonzero(kind == OBJECT)
        lists = np.flatnonzero(kind == LIST)
        owner, kid = self.spread(rows[lists])
        owner = np.concatenate([lists[owner], lone])
        kid = np.concatenate([kid, rows[lone]])
        place = np.concatenate([self.ix.place[kid[: len(kid) - len(lone)]], np.zeros(len(lone), np.int64)])
        order = np.lexsort((place, owner))
        return owner[order], kid[order], place[order]

    def spread(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, n = self.kid_lo[rows], self.kid_hi[rows] - self.kid_lo[rows]
        owner = np.repeat(np.arange(len(rows)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return owner, self.kids[at]

    def texts(self, rows: np.ndarray) -> list[str | None]:
        """Strings as they read, numbers as they are spelt; None for everything else."""
        out: list[str | None] = []
        kind = self.kind(rows)
        raw = self.ix.raw
        for r, k in zip(rows.tolist(), kind.tolist(), strict=True):
            if k == STRING:
                b = raw[self.ix.first[r] : self.ix.last[r] + 1]
                # A lone surrogate has no UTF-8 form and is replaced.
                out.append(json.loads(b).encode("utf-8", "replace").decode() if b"\\" in b else b[1:-1].decode())
            elif k == SCALAR:
                b = raw[self.ix.first[r] : self.ix.last[r] + 1]
                out.append(None if b == b"null" else b.decode())
            else:
                out.append(None)
        return out

    def numbers(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), np.nan)
        for i, t in enumerate(self.texts(rows)):
            if t is not None:
                try:
                    out[i] = float(t)
                except ValueError:
                    pass
        return out


def same_id(text: str | None) -> str | None:
    """One form for ids that differ only in JSON type: 7, 7.0 and "7"."""
    if text is None:
        return None
    t = text.strip()
    try:
        f = float(t)
        return str(int(f)) if f == int(f) and abs(f) < 2**53 and t[-1:].isdigit() else t
    except (ValueError, OverflowError):
        return t


def last_segment(path: str | None) -> str | None:
    return None if path is None else path.replace("\\", "/").rstrip("/").rpartition("/")[2] or None


def unwrapped(texts: list[bytes]) -> Index:
    """The index of texts once byte-order marks, blanks and wrapping strings are taken off."""
    plain = [_bare(t) for t in texts]
    while True:
        ix = structural_index(plain)
        wrapped = np.flatnonzero((ix.parent < 0) & (ix.kind == STRING))
        if not len(wrapped):
            return ix
        for r in wrapped.tolist():
            plain[ix.text[r]] = _bare(json.loads(ix.bytes_of(r)).encode("utf-8", "replace"))


def _bare(text: bytes) -> bytes:
    t = text.strip(BLANK)
    while t.startswith(MARK) or t.endswith(MARK):
        t = t.removeprefix(MARK).removesuffix(MARK).strip(BLANK)
    return t


def flatten(texts: list[bytes], tables: list[str]) -> dict[str, dict[str, np.ndarray | list]]:
    """The asked tables of TABLES as columns, with `text`, the number of the text."""
    w = Walk(unwrapped(texts))
    ix = w.ix
    roots = np.flatnonzero((ix.parent < 0) & (ix.kind == OBJECT))
    export = w.get(roots, "export")
    linked = (export < 0) & ((w.get(roots, "annotations") >= 0) | (w.get(roots, "images") >= 0))
    images, objects = [], []  # of each layout: (text, row, order) and (text, row, order, image row, parent row)

    r = roots[(export < 0) & ~linked]
    owner, row, place = w.items(w.get(r, "shapes"))
    ok = w.kind(row) == OBJECT
    path = w.get(r, "imagePath")
    there = w.kind(path) == STRING
    images.append((ix.text[r[there]], r[there], path[there]))
    objects.append((ix.text[row[ok]], row[ok], place[ok] + 1, np.where(there, r, -1)[owner[ok]], np.full(int(ok.sum()), -1, np.int64)))

    r = roots[linked]
    _, image, _ = w.items(w.get(r, "images"))
    image = image[w.kind(image) == OBJECT]
    name = w.get(image, "file_name")
    image, name = image[w.kind(name) == STRING], name[w.kind(name) == STRING]
    images.append((ix.text[image], image, name))
    by_id: dict[tuple[int, str], int] = {}
    for t, i, row_ in zip(ix.text[image].tolist(), w.texts(w.get(image, "id")), image.tolist(), strict=True):
        if i is not None:
            by_id.setdefault((t, same_id(i)), row_)
    _, row, place = w.items(w.get(r, "annotations"))
    ok = w.kind(row) == OBJECT
    row, place = row[ok], place[ok]
    of = np.fromiter((by_id.get((t, same_id(i)), -1) if i is not None else -1 for t, i in zip(ix.text[row].tolist(), w.texts(w.get(row, "image_id")), strict=True)), np.int64, len(row))
    objects.append((ix.text[row], row, place + 1, of, np.full(len(row), -1, np.int64)))

    _, batch, _ = w.items(w.get(export[export >= 0], "batches"))
    _, image, _ = w.items(w.get(batch, "images"))
    image = image[w.kind(image) == OBJECT]
    name = w.get(image, "file_name")
    named = w.kind(name) == STRING
    images.append((ix.text[image[named]], image[named], name[named]))
    owner, row, _ = w.items(w.get(image, "objects"))
    ok = w.kind(row) == OBJECT
    row, of, parent = row[ok], np.where(named, image, -1)[owner[ok]], np.full(int(ok.sum()), -1, np.int64)
    levels = []
    while len(row):
        levels.append((row, of, parent))
        owner, part, _ = w.items(w.get(row, "parts"))
        ok = w.kind(part) == OBJECT
        row, of, parent = part[ok], of[owner[ok]], row[owner[ok]]
    if levels:
        row, of, parent = (np.concatenate(x) for x in zip(*levels, strict=True))
        # Values are indexed by their first byte, so an object comes before its parts whatever the order of its keys.
        order = np.lexsort((row, ix.text[row]))
        row, of, parent = row[order], of[order], parent[order]
        text = ix.text[row]
        first = np.searchsorted(text, text)
        objects.append((text, row, np.arange(len(row)) - first + 1, of, parent))

    text, image, name = (np.concatenate(x) for x in zip(*images, strict=True))
    order = np.lexsort((image, text))
    text, image, name = text[order], image[order], name[order]
    number = np.arange(len(text)) - np.searchsorted(text, text) + 1
    paths = w.texts(name)
    names = [last_segment(p) for p in paths]
    at = np.full(len(ix.text) + 1, -1, np.int64)
    at[image] = np.arange(len(image))
    o_text, o_row, o_no, o_of, o_parent = (np.concatenate(x) for x in zip(*objects, strict=True))
    o_at = np.where(o_of >= 0, at[o_of], -1)
    o_name = [names[i] if i >= 0 else None for i in o_at.tolist()]
    out: dict[str, dict] = {}
    if "image" in tables:
        size = w.get(image, "size")
        pick = lambda *found: np.maximum.reduce(found)
        width = w.numbers(pick(w.get(image, "width"), w.get(image, "imageWidth"), w.get(size, "w")))
        height = w.numbers(pick(w.get(image, "height"), w.get(image, "imageHeight"), w.get(size, "h")))
        out["image"] = {"text": text, "image_no": number, "image_name": names, "path": paths, "width": width, "height": height}
    if "object" in tables:
        no_of = np.zeros(len(ix.text) + 1, np.int64)
        no_of[o_row] = o_no
        up = [int(no_of[p]) if p >= 0 else None for p in o_parent.tolist()]
        image_no = [int(number[i]) if i >= 0 else None for i in o_at.tolist()]
        out["object"] = {"text": o_text, "object_no": o_no, "parent_no": up, "image_no": image_no, "image_name": o_name, "label": _labels(w, o_text, o_row, roots, linked)}
    if "ring" in tables or "point" in tables:
        out |= _rings(w, o_text, o_row, o_no, "point" in tables)
    return out


def _labels(w: Walk, text: np.ndarray, row: np.ndarray, roots: np.ndarray, linked: np.ndarray) -> list[str | None]:
    label = w.get(row, "label")
    found = w.texts(np.where(w.kind(label) == OBJECT, w.get(label, "name"), label))
    category: dict[tuple[int, str], str | None] = {}
    _, cat, _ = w.items(w.get(roots[linked], "categories"))
    cat = cat[w.kind(cat) == OBJECT]
    for t, i, n in zip(w.ix.text[cat].tolist(), w.texts(w.get(cat, "id")), w.texts(w.get(cat, "name")), strict=True):
        if i is not None:
            category.setdefault((t, same_id(i)), n)
    ids = w.texts(w.get(row, "category_id"))
    return [f if f is not None or i is None else category.get((t, same_id(i))) for f, i, t in zip(found, ids, text.tolist(), strict=True)]


def _rings(w: Walk, text: np.ndarray, row: np.ndarray, no: np.ndarray, points: bool) -> dict[str, dict]:
    """Rings: `points` is one list of pairs; `rings` a list of such; `segmentation` a list of flat lists or one flat list."""
    single = w.get(row, "points")
    nested = w.get(w.get(row, "geometry"), "rings")
    flat = w.get(row, "segmentation")
    a = np.flatnonzero(w.kind(single) == LIST)
    b_owner, b_ring, _ = w.items(nested)
    keep = w.kind(b_ring) == LIST
    b_owner, b_ring = b_owner[keep], b_ring[keep]
    c_owner, c_ring, c_place = w.items(flat)
    keep = w.kind(c_ring) == LIST
    bare = np.unique(c_owner[(w.kind(c_ring) == SCALAR) & (c_place == 0)])
    c_owner, c_ring = np.concatenate([c_owner[keep], bare]), np.concatenate([c_ring[keep], flat[bare]])
    owner, ring = np.concatenate([a, b_owner, c_owner]), np.concatenate([single[a], b_ring, c_ring])
    order = np.lexsort((ring, owner))
    owner, ring = owner[order], ring[order]
    ring_no = np.arange(len(owner)) - np.searchsorted(owner, owner) + 1
    out = {"ring": {"text": text[owner], "object_no": no[owner], "ring_no": ring_no}}
    if points:
        of, member, place = w.items(ring)
        pair = w.kind(member) == LIST
        p_of, xy = w.spread(member[pair])
        axis = w.ix.place[xy]
        p_of, xy, axis = p_of[axis < 2], xy[axis < 2], axis[axis < 2]
        value = w.numbers(xy)
        n = int(pair.sum())
        x, y = np.full(n, np.nan), np.full(n, np.nan)
        x[p_of[axis == 0]], y[p_of[axis == 1]] = value[axis == 0], value[axis == 1]
        lone = w.kind(member) == SCALAR
        l_of, l_place, l_value = of[lone], place[lone], w.numbers(member[lone])
        even = l_place % 2 == 0
        nexts = np.append(l_value[1:], np.nan)
        nexts[np.append(l_of[1:] != l_of[:-1], True)] = np.nan
        r = np.concatenate([of[pair], l_of[even]])
        k = np.concatenate([place[pair], l_place[even] // 2]) + 1
        out["point"] = {"text": text[owner[r]], "object_no": no[owner[r]], "ring_no": ring_no[r], "point_no": k, "x": np.concatenate([x, l_value[even]]), "y": np.concatenate([y, nexts[even]])}
    return out


def nested_table(files: DataFrame, name: str) -> DataFrame:
    """One of TABLES from the current texts of files (file_id, payload, read_at), with file_id in front."""
    current = latest(files.select("file_id", "payload", "read_at"), "file_id", "read_at").select("file_id", "payload")
    columns = TABLES[name]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payload = b.column(1).cast(pa.binary())
            size = np.diff(np.frombuffer(payload.buffers()[1], np.int32, len(payload) + 1, payload.offset * 4)) if len(payload) else np.zeros(0)
            group = np.cumsum(size) // BLOCK
            for g in np.unique(group):
                at = np.flatnonzero(group == g)
                part = b.slice(int(at[0]), len(at))
                ids = np.asarray(part.column(0))
                flat = flatten([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()], [name])[name]
                arrays = [pa.array(ids[flat["text"]], pa.int64())]
                arrays += [pa.array(flat[c], _ARROW[t], from_pandas=True) for c, t in columns.items()]
                yield pa.record_batch(arrays, names=["file_id", *columns])

    return current.filter("payload is not null").mapInArrow(rows, "file_id long, " + ", ".join(f"{c} {t}" for c, t in columns.items()))


def found_objects(files: DataFrame) -> DataFrame:
    """file_id, image_name, object_no of every object whose image stands in the same file."""
    return nested_table(files, "object").filter("image_name is not null").select("file_id", "image_name", "object_no")
