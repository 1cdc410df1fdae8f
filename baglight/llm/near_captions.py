"""Near-duplicate records with small edits.

A record is the set of different words of its caption. Two records are nearly the same when they
share at least 0.7 of all their words.

* Embedding. A word's hash puts it into one of SEGMENTS segments; a record is reduced to its counts
  (popcounts) per segment. The Manhattan distance of two records' counts is never more than the
  words that stand in one of them only, so whatever holds for near counts holds for near records.
* Grid. A record has a coordinate for each segment it occupies (two for a segment with two words),
  and these have one order for all records, from the segment that fewest records occupy. Of n
  coordinates at most (3 n) // 10 are not shared with a given near record, so the first l that a near
  pair shares are among the first (3 n) // 10 + l of both. Cells are such runs of first shared
  coordinates: one coordinate where few records occupy it, else two, and any cell with more than
  FULL records is divided by the next coordinate, as often as needed (DEPTH), wherever its records
  are. What is still full then is a crowd that agrees in its DEPTH rarest shared coordinates; its
  pairs are compared in blocks of FULL records spread over the tasks.
* Range join. Inside a cell, records are sorted by size, and each is compared with those before it
  by the Manhattan distance of counts summed to 32 segments, after the parities of sums to 64.
* Exact check of what is left, on the words themselves. Links are then closed to groups.

On disk is one depth's cells at a time: the records of a batch and partition are one compressed row,
and a depth's shuffle files go as soon as its pairs are written.

No pair at or above the threshold is lost, at any number of rows, and no cell grows with the rows.
Equal word sets are one record until the end, so copies build no pairs. Records meet only others of
their size class, so that a few long texts among many captions have rare coordinates of their own.

Defined cases: null captions and those with fewer than 15 different words take part in nothing;
order, repetition, letter case, width forms and punctuation of the words don't matter (NFKC, lower
case); an empty table gives no pairs; extra columns aren't read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baglight.functions.stage import drop_stage, stage, width
from baglight.operators.graph import components

LEAST_WORDS = 15
#: Share of all words that near-duplicates have in common, as a fraction.
SHARED, OF = 7, 10
#: Segments of the embedding; their occupation is the one table that is broadcast, a byte each. And of the sums compared inside a cell.
SEGMENTS, SUMS = 1 << 20, 32
#: Records in a cell, above which it is divided, and coordinates of the deepest cells.
FULL, DEPTH = 512, 6
#: Full cells are marked in a bitmap of fixed size; a cell that shares a bit with one is divided as well, which only adds work.
MARKS, KEY_BYTES = 1 << 22, 6
#: Records meet within classes of sizes that end at powers of this.
CLASS = 128
#: Keys a partition of the grid is laid out for, and keys and pairs worked on at once.
MOST_SIZE = (1 << 16) - 1
KEYS_A_PARTITION, KEYS_AT_ONCE, PAIRS_AT_ONCE = 1_000_000, 1 << 19, 1 << 18


def words_of(caption: str) -> list[str]:
    """Different runs of letters and digits after NFKC and lower-casing, sorted."""
    import regex

    return sorted(set(regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFKC", caption).lower())))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Codes:
    """64-bit codes of words, remembered within a task."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(record, code) of each word of the texts, words parted by blanks. Each different word is looked at once."""
        import xxhash

        lists = pa.compute.split_pattern(texts, " ")
        found = lists.flatten().dictionary_encode()
        known = self.known
        if len(known) > 1 << 20:
            known.clear()
        of = [known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in found.dictionary.to_pylist()]
        return np.repeat(np.arange(len(texts)), np.asarray(lists.value_lengths())), np.array(of, np.uint64)[np.asarray(found.indices)]


def word_sets(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, h1, h2 (digests of the word set), words (sorted, parted by blanks) of the texts with enough words."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            keys, words = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words_of(t) if t else []
                if len(ws) >= LEAST_WORDS:
                    keys.append(k)
                    words.append(" ".join(ws))
            d = [xxhash.xxh128_intdigest(w) for w in words]
            yield pa.record_batch([pa.array(keys, b.schema.field(0).type), pa.array([(x >> 64) - 2**63 for x in d], pa.int64()), pa.array([(x & (2**64 - 1)) - 2**63 for x in d], pa.int64()), pa.array(words, pa.string())], names=[key, "h1", "h2", "words"])

    return rows.select(key, text).filter(F.col(text).isNotNull()).mapInArrow(sets, f"`{key}` {dict(rows.dtypes)[key]}, h1 long, h2 long, words string")


def most_different(size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Words that two records of these sizes may differ in."""
    return ((OF - SHARED) * (size_a + size_b)) // (OF + SHARED)


def _class(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(size, 1)) / np.log(CLASS) + 1e-9).astype(np.int64)


def coordinates(record: np.ndarray, code: np.ndarray, n: int, segments: int) -> tuple[np.ndarray, ...]:
    """(view, segment, coordinate) of the words of n records, and record and class of each view.

    A record is seen in its size class, and in the next one too if a near record may be there.
    A coordinate is a segment and the number of the word in it, as one hash.
    """
    size = np.bincount(record, minlength=n)
    low, high = _class(size), _class(size * OF // SHARED)
    owner = np.append(np.arange(n), np.flatnonzero(high > low))
    klass = np.append(low, high[high > low])
    first = np.append(0, np.cumsum(size))[:-1]
    count = size[owner]
    view = np.repeat(np.arange(len(owner)), count)
    at = np.arange(len(view)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[owner], count)
    segment = (_mix(code[at] ^ (klass[view].astype(np.uint64) * np.uint64(0x5851F42D4C957F2D))) % np.uint64(segments)).astype(np.int64)
    order = np.lexsort((segment, view))
    view, segment = view[order], segment[order]
    new = np.append(True, (view[1:] != view[:-1]) | (segment[1:] != segment[:-1]))
    number = np.arange(len(view)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(view) else view
    return view, segment, _mix(segment.astype(np.uint64) + (number.astype(np.uint64) << np.uint64(32)) + np.uint64(1)), owner, klass


def occupation(sets: DataFrame, segments: int = SEGMENTS) -> np.ndarray:
    """Of each segment, eight times the logarithm (base 2) of the records that occupy it, as a byte: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = _Codes(), np.zeros(segments, np.int64)
        for b in batches:
            if b.num_rows:
                record, code = codes.of(b.column(0))
                total += np.bincount(coordinates(record, code, b.num_rows, segments)[1], minlength=segments)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["segment", "n"])

    t = sets.select("words").mapInArrow(count, "segment long, n long").groupBy("segment").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()  # at most a row a segment
    out = np.zeros(segments, np.uint8)
    out[t.column("segment").to_numpy()] = np.minimum(np.floor(8 * np.log2(t.column("n").to_numpy())), 255)
    return out


class _Grid:
    """A batch's records in the order of their coordinates: start of each view, coordinate, whether full, and how many may be missing."""

    def __init__(self, texts: pa.Array, codes: _Codes, held: np.ndarray, full: int):
        record, code = codes.of(texts)
        n = len(texts)
        self.size = np.bincount(record, minlength=n)
        view, segment, value, self.owner, self.klass = coordinates(record, code, n, len(held))
        order = np.lexsort((value, held[segment], view))
        self.value, self.full = value[order], held[segment[order]] > 8 * np.log2(full)
        self.view = view[order]
        self.count = self.size[self.owner]
        self.start = np.cumsum(self.count) - self.count
        self.missing = ((OF - SHARED) * self.count) // OF
        sums = np.minimum(np.bincount(record * SUMS + (code % np.uint64(SUMS)).astype(np.int64), minlength=n * SUMS), 15).reshape(n, 2, 16).astype(np.uint64)
        self.sketch = (sums << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)
        # Whether the counts summed to 64 segments are odd, a bit each.
        odd = np.bincount(record * 64 + (code >> np.uint64(32)).astype(np.int64) % 64, minlength=n * 64).reshape(n, 64).astype(np.uint64) & np.uint64(1)
        self.parity = (odd << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def cells(self, depth: int, marks: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(view, key, place of the last coordinate) of the cells at a depth: first single coordinates that few records occupy and pairs where many do, then cells marked as full with one more coordinate."""
        if depth > 2:
            for view, key, place in self.cells(depth - 1, marks):
                again = marks[depth - 3][(key % np.uint64(MARKS)).astype(np.int64)]
                yield from self._extended(view[again], key[again], place[again], depth)
            return
        place = np.arange(len(self.view)) - self.start[self.view]
        first = place <= self.missing[self.view]
        once, more = first & ~self.full, first & self.full
        yield self.view[once], self.value[once] & _KEY, place[once]
        yield from self._extended(self.view[more], self.value[more], place[more], 2)

    def _extended(self, view: np.ndarray, key: np.ndarray, place: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Cells divided by each coordinate behind that may be the depth-th shared one."""
        number = np.maximum(np.minimum(self.missing[view] + depth, self.count[view]) - place - 1, 0)
        upto = np.cumsum(number)
        at = 0
        while at < len(view):
            base = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, base + KEYS_AT_ONCE, side="right")))
            n = number[at:end]
            of = np.repeat(np.arange(at, end), n)
            behind = place[of] + 1 + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            yield view[of], _mix(key[of] * np.uint64(0x9E3779B97F4A7C15) + self.value[self.start[view[of]] + behind]) & _KEY, behind
            at = end


CELLS = "to int, bytes int, cells binary"
_KEY = np.uint64((1 << 8 * KEY_BYTES) - 1)


def _packed(ids: np.ndarray, size: np.ndarray, parity: np.ndarray, sketch: np.ndarray, record: np.ndarray, key: np.ndarray, partitions: int) -> pa.RecordBatch:
    """Cells (key, record) as a row for each partition: its records with their embedding and each one's keys, by columns, compressed."""
    codec = pa.Codec("zstd", compression_level=1)
    to = ((key >> np.uint64(24)) % np.uint64(partitions)).astype(np.int64)
    order = np.lexsort((record, to))
    record, key, to = record[order], key[order], to[order]
    first = np.flatnonzero(np.append(True, (record[1:] != record[:-1]) | (to[1:] != to[:-1]))) if len(key) else np.zeros(0, np.int64)
    raw = np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
    upto = np.append(first, len(key))
    part = to[first]
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
    sizes, blobs = [], []
    for at, end in zip(starts.tolist(), np.append(starts[1:], len(part)).tolist(), strict=True):
        r = record[first[at:end]]
        whole = b"".join((np.array([end - at]), np.diff(ids[r], prepend=0), size[r].astype(np.int32), np.diff(upto[at : end + 1]).astype(np.int32), sketch[r], parity[r], raw[upto[at] : upto[end]]))
        sizes.append(len(whole))
        blobs.append(codec.compress(whole, asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], names=["to", "bytes", "cells"])


def _unpacked(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """id, size, parity and sketch of the records, and owner (a record's place) and key of their cells."""
    codec, found = pa.Codec("zstd"), []
    for b in parts:
        for size, blob in zip(b.column("bytes").to_pylist(), b.column("cells").to_pylist(), strict=True):
            whole, at = codec.decompress(blob, size, asbytes=True), 8
            n = int(np.frombuffer(whole, np.int64, 1)[0])
            own = []
            for kind, count in ((np.int64, n), (np.int32, n), (np.int32, n), (np.uint64, 2 * n), (np.uint64, n)):
                own.append(np.frombuffer(whole, kind, count, at))
                at += own[-1].nbytes
            found.append((np.cumsum(own[0]), *own[1:], np.frombuffer(whole, np.uint8, -1, at)))
    ids, size, number, sketch, parity, raw = (np.concatenate(x) for x in zip(*found, strict=True))
    key = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    key[:, :KEY_BYTES] = raw.reshape(-1, KEY_BYTES)
    return ids, size.astype(np.int64), parity, sketch.reshape(-1, 2), np.repeat(np.arange(len(ids)), number), key.view(np.uint64).ravel()


def cells(sets: DataFrame, held: np.ndarray, depth: int, marks: list[np.ndarray], full: int, partitions: int) -> DataFrame:
    """The cells of sets (id, words) at a depth, by partition."""
    shared = sets.sparkSession.sparkContext.broadcast((held, marks))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for b in batches:
            if b.num_rows:
                g = _Grid(b.column("words"), codes, shared.value[0], full)
                for view, key, _ in g.cells(depth, shared.value[1]):
                    if len(key):
                        yield _packed(np.asarray(b.column("id")), g.size, g.parity, g.sketch, g.owner[view], key, partitions)

    return sets.select("id", "words").mapInArrow(emit, CELLS)


def _nibbles(s: np.ndarray) -> np.ndarray:
    """(n, 2) uint64 to (n, 32) uint8."""
    b = np.ascontiguousarray(s).view(np.uint8).reshape(len(s), 16)
    return np.concatenate([b & 15, b >> 4], axis=1)


def cell_pairs(ids: np.ndarray, size: np.ndarray, parity: np.ndarray, sketch: np.ndarray, owner: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids (smaller first) of the cells (first, count) that the embedding can't tell to be too far apart, in blocks; owners of a cell are sorted by size.

    Cells of equal count are compared together, each as a square: that reads memory in order.
    """
    counts = _nibbles(sketch)
    # What a partner of equal size may differ in; smaller ones may in less. No two parities differ in more than 64 bits.
    most = np.minimum(most_different(size, size), 64).astype(np.uint8)
    for c in np.unique(count).tolist():
        starts = first[count == c]
        step = max(1, PAIRS_AT_ONCE // (c * c))
        for at in range(0, len(starts), step):
            o = owner[starts[at : at + step, None] + np.arange(c)]
            p = parity[o]
            # Segments of odd difference are the cheapest bound.
            cell, place = np.divmod(np.flatnonzero(np.bitwise_count(p[:, :, None] ^ p[:, None, :]) <= most[o][:, :, None]), c * c)
            i, j = np.divmod(place, c)
            later = i > j
            a, b = o[cell[later], i[later]], o[cell[later], j[later]]
            t = most_different(size[a], size[b])
            ok = (size[a] - size[b] <= t) & (ids[a] != ids[b])
            a, b, t = a[ok], b[ok], t[ok]
            x, y = counts[a], counts[b]
            ok = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int32) <= t
            if ok.any():
                yield np.minimum(ids[a[ok]], ids[b[ok]]), np.maximum(ids[a[ok]], ids[b[ok]])


def _distinct(pairs: list[np.ndarray]) -> pa.RecordBatch:
    seen = np.unique(np.concatenate(pairs), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(seen[:, 0]), pa.array(seen[:, 1])], names=["a", "b"])


def compared(grid: DataFrame, partitions: int, full: int | None) -> DataFrame:
    """Of cells: pairs of ids a < b near enough by the embedding, maybe repeated, and the keys (a, b null) of the cells with more than `full` records."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        ids, size, parity, sketch, owner, key = _unpacked(parts)
        # By cell and size in one number; sizes from MOST_SIZE on count as equal.
        order = np.argsort(key << np.uint64(16) | np.minimum(size, MOST_SIZE).astype(np.uint64)[owner])
        owner, key = owner[order], key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        if full is not None:
            over = key[first[count > full]].view(np.int64)
            if len(over):
                yield pa.RecordBatch.from_arrays([pa.array(over), pa.nulls(len(over), pa.int64())], names=["a", "b"])
        keep = (count > 1) & (count <= full if full is not None else True)
        seen, held = [], 0
        for a, b in cell_pairs(ids, size, parity, sketch, owner, first[keep], count[keep]):
            seen.append(np.stack([a, b], axis=1))
            held += len(a)
            if held > KEYS_AT_ONCE:
                yield _distinct(seen)
                seen, held = [], 0
        if held:
            yield _distinct(seen)

    return grid.repartitionById(partitions, F.col("to")).mapInArrow(compare, "a long, b long")


def blocks(sets: DataFrame, held: np.ndarray, depth: int, marks: list[np.ndarray], full: int, partitions: int) -> DataFrame:
    """The cells at a depth that are marked as full, as cells of two blocks of about `full` records, one for every two blocks, so that any two records of a cell meet."""
    shared = sets.sparkSession.sparkContext.broadcast((held, marks))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for b in batches:
            if b.num_rows:
                g = _Grid(b.column("words"), codes, shared.value[0], full)
                for view, key, _ in g.cells(depth, shared.value[1]):
                    marked = shared.value[1][depth - 2][(key % np.uint64(MARKS)).astype(np.int64)]
                    o = g.owner[view[marked]]
                    columns = [pa.array(np.asarray(b.column("id"))[o]), pa.array(key[marked].view(np.int64)), pa.array(g.size[o].astype(np.int32)), pa.array(g.parity[o].view(np.int64)), pa.array(g.sketch[o, 0].view(np.int64)), pa.array(g.sketch[o, 1].view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "size", "parity", "s0", "s1"])

    rows = stage(sets.select("id", "words").mapInArrow(members, "id long, key long, size int, parity long, s0 long, s1 long"), "crowds")
    number = rows.groupBy("key").agg(F.ceil(F.count("*") / F.lit(full)).alias("n"))
    mine = rows.join(number, "key").withColumn("i", F.pmod(F.xxhash64("id"), "n"))
    every = mine.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                column = lambda c: np.asarray(b.column(c))  # noqa: B023, E731
                key = column("pair").view(np.uint64) & _KEY
                yield _packed(column("id"), column("size"), column("parity").view(np.uint64), np.stack([column("s0"), column("s1")], axis=1).view(np.uint64), np.arange(len(key)), key, partitions)

    return every.select("id", "size", "parity", "s0", "s1", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("pair")).mapInArrow(pack, CELLS)


def near_links(sets: DataFrame, size: int = FULL, most: int = DEPTH, segments: int = SEGMENTS) -> DataFrame:
    """a < b: pairs of ids of sets (id, words) that share at least SHARED / OF of their words. A cell has at most `size` records, or `most` coordinates."""
    n = sets.count()
    held = occupation(sets, segments)
    to = max(1, min(width(sets.sparkSession), ceil(n * 40 / KEYS_A_PARTITION)), ceil(n * 40 / (4 * KEYS_A_PARTITION)))
    found, marks = [], []
    for depth in range(2, most + 1):
        out = stage(compared(cells(sets, held, depth, marks, size, to), to, size), "cells", release=True)
        found.append(out.filter("b is not null"))
        bits = out.filter("b is null").select(F.pmod("a", F.lit(MARKS)).cast("int").alias("bit")).distinct().toArrow().column("bit").to_numpy()  # at most MARKS
        if not len(bits):
            break
        marks.append(np.zeros(MARKS, bool))
        marks[-1][bits] = True
    else:
        found.append(stage(compared(blocks(sets, held, most, marks, size, to), to, None), "blocks", release=True))
    pairs = reduce(DataFrame.union, found).distinct()
    a, b = sets.select(F.col("id").alias("a"), F.split("words", " ").alias("wa")), sets.select(F.col("id").alias("b"), F.split("words", " ").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    return pairs.join(a, "a").join(b, "b").filter(both * (OF + SHARED) >= (F.size("wa") + F.size("wb")) * SHARED).select("a", "b")


def near_groups(rows: DataFrame, key: str, text: str, links: bool = False, **layout: int) -> DataFrame:
    """key, group: every record in a group of at least two; records with equal word sets are linked as well. With links, also the number of records that each is linked to directly, and the group is named by its least key."""
    texts = stage(word_sets(rows, key, text), "words", release=True)
    sets = stage(texts.groupBy("h1", "h2").agg(F.min("words").alias("words"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "sets", release=True)
    made = stage(texts.select(key, "h1", "h2"), "keys")
    drop_stage(texts)  # the words are kept once
    linked = stage(near_links(sets.select("id", "words"), **layout), "links", release=True)
    group = components(linked)
    grouped = sets.join(group.withColumnRenamed("node", "id"), "id", "left").filter("n > 1 or component is not null").select("h1", "h2", F.coalesce("component", "id").alias("group"))
    out = made.select(key, "h1", "h2").join(grouped, ["h1", "h2"])
    if not links:
        return out.select(key, "group")
    both = linked.union(linked.select("b", "a")).toDF("id", "other")
    other = both.join(sets.select(F.col("id").alias("other"), "n"), "other").groupBy("id").agg(F.sum("n").alias("others"))
    degree = sets.select("id", "h1", "h2", "n").join(other, "id", "left").select("h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    out = out.join(degree, ["h1", "h2"]).select(key, "group", "links")
    least = out.groupBy("group").agg(F.min(key).alias("least"))
    return out.join(least, "group").select(key, F.col("least").alias("group"), "links")


def near_pairs(rows: DataFrame, key: str, text: str, **layout: int) -> DataFrame:
    """uid_a < uid_b: all pairs of keys within a group."""
    g = stage(near_groups(rows, key, text, **layout), "groups", release=True)
    a, b = g.select(F.col(key).alias("uid_a"), "group"), g.select(F.col(key).alias("uid_b"), "group")
    return a.join(b, "group").filter("uid_a < uid_b").select("uid_a", "uid_b")
