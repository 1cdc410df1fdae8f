"""Same or near-same records across splits.

Two ways for a val or test scan to be in train as well are looked for:

* the same file. Paths are normalised and cut into content-defined chunks: a rolling hash over the
  bytes marks the cuts, so the same run of text gives the same chunks whatever stands before it.
  Chunk digests of the train part are a distinct set, a record's chunks found in it are summed by
  length into its overlap fraction, which the report gives, and only records with fraction 1 go on
  to the exact comparison of the whole path. No pairs are built on a shared chunk, so a chunk that
  all records share costs one row.
* nearly the same picture: at most 12 of the 128 signature bits differ. Chunks cut by content
  can't decide this (12 scattered flips can leave no run of bits longer than 9, which no cut rule
  survives), so signatures are cut at fixed places into 7 blocks. 12 flips leave one block with at
  most one flip; held-out signatures look up every block and every block with one bit flipped, and
  candidates are checked by their exact distance. Copies of a signature are one row until the end,
  and the report counts pairs from the sizes of the classes without building them.

Defined cases: null and all-zero signatures match nothing (one null half makes the whole null);
a null path and one without the split folder name no file; rows in no part are ignored; a scan
present in both parts of its own uid can't occur, as a uid has one current row; empty tables give
no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baglight.functions.stage import stage
from baglight.operators.splits import near_signatures, signatures

MAX_BITS = 12
#: How the split folder's name begins, from which on two paths are compared.
ROOT = "stcray_"
WINDOW, MASK, LEAST, MOST = 8, 15, 4, 64


def same_file_name(path: Column, root: str = ROOT) -> Column:
    """The path from the first folder that begins with `root` on, in lower case, with one slash between segments and without dot segments and escapes."""
    decoded = F.when(path.contains("%"), F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)).otherwise(path)
    plain = F.lower(F.translate(decoded, "\\", "/"))
    # Two dots need a look at each segment in turn; all other paths are settled by patterns.
    segments = F.filter(F.split(plain, "/"), lambda s: ~s.isin("", "."))
    up = F.aggregate(segments, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    simple = F.regexp_replace(plain, r"/(?:\.?/)+", "/")
    resolved = F.when(plain.contains(".."), F.concat_ws("/", up)).otherwise(simple)
    found = F.regexp_extract(resolved, rf"(?:^|/)(\Q{root}\E.*?)(?:/\.?)?$", 1)
    return F.when(found != "", found)


def cut_points(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Starts of the chunks of several records laid end to end in data (uint8); starts: each record's first byte.

    The hash of the last WINDOW bytes is computed for all bytes at once; a chunk ends after a byte whose
    hash has no bit of MASK, but not within LEAST bytes of the last cut, and at MOST bytes anyway.
    """
    n = len(data)
    table = np.random.default_rng(20240607).integers(0, 2**32, 256, dtype=np.uint64)
    g, h = table[data], np.zeros(n, np.uint64)
    first = np.zeros(n, np.int64)
    first[starts] = starts
    first = np.maximum.accumulate(first)
    at = np.arange(n)
    for k in range(WINDOW):  # bytes of another record don't count
        inside = at - k >= first
        h[k:] += np.where(inside[k:], g[: n - k] << np.uint64(k), np.uint64(0))
    marks = np.flatnonzero((h >> np.uint64(7)) & np.uint64(MASK) == 0) + 1
    cuts, ends = [], np.append(starts[1:], n)
    lo = np.searchsorted(marks, starts)
    hi = np.searchsorted(marks, ends)
    for s, e, a, b in zip(starts.tolist(), ends.tolist(), lo.tolist(), hi.tolist(), strict=True):
        if s == e:
            continue
        cuts.append(s)
        last = s
        for m in marks[a:b].tolist():
            while m - last > MOST:
                last += MOST
                cuts.append(last)
            if m - last >= LEAST and m < e:
                cuts.append(m)
                last = m
        while e - last > MOST:
            last += MOST
            cuts.append(last)
    return np.array(cuts, np.int64)


def chunks(rows: DataFrame, text: str) -> DataFrame:
    """rows with digest, bytes of each content-defined chunk of text; null and empty texts have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            texts = [t.encode() for t in b.column(text).to_pylist()]
            size = np.array([len(t) for t in texts], np.int64)
            raw, ends = b"".join(texts), np.cumsum(size)
            if not raw:
                continue
            cuts = cut_points(np.frombuffer(raw, np.uint8), (ends - size)[size > 0])
            stops = np.append(cuts[1:], len(raw))
            owner = pa.array(np.searchsorted(ends, cuts, side="right"))
            digests = [xxhash.xxh64_intdigest(raw[a:z]) - 2**63 for a, z in zip(cuts.tolist(), stops.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(c.take(owner) for c in b.columns), pa.array(digests, pa.int64()), pa.array(stops - cuts, pa.int64())], names=[*b.schema.names, "digest", "bytes"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.filter(F.col(text).isNotNull()).mapInArrow(cut, f"{kinds}, digest long, bytes long")


def file_overlaps(scans: DataFrame) -> DataFrame:
    """file, fraction of every different file name of the held-out scans (part, file): the share of its bytes whose chunks occur in any of train."""
    held, train = F.col("part") != "train", F.col("part") == "train"
    names = scans.filter("file is not null").groupBy("file").agg(F.max(train).alias("train"), F.max(held).alias("held"))
    made = stage(chunks(names, "file"), "chunks")
    # Digests are a distinct set, so that a chunk of all records is one row on this side.
    seen = made.filter("train").select("digest").distinct().withColumn("hit", F.lit(True))
    mine = made.filter("held").join(seen, "digest", "left")
    return mine.groupBy("file").agg((F.sum(F.when(F.col("hit"), F.col("bytes")).otherwise(0)) / F.sum("bytes")).alias("fraction"))


def same_files(held_out: DataFrame, train: DataFrame, overlaps: DataFrame) -> DataFrame:
    """a, b: uids of a train and a held-out scan (uid, file) with the same file: of file names whose chunks all occur in train, those that are there as a whole."""
    whole = overlaps.filter("fraction = 1").select("file")
    return held_out.select(F.col("uid").alias("b"), "file").join(whole, "file", "left_semi").join(train.select(F.col("uid").alias("a"), "file"), "file").select("a", "b")


class Overlaps:
    """What is shared between the held-out scans and train, by classes: nothing here grows with the pairs of scans.

    held, train: uid, part, folder_name if given, file, sig_d, sig_a. files: file, fraction of the
    held-out names. near: d, a, d2, a2 of different signatures of both sides near enough.
    """

    def __init__(self, scans: DataFrame, most: int = MAX_BITS, root: str = ROOT):
        rows = scans.filter(F.col("part").isin("train", "val", "test"))
        more = [c for c in ("folder_name",) if c in scans.columns]
        rows = stage(rows.select("uid", "part", *more, same_file_name(F.col("img_path"), root).alias("file"), "sig_d", "sig_a"), "scans")
        self.train, self.held = rows.filter("part = 'train'"), rows.filter("part <> 'train'")
        self.signs, self.held_signs = signatures(self.train), signatures(self.held)
        self.files = stage(file_overlaps(rows), "files")
        self.near = stage(near_signatures(self.held_signs.select("d", "a").distinct(), self.signs.select("d", "a").distinct(), most), "near")


def cross_split_pairs(scans: DataFrame) -> DataFrame:
    """a (in train), b (in val or test) of scans (uid, part, img_path, sig_d, sig_a), each pair once."""
    o = Overlaps(scans)
    b = o.held_signs.withColumnRenamed("uid", "held").join(o.near, ["d", "a"]).select("held", "d2", "a2")
    pairs = b.join(o.signs.select("uid", F.col("d").alias("d2"), F.col("a").alias("a2")), ["d2", "a2"]).select(F.col("uid").alias("a"), F.col("held").alias("b"))
    return pairs.union(same_files(o.held, o.train, o.files)).distinct()


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("uid_a"), F.greatest("a", "b").alias("uid_b"))


def overlap_report(scans: DataFrame) -> DataFrame:
    """part, folder_name, scans, overlapping, pairs, fraction of the held-out parts, for every folder, overlapping or not.

    Pairs are counted by multiplying class sizes and never built: those of near signatures plus
    those of equal files less those that are both. fraction is the mean share of the scans' file
    names (in bytes) whose chunks occur in train; scans without a file name don't count in it.
    """
    o = Overlaps(scans)
    count = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("n"))
    sizes = o.signs.select(F.col("d").alias("d2"), F.col("a").alias("a2"))
    near = o.near.join(count(sizes, "d2", "a2"), ["d2", "a2"]).groupBy("d", "a").agg(F.sum("n").alias("near"))
    whole = o.files.filter("fraction = 1").select("file")
    same = count(o.train.join(whole, "file", "left_semi"), "file").withColumnRenamed("n", "same")
    both_files = signatures(o.train, "file").filter("file is not null").withColumnsRenamed({"d": "d2", "a": "a2"})
    mine = signatures(o.held, "file").join(same.select("file"), "file", "left_semi").select("file", "d", "a").distinct()
    both = mine.join(o.near, ["d", "a"]).join(count(both_files, "file", "d2", "a2"), ["file", "d2", "a2"]).groupBy("file", "d", "a").agg(F.sum("n").alias("both"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    held = o.held.withColumnsRenamed({"sig_d": "d", "sig_a": "a"}).join(near, ["d", "a"], "left").join(same, "file", "left").join(both, ["file", "d", "a"], "left").join(o.files, "file", "left")
    # A null or all-zero signature has no row in near, a null name none in same.
    pairs = zero(F.col("near")) + zero(F.col("same")) - zero(F.col("both"))
    return held.withColumn("pairs", pairs).groupBy("part", "folder_name").agg(F.count("*").alias("scans"), F.sum((F.col("pairs") > 0).cast("long")).alias("overlapping"), F.sum("pairs").alias("pairs"), F.avg("fraction").alias("fraction"))

