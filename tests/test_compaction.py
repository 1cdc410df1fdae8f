import json
from datetime import datetime, timedelta

import numpy as np

from baglight.functions.curve import hilbert
from baglight.operators.compaction import compact, complete_records, file_sizes

T = datetime(2024, 1, 1)


def line(uid, **more):
    return json.dumps({"uid": uid, "img_path": f"S/Images/Class 3_X/{uid}.jpg", "cache_ok": True} | more)


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "file_id long, file_path string, payload string, written_at timestamp, line string")


def test_newest_complete_record_of_committed_files(spark):
    rows = [
        (1, "c/a.jsonl", line("u1") + "\r\n" + line("u2", cache_ok="false") + "\n\n" + line("u3")[:-5], T),
        (2, "c/b.jsonl", line("u1", img_path="new") + "\n" + line("u4") + " x\n[1]\n\"s\"", T + timedelta(1)),
        (3, "c/_tmp/c.jsonl", line("u5"), T + timedelta(2)),
        (4, "c/d.jsonl.tmp", line("u1"), T + timedelta(2)),
        (5, ".x/e.jsonl", line("u1"), T + timedelta(2)),
        (6, "c/f.jsonl", None, T),
        (7, None, line("u6", cache_ok=7), None),
        (2, "c/b.jsonl", line("u1", img_path="new"), T + timedelta(1)),
    ]
    store = compact(table(spark, rows), 200, 400)
    got = {r.uid: (r.file_id, r.img_path, r.cache_ok) for r in store.rows.collect()}
    assert got == {"u1": (2, "new", True), "u2": (1, "S/Images/Class 3_X/u2.jpg", False), "u6": (7, "S/Images/Class 3_X/u6.jpg", None)}
    assert store.rows.count() == 3


def test_files_are_near_the_target_and_never_above_the_limit(spark):
    rows = [(i, f"c/{i}.jsonl", "\n".join(line(f"u{i}_{j}") for j in range(1 + i % 7)), T) for i in range(300)]
    rows.append((999, "c/hot.jsonl", "\n".join(line("same", n=i) for i in range(2000)), T))
    rows.append((1000, "c/big.jsonl", line("big", img_path="y" * 9000), T))
    store = compact(table(spark, rows), 4000, 8000)
    sizes = file_sizes(store).collect()
    assert sum(r.rows for r in sizes) == store.rows.select("uid").distinct().count() == sum(1 + i % 7 for i in range(300)) + 2
    big = [r for r in sizes if r.bytes > 8000]
    assert len(big) == 1 and big[0].rows == 1
    rest = [r.bytes for r in sizes if r.rows > 1]
    assert np.mean(rest) > 3000 and max(rest) <= 8000


def test_empty_table(spark):
    store = compact(table(spark, []), 100, 200)
    assert store.rows.count() == 0 and file_sizes(store).count() == 0
    assert complete_records(table(spark, [(1, "a", "", T)])).count() == 0


def test_hilbert_codes_are_a_path_of_neighbours():
    axes = np.array([(x, y) for x in range(16) for y in range(16)])
    code = hilbert(axes, 4)
    assert sorted(code) == list(range(256))
    path = axes[np.argsort(code)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
