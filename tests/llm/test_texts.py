import base64
import random

import pytest

from baglight.llm import containers, near_captions, subjects, tokenise

VOCAB = [f"w{i}" for i in range(4000)]


def captions(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "uid string, caption string, words string, id int")


def brute_groups(rows):
    sets = [(u, set(near_captions.words_of(c))) for u, c in rows if c]
    sets = [(u, w) for u, w in sets if len(w) >= 15]
    parent = {u: u for u, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (u, a) in enumerate(sets):
        for v, b in sets[:i]:
            if 10 * len(a & b) >= 7 * len(a | b):
                parent[root(u)] = root(v)
    return {tuple(sorted((u, v))) for u, _ in sets for v, _ in sets if u < v and root(u) == root(v)}


def edited(words, rng, most):
    w = list(words)
    for _ in range(rng.randint(0, most)):
        r = rng.random()
        if r < 0.4 and w:
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        elif r < 0.7:
            w.insert(rng.randrange(len(w) + 1), rng.choice(VOCAB))
        elif w:
            del w[rng.randrange(len(w))]
    rng.shuffle(w)
    return w


@pytest.mark.parametrize("layout", [{}, {"size": 1, "most": 3}, {"size": 3, "most": 6}, {"size": 4, "most": 2}, {"size": 2, "most": 4, "segments": 50}])
def test_near_captions_by_brute_force(spark, layout):
    """Whatever counts as full, however deep cells are divided, and for short and long captions, no link is lost or added."""
    rng = random.Random(len(layout))
    rows = []
    for i in range(12 if layout else 60):
        base = rng.sample(VOCAB[:100] if i % 3 else VOCAB, rng.choice([15, 17, 22, 36] if layout else [15, 17, 22, 36, 50, 90]))
        rows += [(f"u{i}_{j}", " ".join(edited(base, rng, len(base) // 4))) for j in range(5)]
    rows += [(f"copy{i}", "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen!") for i in range(40)]
    rows += [("wide", "ｏｎｅ TWO three, four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), ("short", " ".join(VOCAB[:14])), ("short2", " ".join(VOCAB[:14])), ("none", None), ("empty", "")]
    if not layout:  # cells of long texts are too many where every coordinate counts as full
        rows += [("long", " ".join(VOCAB)), ("long2", " ".join(VOCAB[100:]))]
    got = {tuple(r) for r in near_captions.near_pairs(captions(spark, rows), "uid", "caption", **layout).collect()}
    assert got == brute_groups(rows)


def test_membership_and_number_of_links(spark):
    base = [f"w{i}" for i in range(20)]
    rows = [("a", " ".join(base)), ("b", " ".join(base)), ("c", " ".join([*base[:18], "x1", "x2"])), ("d", " ".join([*base[:14], "x1", "x2", "x3", "x4", "x5", "x6"])), ("e", " ".join(f"z{i}" for i in range(20))), ("f", " ".join([*base[:16], "x1", "x2", "x3", "x4"]))]
    got = {r.uid: (r.group, r.links) for r in near_captions.near_groups(captions(spark, rows), "uid", "caption", links=True).collect()}
    share = lambda x, y: len(x & y) / len(x | y)
    words = {u: set(t.split()) for u, t in rows}
    want = {u: sum(share(words[u], words[v]) >= 0.7 for v in words if v != u) for u in words}
    assert {u: n for u, (_, n) in got.items()} == {u: n for u, n in want.items() if n} and len({g for g, _ in got.values()}) == 1


def test_a_text_of_very_many_words_among_captions(spark):
    rng = random.Random(12)
    book = [f"w{i}" for i in range(20000)]
    rows = [(f"u{i}", " ".join(rng.sample(VOCAB[:60], 30))) for i in range(300)]
    rows += [("book", " ".join(book)), ("book2", " ".join(book[:19000] + VOCAB)), ("part", " ".join(book[:13000])), ("class", " ".join(book[:120])), ("class2", " ".join(book[:140]))]
    got = {tuple(r) for r in near_captions.near_pairs(captions(spark, rows), "uid", "caption").collect()}
    assert got == brute_groups(rows) and {("book", "book2"), ("class", "class2")} <= got


def test_no_captions(spark):
    assert near_captions.near_pairs(captions(spark, []), "uid", "caption").count() == 0
    assert near_captions.near_pairs(captions(spark, [("a", None)]), "uid", "caption").count() == 0


TEXTS = [None, "", " ", "Hello  world\n\n\t x", "<|endoftext|> is a word", "aaaa" * 500, "=-" * 900, "naïve café 🧳🏽‍🔧 данные 数据", "it's they'll 123456 ...", "x" * 3000]


def test_ids_equal_another_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenise.vocabulary("byte_bpe_50k")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=tokenise.WORDS, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    texts = TEXTS + ["".join(rng.choice("abcdeht nios'  .,19é\n") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tokenise.token_ids(df, "byte_bpe_50k").collect()}
    assert got == {i: other.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert tokenise.token_ids(df.limit(0), "byte_bpe_50k").count() == 0


def test_forgotten_words_are_replayed(monkeypatch):
    monkeypatch.setattr(tokenise, "KEPT_WORDS", 5)
    m = tokenise.MergeReplay(tokenise.vocabulary("byte_bpe_50k"))
    first = m.encode(["one two three four five six", "one two"])
    assert m.encode(["one two three four five six", "one two"]) == first


def test_counts_by_several_tokenizers(spark):
    df = spark.createDataFrame([(1, "a small text"), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.tokenizer): r.tokens for r in tokenise.token_counts(df, ["byte_bpe_50k", "piece_bpe_32k", "word_bpe_49k"]).collect()}
    assert got[1, "byte_bpe_50k"] == 3 and got[2, "piece_bpe_32k"] == got[2, "byte_bpe_50k"] == 0 and len(got) == 6
    with pytest.raises(ValueError):
        tokenise.vocabulary("no such thing")


def held(patterns):
    out = {}
    for filling, times in patterns:
        for s, n in filling:
            out[s] = out.get(s, 0) + n * times
    return out


def test_packings_hold_every_document_once():
    rng = random.Random(8)
    for case in range(60):
        capacity = rng.choice([10, 64, 512])
        counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 60))}
        for patterns in (containers.pack(counts, capacity, 3000), containers.best_fit(counts, capacity)):
            assert held(patterns) == counts
            assert all(sum(s * n for s, n in f) <= capacity for f, _ in patterns)
        bins, fit = (sum(t for _, t in p) for p in (containers.pack(counts, capacity, 3000), containers.best_fit(counts, capacity)))
        assert containers.lower_bound(counts, capacity) <= bins <= fit, case


def test_packing_finds_what_best_fit_misses():
    assert sum(t for _, t in containers.best_fit({4: 2, 3: 4, 2: 1}, 10)) >= sum(t for _, t in containers.pack({4: 2, 3: 4, 2: 1}, 10)) == 3
    assert sum(t for _, t in containers.pack({6: 2, 5: 2, 4: 2, 3: 2, 2: 1}, 10)) == 4
    assert containers.pack({}, 5) == []


def test_documents_and_containers(spark):
    rng = random.Random(9)
    sizes = [(i, "t", rng.choice([0, 1, 7, 20, 33, 50, 51, 64, 65, 200, None])) for i in range(500)]
    specs = spark.createDataFrame([(1, "t", 64), (2, "t", 1), (3, "other", 9)], "spec_id int, tokenizer string, capacity long")
    got = containers.pack_documents(spark.createDataFrame(sizes, "doc_id long, tokenizer string, tokens long"), specs).collect()
    want = {i: n or 0 for i, _, n in sizes}
    for spec, capacity in ((1, 64), (2, 1)):
        total, room, pieces = {}, {}, {}
        for r in got:
            if r.spec_id == spec:
                total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
                room[r.container] = room.get(r.container, 0) + r.tokens
                pieces[r.doc_id] = pieces.get(r.doc_id, 0) + 1
        assert total == want and max(room.values()) <= capacity and set(room) == set(range(1, len(room) + 1))
        assert all(pieces[i] == max(1, -(-n // capacity)) for i, n in want.items())
    assert not [r for r in got if r.spec_id == 3]
    empty = spark.createDataFrame([], "doc_id long, tokenizer string, tokens long")
    assert containers.pack_documents(empty, specs).count() == 0
    with pytest.raises(ValueError):
        containers.pack_documents(empty, spark.createDataFrame([(1, "t", 0)], "spec_id int, tokenizer string, capacity long"))


def test_sentences():
    text = "# Notes 12\n\n- First one here.\n2. Second, isn't it?\n<p>Third has no end mark but five</p>\nshort line\n[2024-01-01 10:00] Last."
    assert [len(s) for s in subjects.sentences(text)] == [3, 3, 7, 1]
    assert subjects.sentences(None) == subjects.sentences(" \n") == subjects.sentences("123 ...") == []


def corpus(rng, n):
    topics = {s: [f"{s}{chr(97 + i)}q" for i in range(25)] for s in ("law", "music", "sport")}
    plain = ["the lane was quiet and the queue short", "this bag was scanned twice", "a perfect match and the score was fine", "they looked at the picture again"]
    docs, truth = [], {}
    for i in range(n):
        about = rng.sample(sorted(topics), rng.choice([0, 1, 1, 2]))
        lines = []
        for s in about:
            lines += [f"we talked about {' and '.join(rng.sample(topics[s], 2))} that day." for _ in range(4)]
        lines += [rng.choice(plain) + "." for _ in range(rng.randint(2, 5))]
        rng.shuffle(lines)
        docs.append((i, " ".join(lines), "en", "clash"))
        truth[i] = {s for s in about if 4 / len(lines) >= 0.25}
    return docs, truth


def test_subjects_of_documents_without_labels(spark):
    rng = random.Random(10)
    docs, truth = corpus(rng, 1200)
    labels = [(i, s) for i in range(0, 1200, 10) for s in (truth[i] or {"none"})] + [(0, "nonsense"), (None, "law"), (99999, "law")]
    docs += [(5000, None, None, "x"), (5001, "", "en", "x"), (5002, "  ", "de", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, subject string")
    areas = spark.createDataFrame([("law",), ("music",), ("sport",)], "subject string")
    got = {}
    for r in subjects.Subjects(df, spark.createDataFrame(labels, "doc_id long, subject string"), areas).found().collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    test = [i for i in truth if i % 10]
    right = sum(len(got.get(i, set()) & truth[i]) for i in test)
    assert right / sum(len(truth[i]) for i in test) > 0.95 and right / sum(len(got.get(i, set())) for i in test) > 0.95
    assert not {5000, 5001, 5002} & set(got)


def test_subjects_of_nothing(spark):
    docs = spark.createDataFrame([(1, "One text here.", "en")], "doc_id long, text string, lang string")
    labels, areas = spark.createDataFrame([], "doc_id long, subject string"), spark.createDataFrame([("law",)], "subject string")
    assert subjects.Subjects(docs, labels, areas).found().count() == 0
    assert subjects.Subjects(docs.limit(0), labels, areas).found().count() == 0


@pytest.mark.parametrize("seed, capacity, k, most", [(9, 200, 80, 29), (63, 200, 40, 15)])
def test_packing_tries_targets_that_were_passed_over(seed, capacity, k, most):
    rng = random.Random(seed)
    rng.choice([30, 50, 100, 200]), rng.choice([8, 15, 25, 40, 80])
    counts = {}
    for _ in range(k):
        s = rng.randint(capacity // 5, capacity // 2 + 2)
        counts[s] = counts.get(s, 0) + 1
    packed = containers.pack(counts, capacity, 3000)
    held = {}
    for filling, times in packed:
        assert sum(s * n for s, n in filling) <= capacity
        for s, n in filling:
            held[s] = held.get(s, 0) + n * times
    assert held == counts and sum(t for _, t in packed) <= most


def shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    names = []
    while files.hasNext():
        names.append(files.next().getName())
    return {n.split("_")[1] for n in names if n.startswith("shuffle_")}


def test_shuffle_files_of_a_depth_go_before_the_next(spark, monkeypatch):
    import time

    kept, staged = near_captions.stage, []

    def watched(df, name, **how):
        before = shuffles(spark)
        out = kept(df, name, **how)
        if name in ("words", "sets", "cells", "blocks", "links"):
            until = time.time() + 10  # files are removed a moment later
            while (left := shuffles(spark) - before) and time.time() < until:
                time.sleep(0.1)
            staged.append((name, len(left)))
        return out

    monkeypatch.setattr(near_captions, "stage", watched)
    rng = random.Random(5)
    rows = [(f"u{i}", " ".join(rng.sample(VOCAB[:60], 30))) for i in range(200)]
    assert {tuple(r) for r in near_captions.near_pairs(captions(spark, rows), "uid", "caption", size=3, most=3).collect()} == brute_groups(rows)
    assert [n for n, _ in staged] == ["words", "sets", "cells", "cells", "blocks", "links"] and not any(left for _, left in staged)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_cells_are_packed_without_loss():
    import numpy as np

    rng = np.random.default_rng(3)
    n, m = 300, 9000
    ids, size = np.sort(rng.integers(0, 1 << 62, n)), rng.integers(15, 1 << 20, n)
    parity, sketch = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
    record, key = rng.integers(0, n, m), rng.integers(0, 1 << 48, m).astype(np.uint64)
    packed = near_captions._packed(ids, size, parity, sketch, record, key, 7)
    assert sorted(packed.column("to").to_pylist()) == list(range(7))
    i, s, p, k, owner, keys = near_captions._unpacked([packed.slice(0, 3), packed.slice(3)])
    assert sorted(zip(i[owner].tolist(), s[owner].tolist(), p[owner].tolist(), *k[owner].T.tolist(), keys.tolist())) == sorted(zip(ids[record].tolist(), size[record].tolist(), parity[record].tolist(), *sketch[record].T.tolist(), key.tolist()))
    # A cell costs its key and a small share of its record.
    assert sum(map(len, packed.column("cells").to_pylist())) < 8 * m + 45 * 7 * n
