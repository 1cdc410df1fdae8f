"""Subject area of each document.

Documents are embedded by term weighting and truncated singular value decomposition and compared by
cosine with one centroid a subject and language, and one for documents without subject. The
centroids' seeds are the documents labelled by hand; they are refined by all documents, each as far
as it is near a centroid. What the documents then say about their terms refines the term weights (a
term found under all subjects alike, as the words of a phrase or a word with other senses, ends with
weight 0), with which the documents are embedded anew.

At the end every term, word pairs too, is folded into the same space at the mean of its documents. A
sentence is the weighted sum of its terms there, its subject is the centroid of the greatest cosine,
and a document is about a subject when at least a quarter of its sentences are. The cosines of a
sentence with all centroids have its own length in common, so their order is that of the sums of its
terms' products with the centroids; these are kept as a table of terms and subjects.

Texts are cut into sentences and words once; what is staged is a code a word. All documents take part
in every count. The decomposition is a subspace iteration: each pass multiplies the document-term
matrix, kept in Spark, by a terms x rank block; blocks are summed by term range, so what reaches the
driver is terms x rank numbers. Terms and languages count from a share of the documents on
(LEAST_SHARE, LANGUAGE_SHARE), which bounds their number whatever the corpus, by the mean number of
a document's terms over that share.

Defined cases: null, empty and blank texts and texts without any sentence have no subject; a line
without end mark counts as a sentence from five words on, so that headings and greetings don't;
label 'none' and labels outside subject_areas are no subject, repeated labels count once, labels of
unknown documents are passed over; without any labels no document gets a subject; unknown, rare and
null languages form one group.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baglight.functions.stage import drop_stage, stage

SHARE = 0.25
#: A term counts if it is in so many documents at least and in so large a share of them; a language has its own group from a share on.
LEAST_DOCS, LEAST_SHARE, LANGUAGE_SHARE = 4, 1 / 20_000, 1 / 1000
RANK = 64
#: Rounds of weighting and refining; subspace passes of the first round and of others; rounds of centroids.
ROUNDS, FIRST_PASSES, PASSES, REFINES = 3, 2, 1, 2
#: The most that a document of a rare language may count for in the decomposition.
MOST_SAY = 20.0
#: Sharpness of the soft assignment; cosine at which a document begins to count, and its width.
SHARP, NEAR, WIDTH = 12.0, 0.2, 0.3
#: Weight of a hand label against the document's own assignment; labels can be wrong.
TRUST = 0.7
#: Weight from which a term has a say in a sentence.
LEAST_WEIGHT = 1.0
BLOCK = 4096
#: Characters cut at once, and entries of the matrix multiplied at once.
CHARS, ENTRIES = 1 << 22, 1 << 16
#: Stands between two texts; a noncharacter, taken out of texts.
APART = "\uffff"

T_SCHEMA = "doc_id long, lang string, mask int, words array<long>, ends array<int>"


@cache
def _tokens() -> re.Pattern:
    """One pattern for words, digits, end marks and breaks between sentences; list marks and time stamps belong to the break before them."""
    found = [i for i in range(0x110000) if unicodedata.category(chr(i))[0] == "M"]
    runs = [[i for _, i in g] for _, g in groupby(enumerate(found), lambda x: x[1] - x[0])]
    marks = "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs)
    letters = rf"[^\W\d_]+(?:[{marks}]+(?:[^\W\d_]+)?)*"
    stamps = r"(?:\s*\[[^\]\n]{0,40}\])*"
    return re.compile(rf"{letters}(?:[-'](?:[^\W\d_]|[{marks}])+)*|\d+|[.!?。！？…][\"”')\]]*\s+(?:\[[^\]\n]{{0,40}}\]\s*)*|[.!?。！？…]|[\r\n\x85\u2028\u2029]+{stamps}|<[^<>\n{APART}]{{1,200}}>{stamps}|{APART}{stamps}")


WORD, DIGITS, END, BREAK, END_BREAK, NEXT = range(6)


def _kind(token: str) -> int:
    c = token[0]
    if c == APART:
        return NEXT
    if c in ".!?。！？…":
        return END_BREAK if token[1:] and any(x.isspace() for x in token) else END
    if c.isspace() or c == "<":
        return BREAK
    return DIGITS if c.isdigit() and not c.isalpha() else WORD


def cut(texts: list[str | None], known: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words of all sentences, the words of each sentence, and the sentences of each text; known: kind and code of tokens met before."""
    import xxhash

    plain = []
    for t in texts:
        t = t or ""
        if not t.isascii():
            t = unicodedata.normalize("NFKC", t).replace("’", "'").replace(APART, " ")
        plain.append(t.lower())
    # A text begins after its separator, so that its first line's marks belong to it.
    found = pa.array(_tokens().findall("".join(APART + t for t in plain)), pa.string()).dictionary_encode()
    if len(known) > 1 << 20:
        known.clear()
    of = []
    for x in found.dictionary.to_pylist():
        k = known.get(x)
        if k is None:
            k = known[x] = (_kind(x), xxhash.xxh64_intdigest(x) - 2**63)
        of.append(k)
    kinds, codes = np.array([k for k, _ in of], np.int8), np.array([c for _, c in of], np.int64)
    at = np.asarray(found.indices)
    kind = kinds[at]
    n = len(kind)
    # Pieces end with a break, with the next text or at the end.
    stop = np.flatnonzero(kind >= BREAK)
    first, last = np.append(0, stop + 1), np.append(stop, n)
    is_word = kind == WORD
    upto = np.append(0, np.cumsum(is_word))
    words = upto[last] - upto[first]
    closed = np.append(kind[stop] == END_BREAK, False) | ((last > first) & (kind[np.maximum(last - 1, 0)] == END))
    valid = (words >= 5) | (closed & (words > 0))
    text = np.cumsum(np.append(0, kind[stop] == NEXT)) - 1  # the text of each piece; -1 before the first, which is empty
    piece = np.repeat(np.arange(len(first)), words)
    return codes[at[is_word]][valid[piece]], words[valid].astype(np.int32), np.bincount(text[valid], minlength=len(texts)).astype(np.int32)


def sentences(text: str | None) -> list[list[int]]:
    """Word codes of each sentence of a text."""
    codes, words, _ = cut([text], {})
    return [x.tolist() for x in np.split(codes, np.cumsum(words)[:-1])] if len(words) else []


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values, kind))


def words_of(docs: DataFrame) -> DataFrame:
    """doc_id, lang, mask, words (codes), ends (words of each sentence) of docs (doc_id, lang, mask, text) with any sentence."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        for b in rows:
            texts = b.column("text").to_pylist()
            size = np.cumsum([len(t or "") for t in texts])
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHARS, side="right")))
                codes, words, per = cut(texts[at:to], known)
                each = np.add.reduceat(np.append(words, 0), np.minimum(np.append(0, np.cumsum(per)[:-1]), len(words))) * (per > 0)
                part = b.slice(at, to - at)
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("mask"), _lists(codes, each, pa.int64()), _lists(words, per, pa.int32())], names=["doc_id", "lang", "mask", "words", "ends"])
                yield out.filter(pa.array(per > 0))
                at = to

    return docs.select("doc_id", "lang", "mask", "text").mapInArrow(batches, T_SCHEMA)


def _flat(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column without nulls."""
    c = b.column(name)
    return np.asarray(c.flatten()), np.asarray(c.value_lengths())


def _terms(words: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, code) of the words and of the pairs of neighbours in a sentence, words first; place: index of the (first) word. And where the pairs begin."""
    pair = np.flatnonzero(sentence[1:] == sentence[:-1])
    u = words.view(np.uint64)
    both = (u[pair] * np.uint64(0x9E3779B97F4A7C15)) ^ ((u[pair + 1] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F))
    both ^= both >> np.uint64(29)
    return np.append(np.arange(len(words)), pair), np.append(words, both.view(np.int64)), len(words)


def _places(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the document of each word, its sentence, and the sentences of each document."""
    words, size = _flat(b, "words")
    ends, per = _flat(b, "ends")
    return words, np.repeat(np.arange(b.num_rows), size), np.repeat(np.arange(len(ends)), ends), per


def _batches(rows: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Batches with at most ENTRIES * 16 values of the list column, or one row."""
    for b in rows:
        upto = np.cumsum(np.asarray(b.column(name).value_lengths()))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ENTRIES * 16, side="right")))
            yield b.slice(at, to - at)
            at = to


class Vocabulary:
    """Terms in enough documents, by code: codes (sorted), documents, whether a single word."""

    def __init__(self, codes: np.ndarray, documents: np.ndarray, single: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.documents, self.single = codes[order], documents[order].astype(np.float64), single[order]

    def __len__(self) -> int:
        return len(self.codes)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the codes that are terms, and which of the codes these are."""
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        kept = np.flatnonzero(self.codes[at] == code)
        return at[kept], kept


def _vocabulary(texts: DataFrame, total: int) -> Vocabulary:
    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(rows, "words"):
            words, doc, sentence, _ = _places(b)
            place, code, singles = _terms(words, sentence)
            key = code ^ (doc[place] * np.int64(0x9E3779B97F4A7)) if len(code) else code
            _, first = np.unique(key, return_index=True)
            for single, part in ((True, first[first < singles]), (False, first[first >= singles])):
                code_, n = np.unique(code[part], return_counts=True)
                yield pa.record_batch([pa.array(code_, pa.int64()), pa.array(n, pa.int64()), pa.array(np.full(len(n), single))], names=["term", "n", "single"])

    least = max(LEAST_DOCS, ceil(LEAST_SHARE * total))
    counted = texts.select("words", "ends").mapInArrow(count, "term long, n long, single boolean").groupBy("term").agg(F.sum("n").alias("n"), F.max("single").alias("single")).filter(F.col("n") >= least)
    t = counted.toArrow()  # bounded: see the docstring of the module
    return Vocabulary(*(t.column(c).to_numpy() for c in ("term", "n", "single")))


def _sum_blocks(df: DataFrame, rows: int, columns: int) -> np.ndarray:
    """The sum over tasks of blocks (block, value binary of float32), as a rows x columns matrix: bounded by the vocabulary."""

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = None
        for v in t.column("value"):
            x = np.frombuffer(v.as_py(), np.float32).astype(np.float64)
            total = x if total is None else total + x
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "value": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((rows, columns))
    for r in df.groupBy("block").applyInArrow(add, "block int, value binary").collect():
        part = np.frombuffer(r.value).reshape(-1, columns)
        out[r.block * BLOCK : r.block * BLOCK + len(part)] = part
    return out


def _blocks(matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    m = np.ascontiguousarray(matrix, np.float32)
    ids = list(range(0, len(m), BLOCK))
    yield pa.record_batch([pa.array([i // BLOCK for i in ids], pa.int32()), pa.array([m[i : i + BLOCK].tobytes() for i in ids], pa.binary())], names=["block", "value"])


def _sparse(b: pa.RecordBatch, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, value) of the weighted and normalised matrix of a batch, by document."""
    term, size = _flat(b, "terms")
    n = b.num_rows
    doc = np.repeat(np.arange(n), size)
    value = np.log1p(_flat(b, "counts")[0]) * scale[term]
    keep = value > 0
    doc, term, value = doc[keep], term[keep], value[keep]
    norm = np.sqrt(np.bincount(doc, weights=value * value, minlength=n))
    return doc, term, (value / np.maximum(norm[doc], 1e-12)).astype(np.float32)


def _gather(row: np.ndarray, column: np.ndarray, value: np.ndarray, matrix: np.ndarray, out: np.ndarray) -> None:
    """out += A @ matrix for A of entries (row, column, value), sorted by row."""
    for at in range(0, len(row), ENTRIES):
        r = row[at : at + ENTRIES]
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        out[r[first]] += np.add.reduceat(matrix[column[at : at + ENTRIES]] * value[at : at + ENTRIES, None], first, axis=0)


def _embed(n: int, doc: np.ndarray, term: np.ndarray, value: np.ndarray, basis: np.ndarray) -> np.ndarray:
    out = np.zeros((n, basis.shape[1]), np.float32)
    _gather(doc, term, value, basis, out)
    return out


class Model:
    """Codes of the terms that have a say, and each one's weighted products with the centroids."""

    def __init__(self, codes: np.ndarray, product: np.ndarray, names: list[str]):
        order = np.argsort(codes)
        self.names, self.product = names, product[order].astype(np.float32)
        self.terms = Vocabulary(codes[order], np.ones(len(codes)), np.ones(len(codes), bool))

    def shares(self, b: pa.RecordBatch) -> np.ndarray:
        """The share of the sentences of each document that are about each subject."""
        words, _, sentence, per = _places(b)
        k = len(self.names)
        if not len(self.terms):
            return np.zeros((b.num_rows, k))
        place, code, _ = _terms(words, sentence)
        term, kept = self.terms.find(code)
        # A term counts once in a sentence.
        key = np.unique(sentence[place[kept]] * np.int64(len(self.terms)) + term)
        row, term = key // len(self.terms), key % len(self.terms)
        score = np.zeros((int(per.sum()), k), np.float32)
        _gather(row, term, np.ones(len(row), np.float32), self.product, score)
        about = score.argmax(axis=1)
        hit = score[np.arange(len(score)), about] > 0
        doc = np.repeat(np.arange(len(per)), per)
        found = np.bincount(doc[hit] * k + about[hit], minlength=len(per) * k).reshape(-1, k)
        return found / np.maximum(per, 1)[:, None]


class Subjects:
    """docs (doc_id, text, lang) as staged word codes, and the model fitted on them with hand labels (doc_id, subject) for areas (subject)."""

    def __init__(self, docs: DataFrame, labels: DataFrame, areas: DataFrame):
        names = sorted({r.subject for r in areas.select("subject").distinct().collect() if r.subject})  # the subjects
        bit = F.coalesce(*[F.when(F.col("subject") == s, F.lit(1 << i)) for i, s in enumerate(names)], F.lit(0))
        mask = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.bit_or(bit).alias("mask"))
        rows = docs.select("doc_id", "text", "lang").filter("text is not null").join(mask, "doc_id", "left")
        rows = rows.withColumn("mask", F.coalesce("mask", F.lit(-1)).cast("int"))
        self.texts = stage(words_of(rows), "words")
        self.model = _fit(self.texts, names)

    def found(self, share: float = SHARE) -> DataFrame:
        """doc_id, subject: a row for each subject of at least the share of the sentences."""
        shared = self.texts.sparkSession.sparkContext.broadcast(self.model)

        def assign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            names = pa.array(model.names, pa.string())
            for b in _batches(rows, "words"):
                doc, subject = np.nonzero(model.shares(b) >= share)
                yield pa.record_batch([b.column("doc_id").take(pa.array(doc)), names.take(pa.array(subject))], names=["doc_id", "subject"])

        return self.texts.select("doc_id", "words", "ends").mapInArrow(assign, "doc_id long, subject string")


def _fit(texts: DataFrame, names: list[str]) -> Model:
    spark, k = texts.sparkSession, len(names)
    nothing = Model(np.zeros(0, np.int64), np.zeros((0, k)), names)
    counted = texts.groupBy("lang").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).head()[0] or 0
    if not total or not k:
        return nothing
    known = counted.filter(F.col("lang").isNotNull() & (F.col("n") >= max(1, LANGUAGE_SHARE * total))).orderBy(F.desc("n"), "lang").collect()  # at most 1 / LANGUAGE_SHARE
    vocabulary = _vocabulary(texts, total)
    if not len(vocabulary):
        return nothing
    languages = len(known) + 1
    group = {r.lang: i for i, r in enumerate(known)}
    # In the decomposition every language has the same say, or the subjects of the lesser ones would fall out of it.
    say = np.ones(languages, np.float32)
    say[: len(known)] = [min(known[0].n / r.n, MOST_SAY) for r in known]
    index = spark.sparkContext.broadcast(vocabulary)

    def vectors(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = index.value
        for b in _batches(rows, "words"):
            words, doc, sentence, _ = _places(b)
            place, code, _ = _terms(words, sentence)
            term, kept = v.find(code)
            key, n = np.unique(doc[place[kept]] * np.int64(len(v)) + term, return_counts=True)
            row, term = key // len(v), key % len(v)
            single = v.single[term]
            lang = pa.array([group.get(x, languages - 1) for x in b.column("lang").to_pylist()], pa.int32())
            sizes = lambda keep: np.bincount(row[keep], minlength=b.num_rows)  # noqa: B023, E731
            yield pa.record_batch([lang, b.column("mask"), _lists(term[single], sizes(single), pa.int32()), _lists(n[single], sizes(single), pa.int32()), _lists(term[~single], sizes(~single), pa.int32())], names=["lang", "mask", "terms", "counts", "pairs"])

    rows = stage(texts.select("lang", "mask", "words", "ends").mapInArrow(vectors, "lang int, mask int, terms array<int>, counts array<int>, pairs array<int>"), "vectors")
    df = vocabulary.documents
    idf = np.log((total + 1) / df)
    weight = np.where(vocabulary.single, idf, 0)
    basis = np.random.default_rng(5).standard_normal((len(df), RANK))
    product = None
    for turn in range(ROUNDS):
        live = np.flatnonzero(vocabulary.single & (weight > 0))
        if not len(live):
            break
        rank = min(RANK, len(live))
        narrow = np.zeros(len(df), np.int32)
        narrow[live] = np.arange(len(live))
        full = np.zeros((len(df), RANK), np.float32)
        full[live, :rank], sums = _subspace(rows, weight, narrow, say, basis[live, :rank], PASSES if turn else FIRST_PASSES)
        centre = _centres(sums, full[live])
        embedded = stage(rows.mapInArrow(_embedder(spark, weight, full, centre), "lang int, mask int, terms array<int>, pairs array<int>, z array<float>"), "embedded")
        centroid = _refine(embedded, k, languages)
        last = turn == ROUNDS - 1
        share, seen, by_lang, folded = _term_table(embedded, centroid, len(df), last)
        drop_stage(embedded)
        weight = _topical(share, seen, by_lang, df, idf)
        if last:
            mine = seen.argmax(axis=1)  # the language that a term is most often found in
            unit = folded / np.maximum(np.linalg.norm(folded, axis=1, keepdims=True), 1e-12)
            product = np.zeros((len(df), k))
            for i in np.unique(mine):
                product[mine == i] = unit[mine == i] @ centroid[i, :k].T * weight[mine == i, None]
        else:
            weight = np.where(vocabulary.single, weight, 0)
        basis = full
    drop_stage(rows)
    if product is None:
        return nothing
    use = weight > LEAST_WEIGHT
    return Model(vocabulary.codes[use], product[use], names)


def _subspace(rows: DataFrame, weight: np.ndarray, narrow: np.ndarray, say: np.ndarray, start: np.ndarray, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal basis of the leading right singular vectors, by subspace iteration over the documents; and of each term, the sum of its values by language, with the documents of each language as the last row."""
    spark = rows.sparkSession
    q = np.linalg.qr(start + 1e-6 * np.random.default_rng(6).standard_normal(start.shape))[0]
    sums = None
    for _ in range(passes):
        shared = spark.sparkContext.broadcast((weight, narrow, q.astype(np.float32)))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, at, basis = shared.value  # noqa: B023
            rank = basis.shape[1]
            out = np.zeros((len(basis) + 1, rank + len(say)), np.float32)
            for b in _batches(batches, "terms"):
                doc, term, value = _sparse(b, w)
                lang = np.asarray(b.column("lang"))
                term = at[term]
                x = _embed(b.num_rows, doc, term, value, basis) * say[lang][:, None]
                x = np.concatenate([x, np.eye(len(say), dtype=np.float32)[lang]], axis=1)
                out[-1, rank:] += np.bincount(lang, minlength=len(say))
                order = np.argsort(term, kind="stable")
                _gather(term[order], doc[order], value[order], x, out)
            yield from _blocks(out)

        y = _sum_blocks(rows.select("lang", "terms", "counts").mapInArrow(multiply, "block int, value binary"), len(q) + 1, q.shape[1] + len(say))
        sums = y[:, q.shape[1] :]
        q = np.linalg.qr(y[:-1, : q.shape[1]] + 1e-9 * q)[0]
        shared.unpersist()
    return q, sums


def _centres(sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Mean embedding of each language's documents."""
    return (sums[:-1].T @ basis) / np.maximum(sums[-1][:, None], 1)


def _embedder(spark, weight: np.ndarray, basis: np.ndarray, centre: np.ndarray) -> Callable:
    """z: the embedding less its language's mean, at unit length."""
    shared = spark.sparkContext.broadcast((weight, basis, centre.astype(np.float32)))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, q, c = shared.value
        for b in _batches(batches, "terms"):
            z = _embed(b.num_rows, *_sparse(b, w), q) - c[np.asarray(b.column("lang"))]
            z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            yield pa.record_batch([b.column("lang"), b.column("mask"), b.column("terms"), b.column("pairs"), _lists(z.ravel(), np.full(b.num_rows, z.shape[1]), pa.float32())], names=["lang", "mask", "terms", "pairs", "z"])

    return embed


def _points(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lang, mask = np.asarray(b.column("lang")), np.asarray(b.column("mask"))
    return lang, mask, np.asarray(b.column("z").flatten()).reshape(len(lang), -1)


def _labelled(mask: np.ndarray, k: int) -> np.ndarray:
    """Subjects of labelled documents, and none as the last."""
    y = (np.maximum(mask, 0)[:, None] >> np.arange(k)) & 1
    return np.concatenate([y, (mask == 0)[:, None]], axis=1).astype(np.float32)


def _assign(lang: np.ndarray, mask: np.ndarray, z: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Soft subjects of documents by cosine; labelled ones lean on their labels."""
    k = centroid.shape[1] - 1
    cosine = np.zeros((len(z), k + 1), np.float32)
    for i in np.unique(lang):
        cosine[lang == i] = z[lang == i] @ centroid[i].T
    top = cosine.max(axis=1)
    q = np.exp(SHARP * (cosine - top[:, None]))
    q *= np.clip((top - NEAR) / WIDTH, 0, 1)[:, None] / q.sum(axis=1, keepdims=True)
    y = _labelled(mask, k)
    known = mask >= 0
    q[known] = TRUST * y[known] / np.maximum(y[known].sum(axis=1, keepdims=True), 1) + (1 - TRUST) * q[known]
    return q


def _refine(embedded: DataFrame, k: int, languages: int) -> np.ndarray:
    """Unit centroids (language, subject or none, rank): the seeds of the labelled documents first, then REFINES rounds over all documents."""
    spark = embedded.sparkSession
    rows = embedded.select("lang", "mask", "z")
    centroid = None
    for turn in range(REFINES + 1):
        shared = spark.sparkContext.broadcast(centroid)

        def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = shared.value  # noqa: B023
            out = np.zeros((languages, k + 1, RANK), np.float32)
            for b in batches:
                lang, mask, z = _points(b)
                if now is None:
                    y = _labelled(mask, k)
                    q = y / np.maximum(y.sum(axis=1, keepdims=True), 1)
                else:
                    q = _assign(lang, mask, z, now)
                for i in np.unique(lang):
                    out[i] += q[lang == i].T @ z[lang == i]
            yield from _blocks(out.reshape(-1, RANK))

        source = rows if turn else rows.filter("mask >= 0")
        total = _sum_blocks(source.mapInArrow(pull, "block int, value binary"), languages * (k + 1), RANK).reshape(languages, k + 1, RANK)
        total = total + 0.02 * total.sum(axis=0)  # a language without seeds begins at the subject's common centroid
        centroid = (total / np.maximum(np.linalg.norm(total, axis=2, keepdims=True), 1e-12)).astype(np.float32)
        shared.unpersist()
    return centroid


def _term_table(embedded: DataFrame, centroid: np.ndarray, size: int, pairs: bool) -> tuple[np.ndarray, ...]:
    """Of each term, documents by subject and by language; of each language, documents by subject; of each term, the sum of its documents' embeddings."""
    shared = embedded.sparkSession.sparkContext.broadcast(centroid)
    languages, k, rank = centroid.shape
    wide = k + languages + rank * pairs

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((size + languages, wide), np.float32)
        for b in _batches(batches, "pairs" if pairs else "terms"):
            lang, mask, z = _points(b)
            q = _assign(lang, mask, z, shared.value)
            x = np.concatenate([q, np.eye(languages, dtype=np.float32)[lang], *([z] if pairs else [])], axis=1)
            for name in ("terms", "pairs")[: 1 + pairs]:
                term, n = _flat(b, name)
                doc = np.repeat(np.arange(b.num_rows), n)
                order = np.argsort(term, kind="stable")
                _gather(term[order], doc[order], np.ones(len(term), np.float32), x, out)
            for i in np.unique(lang):
                out[size + i] += x[lang == i].sum(axis=0)
        yield from _blocks(out)

    columns = ["lang", "mask", "terms", *(["pairs"] if pairs else []), "z"]
    total = _sum_blocks(embedded.select(*columns).mapInArrow(count, "block int, value binary"), size + languages, wide)
    docs = np.maximum(total[size:, k : k + languages].sum(axis=1, keepdims=True), 1)
    return total[:size, : k - 1], total[:size, k : k + languages], total[size:, : k - 1] / docs, total[:size, k + languages :]


def _topical(share: np.ndarray, seen: np.ndarray, by_lang: np.ndarray, df: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weight of terms: high where the documents of a term are of one subject far more than its languages' documents are."""
    expected = seen @ by_lang
    prior = expected / np.maximum(expected.sum(axis=1, keepdims=True), 1e-9)
    lift = np.log(np.maximum((share + prior) / (expected + prior + 1e-9), 1e-6))
    subject = lift.argmax(axis=1)
    at = np.arange(len(df))
    return idf * np.clip((share[at, subject] / (df + 1) - 0.25) / 0.35, 0, 1) * np.clip(lift[at, subject], 0, 1)


def composition(docs: DataFrame, found: DataFrame) -> DataFrame:
    """subject, lang, source, documents: the corpus by subject; a null subject counts documents without any."""
    return docs.select("doc_id", "lang", "source").join(found, "doc_id", "left").groupBy("subject", "lang", "source").agg(F.count("*").alias("documents"))
