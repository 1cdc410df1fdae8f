"""Encoding of a whole corpus with a public tokenizer.

Byte-level BPE by corpus-level merge replay. The words of a block of documents are collected, each
distinct word once, and laid end to end as byte tokens. An inverted index holds, for every merge
that some pair of neighbours calls for, the positions of that pair. The merges are applied in rank
order, each at all its positions in the whole block, and only the neighbours of a merged position
are looked up again and filed under their new merge. As a merge never joins tokens of different
words, blocks are independent: a task replays the merges for the words that it hasn't met before and
keeps the ids of met words for its next blocks. So the corpus is read once and never shuffled.

Positions of one rank are taken from left to right, which is the order of the rank file's own
encoder when equal ranks meet in a word.

Other tokenizers of the folder (word_bpe_49k, piece_bpe_32k) are run by their libraries.

Defined cases: null and empty texts give an empty list; strings that look like special tokens are
ordinary text; a text is encoded as it stands, blanks included; other columns pass through
untouched and their names can't clash, as only the key and the text are read.
"""

from __future__ import annotations

import base64
import heapq
import importlib.util
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
#: The pattern that parts a text into words before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a task keeps; above it, the words met so far are forgotten and replayed when met again.
KEPT_WORDS = 1 << 20


class MergeReplay:
    """Token ids of words, by replaying the merges of a rank file over all words at once."""

    def __init__(self, path: str):
        import regex

        rows = (line.split() for line in Path(path).read_bytes().splitlines() if line)
        self.rank = {base64.b64decode(a): int(b) for a, b in rows}
        self.token = {i: t for t, i in self.rank.items()}
        self.byte = [self.rank[bytes([i])] for i in range(256)]
        self.pair: dict[tuple[int, int], int] = {}
        self.word_ids: dict[str, list[int]] = {}
        self.words = regex.compile(WORDS)

    def merged(self, a: int, b: int) -> int:
        """The token that a and b merge into, which is also the merge's rank; -1 where there is none."""
        key = (a, b)
        r = self.pair.get(key)
        if r is None:
            r = self.pair[key] = self.rank.get(self.token[a] + self.token[b], -1)
        return r

    def replay(self, words: list[str]) -> None:
        """Adds the ids of words, distinct and none of them met before, to word_ids."""
        ids: list[int] = []
        starts = [0]
        byte = self.byte
        for w in words:
            ids.extend([byte[b] for b in w.encode()])
            starts.append(len(ids))
        n = len(ids)
        after = list(range(1, n + 1))  # -1 at a word's last token
        before = list(range(-1, n - 1))  # -1 at its first
        for s, e in zip(starts, starts[1:], strict=False):
            before[s] = -1
            after[e - 1] = -1
        index: dict[int, list[int]] = {}
        merged = self.merged
        for i in range(n):
            if after[i] >= 0 and (r := merged(ids[i], ids[i + 1])) >= 0:
                index.setdefault(r, []).append(i)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            positions = index.pop(rank)
            positions.sort()
            for i in positions:
                j = after[i]
                # A position is stale when its token or its neighbour has changed since it was filed.
                if ids[i] < 0 or j < 0 or merged(ids[i], ids[j]) != rank:
                    continue
                k = after[j]
                ids[i], ids[j], after[i] = rank, -1, k
                if k >= 0:
                    before[k] = i
                    if (r := merged(rank, ids[k])) >= 0:
                        if r not in index:
                            index[r] = []
                            heapq.heappush(heap, r)
                        index[r].append(i)
                h = before[i]
                if h >= 0 and (r := merged(ids[h], rank)) >= 0:
                    if r not in index:
                        index[r] = []
                        heapq.heappush(heap, r)
                    index[r].append(h)
        for w, s, e in zip(words, starts, starts[1:], strict=False):
            self.word_ids[w] = [t for t in ids[s:e] if t >= 0]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        known = self.word_ids
        split = [self.words.findall(t) if t else [] for t in texts]
        new = {w for words in split for w in words if w not in known}
        if len(known) + len(new) > KEPT_WORDS:
            known.clear()
            new = {w for words in split for w in words}
        if new:
            self.replay(sorted(new))
        out = []
        for words in split:
            ids: list[int] = []
            for w in words:
                ids += known[w]
            out.append(ids)
        return out


class LibraryEncoder:
    """The tokenizers that aren't rank files."""

    def __init__(self, path: str):
        self.pieces = path.endswith(".model")
        if self.pieces:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.encode_special_tokens = True

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        plain = [t or "" for t in texts]
        if self.pieces:
            return [list(x) for x in self.model.encode(plain, num_threads=1)]
        return [x.ids for x in self.model.encode_batch(plain, add_special_tokens=False)]


def vocabulary(name: str, folder: str = FOLDER) -> str:
    """The file of the named tokenizer; a rank file comes before others of its name."""
    for end in (".tiktoken", ".model", ".json"):
        if (p := Path(folder) / f"{name}{end}").exists():
            return str(p)
    spec = importlib.util.find_spec("public_tokenizers")
    if spec and spec.origin and str(Path(spec.origin).parent) != str(folder):
        return vocabulary(name, str(Path(spec.origin).parent))
    raise ValueError(f"no tokenizer {name} in {folder}")


_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The encoder of a file, made once a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = MergeReplay(path) if path.endswith(".tiktoken") else LibraryEncoder(path)
    return _ENCODERS[path]


def token_ids(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """key, ids: the token ids of each text."""
    path = vocabulary(name, folder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = enc.encode(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    rows = docs.select(key, F.col(text))
    return rows.mapInArrow(encode, f"`{key}` {dict(rows.dtypes)[key]}, ids array<int>")


def token_counts(docs: DataFrame, names: list[str], key: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """key, tokenizer, tokens: the number of tokens of each text by each named tokenizer, in one pass over the texts."""
    paths = {n: vocabulary(n, folder) for n in sorted(set(names))}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for n, p in paths.items():
                sizes = [len(x) for x in encoder(p).encode(texts)]
                yield pa.record_batch([b.column(0), pa.array([n] * len(sizes)), pa.array(sizes, pa.int64())], names=[key, "tokenizer", "tokens"])

    rows = docs.select(key, F.col(text))
    return rows.mapInArrow(count, f"`{key}` {dict(rows.dtypes)[key]}, tokenizer string, tokens long")
