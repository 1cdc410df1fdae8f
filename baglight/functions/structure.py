"""Vectorised structural index of JSON texts.

Many texts are laid end to end as bytes, each followed by a line end. Bitmaps of quotes, brackets
and delimiters are built for all bytes at once; bytes inside strings are masked out by the parity of
unescaped quotes; nesting depth is a prefix sum of opening less closing brackets. What is left is a
sequence of tokens (brackets, delimiters, strings, scalars), on which brackets are paired, parents
and list places found and the grammar checked by array operations, without a loop over bytes,
tokens or texts.

A text is valid if it is one JSON value (RFC 8259) with white space around it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

OBJECT, LIST, STRING, SCALAR = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
for _c, _k in ((b"{", 1), (b"[", 2), (b"}", 5), (b"]", 6), (b",", 7), (b":", 8)):
    _KIND[_c[0]] = _k
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r")] = True
_NUMBER = re.compile(rb"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_ESCAPE = re.compile(rb'\\(["\\/bfnrt]|u[0-9a-fA-F]{4})')


@dataclass
class Index:
    """One row a JSON value, in document order.

    text: the number of its text; kind; first, last: its bytes, quotes and brackets included;
    parent: the row of the object or list that holds it, -1 for a text's own value;
    place: its place in that list or object from 0; key: the token bytes of its key (first, last), or -1.
    """

    raw: bytes
    text: np.ndarray
    kind: np.ndarray
    first: np.ndarray
    last: np.ndarray
    parent: np.ndarray
    place: np.ndarray
    key_first: np.ndarray
    key_last: np.ndarray
    valid: np.ndarray

    def bytes_of(self, row: int) -> bytes:
        return self.raw[self.first[row] : self.last[row] + 1]


def _escaped(data: np.ndarray) -> np.ndarray:
    """Bytes after an odd run of backslashes."""
    slash = data == 0x5C
    at = np.flatnonzero(slash)
    out = np.zeros(len(data) + 1, bool)
    if len(at):
        new = np.append(True, np.diff(at) != 1)
        begin = at[new][np.cumsum(new) - 1]
        odd = (at - begin) % 2 == 0  # an odd number of backslashes up to and with this one
        out[at[odd] + 1] = True
    return out[:-1]


def structural_index(texts: list[bytes]) -> Index:
    """The values of all texts; valid says which texts are JSON, and rows of others are left out."""
    n_text = len(texts)
    raw = b"\n".join(texts) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    size = np.fromiter((len(t) for t in texts), np.int64, n_text)
    begin = np.cumsum(size + 1) - size - 1
    valid = np.ones(n_text, bool)
    # Bitmap of the quotes that open or close a string; parity starts anew with each text.
    quote = np.flatnonzero((data == 0x22) & ~_escaped(data)) if b"\\" in raw else np.flatnonzero(data == 0x22)
    of_quote = np.searchsorted(begin, quote, side="right") - 1
    before = np.searchsorted(quote, begin)
    odd = np.diff(np.append(before, len(quote))) % 2 == 1
    if odd.any():  # an unclosed string; its text has no tokens
        valid[odd] = False
        keep = ~odd[of_quote]
        quote = quote[keep]
    opens, closes = quote[::2], quote[1::2]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[opens] += 1
    edge[closes + 1] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    control = (data < 0x20) & inside
    if control.any():
        valid[np.searchsorted(begin, np.flatnonzero(control), side="right") - 1] = False
    kind = np.where(inside, 0, _KIND[data]).astype(np.uint8)
    # A scalar is a run of bytes that are neither white space, delimiter nor in a string.
    loose = (kind == 0) & ~inside & ~_SPACE[data]
    step = np.diff(loose.astype(np.int8), prepend=0, append=0)
    s_first, s_last = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
    marks = np.flatnonzero(kind)
    first = np.concatenate([marks, opens, s_first])
    last = np.concatenate([marks, closes, s_last])
    what = np.concatenate([kind[marks], np.full(len(opens), STRING, np.uint8), np.full(len(s_first), SCALAR, np.uint8)])
    order = np.argsort(first, kind="stable")
    first, last, what = first[order], last[order], what[order]
    text = np.searchsorted(begin, first, side="right") - 1
    _check_strings(raw, first, last, what, text, valid)
    _check_scalars(raw, first, last, what, text, valid)
    # Depth by prefix sums, each text from 0; a bracket has the depth of what it holds.
    up, down = what <= LIST, (what == 5) | (what == 6)
    change = up.astype(np.int32) - down
    total = np.cumsum(change)
    lo = np.searchsorted(text, np.arange(n_text))
    hi = np.searchsorted(text, np.arange(n_text), side="right")
    base = np.where(lo > 0, np.append(0, total)[lo], 0)
    depth = total - base[text] + down
    end = np.where(hi > 0, np.append(0, total)[hi], 0) - base
    valid &= (hi > lo) & (end == 0)
    np.logical_and.at(valid, text[down & (depth < 1)], False)
    good = valid[text]
    first, last, what, text, depth, up, down = (x[good] for x in (first, last, what, text, depth, up, down))
    # Brackets of one text and depth alternate between opening and closing.
    at = np.flatnonzero(up | down)
    by = at[np.lexsort((at, depth[at], text[at]))]
    left, right = by[::2], by[1::2]
    if len(by) % 2 == 0:
        wrong = ~up[left] | ~down[right] | (what[right] != what[left] + 4)
        valid[text[left[wrong]]] = False
    n = len(what)
    match = np.full(n, -1, np.int64)
    match[left] = right
    # The holder of a token is the last opening bracket one level above; found per level in sorted order.
    level = depth - (up | down)
    key = text.astype(np.int64) * (int(depth.max(initial=0)) + 2)
    opened = np.flatnonzero(up)
    okey = key[opened] + depth[opened]
    osort = np.lexsort((opened, okey))
    span = np.int64(n + 1)
    where = np.searchsorted(okey[osort] * span + opened[osort], (key + level) * span + np.arange(n), side="left") - 1
    holder = np.where((level > 0) & (where >= 0), opened[osort][np.maximum(where, 0)] if len(opened) else -1, -1)
    holder = np.where(level > 0, holder, -1)
    _check_grammar(what, holder, text, level, valid)
    # Values: whatever opens, strings and scalars, but for keys.
    colon = what == 8
    is_key = np.zeros(n, bool)
    c = np.flatnonzero(colon[1:] & (text[1:] == text[:-1]))
    is_key[c] = True
    value = (what <= SCALAR) & ~is_key & valid[text]
    rows = np.flatnonzero(value)
    number = np.full(n + 1, -1, np.int64)
    number[rows] = np.arange(len(rows))
    prior = np.maximum(rows - 1, 0)
    keyed = (rows > 0) & colon[prior] & (text[prior] == text[rows])
    k = np.maximum(rows - 2, 0)
    parent = number[holder[rows]]
    # Place: values of one holder are in order when sorted by holder, then token.
    place = np.zeros(len(rows), np.int64)
    s = np.lexsort((rows, holder[rows], text[rows]))
    if len(s):
        new = np.append(True, (holder[rows][s][1:] != holder[rows][s][:-1]) | (text[rows][s][1:] != text[rows][s][:-1]))
        starts = np.flatnonzero(new)
        place[s] = np.arange(len(s)) - starts[np.cumsum(new) - 1]
    stop = np.where(match[rows] >= 0, last[match[rows]], last[rows])
    return Index(raw, text[rows], what[rows], first[rows], stop, parent, place, np.where(keyed, first[k], -1), np.where(keyed, last[k], -1), valid)


def _check_strings(raw: bytes, first: np.ndarray, last: np.ndarray, what: np.ndarray, text: np.ndarray, valid: np.ndarray) -> None:
    """Only strings with a backslash need a look."""
    if b"\\" not in raw:
        return
    slashes = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x5C)
    s = np.flatnonzero(what == STRING)
    has = np.searchsorted(slashes, last[s]) > np.searchsorted(slashes, first[s])
    known: dict[bytes, bool] = {}
    for t in s[has].tolist():
        b = raw[first[t] : last[t] + 1]
        if b not in known:
            known[b] = b"\\" not in _ESCAPE.sub(b"", b)
        if not known[b]:
            valid[text[t]] = False


def _check_scalars(raw: bytes, first: np.ndarray, last: np.ndarray, what: np.ndarray, text: np.ndarray, valid: np.ndarray) -> None:
    """Numbers of digits, a point and digits pass at once; the others are looked at, each spelling once."""
    s = np.flatnonzero(what == SCALAR)
    if not len(s):
        return
    data = np.frombuffer(raw, np.uint8)
    digit = (data >= 0x30) & (data <= 0x39)
    digits = np.append(0, np.cumsum(digit, dtype=np.int32))
    points = np.append(0, np.cumsum(data == 0x2E, dtype=np.int32))
    a, z = first[s], last[s] + 1
    nd, np_ = digits[z] - digits[a], points[z] - points[a]
    minus = data[a] == 0x2D
    lead = a + minus
    plain = (nd + np_ + minus == z - a) & (np_ <= 1) & digit[np.minimum(lead, len(data) - 1)] & digit[z - 1]
    second = data[np.minimum(lead + 1, len(data) - 1)]
    plain &= (data[np.minimum(lead, len(data) - 1)] != 0x30) | (z - lead == 1) | (second == 0x2E)
    known: dict[bytes, bool] = {b"true": True, b"false": True, b"null": True}
    for t in s[~plain].tolist():
        b = raw[first[t] : last[t] + 1]
        if b not in known:
            known[b] = _NUMBER.fullmatch(b) is not None
        if not known[b]:
            valid[text[t]] = False


def _check_grammar(what: np.ndarray, holder: np.ndarray, text: np.ndarray, level: np.ndarray, valid: np.ndarray) -> None:
    """Each token is judged by the one before it and by what holds both; wrong marks its text as invalid."""
    n = len(what)
    if not n:
        return
    prev = np.append(0, what[:-1])
    new = np.append(True, text[1:] != text[:-1])
    prev[new] = 0
    in_object = np.where(holder >= 0, what[np.maximum(holder, 0)] == OBJECT, False)
    in_list = np.where(holder >= 0, what[np.maximum(holder, 0)] == LIST, False)
    nxt = np.append(what[1:], 0)
    nxt[np.append(new[1:], True)] = 0
    value = what <= SCALAR
    closed = (prev == STRING) | (prev == SCALAR) | (prev == 5) | (prev == 6)
    after_open = (prev == OBJECT) | (prev == LIST)
    key = (what == STRING) & in_object & ((prev == OBJECT) | (prev == 7))
    ok = np.zeros(n, bool)
    ok |= value & (prev == 0) & (level == 0)
    ok |= value & in_list & ((prev == LIST) | (prev == 7))
    ok |= key & (nxt == 8)
    ok |= value & in_object & (prev == 8)
    key_before = np.append(False, key[:-1])
    ok |= (what == 8) & in_object & key_before
    ok |= (what == 7) & (in_list | in_object) & closed & ~key_before
    ok |= ((what == 5) | (what == 6)) & ((after_open & (prev == what - 4)) | (closed & ~key_before))
    valid[text[~ok]] = False
