import json
import random

import numpy as np

from baglight.functions.structure import LIST, OBJECT, structural_index

BASE = [b'{"a":[1,2,{"b":"x\\"y,[{"}],"c":null}', b"[]", b"{}", b" 1.5e3 ", b'"s"', b'[[],{},[1],""]', b'{"k":{"k":{"k":[true,false]}}}', b"-0", b"01", b'{"a":1,}', b'{"a"}', b"[1 2]", b"", b"  ", b'{"a":1}{"b":2}', b'"a\tb"', b"nul", b"[1}", b'["\\u12g4"]', '["é€"]'.encode(), b'{"a" "b":1}', b"[,1]", b'"\\\\\\""', b'{"a":"b":"c"}']


def valid(t):
    try:
        json.loads(t, parse_constant=lambda x: 1 / 0)
        return True
    except (ValueError, ZeroDivisionError):
        return False


def changed(t, rng):
    t = bytearray(t)
    for _ in range(rng.randint(1, 3)):
        if t:
            i, c, r = rng.randrange(len(t)), rng.choice(b'{}[],:"\\ 1.-ea'), rng.random()
            if r < 0.3:
                del t[i]
            elif r < 0.6:
                t.insert(i, c)
            elif r < 0.8:
                t[i] = c
            else:
                del t[i:]
    return bytes(t)


def test_index_agrees_with_a_parser_on_valid_and_broken_texts():
    rng = random.Random(0)
    texts = [t for t in BASE + [changed(rng.choice(BASE), rng) for _ in range(6000)] if t.decode("utf-8", "ignore").encode() == t]
    ix = structural_index(texts)
    assert [t for t, v in zip(texts, ix.valid, strict=True) if valid(t.decode()) != v] == []
    kids, root = [[] for _ in ix.text], {}
    for i, p in enumerate(ix.parent):
        if p < 0:
            root[ix.text[i]] = i
        else:
            kids[p].append(i)

    def value(i):
        if ix.kind[i] == OBJECT:
            return {json.loads(ix.raw[ix.key_first[j] : ix.key_last[j] + 1]): value(j) for j in kids[i]}
        if ix.kind[i] == LIST:
            assert [ix.place[j] for j in kids[i]] == list(range(len(kids[i])))
            return [value(j) for j in kids[i]]
        return json.loads(ix.bytes_of(i))

    for t in np.flatnonzero(ix.valid):
        assert json.dumps(value(root[t])) == json.dumps(json.loads(texts[t]))


def test_no_texts():
    assert len(structural_index([]).text) == 0
