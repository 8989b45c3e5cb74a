"""How context mixing lays out its work: tokens by Arrow, counts of a document from depth to depth, Newton steps on packed rows."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tessera.llm import context_mixing as cm

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def test_tokens_are_parted_and_numbered(monkeypatch):
    texts = ["The cat", None, "", "  \n", " a\x0bB\x0cc\rd \x1ce\x85É x", "z" * 200, "\ta\t" * 50, "end "] * 3
    lexicon = cm.Lexicon.of([(b"the", 5), (b"a", 3), ("É".encode(), 2)], 7, 10)
    want = [WORD.findall((t or "").encode().translate(LOWER)) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(["skipped ", *texts], pa.string()).slice(1)], ["text"])
    for at_once, tokens in ((1, 1), (60, 7), (1 << 20, 1 << 20)):
        monkeypatch.setattr(cm, "TOKENS_AT_ONCE", tokens)
        got, places = [], []
        for whole in cm.words_of(batch, at_once):
            edges = np.append(0, np.cumsum(whole.sizes)).tolist()
            got += [whole.words.slice(i, j - i).to_pylist() for i, j in zip(edges, edges[1:])]
        for some in cm.groups(batch, lexicon):
            places += range(some.first, some.first + len(some.sizes))
            assert some.ids.tolist() == [lexicon.ids.get(w, cm.ESCAPE) for r in range(some.first, some.first + len(some.sizes)) for w in want[r]]
        assert got == want and places == [*range(len(texts))]
    assert [n.as_py() for n in cm.names_of(pa.array([b"a", b"z" * 64], pa.binary()))] == ["a", "z" * 64]
    long = [n.as_py() for n in cm.names_of(pa.array([b"a", b"z" * 65, b"y" * 65], pa.binary()))]
    assert long[0] == "a" and {len(x) for x in long[1:]} == {65} and all(x[0] == " " for x in long[1:]) and long[1] != long[2]


def test_what_a_span_has_shown_is_counted_plainly():
    r = np.random.default_rng(4)
    words = [(f"w{i}".encode(), 400 // (i + 1) + 2) for i in range(60)]
    lexicon = cm.Lexicon.of(words, 50, 30)
    pool = [w for w, _ in words] + [b"odd", b"oddly", b"w\xc3\xa9"]
    docs = [[pool[min(int(x), len(pool) - 1)] for x in r.zipf(1.3, r.integers(0, 300))] for _ in range(25)]
    s, _ = cm.symbols(lexicon, docs)
    for some in cm.packs(s.doc, 700):
        b = cm.bits_of(s, some, lexicon, 16)
        own = np.empty(len(b.bit))
        own[b.at] = b.own
        assert sorted(b.at.tolist()) == [*range(len(own))]
        seen, want = defaultdict(Counter), []
        for a, z in some:
            for i in range(a, z):
                code = format(int(s.code[i]), f"0{s.length[i]}b")
                for d, bit in enumerate(code):
                    n = seen[a, bool(s.byte[i]), int(s.own[i]), code[:d]]
                    want.append(math.log((n["1"] + 0.3) / (n["0"] + 0.3)))
                    n[bit] += 1
        assert np.allclose(own, want, atol=1e-5)


def test_a_newton_step_is_that_of_plain_sums():
    r = np.random.default_rng(5)
    n = 3000
    b = cm.Bits(r.integers(0, 2, n).astype(np.uint8), [], r.choice([0, 0.5, -1.25], n).astype(np.float32), r.choice([0, 4, 8, 12], n).astype(np.uint8), None, [])
    twelfths = [r.integers(-30, 30, n).astype(np.int8) * r.integers(0, 2, n).astype(np.int8) for _ in range(3)]
    w, curve = cm.start_weights(), np.tile(np.eye(cm.INPUTS) * 20.0, (cm.KINDS, 1, 1))
    plain_w, plain_curve = w.copy(), curve.copy()
    cm.step(w, curve, cm.inputs(b, twelfths))
    x = np.stack([*(t / 12 for t in twelfths), b.own, np.ones(n)])
    gate = b.kind + (x[1] != 0) + 2 * (x[2] != 0) + 16 * (x[3] != 0)
    for kind in range(cm.KINDS):
        q, y = x[:, gate == kind], b.bit[gate == kind]
        p = 1 / (1 + np.exp(-(plain_w[kind] @ q)))
        plain_curve[kind] += (q * (p * (1 - p))) @ q.T
        plain_w[kind] += np.linalg.solve(plain_curve[kind], q @ (y - p))
    assert np.allclose(curve, plain_curve, rtol=1e-4, atol=1e-4) and np.allclose(w, plain_w, atol=1e-4)
