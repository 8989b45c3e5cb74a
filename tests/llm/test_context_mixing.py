"""Context mixing against plain dictionaries, its codes, its base score and held-out figures."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import context_mixing as cm

D = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, "The cat\nsat\tthe É", 1), (1, "The cat\nsat\tthe É", 1), (None, "no id the", 2), (2, None, 3), (3, "", 4), (4, "  \n", 5), (5, "x" * 5000 + " the " + "x" * 5000, 6), (6, "the cat sat the cat sat", 7), (7, "k\x0bv\x0cw\rz \x1ca\x85", 8), (11, "été 漢字 the", 9), (15, "nobody knows the trouble", 10)]


def held(i, fold=0):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == fold


def base(rows):
    """rows: (doc_id, text). Plain unigram scores."""
    docs = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in rows]
    c = Counter(w for i, words in docs if i is not None and not held(i) for w in words)
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in docs]


def key(row):
    return tuple((x is not None, round(x, 6) if isinstance(x, float) else x) for x in row)


def same(got, want):
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in got], [x[5] for x in want], rtol=1e-9, atol=1e-9)


NAMES = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")


@pytest.mark.parametrize("size", [3, 1000])
def test_base_and_odd_tables(spark, size):
    df = spark.createDataFrame([(i, t, x, x) for i, t, x in ODD], "doc_id long, text string, row int, token int")
    found = cm.score(df, lexicon_size=size)
    same(found.select(*NAMES).collect(), base([r[:2] for r in ODD]))
    assert all(r.score < 0 for r in found.collect()) and found.where("bits_per_byte is null").count() == 2
    assert cm.score(df.where("false")).count() == 0
    alone = cm.score(df.where("doc_id is null")).collect()[0]  # nothing to learn from
    assert (alone.train_tokens, alone.base_score, alone.n_known, alone.n_tokens) == (0, 0.0, 0, 4) and alone.score < 0


def test_whole_table(spark):
    from tessera.llm import queries

    rows = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op11_mixing(spark, D).toPandas()
    same(found[list(NAMES)].itertuples(index=False), base(rows))
    out = found[found.held_out]
    assert out.score.sum() > out.base_score.sum()  # though words that no one has learned are spelled
    assert 0 < out.bits_per_byte.mean() < 2.5
    again = queries.op11_mixing(spark, D).toPandas()
    both = found.merge(again, on="doc_id")
    assert np.allclose(both.score_x, both.score_y, rtol=1e-6)


def lexicon():
    words = [(w.encode(), n) for w, n in [("the", 50), ("cat", 20), ("sat", 20), ("é", 5), ("mat", 2)]]
    return words, cm.Lexicon.of(words, 7, 10)


def test_codes_are_complete_and_numbered():
    for weights in ([3, 4], [4, 5, *(2 + i * i for i in range(300))], [1] * 257, [10**12, *range(1, 400)]):
        x = cm.Code.of(weights)
        assert sum(2.0 ** -int(v) for v in x.lengths) == 1.0 and x.lengths.max() <= 30
        codes = [format(int(c), f"0{int(k)}b") for c, k in zip(x.bits, x.lengths)]
        inner = {c[:d] for c in codes for d in range(len(c))}
        assert len(set(codes)) == len(weights) and not set(codes) & inner
        assert sorted((int(p, 2) if p else 0) + int(x.inner[len(p)]) for p in inner) == list(range(x.n_inner)) == list(range(len(inner)))
        counts = x.counts(np.array(weights, float)).reshape(-1, 2)
        for p in list(inner)[:40]:
            zero, one = (sum(w for w, c in zip(weights, codes) if c.startswith(p + b)) for b in "01")
            assert counts[(int(p, 2) if p else 0) + x.inner[len(p)]].tolist() == [zero, one]
    assert cm.code_lengths([1, 1, 2, 4, 8]).tolist() == [4, 4, 3, 2, 1]


def plain_bits(lex, words, docs, learn, weights, span=cm.SPAN):
    """Bits of each document by dictionaries of true contexts, one bit after the other. learn: indices of the documents to count."""

    def steps(doc):
        tokens = [*doc, None]
        past = ["", ""]
        for t in tokens:
            i = cm.END if t is None else lex.ids.get(t, cm.ESCAPE)
            code = format(int(lex.tokens.bits[i]), f"0{int(lex.tokens.lengths[i])}b")
            yield [(d, code[:d], int(b), False, ("L", code[:d]), ("M", past[1], code[:d]), ("H", *past, code[:d]), ("O", code[:d])) for d, b in enumerate(code)]
            if i == cm.ESCAPE:
                raw = t + b" "
                for j, x in enumerate(raw):
                    code = format(int(lex.bytes_.bits[x]), f"0{int(lex.bytes_.lengths[x])}b")
                    p = [raw[j - k] if j >= k else None for k in range(1, 6)]
                    yield [(d, code[:d], int(b), True, ("l", p[0], code[:d]), ("m", *p[:3], code[:d]), ("h", *p, code[:d]), ("o", raw[:j], code[:d])) for d, b in enumerate(code)]
            past = [past[1], t]

    counts = defaultdict(lambda: [0, 0])
    for i in learn:
        for symbol in steps(docs[i]):
            for _, _, b, _, *contexts in symbol:
                for c in contexts[:3]:
                    if c[0] != "L":
                        counts[c][b] += 1
    weight = [lex.others, *lex.counts[1:].tolist()]
    for i, n in enumerate(weight):
        code = format(int(lex.tokens.bits[i]), f"0{int(lex.tokens.lengths[i])}b")
        for d, b in enumerate(code):
            counts["L", code[:d]][int(b)] += n
    out = []
    for doc in docs:
        own, shift, need, bits = defaultdict(lambda: [0, 0]), np.zeros(5), 0.0, [x for symbol in steps(doc) for x in symbol]
        for a in range(0, len(bits), cm.STEP):
            turn = np.zeros(5)
            for depth, _, b, byte, *contexts in bits[a : a + cm.STEP]:
                x = [round(12 * math.log((counts[c][1] + 0.4) / (counts[c][0] + 0.4))) / 12 if c in counts else 0.0 for c in contexts[:3]]
                mine = own[contexts[3]]
                x += [math.log((mine[1] + 0.3) / (mine[0] + 0.3)), 1.0]
                mine[b] += 1
                gate = (3 if byte else 0 if depth < 4 else 1 if depth < 10 else 2) * 4 + (x[1] != 0) + 2 * (x[2] != 0) + 16 * (x[3] != 0)
                p = 1 / (1 + math.exp(-max(-12, min(12, float(np.dot(weights[gate] + shift, x))))))
                need -= math.log2(p if b else 1 - p)
                turn += (b - p) * np.array(x)
            shift = shift + 0.2 * turn / len(bits[a : a + cm.STEP])
        out.append(need)
    return out


def test_mix_against_plain_dictionaries(monkeypatch):
    monkeypatch.setattr(cm, "STEP", 50)
    words, lex = lexicon()
    r = np.random.default_rng(6)  # no two of its contexts share a slot
    pool = [w for w, _ in words] + [b"dog", b"dogs", "naïve".encode(), b"7"]
    docs = [[pool[i] for i in r.integers(0, len(pool), r.integers(0, 30))] for _ in range(12)]
    weights = r.normal(0.4, 0.2, (cm.KINDS, cm.INPUTS))
    tables = [np.zeros(2 * n, np.uint16) for n in (lex.n_low, 1 << 22, 1 << 22)]
    s, _ = cm.symbols(lex, docs[:8])
    for some in cm.packs(s.doc):
        for t, (slot, bit) in zip(tables, cm.bits_of(s, some, lex, 22, learn=True).slots):
            np.add.at(t, 2 * slot.astype(np.int64) + bit, 1)
    tokens = lex.tokens.counts(np.array([lex.others, *lex.counts[1:]], float))
    tables[0][: len(tokens)] = tokens
    model = cm.Model(lex, 22, [cm.stretched(t) for t in tables], weights)
    s, _ = cm.symbols(lex, docs)
    assert np.allclose(cm.bits_needed(model, s, len(docs)), plain_bits(lex, words, docs, range(8), weights), rtol=1e-4)


def test_spans_bound_the_work(monkeypatch):
    monkeypatch.setattr(cm, "SPAN", 100)
    _, lex = lexicon()
    docs = [[b"the"] * 350, [b"cat"] * 20, [b"z" * 500]]
    s, _ = cm.symbols(lex, docs)
    parts = cm.spans(s.doc)
    assert all(z - a <= 100 and len(set(s.doc[a:z])) == 1 for a, z in parts) and sum(z - a for a, z in parts) == len(s.doc) == 351 + 21 + 503
    assert [p for some in cm.packs(s.doc) for p in some] == parts


def test_weights_are_fitted_on_all_learning_documents(spark, monkeypatch):
    ids = [i for i in range(120) if not held(i) and zlib.crc32(str(i).encode()) % 100 != 1]  # none of a former fold
    fit, seen = cm.mixing_weights, []
    monkeypatch.setattr(cm, "mixing_weights", lambda docs, *more: seen.append((docs.count(), fit(docs, *more))) or seen[-1][1])
    assert cm.score(spark.createDataFrame([(i, f"the cat sat {i} the cat") for i in ids], "doc_id long, text string")).count() == len(ids)
    (n, weights), = seen
    assert n == len(ids) and np.isfinite(weights).all() and np.abs(weights - cm.start_weights()).max() > 0.05


def test_a_bit_is_taken_out_of_its_counts():
    counts = np.array([3, 5, 0, 1, 1, 0, 0, 0, 65535, 2], np.uint16)
    want = [max(-127, min(127, round(12 * math.log((n1 - (b and n1 > 0) + 0.4) / (n0 - (not b and n0 > 0) + 0.4))))) for n0, n1 in counts.reshape(-1, 2).tolist() for b in (0, 1)]
    assert cm.without_one(counts).tolist() == want and counts.tolist() == [3, 5, 0, 1, 1, 0, 0, 0, 65535, 2]
