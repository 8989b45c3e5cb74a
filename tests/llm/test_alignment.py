"""The alignment against plain encodings of whole texts, and the fragments' composition."""

import hashlib
import random
from collections import Counter
from functools import reduce

import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment
from tessera.llm.alignment import Fragment, compose, encoder, fragment, ranges

D = "/root/testdata/sf0.001"
ODD = ["", None, "a", " ", "  lead", "trail  ", "a\nb\n\n c \n", "\n", "x▁y", "▁", "<s>a</s> <0x41> <|endoftext|>", "a\x00b", "　  x  y", "tab\t x\t\ty\r\n z", "é̈́ 😀 ﬁ﻿", "it's 'll don't''s  !'s", "12345 67 8,900", "漢字かな混じり文 テスト", "a" * 700, "x  \n  \n  y", "\x1c\x1d a", "a b \u0085 c"]


@pytest.fixture(scope="module")
def tokenizers():
    return encoder(alignment.FOLDER)


@pytest.fixture(scope="module")
def byte_level():
    """The library's own reading of the first file."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.BYTE_LEVEL}")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def tokens(e, text):
    """Plainly: ids and ends of both encodings of a whole text; nothing where one doesn't give it back."""
    if not text:
        return [], [], [], []
    a, b = e.a(" " + text), e.b.encode(text)
    x, y = [e.a_bytes[i] for i in a], [e.b_bytes[i] for i in b]
    if b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
        return [], [], [], []
    return a, [sum(map(len, x[: i + 1])) for i in range(len(x))], b, [sum(map(len, y[: i + 1])) for i in range(len(y))]


def plain(e, texts):
    rows, counts = [], Counter()
    for text in texts:
        a, x, b, y = tokens(e, text)
        links = [(i, j) for i, p in zip(a, x) for j, q in zip(b, y) if p == q] if len(x) < 100 else [(a[x.index(p)], b[y.index(p)]) for p in set(x) & set(y)]
        groups, i, j = [], 0, 0
        for p in sorted(set(x) & set(y)):
            m, n = x.index(p) + 1, y.index(p) + 1
            groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
            i, j = m, n
        rows.append((len(a), len(b), groups, links))
        counts.update(links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(n_a, n_b, len(g), len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for n_a, n_b, g, k in rows]


def fuzzed(n, seed):
    r = random.Random(seed)
    alphabet = [" ", " ", " ", "\n", "\t", "the", "and", "er", "x", "7", "'s", "!", "é", "漢", " ", "　", "▁", "😀", "\r", "ly"]
    return ["".join(r.choice(alphabet if r.random() < 0.5 else alphabet[:12]) for _ in range(r.randrange(60))) for _ in range(n)]


def test_units_are_encoded_as_in_the_text(tokenizers, byte_level, spark):
    corpus = [t for (t,) in spark.read.parquet(f"{D}/documents.parquet").select("text").limit(60).collect() if t]
    for text in [*ODD, *fuzzed(500, 1), *corpus]:
        if text:
            assert tokenizers.a(" " + text) == byte_level(" " + text)
            units = tokenizers.units(" " + text)
            assert "".join(units) == " " + text
            found = [*tokenizers.encode(units)]
            whole = all(u[4] for u in found)
            if whole:
                assert [i for u in found for i in u[0]] == byte_level(" " + text)
                assert [i for u in found for i in u[2]] == tokenizers.b.encode(text)
            assert whole == bool(tokens(tokenizers, text)[0])


def test_units_at_once_and_one_by_one(tokenizers, spark):
    corpus = [t for (t,) in spark.read.parquet(f"{D}/documents.parquet").select("text").limit(60).collect() if t]
    units = [*{u for t in [*ODD, *fuzzed(300, 9), *corpus] if t for u in tokenizers.units(" " + t)}]
    plainly = [alignment.closed(*x[:4]) if x[4] else None for x in tokenizers.encode(units)]
    assert tokenizers.close(units) == plainly and None in plainly
    assert tokenizers.close_all([u for u, x in zip(units, plainly) if x and not u[-1].isspace()]) is not None


def test_kept_units_change_nothing(tokenizers, monkeypatch):
    texts = [[*dict.fromkeys(tokenizers.units(" " + t))] for t in fuzzed(60, 7)]
    want = [tokenizers.learn(us) for us in texts]
    monkeypatch.setattr(alignment, "KEPT", 20)
    monkeypatch.setattr(alignment, "LONG", 5)
    assert [tokenizers.learn(us) for us in texts] == want and len(tokenizers.kept) < 100


def test_fragments_compose_in_any_order(tokenizers):
    r = random.Random(2)
    for text in fuzzed(60, 3):
        a, x, b, y = tokens(tokenizers, text)
        if not a:
            continue
        whole = fragment(a, x, b, y)
        marks = sorted({0, x[-1], *(r.randrange(x[-1] + 1) for _ in range(5))})
        cuts = [fragment([i for i, p in zip(a, x) if low < p <= high], [p for p in x if low < p <= high], [i for i, p in zip(b, y) if low < p <= high], [p for p in y if low < p <= high]) for low, high in zip(marks, marks[1:])]
        left = reduce(compose, cuts)
        right = reduce(lambda p, q: compose(q, p), cuts[::-1])
        assert left == right == compose(Fragment(), whole) == compose(whole, Fragment()) == whole
        assert any(f.prefix[0] for f in cuts)


def test_ranges_cover_tokens_once(tokenizers):
    for text in [t for t in [*ODD, *fuzzed(80, 4)] if t and tokens(tokenizers, t)[0]]:
        for size in (8, 32, 100):
            parts = [tokenizers.range(part, start, low, high) for _, part, start, low, high in ranges(text, size)]
            assert reduce(compose, parts) == fragment(*tokens(tokenizers, text))
    text = "word " * 500
    assert len(list(ranges(text, 64))) == 40 and len(list(ranges("x" * 5000, 64))) == 1


@pytest.mark.parametrize("size", [40, 65_536])
def test_rows_against_plain_encodings(spark, tokenizers, size, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 3)
    texts = [*ODD, *fuzzed(40, 5), "the quick er " * 200, "the quick er " * 200] + [t[:3000] for (t,) in spark.read.parquet(f"{D}/documents.parquet").select("text").limit(30).collect() if t]
    docs = spark.createDataFrame([(i if i % 7 else None, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, row int, pair int, key int")
    got = sorted(tuple(x[1:]) for x in alignment.align(docs, size=size).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    assert got == sorted(plain(tokenizers, texts))
    assert alignment.align(docs.where("false"), size=size).count() == 0


def test_rare_pairs_are_shuffled(spark, monkeypatch):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(50)
    want = sorted(map(tuple, alignment.align(docs).collect()))
    monkeypatch.setattr(alignment, "ROWS_AT_MOST", 20)
    assert sorted(map(tuple, alignment.align(docs).collect())) == want


def test_whole_table(spark):
    from tessera.llm import queries

    found = queries.op13_align(spark, D)
    assert found.count() == spark.read.parquet(f"{D}/documents.parquet").count()
    assert found.where("n_groups > 0 and (count_sum < n_links or n_best > n_links or length(groups_sha256) <> 64)").count() == 0
    assert found.where("n_best > 0").count() > 0 and found.agg(F.max("n_groups")).first()[0] > 100
