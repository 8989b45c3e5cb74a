"""The near-copy stage against the similarity of all pairs, and on rows that share an id."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import copies

D = "/root/testdata/sf0.01"


def sets_of(texts):
    words = [(t or "").lower().split() for t in texts]
    return [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for w in words]


def groups_of(texts):
    """The smallest place that links of 0.8 or more reach from each text."""
    sets, part = sets_of(texts), list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small >= 0.8 * large and part[a] != part[b] and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                low, high = sorted((part[a], part[b]))
                part = [low if p == high else p for p in part]
    return part


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_copies_are_similar(spark, monkeypatch):
    monkeypatch.setattr(copies, "BLOCK_ROWS", 16)  # the planted group is many blocks
    rng = np.random.default_rng(5)
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect())
    base = rows[3][1].split()
    for i in range(100):
        words = list(base)
        for at in rng.integers(0, len(words), rng.integers(1, 4)):
            words[at] = f"w{rng.integers(10**6)}"
        rows.append((10**6 + i, " ".join(words)))
    want = groups_of([t for _, t in rows])
    kept = corpus_pipeline.keep_one_copy(spark, docs_of(spark, rows), D)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(rows[p][0] for p in set(want))


@pytest.mark.parametrize("same", [True, False])
def test_alike_against_all_pairs(same):
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.choice(14, rng.integers(1, 12))).astype(np.uint64) for _ in range(60)] for _ in "ab")
    b = a if same else b

    def connected(edges):
        part = list(range(120))
        for i, j in edges:
            i, j = part[i], part[j if same else 60 + j]
            part = [min(i, j) if p in (i, j) else p for p in part]
        return part

    all_pairs = [(i, j) for i in range(60) for j in range(60) if len(np.intersect1d(a[i], b[j])) >= 0.8 * len(np.union1d(a[i], b[j]))]
    assert connected(copies.alike(a, b, same, 0.8)) == connected(all_pairs)


def test_texts_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (7, a + " more"), (5, a), (9, b), (3, c), (5, c), (None, a), (None, a)]
    rows += [(8, f"text {i} of one id") for i in range(40)]
    kept = corpus_pipeline.keep_one_copy(spark, docs_of(spark, rows), D).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(5, a), (5, b), (3, c), (None, a), (None, a), *rows[9:]])
