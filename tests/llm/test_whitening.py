"""Whitening against a plain eigendecomposition, and its odd tables."""

import numpy as np
import pytest

from tessera.llm import whitening

D = "/root/testdata/sf0.001"


def plain(x, k):
    """x: integers as Python numbers. Sums, eigenvalues, whitened rows and deviations, all plainly."""
    n, s = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * v - t) / n for v, t in zip(r, s)] for r in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return e, centred @ u / np.sqrt(e), [sum((n * v - t) ** 2 for v, t in zip(r, s)) for r in x], np.trace(centred.T @ centred / n)


def integers(vectors):
    return [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]


def hold(rows, vectors, k):
    e, w, deviation, trace = plain(integers(vectors.values()), k)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(vectors) * len(e)
    assert {r.n for r in rows} == {len(vectors)} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    for j in range(len(e)):
        sign = None
        for i, v in enumerate(vectors):
            r = got[v, j + 1]
            sign = sign or np.sign(r.whitened * w[i, j])
            assert abs(r.whitened - sign * w[i, j]) < 1e-7 and abs(r.explained - e[j] / trace) < 1e-10 and r.deviation == deviation[i]


def test_against_eigh(spark):
    r = np.random.default_rng(1)
    vectors = {i: v for i, v in enumerate((r.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.2]).tolist())}
    rows = [(i, v, 1, 2) for i, v in vectors.items()] + [(900, None, 1, 2), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, 2), (902, [float("inf")] * 6, 1, 2), (903, [float("nan")] * 6, 1, 2), (904, [], 1, 2), (905, [1e300] * 6, 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, dim int")
    hold(whitening.whiten(df, k=4).collect(), vectors, 4)
    hold(whitening.whiten(df, k=32).collect(), vectors, 32)
    assert whitening.whiten(df.where("vec_id >= 900")).count() == whitening.whiten(df.where("false")).count() == 0


def test_lengths_repeats_and_no_variance(spark):
    r = np.random.default_rng(2)
    three, two = {i: v for i, v in enumerate(r.normal(size=(50, 3)).tolist())}, {100 + i: v for i, v in enumerate(r.normal(size=(40, 2)).tolist())}
    flat = [(200, [1.0, 2.0, 3.0, 4.0]), (200, [1.0, 2.0, 3.0, 4.0]), (None, [1.0, 2.0, 3.0, 5.0])]
    found = whitening.whiten(spark.createDataFrame([*three.items(), *two.items(), *flat, (300, [7.0])], "vec_id long, embedding array<double>")).collect()
    hold([x for x in found if x.vec_id is not None and x.vec_id < 100], three, 32)
    hold([x for x in found if x.vec_id is not None and 100 <= x.vec_id < 200], two, 32)
    rest = [x for x in found if x.vec_id is None or x.vec_id == 200]
    assert len(rest) == 12 and {x.n for x in rest} == {3} and {x.whitened is None for x in rest if x.component > 1} == {True}
    assert sorted(x.deviation for x in rest if x.component == 1) == [64**2, 64**2, 128**2]
    lone = [x for x in found if x.vec_id == 300]
    assert [(x.component, x.n, x.deviation, x.whitened, x.explained, x.identity_error) for x in lone] == [(1, 1, 0, None, None, None)]


def test_whole_table(spark):
    from tessera.llm import queries

    vectors = {i: v for i, v in spark.read.parquet(f"{D}/embeddings.parquet").select("vec_id", "embedding").collect()}
    hold(queries.op12_whiten(spark, D).collect(), vectors, 32)


@pytest.mark.parametrize("kind", ["plain", "repeated", "low rank", "steep", "isotropic", "far"])
def test_contours_find_all(kind):
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 48))
    x = {"plain": x, "repeated": x * np.repeat([3.0, 1.0], [20, 28]), "low rank": x[:10], "steep": x * np.logspace(0, -5, 48), "isotropic": np.linalg.qr(x)[0], "far": x * 1e6}[kind]
    v = x.T @ x
    e, u = whitening.components(v, 32)
    want = np.linalg.eigvalsh(v)[::-1][:32]
    assert np.abs(e - want).max() <= 1e-13 * want[0] and np.abs(u.T @ u - np.eye(32)).max() < 1e-12 and np.abs(v @ u - u * e).max() <= 1e-12 * want[0]
    for shift in (want[3] * 1.01, want[7] * 0.99, want[0] * 2):
        assert whitening.inertia(v - shift * np.eye(48)) == (np.linalg.eigvalsh(v) > shift).sum()
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1 and whitening.inertia(np.zeros((3, 3))) == 0
