"""Whitening of embeddings by their principal components, found by contour integration (FEAST) on the covariance.

Spark makes four passes over the vectors: exact sums, centred products, the products of the whitened rows and the rows
themselves. What a task hands on is a matrix for each length of vector, and those are added in two steps. Inertia
counts cut the spectrum into intervals of few eigenvalues; for each, complex shifted solves on a circle around it
project a start basis onto its eigenvectors, and Rayleigh-Ritz extracts them. At the end inertia counts around every
eigenvalue show that none is missed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, small, spread

#: Vectors in a block, and eigenvalues that an interval holds at most if they differ.
BLOCK, SLICE = 4096, 12
#: Entries beyond this have no exact integer; their vectors take no part, as if they were not finite.
LARGEST = 2.0**53


def inertia(a: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix: the signs of its pivots, single or in pairs (Bunch-Parlett)."""
    a, positive = np.array(a), 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        i = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diagonal(a)))
        p, q = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[i] >= 0.6404 * off[p, q]:
            if diagonal[i] == 0.0:
                return positive
            positive += a[i, i] > 0
            taken = [i]
        else:
            positive += 1
            taken = [p, q]
        left = np.setdiff1d(np.arange(len(a)), taken)
        side = a[np.ix_(left, taken)]
        a = a[np.ix_(left, left)] - side @ np.linalg.solve(a[np.ix_(taken, taken)], side.T)
        a = (a + a.T) / 2
    return int(positive)


def intervals(v: np.ndarray, k: int, bound: float) -> list[tuple[float, float, int]]:
    """(low, high, number of eigenvalues between) from the top down until they hold k of them."""
    eye = np.eye(len(v))

    def above(x: float) -> int:
        return inertia(v - x * eye)

    low, high, n = -bound * 1e-3, bound, len(v)  # all of them lie above low
    while n > k + SLICE and high - low > 1e-9 * bound:
        middle = (low + high) / 2
        if (m := above(middle)) >= k:
            low, n = middle, m
        else:
            high = middle
    found, left = [], [(low, bound, n)]  # n: in the interval, of which bound is above all
    while left:
        low, high, n = left.pop()
        if n == 0:
            continue
        if n <= SLICE or high - low <= 1e-9 * bound:
            found.append((low, high, n))
            continue
        middle = (low + high) / 2
        upper = above(middle) - sum(m for *_, m in found) - sum(m for a, _, m in left if a >= high)
        left += [(low, middle, n - upper), (middle, high, upper)]
    return found


def contour(v: np.ndarray, low: float, high: float, n: int, nodes: int = 8) -> np.ndarray:
    """Orthonormal columns that span the eigenvectors of the n eigenvalues in (low, high): FEAST with half a circle of Gauss-Legendre nodes."""
    d = len(v)
    size, norm = min(d, n + 8), np.abs(v).sum(axis=1).max()
    x, weights = np.polynomial.legendre.leggauss(nodes)
    turn = np.exp(1j * math.pi / 2 * (x + 1.0))
    middle, radius = (low + high) / 2, max((high - low) / 2, 1e-9 * norm)
    while True:
        basis = np.random.default_rng(7).standard_normal((d, size))
        shifted = [np.linalg.inv((middle + radius * t) * np.eye(d) - v) for t in turn]
        for _ in range(12):
            q = sum(w / 2 * np.real(radius * t * (s @ basis)) for w, t, s in zip(weights, turn, shifted, strict=True))
            q = np.linalg.qr(q)[0]
            values, mix = np.linalg.eigh(q.T @ v @ q)
            basis = q @ mix
            within = basis[:, np.argsort(np.maximum(low - values, values - high), kind="stable")[:n]]
            if np.abs(v @ within - within @ (within.T @ v @ within)).max() <= 1e-14 * d * norm:
                return within
        if size == d:
            return within
        size = min(d, 2 * size)


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns."""
    bound = float(np.abs(v).sum(axis=1).max()) * 1.001
    if bound == 0.0:
        return np.zeros(k), np.eye(len(v))[:, :k]
    basis = np.hstack([contour(v, *x) for x in intervals(v, k, bound)])
    q = np.linalg.qr(basis)[0]
    values, mix = np.linalg.eigh(q.T @ v @ q)
    values, vectors = values[::-1][:k], (q @ mix)[:, ::-1][:, :k]
    for i, e in enumerate(values):  # no eigenvalue missed: i or fewer above each, more than i with it
        if inertia(v - (e + 1e-10 * bound) * np.eye(len(v))) > i or inertia(v - (e - 1e-10 * bound) * np.eye(len(v))) <= i:
            raise ArithmeticError(f"eigenvalue {i + 1} is missed")
    return values, vectors


def blocks(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(dim, ids, x): up to 4,096 vectors of one length as long integers floor(64 c) + 1,000,000."""
    v = F.col("vec")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * 64 < LARGEST))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where(v.isNotNull() & (F.size(v) > 0) & fine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["vec"].value_lengths().to_numpy()
            for d in np.unique(dims).tolist():
                same = batch.filter(pa.array(dims == d))
                step = max(1, min(BLOCK, 4_000_000 // d))
                for at in range(0, same.num_rows, step):
                    some = same.slice(at, step)
                    x = np.floor(64.0 * some["vec"].flatten().to_numpy(zero_copy_only=False)).astype(np.int64) + 1_000_000
                    yield pa.RecordBatch.from_pylist([{"dim": d, "ids": some["vec_id"].to_pylist(), "x": x.tobytes()}], pa.schema([("dim", pa.int32()), ("ids", pa.list_(pa.int64())), ("x", pa.binary())]))

    return spread(rows).mapInArrow(run, "dim int, ids array<long>, x binary")


def read(x: bytes, d: int) -> np.ndarray:
    return np.frombuffer(x, np.int64).reshape(-1, d)


def added(parts: DataFrame) -> DataFrame:
    """One (dim, total) for each dim: matrices added in some tens of tasks first, then all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sums(((d, np.frombuffer(m)) for b in batches for d, m in zip(b["dim"].to_pylist(), b["part"].to_pylist(), strict=True)))

    few = max(1, math.isqrt(parts.rdd.getNumPartitions()))
    return parts.repartition(few).mapInArrow(run, "dim int, part binary").groupBy("dim").applyInPandas(lambda p: pd.DataFrame({"dim": p["dim"][:1], "total": [sum(map(np.frombuffer, p["part"])).tobytes()]}), "dim int, total binary")


def sums(parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """What one task hands on: a sum of flat arrays for each dim."""
    total: dict[int, np.ndarray] = {}
    for d, m in parts:
        total[d] = total[d] + m if d in total else m
    for d, m in total.items():
        yield pa.RecordBatch.from_pydict({"dim": pa.array([d], pa.int32()), "part": pa.array([m.tobytes()], pa.binary())})


def by_block(rows: DataFrame, f: Callable[[dict], np.ndarray]) -> DataFrame:
    """(dim, part): the sum over a task's blocks of f(row), a flat array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sums((r["dim"], f(r)) for b in batches for r in b.to_pylist())

    return rows.mapInArrow(run, "dim int, part binary")


def moments(rows: DataFrame) -> DataFrame:
    """(dim, n, sums): exact sums of each component; halves of the numbers are added apart, so nothing overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        s: dict[int, list[int]] = {}
        for b in batches:
            for r in b.to_pylist():
                d, x = r["dim"], read(r["x"], r["dim"])
                one = [(h << 26) + low for h, low in zip((x >> 26).sum(axis=0).tolist(), (x & (2**26 - 1)).sum(axis=0).tolist(), strict=True)]
                n[d], s[d] = n.get(d, 0) + len(x), [u + w for u, w in zip(s.get(d, [0] * d), one, strict=True)]
        for d in n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array([d] * d, pa.int32()), "place": pa.array(range(d), pa.int32()), "n": pa.array([n[d]] * d), "s": pa.array(s[d], pa.decimal128(38, 0))})

    each = rows.mapInArrow(run, "dim int, place int, n long, s decimal(38,0)").groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    return each.groupBy("dim").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", "s"))), lambda x: x["s"]).alias("sums"))


def centre(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """x less the floor of the mean, as integers, and the rest of the mean: remainder and n."""
    s, n = [int(v) for v in r["sums"]], r["n"]
    floor = np.array([v // n for v in s], np.int64)
    rest = np.array([v % n for v in s], np.int64)
    return read(r["x"], r["dim"]) - floor, rest, rest / n, n


def products(r: dict) -> np.ndarray:
    x, _, rest, _ = centre(r)
    x = x - rest
    return (x.T @ x).ravel()


def project(r: dict) -> np.ndarray:
    """Whitened rows; components without variance are NaN."""
    x, _, rest, _ = centre(r)
    e = np.array(r["eigenvalues"])
    with np.errstate(divide="ignore", invalid="ignore"):
        return (x - rest) @ np.array(r["vectors"]).reshape(r["dim"], -1) / np.where(e > 0, np.sqrt(np.maximum(e, 0)), np.nan)


def whitened_products(r: dict) -> np.ndarray:
    w = project(r)
    return np.vstack([w.sum(axis=0), w.T @ w]).ravel()


def deviations(r: dict) -> list[int | None]:
    """Sum over the components of (n x - sum)^2, exactly; null where it needs more than 63 bits."""
    x, rest, _, n = centre(r)
    most = n * int(np.abs(x).max(initial=0)) + n
    if most * most * r["dim"] < 2**63:
        u = n * x - rest
        return (u * u).sum(axis=1).tolist()
    u = n * x.astype(object) - rest.astype(object)
    return [v if v < 2**63 else None for v in (u * u).sum(axis=1)]


def fit(rows: DataFrame, k: int) -> DataFrame:
    """(dim, n, sums, eigenvalues, vectors, explained, identity_error), one row for each length of vector, kept in the shared folder.

    It is kept, as a task that runs again must meet the same signs. An eigenvalue below what rounding leaves of zero is 0.
    """
    means = cut(moments(rows))
    total = added(by_block(rows.join(small(means, "sums"), "dim"), products))

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        d, n = int(p["dim"].iloc[0]), int(p["n"].iloc[0])
        v = np.frombuffer(p["total"].iloc[0]).reshape(d, d) / n
        e, vectors = components((v + v.T) / 2, min(k, d))
        trace = float(np.trace(v))
        e = np.where(e > 2e-12 * max(e.max(), 0.0), e, 0.0)
        return pd.DataFrame({"dim": [d], "eigenvalues": [e.tolist()], "vectors": [vectors.ravel().tolist()], "explained": [(e / trace if trace > 0 else np.full(len(e), np.nan)).tolist()]})

    solved = total.join(means.select("dim", "n"), "dim").groupBy("dim").applyInPandas(solve, "dim int, eigenvalues array<double>, vectors array<double>, explained array<double>")
    found = cut(means.join(solved, "dim"))

    def error(p: pd.DataFrame) -> pd.DataFrame:
        n, e = int(p["n"].iloc[0]), np.array(p["eigenvalues"].iloc[0])
        w = np.frombuffer(p["total"].iloc[0]).reshape(-1, len(e)) / n
        some = e > 0
        off = np.abs(w[1:] - np.outer(w[0], w[0]) - np.eye(len(e)))[np.ix_(some, some)]
        return pd.DataFrame({"dim": p["dim"][:1], "identity_error": [float(off.max()) if some.any() else None]})

    errors = added(by_block(rows.join(small(found, "vectors"), "dim"), whitened_products)).join(found.select("dim", "n", "eigenvalues"), "dim").groupBy("dim").applyInPandas(error, "dim int, identity_error double")
    return cut(found.join(errors, "dim"))


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): min(k, length) rows for each row of df that takes part.

    Rows whose vector is null or holds null, non-finite or (floor(64 c) without exact integer) huge entries take no part;
    an empty vector has no component. Repeated rows and rows without id count like any. Vectors of different lengths are
    fitted apart. A component without variance has a null whitened and an explained of 0, null if no component has any;
    identity_error looks at components with variance. A deviation of more than 63 bits is null. No rows give none.
    Other columns of df are not read.
    """
    rows = blocks(df, id_col, vec_col)
    found = fit(rows, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                w, m = project(r), len(r["ids"])
                c = w.shape[1]
                each = lambda values: pa.array([v for v in values for _ in range(c)], pa.int64())
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": each(r["ids"]),
                        "component": pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)),
                        "n": pa.array(np.full(m * c, r["n"])),
                        "deviation": each(deviations(r)),
                        "whitened": pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                        "explained": pa.array(np.tile(np.array(r["explained"], float), m), mask=np.tile(np.isnan(np.array(r["explained"], float)), m)),
                        "identity_error": pa.array([r["identity_error"]] * (m * c), pa.float64()),
                    }
                )

    return rows.join(small(found, "vectors"), "dim").mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
