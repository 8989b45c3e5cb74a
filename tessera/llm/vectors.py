"""What the two vector searches share: clean vectors by length, packed blocks, block scoring and exact top-k merging.

A block is one row that holds up to some thousands of vectors as two binary columns (ids and a row-major
matrix). Blocks keep shuffles to a few large rows, and a block pair is scored by one matrix product, whose
best candidates, with a margin for its rounding, are scored again by a sum in the order of the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tessera.llm.common import spread

#: An id that no candidate has: it fills up rows of the k best.
NONE = np.iinfo(np.int64).max


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def vector_column(rows: np.ndarray) -> pa.Array:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def clean(df: DataFrame, id_col: str, vec_col: str, allow_zero: bool) -> DataFrame:
    """(vec_id, vec) of the vectors that take part.

    Vectors that are null, empty or hold null or non-finite components take no part, nor zero vectors
    unless allow_zero; nor rows without an id. Other columns of df are not read.
    """
    v = F.col("vec")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    if not allow_zero:
        fine = fine & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return spread(rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine))


def lengths(rows: DataFrame) -> list[Row]:
    """(dim, n, norm) for each length of vector: how many there are and their largest norm, without overflow for huge components.

    Vectors of different lengths have no inner product, so a search treats each length by itself. What reaches the
    driver is a row for each length.
    """
    high = F.array_max(F.transform("vec", F.abs))
    norm = F.when(high > 0, high * F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x / high) * (x / high)))).otherwise(0.0)
    return rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(F.least(norm, F.lit(1e308))).alias("norm")).orderBy("dim").collect()


def sample_matrix(rows: DataFrame, most: int) -> np.ndarray:
    """A bounded sample for fitting: the `most` vectors of the smallest hash of their id. Never more than `most` rows reach the driver."""
    table = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("vec").toArrow()
    return matrix(table["vec"].combine_chunks())


def augmented(x: np.ndarray) -> np.ndarray:
    """Rows of norm 1 at most with one more component that makes it 1, so that a larger inner product is a smaller distance."""
    return np.hstack([x, np.sqrt(np.maximum(1.0 - np.einsum("ij,ij->i", x, x), 0.0))[:, None]])


def distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    d = np.einsum("ij,ij->i", x, x)[:, None] - 2.0 * (x @ to.T) + np.einsum("ij,ij->i", to, to)[None]
    return np.sqrt(np.maximum(d, 0.0))


def packed(keys: dict[str, object], ids: np.ndarray, vecs: np.ndarray) -> dict[str, object]:
    """One row with a block: ids as int64; the matrix in the narrowest of three types that holds it exactly, whose code comes first."""
    for kind in ("i2", "f4", "f8"):
        with np.errstate(invalid="ignore", over="ignore"):
            mat = vecs.astype(kind)
        if kind == "f8" or np.array_equal(mat, vecs):
            break
    return keys | {"n": len(ids), "ids": ids.astype(np.int64).tobytes(), "mat": kind.encode() + mat.tobytes()}


def unpacked(ids: bytes, mat: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(mat, mat[:2].decode(), offset=2).astype(np.float64).reshape(len(ids), -1)


def foremost(ids: np.ndarray, vecs: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among the k best of some query: of equal vectors, those of the k + 1 smallest ids.

    Equal vectors have equal scores, ties go to the smaller id, and a query leaves out at most one id, its own.
    """
    raw = np.ascontiguousarray(vecs + 0.0).view(np.dtype((np.void, vecs.shape[1] * vecs.itemsize))).reshape(-1)
    group = np.unique(raw, return_inverse=True)[1]
    order = np.lexsort((ids, group))
    group, sorted_ids = group[order], ids[order]
    new = np.append(True, (np.diff(group) != 0) | (np.diff(sorted_ids) != 0))  # a repeated row counts once
    order, group = order[new], group[new]
    nth = np.arange(len(group)) - np.searchsorted(group, group)
    return np.sort(order[nth <= k])


def products(q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the rows q[r] and x[c], summed component by component, so that equal vectors get equal scores in any block."""
    out = np.zeros(len(r))
    for a in range(0, len(r), 16384):
        some = slice(a, a + 16384)
        u, v = q[r[some]].T.copy(), x[c[some]].T.copy()
        for j in range(len(u)):
            out[some] += u[j] * v[j]
    return out


class Tops:
    """The k best ids of each query so far, ties to the smaller id; a task holds those of `most` queries and hands them on when there are more."""

    def __init__(self, k: int, most: int = 50_000):
        self.k, self.most, self.row = k, most, {}
        self.scores, self.ids = np.full((0, k), -np.inf), np.full((0, k), NONE)

    def rows(self, queries: np.ndarray) -> np.ndarray:
        """The places of queries, new ones included."""
        at = np.array([self.row.setdefault(q, len(self.row)) for q in queries.tolist()], np.int64)
        if len(self.row) > len(self.scores):
            more = max(1024, 2 * len(self.row)) - len(self.scores)
            self.scores = np.vstack([self.scores, np.full((more, self.k), -np.inf)])
            self.ids = np.vstack([self.ids, np.full((more, self.k), NONE)])
        return at

    def score(self, qi: np.ndarray, q: np.ndarray, xi: np.ndarray, x: np.ndarray, bound: np.ndarray | None = None) -> None:
        """Takes in a block x with ids xi in order, for the queries qi. bound: a score that each query's k-th best is known to reach."""
        if not len(qi) or not len(xi):
            return
        at = self.rows(qi)
        with np.errstate(invalid="ignore", over="ignore"):
            near = np.nan_to_num(q @ x.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            margin = 4e-16 * q.shape[1] * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        own = qi[:, None] == xi[None]
        near[own] = -np.inf
        starts = np.flatnonzero(np.append(True, np.diff(xi) != 0))
        least = self.scores[at, -1] if bound is None else np.maximum(self.scores[at, -1], bound)
        if len(starts) > self.k and (open_ := np.flatnonzero(least == -np.inf)).size:
            # The k-th best by distinct ids.
            some = near[open_] if len(starts) == len(xi) else np.maximum.reduceat(near[open_], starts, axis=1)
            least = least.copy()
            least[open_] = np.partition(some, some.shape[1] - self.k, axis=1)[:, -self.k]
        r, c = np.nonzero((near >= (least - np.nan_to_num(margin, posinf=np.inf))[:, None]) & ~own)
        if len(r):
            self.add(at, r, products(q, x, r, c), xi[c])

    def add(self, at: np.ndarray, r: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merges candidates; r (in order) are places in at."""
        scores = np.where(np.isnan(scores), -np.inf, scores)
        rows, first, count = np.unique(r, return_index=True, return_counts=True)
        nth = np.arange(len(r)) - np.repeat(first, count)
        s, i = np.full((len(rows), count.max()), -np.inf), np.full((len(rows), count.max()), NONE)
        s[np.repeat(np.arange(len(rows)), count), nth], i[np.repeat(np.arange(len(rows)), count), nth] = scores, ids
        into = at[rows]
        if len(np.unique(into)) < len(into):  # rows that repeat a query's id: one after the other
            for j in range(len(rows)):
                self.merge(into[j : j + 1], s[j : j + 1], i[j : j + 1])
        else:
            self.merge(into, s, i)

    def merge(self, into: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        s, i = np.hstack([self.scores[into], s]), np.hstack([self.ids[into], i])
        order = np.lexsort((-s, i), axis=1)
        s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        again = np.zeros(i.shape, bool)
        again[:, 1:] = i[:, 1:] == i[:, :-1]  # an id counts once, with its higher score
        s, i = np.where(again, -np.inf, s), np.where(again, NONE, i)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[into], self.ids[into] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def full(self) -> bool:
        return len(self.row) > self.most

    def flush(self) -> pa.RecordBatch:
        n = len(self.row)
        q = np.repeat(np.fromiter(self.row, np.int64, n), self.k)
        s, i = self.scores[:n].reshape(-1), self.ids[:n].reshape(-1)
        keep = i != NONE
        self.__init__(self.k, self.most)
        return pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(i[keep]), pa.array(s[keep])], ["query_id", "vec_id", "score"])


def score_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) for pairs of blocks (q_ids, q_mat, ids, mat): the k best of every query in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = Tops(k)
        for batch in batches:
            for q_ids, q_mat, ids, mat in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_mat", "ids", "mat")), strict=True):
                tops.score(*unpacked(q_ids, q_mat), *unpacked(ids, mat))
                if tops.full():
                    yield tops.flush()
        if tops.row:
            yield tops.flush()

    return pairs.select("q_ids", "q_mat", "ids", "mat").mapInArrow(run, "query_id long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, without repeats of a vec_id; a query has at most k rows from each task here."""
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
