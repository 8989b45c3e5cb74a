"""Exact top-k by largest inner product over integer vectors, with a pivot-distance index.

Every vector gets the key (nearest pivot, distance to it), in the space with one added component in which a
larger inner product is a smaller Euclidean distance. Rows sorted by that key and cut into blocks are annuli
around the pivots. Queries expand outwards: each reads the annuli in the order in which they could be reached,
|dist(q, p) - annulus|, some more of them in every round. Each round tightens the distance r of its k-th best, and by
the triangle inequality an annulus that lies more than r away holds no better row: a query stops there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, shuffle_partitions
from tessera.llm.vectors import Tops, augmented, clean, distances, foremost, lengths, matrix, packed, ranked, sample_matrix, unpacked

#: Bounds of what each task holds: PIVOTS pivots (one for 256 rows up to then), chosen among at most SAMPLE_ROWS vectors.
PIVOTS, SAMPLE_ROWS = 64, 4096
#: Room for rounding in a bound, in the space in which the largest norm is 1: bounds only ever let more through.
SLACK = 1e-6


def far_apart(x: np.ndarray, count: int) -> np.ndarray:
    """Pivots that lie far from each other: each next one is the row farthest from those taken."""
    if not len(x):
        return x
    chosen = [int(np.argmax(distances(x, x.mean(axis=0)[None])[:, 0]))]
    gap = distances(x, x[chosen])[:, 0]
    while len(chosen) < min(count, len(x)) and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int | None = None, block_rows: int = 512, stats: list[tuple[int, int]] | None = None) -> DataFrame:
    """The k rows with the largest inner product of floor(scale * x) vectors for each query row, itself left out.

    Returns query_id, rank (from 1), vec_id, score (long); ties go to the smaller vec_id. Exact while products stay
    below 2^53. Rows with vectors that are null, empty or not finite, and rows without an id, take no part; zero
    vectors do. Vectors of different lengths are searched apart, as they have no inner product. Repeated ids count as
    one candidate (the higher score) and as one query (the best of its rows). An empty table gives no rows; other
    columns aren't read. To stats each round adds (pairs of query block and annulus read, pairs there are).
    """
    rows = clean(vectors, id_col, vec_col, allow_zero=True)
    rows = rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double")))
    parts = [one_length(rows.where(F.size("vec") == size.dim), size.n, size.norm or 1.0, is_query, k, pivots, block_rows, stats) for size in lengths(rows)]
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if not parts else parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return (out if len(parts) < 2 else ranked(out.drop("rank"), k)).withColumn("score", F.col("score").cast("long"))


def one_length(rows: DataFrame, n: int, norm: float, is_query: Column, k: int, pivots: int | None, block_rows: int, stats: list[tuple[int, int]] | None) -> DataFrame:
    spark = rows.sparkSession
    centres = far_apart(augmented(sample_matrix(rows, SAMPLE_ROWS) / norm), pivots or int(min(PIVOTS, max(2, n // 256))))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(augmented(matrix(batch.column("vec")) / norm), centres)
            nearest = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(nearest.astype(np.int64)), pa.array(far[np.arange(len(far)), nearest]), batch.column("vec_id"), batch.column("vec"), batch.column("is_query")], ["pivot", "dist", "vec_id", "vec", "is_query"])

    def annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of one pivot each, by distance; of equal vectors (they share a key) those that can be found."""
        schema = pa.schema([("pivot", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int64()), ("ids", pa.binary()), ("mat", pa.binary())])
        for batch in batches:
            pivot, dist, ids, x = batch.column("pivot").to_numpy(), batch.column("dist").to_numpy(), batch.column("vec_id").to_numpy(), matrix(batch.column("vec"))
            out, begin = [], 0
            for end in np.flatnonzero(np.append(np.diff(pivot) != 0, True)) + 1:
                at = begin + foremost(ids[begin:end], x[begin:end], k)
                for a in range(0, len(at), block_rows):
                    some = at[a : a + block_rows]
                    by_id = some[np.argsort(ids[some], kind="stable")]
                    out.append(packed({"pivot": int(pivot[begin]), "lo": float(dist[some[0]]), "hi": float(dist[some[-1]])}, ids[by_id], x[by_id]))
                begin = end
            yield pa.RecordBatch.from_pylist(out, schema)

    def askers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries that lie near each other, with the interval of their distances to each pivot."""
        kinds = pa.schema([("q_ids", pa.binary()), ("q_mat", pa.binary()), ("queries", pa.list_(pa.int64())), ("lows", pa.list_(pa.float64())), ("highs", pa.list_(pa.float64()))])
        for batch in batches:
            ids, x = batch.column("vec_id").to_numpy(), matrix(batch.column("vec"))
            out = []
            for a in range(0, len(ids), block_rows):
                to = to_pivots(x[a : a + block_rows])
                row = packed({}, ids[a : a + block_rows], x[a : a + block_rows])
                out.append({"q_ids": row["ids"], "q_mat": row["mat"], "queries": ids[a : a + block_rows].tolist(), "lows": to.min(axis=0).tolist(), "highs": to.max(axis=0).tolist()})
            yield pa.RecordBatch.from_pylist(out, kinds)

    def to_pivots(q: np.ndarray) -> np.ndarray:
        return distances(np.hstack([q / norm, np.zeros((len(q), 1))]), centres)  # a query has no added component

    def reach(q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """How far from each query a row can lie that scores its k-th best or more."""
        return np.sqrt(np.maximum(np.einsum("ij,ij->i", q, q) / norm**2 + 1.0 - 2.0 * kth / norm**2, 0.0)) + SLACK

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = Tops(k)
        for batch in batches:
            for pivot, lo, hi, q_ids, q_mat, kth, ids, mat in zip(*(batch.column(c).to_pylist() for c in ("pivot", "lo", "hi", "q_ids", "q_mat", "kth", "ids", "mat")), strict=True):
                (qi, q), (xi, x) = unpacked(q_ids, q_mat), unpacked(ids, mat)
                known = {r["query_id"]: r["kth"] for r in kth or []}
                best = np.array([-np.inf if known.get(i) is None else known[i] for i in qi.tolist()])
                far = to_pivots(q)[:, pivot]
                near = np.maximum(lo - far, far - hi) <= reach(q, best)
                tops.score(qi[near], q[near], xi, x, best[near])
                if tops.full():
                    yield tops.flush()
        if tops.row:
            yield tops.flush()

    def radius(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The reach of the widest query of each block."""
        for batch in batches:
            out = []
            for q_ids, q_mat, kth in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_mat", "kth")), strict=True):
                qi, q = unpacked(q_ids, q_mat)
                known = {r["query_id"]: r["kth"] for r in kth or []}
                out.append(float(reach(q, np.array([-np.inf if known.get(i) is None else known[i] for i in qi.tolist()])).max()))
            yield pa.RecordBatch.from_arrays([batch.column("q_block"), pa.array(out, pa.float64())], ["q_block", "radius"])

    keyed = cut(rows.withColumn("is_query", F.coalesce(is_query, F.lit(False))).mapInArrow(key, "pivot long, dist double, vec_id long, vec array<double>, is_query boolean"))
    parts, order = shuffle_partitions(spark), ("pivot", "dist", "vec_id")
    blocks = cut(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(annuli, "pivot long, lo double, hi double, n long, ids binary, mat binary").withColumn("block", F.monotonically_increasing_id()))
    asked = cut(keyed.where("is_query").repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(askers, "q_ids binary, q_mat binary, queries array<long>, lows array<double>, highs array<double>").withColumn("q_block", F.monotonically_increasing_id()))
    # A row for each pair of blocks: the annuli of a query block by the least distance at which they begin.
    wanted = asked.select("q_block", F.posexplode(F.arrays_zip("lows", "highs")).alias("at", "span"))
    pairs = wanted.join(blocks.select("block", "pivot", "lo", "hi"), F.col("at") == F.col("pivot"))
    pairs = pairs.select("q_block", "block", F.greatest(F.lit(0.0), F.col("span.lows") - F.col("hi"), F.col("lo") - F.col("span.highs")).alias("bound"))
    nth = F.row_number().over(Window.partitionBy("q_block").orderBy("bound", "block"))
    # Rounds read 1, then 3, 12, 48 ... more annuli.
    agenda = cut(pairs.withColumn("round", F.floor(F.log(nth.cast("double")) / F.log(F.lit(4.0)) + 1e-9)))
    last, count = agenda.agg(F.max("round"), F.count("*")).first()
    members = asked.select("q_block", F.explode("queries").alias("query_id")).distinct()
    tops = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    state = asked.select("q_block", F.lit(None).cast("array<struct<query_id:long,kth:double>>").alias("kth"), F.lit(float("inf")).alias("radius"))
    for turn in range(-1 if last is None else int(last) + 1):
        todo = agenda.where(F.col("round") == turn).join(state, "q_block").where("bound <= radius").select("q_block", "block", "kth")
        if stats is not None:
            stats.append((todo.count(), count))
        full = todo.join(asked.select("q_block", "q_ids", "q_mat"), "q_block").join(blocks.select("block", "pivot", "lo", "hi", "ids", "mat"), "block")
        found = full.select("pivot", "lo", "hi", "q_ids", "q_mat", "kth", "ids", "mat").mapInArrow(compare, "query_id long, vec_id long, score double")
        tops = cut(ranked(tops.select("query_id", "vec_id", "score").unionByName(found), k))
        if turn < last:
            kth = tops.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth")).where("kth is not null")
            known = members.join(kth, "query_id").groupBy("q_block").agg(F.collect_list(F.struct("query_id", "kth")).alias("kth"))  # a block's queries at most
            held = cut(asked.select("q_block", "q_ids", "q_mat").join(known, "q_block", "left"))
            state = held.select("q_block", "kth").join(held.mapInArrow(radius, "q_block long, radius double"), "q_block")
    return tops
