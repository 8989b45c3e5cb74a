"""Approximate nearest neighbours by balanced posting lists.

Centroids come from balanced two-way splits of a bounded sample, and get offsets that even out how many vectors each
list takes. Every vector goes to the list of its nearest centroid and, if it lies near a boundary, to a few more.
Lists for a vector or a query are found by best-first search in a neighbour graph over the centroids, which each task
holds in memory; a query then reads the lists whose distance is within a ratio of the nearest one's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, shuffle_partitions
from tessera.llm.vectors import augmented, clean, distances, foremost, lengths, matrix, packed, ranked, sample_matrix, score_pairs, vector_column

#: Bounds of what every task holds and of what it is fitted on: lists grow with the root of the table up to MAX_LISTS
#: (67 million vectors), from where on lists grow longer, in blocks; the sample holds SAMPLE_ROWS vectors at most.
MAX_LISTS, SAMPLE_ROWS = 8192, 131_072
#: Vectors for each task that scores pairs of blocks: a query has k rows from each of these tasks, so they are no more than the work needs.
SCORED_AT_ONCE = 65_536
NO_KEY = np.uint64(2**64 - 1)


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of cells of equal size, neighbours in the order of the splits: each cell is split in two at the median along the line between its two means."""
    cells = [np.arange(len(x))]
    while len(cells) < lists and min(map(len, cells)) > 1:
        halves = []
        for cell in cells:
            rows = x[cell]
            line = rows[0] - rows.mean(axis=0)
            for _ in range(4):
                along = rows @ line
                upper = along > np.median(along)
                if not upper.any() or upper.all():
                    break
                line = rows[upper].mean(axis=0) - rows[~upper].mean(axis=0)
            order = np.argsort(rows @ line, kind="stable")
            halves += [cell[order[: len(cell) // 2]], cell[order[len(cell) // 2 :]]]
        cells = halves
    means = np.stack([x[c].mean(axis=0) for c in cells])
    _, first = np.unique(means, axis=0, return_index=True)
    return means[np.sort(first)]


def balanced_lists(x: np.ndarray, centroids: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Centroids, moved to the means of their lists, and what to add to squared distances so that nearest lists take about equally many rows of x.

    A crowded list seems farther by a step that shrinks from round to round; centroids move in the first half of them.
    """
    n = len(centroids)
    offset, step = np.zeros(n), 0.0
    for turn in range(rounds):
        sums, count, gaps = np.zeros(centroids.shape), np.zeros(n), []
        for a in range(0, len(x), 4096):
            d = distances(x[a : a + 4096], centroids) ** 2 + offset
            own = d.argmin(axis=1)
            count += np.bincount(own, minlength=n)
            np.add.at(sums, own, x[a : a + 4096])
            if not turn and n > 1:
                two = np.partition(d, 1, axis=1)
                gaps.append(two[:, 1] - two[:, 0])
        step = float(np.mean(np.concatenate(gaps))) if gaps else step
        offset += 2 * step * (1.0 - turn / rounds) * np.clip(np.log((count + 0.5) / (len(x) / n + 0.5)), -1.0, 1.0)
        if 2 * turn < rounds:
            centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids, offset - offset.mean()


class CentroidGraph:
    """Neighbour graph over centroids, with edges that a shorter two-step path makes needless left out."""

    def __init__(self, centroids: np.ndarray, offset: np.ndarray | None = None, degree: int = 16):
        n = len(centroids)
        self.at, self.offset = centroids.astype(np.float32), np.zeros(n) if offset is None else offset
        self.square = np.einsum("ij,ij->i", self.at, self.at)
        sets: list[set[int]] = [set() for _ in range(n)]
        for a in range(0, n, 1024):
            rows = distances(centroids[a : a + 1024], centroids)
            for i, row in enumerate(rows, a):
                near = np.argpartition(row, min(n - 1, 3 * degree))[: 3 * degree + 1]
                near = near[np.argsort(row[near], kind="stable")]
                between = distances(centroids[near], centroids[near])
                kept: list[int] = []
                for p, j in enumerate(near):
                    if j != i and len(kept) < degree and (between[p, kept] > 0.8 * row[j]).all():
                        kept.append(p)
                for j in near[kept].tolist():
                    sets[i].add(j)
                    sets[j].add(i)
        for i in range(1, n):  # a chain, so that every centroid can be reached
            sets[i].add(i - 1)
            sets[i - 1].add(i)
        widest = max(map(len, sets), default=0)
        self.links = np.array([sorted(s) + [i] * (widest - len(s)) for i, s in enumerate(sets)], dtype=np.int64).reshape(n, -1)
        self.entries = np.arange(0, n, max(1, int(n**0.5)))  # spread over the tree of splits

    def keys(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distance (as the bits of a float32, which order like it), id, and a last bit that says the id isn't opened yet."""
        d = np.einsum("ij,ij->i", x, x)[:, None] + self.square[ids] - 2.0 * np.einsum("ijk,ik->ij", self.at[ids], x)
        return np.maximum(d, np.float32(0)).astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | (ids.astype(np.uint64) << np.uint64(1)) | np.uint64(1)

    def walk(self, x: np.ndarray, width: int, ratio: float, least: int, opens: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x up to `width` near centroids, nearest first (-1 fills up), and their distances.

        A row goes on from its nearest unopened centroids, `opens` at a time, and beyond the `least` nearest only from
        those within the ratio of its nearest distance.
        """
        x = x.astype(np.float32)
        start = self.keys(x, np.broadcast_to(self.entries, (len(x), len(self.entries))))
        beam = np.full((len(x), width), NO_KEY)
        start.sort(axis=1)
        beam[:, : min(width, start.shape[1])] = start[:, :width]
        active = np.arange(len(x))
        while len(active):
            rows = beam[active]
            far = (rows >> np.uint64(32)).astype(np.uint32).view(np.float32)
            near = far <= np.float32((1 + ratio) ** 2) * far[:, :1]
            near[:, :least] = True
            go = near & (rows & np.uint64(1) == 1) & (rows != NO_KEY)
            some = go.any(axis=1)
            active, rows, go = active[some], rows[some], go[some]
            if not len(active):
                break
            at = np.argsort(~go, axis=1, kind="stable")[:, :opens]
            valid = np.take_along_axis(go, at, 1)
            own = np.take_along_axis(rows, at, 1)
            ids = np.where(valid, (own >> np.uint64(1)).astype(np.int64) & (2**31 - 1), 0)
            np.put_along_axis(rows, at, np.where(valid, own & ~np.uint64(1), own), 1)
            new = self.keys(x[active], self.links[ids].reshape(len(active), -1))
            new[np.repeat(~valid, self.links.shape[1], axis=1)] = NO_KEY
            rows = np.hstack([rows, new])
            rows.sort(axis=1)
            again = np.zeros(rows.shape, bool)
            again[:, 1:] = rows[:, 1:] >> np.uint64(1) == rows[:, :-1] >> np.uint64(1)  # the opened one comes first
            rows[again] = NO_KEY
            rows.sort(axis=1)
            beam[active] = rows[:, :width]
        far = np.sqrt((beam >> np.uint64(32)).astype(np.uint32).view(np.float32).astype(np.float64))
        ids = (beam >> np.uint64(1)).astype(np.int64) & (2**31 - 1)
        return np.where(beam == NO_KEY, -1, ids), np.where(beam == NO_KEY, np.inf, far)

    def stored(self, x: np.ndarray, copies: int, ratio: float) -> np.ndarray:
        """The lists that store each vector: the nearest by distance and offset, and others within the ratio that no chosen one is much nearer to. -1 fills up."""
        out = np.full((len(x), copies), -1)
        for a in range(0, len(x), 2048):
            near, far = self.walk(x[a : a + 2048], min(len(self.at), 8 + 2 * copies), 1.0, 4, 2)
            with_offset = np.where(near < 0, np.inf, far**2 + self.offset[near])
            order = np.argsort(with_offset, axis=1, kind="stable")
            near, cost = np.take_along_axis(near, order, 1), np.sqrt(np.maximum(np.take_along_axis(with_offset, order, 1), 0.0))
            some = out[a : a + 2048]
            some[:, 0], used = near[:, 0], np.ones(len(near), np.int64)
            for j in range(1, near.shape[1]):
                gap = np.linalg.norm(self.at[near[:, j]][:, None] - self.at[np.maximum(some, 0)], axis=2)
                gap[some < 0] = np.inf
                take = (near[:, j] >= 0) & (cost[:, j] <= (1 + ratio) * cost[:, 0]) & (used < copies) & (gap.min(axis=1) > cost[:, j] * 0.5)
                some[np.flatnonzero(take), used[take]] = near[take, j]
                used += take
        return out

    def probed(self, x: np.ndarray, ratio: float, least: int = 16, width: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of all lists within the ratio of a row's nearest, `least` at least. Rows with more of them than the beam is wide walk again with a wider one."""
        rows, out = np.arange(len(x)), []
        while len(rows):
            width = min(width, len(self.at))
            again = []
            for a in range(0, len(rows), max(1, 200_000 // width)):
                some = rows[a : a + max(1, 200_000 // width)]
                near, far = self.walk(x[some], width, ratio, max(8, least), 8)
                read = (far <= (1 + ratio) * far[:, :1]) | (np.arange(width) < least)
                more = read[:, -1] & (width < len(self.at))
                again.append(some[more])
                r, c = np.nonzero(read & (near >= 0) & ~more[:, None])
                out.append((some[r], near[r, c]))
            rows, width = np.concatenate(again), 4 * width
        r, c = (np.concatenate(z) for z in zip(*out, strict=True))
        return r, c


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", per_root: float = 1.0, max_lists: int = MAX_LISTS, copies: int = 2, copy_ratio: float = 0.1, probe_ratio: float = 0.17, block_rows: int = 1024) -> DataFrame:
    """The k rows of largest inner product that the index finds for every query row, itself left out.

    is_query is a condition on vec_id. Returns query_id, rank (from 1), vec_id, score: the inner product of the
    original vectors, summed in double precision from the first component on; ties go to the smaller vec_id. Rows with
    vectors that are null, empty, zero or not finite, and rows without an id, neither ask nor are found. Vectors of
    different lengths are searched apart, as they have no inner product. Repeated ids count as one candidate (the
    higher score) and as one query (the best of its rows). Fewer candidates than k: all that the lists hold are
    returned. Huge components only cost precision of the index, not of scores. An empty table gives no rows; other
    columns aren't read.

    Sizes: there are about per_root times the root of the table lists, max_lists at most; lists hold whole postings,
    cut into blocks of block_rows, so a list that a third of all rows falls in is many blocks and not one task, and of
    equal vectors a block holds those that can be found.
    """
    rows = clean(vectors, id_col, vec_col, allow_zero=False)
    parts = [one_length(rows.where(F.size("vec") == size.dim), size.n, size.norm, is_query, k, per_root, max_lists, copies, copy_ratio, probe_ratio, block_rows) for size in lengths(rows)]
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if not parts else parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out if len(parts) < 2 else ranked(out.drop("rank"), k)


def index(rows: DataFrame, n: int, norm: float, per_root: float, max_lists: int) -> CentroidGraph:
    lists = int(min(max_lists, max(1, 2 ** np.round(np.log2(max(1.0, per_root * n**0.5))))))
    sample = augmented(sample_matrix(rows, int(min(SAMPLE_ROWS, max(16_384, 16 * lists)))) / norm)
    return CentroidGraph(*balanced_lists(sample, balanced_centroids(sample, lists)))


def one_length(rows: DataFrame, n: int, norm: float, is_query: Column, k: int, per_root: float, max_lists: int, copies: int, copy_ratio: float, probe_ratio: float, block_rows: int) -> DataFrame:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(index(rows, n, norm, per_root, max_lists))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        for batch in batches:
            x, ids = matrix(batch.column("vec")), batch.column("vec_id").to_numpy()
            stored = graph.stored(augmented(x / norm), copies, copy_ratio)
            at, column = np.nonzero(stored >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(stored[at, column]), pa.array(np.zeros(len(at), bool)), pa.array(ids[at]), vector_column(x[at])], ["list", "asks", "vec_id", "vec"])
            asks = np.flatnonzero(batch.column("is_query").to_numpy(zero_copy_only=False))
            for part in np.array_split(asks, -(-len(asks) // 1024)) if len(asks) else ():
                q = np.hstack([x[part] / norm, np.zeros((len(part), 1))])  # a query has no added component
                at, found = graph.probed(q, probe_ratio)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.ones(len(at), bool)), pa.array(ids[part[at]]), vector_column(x[part[at]])], ["list", "asks", "vec_id", "vec"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("list", pa.int64()), ("asks", pa.bool_()), ("n", pa.int64()), ("ids", pa.binary()), ("mat", pa.binary())])
        for batch in batches:
            lists, asks = batch.column("list").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            ids, x = batch.column("vec_id").to_numpy(), matrix(batch.column("vec"))
            ends = np.flatnonzero(np.append((np.diff(lists) != 0) | (np.diff(asks.astype(np.int8)) != 0), True)) + 1
            out, begin = [], 0
            for end in ends:
                at = np.arange(begin, end)
                if not asks[begin]:
                    at = at[foremost(ids[begin:end], x[begin:end], k)]
                out += [packed({"list": int(lists[begin]), "asks": bool(asks[begin])}, ids[at[a : a + block_rows]], x[at[a : a + block_rows]]) for a in range(0, len(at), block_rows)]
                begin = end
            yield pa.RecordBatch.from_pylist(out, schema)

    placed = cut(rows.withColumn("is_query", F.coalesce(is_query, F.lit(False))).mapInArrow(place, "list long, asks boolean, vec_id long, vec array<double>"))
    # The id in the sort key lets a crowded list span partitions; blocks are cut wherever a partition or batch ends.
    dealt = placed.repartitionByRange(shuffle_partitions(spark), "list", "asks", "vec_id").sortWithinPartitions("list", "asks", "vec_id")
    blocks = cut(dealt.mapInArrow(pack, "list long, asks boolean, n long, ids binary, mat binary").withColumn("block", F.monotonically_increasing_id()))
    # A list of many blocks is dealt over as many tasks as it has fours of blocks, and its queries go to each.
    stored = blocks.where("not asks")
    salts = stored.groupBy("list").agg(F.ceil(F.count("*") / 4).alias("salts"))
    queries = blocks.where("asks").join(salts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat"))
    stored = stored.join(salts, "list").select("list", F.pmod(F.xxhash64("block"), F.col("salts")).alias("salt"), "ids", "mat")
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // SCORED_AT_ONCE))
    return ranked(score_pairs(queries.join(stored, ["list", "salt"]).coalesce(tasks), k), k)
