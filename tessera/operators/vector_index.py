"""A stored vector index: vectors clustered into a partitioned table, and exact searches that leave partitions out by radius.

Every vector lies within its cluster's radius of the centre, so none can be nearer to a query than the query's distance
to the centre less the radius. A search scores the most promising partitions first; the k-th distance found there is a
bar, and only partitions whose bound reaches it are read. Cosine searches work on unit vectors, whose distances order
alike. Centres and radii are a bounded table; vectors stay in the cluster of their nearest centre.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as vx
from tessera.operators.search import ranked

#: Vectors that centres are fitted on at most, and clusters at most.
SAMPLE, CLUSTERS = 20_000, 1024
#: Partitions that are scored first, and what bounds allow for rounding.
FIRST, SLACK = 4, 1e-9


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    id_col: str
    vec_col: str
    metric: str
    schema: str

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        m = spark.read.parquet(f"{path}/state").first()
        return cls(spark, path, m["id_col"], m["vec_col"], m["metric"], m["schema"])

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/vectors")

    def clusters(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, centres and radii of clusters that have vectors: CLUSTERS rows at most."""
        centres = self.spark.read.parquet(f"{self.path}/centres")
        radii = self.spark.read.parquet(f"{self.path}/radii").groupBy("cluster").agg(F.max("radius").alias("radius"))
        found = centres.join(radii, "cluster").orderBy("cluster").collect()
        return np.array([r["cluster"] for r in found], int), np.array([r["centre"] for r in found], float).reshape(len(found), -1 if found else 1), np.array([r["radius"] for r in found], float)


def fine(vec: Column, metric: str) -> Column:
    """Vectors that can be found: finite, not empty, and for cosine not zero."""
    sound = vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return sound & F.exists(vec, lambda x: x != 0) if metric == "cosine" else sound


def scaled(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x


def apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.einsum("ij,ij->i", x, x)[:, None] - 2 * x @ centres.T + np.einsum("ij,ij->i", centres, centres), 0))


def fitted(x: np.ndarray, k: int, turns: int = 8) -> np.ndarray:
    """Centres by Lloyd's algorithm from rows spread over the sample."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(turns):
        near = apart(x, centres).argmin(axis=1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def build(rows: DataFrame, path: str, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", clusters: int | None = None) -> VectorIndex:
    """Writes the index of rows under path. Vectors that can't be found, and those of another length than most have, are left out.

    metric: cosine or l2. Centres are fitted on SAMPLE vectors of the smallest hash of their id; all rows are assigned.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError("metric must be cosine or l2")
    spark = rows.sparkSession
    sound = rows.where(fine(F.col(vec_col), metric))
    sizes = sound.groupBy(F.size(vec_col).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    n, dim = (sizes["n"], sizes["dim"]) if sizes else (0, 1)
    sample = sound.where(F.size(vec_col) == dim).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE).select(F.col(vec_col).cast("array<double>").alias("v")).collect()
    x = scaled(np.array([r["v"] for r in sample], float).reshape(len(sample), dim), metric)
    k = max(1, min(CLUSTERS, len(x), clusters or round(n**0.5 / 2)))
    centres = fitted(x, k) if len(x) else np.zeros((1, dim))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cluster int, far double"
    index = VectorIndex(spark, path, id_col, vec_col, metric, schema)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    spark.createDataFrame([(id_col, vec_col, metric, schema)], "id_col string, vec_col string, metric string, schema string").coalesce(1).write.parquet(f"{path}/state")
    add(index, rows)
    return index


def add(index: VectorIndex, rows: DataFrame) -> None:
    """Puts rows into the clusters of their nearest centres, and widens the radii."""
    found = index.spark.read.parquet(f"{index.path}/centres").orderBy("cluster").collect()
    centres, metric, dim = np.array([r["centre"] for r in found], float), index.metric, len(found[0]["centre"])

    def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vecs in parts:
            far = apart(scaled(np.stack(vecs.to_numpy()).astype(float), metric), centres) if len(vecs) else np.zeros((0, 1))
            yield pd.DataFrame({"cluster": far.argmin(axis=1).astype(np.int32), "far": far.min(axis=1)})

    near = F.pandas_udf(nearest, "cluster int, far double")
    sound = rows.where(fine(F.col(index.vec_col), metric) & (F.size(index.vec_col) == dim))
    placed = sound.withColumn("__c", near(F.col(index.vec_col).cast("array<double>"))).select(*rows.columns, F.col("__c.cluster").alias("cluster"), F.col("__c.far").alias("far"))
    # Ranges of (cluster, distance) deal a large cluster over many files.
    placed.repartitionByRange("cluster", "far", index.id_col).write.mode("append").partitionBy("cluster").parquet(f"{index.path}/vectors")
    index.rows().groupBy("cluster").agg(F.max("far").alias("radius")).coalesce(1).write.mode("append").parquet(f"{index.path}/radii")


def wanted(index: VectorIndex, query: list[float], k: int, where: Column | None = None) -> list[int]:
    """The clusters that can hold one of the k nearest: those whose bound reaches the k-th distance in the FIRST nearest ones."""
    numbers, centres, radii = index.clusters()
    q = scaled(np.array([query], float), index.metric)
    if not len(numbers) or centres.shape[1] != q.shape[1] or not np.isfinite(q).all():
        return []
    least = np.maximum(apart(q, centres)[0] - radii, 0) - SLACK * (1 + np.abs(q).max())
    order = np.argsort(least, kind="stable")
    first = nearest_rows(index, query, numbers[order[:FIRST]].tolist(), k, where).agg(F.count("*").alias("n"), F.max("distance").alias("far")).first()
    if first["n"] < k:
        return sorted(numbers.tolist())
    bar = np.sqrt(max(0.0, 2 * first["far"])) if index.metric == "cosine" else first["far"]
    return sorted(numbers[least <= bar + SLACK * (1 + bar)].tolist())


def nearest_rows(index: VectorIndex, query: list[float], clusters: list[int], k: int, where: Column | None) -> DataFrame:
    rows = index.rows().where(F.col("cluster").isin(clusters))
    rows = rows if where is None else rows.where(where)
    far = vx.distance(F.col(index.vec_col), F.array(*[F.lit(float(x)) for x in query]), index.metric)
    return rows.drop("cluster", "far").withColumn("distance", far).where("distance is not null").orderBy("distance", index.id_col).limit(k)


def search(index: VectorIndex, query: list[float], k: int = 10, where: Column | None = None) -> DataFrame:
    """The k nearest rows, exactly, with distance, similarity (1 - distance in [0, 1]) and rank; ties go to the smaller id."""
    if not 1 <= k <= 1000:
        raise ValueError("k must lie between 1 and 1000")
    top = nearest_rows(index, query, wanted(index, query, k, where), k, where)
    return ranked(top.withColumn("similarity", vx.clamp(1.0 - F.col("distance"))), F.col("distance"), F.col(index.id_col))
