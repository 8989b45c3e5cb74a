"""Fusion of ranked lists, normalisation and merging of scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import clamp


def rrf(arms: dict[str, tuple[DataFrame, float]], k: int = 60, id_col: str = "id") -> DataFrame:
    """(id, score, sources, confidence, rank): sum of weight / (k + rank) over the arms' (id, rank) rows, weights normalised to sum 1.

    Rows that repeat an id within an arm count once, at their last rank. confidence is the largest of the arms' (their
    column confidence, 0 if an arm has none).
    """
    if not 1 <= k <= 1000:
        raise ValueError("k must lie between 1 and 1000")
    total = sum(w for _, w in arms.values())
    if total <= 0:
        raise ValueError("weights must not all be zero")
    sure = lambda df: (F.max("confidence") if "confidence" in df.columns else F.lit(0.0)).cast("double").alias("confidence")
    parts = [df.groupBy(id_col).agg(F.max("rank").alias("rank"), sure(df)).select(id_col, (F.lit(w / total) / (k + F.col("rank"))).alias("part"), F.lit(name).alias("source"), "confidence") for name, (df, w) in arms.items() if w > 0]
    fused = reduce(DataFrame.unionByName, parts).groupBy(id_col).agg(F.sum("part").alias("score"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.max("confidence").alias("confidence"))
    return reranked(fused.withColumn("score", clamp(F.col("score"))), F.desc("score"), F.col(id_col))


def fuse_multiple(arms: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = 60, id_col: str = "id") -> DataFrame:
    """Fusion of any number of arms, equal weights by default; repeats of an id within an arm add up."""
    weights = weights or {name: 1.0 / len(arms) for name in arms}
    if abs(sum(weights.values()) - 1.0) > 0.01:
        raise ValueError("weights must sum to 1")
    parts = [df.select(id_col, (F.lit(weights.get(name, 0.0)) / (k + F.col("rank"))).alias("part")) for name, df in arms.items() if weights.get(name, 0.0) > 0]
    fused = reduce(DataFrame.unionByName, parts).groupBy(id_col).agg(clamp(F.sum("part")).alias("score"))
    return reranked(fused, F.desc("score"), F.col(id_col))


def reranked(df: DataFrame, *order: Column) -> DataFrame:
    """Ranks over a fused page; its arms are top-k lists, so it is small."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def linear(vector: Column, text: Column, weights: tuple[float, float] = (0.6, 0.4)) -> Column:
    if abs(sum(weights) - 1.0) > 0.001:
        raise ValueError("weights must sum to 1")
    return vector * weights[0] + text * weights[1]


def normal_vector(score: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.lit(0.5) if low == high else (score - low) / (high - low)


def normal_text(score: Column, p99: float = 10.0) -> Column:
    return F.least(F.lit(1.0), score / (p99 if p99 > 0 else 1.0))


def first_seen(df: DataFrame, id_col: str, order: Column) -> DataFrame:
    """The first row of every id."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(id_col).orderBy(order))).where("__n = 1").drop("__n")
