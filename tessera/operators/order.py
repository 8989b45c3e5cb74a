"""Order statistics and ranks of groups of any size: counts over splits of the value range, so that no task holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Splits of a group's values. A split holds about n / SPLITS rows, equal values counted as one.
SPLITS = 256


def split_rows(df: DataFrame, value: str, keys: list[str], splits: int = SPLITS) -> DataFrame:
    """df with __split, the number of approximate quantiles of its group that lie below the value. Rows without value or key are left out.

    The quantiles' exact places don't matter, only that each row finds the same ones: they are one row a group.
    """
    rows = df.where(F.col(value).isNotNull())
    edges = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, [i / splits for i in range(1, splits)], 10 * splits)).alias("__edges"))
    return rows.join(edges, keys).withColumn("__split", F.size(F.filter("__edges", lambda e: e < F.col(value)))).drop("__edges")


def at_places(df: DataFrame, value: str, keys: list[str], places: dict[str, Column], splits: int = SPLITS) -> DataFrame:
    """(keys, one column for each of places): the values at 0-based places of each group in order, where `n` is its number of rows.

    Only splits in which a place falls are looked into, and of equal values one row.
    """
    rows = split_rows(df, value, keys, splits)
    counts = rows.groupBy(*keys, "__split").agg(F.count("*").alias("__in"))  # SPLITS rows a group
    below = Window.partitionBy(*keys).orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    sized = counts.withColumn("__below", F.coalesce(F.sum("__in").over(below), F.lit(0))).withColumn("n", F.sum("__in").over(Window.partitionBy(*keys)))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), place.cast("long").alias("place")) for name, place in places.items()])
    asked = sized.select(*keys, "__split", "__below", "__in", F.explode(wanted).alias("w")).where((F.col("w.place") >= F.col("__below")) & (F.col("w.place") < F.col("__below") + F.col("__in")))
    some = asked.groupBy(*keys, "__split", "__below").agg(F.collect_list("w").alias("__wanted"))
    values = rows.join(F.broadcast(some), [*keys, "__split"]).groupBy(*keys, "__split", "__below", "__wanted", value).agg(F.count("*").alias("__times"))
    upto = Window.partitionBy(*keys, "__split").orderBy(value)
    placed = values.withColumn("__last", F.col("__below") + F.sum("__times").over(upto))
    hit = F.filter("__wanted", lambda w: (w["place"] < F.col("__last")) & (w["place"] >= F.col("__last") - F.col("__times")))
    found = placed.select(*keys, value, F.explode(hit).alias("w"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("w.name") == name, F.col(value))).alias(name) for name in places])


def neighbours(df: DataFrame, value: str, keys: list[str], rank: str, falls: Column, span: int = 100_000) -> DataFrame:
    """(keys, n, low, high, distinct, held, pairs) of groups with ranks: rows, least and largest rank, distinct ranks, and of how many pairs of neighbours `falls` holds.

    falls compares columns before and after. Ranks are looked at in spans; neighbours of two spans meet as their last and first rows.
    """
    part = [*keys, "__span"]
    rows = df.withColumn("__span", F.floor(F.col(rank) / span))
    inner = Window.partitionBy(*part).orderBy(rank)
    pairs = rows.withColumn("before", F.lag(value).over(inner)).withColumn("after", F.col(value)).withColumn("__at", F.row_number().over(inner))
    holds = F.coalesce(falls.cast("long"), F.lit(0))
    spans = pairs.groupBy(*part).agg(
        F.count("*").alias("n"), F.min(rank).alias("low"), F.max(rank).alias("high"), F.count_distinct(rank).alias("distinct"), F.sum(F.when(F.col("__at") > 1, holds).otherwise(0)).alias("held"),
        F.min_by(value, "__at").alias("after"), F.max_by(value, "__at").alias("__end"),
    )
    edges = spans.withColumn("before", F.lag("__end").over(Window.partitionBy(*keys).orderBy("__span"))).withColumn("__first", F.row_number().over(Window.partitionBy(*keys).orderBy("__span")))
    out = edges.withColumn("held", F.col("held") + F.when(F.col("__first") > 1, holds).otherwise(0)).groupBy(*keys)
    return out.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("distinct").alias("distinct"), F.sum("held").alias("held")).withColumn("pairs", F.col("n") - 1)


def running(df: DataFrame, flag: Column, keys: list[str], rank: str, to: str, span: int = 100_000) -> DataFrame:
    """df with the running sum of a flag in the order of rank within each group: sums by span of ranks, then within each span."""
    rows = df.withColumn("__span", F.floor(F.col(rank) / span)).withColumn("__flag", flag.cast("long"))
    sums = rows.groupBy(*keys, "__span").agg(F.sum("__flag").alias("__sum"))
    before = sums.select(*keys, "__span", F.coalesce(F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.sum("__flag").over(Window.partitionBy(*keys, "__span").orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn(to, within).join(before, [*keys, "__span"]).withColumn(to, F.col(to) + F.col("__before")).drop("__span", "__flag", "__before")


def places(df: DataFrame, order: str, to: str, keys: tuple[str, ...] = (), splits: int = SPLITS) -> DataFrame:
    """df with 0-based places in the order of a column that is unique within its group, from counts over approximate quantiles: values may bunch anywhere in their range."""
    groups = list(keys) or ["__all"]
    rows = split_rows(df if keys else df.withColumn("__all", F.lit(0)), order, groups, splits)
    before = Window.partitionBy(*groups).orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*groups, "__split").agg(F.count("*").alias("__n")).select(*groups, "__split", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    at = F.row_number().over(Window.partitionBy(*groups, "__split").orderBy(order)) - 1
    placed = rows.withColumn(to, at).join(counts, [*groups, "__split"]).withColumn(to, F.col(to) + F.col("__before"))
    return placed.select(*df.columns, to)
