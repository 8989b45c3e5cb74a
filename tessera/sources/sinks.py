"""Merging new rows into a table by key: insert-if-absent and upsert, with counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokens


def insert_if_absent(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of new to append: one for each key that target lacks."""
    return new.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def upsert(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """target with new's rows in place of those of the same key, and column action: kept, updated or inserted."""
    old = target.select(F.col(key).alias("__k"), F.struct(*target.columns).alias("__old"))
    fresh = new.select(F.col(key).alias("__n"), F.struct(*target.columns).alias("__new"))
    both = old.join(fresh, F.col("__k") == F.col("__n"), "full_outer")
    action = F.when(F.col("__n").isNull(), "kept").when(F.col("__k").isNull(), "inserted").otherwise("updated")
    return both.select(F.coalesce("__new", "__old").alias("row"), action.alias("action")).select("row.*", "action")


def write_report(df: DataFrame, path: str) -> None:
    """Writes rows as JSON lines; a report that is there already is an error."""
    df.write.mode("errorifexists").json(path)


def upsert_stats(old: DataFrame, new: DataFrame, key: str, *by: str) -> DataFrame:
    """What an upsert does: rows inserted, updated and kept, and rows of new that repeat a key; one row, or one for each value of the columns `by`."""
    both = new.groupBy(key, *by).agg(F.count("*").alias("__new")).join(old.groupBy(key, *by).agg(F.count("*").alias("__old")), [key, *by], "full")
    is_new, is_old = F.col("__new").isNotNull(), F.col("__old").isNotNull()
    return both.groupBy(*by).agg(F.count_if(is_new & ~is_old).alias("inserted"), F.count_if(is_new & is_old).alias("updated"), F.count_if(~is_new).alias("kept"), F.coalesce(F.sum(F.col("__new") - 1), F.lit(0)).alias("repeated"))


def from_arrays(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows out of a row's parallel arrays (the form in which a columnar upsert comes), for upsert()."""
    return df.select(F.explode(F.arrays_zip(*columns)).alias("__r")).select("__r.*")


def stamped(new: DataFrame, old: DataFrame, key: str, now: Column) -> DataFrame:
    """upsert() with updated_at: now for rows inserted or updated, what was there for rows kept. old has the column updated_at."""
    return upsert(old, new.withColumn("updated_at", now), key)


def with_tokens(docs: DataFrame, text_col: str = "text", *more: str, stop: frozenset[str] = frozenset()) -> DataFrame:
    """docs with the columns tokens and lexemes, to be written beside the text so that searches need not tokenize again."""
    text = F.concat_ws(" ", text_col, *more)
    return docs.withColumn("tokens", tokens(text, stop)).withColumn("lexemes", F.array_sort(F.array_distinct("tokens")))
