"""Work whose failures are set apart: a bad row becomes a row with its error, the others go on, and both are counted."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators import documents, markdown


def one_by_one(values: pd.Series, model: Callable[[pd.Series], pd.Series]) -> tuple[list, list]:
    """What the model gives for each value, and an error for each that it fails on: a failing batch is halved until its bad rows stand alone."""
    try:
        return list(model(values)), [None] * len(values)
    except Exception as e:  # noqa: BLE001  whatever a model raises is the row's error
        if len(values) == 1:
            return [None], [f"{type(e).__name__}: {e}"]
    half = len(values) // 2
    (a, x), (b, y) = one_by_one(values.iloc[:half], model), one_by_one(values.iloc[half:], model)
    return a + b, x + y


def mapped(df: DataFrame, column: str, model: Callable[[pd.Series], pd.Series] = documents.hash_embed, kind: str = "array<float>", out: str = "embedding") -> DataFrame:
    """df with `out`, what the model gives for a column, and `error`, null where it gave something. The model sees Arrow batches."""

    @F.pandas_udf(f"value {kind}, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in parts:
            found, errors = one_by_one(values, model) if len(values) else ([], [])
            yield pd.DataFrame({"value": pd.Series(found, dtype=object), "error": pd.Series(errors, dtype=object)})

    both = df.withColumn("__made", run(F.col(column)))
    return both.select(*[c for c in df.columns if c not in (out, "error")], F.col("__made.value").alias(out), F.col("__made.error").alias("error"))


def vector_fault(vec: Column, dim: int) -> Column:
    """What keeps a vector out of a table: missing, dimension or not finite; null if nothing does."""
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vec.isNull(), "missing").when(F.size(vec) != dim, "dimension").when(~sound, "not finite")


def write_vectors(rows: DataFrame, path: str, dim: int, vec_col: str = "embedding") -> dict[str, int]:
    """Writes rows in one pass, sound ones under state=stored and the others with their error under state=refused, and counts both."""
    seen = Observation("vectors")
    own = F.col("error") if "error" in rows.columns else F.lit(None)
    faults = rows.withColumn("error", F.coalesce(own, vector_fault(F.col(vec_col), dim)))
    bad = F.col("error").isNotNull()
    counted = faults.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("refused"), F.count_if(~bad).alias("stored"))
    counted.withColumn("state", F.when(bad, "refused").otherwise("stored")).write.mode("append").partitionBy("state").parquet(path)
    return dict(seen.get)


def file_fault(text: Column) -> Column:
    """What makes a file fail: blank, or undecodable where bytes that are no UTF-8 were replaced; null if nothing does."""
    return F.when(F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", F.lit(True)), "blank").when(text.contains("�"), "undecodable")


def failed_files(files: DataFrame) -> DataFrame:
    """(path, error) of files that ingest() passes over."""
    return files.select("path", file_fault(F.col("text")).alias("error")).where("error is not null")


def ingest(spark: SparkSession, source: str, path: str, separator: str = r"\n\s*\n", model: Callable[[pd.Series], pd.Series] | None = documents.hash_embed) -> dict[str, float]:
    """Reads a folder's files, writes their chunks with vectors to path and returns what the one pass counted.

    files, failed (files that are blank or no UTF-8), chunks, tokens, vectors, refused (chunks without vector), seconds.
    """
    files_seen, chunks_seen, began = Observation("files"), Observation("chunks"), time.monotonic()
    files = markdown.read_files(spark, source).withColumn("__fault", file_fault(F.col("text")))
    files = files.observe(files_seen, F.count(F.lit(1)).alias("files"), F.count_if(F.col("__fault").isNotNull()).alias("failed"))
    made = markdown.chunks(files.where("__fault is null").drop("__fault"), separator)
    made = mapped(made, "chunk_text", model) if model else made.withColumns({"embedding": F.lit(None).cast("array<float>"), "error": F.lit(None).cast("string")})
    has = F.col("embedding").isNotNull()
    made = made.observe(chunks_seen, F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"), F.count_if(has).alias("vectors"), F.count_if(~has).alias("refused"))
    made.write.mode("append").parquet(path)
    return files_seen.get | chunks_seen.get | {"seconds": time.monotonic() - began}
