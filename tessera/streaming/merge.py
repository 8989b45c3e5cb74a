"""Streams that merge into a stored table by key, repeatably: a batch that comes again changes nothing.

The table lies in buckets by hash of the key. A batch rewrites the buckets that it touches into a folder of its own and
then logs which bucket stands where; readers follow the log. What a failed attempt left is written over by the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tessera.sources import sinks

LOG = "batch long, bucket int, inserted long, updated long, repeated long"


class MergedTable:
    """A table of rows by key in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 16):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def log(self) -> DataFrame:
        """(batch, bucket, inserted, updated, repeated) of the batches that ended."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        except AnalysisException:
            return self.spark.createDataFrame([], LOG)

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The table as the log has it; of the given buckets alone, if any are."""
        newest = self.log().groupBy("bucket").agg(F.max("batch").alias("batch")).collect()  # a row a bucket
        at = [f"{self.path}/data/batch={r['batch']}/bucket={r['bucket']}" for r in newest if buckets is None or r["bucket"] in buckets]
        return self.spark.read.schema(self.schema).parquet(*at) if at else self.spark.createDataFrame([], self.schema)

    def merge(self, new: DataFrame, batch: int, order: str | None = None) -> None:
        """Upserts a batch's rows; of rows with one key the last by order (else by all columns) counts. A batch in the log is passed over."""
        if self.log().where(F.col("batch") == batch).take(1):
            return
        names = self.spark.createDataFrame([], self.schema).columns
        rows = new.where(F.col(self.key).isNotNull()).select(names)
        once = rows.groupBy(self.key).agg(F.max(F.struct(*([F.col(order).alias("__order")] if order else []), *names)).alias("r")).select([F.col(f"r.{n}").alias(n) for n in names])
        touched = [r[0] for r in rows.select(self.bucket(F.col(self.key))).distinct().collect()]  # `buckets` at most
        if not touched:
            return
        old = self.rows(touched)
        both = sinks.upsert(old, once, self.key).drop("action").withColumn("bucket", self.bucket(F.col(self.key)))
        both.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")
        counts = sinks.upsert_stats(old.withColumn("bucket", self.bucket(F.col(self.key))), rows.withColumn("bucket", self.bucket(F.col(self.key))), self.key, "bucket")
        counts.select(F.lit(batch).cast("long").alias("batch"), "bucket", "inserted", "updated", "repeated").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/part={batch}")

    def follow(self, stream: DataFrame, checkpoint: str, order: str | None = None, once: bool = True) -> StreamingQuery:
        """Merges a stream's micro-batches; with once, all there is now, and then it ends."""
        writer = stream.writeStream.foreachBatch(lambda df, batch: self.merge(df, batch, order)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
