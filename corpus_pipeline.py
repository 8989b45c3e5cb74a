"""Training-corpus pipeline: rejects toxic documents, deletes repeated lines, keeps one of each group of near copies,
mixes sources to target weights and encodes what is left as sampled pieces.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and, but for the last, returns
the columns of docs. Stages hand rows on as Parquet in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import copies, line_dedup, mixing, pieces, toxicity
from tessera.llm.common import WORD, free, shared_folder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7 by a model fitted on the labelled documents of sf_dir. Null texts stay. Any other columns stay, whatever their names."""
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = free(docs, "toxicity") + "toxicity"
    return toxicity.score(docs, model, keep=docs.columns, out=out).where(F.col(out) < 0.7).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines of 30 words or more; n_chars follows the text. Other columns stay, whatever their names.

    A document that loses all its words goes: all it held is in others. One without words to begin with stays.
    """
    p = free(docs, "gone", "n_lines")
    lost = F.size(f"{p}gone") > 0
    left = line_dedup.without_repeats(docs, prefix=p).where(~lost | F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.when(lost, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that a similarity of 0.8 over shingles of five words links: that of the smallest doc_id, then text hash.

    So rows that share an id stay unless their texts are linked or equal. Rows without id stay. Other columns stay, whatever their names.
    """
    p = free(docs, "id", "row", "kept")
    own, groups = copies.groups(docs)
    lowest = own.where("doc_id is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "text_hash", "row")).alias("low"))
    kept = lowest.join(groups, "sig").groupBy("group").agg(F.min("low").alias("low")).select(F.col("low.doc_id").alias(f"{p}id"), F.col("low.row").alias(f"{p}kept"))
    keyed = docs.withColumn(f"{p}row", copies.row_key(docs))
    first = keyed.join(kept, (F.col("doc_id") == F.col(f"{p}id")) & (F.col(f"{p}row") == F.col(f"{p}kept")), "left_semi").dropDuplicates(["doc_id", f"{p}row"])
    return first.select(docs.columns).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, which may be not at all. Rows that are equal in all columns are written as often as all of them are taken. Other columns stay, whatever their names."""
    p = free(docs, "id", "row", "key", "copies", "copy")
    taken = mixing.mix(docs, key=copies.row_key(docs)).groupBy(F.col("doc_id").alias(f"{p}id"), F.col("key").alias(f"{p}row")).agg(F.sum("copies").cast("int").alias(f"{p}copies")).where(F.col(f"{p}copies") > 0)
    rows = docs.withColumn(f"{p}key", copies.row_key(docs)).join(taken, F.col("doc_id").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}key") == F.col(f"{p}row"))).dropDuplicates([f"{p}id", f"{p}row"])
    return rows.withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), F.col(f"{p}copies")))).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces, n_pieces, lossless: a sampled segmentation of every text."""
    return pieces.sampled_pieces(docs)


STAGES = [("toxicity", reject_toxic), ("line dedup", dedup_lines), ("simhash near-dedup", keep_one_copy), ("source mix", mix_sources), ("sentencepiece", encode_pieces)]

#: No SQL engine has the stages' hashes, models or lattices; tests hold run() against all stages done plainly.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
