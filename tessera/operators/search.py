"""Vector and full-text search over a chunk table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vectors as vx

#: Vectors in a block of a batch search.
BLOCK = 1024


def vector_search(chunks: DataFrame, query: list[float] | Column, k: int = 10, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k nearest rows, with distance, similarity (1 - distance in [0, 1]) and rank. One scan and a top-k, no sort of all rows.

    Rows to which there is no distance (null or zero vectors, null components, another length) are not found.
    """
    if not 1 <= k <= 1000:
        raise ValueError("k must lie between 1 and 1000")
    q = F.array(*[F.lit(float(x)) for x in query]).cast("array<double>") if isinstance(query, list) else query
    rows = chunks.where(F.col(vec_col).isNotNull())
    if where is not None:
        rows = rows.where(where)
    rows = rows.withColumn("distance", vx.distance(F.col(vec_col), q, metric)).where(F.col("distance").isNotNull() & ~F.isnan("distance"))
    top = rows.orderBy("distance", id_col).limit(k)
    return ranked(top.withColumn("similarity", vx.clamp(1.0 - F.col("distance"))), F.col("distance"), F.col(id_col))


def blocks(df: DataFrame, id_col: str, vec_col: str, metric: str, name: str, packs: int) -> DataFrame:
    """(dim, pack, name): finite vectors (for cosine, no zero ones) packed by length into blocks of about BLOCK.

    A vector's pack is a hash of its id; rows that repeat an id more than a block's worth make that block larger.
    """
    v = F.col("vec")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if metric == "cosine":
        rows = rows.where(F.exists(v, lambda x: x != 0))
    return rows.groupBy(F.size("vec").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(packs)).cast("int").alias("pack")).agg(F.collect_list(F.struct("id", "vec")).alias(name))


def batch_search(chunks: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of each query row (query_id, query_vec), however many there are.

    Queries and rows meet in blocks of one length, and each pair of blocks hands on its k best for each query. A pair's
    key is the length and the pack of rows, to which every block of queries goes: pairs are spread over all tasks.
    """
    if metric not in ("cosine", "l2", "inner_product"):
        raise ValueError(f"unknown metric {metric!r}")

    def unpacked(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
        each = column[i].values
        return each.field("id").to_numpy(), each.field("vec").flatten().to_numpy().reshape(len(each), -1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (qi, q), (xi, x) = unpacked(batch.column("q"), i), unpacked(batch.column("x"), i)
                if metric == "l2":
                    far = np.sqrt(np.maximum(np.einsum("ij,ij->i", q, q)[:, None] - 2.0 * q @ x.T + np.einsum("ij,ij->i", x, x), 0.0))
                else:
                    far = -(q @ x.T)
                if metric == "cosine":
                    far = 1.0 + far / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1))
                near = np.lexsort((np.broadcast_to(xi, far.shape), far), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, near.shape[1])), pa.array(xi[near].reshape(-1)), pa.array(np.take_along_axis(far, near, 1).reshape(-1))], ["query_id", id_col, "distance"])

    packs = max(1, -(-chunks.count() // BLOCK))
    rows = blocks(chunks, id_col, vec_col, metric, "x", packs)
    asked = blocks(queries, "query_id", "query_vec", metric, "q", max(1, -(-queries.count() // BLOCK))).drop("pack").withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    pairs = asked.join(rows.hint("merge"), ["dim", "pack"]).select("q", "x")  # blocks are large rows, whatever their plan's estimate: none goes through the driver
    found = pairs.mapInArrow(compare, f"query_id long, {id_col} long, distance double")
    by = Window.partitionBy("query_id").orderBy("distance", id_col)
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """1-based ranks of a page that a limit has already bounded."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def nothing(docs: DataFrame, id_col: str, **columns: Column) -> DataFrame:
    """The result of a query without terms: no rows."""
    return docs.where(F.lit(False)).select(id_col, *[c.alias(n) for n, c in columns.items()], F.lit(0.0).alias("score"), F.lit(0).alias("rank"))


def all_terms(text: Column, terms: list[str], stop: frozenset[str] = frozenset()) -> Column:
    found = tx.tokens(text, stop)
    return reduce(lambda a, b: a & b, (F.array_contains(found, t) for t in terms))


def hinted(docs: DataFrame, text_col: str, terms: list[str]) -> DataFrame:
    """Rows that can hold all terms at all: a substring test spares most rows the tokenizing."""
    return docs.where(reduce(lambda a, b: a & b, (F.lower(text_col).contains(t) for t in terms)))


def positions(docs: DataFrame, id_col: str, text_col: str, terms: list[str], stop: frozenset[str] = frozenset()) -> DataFrame:
    """(id, n_tokens, pos, term) for each place of a term, in rows that hold all of them."""
    rows = hinted(docs, text_col, terms).select(id_col, tx.tokens(F.col(text_col), stop).alias("toks"))
    rows = rows.where(reduce(lambda a, b: a & b, (F.array_contains("toks", t) for t in terms)))
    return rows.select(id_col, F.size("toks").alias("n_tokens"), F.posexplode("toks").alias("pos", "term")).where(F.col("term").isin(terms))


def text_search(docs: DataFrame, query: str, k: int = 10, id_col: str = "doc_id", text_col: str = "text", category: Column | None = None, min_score: float = 0.0, stop: frozenset[str] = frozenset()) -> DataFrame:
    """Rows that hold all terms, by cover density: each shortest stretch with all terms adds 1 / its length; the sum is divided by 1 + ln(tokens) and by tokens."""
    terms = tx.query_terms(query, stop)
    if not terms:
        return nothing(docs, id_col, n_tokens=F.lit(0))
    rows = docs if category is None else docs.where(category)
    at = positions(rows, id_col, text_col, terms, stop)
    upto = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = [F.max(F.when(F.col("term") == t, F.col("pos"))).over(upto) for t in terms]
    begin = latest[0] if len(latest) == 1 else F.when(reduce(lambda a, b: a & b, (c.isNotNull() for c in latest)), F.least(*latest))
    covers = at.withColumn("begin", begin).where("begin is not null").groupBy(id_col, "n_tokens", "begin").agg(F.min("pos").alias("end"))
    length = F.col("n_tokens").cast("double")
    scored = covers.groupBy(id_col, "n_tokens").agg(F.sum(1.0 / (F.col("end") - F.col("begin") + 1)).alias("density"))
    scored = scored.withColumn("score", F.col("density") / (1.0 + F.log(length)) / length).where(F.col("score") >= min_score)
    return ranked(scored.orderBy(F.desc("score"), id_col).limit(k), F.desc("score"), F.col(id_col)).select(id_col, "n_tokens", "score", "rank")


def phrase_search(docs: DataFrame, phrase: str, k: int = 10, id_col: str = "doc_id", text_col: str = "text", category: Column | None = None) -> DataFrame:
    """Rows that hold the terms next to each other in order, by the number of such places over tokens."""
    terms = [t for t in re.split("[^a-z0-9]+", phrase.lower()) if t]
    if not terms:
        return nothing(docs, id_col, n_tokens=F.lit(0), hits=F.lit(0))
    rows = docs if category is None else docs.where(category)
    rows = hinted(rows, text_col, terms).select(id_col, tx.tokens(F.col(text_col)).alias("toks"))
    hits = F.filter(F.sequence(F.lit(0), F.size("toks") - len(terms)), lambda i: reduce(lambda a, b: a & b, (F.get(F.col("toks"), i + j) == t for j, t in enumerate(terms))))
    rows = rows.where(F.size("toks") >= len(terms)).select(id_col, F.size("toks").alias("n_tokens"), F.size(hits).alias("hits")).where("hits > 0")
    rows = rows.withColumn("score", F.col("hits").cast("double") / F.col("n_tokens"))
    return ranked(rows.orderBy(F.desc("score"), id_col).limit(k), F.desc("score"), F.col(id_col))


def bm25_search(docs: DataFrame, query: str, k: int = 10, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 over rows with any term; document frequencies and the mean length are over all rows."""
    terms = tx.query_terms(query)
    if not terms:
        return nothing(docs, id_col)
    # Tokens are runs of letters and digits, so counts need no arrays of them: a term's matches between other characters.
    text = F.lower(text_col)
    counts = [F.when(text.contains(t), F.regexp_count(text, F.lit(f"(?<![a-z0-9]){t}(?![a-z0-9])"))).otherwise(0).alias(f"tf{i}") for i, t in enumerate(terms)]
    rows = docs.select(id_col, F.regexp_count(text, F.lit("[a-z0-9]++")).alias("n_tokens"), *counts).where("n_tokens > 0")
    stats = rows.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    rows = rows.where(reduce(lambda x, y: x | y, (F.col(f"tf{i}") > 0 for i in range(len(terms))))).join(F.broadcast(stats))
    parts = [F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("n_tokens") / F.col("mean"))) for i in range(len(terms))]
    rows = rows.select(id_col, reduce(lambda x, y: x + y, parts).alias("score"))
    return ranked(rows.orderBy(F.desc("score"), id_col).limit(k), F.desc("score"), F.col(id_col))
