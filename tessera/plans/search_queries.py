"""Searches end to end over documents as chunks; the vector of a document is the embedding of its number."""

from __future__ import annotations

from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import hybrid, metrics, respond, routing
from tessera.plans.queries import ARMS, COVERS, SIMILAR, TOKS, first_vector, text_indexed
from tessera.plans.registry import query, r8
from tessera.sources.graph_tables import table as t

AS_OF, QUERY = date(2024, 3, 1), "From with"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    vectors = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    c = F.col
    day = F.date_add(F.lit(date(2024, 1, 1)), (c("doc_id") % 60).cast("int"))
    return t(spark, d, "documents").join(vectors, "doc_id", "left").select(
        c("doc_id").alias("chunk_id"), c("text").alias("chunk_text"), F.concat(F.lit("doc"), c("doc_id").cast("string"), F.lit(".md")).alias("source_file"), c("source").alias("source_category"), day.alias("document_date"),
        F.concat_ws(" > ", "source", "lang").alias("context_header"), (c("doc_id") % 3).cast("int").alias("chunk_index"), F.lit(3).alias("total_chunks"), F.to_json(F.struct(c("lang").alias("vendor"))).alias("metadata"), "embedding",
    )


def sql_arms(k: int, where: str = "true") -> str:
    """ARMS over the documents that a condition selects, k rows each."""
    kept = ARMS.replace("<= 200", f"<= {k}").replace("FROM embeddings e, q", f"FROM embeddings e, q WHERE vec_id IN (SELECT doc_id FROM documents WHERE {where})")
    return kept.replace(TOKS, TOKS.replace("FROM documents", f"FROM documents WHERE {where}"))


RECENT = "CASE WHEN 60 - doc_id % 60 < 7 THEN CAST(0.05 AS DOUBLE) WHEN 60 - doc_id % 60 < 30 THEN CAST(0.05 AS DOUBLE) * CAST(0.7 AS DOUBLE) ELSE 0 END"
MENTIONED = "CASE WHEN contains(lower(text), 'from') THEN CAST(0.1 AS DOUBLE) ELSE 0 END"


def sql_hybrid(k: int, where: str = "true", least: float = 0.0, factor: str = "1") -> str:
    return f"""{sql_arms(k, where)}, f AS (SELECT id, sum(w) AS score FROM (SELECT id, CAST(0.6 AS DOUBLE) / (60 + rank) AS w FROM v UNION ALL SELECT id, CAST(0.4 AS DOUBLE) / (60 + rank) FROM x) GROUP BY id),
b AS (SELECT id, source, lang, least(1, f.score * {factor} * (1 + {MENTIONED} + {RECENT})) AS score FROM f JOIN documents ON id = doc_id),
h AS (SELECT *, row_number() OVER (ORDER BY round(score, 14) DESC, id) AS rank FROM b WHERE score >= {least} QUALIFY rank <= {k})"""


@query(f"WITH {sql_hybrid(40)} SELECT id AS chunk_id, round(score, 8) AS hybrid_score, CAST(rank AS INTEGER) AS rank, 'hybrid' AS score_type FROM h")
def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    found = hybrid.hybrid_search(chunks(spark, d), QUERY, first_vector(spark, d), 40, strategy="hybrid", as_of=AS_OF, index=partial(text_indexed, spark, d))
    return found.select("chunk_id", r8("hybrid_score").alias("hybrid_score"), "rank", "score_type")


@query(f"WITH {sql_hybrid(40, "lang = 'en' AND source <> 'src1'", 0.3, '61')} SELECT id AS chunk_id, source AS source_category, round(score, 8) AS hybrid_score, CAST(rank AS INTEGER) AS rank FROM h")
def search_filtered_normalised(spark: SparkSession, d: str) -> DataFrame:
    where = (F.col("context_header").endswith("> en")) & (F.col("source_category") != "src1")
    found = hybrid.hybrid_search(chunks(spark, d), QUERY, first_vector(spark, d), 40, strategy="hybrid", where=where, min_score=0.3, as_of=AS_OF, normalised=True, index=partial(text_indexed, spark, d))
    return found.select("chunk_id", "source_category", r8("hybrid_score").alias("hybrid_score"), "rank")


@query(f"WITH {sql_arms(15)} SELECT id AS chunk_id, round(greatest(0, least(1, score)), 8) AS similarity_score, CAST(rank AS INTEGER) AS rank FROM v")
def search_routed(spark: SparkSession, d: str) -> DataFrame:
    """No technical word: the route is the vector arm alone."""
    return hybrid.hybrid_search(chunks(spark, d), QUERY, first_vector(spark, d), 15, index=partial(text_indexed, spark, d)).select("chunk_id", r8("similarity_score").alias("similarity_score"), "rank")


@query(f"WITH {TOKS.replace('FROM documents', "FROM documents WHERE date_add(DATE '2024-01-01', CAST(doc_id % 60 AS INTEGER)) >= DATE '2024-02-01'")}, {COVERS} SELECT doc_id AS chunk_id, round(score, 8) AS bm25_score, CAST(row_number() OVER (ORDER BY round(score, 14) DESC, doc_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 15")
def search_text_since(spark: SparkSession, d: str) -> DataFrame:
    found = hybrid.hybrid_search(chunks(spark, d), QUERY, first_vector(spark, d), 15, strategy="bm25", where=F.col("document_date") >= F.lit(date(2024, 2, 1)), index=partial(text_indexed, spark, d))
    return found.select("chunk_id", r8("bm25_score").alias("bm25_score"), "rank")


@query(f"SELECT vec_id AS chunk_id, round(greatest(0, least(1, {SIMILAR})), 8) AS similarity_score, CAST(row_number() OVER (ORDER BY {SIMILAR} DESC, vec_id) AS INTEGER) AS rank FROM embeddings e JOIN documents ON doc_id = vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE doc_id % 60 BETWEEN 10 AND 40 QUALIFY rank <= 15")
def search_vector_between(spark: SparkSession, d: str) -> DataFrame:
    days = F.col("document_date").between(F.lit(date(2024, 1, 11)), F.lit(date(2024, 2, 10)))
    found = hybrid.hybrid_search(chunks(spark, d), QUERY, first_vector(spark, d), 15, strategy="vector", where=days, index=partial(text_indexed, spark, d))
    return found.select("chunk_id", r8("similarity_score").alias("similarity_score"), "rank")


@query(f"WITH {sql_hybrid(40)} SELECT 'hybrid' AS strategy, (SELECT count(*) FROM v) AS vector_count, (SELECT count(*) FROM x) AS bm25_count, (SELECT count(*) FROM b) AS merged_count, (SELECT count(*) FROM h) AS final_count, CAST(0.85 AS DOUBLE) AS confidence")
def search_explained(spark: SparkSession, d: str) -> DataFrame:
    row = hybrid.explained(chunks(spark, d), QUERY, first_vector(spark, d), 40, strategy="hybrid", as_of=AS_OF, index=partial(text_indexed, spark, d))
    return row.select("strategy", "vector_count", "bm25_count", "merged_count", "final_count", r8("confidence").alias("confidence"))


SECOND_PAGE = respond.cursor({"query": QUERY, "top_k": 40, "mode": "metadata"}, 10, "metadata")


@query(f"WITH {sql_hybrid(40)} SELECT id AS chunk_id, round(score, 8) AS hybrid_score, CAST(rank AS INTEGER) AS rank, 'doc' || id || '.md' AS source_file, source AS source_category, CAST(id % 3 AS INTEGER) AS chunk_index, 3 AS total_chunks, (SELECT count(*) FROM h) AS total_found, (SELECT count(*) FROM h) > 20 AS has_more FROM h WHERE rank BETWEEN 11 AND 20")
def semantic_search_page(spark: SparkSession, d: str) -> DataFrame:
    page = hybrid.semantic_search(chunks(spark, d), QUERY, first_vector(spark, d), 40, 10, SECOND_PAGE, as_of=AS_OF, index=partial(text_indexed, spark, d))
    return page.withColumn("hybrid_score", r8("hybrid_score")).drop("next_cursor")


@query(f"WITH {sql_hybrid(40)} SELECT id AS chunk_id, sha256(text) AS text_hash, '{{\"vendor\":\"' || h.lang || '\"}}' AS metadata, CAST(rank AS INTEGER) AS rank, (SELECT count(*) FROM h) AS total_found FROM h JOIN documents ON doc_id = id WHERE rank <= 10")
def semantic_search_full(spark: SparkSession, d: str) -> DataFrame:
    """The first page with all columns."""
    page = hybrid.semantic_search(chunks(spark, d), QUERY, first_vector(spark, d), 40, mode="full", as_of=AS_OF, index=partial(text_indexed, spark, d))
    return page.select("chunk_id", F.sha2("chunk_text", 256).alias("text_hash"), "metadata", "rank", "total_found")


@query(f"WITH {sql_hybrid(40)} SELECT least(10, count(*)) AS returned, least(10, count(*)) * 10 + 300 AS tokens, CAST(NULL AS VARCHAR) AS warning FROM h")
def semantic_search_envelope(spark: SparkSession, d: str) -> DataFrame:
    page = hybrid.semantic_search(chunks(spark, d), QUERY, first_vector(spark, d), 40, mode="ids_only", as_of=AS_OF, index=partial(text_indexed, spark, d)).select(*respond.MODES["ids_only"])
    return respond.envelope(page, "ids_only").select(F.col("returned").cast("long").alias("returned"), F.col("tokens").cast("long").alias("tokens"), "warning")


@query(f"WITH {sql_hybrid(20)} SELECT 'Rank: ' || rank || chr(10) || 'Score: ' || format('{{:.3f}}', score) || chr(10) || 'Source: doc' || id || '.md' || chr(10) || 'Category: ' || h.source || chr(10) || 'Context: ' || h.source || ' > ' || h.lang || chr(10) || 'Chunk: ' || (id % 3 + 1) || '/3' || chr(10) || chr(10) || 'Text: ' || CASE WHEN len(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS shown FROM h JOIN documents ON doc_id = id")
def results_as_text(spark: SparkSession, d: str) -> DataFrame:
    found = hybrid.hybrid_search(chunks(spark, d), QUERY, first_vector(spark, d), 20, strategy="hybrid", as_of=AS_OF, index=partial(text_indexed, spark, d))
    return found.select(respond.as_text(F.col("hybrid_score"), with_metadata=False).alias("shown"))


@query(f"WITH {sql_hybrid(40)} SELECT id AS chunk_id, CAST(trunc(100 * (1 - (rank() OVER (ORDER BY round(score, 14) DESC) - 1) / CAST(count(*) OVER () AS DOUBLE))) AS INTEGER) AS percentile FROM h")
def page_percentiles(spark: SparkSession, d: str) -> DataFrame:
    found = hybrid.hybrid_search(chunks(spark, d), QUERY, first_vector(spark, d), 40, strategy="hybrid", as_of=AS_OF, index=partial(text_indexed, spark, d))
    return found.withColumn("score", F.round("hybrid_score", 14)).select("chunk_id", respond.percentile_int(F.col("score")).alias("percentile"))


@query()
def search_reranked(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.reranked_search(chunks(spark, d), QUERY, first_vector(spark, d), 10, as_of=AS_OF, index=partial(text_indexed, spark, d)).select("chunk_id", "confidence", "rank")


@query("SELECT conv_id, turn, CAST((len(lower(text)) - len(replace(lower(text), ' and ', ''))) // 5 + (len(lower(text)) - len(replace(lower(text), ' or ', ''))) // 4 + (len(lower(text)) - len(replace(lower(text), ' not ', ''))) // 5 + len(text) - len(replace(text, '\"', '')) AS INTEGER) AS operators, CAST(len([x FOR x IN string_split_regex(text, '\\s+') IF regexp_matches(x, '^[A-Z]')]) AS INTEGER) AS entities FROM conversations WHERE text IS NOT NULL")
def query_signals(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "conversations").where("text is not null").withColumn("s", routing.signals(F.col("text")))
    return rows.select("conv_id", "turn", "s.operators", "s.entities")


GRADED = """r AS (SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, coalesce(quality * 2 + (1 - toxic), 0) AS grade FROM documents LEFT JOIN labels USING (doc_id)),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS best FROM r)"""


@query(f"WITH {GRADED}, s AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN grade / greatest(CAST(1 AS DOUBLE), log2(rank)) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 10 THEN grade / greatest(CAST(1 AS DOUBLE), log2(best)) ELSE 0 END) AS idcg, count(*) FILTER (rank <= 10 AND grade > 0) AS hits, least(10, count(*)) AS shown, count(*) FILTER (grade > 0) AS relevant FROM i GROUP BY query_id) SELECT query_id, round(dcg / idcg, 8) AS ndcg, round(hits / CAST(shown AS DOUBLE), 8) AS precision, round(hits / CAST(relevant AS DOUBLE), 8) AS recall, round(CASE WHEN hits = 0 THEN 0 ELSE 2 * CAST(hits AS DOUBLE) / (shown + relevant) END, 8) AS f1 FROM s WHERE relevant > 0")
def graded_metrics(spark: SparkSession, d: str) -> DataFrame:
    grades = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left").select(F.col("lang").alias("query_id"), "doc_id", "n_chars", F.coalesce(F.col("quality") * 2 + 1 - F.col("toxic"), F.lit(0)).alias("grade"))
    found = metrics.graded(grades, "n_chars", "doc_id")
    return found.select("query_id", *[r8(c).alias(c) for c in ("ndcg", "precision", "recall", "f1")])
