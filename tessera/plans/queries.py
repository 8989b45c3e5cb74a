"""Registered queries over the given tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import english
from tessera.functions import text as tx
from tessera.functions import vectors as vx
from tessera.operators import boost, documents, filters, fusion, graph, markdown, metrics, order, rerank, respond, routing, search, sql_functions, text_index, vector_index
from tessera.plans.registry import query, r8
from tessera.sources import graph_tables as gt
from tessera.sources import sinks, stored
from tessera.streaming import state

t = gt.table


# Vector search. The query vector is that of vec_id 0, a scalar subquery of one row.
VEC = "[CAST(x AS DOUBLE) FOR x IN {}]"
SIMILAR = f"list_cosine_similarity({VEC.format('e.embedding')}, {VEC.format('q.embedding')})"


def first_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector of vec_id 0; none, to which nothing is near, if there is no such row."""
    row = t(spark, d, "embeddings").where("vec_id = 0 and embedding is not null").first()
    return row["embedding"] if row else []


@query(f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), s AS (SELECT e.vec_id, {SIMILAR} AS c FROM embeddings e, q) SELECT vec_id, round(greatest(0, least(1, c)), 8) AS similarity, CAST(row_number() OVER (ORDER BY c DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10")
def vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    return search.vector_search(t(spark, d, "embeddings"), first_vector(spark, d)).select("vec_id", r8("similarity").alias("similarity"), "rank")


@query(f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), s AS (SELECT e.vec_id, list_distance({VEC.format('e.embedding')}, {VEC.format('q.embedding')}) AS c FROM embeddings e, q) SELECT vec_id, round(c, 8) AS distance, round(greatest(0, least(1, 1 - c)), 8) AS similarity, CAST(row_number() OVER (ORDER BY c, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20")
def vector_l2(spark: SparkSession, d: str) -> DataFrame:
    return search.vector_search(t(spark, d, "embeddings"), first_vector(spark, d), 20, "l2").select("vec_id", r8("distance").alias("distance"), r8("similarity").alias("similarity"), "rank")


@query(f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), s AS (SELECT e.vec_id, -list_dot_product({VEC.format('e.embedding')}, {VEC.format('q.embedding')}) AS c FROM embeddings e, q) SELECT vec_id, round(c, 8) AS distance, round(greatest(0, least(1, 1 - c)), 8) AS similarity, CAST(row_number() OVER (ORDER BY c, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20")
def vector_inner_product(spark: SparkSession, d: str) -> DataFrame:
    return search.vector_search(t(spark, d, "embeddings"), first_vector(spark, d), 20, "inner_product").select("vec_id", r8("distance").alias("distance"), r8("similarity").alias("similarity"), "rank")


@query(f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), s AS (SELECT e.vec_id, e.label, {SIMILAR} AS c FROM embeddings e, q WHERE e.label = 3) SELECT vec_id, label, round(greatest(0, least(1, c)), 8) AS similarity, CAST(row_number() OVER (ORDER BY c DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10")
def vector_filtered(spark: SparkSession, d: str) -> DataFrame:
    return search.vector_search(t(spark, d, "embeddings"), first_vector(spark, d), where=F.col("label") == 3).select("vec_id", "label", r8("similarity").alias("similarity"), "rank")


@query(f"WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.query_id, e.vec_id, {SIMILAR} AS c FROM embeddings e, q) SELECT query_id, vec_id, round(1 - c, 8) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10")
def vector_batch(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return search.batch_search(e, asked).select("query_id", "vec_id", r8("distance").alias("distance"), "rank")


@query(f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 7), s AS (SELECT e.vec_id, {SIMILAR} AS c FROM embeddings e, q) SELECT vec_id, round(greatest(0, least(1, c)), 8) AS similarity, CAST(row_number() OVER (ORDER BY c DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 25")
def vector_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The exact search over a stored index, whose partitions are left out by their radii."""
    source = f"{d}/embeddings.parquet"
    place = stored.stored(spark, "vectors", [source], lambda to: vector_index.build(spark.read.parquet(source), to))
    asked = spark.read.parquet(source).where("vec_id = 7").select("embedding").collect()
    index = vector_index.VectorIndex.open(spark, place)
    return vector_index.search(index, asked[0]["embedding"] if asked else [], 25).select("vec_id", r8("similarity").alias("similarity"), "rank")


COPIED = """p AS (SELECT lang AS query_id, doc_id, text, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents QUALIFY rank <= 20), v AS (SELECT query_id, doc_id, text, rank, embedding FROM p JOIN embeddings ON vec_id = doc_id),
pages AS (SELECT query_id, doc_id, rank, text, embedding FROM v UNION ALL SELECT query_id, doc_id + 1000000, rank + 20, replace(text, ' ', '  ') || '  ', NULL FROM v WHERE rank % 3 = 0 UNION ALL SELECT query_id, doc_id + 2000000, rank + 20, 'other', [2 * x FOR x IN embedding] FROM v WHERE rank % 3 = 1)"""


@query(f"WITH {COPIED}, h AS (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS content FROM pages) SELECT a.doc_id, coalesce(min(b.rank), 0) AS duplicate_of FROM h a LEFT JOIN h b ON a.query_id = b.query_id AND b.rank < a.rank AND (a.content = b.content OR list_cosine_similarity({VEC.format('a.embedding')}, {VEC.format('b.embedding')}) >= 0.95) GROUP BY a.query_id, a.doc_id, a.rank")
def page_content_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Pages with planted copies: texts with wider spaces without vector, and other texts with the same direction."""
    by = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    top = t(spark, d, "documents").withColumn("rank", F.row_number().over(by)).where("rank <= 20").select(F.col("lang").alias("query_id"), "doc_id", "text", "rank")
    v = top.join(t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").select("query_id", "doc_id", "rank", "text", "embedding")
    loud = v.where("rank % 3 = 0").selectExpr("query_id", "doc_id + 1000000 as doc_id", "rank + 20 as rank", "replace(text, ' ', '  ') || '  ' as text", "cast(null as array<float>) as embedding")
    turned = v.where("rank % 3 = 1").selectExpr("query_id", "doc_id + 2000000 as doc_id", "rank + 20 as rank", "'other' as text", "transform(embedding, x -> cast(2 * x as float)) as embedding")
    return respond.content_duplicates(v.unionByName(loud).unionByName(turned)).select("doc_id", F.coalesce("duplicate_of", F.lit(0)).alias("duplicate_of"))


@query("SELECT count(*) AS n, count(embedding) AS with_vector, count(DISTINCT label) AS categories FROM embeddings")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").agg(F.count("*").alias("n"), F.count("embedding").alias("with_vector"), F.countDistinct("label").alias("categories"))


@query("SELECT vec_id, len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AS valid FROM embeddings")
def vector_valid(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select("vec_id", vx.valid(F.col("embedding"), 64).alias("valid"))


@query("SELECT vec_id, len(embedding) AS n, true AS same FROM embeddings WHERE embedding IS NOT NULL")
def vector_text_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The text form of every vector, read back, is the vector."""
    back = F.from_json(vx.vector_text(F.col("embedding")), "array<float>")
    return t(spark, d, "embeddings").where("embedding is not null").select("vec_id", F.size(back).cast("long").alias("n"), (back == F.col("embedding")).alias("same"))


@query()
def vector_text(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select("vec_id", vx.vector_text(F.col("embedding")).alias("vector"))


# Full-text search, simple profile, over a stored index that the first of these queries writes.
def text_indexed(spark: SparkSession, d: str, profile: str = "simple") -> text_index.TextIndex:
    source = f"{d}/documents.parquet"
    return text_index.TextIndex.open(spark, stored.stored(spark, f"text-{profile}", [source], lambda to: text_index.build(spark.read.parquet(source), to, profile, attributes=("source",))))


TOKS = "toks AS (SELECT doc_id, [x FOR x IN string_split_regex(lower(text), '[^a-z0-9]+') IF x <> ''] AS toks FROM documents)"
COVERS = """places AS (
  SELECT doc_id, n_tokens, pos, term FROM (SELECT doc_id, len(toks) AS n_tokens, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM toks WHERE list_contains(toks, 'with') AND list_contains(toks, 'from')) WHERE term IN ('with', 'from')
), latest AS (
  SELECT doc_id, n_tokens, pos, max(CASE WHEN term = 'with' THEN pos END) OVER w AS a, max(CASE WHEN term = 'from' THEN pos END) OVER w AS b FROM places WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), covers AS (
  SELECT doc_id, n_tokens, least(a, b) AS begin_, min(pos) AS end_ FROM latest WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL
), scored AS (
  SELECT doc_id, n_tokens, sum(CAST(1 AS DOUBLE) / (end_ - begin_ + 1)) / (1 + ln(CAST(n_tokens AS DOUBLE))) / n_tokens AS score FROM covers GROUP BY doc_id, n_tokens
)"""


@query(f"WITH {TOKS}, {COVERS} SELECT doc_id, CAST(n_tokens AS INTEGER) AS n_tokens, round(score, 8) AS score, CAST(row_number() OVER (ORDER BY round(score, 12) DESC, doc_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 10")
def text_cover_density(spark: SparkSession, d: str) -> DataFrame:
    return text_index.text_search(text_indexed(spark, d), "with from", 10).withColumn("score", r8("score"))


@query(f"WITH {TOKS.replace('FROM documents', "FROM documents WHERE source = 'src3'")}, {COVERS} SELECT doc_id, round(score, 8) AS score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score >= 0.00001 QUALIFY rank <= 5")
def text_category(spark: SparkSession, d: str) -> DataFrame:
    return text_index.text_search(text_indexed(spark, d), "with from", 5, F.col("source") == "src3", 0.00001).select("doc_id", r8("score").alias("score"), "rank")


@query(f"WITH {TOKS}, p AS (SELECT doc_id, toks, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM toks), h AS (SELECT doc_id, len(toks) AS n_tokens, count(*) AS hits FROM p WHERE term = 'of' AND toks[pos + 1] = 'the' GROUP BY ALL) SELECT doc_id, CAST(hits AS INTEGER) AS hits, round(CAST(hits AS DOUBLE) / n_tokens, 8) AS score, CAST(row_number() OVER (ORDER BY CAST(hits AS DOUBLE) / n_tokens DESC, doc_id) AS INTEGER) AS rank FROM h QUALIFY rank <= 10")
def text_phrase(spark: SparkSession, d: str) -> DataFrame:
    return text_index.phrase_search(text_indexed(spark, d), "of the").select("doc_id", "hits", r8("score").alias("score"), "rank")


@query(f"""WITH {TOKS}, c AS (SELECT doc_id, len(toks) AS n, len([x FOR x IN toks IF x = 'worthless']) AS a, len([x FOR x IN toks IF x = 'from']) AS b FROM toks WHERE len(toks) > 0),
s AS (SELECT count(*) AS n_docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c),
r AS (SELECT doc_id, ln(1 + (n_docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (n_docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)) AS score FROM c, s WHERE a > 0 OR b > 0)
SELECT doc_id, round(CAST(score AS DOUBLE), 7) AS score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r QUALIFY rank <= 10""")
def text_bm25(spark: SparkSession, d: str) -> DataFrame:
    return text_index.bm25_search(text_indexed(spark, d), "worthless from").select("doc_id", F.round("score", 7).alias("score"), "rank")


@query(f"WITH {TOKS} SELECT doc_id, len(toks) AS n_tokens, len(list_distinct(toks)) AS n_lexemes FROM toks")
def text_lexemes(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", tx.tokens(F.col("text")).alias("k")).select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.size(F.array_distinct("k")).cast("long").alias("n_lexemes"))


# The English profile: stop words out, stems by the same rules in both engines.
STOP_SQL = "('" + "','".join(sorted(english.STOP_WORDS)) + "')"
ENGLISH = f"""each AS (SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM (SELECT doc_id, [x FOR x IN string_split_regex(lower(text), '[^a-z0-9]+') IF x <> ''] AS toks FROM documents)), left_ AS (SELECT * FROM each WHERE token NOT IN {STOP_SQL}), {english.duckdb_sql("left_")},
e AS (SELECT doc_id, pos, stem AS term FROM left_ JOIN stems USING (token)), sizes AS (SELECT doc_id, count(*) AS n_tokens FROM e GROUP BY doc_id)"""


@query(f"""WITH {ENGLISH}, places AS (SELECT doc_id, pos, term FROM e WHERE term IN ('onli', 'hous')), latest AS (SELECT doc_id, pos, max(CASE WHEN term = 'onli' THEN pos END) OVER w AS a, max(CASE WHEN term = 'hous' THEN pos END) OVER w AS b FROM places WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
covers AS (SELECT doc_id, least(a, b) AS begin_, min(pos) AS end_ FROM latest WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL), scored AS (SELECT doc_id, n_tokens, sum(CAST(1 AS DOUBLE) / (end_ - begin_ + 1)) / (1 + ln(CAST(n_tokens AS DOUBLE))) / n_tokens AS score FROM covers JOIN sizes USING (doc_id) GROUP BY doc_id, n_tokens)
SELECT doc_id, CAST(n_tokens AS INTEGER) AS n_tokens, round(score, 8) AS score, CAST(row_number() OVER (ORDER BY round(score, 12) DESC, doc_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 20""")
def text_english(spark: SparkSession, d: str) -> DataFrame:
    return text_index.text_search(text_indexed(spark, d, "english"), "only the houses", 20).withColumn("score", r8("score"))


@query(f"""WITH {ENGLISH}, h AS (SELECT a.doc_id, count(*) AS hits FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.pos = a.pos + 3 WHERE a.term = 'licens' AND b.term = 'apach' GROUP BY a.doc_id)
SELECT doc_id, CAST(n_tokens AS INTEGER) AS n_tokens, round(hits / CAST(n_tokens AS DOUBLE), 8) AS similarity, CAST(row_number() OVER (ORDER BY hits / CAST(n_tokens AS DOUBLE) DESC, doc_id) AS INTEGER) AS rank FROM h JOIN sizes USING (doc_id) QUALIFY rank <= 30""")
def text_phrase_sql(spark: SparkSession, d: str) -> DataFrame:
    """A phrase by the table function of Spark SQL."""
    sql_functions.register(text_indexed(spark, d, "english"), "search_documents")
    return spark.sql("SELECT doc_id, n_tokens, round(similarity, 8) AS similarity, rank FROM search_documents_phrase('licensed under the Apache', 30)")


@query(f"WITH {ENGLISH} SELECT token, stem FROM stems")
def text_stems(spark: SparkSession, d: str) -> DataFrame:
    words = t(spark, d, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("token")).where(~F.col("token").isin(sorted(english.STOP_WORDS))).distinct()
    return english.stemmed(words)


# Fusion. The arms are the vector and text top lists, keyed by doc_id = vec_id.
ARMS = f"""q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), {TOKS}, {COVERS},
v AS (SELECT vec_id AS id, {SIMILAR} AS score, row_number() OVER (ORDER BY {SIMILAR} DESC, vec_id) AS rank FROM embeddings e, q QUALIFY rank <= 200),
x AS (SELECT doc_id AS id, score, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 200)"""


def arms(spark: SparkSession, d: str, k: int = 200) -> tuple[DataFrame, DataFrame]:
    v = search.vector_search(t(spark, d, "embeddings"), first_vector(spark, d), k).select(F.col("vec_id").alias("id"), "similarity", "rank")
    return v, text_index.text_search(text_indexed(spark, d), "with from", k).select(F.col("doc_id").alias("id"), "score", "rank")


FUSED = f"{ARMS}, f AS (SELECT id, sum(w) AS score FROM (SELECT id, CAST(0.6 AS DOUBLE) / (60 + rank) AS w FROM v UNION ALL SELECT id, CAST(0.4 AS DOUBLE) / (60 + rank) FROM x) GROUP BY id)"


@query(f"WITH {FUSED} SELECT id, round(score, 8) AS score, CAST(row_number() OVER (ORDER BY round(score, 14) DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 50")
def fusion_rrf(spark: SparkSession, d: str) -> DataFrame:
    v, x = arms(spark, d)
    fused = fusion.rrf({"vector": (v, 0.6), "text": (x, 0.4)})
    return fused.orderBy(F.round("score", 14).desc(), "id").limit(50).withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 14).desc(), "id"))).select("id", r8("score").alias("score"), "rank")


@query(f"WITH {ARMS} SELECT id, round(sum(w), 8) AS score, round(max(c), 8) AS confidence FROM (SELECT id, CAST(0.6 AS DOUBLE) / (60 + rank) AS w, least(1, greatest(0, score)) AS c FROM v UNION ALL SELECT id, CAST(0.4 AS DOUBLE) / (60 + rank), least(1, 10 * score) FROM x) GROUP BY id")
def fusion_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Fused rows with the largest confidence of the arms."""
    v, x = arms(spark, d)
    fused = fusion.rrf({"vector": (v.withColumn("confidence", F.col("similarity")), 0.6), "text": (x.withColumn("confidence", F.least(F.lit(1.0), 10 * F.col("score"))), 0.4)})
    return fused.select("id", r8("score").alias("score"), r8("confidence").alias("confidence"))


@query(f"WITH {ARMS}, z AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 100) SELECT id, round(sum(w), 8) AS score FROM (SELECT id, CAST(1 AS DOUBLE) / 3 / (60 + rank) AS w FROM v UNION ALL SELECT id, CAST(1 AS DOUBLE) / 3 / (60 + rank) FROM x UNION ALL SELECT id, CAST(1 AS DOUBLE) / 3 / (60 + rank) FROM z) GROUP BY id")
def fusion_multiple(spark: SparkSession, d: str) -> DataFrame:
    v, x = arms(spark, d)
    z = search.ranked(t(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(100), F.desc("n_chars"), F.col("doc_id")).select(F.col("doc_id").alias("id"), "rank")
    return fusion.fuse_multiple({"vector": v, "text": x, "long": z}).select("id", r8("score").alias("score"))


@query(f"WITH {ARMS} SELECT v.id, round(CAST(0.6 AS DOUBLE) * (least(1, greatest(0, v.score)) + 1) / 2 + CAST(0.4 AS DOUBLE) * least(1, x.score / 10), 8) AS hybrid FROM v JOIN x USING (id)")
def fusion_linear(spark: SparkSession, d: str) -> DataFrame:
    v, x = arms(spark, d)
    both = v.select("id", "similarity").join(x.select("id", "score"), "id")
    return both.select("id", r8(fusion.linear(fusion.normal_vector(F.col("similarity")), fusion.normal_text(F.col("score")))).alias("hybrid"))


@query(f"WITH {ARMS}, u AS (SELECT id, rank, 0 AS arm FROM v UNION ALL SELECT id, rank, 1 FROM x) SELECT id, arg_min(arm, arm * 1000 + rank) AS arm, arg_min(rank, arm * 1000 + rank) AS rank FROM u GROUP BY id")
def union_first_seen(spark: SparkSession, d: str) -> DataFrame:
    v, x = arms(spark, d)
    both = v.select("id", "rank", F.lit(0).alias("arm")).unionByName(x.select("id", "rank", F.lit(1).alias("arm")))
    return fusion.first_seen(both, "id", F.col("arm") * 1000 + F.col("rank")).select("id", "arm", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {ARMS} SELECT id FROM v INTERSECT SELECT id FROM x")
def arms_intersect(spark: SparkSession, d: str) -> DataFrame:
    v, x = arms(spark, d)
    return v.select("id").intersect(x.select("id"))


BOOSTED = f"""{FUSED}, b AS (
  SELECT f.id, least(1, f.score * (1 + CASE WHEN contains(lower(source), 'src1') THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN contains(lower(text), 'idiot') THEN CAST(0.1 AS DOUBLE) ELSE 0 END)) AS score, source, text FROM f JOIN documents ON f.id = doc_id)"""


@query(f"WITH {BOOSTED} SELECT id, source, round(score, 8) AS score, CAST(row_number() OVER (ORDER BY round(score, 14) DESC, id) AS INTEGER) AS rank FROM b QUALIFY rank <= 20")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Both arms, fusion, boosts and new ranks in one plan; the entity boost reads the text of fused rows only."""
    v, x = arms(spark, d)
    fused = fusion.rrf({"vector": (v, 0.6), "text": (x, 0.4)}).select("id", "score")
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source").join(fused, "id")
    factors = {"doc_type": F.when(F.lower("source").contains("src1"), 1.0).otherwise(0.0), "entity": boost.entity("see Idiot", F.col("text"))}
    top = rows.withColumn("score", boost.boosted(F.col("score"), factors)).withColumn("key", F.round("score", 14)).orderBy(F.desc("key"), "id").limit(20)
    return search.ranked(top, F.desc("key"), F.col("id")).select("id", "source", r8("score").alias("score"), "rank")


@query("""SELECT event_id, round(least(1, 0.5 * (1 + CASE WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') < 7 THEN CAST(0.05 AS DOUBLE) WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') < 30 THEN CAST(0.05 AS DOUBLE) * CAST(0.7 AS DOUBLE) ELSE 0 END)), 8) AS boosted FROM events""")
def boost_recency(spark: SparkSession, d: str) -> DataFrame:
    factor = boost.recency(F.col("ts").cast("date"), date(2024, 1, 30))
    return t(spark, d, "events").select("event_id", r8(boost.boosted(F.lit(0.5), {"recency": factor})).alias("boosted"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'error') OR contains(lower(text), 'exception') OR contains(lower(text), 'failure') OR contains(lower(text), 'retry') OR contains(lower(text), 'timeout') OR contains(lower(text), 'circuit breaker') OR contains(lower(text), 'fallback') OR contains(lower(text), 'debugging') OR contains(lower(text), 'troubleshoot') THEN CAST(1 AS DOUBLE) ELSE 0 END AS topic, CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'worthless') OR contains(lower(text), 'the worthless') THEN CAST(1 AS DOUBLE) ELSE 0 END AS entity FROM documents""")
def boost_topic_entity(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", boost.topic("why this timeout", F.col("text")).alias("topic"), boost.entity("The Worthless", F.col("text")).alias("entity"))


@query("SELECT s_suppkey, CAST(s_suppkey % 2 = 0 AS INTEGER) * CAST(1 AS DOUBLE) AS vendor, CASE WHEN contains(lower(s_name), 'api') THEN CAST(1 AS DOUBLE) ELSE 0 END AS doc_type FROM supplier")
def boost_vendor(spark: SparkSession, d: str) -> DataFrame:
    meta = F.to_json(F.struct(F.when(F.col("s_suppkey") % 2 == 0, "OpenAI").alias("vendor"), F.col("s_name").alias("company")))
    return t(spark, d, "supplier").select("s_suppkey", boost.vendor("gpt from openai", meta).alias("vendor"), boost.doc_type("api guide", F.col("s_name")).alias("doc_type"))


@query("SELECT s_suppkey, round(CAST(0.3 AS DOUBLE) * CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END + CAST(0.1 AS DOUBLE) * CASE WHEN contains(lower(s_name), 'api') THEN 1 ELSE 0 END + CAST(0.08 AS DOUBLE) * CASE WHEN contains(lower(s_name), 'error') OR contains(lower(s_name), 'retry') THEN 1 ELSE 0 END + CAST(0.25 AS DOUBLE) * CASE WHEN contains(s_name, '7') THEN 1 ELSE 0 END, 8) AS boost FROM supplier")
def boost_registry(spark: SparkSession, d: str) -> DataFrame:
    """The boosts of strategies by name, with a factor of one's own and a rule that is put in."""
    meta = F.to_json(F.struct(F.when(F.col("s_suppkey") % 2 == 0, "antml").alias("vendor")))
    seven = boost.Strategy("seven", lambda name: name.contains("7").cast("double"), 0.25)
    own = boost.create("vendor", 0.3).boost("news of antml", meta) + boost.create("doc_type").boost("api guide", F.col("s_name")) + boost.create("topic").boost("why this error", F.col("s_name"))
    return t(spark, d, "supplier").select("s_suppkey", r8(own + seven.boost(F.col("s_name"))).alias("boost"))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d') END AS given FROM orders")
def normal_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates of two kinds in the form that front matter gets."""
    day = F.col("o_orderdate").cast("timestamp")
    raw = F.when(F.col("o_orderkey") % 3 == 0, " \n ").otherwise(F.concat(F.lit("\t "), F.date_format(day, "yyyy-MM-dd"), F.lit(" ")))
    return t(spark, d, "orders").select("o_orderkey", markdown.normal_date(day, "timestamp").alias("at"), markdown.normal_date(raw).alias("given"))


@query()
def reranked_results(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("n_chars").cast("double").alias("score"))
    return rerank.rerank(rows, rerank.overlap_scorer("of the and with"), pool=50, k=10).select("id", "confidence", "rank")


# Routing over a table of queries: the turns of conversations.
OPS = "(len(lower(text)) - len(replace(lower(text), ' and ', ''))) // 5 + (len(lower(text)) - len(replace(lower(text), ' or ', ''))) // 4 + (len(lower(text)) - len(replace(lower(text), ' not ', ''))) // 5"
WORDS = "[x FOR x IN string_split_regex(lower(text), '\\s+') IF x <> '']"
KNOWN = "('" + "','".join(routing.TECHNICAL) + "')"
HARD = "('" + "','".join(routing.COMPLEX) + "')"
ASKING = "('" + "','".join(routing.QUESTIONS) + "')"
ROUTED = f"w AS (SELECT conv_id, turn, text, {WORDS} AS w, {OPS} AS ops, len(text) - len(replace(text, '\"', '')) AS quotes FROM conversations), a AS (SELECT *, len(w) AS n, len([x FOR x IN w IF x IN {KNOWN}]) / CAST(greatest(len(w), 1) AS DOUBLE) AS density, len([x FOR x IN w IF x IN {HARD}]) AS hard, len([x FOR x IN w IF x IN {ASKING}]) AS asks FROM w)"


@query(f"WITH {ROUTED} SELECT conv_id, turn, CASE WHEN density > 0.7 THEN 'bm25' WHEN density < 0.3 THEN 'vector' ELSE 'hybrid' END AS strategy, CASE WHEN s < 0.5 THEN 'simple' WHEN s < 1.5 THEN 'moderate' ELSE 'complex' END AS complexity, round(CAST(CASE WHEN ops + quotes > 2 THEN least(base + 0.1, 1) WHEN ops + quotes = 0 AND density < 0.3 THEN greatest(base - 0.05, 0.5) ELSE base END AS DOUBLE), 8) AS confidence FROM (SELECT *, CAST(CASE WHEN n < 3 THEN 0.2 WHEN n < 8 THEN 0.5 WHEN n < 15 THEN 1.0 ELSE 1.5 END AS DOUBLE) + ops * CAST(0.3 AS DOUBLE) + density * CAST(0.3 AS DOUBLE) + hard * CAST(0.5 AS DOUBLE) AS s, CASE WHEN density > 0.7 OR density < 0.2 THEN 0.9 WHEN asks > 0 THEN 0.85 ELSE 0.6 END AS base FROM a)")
def route_queries(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("text")
    return t(spark, d, "conversations").where(q.isNotNull()).select("conv_id", "turn", routing.strategy(q).alias("strategy"), routing.complexity_class(q).alias("complexity"), r8(routing.confidence(q)).alias("confidence"))


@query(f"WITH c AS (SELECT conv_id, turn, len(text) AS n, least(CAST(1 AS DOUBLE), len({WORDS}) / CAST(10 AS DOUBLE) * CAST(0.6 AS DOUBLE) + CASE WHEN regexp_matches(lower(text), '\\b(and|or|not)\\b') THEN CAST(0.2 AS DOUBLE) ELSE 0 END + CASE WHEN regexp_matches(text, '\"[^\"]*\"') THEN CAST(0.2 AS DOUBLE) ELSE 0 END) AS c FROM conversations) SELECT conv_id, turn, CASE WHEN n < 15 THEN 'short' WHEN n < 50 THEN 'medium' WHEN n < 100 THEN 'long' ELSE 'complex' END AS kind, round(c, 8) AS complexity, least(greatest(least(CAST(floor(50 * (1 + c * CAST(1.2 AS DOUBLE))) AS INTEGER), 100), 5), 80) AS pool FROM c")
def rerank_pools(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("text")
    rows = t(spark, d, "conversations").where(q.isNotNull()).withColumn("c", routing.pool_complexity(q))
    return rows.select("conv_id", "turn", routing.pool_type(q).alias("kind"), r8("c").alias("complexity"), routing.pool_size(F.col("c"), F.lit(80)).alias("pool"))


# Filters.
@query("SELECT event_id FROM events WHERE (event_type = 'click' AND value > 20 AND value <= 90) OR (user_id IN (1, 2, 3) AND NOT (event_type LIKE '%ur%')) OR (value BETWEEN 1 AND 2 AND props IS NOT NULL)")
def filter_tree(spark: SparkSession, d: str) -> DataFrame:
    f = filters
    tree = (f.equals("event_type", "click") & f.greater_than("value", 20) & f.less_equal("value", 90)) | (f.in_values("user_id", [1, 2, 3]) & ~f.contains("event_type", "ur")) | (f.between("value", 1, 2) & f.exists("props"))
    return tree.apply(t(spark, d, "events")).select("event_id")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '69' OR (CAST(json_extract_string(props, '$.k') AS INTEGER) >= 95 AND NOT value < 50) OR event_type IS NULL")
def filter_json(spark: SparkSession, d: str) -> DataFrame:
    f = filters
    tree = f.or_(f.jsonb_contains("props", {"k": 69}), f.and_(f.greater_equal("props.k", 95), f.not_(f.less_than("value", 50))), f.is_null("event_type"))
    return tree.apply(t(spark, d, "events")).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_orderdate IS NULL OR o_orderdate >= TIMESTAMP '1995-01-01') AND (o_orderdate IS NULL OR o_orderdate <= TIMESTAMP '1997-01-01') AND contains(o_orderpriority, 'H')")
def filter_results(spark: SparkSession, d: str) -> DataFrame:
    names = {"category": "o_orderstatus", "date": "o_orderdate", "file": "o_orderpriority"}
    return t(spark, d, "orders").where(filters.matches("F", "1995-01-01", "1997-01-01", source_file="H", names=names)).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE list_has_any([lang, source, 'all'], ['de', 'src2']) AND source <> 'src1'")
def filter_tags(spark: SparkSession, d: str) -> DataFrame:
    """Rows with any of the given tags."""
    rows = t(spark, d, "documents").withColumn("labels", F.array("lang", "source", F.lit("all")))
    return rows.where(filters.matches(tags=["de", "src2"], names={"tags": "labels"}) & (F.col("source") != "src1")).select("doc_id")


# Graph.
def g(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    x = gt.read_graph(spark, d)
    return x.nodes, x.edges, x.mentions


@query(f"WITH {gt.GRAPH_SQL} SELECT id, text, entity_type, relationship_type, e.confidence AS relationship_confidence FROM edges e JOIN nodes ON id = target WHERE source = 'S1' AND e.confidence >= 0.6 ORDER BY e.confidence DESC, id, relationship_type LIMIT 50")
def graph_one_hop(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = g(spark, d)
    return graph.one_hop(n, e, "S1", 0.6).select("id", "text", "entity_type", "relationship_type", "relationship_confidence")


HOPS = "SELECT DISTINCT target AS mid_id, relationship_type AS first_type, confidence AS c1 FROM edges WHERE source = 'C1' AND confidence >= 0.6"


@query(f"WITH {gt.GRAPH_SQL}, h AS ({HOPS}) SELECT n.id, h.mid_id, first_type, e.relationship_type AS second_type, round(sqrt(c1 * e.confidence), 8) AS path_confidence FROM h JOIN edges e ON e.source = h.mid_id JOIN nodes n ON n.id = e.target WHERE e.confidence >= 0.6 AND e.target <> 'C1' ORDER BY sqrt(c1 * e.confidence) DESC, n.id, h.mid_id, first_type, second_type LIMIT 100")
def graph_two_hop(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = g(spark, d)
    return graph.two_hop(n, e, "C1", 0.6).select("id", "mid_id", "first_type", "second_type", r8("path_confidence").alias("path_confidence"))


@query(f"WITH {gt.GRAPH_SQL}, h AS ({HOPS.replace('DISTINCT ', '').replace('0.6', '0.7')}) SELECT n.id, h.mid_id, round(c1 * e.confidence, 8) AS path_confidence FROM h JOIN edges e ON e.source = h.mid_id JOIN nodes n ON n.id = e.target WHERE e.confidence >= 0.7 AND e.target <> 'C1' ORDER BY c1 * e.confidence DESC, n.id, h.mid_id, first_type, e.relationship_type LIMIT 50")
def graph_strong_paths(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = g(spark, d)
    return graph.two_hop(n, e, "C1", 0.7, 50, distinct=False, score="product").select("id", "mid_id", r8("path_confidence").alias("path_confidence"))


@query(f"""WITH {gt.GRAPH_SQL}, o AS (SELECT target AS id, relationship_type AS t, confidence AS c FROM edges WHERE source = 'S1' AND confidence >= 0.4), i AS (SELECT source AS id, relationship_type AS t, confidence AS c FROM edges WHERE target = 'S1' AND confidence >= 0.4),
b AS (SELECT coalesce(o.id, i.id) AS id, o.t AS ot, i.t AS it, o.c AS oc, i.c AS ic FROM o FULL OUTER JOIN i ON o.id = i.id)
SELECT b.id, entity_type, list_sort(list_distinct(coalesce(array_agg(ot) FILTER (ot IS NOT NULL), []))) AS outbound, list_sort(list_distinct(coalesce(array_agg(it) FILTER (it IS NOT NULL), []))) AS inbound, greatest(coalesce(max(oc), 0), coalesce(max(ic), 0)) AS max_confidence, count(*) AS relationship_count, CAST(1 AS INTEGER) AS min_distance
FROM b JOIN nodes n ON n.id = b.id GROUP BY b.id, entity_type ORDER BY relationship_count DESC, max_confidence DESC, b.id LIMIT 200""")
def graph_bidirectional(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = g(spark, d)
    return graph.bidirectional(n, e, "S1", 0.4, 200, gt.read_graph(spark, d).by_target).select("id", "entity_type", "outbound", "inbound", "max_confidence", "relationship_count", "min_distance")


@query(f"WITH {gt.GRAPH_SQL} SELECT id, entity_type, e.confidence AS relationship_confidence FROM edges e JOIN nodes ON id = target WHERE source = 'S1' AND e.confidence >= 0.6 AND relationship_type = 'hierarchical' AND entity_type IN ('GPE') ORDER BY e.confidence DESC, id LIMIT 50")
def graph_type_filter(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = g(spark, d)
    return graph.one_hop(n, e, "S1", 0.6, ["hierarchical"], 50, ["GPE"]).select("id", "entity_type", "relationship_confidence")


@query(f"WITH {gt.GRAPH_SQL} SELECT document_id, chunk_id, created_at, CAST(1 AS DOUBLE) AS confidence, CAST(0 AS INTEGER) AS chunk_index FROM mentions WHERE entity_id = 'P1' ORDER BY created_at DESC, document_id, chunk_id, line_key LIMIT 100")
def graph_mentions(spark: SparkSession, d: str) -> DataFrame:
    return graph.entity_mentions(g(spark, d)[2], "P1").drop("line_key")


@query(f"WITH {gt.GRAPH_SQL} SELECT DISTINCT document_id, id, text, entity_type FROM mentions JOIN nodes ON id = entity_id")
def graph_document_entities(spark: SparkSession, d: str) -> DataFrame:
    n, _, m = g(spark, d)
    return graph.entities_by_document(m, n).select("document_id", "id", "text", "entity_type")


@query(f"WITH {gt.GRAPH_SQL} SELECT b.entity_id, count(DISTINCT (b.document_id, b.chunk_id)) AS co_mentions FROM (SELECT DISTINCT document_id FROM mentions WHERE entity_id = 'P1') a JOIN mentions b ON a.document_id = b.document_id WHERE b.entity_id <> 'P1' GROUP BY b.entity_id ORDER BY co_mentions DESC, b.entity_id LIMIT 100")
def graph_co_mentions(spark: SparkSession, d: str) -> DataFrame:
    x = gt.read_graph(spark, d)
    return graph.co_mentioned(x.mentions, "P1", by_document=x.by_document)


@query(f"WITH {gt.GRAPH_SQL} SELECT id, text, confidence FROM nodes WHERE lower(text) = (SELECT lower(s_name) FROM supplier WHERE s_suppkey = 1) AND entity_type = 'ORG' ORDER BY confidence DESC, id LIMIT 2")
def graph_vendor_lookup(spark: SparkSession, d: str) -> DataFrame:
    return graph.lookup(g(spark, d)[0], gt.supplier_name(spark, d, 1)).select("id", "text", "confidence")


@query(f"WITH {gt.GRAPH_SQL}, h AS (SELECT entity_type, relationship_type FROM edges e JOIN nodes ON id = target WHERE source = 'S1' AND e.confidence >= 0.6 ORDER BY e.confidence DESC, id, relationship_type LIMIT 1000) SELECT 'entity' AS kind, entity_type AS name, count(*) AS n FROM h GROUP BY ALL UNION ALL SELECT 'relationship', relationship_type, count(*) FROM h GROUP BY ALL")
def graph_vendor_stats(spark: SparkSession, d: str) -> DataFrame:
    n, e, _ = g(spark, d)
    hop = graph.one_hop(n, e, "S1", 0.6, most=1000)
    both = [graph.type_counts(hop, c).select(F.lit(k).alias("kind"), F.explode("counts").alias("name", "n")) for k, c in (("entity", "entity_type"), ("relationship", "relationship_type"))]
    return both[0].unionByName(both[1])


@query(f"WITH {gt.GRAPH_SQL} SELECT relationship_type, string_agg(DISTINCT substr(source, 1, 1), ', ' ORDER BY substr(source, 1, 1)) AS sources, count(*) FILTER (confidence > 1) AS invalid, count(*) AS n FROM edges GROUP BY relationship_type")
def graph_type_report(spark: SparkSession, d: str) -> DataFrame:
    by = F.substring("source", 1, 1)
    return g(spark, d)[1].groupBy("relationship_type").agg(F.array_join(F.sort_array(F.collect_set(by)), ", ").alias("sources"), F.count_if(F.col("confidence") > 1).alias("invalid"), F.count("*").alias("n"))


@query(f"WITH {gt.GRAPH_SQL} SELECT id, text FROM nodes WHERE entity_type = 'PRODUCT' ORDER BY id LIMIT 100")
def graph_type_scan(spark: SparkSession, d: str) -> DataFrame:
    return g(spark, d)[0].where("entity_type = 'PRODUCT'").orderBy("id").limit(100).select("id", "text")


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 1 HOUR ORDER BY ts DESC, event_id LIMIT 1000")
def incremental_sync(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").where(F.col("ts") > F.expr("timestamp'2024-01-29 00:00:00' - interval 1 hour")).orderBy(F.desc("ts"), "event_id").limit(1000).select("event_id", "ts")


# Documents.
@query("""WITH p AS (SELECT doc_id, [x FOR x IN [trim(y) FOR y IN string_split(text, chr(10))] IF x <> ''] AS p FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(len(p) AS INTEGER) AS total_chunks, sha256(c) AS chunk_hash FROM (SELECT doc_id, p, unnest(p) AS c, generate_subscripts(p, 1) - 1 AS i FROM p)""")
def chunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return documents.paragraphs(t(spark, d, "documents")).select("doc_id", "chunk_index", "total_chunks", "chunk_hash")


@query("""WITH n AS (SELECT doc_id, len([x FOR x IN string_split_regex(text, '\\s+') IF x <> '']) AS n FROM documents), c AS (SELECT doc_id, n, CASE WHEN n <= 512 THEN 1 ELSE 1 + CAST(ceil((n - 512) / CAST(462 AS DOUBLE)) AS BIGINT) END AS total FROM n WHERE n > 0), w AS (SELECT doc_id, n, total, unnest(range(total)) AS i FROM c)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(total AS INTEGER) AS total_chunks, CAST(i * 462 AS INTEGER) AS start, CAST(least(i * 462 + 512, n) AS INTEGER) AS "end", CAST(CASE WHEN i = 0 THEN 0 ELSE least(50, least(i * 462 + 512, n) - i * 462) END AS INTEGER) AS overlap_tokens FROM w""")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return documents.windows(t(spark, d, "documents")).select("doc_id", "chunk_index", "total_chunks", "start", "end", "overlap_tokens")


@query()
def chunk_characters(spark: SparkSession, d: str) -> DataFrame:
    return documents.char_chunks(t(spark, d, "documents")).select("doc_id", "chunk_index", F.length("chunk_text").alias("chars"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[.!?]+\\s+')) + CASE WHEN regexp_replace(text, '^.*[.!?]+\\s+', '', 's') <> '' THEN 1 ELSE 0 END AS INTEGER) AS sentences FROM documents")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", documents.sentence_count(F.col("text")).alias("sentences"))


@query("SELECT doc_id, concat_ws(chr(10), '[Document: Doc ' || doc_id || '] [Author: ' || source || '] [Tags: ' || lang || ', doc]', '[Context: ' || source || ' > ' || lang || ']', '---') AS header, 'Chunk ' || (doc_id % 7 + 1) || ' of 7 (' || CAST(floor((doc_id % 7 + 1) * 100 / 7) AS INTEGER) || '%)' AS place FROM documents")
def context_headers(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    header = documents.context_header(F.concat(F.lit("Doc "), c("doc_id").cast("string")), c("source"), F.lit(None).cast("string"), F.array("lang", F.lit("doc")), F.array("source", "lang"), F.lit(None).cast("string"))
    return t(spark, d, "documents").select("doc_id", header.alias("header"), documents.position_label(c("doc_id") % 7, F.lit(7)).alias("place"))


@query("SELECT doc_id, array_to_string(string_split_regex(trim(text), '\\s+')[1:26], ' ') AS summary FROM documents")
def summaries(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", documents.summary(F.col("text")).alias("summary"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1)) AS n_links, array_to_string(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1), ' ') AS links FROM pages")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", F.size(documents.links(F.col("html"))).cast("long").alias("n_links"), F.array_join(documents.links(F.col("html")), " ").alias("links"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", documents.page_text(F.col("html")).alias("text"))


def cleaned(text: str) -> str:
    """Nested regexp_replace calls that clean Markdown."""
    for pattern, into in ((r"(?s)```.*?```", ""), (r"`([^`]*)`", r"\1"), (r"!?\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\*\*([^*]+)\*\*", r"\1"), (r"__([^_]+)__", r"\1"), (r"\*([^*\n]+)\*", r"\1"), (r"(?s)<[^>]+>", ""), (r"(?m)^\s*(?:[-*_]\s*){3,}$", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        text = f"regexp_replace({text}, '{pattern}', '{into}', 'g')"
    return f"trim({text})"


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), f AS (SELECT *, sum(CAST(starts_with(x, '```') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) % 2 AS fenced FROM l),
h AS (SELECT doc_id, CAST(count(*) FILTER (fenced = 0 AND regexp_matches(x, '^#{{1,6}}\s+\S')) AS INTEGER) AS headings FROM f GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN regexp_extract(text, '(?m)^#{{1,6}}[ \t]+(\S[^\n]*)$', 1) = '' THEN 'Untitled' ELSE trim(regexp_extract(text, '(?m)^#{{1,6}}[ \t]+(\S[^\n]*)$', 1)) END AS title, headings, CAST(len({cleaned('text')}) AS INTEGER) AS clean_chars FROM documents d JOIN h ON h.doc_id = d.doc_id""")
def markdown_parts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return t(spark, d, "documents").select("doc_id", documents.title(c).alias("title"), F.size(documents.headings(c)).alias("headings"), F.length(documents.clean_markdown(c)).alias("clean_chars"))


@query()
def embedded_documents(spark: SparkSession, d: str) -> DataFrame:
    return documents.embed(t(spark, d, "documents").where(F.trim("text") != "").select("doc_id", "text")).select("doc_id", "embedding")


@query("SELECT o_orderkey, CAST(CASE WHEN n = 0 THEN 1 WHEN n <= 100 THEN least(n, 32) WHEN n <= 1000 THEN least(n // 10, 32) ELSE 32 END AS INTEGER) AS batch FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 100) AS INTEGER) AS n FROM orders)")
def batch_sizes(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", documents.batch_size(F.floor(F.col("o_totalprice") / 100).cast("int"), 32).cast("int").alias("batch"))


# Ingest.
CHUNKS = "SELECT doc_id, sha256(coalesce(text, '')) AS chunk_hash, n_chars FROM documents"


def hashed(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("chunk_hash"), "n_chars")


@query(f"WITH c AS ({CHUNKS}), old AS (SELECT DISTINCT chunk_hash FROM c WHERE doc_id % 3 = 0) SELECT DISTINCT chunk_hash FROM c WHERE chunk_hash NOT IN (SELECT chunk_hash FROM old)")
def insert_absent(spark: SparkSession, d: str) -> DataFrame:
    c = hashed(spark, d)
    return sinks.insert_if_absent(c.where("doc_id % 3 = 0").dropDuplicates(["chunk_hash"]), c, "chunk_hash").select("chunk_hash")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 100 ELSE p_size END AS p_size, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'updated' WHEN p_partkey % 3 = 0 THEN 'inserted' ELSE 'kept' END AS action FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def upsert_parts(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_partkey", "p_size")
    return sinks.upsert(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 3 = 0").withColumn("p_size", F.col("p_size") + 100), "p_partkey")


@query("WITH o AS (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0) SELECT (SELECT count(*) FROM n WHERE p_partkey NOT IN (SELECT p_partkey FROM o)) AS inserted, (SELECT count(*) FROM n WHERE p_partkey IN (SELECT p_partkey FROM o)) AS updated, (SELECT count(*) FROM o WHERE p_partkey NOT IN (SELECT p_partkey FROM n)) AS kept, CAST(0 AS BIGINT) AS repeated")
def upsert_counts(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_partkey")
    return sinks.upsert_stats(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 3 = 0"), "p_partkey")


@query("SELECT source, count(*) AS documents, count(*) FILTER (text IS NULL OR trim(text) = '') AS empty, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM documents GROUP BY source")
def ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    empty = F.col("text").isNull() | (F.trim("text") == "")
    return t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(empty).alias("empty"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


# Metrics: documents of each language ranked by length, relevant where labelled of quality.
RANKED = "r AS (SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, coalesce(quality, 0) = 1 AS relevant, n_chars FROM documents LEFT JOIN labels USING (doc_id)), n AS (SELECT query_id, count(*) FILTER (relevant) AS n FROM r GROUP BY query_id)"


def ranked_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return docs.select(F.col("lang").alias("query_id"), "doc_id", rank.alias("rank"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("relevant"), "n_chars")


@query(f"""WITH {RANKED}, h AS (SELECT *, sum(CAST(relevant AS INTEGER)) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM r),
m AS (SELECT query_id, sum(CASE WHEN relevant AND rank <= 10 THEN 1 / (1 + log2(rank)) ELSE 0 END) AS dcg, 1 / min(CASE WHEN relevant THEN CAST(rank AS DOUBLE) END) AS mrr, sum(CASE WHEN relevant AND rank <= 10 THEN 1 ELSE 0 END) / CAST(10 AS DOUBLE) AS p, sum(CASE WHEN relevant THEN CAST(hits AS DOUBLE) / rank ELSE 0 END) AS ap FROM h GROUP BY query_id),
i AS (SELECT query_id, n, list_sum([1 / (1 + log2(x)) FOR x IN range(1, least(n, 10) + 1)]) AS idcg FROM n WHERE n > 0)
SELECT query_id, round(dcg / idcg, 8) AS ndcg, round(mrr, 8) AS mrr, round(p, 8) AS precision, round(ap / n, 8) AS map, round(CAST(0.4 AS DOUBLE) * dcg / idcg + CAST(0.3 AS DOUBLE) * mrr + CAST(0.3 AS DOUBLE) * p, 8) AS composite FROM m JOIN i USING (query_id)""")
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = ranked_docs(spark, d)
    truth = r.groupBy("query_id").agg(F.count_if("relevant").alias("n_relevant"))
    m = metrics.ranking_metrics(r, truth)
    return m.select("query_id", *[r8(c).alias(c) for c in ("ndcg", "mrr", "precision", "map", "composite")])


@query(f"WITH {RANKED} SELECT count(*) AS queries, round(avg(precision), 8) AS precision FROM (SELECT query_id, sum(CASE WHEN relevant AND rank <= 10 THEN 1 ELSE 0 END) / CAST(10 AS DOUBLE) AS precision FROM r GROUP BY query_id)")
def metric_averages(spark: SparkSession, d: str) -> DataFrame:
    r = ranked_docs(spark, d)
    m = metrics.ranking_metrics(r, r.groupBy("query_id").agg(F.count_if("relevant").alias("n_relevant")))
    return metrics.averages(m, ["precision"]).select("queries", r8("precision").alias("precision"))


@query("WITH r AS (SELECT lang AS query_id, n_chars AS score, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents), l AS (SELECT *, lag(score) OVER (PARTITION BY query_id ORDER BY rank) AS before FROM r) SELECT query_id, count(*) AS n, min(rank) = 1 AND max(rank) = count(*) AND count(DISTINCT rank) = count(*) AS ranks_valid, bool_and(before IS NULL OR score <= before) AS sorted FROM l GROUP BY query_id")
def rank_order(spark: SparkSession, d: str) -> DataFrame:
    placed = order.places(t(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("n_chars").alias("score"), "doc_id"), "doc_id", "place", ("query_id",))
    return metrics.order_check(placed.withColumn("rank", F.col("place") + 1), "score")


@query(f"WITH {RANKED}, a AS (SELECT query_id, doc_id, rank AS x, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS y FROM r) SELECT query_id, round(1 - 6 * CAST(sum((x - y) * (x - y)) AS DOUBLE) / (count(*) * (CAST(count(*) AS DOUBLE) * count(*) - 1)), 8) AS correlation FROM a GROUP BY query_id")
def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    r = ranked_docs(spark, d)
    by_id = r.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    return metrics.spearman(r, by_id, "doc_id").select("query_id", r8("correlation").alias("correlation"))


@query(f"WITH {RANKED}, l AS (SELECT query_id, doc_id, lead(doc_id) OVER (PARTITION BY query_id ORDER BY rank) AS after FROM r) SELECT query_id, round(1 - count(*) FILTER (doc_id < after) / (count(*) - CAST(1 AS DOUBLE)), 8) AS quality FROM l GROUP BY query_id")
def rank_inversions(spark: SparkSession, d: str) -> DataFrame:
    return metrics.inversions(ranked_docs(spark, d), "doc_id").select("query_id", r8("quality").alias("quality"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS deviation, max(CASE WHEN i = least(CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT), n - 1) THEN value END) AS p95, max(CASE WHEN i = least(CAST(floor(n * CAST(0.99 AS DOUBLE)) AS BIGINT), n - 1) THEN value END) AS p99 FROM r GROUP BY event_type")
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.latency(t(spark, d, "events"), "value", "event_type")
    return m.select("event_type", "n", "low", "high", *[F.round(c, 6).alias(c) for c in ("mean", "median", "deviation")], "p95", "p99")


@query("SELECT w.w AS weight, d.lang AS query_id, round(sum(least(1, (0.5 + CAST(d.n_chars % 100 AS DOUBLE) / 1000) * (1 + w.w * CASE WHEN contains(lower(d.text), 'from') THEN 1 ELSE 0 END))), 6) AS total FROM documents d, (SELECT CAST(unnest([0, 5, 10, 15, 20, 25, 30]) AS DOUBLE) / 100 AS w) w GROUP BY ALL")
def weight_sweep(spark: SparkSession, d: str) -> DataFrame:
    """One job for all weights: each row meets every point of a seven-point sweep."""
    rows = t(spark, d, "documents").select("lang", (0.5 + (F.col("n_chars") % 100) / 1000.0).alias("base"), F.lower("text").contains("from").cast("int").alias("hit"))
    points = rows.withColumn("weight", F.explode(F.array(*[F.lit(w) / 100.0 for w in range(0, 35, 5)])))
    return points.groupBy("weight", F.col("lang").alias("query_id")).agg(F.round(F.sum(vx.clamp(F.col("base") * (1 + F.col("weight") * F.col("hit")))), 6).alias("total"))


SWEPT = {"vendor": "CASE WHEN source = 'src1' THEN 1 ELSE 0 END", "entity": "CASE WHEN contains(lower(text), 'worthless') THEN 1 ELSE 0 END", "recency": "doc_id % 7 / CAST(7 AS DOUBLE)"}


@query(f"""WITH b AS (SELECT lang AS query_id, doc_id, toxic = 1 OR quality = 1 AS relevant, 0.4 + (doc_id * 37 % 101) / CAST(1000 AS DOUBLE) AS base, {", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in SWEPT.items())} FROM documents JOIN labels USING (doc_id)),
p AS (SELECT unnest(['vendor', 'entity', 'recency']) AS factor), w AS (SELECT CAST(unnest([0, 5, 10, 15, 20, 25, 30]) AS DOUBLE) / 100 AS weight),
s AS (SELECT factor, weight, query_id, doc_id, relevant, round(least(1, base * (1 + CASE WHEN factor = 'vendor' THEN weight ELSE CAST(0.15 AS DOUBLE) END * vendor + CASE WHEN factor = 'entity' THEN weight ELSE CAST(0.1 AS DOUBLE) END * entity + CASE WHEN factor = 'recency' THEN weight ELSE CAST(0.05 AS DOUBLE) END * recency)), 12) AS score FROM b, p, w),
r AS (SELECT *, row_number() OVER (PARTITION BY factor, weight, query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10),
i AS (SELECT query_id, least(10, count(*)) AS n FROM b WHERE relevant GROUP BY query_id), g AS (SELECT unnest(range(1, 11)) AS j), d AS (SELECT query_id, sum(1 / (1 + log2(j))) AS ideal FROM i JOIN g ON j <= n GROUP BY query_id),
q AS (SELECT factor, weight, query_id, sum(CASE WHEN relevant THEN 1 / (1 + log2(rank)) ELSE 0 END) / min(ideal) AS ndcg, coalesce(CAST(1 AS DOUBLE) / min(CASE WHEN relevant THEN rank END), 0) AS mrr, count(*) FILTER (relevant) / CAST(10 AS DOUBLE) AS precision FROM r JOIN d USING (query_id) GROUP BY ALL),
m AS (SELECT factor, weight, avg(ndcg) AS ndcg, avg(mrr) AS mrr, avg(precision) AS precision FROM q GROUP BY ALL), c AS (SELECT *, round(CAST(0.4 AS DOUBLE) * ndcg + CAST(0.3 AS DOUBLE) * mrr + CAST(0.3 AS DOUBLE) * precision, 12) AS composite FROM m)
SELECT factor, weight, round(ndcg, 8) AS ndcg, round(mrr, 8) AS mrr, round(precision, 8) AS precision, round(composite, 8) AS composite, row_number() OVER (PARTITION BY factor ORDER BY composite DESC, weight) = 1 AS is_best FROM c""")
def factor_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Every weight of every factor ranked in one job; the best weight of each."""
    c = F.col
    shown = {"vendor": (c("source") == "src1").cast("double"), "entity": F.lower("text").contains("worthless").cast("double"), "recency": c("doc_id") % 7 / 7.0}
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select(c("lang").alias("query_id"), c("doc_id").alias("id"), ((c("toxic") == 1) | (c("quality") == 1)).alias("relevant"), (0.4 + c("doc_id") * 37 % 101 / 1000.0).alias("base"), *[v.alias(n) for n, v in shown.items()])
    found = metrics.factor_sweep(rows, {"vendor": 0.15, "entity": 0.1, "recency": 0.05})
    return found.select("factor", "weight", *[r8(x).alias(x) for x in ("ndcg", "mrr", "precision", "composite")], "is_best")


@query("SELECT doc_id, round(least(1, sum(s)), 8) AS relevance FROM (SELECT doc_id, CASE WHEN n > 0 THEN CAST(1 AS DOUBLE) / 3 ELSE 0 END + CASE WHEN n > 1 THEN CAST(0.05 AS DOUBLE) * least(n - 1, 2) ELSE 0 END + CASE WHEN contains(substr(l, 1, 200), k) THEN CAST(0.05 AS DOUBLE) ELSE 0 END AS s FROM (SELECT doc_id, l, k, (len(l) - len(replace(l, k, ''))) // len(k) AS n FROM (SELECT doc_id, lower(text) AS l, unnest(['from', 'idiot', 'licensed']) AS k FROM documents))) GROUP BY doc_id")
def keyword_relevance(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", r8(metrics.keyword_relevance(F.col("text"), ["from", "idiot", "licensed"])).alias("relevance"))


# Responses: pages over the hundred dearest orders.
PAGE = "p AS (SELECT o_orderkey, o_orderpriority, round(o_totalprice / 1000000, 3) AS score, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 100)"


def result_page(spark: SparkSession, d: str) -> DataFrame:
    top = t(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
    return search.ranked(top, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "o_orderpriority", F.round(F.col("o_totalprice") / 1000000, 3).alias("score"), "rank")


@query(f"WITH {PAGE} SELECT o_orderkey, score, rank, round(100 * (1 - CAST(rank() OVER (ORDER BY score DESC) - 1 AS DOUBLE) / count(*) OVER ()), 6) AS percentile, CASE WHEN rank = 1 THEN 'best' WHEN rank <= 3 THEN 'top' WHEN rank <= 10 THEN 'relevant' ELSE 'other' END AS label FROM p")
def page_confidence(spark: SparkSession, d: str) -> DataFrame:
    return result_page(spark, d).select("o_orderkey", "score", "rank", F.round(respond.percentile(F.col("score")), 6).alias("percentile"), respond.rank_label(F.col("rank")).alias("label"))


@query(f"WITH {PAGE} SELECT o_orderkey, round(1 - CAST(rank() OVER (ORDER BY score DESC) - 1 AS DOUBLE) / count(*) OVER (), 8) AS score_reliability, CAST(0.9 AS DOUBLE) AS source_quality, CAST(0.85 AS DOUBLE) AS recency FROM p")
def page_confidence_parts(spark: SparkSession, d: str) -> DataFrame:
    found = result_page(spark, d).select("o_orderkey", respond.confidence(F.col("score")).alias("c"))
    return found.select("o_orderkey", r8("c.score_reliability").alias("score_reliability"), "c.source_quality", "c.recency")


@query(f"WITH {PAGE} SELECT o_orderkey, rank FROM p WHERE rank BETWEEN 21 AND 30")
def page_slice(spark: SparkSession, d: str) -> DataFrame:
    return respond.page(result_page(spark, d), 20, 10).select("o_orderkey", "rank")


@query(f"WITH {PAGE} SELECT a.o_orderkey, list_sort(coalesce(array_agg(b.o_orderkey) FILTER (b.o_orderkey IS NOT NULL), []))[1:5] AS similar_ids, coalesce(bool_or(b.rank < a.rank), false) AS is_duplicate FROM p a LEFT JOIN p b ON a.o_orderkey <> b.o_orderkey AND abs(a.score - b.score) < 1 - CAST(0.998 AS DOUBLE) GROUP BY a.o_orderkey")
def page_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return respond.similar_rows(result_page(spark, d), "o_orderkey", "score", 0.998)


@query("SELECT doc_id, CASE WHEN len(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet, CAST((doc_id % 5) * 800 + 300 AS BIGINT) AS tokens FROM documents")
def page_previews(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"), respond.token_estimate(F.col("doc_id") % 5, "preview").alias("tokens"))


# State over events.
@query()
def rate_limits(spark: SparkSession, d: str) -> DataFrame:
    return state.rate_limit(t(spark, d, "events"), limits=state.Limits(2, 5, 20))


@query()
def circuit_states(spark: SparkSession, d: str) -> DataFrame:
    return state.circuit(t(spark, d, "events").withColumn("failed", F.col("event_type") == "error"), failures=2, wait=3600.0)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begins, user_id, count(*) AS requests FROM events GROUP BY ALL")
def windowed_requests(spark: SparkSession, d: str) -> DataFrame:
    return state.windowed_counts(t(spark, d, "events")).select(F.col("window.start").alias("begins"), "user_id", "requests")
