"""Documents, chunks, headers and write-time columns beyond those of queries.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import documents, markdown
from tessera.plans.registry import query
from tessera.sources import sinks
from tessera.sources.graph_tables import table as t

c = F.col


@query(r"""WITH m AS (SELECT page_id, string_split(regexp_replace(html, '<a\s[^>]*?href="([^"]*)"[^>]*>([^<]*)</a>', '[\2](\1)', 'g'), chr(10)) AS l FROM pages),
n AS (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS line FROM m), f AS (SELECT page_id, line, unnest(regexp_extract_all(x, '\[([^\]]+)\]\(([^)]+)\)', 1)) AS text, unnest(regexp_extract_all(x, '\[([^\]]+)\]\(([^)]+)\)', 2)) AS url FROM n WHERE NOT starts_with(trim(x), '```'))
SELECT page_id, text, url, CAST(line AS INTEGER) AS line FROM f""")
def markdown_links(spark: SparkSession, d: str) -> DataFrame:
    text = F.regexp_replace("html", r'<a\s[^>]*?href="([^"]*)"[^>]*>([^<]*)</a>', "[$2]($1)")
    return t(spark, d, "pages").select("page_id", F.inline(markdown.links(text)))


@query("SELECT doc_id, 'Doc ' || doc_id AS title, source IN ('src1', 'src2') AS draft, lang || ',' || source AS tags, '2024-01-02' AS date FROM documents")
def front_matter_values(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string("---\ntitle: \"Doc %d\"\n# comment\ndraft: %s\ntags: [%s, '%s']\ndate:  2024-01-02 \n---\n%s", "doc_id", c("source").isin("src1", "src2"), "lang", "source", "text")
    rows = t(spark, d, "documents").select("doc_id", markdown.front_values(text).alias("m"))
    return rows.select("doc_id", c("m")["title"]["text"].alias("title"), c("m")["draft"]["flag"].alias("draft"), F.array_join(markdown.tag_list(c("m")["tags"]["text"], c("m")["tags"]["items"]), ",").alias("tags"), markdown.plain_date(c("m")["date"]["text"]).alias("date"))


@query("SELECT doc_id, source, CAST(n_chars AS VARCHAR) AS n, len(text) AS body_chars FROM documents")
def front_matter_json(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("~~~json\n"), F.to_json(F.struct("source", c("n_chars").alias("n"))), F.lit("\n~~~\n"), c("text"))
    return t(spark, d, "documents").select("doc_id", markdown.json_front(text).alias("m"), F.length(markdown.body(text)).cast("long").alias("body_chars")).select("doc_id", c("m")["source"].alias("source"), c("m")["n"].alias("n"), "body_chars")


@query(r"""WITH p AS (SELECT doc_id, len(text) AS n, least(200, len(text)) AS place, substr(text, 1, least(200, len(text))) AS head, text FROM documents), u AS (SELECT *, len(regexp_extract(head, '^(.*[.!?])', 1, 's')) AS upto FROM p), s AS (SELECT *, upto + len(regexp_extract(substr(text, upto + 1), '^(\s*)', 1)) AS start FROM u)
SELECT doc_id, CAST(CASE WHEN upto > 0 AND start <= place THEN start ELSE place END AS INTEGER) AS start FROM s""")
def sentence_starts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", markdown.sentence_start(c("text"), F.least(F.lit(200), F.length("text"))).alias("start"))


@query(r"""WITH p AS (SELECT doc_id, [x FOR x IN [trim(y) FOR y IN string_split(text, chr(10))] IF x <> ''] AS p FROM documents), k AS (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) - 1 AS i FROM p),
l AS (SELECT doc_id, i, lag(regexp_replace(t, '^.*[.!?]\s+', '', 's'), 1, '') OVER (PARTITION BY doc_id ORDER BY i) AS previous FROM k) SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, previous AS previous_sentence FROM l""")
def previous_sentences(spark: SparkSession, d: str) -> DataFrame:
    return markdown.previous_sentences(documents.paragraphs(t(spark, d, "documents"))).select("doc_id", "chunk_index", "previous_sentence")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || ' > ' || lang ELSE '' END AS path, '[Source: ' || CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END || ' | Date: 2024-01-02]' AS origin, CASE WHEN doc_id % 5 = 0 OR text IS NULL OR trim(text) = '' THEN 'empty' WHEN len(text) > 200 THEN 'too_long' WHEN NOT (contains(text, '[') AND contains(text, ']')) THEN 'no_brackets' END AS problem, '[Doc ' || doc_id || '] [a] | b' AS shown FROM documents""")
def header_parts(spark: SparkSession, d: str) -> DataFrame:
    meta = F.when(c("doc_id") % 3 == 0, F.array("source", "lang", F.lit(" ")))
    named = F.to_json(F.struct(meta.alias("sections"), F.when(c("doc_id") % 2 == 0, c("source")).alias("source_file"), c("lang").alias("source"), F.lit("2024-01-02").alias("date"), F.lit("").alias("author")))
    shown = F.concat(F.lit("[Doc  "), c("doc_id").cast("string"), F.lit("][a]|   b "))
    return t(spark, d, "documents").select("doc_id", markdown.hierarchy_path(named).alias("path"), markdown.origin_line(named).alias("origin"), markdown.header_problem(F.when(c("doc_id") % 5 == 0, "  ").otherwise(c("text"))).alias("problem"), markdown.displayed(shown).alias("shown"))


@query(r"""WITH p AS (SELECT doc_id, [x FOR x IN [trim(y) FOR y IN string_split_regex(text, '\n\s*\n')] IF x <> ''] AS p FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(len(p) AS INTEGER) AS total_chunks, sha256(c) AS chunk_hash, CAST(len(c) AS INTEGER) AS chars FROM (SELECT doc_id, p, unnest(p) AS c, generate_subscripts(p, 1) - 1 AS i FROM p)""")
def chunk_blank_lines(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs between blank lines, with their texts."""
    rows = documents.paragraphs(t(spark, d, "documents"), r"\n\s*\n")
    return rows.select("doc_id", "chunk_index", "total_chunks", "chunk_hash", F.length("chunk_text").alias("chars"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS batch, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 * 100 AS start, least((row_number() OVER (ORDER BY o_orderkey) - 1) // 100 * 100 + 100, count(*) OVER ()) AS \"end\" FROM orders")
def fixed_batches(spark: SparkSession, d: str) -> DataFrame:
    return markdown.batches(t(spark, d, "orders").select("o_orderkey"), 100, "o_orderkey")


@query("""WITH p AS (SELECT doc_id, [x FOR x IN [trim(y) FOR y IN string_split(text, chr(10))] IF x <> ''] AS p FROM documents), k AS (SELECT doc_id, len(p) AS n, unnest(p) AS t, generate_subscripts(p, 1) - 1 AS i FROM p)
SELECT '/in/doc' || doc_id || '.md' AS path, 'doc' || doc_id AS title, CAST(i AS INTEGER) AS chunk_index, CAST(n AS INTEGER) AS total_chunks, 'doc' || doc_id || '.md > Chunk ' || i AS context_header, sha256(t) AS chunk_hash, '{"title":"doc' || doc_id || '","chunk_index":' || i || ',"total_chunks":' || n || ',"token_count":' || len(string_split_regex(t, '\\s+')) || '}' AS metadata FROM k""")
def ingest_chunks(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/in/doc"), c("doc_id").cast("string"), F.lit(".md"))
    files = t(spark, d, "documents").select(path.alias("path"), markdown.stem(path).alias("title"), F.concat(F.lit("---\nlang: x\n---\n"), c("text")).alias("text"))
    return markdown.chunks(files, "\n").select("path", "title", "chunk_index", "total_chunks", "context_header", "chunk_hash", "metadata")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 100 ELSE p_size END AS p_size, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'updated' WHEN p_partkey % 3 = 0 THEN 'inserted' ELSE 'kept' END AS action, CASE WHEN p_partkey % 3 = 0 THEN '2024-02-02' ELSE '2024-01-01' END AS updated_at FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def upsert_arrays(spark: SparkSession, d: str) -> DataFrame:
    """New rows come as parallel arrays, one set a brand and size, and are merged with the date of the write."""
    parts = t(spark, d, "part").select("p_partkey", "p_size")
    arrays = t(spark, d, "part").where("p_partkey % 3 = 0").groupBy("p_brand", "p_size").agg(F.collect_list(F.struct("p_partkey", (c("p_size") + 100).alias("p_size"))).alias("r")).select(c("r.p_partkey").alias("p_partkey"), c("r.p_size").alias("p_size"))
    new = sinks.from_arrays(arrays, ["p_partkey", "p_size"])
    old = parts.where("p_partkey % 2 = 0").withColumn("updated_at", F.lit("2024-01-01"))
    return sinks.stamped(new, old, "p_partkey", F.lit("2024-02-02"))


@query("WITH k AS (SELECT doc_id, [x FOR x IN string_split_regex(lower(source || ' ' || text), '[^a-z0-9]+') IF x <> ''] AS k FROM documents) SELECT doc_id, sha256(array_to_string(list_sort(list_distinct(k)), ' ')) AS lexemes, len(k) AS n_tokens FROM k")
def stored_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = sinks.with_tokens(t(spark, d, "documents").select("doc_id", "source", "text"), "source", "text")
    return rows.select("doc_id", F.sha2(F.array_join("lexemes", " "), 256).alias("lexemes"), F.size("tokens").cast("long").alias("n_tokens"))
