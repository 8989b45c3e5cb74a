"""Text searches as table functions of Spark SQL, over a stored text index.

register() makes views of the index and two functions: search_bm25(query_text, top_k, category_filter, min_score) and
search_bm25_phrase(phrase, top_k, category_filter). Both are SQL bodies, so the planner sees through them: the query's
words are stemmed by the profile's expressions and joined to the postings of their buckets.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import english
from tessera.operators.text_index import STOPS, TextIndex


def stem_sql(source: str) -> str:
    """The stemmer's steps as nested selects over a relation with the columns token and place."""
    have = ["token", "place"]
    for step in english.steps():
        kept = [c for c in have if c not in step]
        have = kept + list(step)
        source = f"(SELECT {', '.join([*kept, *(f'{e} AS {n}' for n, e in step.items())])} FROM {source})"
    return f"(SELECT w AS term, place FROM {source})"


def words_sql(profile: str, parameter: str) -> str:
    """(term, place) of a query's words: stop words are left out and keep their places."""
    words = f"filter(split(lower({parameter}), '[^a-z0-9]+'), x -> x <> '')"
    stops = ", ".join(f"'{w}'" for w in sorted(STOPS[profile]))
    each = f"(SELECT token, place FROM (SELECT posexplode({words}) AS (place, token)){f' WHERE token NOT IN ({stops})' if stops else ''})"
    return stem_sql(each) if profile == "english" else f"(SELECT token AS term, place FROM {each})"


#: What one document's places of all words give: the shortest stretches' sum, by one pass in order.
DENSITY = """aggregate(array_sort(flatten(transform(found, f -> transform(f.positions, p -> struct(p AS pos, CAST(array_position(terms, f.term) AS INT) AS t))))),
 struct(array_repeat(-1, size(terms)) AS last, -1 AS begin, CAST(0 AS DOUBLE) AS total),
 (s, p) -> aggregate(array(transform(s.last, (v, i) -> IF(i + 1 = p.t, p.pos, v))), s, (a, now) -> struct(now AS last, array_min(now) AS begin, a.total + IF(array_min(now) > a.begin, 1 / CAST(p.pos - array_min(now) + 1 AS DOUBLE), CAST(0 AS DOUBLE)) AS total)),
 s -> s.total)"""


def register(index: TextIndex, name: str = "search_bm25", category: str = "source") -> None:
    """Makes name and name_phrase known to the index's session. category is the attribute that category_filter compares."""
    spark, key = index.spark, index.id_col
    postings, docs = f"{name}_postings", f"{name}_docs"
    rows = index.rows("postings").select("bucket", "term", "generation", F.explode(F.arrays_zip("docs", "lens", "positions")).alias("x"))
    flat = rows.select("bucket", "term", "generation", F.col("x.docs").alias(key), F.col("x.lens").alias("n_tokens"), F.col("x.positions").alias("positions"))
    index.live(flat, key).drop("generation").createOrReplaceTempView(postings)
    index.documents().createOrReplaceTempView(docs)
    # Parameters appear once, at the leaves: the words' relation carries them on as columns.
    for function, parameter, score, more in (
        (name, "query_text", f"{DENSITY} / (1 + ln(CAST(n_tokens AS DOUBLE))) / n_tokens", ", min_score DOUBLE DEFAULT 0.0"),
        (f"{name}_phrase", "phrase", "greatest(size(array_intersect_all), 0) / CAST(n_tokens AS DOUBLE)", ""),
    ):
        least = "min_score" if more else "CAST(0 AS DOUBLE)"
        asked = f"SELECT collect_list(struct(place, term)) AS placed, array_distinct(collect_list(term)) AS terms FROM {words_sql(index.profile, f'{function}.{parameter}')}"
        starts = "transform(array_sort(placed), w -> transform(get(filter(found, f -> f.term = w.term), 0).positions, p -> p - w.place))"
        common = f"aggregate(slice({starts}, 2, 1000), get({starts}, 0), (a, b) -> array_intersect(a, b))"
        hits = score.replace("array_intersect_all", common)
        spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION {function}({parameter} STRING, top_k INT DEFAULT 10, category_filter STRING DEFAULT NULL{more})
RETURNS TABLE({key} BIGINT, n_tokens INT, similarity DOUBLE, rank INT)
RETURN SELECT {key}, n_tokens, similarity, rank FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY similarity DESC, {key}) AS INT) AS rank FROM (
    SELECT {key}, n_tokens, {hits} AS similarity FROM (
      SELECT p.{key}, p.n_tokens, first(q.placed) AS placed, first(q.terms) AS terms, collect_list(struct(p.term AS term, p.positions AS positions)) AS found
      FROM ({asked}) q JOIN {postings} p ON array_contains(q.terms, p.term) JOIN {docs} d ON d.{key} = p.{key}
      WHERE {function}.category_filter IS NULL OR d.{category} = {function}.category_filter
      GROUP BY p.{key}, p.n_tokens
    ) WHERE size(found) = size(terms)
  ) WHERE similarity > 0 AND similarity >= {f'{function}.{least}' if more else least}
) WHERE rank <= {function}.top_k""")
