"""Search end to end over a chunk table: routing, both arms, fusion, boosts, threshold, pages and explanations.

A chunk table has chunk_id, chunk_text, source_category, metadata (JSON), document_date and embedding; what else it has
comes with the results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import boost, fusion, rerank, respond, routing, search, text_index

STRATEGIES = ("vector", "bm25", "hybrid")
#: The most rows of one search, and so the size of what is broadcast to fetch their texts: two arms of so many ids.
MOST = 1000


@dataclass(frozen=True)
class Settings:
    """Defaults of a search. Weights are shares of the two arms."""

    vector_weight: float = 0.6
    text_weight: float = 0.4
    rrf_k: int = 60
    boosts: dict[str, float] = field(default_factory=lambda: dict(boost.WEIGHTS))

    def __post_init__(self) -> None:
        if min(self.vector_weight, self.text_weight) < 0 or self.vector_weight + self.text_weight <= 0:
            raise ValueError("weights must not be negative, nor all zero")
        if unknown := set(self.boosts) - set(boost.WEIGHTS):
            raise ValueError(f"unknown boosts: {sorted(unknown)}")


@dataclass(frozen=True)
class Plan:
    """The stages of a search as DataFrames, none of them run yet."""

    route: routing.Route
    arms: dict[str, DataFrame]
    merged: DataFrame
    results: DataFrame


def plan(chunks: DataFrame, query: str, vector: list[float], k: int = 10, strategy: str | None = None, where: Column | None = None, min_score: float = 0.0, settings: Settings = Settings(), as_of: date | None = None, normalised: bool = False, index: text_index.TextIndex | Callable[[], text_index.TextIndex] | None = None) -> Plan:
    """k rows of each arm that the strategy asks for (routed if None), fused and boosted if both, above the threshold, ranked.

    normalised divides fused scores by the most that a row first in both arms can reach, so that thresholds mean the same
    for every strategy; without it they are at most 1 / (rrf_k + 1) before boosts. With an index of the chunks' texts by
    id the text arm reads its postings, and of the chunks only what where asks for. A function that gives the index is
    called only if the strategy has a text arm.
    """
    if not query.strip():
        raise ValueError("the query is empty")
    if not 1 <= k <= MOST:
        raise ValueError(f"k must lie between 1 and {MOST}")
    if strategy is not None and strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    route = routing.route(query)
    strategy = strategy or route.strategy
    kept = chunks if where is None else chunks.where(where)
    arms = {}
    if strategy != "bm25":
        arms["vector"] = search.vector_search(kept, vector, k, id_col="chunk_id").select("chunk_id", F.col("similarity").alias("similarity_score"), "rank")
    if strategy != "vector":
        if index is None:
            texts = search.text_search(kept, query, k, id_col="chunk_id", text_col="chunk_text")
        else:
            index = index() if callable(index) else index
            among = None if where is None else kept.select(F.col("chunk_id").alias(index.id_col))
            texts = text_index.text_search(index, query, k, among=among).withColumnRenamed(index.id_col, "chunk_id")
        arms["bm25"] = texts.select("chunk_id", F.col("score").alias("bm25_score"), "rank")
    scores = [a.drop("rank") for a in arms.values()]
    found = reduce(lambda a, b: a.join(b, "chunk_id", "full"), scores)
    for name in ("similarity_score", "bm25_score"):
        found = found.withColumn(name, F.coalesce(F.col(name), F.lit(0.0)) if name in found.columns else F.lit(0.0))
    if strategy == "hybrid":
        weights = {"vector": settings.vector_weight, "bm25": settings.text_weight}
        fused = fusion.rrf({n: (a, weights[n]) for n, a in arms.items()}, settings.rrf_k, "chunk_id").select("chunk_id", F.col("score").alias("hybrid_score"))
        found = found.join(fused, "chunk_id")
    else:
        found = found.withColumn("hybrid_score", F.lit(0.0))
    rows = kept.drop("embedding").join(F.broadcast(found), "chunk_id").withColumn("score_type", F.lit(strategy))
    if strategy == "hybrid":
        base = F.col("hybrid_score") * (settings.rrf_k + 1.0) if normalised else F.col("hybrid_score")
        factors = {"vendor": boost.vendor(query, F.col("metadata")), "doc_type": boost.doc_type(query, F.col("source_category")), "entity": boost.entity(query, F.col("chunk_text")), "topic": boost.topic(query, F.col("chunk_text"))}
        if as_of is not None:
            factors["recency"] = F.coalesce(boost.recency(F.col("document_date"), as_of), F.lit(0.0))
        rows = rows.withColumn("hybrid_score", boost.boosted(base, factors, settings.boosts))
    return Plan(route if strategy == route.strategy else routing.Route(strategy, route.density, "asked for"), arms, rows, above(rows, min_score, k))


def above(rows: DataFrame, least: float, k: int) -> DataFrame:
    """Rows whose first score that is not zero reaches the threshold, the k best, ranked; scores equal to 14 places go by id."""
    score = F.coalesce(*[F.nullif(F.col(c), F.lit(0.0)) for c in ("hybrid_score", "similarity_score", "bm25_score")], F.lit(0.0))
    kept = rows.withColumn("score", score).where(F.col("score") >= least).withColumn("__key", F.round("score", 14))
    return search.ranked(kept.orderBy(F.desc("__key"), "chunk_id").limit(k), F.desc("__key"), F.col("chunk_id")).drop("__key")


def hybrid_search(chunks: DataFrame, query: str, vector: list[float], k: int = 10, **options: object) -> DataFrame:
    """The results of plan()."""
    return plan(chunks, query, vector, k, **options).results


def explained(chunks: DataFrame, query: str, vector: list[float], k: int = 10, **options: object) -> DataFrame:
    """One row on how a search came out: strategy, why, rows of each arm (null if not asked), merged and final rows, and the boosts' weights."""
    p = plan(chunks, query, vector, k, **options)
    stages = p.arms | {"merged": p.merged, "final": p.results}
    counted = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("stage")) for n, df in stages.items()])
    count = lambda n: (F.count_if(F.col("stage") == n) if n in stages else F.lit(None).cast("long")).alias(f"{n}_count")
    boosts = options.get("settings", Settings()).boosts if p.route.strategy == "hybrid" else {}
    weights = F.map_from_arrays(F.array(*map(F.lit, boosts)), F.array(*map(F.lit, boosts.values()))) if boosts else F.lit(None).cast("map<string,double>")
    row = counted.agg(*map(count, ("vector", "bm25", "merged", "final")))
    return row.select(F.lit(query).alias("query"), F.lit(p.route.strategy).alias("strategy"), routing.confidence(F.lit(query)).alias("confidence"), F.lit(p.route.reason).alias("reason"), "*", weights.alias("boosts"))


def semantic_search(chunks: DataFrame, query: str, vector: list[float], top_k: int = 50, page_size: int = 10, cursor: str | None = None, mode: str = "metadata", fields: list[str] | None = None, **options: object) -> DataFrame:
    """One page of a hybrid search of top_k rows, in a response mode or with chosen fields, with total_found, has_more and next_cursor.

    top_k is fetched whatever the page size, so later pages exist. A cursor of another request starts over.
    """
    if not 1 <= page_size <= 50 or mode not in respond.TOKENS:
        raise ValueError("page_size must lie between 1 and 50, and the mode be known")
    request = {"query": query, "top_k": top_k, "mode": mode}
    offset = respond.offset_of(cursor, request)
    results = hybrid_search(chunks, query, vector, top_k, **({"strategy": "hybrid"} | options))
    counted = results.withColumn("total_found", F.count("*").over(Window.partitionBy()))  # top_k rows at most
    shown = respond.page(counted, offset, page_size)
    shown = respond.only_fields(shown, [*fields, "total_found"]) if fields else respond.project(shown, mode, "total_found")
    more = F.col("total_found") > offset + page_size
    return shown.withColumn("has_more", more).withColumn("next_cursor", F.when(more, respond.cursor(request, offset + page_size, mode)))


def reranked_search(chunks: DataFrame, query: str, vector: list[float], k: int = 5, least: float = 0.0, available: int = 80, **options: object) -> DataFrame:
    """A hybrid search whose pool of candidates grows with the complexity of the query, put in order anew by the scorer."""
    words = len(query.lower().split())
    joined, quoted = any(w in (" " + query.lower() + " ") for w in (" and ", " or ", " not ")), query.count('"') > 1
    complexity = min(1.0, words / 10.0 * 0.6 + 0.2 * joined + 0.2 * quoted)
    pool = min(max(min(int(50 * (1.0 + complexity * 1.2)), 100), 5), available)
    rows = hybrid_search(chunks, query, vector, pool, **({"strategy": "hybrid"} | options)).drop("rank")
    return rerank.rerank(rows, rerank.overlap_scorer(query), pool, k, least, "chunk_id", "chunk_text", "hybrid_score")
