"""Ranking metrics over a table of ranked results: (query, rank, relevant)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import order


def gain(rank: Column, standard: bool = False) -> Column:
    """Discount of a rank: 1 / (1 + log2 rank), or the standard 1 / log2(rank + 1)."""
    return 1.0 / F.log2(rank + 1) if standard else 1.0 / (1.0 + F.log2(rank))


def ranking_metrics(ranked: DataFrame, truth: DataFrame, k: int = 10, query_col: str = "query_id", standard: bool = False) -> DataFrame:
    """ndcg, mrr, precision, map and their composite for each query.

    ranked: (query, rank, relevant boolean); truth: (query, n_relevant). Precision divides by k even if a query has
    fewer rows; map by the number of relevant items.
    """
    hit = F.col("relevant").cast("int")
    rows = order.running(ranked, F.col("relevant"), [query_col], "rank", "hits")
    found = rows.groupBy(query_col).agg(
        F.sum(F.when(F.col("relevant") & (F.col("rank") <= k), gain(F.col("rank"), standard)).otherwise(0.0)).alias("dcg"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= k, hit).otherwise(0)).alias("in_k"), F.sum(F.when(F.col("relevant"), F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + gain(r, standard))
    out = truth.where("n_relevant > 0").withColumn("idcg", ideal).join(found, query_col)
    out = out.select(query_col, (F.col("dcg") / F.col("idcg")).alias("ndcg"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("in_k") / float(k)).alias("precision"), (F.col("precisions") / F.col("n_relevant")).alias("map"), (F.col("in_k") / F.col("n_relevant")).alias("recall"))
    return out.withColumn("composite", 0.4 * F.col("ndcg") + 0.3 * F.col("mrr") + 0.3 * F.col("precision"))


def spearman(actual: DataFrame, expected: DataFrame, id_col: str = "id", query_col: str = "query_id") -> DataFrame:
    """Rank correlation of two orders of the ids they share (columns rank); one shared id gives 1, none no row."""
    both = actual.select(query_col, id_col, F.col("rank").alias("a")).join(expected.select(query_col, id_col, F.col("rank").alias("b")), [query_col, id_col])
    apart = F.col("a").cast("long") - F.col("b")  # its square passes an int from 46,341 ranks on, the sum of squares a long from some three million
    sums = both.groupBy(query_col).agg(F.sum((apart * apart).cast("decimal(20,0)")).cast("double").alias("d2"), F.count("*").cast("double").alias("n"))
    return sums.select(query_col, F.when(F.col("n") < 2, 1.0).otherwise(F.greatest(F.lit(-1.0), 1.0 - 6.0 * F.col("d2") / (F.col("n") * (F.col("n") * F.col("n") - 1.0)))).alias("correlation"))


def inversions(ranked: DataFrame, score: str, query_col: str = "query_id") -> DataFrame:
    """1 - the share of neighbours whose scores rise."""
    found = order.neighbours(ranked, score, [query_col], "rank", F.col("before") < F.col("after"))
    return found.select(query_col, F.when(F.col("n") < 2, 1.0).otherwise(1.0 - F.col("held") / F.col("pairs")).alias("quality"))


def latency(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """min, max, mean, median, sample deviation, and p95 and p99 by index int(n p), the largest if that is past the end."""
    n = F.col("n")
    wanted = {"p95": F.least(F.floor(n * 0.95), n - 1), "p99": F.least(F.floor(n * 0.99), n - 1), "__a": F.floor((n - 1) / 2), "__b": F.floor(n / 2)}
    at = order.at_places(df, value, list(keys), wanted)
    plain = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))
    return plain.join(at, list(keys)).select(*keys, "n", "low", "high", "mean", ((F.col("__a") + F.col("__b")) / 2).alias("median"), "deviation", "p95", "p99")


def keyword_relevance(text: Column, keywords: list[str]) -> Column:
    """Share of keywords present, with small bonuses for repeats and for keywords within the first 200 characters, 1 at most."""
    from tessera.functions.text import occurrences

    low = F.lower(text)
    head = F.substring(low, 1, 200)
    total = F.lit(0.0)
    for word in (k.lower() for k in keywords):
        n = occurrences(low, word)
        total = total + F.when(n > 0, 1.0 / len(keywords)).otherwise(0.0) + F.when(n > 1, 0.05 * F.least(n - 1, F.lit(2))).otherwise(0.0) + F.when(head.contains(word), 0.05).otherwise(0.0)
    return F.least(total, F.lit(1.0))


def averages(per_query: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of queries and the mean of each metric over them."""
    return per_query.agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in columns])


def order_check(ranked: DataFrame, score_col: str) -> DataFrame:
    """(query_id, n, ranks_valid, sorted) of results with columns query_id, rank and a score: ranks are 1 to n, each once, and scores never rise."""
    found = order.neighbours(ranked, score_col, ["query_id"], "rank", F.col("after") <= F.col("before"))
    n = F.col("n")
    return found.select("query_id", "n", ((F.col("low") == 1) & (F.col("high") == n) & (F.col("distinct") == n)).alias("ranks_valid"), (F.col("held") == F.col("pairs")).alias("sorted"))


def graded(judged: DataFrame, score_col: str, id_col: str = "id", k: int = 10, query_col: str = "query_id", grade_col: str = "grade") -> DataFrame:
    """ndcg over grades (rank 1 undiscounted, then 1 / log2 rank), precision, recall and F1 of the k best rows by score, for queries with a relevant row.

    Only the k best by score and the k best by grade of each query are kept on the way: a rank filter that the engine
    applies before its shuffle, so no query's rows come together.
    """
    by = Window.partitionBy(query_col)
    cut = lambda *order: judged.withColumn("__at", F.row_number().over(by.orderBy(*order))).where(F.col("__at") <= k)
    value = F.sum(F.col(grade_col) / F.greatest(F.lit(1.0), F.log2("__at")))
    shown = cut(F.desc(score_col), F.col(id_col)).groupBy(query_col).agg(value.alias("dcg"), F.count_if(F.col(grade_col) > 0).alias("hits"), F.count("*").alias("shown"))
    ideal = cut(F.desc(grade_col)).groupBy(query_col).agg(value.alias("idcg"))
    relevant = judged.groupBy(query_col).agg(F.count_if(F.col(grade_col) > 0).alias("relevant")).where("relevant > 0")
    hits = F.col("hits").cast("double")
    return shown.join(ideal, query_col).join(relevant, query_col).select(query_col, (F.col("dcg") / F.col("idcg")).alias("ndcg"), (hits / F.col("shown")).alias("precision"), (hits / F.col("relevant")).alias("recall"), (2.0 * hits / (F.col("shown") + F.col("relevant"))).alias("f1"))


#: What a sweep changes: the weights of the boosts, from 0 to 0.3 in steps of 0.05.
STEPS = tuple(i / 20 for i in range(7))


def factor_sweep(results: DataFrame, factors: dict[str, float], k: int = 10, steps: tuple[float, ...] = STEPS, query_col: str = "query_id", id_col: str = "id") -> DataFrame:
    """(factor, weight, ndcg, mrr, precision, composite, is_best) for each weight of each factor, the others at their baseline.

    results: (query, id, relevant, base score, a column from 0 to 1 for each factor). One job: each row meets every point
    of the sweep, and each (factor, weight, query) keeps its k best by a rank filter that runs before the shuffle. Ties go
    to the smaller id; of equal composites the smaller weight is best. Metrics are means over queries with a relevant row.
    """
    points = F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(w).alias("weight")) for f in factors for w in steps])
    boost = sum((F.when(F.col("point.factor") == f, F.col("point.weight")).otherwise(F.lit(w)) * F.col(f) for f, w in factors.items()), F.lit(0.0))
    swept = results.withColumn("point", F.explode(points)).select("point.*", query_col, id_col, "relevant", F.round(F.least(F.lit(1.0), F.col("base") * (1.0 + boost)), 12).alias("score"))
    by = Window.partitionBy("factor", "weight", query_col).orderBy(F.desc("score"), id_col)
    top = swept.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    hit = F.col("relevant")
    per = top.groupBy("factor", "weight", query_col).agg(F.sum(F.when(hit, gain(F.col("rank"))).otherwise(0.0)).alias("dcg"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.count_if(hit).alias("hits"))
    truth = results.groupBy(query_col).agg(F.count_if("relevant").alias("n")).where("n > 0")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + gain(r))
    scored = per.join(truth.withColumn("ideal", ideal), query_col).select("factor", "weight", (F.col("dcg") / F.col("ideal")).alias("ndcg"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("hits") / float(k)).alias("precision"))
    means = scored.groupBy("factor", "weight").agg(*[F.avg(c).alias(c) for c in ("ndcg", "mrr", "precision")]).withColumn("composite", F.round(0.4 * F.col("ndcg") + 0.3 * F.col("mrr") + 0.3 * F.col("precision"), 12))
    best = Window.partitionBy("factor").orderBy(F.desc("composite"), "weight")  # a row for each step
    return means.withColumn("is_best", F.row_number().over(best) == 1)
