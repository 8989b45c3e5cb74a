"""Order statistics, ranks and sweeps of large groups, and searches by batch."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators import markdown, metrics, order, search


def test_order_check_has_no_bound(spark):
    good = [("q", i + 1, 5000.0 - i) for i in range(1499)]
    late = [(q, r, s if r != 1001 else 9999.0) for q, r, s in good]
    rows = [("good", r, s) for _, r, s in good] + [("late", r, s) for _, r, s in late] + [("gap", 1, 3.0), ("gap", 3, 2.0), ("twice", 1, 2.0), ("twice", 1, 2.0), ("one", 1, 0.0)]
    df = spark.createDataFrame(rows, "query_id string, rank int, score double")
    got = {r.query_id: (r.n, r.ranks_valid, r.sorted) for r in metrics.order_check(df, "score").collect()}
    assert got == {"good": (1499, True, True), "late": (1499, True, False), "gap": (2, False, True), "twice": (2, False, True), "one": (1, True, True)}
    for span in (1, 7, 1000):  # a fall between two spans counts as well
        found = order.neighbours(df, "score", ["query_id"], "rank", F.col("after") <= F.col("before"), span)
        assert {r.query_id: r.held for r in found.collect() if r.query_id in ("good", "late")} == {"good": 1498, "late": 1497}


def test_latency_of_a_million_rows(spark):
    big = spark.range(1_000_000).select(F.lit("a").alias("k"), ((F.col("id") * 7919) % 1_000_003).cast("double").alias("v"))
    few = spark.createDataFrame([("b", 1.0), ("b", 1.0), ("b", 5.0), ("c", 2.0), ("b", None)], "k string, v double")
    same = spark.range(100_000).select(F.lit("d").alias("k"), F.lit(4.0).alias("v"))
    got = {r.k: r for r in metrics.latency(big.unionByName(few).unionByName(same), "v", "k").collect()}
    values = sorted((i * 7919) % 1_000_003 for i in range(1_000_000))
    assert (got["a"].p95, got["a"].p99, got["a"].median) == (values[950_000], values[990_000], (values[499_999] + values[500_000]) / 2)
    assert (got["b"].n, got["b"].median, got["b"].p95, got["c"].p99, got["c"].deviation, got["d"].p95, got["d"].median) == (3, 1.0, 5.0, 2.0, None, 4.0, 4.0)
    plan = metrics.latency(big, "v", "k")._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():  # windows see a row for each split or each value of one split
        if line.strip(" :+-").startswith("Window"):
            assert "__split" in line or "sum(__in" in line  # a row for each split


def test_places_of_bunched_ids(spark):
    ids = [0, 2**62, *(2**61 + i for i in range(500)), *range(5, 300)]
    random.Random(1).shuffle(ids)
    got = {r.x: (r.batch, r.start, r.end) for r in markdown.batches(spark.createDataFrame([(i,) for i in ids], "x long"), 100, "x").collect()}
    want = {v: (i // 100, i // 100 * 100, min(i // 100 * 100 + 100, len(ids))) for i, v in enumerate(sorted(ids))}
    assert got == want
    assert markdown.batches(spark.createDataFrame([], "x long"), 100, "x").count() == 0


def test_running_sums_over_spans(spark):
    r = random.Random(3)
    rows = [(q, i, r.random() < 0.4) for q in "ab" for i in range(1, 60)]
    got = {(x.q, x.rank): x.hits for x in order.running(spark.createDataFrame(rows, "q string, rank int, f boolean"), F.col("f"), ["q"], "rank", "hits", span=7).collect()}
    assert got == {(q, i): sum(f for p, j, f in rows if p == q and j <= i) for q, i, _ in rows}


def test_batch_search_leaves_infinite_vectors_out(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [inf, 1.0]), (3, [nan, 1.0]), (4, [0.0, 0.0]), (5, [1.0, 1.0]), (6, None), (7, [1.0, None]), (8, [-inf, inf]), (9, [1.0]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for metric, want in (("cosine", {1, 5}), ("l2", {1, 4, 5}), ("inner_product", {1, 4, 5})):
        found = search.batch_search(df, df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), metric=metric).collect()
        pairs = {(r.query_id, r.vec_id) for r in found}
        assert pairs == {(a, b) for a in want for b in want} | {(9, 9)} and all(r.distance == r.distance for r in found)


def test_nothing_is_near_to_no_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    for metric in ("cosine", "l2", "inner_product"):
        assert search.vector_search(df, [], metric=metric).count() == 0


def test_batch_search_is_spread(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 16)
    rows = spark.range(200).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * k + k).alias("x") for k in range(1, 5)]).alias("embedding"))
    asked = rows.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    got = {(r.query_id, r.rank): r.vec_id for r in search.batch_search(rows, asked, 3).collect()}
    for q in (0, 55, 195):
        one = asked.where(F.col("query_id") == q).first()["query_vec"]
        assert [r.vec_id for r in search.vector_search(rows, list(one), 3).orderBy("rank").collect()] == [got[q, i] for i in (1, 2, 3)]
    keys = search.blocks(rows, "vec_id", "embedding", "cosine", "x", 13).select("dim", "pack").collect()
    assert len(set(keys)) == len(keys) > 8


def test_sweep_against_plain_loops(spark):
    r = random.Random(5)
    rows = [(f"q{i % 3}", i, r.random() < 0.3, r.random() / 2, r.random(), float(r.random() < 0.5)) for i in range(90)] + [("none", 500, False, 0.5, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "query_id string, id long, relevant boolean, base double, vendor double, topic double")
    start, steps = {"vendor": 0.15, "topic": 0.08}, (0.0, 0.1, 0.3)
    import math

    for x in metrics.factor_sweep(df, start, 5, steps).collect():
        weights = start | {x.factor: x.weight}
        scores = []
        for q in ("q0", "q1", "q2"):
            own = sorted((-round(min(1.0, b * (1 + weights["vendor"] * v + weights["topic"] * t)), 12), i, rel) for p, i, rel, b, v, t in rows if p == q)[:5]
            n = min(5, sum(rel for p, _, rel, *_ in rows if p == q))
            ideal = sum(1 / (1 + math.log2(j)) for j in range(1, n + 1))
            hits = [j for j, (_, _, rel) in enumerate(own, 1) if rel]
            scores.append((sum(1 / (1 + math.log2(j)) for j in hits) / ideal, 1 / hits[0] if hits else 0.0, len(hits) / 5))
        means = [statistics.mean(c) for c in zip(*scores)]
        assert (x.ndcg, x.mrr, x.precision) == pytest.approx(tuple(means)) and x.composite == pytest.approx(0.4 * means[0] + 0.3 * means[1] + 0.3 * means[2])
    best = metrics.factor_sweep(df, start, 5, steps).where("is_best").collect()
    assert len(best) == 2
