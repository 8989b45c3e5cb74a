"""Registries, validators and reranking against plain versions."""

import math
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.operators import boost, filters, fusion, hybrid, rerank
from tessera.plans import search_queries as sq

D = "/root/testdata/sf0.001"


def test_strategies_by_name():
    assert [s.name for s in boost.create_all()][:5] == ["vendor", "doc_type", "recency", "entity", "topic"]
    assert boost.create("vendor").factor == 0.15 and {s.name: s.factor for s in boost.create_all({"topic": 0.5})}["topic"] == 0.5
    for bad in (lambda: boost.create("nobody"), lambda: boost.create("vendor", 1.5), lambda: boost.register("x", "no rule"), lambda: boost.register("x", boost.topic, -1.0)):
        with pytest.raises((KeyError, ValueError, TypeError)):
            bad()
    assert "x" not in boost.RULES
    boost.register("mine", lambda c: c.isNotNull().cast("double"), 0.2)
    try:
        assert boost.create("mine").factor == 0.2 and boost.create_all()[-1].name == "mine"
    finally:
        del boost.RULES["mine"], boost.FACTORS["mine"]


def test_dates_are_checked(spark):
    assert filters.iso_date("2024-02-29") == date(2024, 2, 29) == filters.iso_date(date(2024, 2, 29))
    for bad in ("2024-2-1", "29.02.2024", "2023-02-29", "", None, 5):
        with pytest.raises(ValueError):
            filters.iso_date(bad)
    with pytest.raises(ValueError):
        filters.date_between("day", "2024-02-02", "2024-02-01")
    with pytest.raises(ValueError):
        filters.matches(min_date="yesterday")
    df = spark.sql("select * from values (1, date'2024-01-01'), (2, date'2024-02-01'), (3, null) as t(id, day)")
    assert [r.id for r in filters.date_between("day", "2024-01-15", "2024-02-01").apply(df).collect()] == [2]


def plain_confidence(query, text):
    wanted = set(re.findall(r"\w+", query.lower()))
    share = len(wanted & set(re.findall(r"\w+", (text or "")[:512].lower()))) / max(1, len(wanted))
    return 1 / (1 + math.exp(-(8 * share - 4)))


def test_reranking_against_plain_scores(spark):
    rows = [(i, t, float(s)) for i, (t, s) in enumerate([("of the and", 5), ("with", 9), ("nothing", 8), (None, 7), ("and of the with", 1), ("the", 6), ("x " * 300 + "of and", 4)])]
    df = spark.createDataFrame(rows, "id long, text string, score double")
    pool = sorted(rows, key=lambda r: (-r[2], r[0]))[:6]
    want = sorted(((plain_confidence("of the and with", t), i) for i, t, _ in pool), key=lambda x: (-x[0], x[1]))[:4]
    got = rerank.rerank(df, rerank.overlap_scorer("of the and with"), 6, 4).orderBy("rank").collect()
    assert [(r.id, r["rank"]) for r in got] == [(i, n) for n, (_, i) in enumerate(want, 1)] and [r.confidence for r in got] == pytest.approx([c for c, _ in want])
    assert rerank.rerank(df, rerank.overlap_scorer("of"), 6, 4, least=0.9).count() == sum(plain_confidence("of", t) >= 0.9 for _, t, _ in pool)


def test_reranked_search_against_its_pool(spark):
    pool = hybrid.hybrid_search(sq.chunks(spark, D), sq.QUERY, sq.first_vector(spark, D), 56, strategy="hybrid", as_of=sq.AS_OF).select("chunk_id", "chunk_text").collect()
    want = sorted(((plain_confidence(sq.QUERY, r.chunk_text), r.chunk_id) for r in pool), key=lambda x: (-round(x[0], 12), x[1]))[:10]
    got = sq.search_reranked(spark, D).orderBy("rank").collect()
    assert [(round(r.confidence, 9), r.chunk_id) for r in got] == [(round(c, 9), i) for c, i in want]


def test_fused_confidence(spark):
    a = spark.createDataFrame([(1, 1, 0.9), (2, 2, 0.4)], "id long, rank int, confidence double")
    b = spark.createDataFrame([(2, 1, 0.7), (3, 2, 0.1)], "id long, rank int, confidence double")
    got = {r.id: (r.confidence, r.sources) for r in fusion.rrf({"v": (a, 0.6), "x": (b, 0.4)}).collect()}
    assert got == {1: (0.9, "v"), 2: (0.7, "v,x"), 3: (0.1, "x")}
    assert {r.confidence for r in fusion.rrf({"v": (a.drop("confidence"), 1.0)}).collect()} == {0.0}
