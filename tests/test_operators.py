import pytest
from pyspark.sql import functions as F

from tessera.operators import boost, documents, filters, fusion, respond, search
from tessera.streaming import state


def test_filters_reject_bad_input():
    with pytest.raises(ValueError):
        filters.in_values("a", [])
    with pytest.raises(ValueError):
        filters.between("a", 3, 1)
    with pytest.raises(TypeError):
        filters.contains("a", 3)
    with pytest.raises(ValueError):
        filters.equals("a b", 3).column()


def test_three_valued_not(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, a string")
    assert [r.id for r in filters.not_(filters.equals("a", "y")).apply(df).collect()] == [2]


def test_rrf_prefers_rows_of_both_arms(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    top = fusion.rrf({"a": (a, 0.5), "b": (b, 0.5)}).orderBy("rank").collect()
    assert [r.id for r in top] == [2, 1, 3] and all(0 <= r.score <= 1 for r in top)
    with pytest.raises(ValueError):
        fusion.fuse_multiple({"a": a}, {"a": 0.5})


def test_char_windows_always_advance():
    text = "ab " * 2000
    parts = documents.char_windows(text, 100, 90)
    assert parts and all(parts) and len(parts) < 6000


def test_front_matter_and_headings(spark):
    df = spark.createDataFrame([("title: 'A b'\ntags: [x, y]", "# Top\n```\n# no\n```\n## Sub")], "front string, body string")
    row = df.select(documents.front_matter(F.col("front")).alias("m"), documents.headings(F.col("body")).alias("h"), documents.title(F.col("body")).alias("t")).first()
    assert row.m["title"] == "A b" and [(h.level, h.text, h.line) for h in row.h] == [(1, "Top", 1), (2, "Sub", 5)] and row.t == "Top"


def test_cursor_of_another_request_starts_over():
    c = respond.cursor({"q": 1}, 20, "full")
    assert respond.offset_of(c, {"q": 1}) == 20 and respond.offset_of(c, {"q": 2}) == 0 and respond.offset_of(None, {}) == 0


def test_boost_stays_within_one(spark):
    assert spark.range(1).select(boost.boosted(F.lit(0.99), {"vendor": F.lit(1.0), "topic": F.lit(1.0)}).alias("b")).first().b == 1.0


def test_limiter_and_breaker():
    allowed, held = state.limited([0.0, 1.0, 2.0, 3.0, 61.0], state.Limits(2, 100, 100))
    assert allowed == [True, True, True, False, True]
    more, _ = state.limited([62.0], state.Limits(2, 100, 100), held)
    assert more == [True]
    assert state.broken([0, 1, 2, 70, 71], [True, True, False, False, False], 2, 60, 2) == ["closed", "open", "open", "half_open", "closed"]


def test_vectors_without_distance_are_not_found(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0]), (5, None), (6, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r.vec_id for r in search.vector_search(df, [1.0, 0.0]).orderBy("rank").collect()] == [1, 6]
    asked = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    got = {(r.query_id, r["rank"]): r.vec_id for r in search.batch_search(df, asked).collect()}
    assert got == {(1, 1): 1, (1, 2): 6, (6, 1): 6, (6, 2): 1, (4, 1): 4}


def test_queries_without_terms(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for f in (search.text_search, search.phrase_search, search.bm25_search):
        assert f(df, " ,!").count() == 0


def test_json_containment(spark):
    rows = [(1, '{"k": null, "n": 1.0, "a": [{"x": 1, "y": 2}, 3], "d.e": {"q\'s": "v"}}'), (2, '{"k": "null"}'), (3, "no json"), (4, None)]
    df = spark.createDataFrame(rows, "id int, j string")
    for value in ({"k": None}, {"n": 1}, {"a": [{"x": 1}]}, {"a": [3]}, {"d.e": {"q's": "v"}}, {"a": []}):
        assert [r.id for r in filters.jsonb_contains("j", value).apply(df).collect()] == [1], value
    for value in ({"n": "1.0"}, {"a": [{"x": 2}]}, {"n": True}, {"missing": None}):
        assert filters.jsonb_contains("j", value).apply(df).count() == 0, value
    with pytest.raises(ValueError):
        filters.between("s", "b", "a")
