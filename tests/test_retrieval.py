"""Hybrid search, vendor modes, Markdown ingest and write-time columns on small rows."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.operators import documents, graph, hybrid, markdown, metrics, respond, routing
from tessera.sources import sinks

VOCABULARY = os.environ.get("TESSERA_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(1, "retry the api token", "guide", '{"vendor":"OpenAI"}', date(2024, 1, 1), [1.0, 0.0]), (2, "api", "kb", None, None, [0.0, 1.0]), (3, "token api", "api", "{}", date(2024, 1, 9), None), (4, None, None, None, None, [1.0, 1.0]), (5, "", "kb", "{}", None, [0.0, 0.0])]
    return spark.createDataFrame(rows, "chunk_id long, chunk_text string, source_category string, metadata string, document_date date, embedding array<double>")


def test_routes():
    assert routing.route("api token jwt").strategy == "bm25" and routing.route("who is that").strategy == "vector"
    assert routing.route("api of token").strategy == "hybrid" and routing.route("api", ["vector"]).strategy == "vector"


def test_arms_and_threshold(chunks):
    ids = lambda df: [r.chunk_id for r in df.orderBy("rank").collect()]
    assert ids(hybrid.hybrid_search(chunks, "api token", [1.0, 0.0], strategy="vector")) == [1, 4, 2]
    assert ids(hybrid.hybrid_search(chunks, "api token", [1.0, 0.0], strategy="bm25")) == [3, 1]
    both = hybrid.hybrid_search(chunks, "api token", [1.0, 0.0], strategy="hybrid", normalised=True, as_of=date(2024, 1, 10))
    assert ids(both)[0] == 1 and set(ids(both)) == {1, 2, 3, 4} and both.agg(F.max("hybrid_score")).first()[0] <= 1
    assert ids(hybrid.hybrid_search(chunks, "api token", [1.0, 0.0], strategy="hybrid", min_score=0.5)) == []
    assert ids(hybrid.hybrid_search(chunks.where("chunk_id > 10"), "api", [1.0, 0.0], strategy="hybrid")) == []


def test_search_refuses(chunks):
    for options in ({"query": " "}, {"k": 0}, {"strategy": "other"}):
        with pytest.raises(ValueError):
            hybrid.plan(**({"chunks": chunks, "query": "api", "vector": [1.0, 0.0]} | options))
    with pytest.raises(ValueError):
        hybrid.Settings(vector_weight=-1)
    with pytest.raises(ValueError):
        hybrid.Settings(boosts={"other": 0.1})


def test_pages_follow_cursors(chunks):
    first = hybrid.semantic_search(chunks, "api token", [1.0, 0.0], 4, 3, mode="ids_only").orderBy("rank").collect()
    assert [r["rank"] for r in first] == [1, 2, 3] and first[0].has_more and first[0].total_found == 4
    second = hybrid.semantic_search(chunks, "api token", [1.0, 0.0], 4, 3, first[0].next_cursor, "ids_only").collect()
    assert [r["rank"] for r in second] == [4] and not second[0].has_more and second[0].next_cursor is None
    assert hybrid.semantic_search(chunks, "other", [1.0, 0.0], 4, 3, first[0].next_cursor, fields=["chunk_id", "rank"]).agg(F.min("rank")).first()[0] == 1


def test_nested_names_and_json(spark):
    df = spark.sql("select 1 as rank, named_struct('long_name', array(named_struct('long_name', 2))) as item, date'2024-01-02' as day, cast(null as string) as gone")
    short = respond.shorten_nested(df, {"long_name": "n", "rank": "r"})
    assert short.columns == ["r", "item", "day", "gone"] and short.first()["item"]["n"][0]["n"] == 2
    assert df.select(respond.as_json(df).alias("j")).first().j == '{"rank":1,"item":{"long_name":[{"long_name":2}]},"day":"2024-01-02","gone":null}'
    assert respond.envelope(df.limit(0), "ids_only").first().returned == 0


def test_vendor_states(spark):
    nodes = spark.createDataFrame([("a", "Acme", "ORG", 0.9), ("b", "Twin", "ORG", 0.5), ("c", "twin", "ORG", 0.6), ("p", "Part", "PRODUCT", 0.7)], "id string, text string, entity_type string, confidence double")
    edges = spark.createDataFrame([("a", "p", "makes", 0.8), ("b", "p", "makes", 0.8)], "source string, target string, relationship_type string, confidence double")
    found = graph.vendor_info(nodes, edges, "acme", "full").first()
    assert found.status == "found" and found.entities[0].snippet == "Part" and found.relationships[0].confidence == 0.8 and found.statistics.entity_count == 1
    for name, status in (("TWIN", "ambiguous"), ("none", "not_found")):
        row = graph.vendor_info(nodes, edges, name, "preview").first()
        assert row.status == status and row.entities is None and row.statistics is None
    assert graph.vendor_info(nodes, edges, "acme", "ids_only", ["entity_ids"]).first().entity_ids == ["a"]
    with pytest.raises(ValueError):
        graph.vendor_info(nodes, edges, "acme", "other")
    assert [(r.id, r.min_distance) for r in graph.two_levels(nodes, edges, "a").collect()] == [("p", 1), ("b", 2)]


def test_files_to_chunks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.b.md").write_text("---\ntitle: X\ndraft: TRUE\ntags: ['u', v]\n---\n# Head\n\nOne.\n \nTwo words\n")
    (tmp_path / "sub" / "t.txt").write_bytes(b"bad \xff byte")
    (tmp_path / "skip.html").write_text("no")
    (tmp_path / "e.md").write_text("")
    rows = markdown.ingest(spark, str(tmp_path)).orderBy("path", "chunk_index").collect()
    assert [(r.title, r.chunk_index, r.chunk_text) for r in rows] == [("a.b", 0, "# Head"), ("a.b", 1, "One."), ("a.b", 2, "Two words\n".strip()), ("t", 0, "bad � byte")]
    assert rows[1].context_header == "a.b.md > Chunk 1" and '"flag":true' in rows[0].front and len({r.chunk_id for r in rows}) == 4


def test_front_matter_forms(spark):
    text = "---\n# c\na: 'q'\na: \"r\"\nno colon\nflag: False\nlist: [x, \"y\"]\nurl: http://h\n---\nbody"
    df = spark.createDataFrame([(text,), ('~~~json\n{"a": 1, "t": ["x"]}\n~~~\nrest',), ("plain",), ("~~~json\nnot\n~~~\n",), (None,)], "t string")
    got = df.select(markdown.front_values(F.col("t")).alias("m"), markdown.json_front(F.col("t")).alias("j"), markdown.body(F.col("t")).alias("b")).collect()
    assert got[0].m["a"].text == "r" and got[0].m["flag"].flag is False and got[0].m["list"]["items"] == ["x", "y"] and got[0].m["url"].text == "http://h" and got[0].b == "body"
    assert got[1].j == {"a": "1", "t": '["x"]'} and got[1].b == "rest" and got[2].m == {} and got[2].j is None and got[2].b == "plain"
    assert not got[3].j and got[4].b is None


def test_links_sentences_and_headings(spark):
    df = spark.createDataFrame([("```\n[a](b)\n```\n[c](d) [e](f)",)], "t string")
    assert [tuple(x) for x in df.select(markdown.links(F.col("t")).alias("l")).first().l] == [("a", "b", 2), ("c", "d", 4), ("e", "f", 4)]
    at = lambda text, i: spark.range(1).select(markdown.sentence_start(F.lit(text), F.lit(i)).alias("s")).first().s
    assert [at("One. Two. Three", 12), at("No end here", 5), at("", 0), at("One.", 4), at("One.    x", 5)] == [10, 5, 0, 4, 5]
    last = spark.createDataFrame([("A. B! C",), ("  ",), (None,)], "t string").select(markdown.last_sentence(F.col("t")).alias("s")).collect()
    assert [r.s for r in last] == ["C", "", ""]
    heads = spark.createDataFrame([("# a\n```\n# x\n```\n## b\n```\n# y",)], "t string").select(documents.headings(F.col("t")).alias("h")).first().h
    assert [(h.level, h.text, h.line) for h in heads] == [(1, "a", 1), (2, "b", 5)]


def test_batches_of_uneven_ids(spark):
    df = spark.createDataFrame([(i * i,) for i in range(25)], "id long")
    rows = markdown.batches(df, 10, "id").orderBy("id").collect()
    assert [r.batch for r in rows] == [i // 10 for i in range(25)] and rows[-1].end == 25
    assert markdown.batches(df.limit(0), 10, "id").count() == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_tokens_decode_to_the_text(spark):
    df = spark.createDataFrame([("héllo  wörld\n123",), ("",), (None,)], "text string")
    rows = markdown.tokenized(df, VOCABULARY, limit=3).collect()
    assert [r.decoded for r in rows] == ["héllo  wörld\n123", "", ""] and rows[0].n_tokens > 3 and not rows[0].within_limit and rows[1].n_tokens == 0


def test_arrays_and_grades(spark):
    arrays = spark.createDataFrame([([1, 2], ["a", "b"]), ([], [])], "k array<long>, v array<string>")
    old = spark.createDataFrame([(1, "z", "then"), (3, "y", "then")], "k long, v string, updated_at string")
    got = {r.k: (r.v, r.updated_at, r.action) for r in sinks.stamped(sinks.from_arrays(arrays, ["k", "v"]), old, "k", F.lit("now")).collect()}
    assert got == {1: ("a", "now", "updated"), 2: ("b", "now", "inserted"), 3: ("y", "then", "kept")}
    judged = spark.createDataFrame([("q", 1, 3.0, 0), ("q", 2, 2.0, 5), ("none", 3, 1.0, 0)], "query_id string, id long, score double, grade int")
    rows = metrics.graded(judged, "score").collect()
    assert len(rows) == 1 and rows[0].ndcg == 1.0 and rows[0].precision == 0.5 and rows[0].recall == 1.0
