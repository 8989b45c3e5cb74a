"""What is stored once and read in part: the graph, the vector index, streams that merge; and what is counted or set apart on the way."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import apart, graph, respond, vector_index
from tessera.sources import graph_tables as gt
from tessera.sources import sinks, stored
from tessera.streaming import merge, state

D = "/root/testdata/sf0.001"


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_graph_reads_its_keys_alone(spark):
    x = gt.stored_graph(spark, D)
    assert gt.stored_graph(spark, D).edges.inputFiles() == x.edges.inputFiles()
    plan = plan_of(graph.one_hop(x.nodes, x.edges, "S1", 0.6))
    assert "EqualTo(source,S1)" in plan and "source_bucket_64" in plan and "lineitem" not in plan
    plan = plan_of(graph.two_hop(x.nodes, x.edges, "C1", 0.6))
    assert "dynamicpruning" in plan and "lineitem" not in plan
    assert len(x.edges.where("source_bucket_64 = 3").inputFiles()) <= len(x.edges.inputFiles())
    assert x.edges.count() == gt.edges(spark, D).count() == x.by_target.count()


def test_plain_and_stored_graphs_agree(spark):
    x, n, e, m = gt.stored_graph(spark, D), gt.nodes(spark, D), gt.edges(spark, D), gt.mentions(spark, D)
    same = lambda a, b: a.collect() == b.collect()
    assert same(graph.one_hop(n, e, "S2", 0.5).select("id", "text", "relationship_type"), graph.one_hop(x.nodes, x.edges, "S2", 0.5).select("id", "text", "relationship_type"))
    columns = ["id", "mid_id", "mid_text", "text", "first_type", "second_type", "path_confidence"]
    assert same(graph.two_hop(n, e, "C2", 0.6).select(columns), graph.two_hop(x.nodes, x.edges, "C2", 0.6).select(columns))
    assert same(graph.bidirectional(n, e, "S3", 0.4), graph.bidirectional(x.nodes, x.edges, "S3", 0.4, by_target=x.by_target))
    assert same(graph.two_levels(n, e, "S4", 0.6), graph.two_levels(x.nodes, x.edges, "S4", 0.6, by_target=x.by_target))
    assert same(graph.co_mentioned(m, "P2"), graph.co_mentioned(x.mentions, "P2", by_document=x.by_document))


def test_stored_tables_follow_their_sources(spark, tmp_path):
    source, built = str(tmp_path / "s"), []
    spark.range(3).write.parquet(source)
    first = stored.stored(spark, "x", [source], built.append)
    assert stored.stored(spark, "x", [source], built.append) == first and built == [first]
    spark.range(4).write.mode("overwrite").parquet(source)
    assert stored.stored(spark, "x", [source], built.append) != first and len(built) == 2


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 8)) * 10
    return centres[np.arange(1000) % 20] + r.normal(size=(1000, 8)) * 0.1


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_vector_index_is_exact_and_reads_few_partitions(spark, clustered, metric, tmp_path):
    rows = [(i, v.tolist(), 1) for i, v in enumerate(clustered)] + [(2000, None, 1), (2001, [float("inf")] * 8, 1), (2002, [0.0] * 8, 1), (2003, [1.0], 1), (2004, clustered[5].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind int")
    index = vector_index.build(df.where("vec_id < 900 or vec_id >= 2000"), str(tmp_path / "i"), metric, clusters=20)
    vector_index.add(index, df.where("vec_id between 900 and 999"))
    index = vector_index.VectorIndex.open(spark, index.path)
    x = np.vstack([clustered, clustered[5], np.zeros(8)])
    ids = np.array([*range(1000), 2004, 2002])
    for q in (clustered[5], clustered[123] + 0.05, np.ones(8)):
        with np.errstate(invalid="ignore"):
            far = 1 - x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q)) if metric == "cosine" else np.linalg.norm(x - q, axis=1)
        far = np.where(np.isnan(far), np.inf, far)
        want = ids[np.lexsort((ids, far.round(12)))][:7].tolist()
        assert [r.vec_id for r in vector_index.search(index, q.tolist(), 7).orderBy("rank").collect()] == want
        assert np.allclose([r.distance for r in vector_index.search(index, q.tolist(), 7).orderBy("rank").collect()], np.sort(far)[:7])
    read = vector_index.wanted(index, clustered[5].tolist(), 7)
    assert 1 <= len(read) <= 4 < index.rows().select("cluster").distinct().count()
    plan = plan_of(vector_index.search(index, clustered[5].tolist(), 7))
    assert "PartitionFilters: [cluster" in plan.replace("isnotnull(", "").replace("\n", "")[:100_000] or "PartitionFilters" in plan
    assert vector_index.search(index, clustered[5].tolist(), 7, F.col("kind") == 2).count() == 0
    assert vector_index.search(index, [1.0], 7).count() == 0


def test_empty_vector_index(spark, tmp_path):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    index = vector_index.build(df, str(tmp_path / "i"))
    assert vector_index.search(index, [1.0], 3).count() == 0


def test_replayed_batches_change_nothing(spark, tmp_path):
    table = merge.MergedTable(spark, str(tmp_path / "t"), "id", "id long, value string, at int", 4)
    batch = lambda *rows: spark.createDataFrame(rows, "id long, value string, at int, more int")
    now = lambda: sorted(tuple(r) for r in table.rows().collect())
    assert now() == []
    table.merge(batch((1, "a", 1, 0), (2, "b", 1, 0), (2, "old", 0, 0), (None, "x", 1, 0)), 0, "at")
    table.merge(batch((2, "c", 2, 0), (3, "d", 2, 0)), 1, "at")
    want = [(1, "a", 1), (2, "c", 2), (3, "d", 2)]
    assert now() == want
    log = sorted(map(tuple, table.log().collect()))
    table.merge(batch((1, "again", 9, 0)), 0, "at")  # the batch is in the log
    assert now() == want and sorted(map(tuple, table.log().collect())) == log
    assert sum(r.inserted for r in table.log().collect()) == 3 and sum(r.updated for r in table.log().collect()) == 1 and sum(r.repeated for r in table.log().collect()) == 1


def test_stream_merges_files(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "id long, value string, at int"
    table = merge.MergedTable(spark, str(tmp_path / "t"), "id", schema, 4)
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: table.follow(spark.readStream.schema(schema).parquet(source), str(tmp_path / "c"), "at").awaitTermination(120)
    put((1, "a", 1), (2, "b", 1))
    assert run()
    put((2, "c", 2), (3, "d", 2))
    assert run() and run()
    assert sorted(tuple(r) for r in table.rows().collect()) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]


def test_fresh_rows_of_a_stream(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "chunk_hash string, ts timestamp"
    rows = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 01:00:00'), ('b', timestamp'2024-01-01 02:00:00') as t(chunk_hash, ts)")
    rows.coalesce(1).write.parquet(source)
    fresh = state.fresh_rows(spark.readStream.schema(schema).parquet(source))
    fresh.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.chunk_hash for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_ingest_counts_in_one_pass(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("# One\n\ntwo words\n\nthree more words")
    (folder / "b.txt").write_text("one paragraph")
    (folder / "blank.md").write_text(" \n\n ")
    (folder / "bad.md").write_bytes(b"caf\xe9 \xff")
    seen = apart.ingest(spark, str(folder), str(tmp_path / "out"))
    assert {k: seen[k] for k in ("files", "failed", "chunks", "tokens", "vectors", "refused")} == {"files": 4, "failed": 2, "chunks": 4, "tokens": 9, "vectors": 4, "refused": 0} and seen["seconds"] > 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    from tessera.operators import markdown

    assert {r.path.rpartition("/")[2]: r.error for r in apart.failed_files(markdown.read_files(spark, str(folder))).collect()} == {"blank.md": "blank", "bad.md": "undecodable"}


def test_bad_rows_are_set_apart(spark, tmp_path):
    texts = [(i, t, 7) for i, t in enumerate(["one", "", "two", None, "three"] + ["more text"] * 30)]
    made = apart.mapped(spark.createDataFrame(texts, "id long, text string, error int"), "text")
    rows = made.collect()
    assert {r.id for r in rows if r.error} == {1, 3} and all((r.embedding is None) == bool(r.error) for r in rows) and "blank" in next(r.error for r in rows if r.id == 1)
    calls = []

    def model(values):
        calls.append(len(values))
        if (values == "bad").any():
            raise RuntimeError("no")
        return values.str.upper()

    found, errors = apart.one_by_one(pd.Series(["a", "bad", "c", "d", "bad"]), model)
    assert found == ["A", None, "C", "D", None] and errors == [None, "RuntimeError: no", None, None, "RuntimeError: no"] and len(calls) < 10
    bad = [(100, None), (101, [1.0]), (102, [float("nan")] * 64), (103, [float("inf")] * 64)]
    both = made.select("id", "embedding", "error").unionByName(spark.createDataFrame([(*r, None) for r in bad], "id long, embedding array<float>, error string"))
    assert apart.write_vectors(both, str(tmp_path / "v"), 64) == {"rows": 39, "refused": 6, "stored": 33}
    back = spark.read.parquet(str(tmp_path / "v"))
    assert {r.id: r.error for r in back.where("state = 'refused' and id >= 100").collect()} == {100: "missing", 101: "dimension", 102: "not finite", 103: "not finite"}
    assert back.where("state = 'stored' and error is null").count() == 33


def test_content_duplicates(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [("p", 1, "A  text", v), ("p", 2, "a text ", None), ("p", 3, "other", [2.0, 0.01]), ("p", 4, None, w), ("p", 5, None, None), ("p", 6, "third", w), ("q", 1, "a text", v), ("p", 51, "a text", v), ("q", 2, "q", [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "query_id string, rank int, text string, embedding array<double>, page int")
    got = {(r.query_id, r["rank"]): r.duplicate_of for r in respond.content_duplicates(df).collect()}
    assert got == {("p", 1): None, ("p", 2): 1, ("p", 3): 1, ("p", 4): None, ("p", 5): None, ("p", 6): 4, ("q", 1): None, ("p", 51): None, ("q", 2): None}


def test_report_is_written_once(spark, tmp_path):
    sinks.write_report(spark.range(2), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_report(spark.range(2), str(tmp_path / "r"))
