"""Names of runs of lines by doubling, the table of repeated hashes, and how often line dedup writes to disk."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import common, line_dedup

PASSAGE = "\n".join(f"Line {w} of a passage of some words." for w in ("one", "two", "three", "four", "five", "six"))
TEXTS = [(i, f"Own {i} begins.\n{PASSAGE}\nOwn {i} ends? Yes {i}. {PASSAGE if i % 2 else ''}") for i in range(20)] + [(50, None), (51, "")]


def test_names_tell_runs_apart():
    rng = np.random.default_rng(7)
    letters = rng.integers(0, 2, 300)  # few kinds of units, so that runs repeat at all lengths
    digest = rng.integers(-(2**63), 2**63 - 1, (2, 2))[letters]
    first = np.repeat(np.arange(260), 40)
    size = np.tile(np.arange(1, 41), 260)
    name = line_dedup.names(digest, first, size)
    runs, named = {}, {}
    for f, n, x in zip(first.tolist(), size.tolist(), name.tolist(), strict=True):
        run = tuple(letters[f : f + n])
        assert runs.setdefault(run, x) == x
        assert named.setdefault((n, *x), run) == run


def test_table_holds_all_its_hashes_however_full(spark):
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    df = spark.createDataFrame([(int(h),) for h in hashes], "run long")
    for most in (10, 27):
        table = line_dedup.table_of(df, most)
        assert line_dedup.held_by(table, hashes).all()
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 3000)
    assert line_dedup.held_by(table, others).mean() < 0.06
    assert not line_dedup.held_by(line_dedup.table_of(df.where("false")), others).any()


def test_a_full_table_changes_no_row(spark, monkeypatch):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(5)
    want = sorted(map(tuple, line_dedup.without_repeats(df).collect()))
    made = line_dedup.table_of
    monkeypatch.setattr(line_dedup, "table_of", lambda hashes: np.full_like(made(hashes), 2**64 - 1))
    assert sorted(map(tuple, line_dedup.without_repeats(df).collect())) == want
    monkeypatch.setattr(common, "ROWS_AT_MOST", 0)  # with joins that are shuffled
    assert sorted(map(tuple, line_dedup.without_repeats(df).collect())) == want
    assert sum(len(r[3]) for r in want) > 100


def test_a_turn_is_dealt_out_once(spark, monkeypatch):
    """No level of the doubling is written or shuffled: it was stopped for its disk on check_h, most of it small files."""
    made, cut = [], line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df: made.append(df) or cut(df))
    line_dedup.without_repeats(spark.createDataFrame(TEXTS, "doc_id long, text string")).collect()
    assert len(made) <= 10


def test_ranges(spark):
    assert line_dedup.numbers([1, 3, 7, 8]) == [1, 2, 7] and line_dedup.numbers(None) == []
    rows = [(0, 1, 5, s, n, 0, 0, 9, 0) for s, n in ((4, 3), (0, 2), (5, 1), (7, 2), (20, 1), (0, 1))] + [(0, 2, 6, 8, 4, 0, 2, 6, 6), (0, 3, 7, 1, 2, 0, 3, 7, 1)]
    runs = spark.createDataFrame(rows, "none int, id long, doc long, seq int, lines int, lead_none int, lead_id long, lead_doc long, lead_seq int")
    assert {r.id: r.gone for r in line_dedup.beyond_first(runs).collect()} == {1: [0, 2, 4, 9, 20, 21], 2: [10, 12]}


def test_all_lists_count_for_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "INTS_AT_MOST", 5)
    df = spark.createDataFrame([(1, [1, 2], [1, 2, 3]), (2, None, [1])], "id long, a array<int>, b array<int>")
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(common.small(df, "a")) and not hinted(common.small(df, "a", "b")) and hinted(common.small(df.select(F.col("id"))))
