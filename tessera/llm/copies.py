"""Groups of near copies: SimHash proposes groups of texts, the exact Jaccard similarity of their shingle sets links within them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, cut, lean, shuffle_partitions, spread
from tessera.llm.components import connected_components
from tessera.llm.simhash import bit_majority, fingerprint, joint, links, shingles

#: Distances that make a candidate; wider than those of simhash.COPIES, as a check follows. Much wider ones connect texts at random.
CANDIDATES = {"most": 15, "orders": 4, "second_most": 18}
#: Shingle sets in a block and their bytes, about.
BLOCK_ROWS, BLOCK_BYTES = 1024, 4_000_000


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns of a row, in which nulls have places."""
    return F.xxhash64(*[x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))])


def described(docs: DataFrame, id_col: str, text_col: str, words: int, second: int) -> DataFrame:
    """(doc_id, row, text_hash, sig, node, fp, second): row is the row's key, sig that of its set of shingles of `second` words (0 when empty)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp, more, sig = [], [], []
            for text in batch.column(3).to_pylist():
                parts = shingles(text, second)
                fp.append(fingerprint(text, words))
                more.append(bit_majority(parts))
                sig.append(xxhash.xxh64_intdigest(np.unique(parts).tobytes()) if len(parts) else 0)
            fp, more, sig = (np.array(x, np.uint64) for x in (fp, more, sig))
            return pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x.view(np.int64)) for x in (sig, joint(fp, more), fp, more))], ["doc_id", "row", "text_hash", "sig", "node", "fp", "second"])

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(docs).alias("row"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return arrow_map(spread(rows), make, "doc_id long, row long, text_hash long, sig long, node long, fp long, second long")


def alike(a: list[np.ndarray], b: list[np.ndarray], same: bool, least: float) -> Iterator[tuple[int, int]]:
    """Pairs of places (in a, in b) of sets with a Jaccard similarity of `least` or more that connect what all such pairs connect."""
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    flat, owner = np.concatenate(b), np.repeat(np.arange(len(b)), size_b)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    part = np.arange(len(a) if same else len(a) + len(b))
    of_b = part if same else part[len(a) :]
    for i, x in enumerate(a):
        want = (np.minimum(size_b, len(x)) >= least * np.maximum(size_b, len(x)) - 1e-9) & (of_b != part[i])
        if same:
            want[: i + 1] = False
        if not want.any():
            continue
        lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(b))
        hits = np.flatnonzero(want & (shared >= least * (len(x) + size_b - shared) - 1e-9))
        if len(hits):
            yield from ((i, int(j)) for j in hits)
            part[np.isin(part, of_b[hits])] = part[i]


def similar(sets: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) between sigs of one part (columns part, size, sig, data) that connect what all pairs of a similarity of `least` or more connect.

    Sets are packed in blocks by part and size, so a part of any size is many blocks, and pairs of blocks are compared
    unless no sizes in them fit; within a pair, sets that are already connected are not compared again.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("part", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("sigs", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])
        for batch in batches:
            parts, sizes, sigs = (batch.column(c).to_numpy() for c in ("part", "size", "sig"))
            out, begin, held = [], 0, 0
            for end in range(1, len(parts) + 1):
                held += 8 * int(sizes[end - 1])
                if end == len(parts) or parts[end] != parts[begin] or end - begin >= BLOCK_ROWS or held >= BLOCK_BYTES:
                    out.append({"part": int(parts[begin]), "lo": int(sizes[begin]), "hi": int(sizes[end - 1]), "sigs": sigs[begin:end].tobytes(), "sizes": sizes[begin:end].tobytes(), "data": b"".join(batch.column("data")[begin:end].to_pylist())})
                    begin, held = end, 0
            yield pa.RecordBatch.from_pylist(out, kinds)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (x, xs), (y, ys) = ((np.split(np.frombuffer(row[f"data_{s}"], np.uint64), np.cumsum(np.frombuffer(row[f"sizes_{s}"], np.int64))[:-1]), np.frombuffer(row[f"sigs_{s}"], np.int64)) for s in "ab")
                found = list(alike(x, y, row["block_a"] == row["block_b"], least))
                if found:
                    i, j = np.array(found).T
                    yield pa.RecordBatch.from_arrays([pa.array(xs[i]), pa.array(ys[j])], ["a", "b"])

    dealt = sets.repartitionByRange(shuffle_partitions(sets.sparkSession), "part", "size", "sig").sortWithinPartitions("part", "size", "sig")
    packed = dealt.select("part", "size", "sig", "data").mapInArrow(lean(pack), "part long, lo long, hi long, sigs binary, sizes binary, data binary")
    blocks = cut(packed.withColumn("block", F.monotonically_increasing_id()))
    a, b = (blocks.select("part", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "lo", "hi")]) for s in "ab")
    met = a.join(b, "part").where("block_a <= block_b").where(F.col("hi_a") >= least * F.col("lo_b") - 1e-9).where(F.col("hi_b") >= least * F.col("lo_a") - 1e-9).select("block_a", "block_b")
    for s in "ab":
        met = met.join(blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in ("block", "sigs", "sizes", "data")]), f"block_{s}")
    return met.mapInArrow(lean(compare), "a long, b long").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, second: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, text_hash, sig) for every row of docs, row as of row_key(), and (sig, group) for every distinct set of shingles.

    Rows of one sig have the same set of shingles of `second` words, rows without words the empty one. Sets are linked
    if their Jaccard similarity is `least` or more; groups are what links connect. Links are sought within groups that
    connect fingerprints over shingles of `words` and of `second` words at the distances of CANDIDATES, and within
    these between all pairs.
    """
    own = cut(described(docs, id_col, text_col, words, second))
    once = cut(own.groupBy("sig").agg(F.min(F.struct("row", "node", "fp", "second")).alias("x")).select("sig", "x.*"))
    near = connected_components(links(once.select("node", "fp", "second").dropDuplicates(["node"]), **CANDIDATES))
    placed = cut(once.select("sig", "row", "node").join(near, "node", "left").select("sig", "row", F.coalesce("component", "node").alias("part")))
    wanted = placed.join(placed.groupBy("part").count().where("count > 1").select("part"), "part")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [np.unique(shingles(text, second)) for text in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("part"), pa.array([len(x) for x in sets], pa.int64()), batch.column("sig"), pa.array([x.tobytes() for x in sets], pa.binary())], ["part", "size", "sig", "data"])

        return step

    texts = docs.select(row_key(docs).alias("row"), F.col(text_col).alias("text")).join(wanted, "row").dropDuplicates(["row"])
    sets = cut(arrow_map(texts.select("part", "sig", "text"), make, "part long, size long, sig long, data binary"))
    linked = connected_components(similar(sets, least))
    return own.select("doc_id", "row", "text_hash", "sig"), once.select("sig").join(linked, once["sig"] == linked["node"], "left").select("sig", F.coalesce("component", "sig").alias("group"))
