"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, in which neighbours share bits, and cut into nodes of the index. A node's
pattern is the bits that all its members share. A fingerprint descends only into nodes whose pattern differs from
it in no more bits than allowed; below, smaller groups add the bits that they share beyond their parent's, and the
differences accumulate until the group is pruned or its members are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, cut, mix64, spread
from tessera.llm.components import connected_components, star_edges

#: Nodes of the upper level at most: every task holds one mask and pattern of each. And fingerprints in a node aimed at.
MAX_NODES, NODE_ROWS = 4096, 4096


def bit_majority(h: np.ndarray) -> int:
    """The number whose bits are those set in over half of the given 64-bit hashes."""
    if not len(h):
        return 0
    lanes = np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(len(h), 64).view(np.uint64)
    sums = np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0)  # bytes can't overflow within 255 rows
    count = sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * count > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


def shingles(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of all shingles of `words` words in their order: A-Z in lower case, words between ASCII white space."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True) if words > 1 else zip(starts.tolist(), ends.tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(parts) - words + 1)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of a text over its shingles of `words` words; 0 without words."""
    return bit_majority(shingles(text, words, seed))


def joint(fp: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for a pair of fingerprints."""
    return mix64(fp ^ mix64(second))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, second: int | None = None) -> DataFrame:
    """(doc_id, fp, second, node): the fingerprint of each row's whole text as a long of the same 64 bits. Null or blank texts: 0.

    With a number of words for second, that is the fingerprint over shingles of so many words, and node stands for
    both; else second is null and node is fp.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            fp = np.array([fingerprint(t, words) for t in texts], np.uint64)
            more, node = pa.nulls(len(fp), pa.int64()), fp
            if second is not None:
                other = np.array([fingerprint(t, second) for t in texts], np.uint64)
                more, node = pa.array(other.view(np.int64)), joint(fp, other)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), more, pa.array(node.view(np.int64))], ["doc_id", "fp", "second", "node"])

        return step

    return arrow_map(spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))), make, "doc_id long, fp long, second long, node long")


def gray_rank(fp: Column) -> Column:
    """The place of a code in Gray order, as a long whose signed order is the order of the unsigned rank."""
    for by in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, by))
    return fp.bitwiseXOR(F.lit(-(2**63)).cast("long"))


def turned(fp: Column, by: int) -> Column:
    """The 64 bits rotated to the left."""
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by)) if by else fp


def turned_back(x: np.ndarray, by: int) -> np.ndarray:
    return x >> np.uint64(by) | x << np.uint64(64 - by) if by else x


def forest(queries: np.ndarray, members: np.ndarray, most: int, head: np.uint64, few: int, also: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, fanout: int = 16, leaf: int = 64) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Links that connect what all links between queries and members connect; members are in Gray order.

    Yields (whether the first places are of queries or else of members, places, places of members). A link is a pair
    that differs in `most` bits at most, and of whose places also() agrees. A group is entered by queries that
    differ from what its members share in `most` bits at most, and in `few` at most of those in head. Queries that
    are already connected to all of a group pass it by, so thousands of near copies cost no square of their number.
    """
    part, of = np.arange(len(members)), np.full(len(queries), -1)
    order = np.argsort(members, kind="stable")
    at = np.minimum(np.searchsorted(members, queries, sorter=order), len(members) - 1)
    if also is None:  # a query that is a member starts in its part
        same = members[order[at]] == queries
        of[same] = order[at[same]]
    stack = [(0, len(members), np.arange(len(queries)), np.zeros(len(queries), np.int64), np.uint64(0))]
    while stack:
        lo, hi, at, used, known = stack.pop()
        if (part[lo:hi] == part[lo]).all():
            go = (of[at] < 0) | (part[of[at]] != part[lo])
            at, used = at[go], used[go]
        if not len(at):
            continue
        if hi - lo <= leaf:
            i, j = np.nonzero(np.bitwise_count(queries[at][:, None] ^ members[lo:hi][None]) <= most)
            i, j = at[i], j + lo
            if also is not None:
                fine = also(i, j)
                i, j = i[fine], j[fine]
            if not len(i):
                continue
            rows, first = np.unique(i, return_index=True)
            lead = np.repeat(j[first], np.diff(np.append(first, len(i))))
            held = of[rows] >= 0
            new = rows[~held]
            if len(new):
                yield True, new, j[first][~held]
            # What a query links is one part: its first member here, its other members, and its part so far.
            u = np.concatenate([lead, j[first][held]])
            v = np.concatenate([j, of[rows[held]]])
            code = np.unique(part[u] * len(members) + part[v])
            u, v = code // len(members), code % len(members)
            u, v = u[u != v], v[u != v]
            if len(u):
                x, low = star_edges(u, v)
                yield False, x, low
                name = np.arange(len(members))
                name[x] = low
                part = name[part]
            of[new] = j[first][~held]
            continue
        step = -(-(hi - lo) // fanout)
        for s in range(lo, hi, step):
            e = min(hi, s + step)
            every, any_ = np.bitwise_and.reduce(members[s:e]), np.bitwise_or.reduce(members[s:e])
            shared = ~(every ^ any_)
            total = used + np.bitwise_count((queries[at] ^ every) & (shared & ~known))
            go = (total <= most) & (np.bitwise_count((queries[at] ^ every) & shared & head) <= few)
            if go.any():
                stack.append((s, e, at[go], total[go], shared))


def links(fps: DataFrame, most: int = 2, orders: int = 1, second_most: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct nodes (columns node, fp, second) that connect the same ones as all links.

    A link is a pair of fingerprints that differ in `most` bits at most and, if second_most is given, with second
    fingerprints that differ in second_most at most. With more than one order the index is built for rotations of the
    fingerprint by 64 / orders bits each: of two that differ in `most` bits, one rotation has most // orders of them
    or fewer in its leading bits, and only groups that agree so far are entered. Of a task's pairs only a spanning
    forest is returned, so thousands of near copies give thousands of edges. Work between two nodes of the index is
    done once, from the one of lower rank.
    """
    n = fps.count()
    nodes = int(min(MAX_NODES, max(1, n * orders // NODE_ROWS)))
    bits = 64 // orders
    head, few = np.uint64((2**bits - 1) << (64 - bits)), most // orders
    width = 1 if second_most is None else 2

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("order", pa.int32()), ("node", pa.int64()), ("every", pa.int64()), ("any", pa.int64()), ("fps", pa.binary())])
        for batch in batches:
            by, x = batch.column(0).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            ends = np.flatnonzero(np.append(np.diff(by) != 0, True)) + 1 if len(by) else []
            rows = []
            for a, b in zip([0, *ends[:-1]], ends, strict=True) if len(by) else ():
                data = x[a:b].tobytes() + (batch.column(3).to_numpy()[a:b].tobytes() if width > 1 else b"")
                rows.append({"order": int(by[a]), "node": batch.column(1)[a].as_py() * orders + int(by[a]), "every": int(np.bitwise_and.reduce(x[a:b]).view(np.int64)), "any": int(np.bitwise_or.reduce(x[a:b]).view(np.int64)), "fps": data})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)

    each = fps.select("second", F.explode(F.array(*[F.struct(F.lit(o).alias("order"), turned(F.col("fp"), bits * o).alias("fp")) for o in range(orders)])).alias("x"))
    each = each.select("x.order", "x.fp", "second", gray_rank(F.col("x.fp")).alias("rank"))
    dealt = each.repartitionByRange(nodes, "order", "rank").sortWithinPartitions("order", "rank")
    packed = dealt.select("order", F.spark_partition_id().cast("long").alias("node"), "fp", "second").mapInArrow(pack, "order int, node long, every long, any long, fps binary")
    blocks = cut(packed.withColumn("block", F.monotonically_increasing_id()))
    # At most MAX_NODES rows and one more for each order (or as many as the session forces partitions), whatever the number of fingerprints.
    top = sorted(tuple(r) for r in blocks.groupBy("node", "order").agg(F.bit_and("every"), F.bit_or("any")).collect())
    node_ids, node_orders = np.array([t[0] for t in top], np.int64), np.array([t[1] for t in top], np.int64)
    every, any_ = (np.array([t[i] for t in top], np.int64).view(np.uint64) for i in (2, 3))
    shared = ~(every ^ any_)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for order, node, block, data in zip(*(batch.column(c).to_pylist() for c in ("order", "node", "block", "fps")), strict=True):
                both = np.frombuffer(data, np.uint64).reshape(width, -1)
                x, out = both[0], []
                for k in range(int(np.searchsorted(node_ids, node)), len(node_ids)):
                    if node_orders[k] != order:
                        continue
                    off = (x ^ every[k]) & shared[k]
                    some = (np.bitwise_count(off) <= most) & (np.bitwise_count(off & head) <= few)
                    if some.any():
                        out.append({"node": int(node_ids[k]), "q_node": node, "q_block": block, "q": both[:, some].tobytes()})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("node", pa.int64()), ("q_node", pa.int64()), ("q_block", pa.int64()), ("q", pa.binary())]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for by, q, data in zip(*(batch.column(c).to_pylist() for c in ("order", "q", "fps")), strict=True):
                q, x = (np.frombuffer(d, np.uint64).reshape(width, -1) for d in (q, data))
                also = None if width == 1 else (lambda i, j, q=q, x=x: np.bitwise_count(q[1][i] ^ x[1][j]) <= second_most)
                qn, xn = (turned_back(z[0], bits * by) if width == 1 else joint(turned_back(z[0], bits * by), z[1]) for z in (q, x))
                found = [((qn if of_queries else xn)[i], xn[j]) for of_queries, i, j in forest(q[0], x[0], most, head, few, also)]
                if found:
                    u, v = (np.concatenate(c) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(u[u != v].view(np.int64)), pa.array(v[u != v].view(np.int64))], ["a", "b"])

    asked = blocks.select("order", "node", "block", "fps").mapInArrow(visits, "node long, q_node long, q_block long, q binary")
    met = asked.join(blocks.select("order", "node", "block", "fps"), "node").where("q_node < node or q_block <= block")
    return met.select("order", "q", "fps").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 2, orders: int = 1, second: int | None = None, second_most: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id that can be reached over links, the row's own included (null where no
    reachable row has an id). Rows whose fingerprints differ in `most` bits or fewer are linked (with second, a number
    of words, only if the fingerprints over such shingles differ in second_most or fewer too; more than one order is
    for `most` beyond a few bits: see links); equal texts always are, and so are rows without words (fingerprint 0).
    Null ids and repeated rows keep their rows. Other columns of docs are not read. An empty table gives no rows.
    """
    own = cut(fingerprints(docs, id_col, text_col, words, second))
    once = own.groupBy("node").agg(F.first("fp").alias("fp"), F.first("second").alias("second"), F.min("doc_id").alias("low"))
    joined = connected_components(links(once, most, orders, second_most))
    parts = once.select("node", "low").join(joined, "node", "left").withColumn("part", F.coalesce("component", "node"))
    lowest = parts.groupBy("part").agg(F.min("low").alias("component_id"))
    return own.join(parts.select("node", "part").join(lowest, "part").select("node", "component_id"), "node").select("doc_id", "fp", "component_id")


#: For copies whose shingles of five words have a similarity of 0.8 or more: such pairs differ in 10 or fewer bits of one
#: fingerprint and 14 or fewer of the other (few pairs do more), texts with nothing in common in about 32 of each.
COPIES = {"words": 3, "most": 10, "orders": 4, "second": 5, "second_most": 14}
