"""Language-model scoring by online logistic mixing of context predictors, bit by bit.

A token is coded as the bits of its Huffman code in a lexicon of the corpus' frequent tokens, any other as an escape
and its bytes. Every bit is predicted by the low, middle and high context (for tokens: none, the token before, the two
before; for bytes: one, three, five before), whose counts over all learning documents stand in tables by a hash of
context and code prefix, and by what the document itself has shown so far. The predictions are mixed in the logistic
domain by weights that a gate selects: token or byte, depth in the code, and which predictors know the context. The
weights are fitted by online Newton steps on all learning documents, each bit taken out of the counts before they
predict it, and go on adapting within each document. Plain token counts give the base score beside it.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, mix64, shared_folder, shuffle_partitions, spread
from tessera.llm.whitening import added

#: Tokens of the lexicon at most; bytes of the longest of them; slots of a hashed table at most, as a power of 2.
LEXICON, LONGEST, SLOT_BITS = 196_608, 64, 22
#: Entries of a table that travel as one row.
CHUNK = 65_536
#: Symbols after which a document's own statistics start afresh, and bits between two steps of its weights.
SPAN, STEP = 65_536, 4096
#: Bytes of text whose tokens are looked up at a time, and tokens whose symbols are made at a time.
AT_ONCE, TOKENS_AT_ONCE = 4 << 20, 16_000
ESCAPE, END, KINDS, INPUTS = 0, 1, 48, 5
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: The gate's share that depth gives for tokens (codes have less than 32 bits), and that of bytes.
DEPTHS, BYTES = [0] * 4 + [4] * 6 + [8] * 22, 12
HALF, LN2 = np.uint64(32), math.log(2)
A32, B32 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
#: A bit's predictors; its gate with the bit itself above six bits. Units of the predictors and of a constant.
INPUT = np.dtype([("own", np.float32), ("low", np.int8), ("middle", np.int8), ("high", np.int8), ("gate", np.uint8)])
UNITS = np.array([1 / 12, 1 / 12, 1 / 12, 1, 1])
#: Log of counts, by which a document's own predictions are looked up.
LOGS = np.log(np.arange(SPAN + 1) + 0.3).astype(np.float32)


def names_of(tokens: pa.Array) -> pa.Array:
    """Tokens as keys: themselves, or a hash (after a space, which no token holds) if they are long."""
    long = pc.greater(pc.binary_length(tokens), LONGEST)
    hashed = [b" " + hashlib.sha256(w).hexdigest().encode() for w in tokens.filter(long).to_pylist()]
    return pc.replace_with_mask(tokens, long, pa.array(hashed, pa.binary())).cast(pa.string()) if hashed else tokens.cast(pa.string())


def code_lengths(weights: list[int]) -> np.ndarray:
    """Bits of each symbol's Huffman code."""
    n = len(weights)
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    above = np.zeros(2 * n - 1, np.int64)
    for node in range(n, 2 * n - 1):
        (v, i), (w, j) = heapq.heappop(heap), heapq.heappop(heap)
        above[i] = above[j] = node
        heapq.heappush(heap, (v + w, node))
    depth = np.zeros(2 * n - 1, np.int64)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[above[node]] + 1
    return depth[:n]


@dataclass
class Code:
    """Canonical Huffman codes: short ones first, so that at each depth the inner nodes follow the leaves. prefix + inner[depth] is an inner node's number."""

    bits: np.ndarray
    lengths: np.ndarray
    inner: np.ndarray
    n_inner: int

    @classmethod
    def of(cls, weights: list[int]) -> Code:
        floor = 1  # lifts rare symbols until no code has more than 30 bits
        while (lengths := code_lengths([max(w, floor) for w in weights])).max() > 30:
            floor = max(2 * floor, sum(weights) >> 24)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        leaves = np.bincount(lengths).tolist()
        bits, inner = np.zeros(len(lengths), np.uint32), np.zeros(32, np.int64)
        first, nodes, place, at = 0, 1, 0, 0
        for depth, n in enumerate(leaves):
            bits[order[at : at + n]] = np.arange(first, first + n)
            inner[depth] = place - first - n
            first, nodes, place, at = (first + n) << 1, 2 * (nodes - n), place + nodes - n, at + n
        return cls(bits, lengths.astype(np.int32), inner, place)

    def by_node(self) -> np.ndarray:
        """inner for nodes that hold their depth's leading one."""
        return self.inner - (1 << np.arange(32))

    def counts(self, weights: np.ndarray) -> np.ndarray:
        """(zeros, ones) of each inner node, flat, from how often each symbol is."""
        rep = np.repeat(np.arange(len(self.bits)), self.lengths)
        depth = np.arange(len(rep)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        last = self.bits[rep].astype(np.int64) >> (self.lengths[rep] - depth - 1)
        return np.bincount(2 * ((last >> 1) + self.inner[depth]) + (last & 1), weights[rep], 2 * self.n_inner)


@dataclass
class Lexicon:
    """Tokens with their counts and codes, and codes of the bytes that spell others."""

    words: pa.Array
    counts: np.ndarray
    others: int
    tokens: Code
    bytes_: Code

    @classmethod
    def of(cls, words: list[tuple[bytes, int]], others: int, ends: int) -> Lexicon:
        counts = [0, ends, *(n for _, n in words)]
        letters = np.ones(256)
        for w, n in words[:5000]:
            np.add.at(letters, np.frombuffer(w + b" ", np.uint8), n**0.5)
        return cls(pa.array([w for w, _ in words], pa.binary()), np.array(counts, np.int64), others, Code.of([others + 1, ends + 1, *counts[2:]]), Code.of(letters.astype(int).tolist()))

    @property
    def ids(self) -> dict[bytes, int]:
        """Numbers of the tokens; the escape and the end come before them."""
        return {w: i + 2 for i, w in enumerate(self.words.to_pylist())}

    def numbers(self, tokens: pa.Array) -> np.ndarray:
        """Numbers of tokens; one that is not in the lexicon has that of the escape."""
        return pc.index_in(tokens, value_set=self.words).fill_null(ESCAPE - 2).to_numpy() + 2

    @property
    def n_low(self) -> int:
        """Slots of the low table: inner nodes of tokens, and of bytes after each byte or none."""
        return self.tokens.n_inner + 257 * 256


@dataclass
class Words:
    """Tokens of some rows: the first row, the tokens, their numbers if looked up, and how many each row has."""

    first: int
    words: pa.Array
    ids: np.ndarray | None
    sizes: np.ndarray


@dataclass
class Symbols:
    """What is coded: codes with their lengths and context hashes; the document, its span and place."""

    code: np.ndarray
    length: np.ndarray
    low: np.ndarray
    middle: np.ndarray
    high: np.ndarray
    own: np.ndarray
    byte: np.ndarray
    doc: np.ndarray


def parts_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of tokens, each closed by a space, and how many each has with it."""
    sizes = pc.binary_length(words).to_numpy().astype(np.int64)
    first = np.frombuffer(words.buffers()[1], np.int32, 1, 4 * words.offset)[0] if len(words) else 0
    n = int(sizes.sum())
    flat = np.full(n + len(words), ord(" "), np.uint8)
    flat[np.arange(n) + np.repeat(np.arange(len(words)), sizes)] = np.frombuffer(words.buffers()[2], np.uint8, n, first) if n else 0
    return flat, sizes + 1


def symbols(lexicon: Lexicon, docs: list[list[bytes]]) -> tuple[Symbols, np.ndarray]:
    """The symbols of documents as lists of tokens, each closed by an end; and the numbers of their tokens and ends."""
    words = pa.array([w for d in docs for w in d], pa.binary())
    return symbols_of(lexicon, Words(0, words, lexicon.numbers(words), np.array([len(d) for d in docs], np.int64)))


def symbols_of(lexicon: Lexicon, some: Words) -> tuple[Symbols, np.ndarray]:
    """symbols() of tokens whose numbers are known."""
    n_docs, sizes = len(some.sizes), some.sizes + 1
    stop = np.cumsum(sizes)
    doc = np.repeat(np.arange(n_docs), sizes)
    ids = np.full(int(sizes.sum()), END, np.int64)
    ids[np.arange(len(some.ids)) + np.repeat(np.arange(n_docs), some.sizes)] = some.ids
    odd = np.flatnonzero(ids == ESCAPE)
    # Bytes of the others, each closed by a space.
    flat, long = parts_of(some.words.filter(pa.array(some.ids == ESCAPE)))
    start = np.cumsum(long) - long
    nth = np.arange(len(flat)) - np.repeat(start, long)
    p = [np.zeros(len(flat), np.uint64) for _ in range(5)]
    for k, x in enumerate(p, 1):
        x[k:] = np.where(nth[k:] >= k, flat[:-k].astype(np.uint64) + np.uint64(1), np.uint64(0))
    third = (p[0] << np.uint64(18)) | (p[1] << np.uint64(9)) | p[2]
    fifth = (third << np.uint64(18)) | (p[3] << np.uint64(9)) | p[4]
    powers = np.cumprod(np.full(int(long.max(initial=1)) + 1, A | np.uint64(1)))
    rising = np.cumsum(np.concatenate([np.zeros(1, np.uint64), (flat.astype(np.uint64) + np.uint64(1)) * powers[nth]]))
    prefix = mix64(rising[:-1] - np.repeat(rising[start], long) + np.uint64(0x55))
    # Tokens: contexts are the two before.
    token = (ids.astype(np.uint64) + np.uint64(1)) * A
    token[odd] ^= prefix[start + long - 1]
    one, two = np.zeros_like(token), np.zeros_like(token)
    one[1:], two[2:] = token[:-1], token[:-2]
    first = stop - sizes
    one[first] = two[first] = 0
    two[(first + 1)[sizes > 1]] = 0
    middle, high = mix64(one + np.uint64(0x51)), mix64(mix64(one + np.uint64(0x52)) + two)
    # Both in order of the text.
    extra = np.zeros(len(ids), np.int64)
    extra[odd] = long
    at = np.arange(len(ids)) + np.cumsum(extra) - extra
    n = len(ids) + len(flat)
    is_byte = np.ones(n, bool)
    is_byte[at] = False
    bytes_at = np.flatnonzero(is_byte)

    def both(x: np.ndarray, y: np.ndarray, kind: type) -> np.ndarray:
        out = np.empty(n, kind)
        out[at], out[bytes_at] = x, y
        return out

    return Symbols(
        both(lexicon.tokens.bits[ids], lexicon.bytes_.bits[flat], np.uint32),
        both(lexicon.tokens.lengths[ids], lexicon.bytes_.lengths[flat], np.int32),
        both(np.int32(0), p[0], np.int32),
        both(middle >> HALF, mix64(third + np.uint64(0x53 << 48)) >> HALF, np.uint32),
        both(high >> HALF, mix64(fifth + np.uint64(0x54 << 48)) >> HALF, np.uint32),
        both(np.uint64(0), prefix, np.uint64),
        is_byte,
        np.repeat(doc, 1 + extra),
    ), ids


@dataclass
class Bits:
    """Bits to predict, all first bits of the symbols, then all second ones: the slots of their contexts, the document's own predictions before them, the gate's share that is known beforehand, their places in the text, and (document, first, last) of these."""

    bit: np.ndarray
    slots: list[np.ndarray]
    own: np.ndarray
    kind: np.ndarray
    at: np.ndarray
    spans: list[tuple[int, int, int]]


def spans(doc: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of at most SPAN symbols of one document."""
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.array([], int)
    stops = np.append(starts[1:], len(doc))
    return [(a, min(a + SPAN, z)) for s, z in zip(starts.tolist(), stops.tolist(), strict=True) for a in range(s, z, SPAN)]


def packs(doc: np.ndarray, most: int = 65_536) -> Iterator[list[tuple[int, int]]]:
    """Spans in groups of about `most` symbols: of less than 2 ** 17, as a key of shown_before() has room for."""
    some: list[tuple[int, int]] = []
    for a, z in spans(doc):
        some.append((a, z))
        if z - some[0][0] >= most:
            yield some
            some = []
    if some:
        yield some


def shown_before(key: np.ndarray, order: np.ndarray, rows: list[np.ndarray]) -> list[np.ndarray]:
    """For each bit the log odds of a one among those that its span has had before it in this context and at this code prefix.

    rows holds the bits of each depth, for symbols in `order`, of falling length. key has their contexts in order of the text; its last
    17 bits are the place.
    """
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    key = np.sort(key)
    at = rank.take((key & np.uint64((1 << 17) - 1)).view(np.int64))
    key >>= np.uint64(17)
    size = np.diff(np.flatnonzero(np.append(True, key[1:] != key[:-1])), append=len(at))
    go = size > 1  # a context's only symbol has nothing before it
    at, size = at.take(np.flatnonzero(np.repeat(go, size))), size[go]
    out, places = [np.zeros(len(row), np.float32) for row in rows], np.arange(len(at))
    for depth, row in enumerate(rows):
        if not len(at):
            break
        # at holds the symbols by context and prefix, and those of a group as in the text: its zeros go on before its ones.
        stop = np.cumsum(size)
        bit = row.take(at, mode="clip").astype(np.int64)
        ones = np.cumsum(bit)
        total = ones.take(stop - 1)
        ones_before = np.append(0, total[:-1])
        n1 = ones - bit
        n1 -= np.repeat(ones_before, size)
        n0 = places[: len(at)] - n1
        pos = n0.copy()
        n0 -= np.repeat(stop - size, size)
        out[depth][at] = LOGS.take(n1, mode="clip") - LOGS.take(n0, mode="clip")
        if depth + 1 == len(rows):
            break
        total -= ones_before
        n1 += np.repeat(stop - total, size)
        n1 -= pos
        n1 *= bit
        pos += n1
        moved = np.empty_like(at)
        moved[pos] = at
        kids = np.stack([size - total, total], axis=1).ravel()
        # Symbols that are alone have nothing before them from here on; ended codes are whole groups.
        go = (kids > 1) & (moved.take(np.cumsum(kids) - kids, mode="clip") < len(rows[depth + 1]))
        at, size = moved.take(np.flatnonzero(np.repeat(go, kids))), kids[go]
    return out


def bits_of(s: Symbols, some: list[tuple[int, int]], lexicon: Lexicon, slot_bits: int, learn: bool = False) -> Bits:
    """The bits of some spans. To learn, the low slots of bytes' bits alone are given, as tokens have theirs from their counts, and nothing else but the hashed slots."""
    a, z = some[0][0], some[-1][1]
    order = np.argsort((32 - s.length[a:z]).astype(np.uint8), kind="stable")
    length = s.length[a:z].take(order)
    alive = (len(length) - np.cumsum(np.bincount(length))[:-1]).tolist()  # symbols with a bit at each depth
    code = s.code[a:z].take(order) << (32 - length).astype(np.uint32)
    is_byte = s.byte[a:z].take(order)
    contexts, shift = [h[a:z].take(order) for h in (s.middle, s.high)], np.uint32(32 - slot_bits)
    byte_low = s.low[a:z].take(order) * np.int32(256) + np.int32(lexicon.tokens.n_inner)
    token_nodes, byte_nodes = lexicon.tokens.by_node().tolist(), lexicon.bytes_.by_node().tolist()
    bytes_at, flag = np.flatnonzero(is_byte), is_byte.view(np.uint8)
    byte_length, low_base = length[bytes_at], byte_low * flag
    rows: list[np.ndarray] = []
    slots: list[list[np.ndarray]] = [[], [], []]
    byte_bits, kinds, places = [], [], []
    if not learn:
        first = np.cumsum(s.length[a:z], dtype=np.int32) - s.length[a:z]
        place = first.take(order)
    for depth, m in enumerate(alive):
        node = (code[:m] >> np.uint32(32 - depth)) | np.uint32(1 << depth) if depth else np.ones(m, np.uint32)
        bit = (code[:m] >> np.uint32(31 - depth)).astype(np.uint8) & np.uint8(1)
        rows.append(bit)
        mixed = node * A32
        for k, h in enumerate(contexts, 1):
            slots[k].append(((h[:m] ^ mixed) * B32) >> shift)
        node = node.view(np.int32)
        if learn:
            there = bytes_at[: int(np.count_nonzero(byte_length > depth))]
            slots[0].append(byte_low.take(there) + node.take(there) + np.int32(byte_nodes[depth]))
            byte_bits.append(bit.take(there))
        else:
            slots[0].append(low_base[:m] + node + (flag[:m] * np.int32(byte_nodes[depth] - token_nodes[depth]) + np.int32(token_nodes[depth])))
            kinds.append(flag[:m] * np.uint8(BYTES - DEPTHS[depth]) + np.uint8(DEPTHS[depth]))
            places.append(place[:m] + np.int32(depth))
    low, *hashed = (np.concatenate(x, dtype=np.int64, casting="unsafe") for x in slots)
    bit = np.concatenate(rows)
    if learn:
        return Bits(bit, [(low, np.concatenate(byte_bits)), *((h, bit) for h in hashed)], None, None, None, [])
    edges = np.append(first, len(bit))
    found = [(int(s.doc[x]), int(edges[x - a]), int(edges[y - a])) for x, y in some]
    span = np.repeat(np.arange(len(some), dtype=np.uint64), [y - x for x, y in some])
    key = ((mix64(s.own[a:z] + span * B) >> np.uint64(18)) << np.uint64(17)) | np.arange(z - a, dtype=np.uint64) | (s.byte[a:z].astype(np.uint64) << np.uint64(63))
    return Bits(bit, [low, *hashed], np.concatenate(shown_before(key, order, rows)), np.concatenate(kinds), np.concatenate(places, dtype=np.int64), found)


def inputs(b: Bits, stretched: list[np.ndarray]) -> np.ndarray:
    """What predicts each bit, as one number that moves as a whole: an INPUT's fields. stretched are twelfths."""
    x = np.empty(len(b.bit), INPUT)
    x["own"], x["low"], x["middle"], x["high"] = b.own, *stretched
    gate = b.kind + (b.bit << np.uint8(6))
    for v, at in zip((*stretched[1:], b.own), (0, 1, 4), strict=True):
        gate += (v != 0).view(np.uint8) << np.uint8(at)
    x["gate"] = gate
    return x.view(np.uint64)


def rows_of(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The predictors' outputs in the logistic domain, to be multiplied by UNITS; the gates; the bits."""
    x = x.view(INPUT)
    return [x[k].astype(np.float32) for k in ("low", "middle", "high", "own")], x["gate"] & np.uint8(63), x["gate"] >> np.uint8(6)


@dataclass
class Model:
    lexicon: Lexicon
    slot_bits: int
    tables: list[np.ndarray]
    weights: np.ndarray


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows, each closed by the row that brings its sizes to `most`."""
    stops, a, done = np.cumsum(sizes), 0, 0
    while a < len(sizes):
        z = min(int(np.searchsorted(stops, done + most)) + 1, len(sizes))
        yield a, z
        a, done = z, int(stops[z - 1])


def words_of(batch: pa.RecordBatch, most: int = AT_ONCE) -> Iterator[Words]:
    """Tokens of slices of about `most` bytes. A-Z lower-cased, parted at ASCII white space alone. A null has no tokens."""
    texts = pc.fill_null(batch["text"], "")
    for a, z in slices(pc.binary_length(texts).to_numpy() + 1, most):
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(a, z - a)))
        words = parts.flatten().cast(pa.binary())
        some = pc.binary_length(words).to_numpy() > 0  # white space at an edge gives empty ones
        before = np.append(0, np.cumsum(some))
        stops = before[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        yield Words(a, words if some.all() else words.filter(pa.array(some)), None, np.diff(stops))


def groups(batch: pa.RecordBatch, lexicon: Lexicon) -> Iterator[Words]:
    """Tokens with their numbers, in slices of about TOKENS_AT_ONCE tokens."""
    for w in words_of(batch):
        ids, edges = lexicon.numbers(w.words), np.append(0, np.cumsum(w.sizes))
        for a, z in slices(w.sizes + 1, TOKENS_AT_ONCE):
            i, j = int(edges[a]), int(edges[z])
            yield Words(w.first + a, w.words.slice(i, j - i), ids[i:j], w.sizes[a:z])


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, count) over all learning documents, whose ends are counted as '' (no token is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch, 4 * AT_ONCE):
                tokens, counts = w.words.value_counts().flatten()
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([names_of(tokens), pa.array([""])]), pa.concat_arrays([counts, pa.array([len(w.sizes)], pa.int64())])], ["token", "count"])

    return docs.select("text").mapInArrow(run, "token string, count long").groupBy("token").agg(F.sum("count").alias("count"))


def bit_counts(docs: DataFrame, lexicon, slot_bits: int, sizes: list[int]) -> list[np.ndarray]:
    """The tables of (zeros, ones) for each slot, counted over all learning documents; counts above 65,535 stay there.

    A task sends what it has counted as rows of CHUNK numbers; those of a chunk are added in one task. The driver gets the sums,
    which are of a fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(2 * n, np.uint32) for n in sizes]
        for batch in batches:
            for words in groups(batch, lexicon.value):
                s, _ = symbols_of(lexicon.value, words)
                for some in packs(s.doc):
                    for t, (slot, bit) in zip(total, bits_of(s, some, lexicon.value, slot_bits, learn=True).slots, strict=True):
                        slot <<= 1
                        slot |= bit
                        np.add.at(t, slot, np.uint32(1))
        for k, t in enumerate(total):
            for at in range(0, len(t), CHUNK):
                part = t[at : at + CHUNK]
                if part.any():
                    narrow = part.astype(np.uint16) if part.max() < 65_536 else part
                    yield pa.RecordBatch.from_pydict({"k": [k], "at": [at], "wide": [narrow is part], "part": [zlib.compress(narrow.tobytes(), 1)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                part = np.frombuffer(zlib.decompress(r["part"]), np.uint32 if r["wide"] else np.uint16).astype(np.uint64)
                total[r["k"], r["at"]] = total[r["k"], r["at"]] + part if (r["k"], r["at"]) in total else part
        for (k, at), t in total.items():
            yield pa.RecordBatch.from_pydict({"k": [k], "at": [at], "part": [np.minimum(t, 65_535).astype(np.uint16).tobytes()]})

    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = docs.select("text").coalesce(max(2 * cores, docs.rdd.getNumPartitions() // 16))
    schema = "k long, at long, {}part binary"
    sums = parts.mapInArrow(run, schema.format("wide boolean, ")).repartition(shuffle_partitions(docs.sparkSession), "k", "at").mapInArrow(add, schema.format(""))
    tables = [np.zeros(2 * n, np.uint16) for n in sizes]
    for r in sums.toArrow().to_pylist():
        part = np.frombuffer(r["part"], np.uint16)
        tables[r["k"]][r["at"] : r["at"] + len(part)] = part
    weights = lexicon.value.counts.astype(float)
    weights[ESCAPE] = lexicon.value.others
    own = lexicon.value.tokens.counts(weights)
    tables[0][: len(own)] = np.where(own > 0, np.maximum(np.rint(own * min(1.0, 65_535 / max(own.max(), 1.0))), 1), 0)  # in proportion
    return tables


def stretched(pairs: np.ndarray) -> np.ndarray:
    """ln of the odds of a one in twelfths, 0 where nothing was seen."""
    n = pairs.reshape(-1, 2).astype(np.float32) + np.float32(0.4)
    return np.clip(np.rint(12 * np.log(n[:, 1] / n[:, 0])), -127, 127).astype(np.int8)


def without_one(pairs: np.ndarray) -> np.ndarray:
    """stretched() of each slot's counts without one of its zeros, then without one of its ones."""
    less = [pairs.reshape(-1, 2).copy() for _ in range(2)]
    for bit, n in enumerate(less):
        n[:, bit] -= n[:, bit] > 0
    return np.stack([stretched(n) for n in less], axis=1).ravel()


def start_weights() -> np.ndarray:
    return np.tile(np.array([0.5, 0.3, 0.3, 0.2, 0.0]), (KINDS, 1))


def step(w: np.ndarray, curve: np.ndarray, x: np.ndarray) -> None:
    """A Newton step of the weights of each gate, in place, with the curvature of all bits so far."""
    gate = x.view(INPUT)["gate"] & np.uint8(63)
    edges = np.append(0, np.cumsum(np.bincount(gate, minlength=KINDS)))
    rows, _, bit = rows_of(x.take(np.argsort(gate, kind="stable"), mode="clip"))
    slope, bend, scaled = np.zeros((KINDS, INPUTS)), np.zeros_like(curve), (w * UNITS).astype(np.float32)
    for kind in np.flatnonzero(np.diff(edges)).tolist():
        m = slice(edges[kind], edges[kind + 1])
        q, v = [row[m] for row in rows], scaled[kind]
        p = q[0] * v[0]
        p += v[-1]
        for row, one in zip(q[1:], v[1:-1], strict=True):
            p += row * one
        np.clip(p, -30, 30, out=p)
        np.negative(p, out=p)
        np.exp(p, out=p)
        p += 1
        np.reciprocal(p, out=p)
        off, steep = bit[m] - p, p * (1 - p)
        slope[kind] = *(row @ off for row in q), off.sum()
        for i, row in enumerate(q):
            bent = row * steep
            bend[kind, i, : i + 1] = [bent @ other for other in q[: i + 1]]
            bend[kind, -1, i] = bent.sum()
        bend[kind, -1, -1] = steep.sum()
    bend *= np.outer(UNITS, UNITS)
    curve += bend + np.tril(bend, -1).transpose(0, 2, 1)
    w += np.linalg.solve(curve, (slope * UNITS)[:, :, None])[:, :, 0]


def less_one(tables: list[np.ndarray], b: Bits) -> list[np.ndarray]:
    """What tables of without_one() have for bits; both numbers of a slot are read at once, as they lie together."""
    half = b.bit.astype(np.uint16) << np.uint16(3)
    return [(t.view("<u2").take(slot, mode="clip") >> half).astype(np.int8) for t, slot in zip(tables, b.slots, strict=True)]


def mixing_weights(docs: DataFrame, lexicon, tables, slot_bits: int) -> np.ndarray:
    """Weights by gate from online Newton steps over all docs, each task by itself; their mean by the tasks' curvatures.

    docs are those that were counted; tables hold without_one() of the counts, as a bit must not predict itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, curve = start_weights(), np.tile(np.eye(INPUTS) * 20.0, (KINDS, 1, 1))
        for batch in batches:
            for words in groups(batch, lexicon.value):
                s, _ = symbols_of(lexicon.value, words)
                for some in packs(s.doc):
                    b = bits_of(s, some, lexicon.value, slot_bits)
                    step(w, curve, inputs(b, less_one(tables.value, b)))
        out = np.concatenate([curve.ravel(), np.einsum("gij,gj->gi", curve, w).ravel()])
        yield pa.RecordBatch.from_pydict({"dim": pa.array([0], pa.int32()), "part": pa.array([out.tobytes()], pa.binary())})

    got = added(docs.select("text").mapInArrow(run, "dim int, part binary")).first()
    if got is None:
        return start_weights()
    flat = np.frombuffer(got["total"])
    curve, turned = flat[: KINDS * INPUTS**2].reshape(KINDS, INPUTS, INPUTS), flat[KINDS * INPUTS**2 :].reshape(KINDS, INPUTS, 1)
    return np.linalg.solve(curve, turned)[:, :, 0]


def bits_needed(model: Model, s: Symbols, n_docs: int, rate: float = 0.2) -> np.ndarray:
    """Bits that each document takes: minus log2 of what the mix gives to its bits, with weights that follow the document."""
    out, w = np.zeros(n_docs), np.ascontiguousarray((model.weights * UNITS).T.astype(np.float32))
    units = UNITS.astype(np.float32)
    for some in packs(s.doc):
        b = bits_of(s, some, model.lexicon, model.slot_bits)
        x = np.empty(len(b.bit), np.uint64)
        x[b.at] = inputs(b, [t.take(slot, mode="clip") for t, slot in zip(model.tables, b.slots, strict=True)])
        rows, gate, bit = rows_of(x)
        gate = gate.astype(np.int64)
        mixed = w[-1].take(gate, mode="clip")
        for row, one in zip(rows, w[:-1], strict=True):
            mixed += one.take(gate, mode="clip") * row
        against = 1 - 2 * bit.astype(np.float32)
        for doc, first, last in b.spans:
            shift = np.zeros(INPUTS, np.float32)
            for a in range(first, last, STEP):
                z = min(a + STEP, last)
                q, y, odds = [row[a:z] for row in rows], against[a:z], mixed[a:z]
                if a > first:
                    odds += shift[-1]
                    for row, one in zip(q, shift[:-1] * units[:-1], strict=True):
                        odds += row * one
                np.clip(odds, -12, 12, out=odds)
                odds *= y
                np.exp(odds, out=odds)  # against the bit
                more = 1 + odds
                out[doc] += np.log(more).sum(dtype=float) / LN2
                if z < last:
                    odds /= more
                    odds *= y
                    shift -= np.float32(rate / (z - a)) * units * np.array([*(row @ odds for row in q), odds.sum()], np.float32)
    return out


def train(docs: DataFrame, learn: Column, lexicon_size: int = LEXICON) -> tuple[DataFrame, object, int, int]:
    """(token counts, broadcast model, number of learning tokens, number of distinct ones)."""
    context = docs.sparkSession.sparkContext
    learning = docs.where(learn)
    counts = cut(token_counts(learning))
    n, distinct, ends = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("token") == "", F.col("count"))), F.lit(0))).first()
    frequent = counts.where((F.col("token") != "") & (F.octet_length("token") <= LONGEST) & (F.col("count") > 1)).orderBy(F.desc("count"), "token").limit(lexicon_size).toArrow()
    words = [*zip(frequent["token"].cast(pa.binary()).to_pylist(), frequent["count"].to_pylist(), strict=True)]
    lexicon = context.broadcast(Lexicon.of(words, n - ends - sum(c for _, c in words), ends))
    slot_bits = min(SLOT_BITS, max(12, math.ceil(math.log2(n + 1)) + 1))
    sizes = [lexicon.value.n_low, 1 << slot_bits, 1 << slot_bits]
    tables = bit_counts(learning, lexicon, slot_bits, sizes)
    sent = context.broadcast([without_one(t) for t in tables])
    weights = mixing_weights(learning, lexicon, sent, slot_bits)
    sent.unpersist()
    return counts, context.broadcast(Model(lexicon.value, slot_bits, [stretched(t) for t in tables], weights)), n, distinct


def score(docs: DataFrame, folds: int = 10, lexicon_size: int = LEXICON) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of docs.

    Documents whose crc32(doc_id as text) mod folds is 0 are held out; counts, lexicon and weights are learned from all
    others. Rows without id are scored, neither held out nor learned from. Null and empty
    texts are one end token; their bits_per_byte is null. Repeated rows count like any; other columns of docs are not
    read; no rows give none. With nothing to learn from every base_score is 0. score is log10 of the probability of
    the lower-cased tokens, unknown ones spelled. Hashed tables have up to 4,194,304 slots, which contexts share
    beyond that; counts are taken from all documents at any size.
    """
    crc = F.crc32(F.col("doc_id").cast("string"))
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counts, model, n, distinct = train(rows, F.coalesce(crc % folds != 0, F.lit(False)), lexicon_size)
    total = n + 0.1 * (distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        base = np.log10((m.lexicon.counts + 0.1) / total)
        base[ESCAPE] = 0.0
        for batch in batches:
            text_sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy()
            for words in groups(batch, m.lexicon):
                i, n_rows = words.first, len(words.sizes)
                s, ids = symbols_of(m.lexicon, words)
                bits = bits_needed(m, s, n_rows)
                row = np.repeat(np.arange(n_rows), words.sizes + 1)
                sizes = text_sizes[i : i + n_rows]
                # The others of each row, once each.
                odd = words.ids == ESCAPE
                others = names_of(words.words.filter(pa.array(odd))).dictionary_encode()
                many = max(len(others.dictionary), 1)
                each, times = np.unique(np.repeat(np.arange(n_rows), words.sizes)[odd] * many + others.indices.to_numpy(), return_counts=True)
                edges = pa.array(np.searchsorted(each, np.arange(n_rows + 1) * many), pa.int32())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch["doc_id"].slice(i, n_rows),
                        "n_tokens": pa.array(words.sizes + 1, pa.int64()),
                        "known": pa.array(np.bincount(row, m.lexicon.counts[ids] > 0, n_rows).astype(np.int64)),
                        "base": pa.array(np.bincount(row, base[ids], n_rows)),
                        "score": pa.array(-bits * math.log10(2)),
                        "bits_per_byte": pa.array(bits / np.maximum(sizes, 1), mask=sizes == 0),
                        "others": pa.ListArray.from_arrays(edges, others.dictionary.take(pa.array(each % many))),
                        "times": pa.ListArray.from_arrays(edges, pa.array(times, pa.int32())),
                    }
                )

    place = f"{shared_folder(docs.sparkSession)}/scored-{uuid.uuid4().hex}"
    scored = rows.mapInArrow(run, "doc_id long, n_tokens long, known long, base double, score double, bits_per_byte double, others array<string>, times array<int>")
    scored.withColumn("row", F.monotonically_increasing_id()).write.parquet(place)
    scored = docs.sparkSession.read.parquet(place)
    # Tokens outside the lexicon are rare, but for long ones: what they count is joined by a shuffle.
    odd = scored.select("row", F.explode(F.arrays_zip("others", "times")).alias("x")).select("row", F.col("x.others").alias("token"), F.col("x.times").alias("times"))
    c = F.coalesce(F.col("count"), F.lit(0))
    seen = odd.join(counts, "token", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10((c + 0.1) / F.lit(total))).alias("rest"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    return scored.join(seen, "row", "left").select(
        "doc_id", held.alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score", "bits_per_byte"
    )
