"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

No piece of the vocabulary goes on after a space or holds a newline, so the lattice of a text falls apart into those
of its units: spaces with the word after them, and newlines. For every distinct unit of a batch, forward filtering
sums the weights of all segmentations up to each character; backward sampling then walks each occurrence from its
end, drawing the last piece in proportion to what lies before it. Draws are hashes of (row key, place of the unit,
step), so they don't depend on batches or partitions. A character that is no piece becomes its UTF-8 bytes.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.llm.common import lean, mix64, spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNIT = re.compile(r"\n| *[^ \n]+| +")
#: Bytes of text encoded at a time within a batch; a longer text is encoded alone.
AT_ONCE = 500_000
#: Characters of the units whose lattices a task keeps for later batches; beyond that it starts afresh.
KEPT = 500_000
#: Units longer than this are filtered one by one.
LONG = 512
BASE, BYTE = np.uint64(0x100000001B3), -1


@dataclass
class Vocabulary:
    """Pieces by id (as the bytes they decode to), their log weights, and for each length the hashes of all their prefixes."""

    decoded: list[bytes]
    weights: np.ndarray
    byte_ids: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    @classmethod
    def load(cls, path: str, theta: float = 1.0) -> Vocabulary:
        """A model file's pieces. A piece of rank r in the file weighs (r + 1) ** -theta: the larger theta, the fewer and longer pieces."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        text = {i: model.id_to_piece(i).replace("▁", " ") for i in normal}
        normal = [i for i in normal if " " not in text[i].lstrip(" ") and "\n" not in text[i]]
        decoded = [b""] * n
        for i in normal:
            decoded[i] = text[i].encode()
        for b, i in enumerate(byte_ids.tolist()):
            decoded[i] = bytes([b])
        weights = np.full(n, -np.inf)
        weights[normal] = -theta * np.log(np.arange(1, len(normal) + 1) + 1.0)
        weights[byte_ids] = -theta * np.log(len(normal) + 1.0)
        out = cls(decoded, weights, byte_ids)
        prefixes: list[dict[str, int]] = []
        for i in normal:
            for size in range(1, len(text[i]) + 1):
                while len(prefixes) < size:
                    prefixes.append({})
                prefixes[size - 1].setdefault(text[i][:size], -1)
            prefixes[len(text[i]) - 1][text[i]] = i
        for table in prefixes:
            h = np.zeros(len(table), np.uint64)
            code = np.frombuffer("".join(table).encode("utf-32-le"), np.uint32).reshape(len(table), -1).astype(np.uint64)
            for j in range(code.shape[1]):
                h = h * BASE + code[:, j] + np.uint64(1)
            order = np.argsort(h)
            out.tables.append((h[order], np.fromiter(table.values(), np.int64, len(table))[order]))
        return out


@dataclass
class Lattices:
    """Edges of many units' lattices by the character they end on: keys are that character's place and the cumulated share of the edge."""

    first: np.ndarray
    last: np.ndarray
    keys: np.ndarray
    sizes: np.ndarray
    pieces: np.ndarray
    code: np.ndarray


def byte_width(code: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of characters."""
    return np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4)))


def lattices(units: list[str], v: Vocabulary) -> Lattices:
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    stop = np.repeat((first + sizes).astype(np.int32), sizes)
    at, h = np.arange(len(code), dtype=np.int32), code + np.uint64(1)
    found = []  # (starts, length, pieces): narrow types, as there are a few edges for every character
    for length, (hashes, ids_of) in enumerate(v.tables, 1):
        place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        known = hashes[place] == h
        piece = np.where(known, ids_of[place], -1)
        if length == 1:
            lone = piece < 0
            found.append((at[lone], 1, np.full(lone.sum(), BYTE, np.int32)))
        whole = piece >= 0
        found.append((at[whole], length, piece[whole].astype(np.int32)))
        more = known & (at + length < stop[at])
        at, h = at[more], h[more]
        h = h * BASE + code[at + length] + np.uint64(1)
        if not len(at):
            break
    # Edges by (end, length) without a sort: within each length ends differ, and lengths come in order.
    count = np.zeros(len(code), np.int32)
    for start, length, _ in found:
        count[start + (length - 1)] += 1
    offset = np.cumsum(count) - count
    total = int(count.sum())
    span, piece, value = np.empty(total, np.int8), np.empty(total, np.int32), np.empty(total)
    filled = offset.copy()
    for start, length, some in found:
        end = start + (length - 1)
        to = filled[end]
        span[to], piece[to] = length, some
        value[to] = np.where(some >= 0, v.weights[some], v.weights[v.byte_ids[0]] * byte_width(code[start]))
        filled[end] += 1
    del found, filled
    alpha = np.zeros(len(code))
    for unit in np.flatnonzero(sizes > LONG).tolist():
        filter_one(int(first[unit]), int(sizes[unit]), offset, count, span, value)
    short = np.flatnonzero(sizes <= LONG)
    bylength = short[np.argsort(-sizes[short], kind="stable")]
    descending = -sizes[bylength]
    for depth in range(int(sizes[short].max(initial=0))):  # all units together, one character further each time
        node = first[bylength[: np.searchsorted(descending, -depth)]] + depth
        edges = count[node]
        most = int(edges.max(initial=0))
        top = np.full(len(node), -np.inf)
        for r in range(most):
            has = edges > r
            e = offset[node[has]] + r
            length = span[e]
            value[e] += np.where(length <= depth, alpha[np.maximum(node[has] - length, 0)], 0.0)
            top[has] = np.maximum(top[has], value[e])
        sums = np.zeros(len(node))
        for r in range(most):
            has = edges > r
            e = offset[node[has]] + r
            sums[has] += np.exp(value[e] - top[has])
            value[e] = sums[has]  # cumulated, and divided by the sum below
        alpha[node] = top + np.log(sums)
        for r in range(most):
            has = edges > r
            value[offset[node[has]] + r] /= sums[has]
    keys = np.minimum(value * 2.0**31, 2.0**31 - 1).astype(np.uint64)
    keys[offset + count - 1] = np.uint64(2**31)
    keys |= np.repeat(np.arange(len(code), dtype=np.uint64), count) << np.uint64(32)
    return Lattices(first, first + sizes - 1, keys, span, piece, code.astype(np.uint32))


def filter_one(lo: int, size: int, offset: np.ndarray, count: np.ndarray, span: np.ndarray, value: np.ndarray) -> None:
    """Forward filtering of one unit, character by character; its edges' values become cumulated shares."""
    a, b = int(offset[lo]), int(offset[lo + size - 1] + count[lo + size - 1])
    lengths, weights, shares, alpha, e = span[a:b].tolist(), value[a:b].tolist(), [], [], 0
    for depth, n in enumerate(count[lo : lo + size].tolist()):
        total = [weights[i] + (alpha[depth - lengths[i]] if lengths[i] <= depth else 0.0) for i in range(e, e + n)]
        top, run = max(total), 0.0
        some = []
        for x in total:
            run += math.exp(x - top)
            some.append(run)
        shares += [x / run for x in some]
        alpha.append(top + math.log(run))
        e += n
    value[a:b] = shares


class Numbered(dict):
    """Units by the order in which they were first met."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


class Known:
    """The lattices of units met so far: a task's batches share most of their words."""

    def __init__(self):
        self.number, self.grid = Numbered(), None

    def extend(self, v: Vocabulary) -> Lattices:
        """Adds the lattices of units that were numbered since."""
        old = self.grid
        have = 0 if old is None else len(old.first)
        if len(self.number) > have:
            new = lattices(list(islice(self.number, have, None)), v)
            if old is not None:
                base = len(old.code)  # keys begin with the place of a character
                parts = [(old.first, new.first + base), (old.last, new.last + base), (old.keys, new.keys + (np.uint64(base) << np.uint64(32))), (old.sizes, new.sizes), (old.pieces, new.pieces), (old.code, new.code)]
                new = Lattices(*map(np.concatenate, parts))
            self.grid = new
        return self.grid

    def trimmed(self) -> Known:
        return Known() if self.grid is not None and len(self.grid.code) > KEPT else self


def units_of(text: str) -> list[str]:
    if "\x1f" in text or "  " in text or text[0] == " ":
        return UNIT.findall(" " + text)
    # The same units by splitting, where every space has a word or newline before and after it.
    parts = (" " + text).replace(" \n", "\x1f \x1f\n").replace("\n", "\x1f\n\x1f").replace(" ", "\x1f ").split("\x1f")
    return [p for p in parts if p]


def encode(texts: list[str | None], seeds: np.ndarray, v: Vocabulary, known: Known | None = None) -> list[np.ndarray]:
    """Piece ids of each text, sampled; seeds are one uint64 a text. Null texts are empty; an empty text has no pieces.

    known keeps lattices from call to call; it changes no result.
    """
    known, found, counts = Known() if known is None else known, [], []
    for text in texts:
        parts = units_of(text) if text else []
        found += map(known.number.__getitem__, parts)
        counts.append(len(parts))
    if not found:
        return [np.zeros(0, np.int32) for _ in texts]
    grid = known.extend(v)
    unit, counts = np.array(found, np.int64), np.array(counts, np.int64)
    row = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts)
    seed = mix64(seeds[row] + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    node, first, live = grid.last[unit], grid.first[unit], np.arange(len(unit))
    steps, used = [], np.zeros(len(unit), np.int64)
    turn = 0
    while len(live):
        draw = mix64(seed[live] + np.uint64(turn)) >> np.uint64(33)
        edge = np.searchsorted(grid.keys, (node.astype(np.uint64) << np.uint64(32)) | draw, side="right")
        steps.append((live, grid.pieces[edge], grid.code[node]))
        used[live] += 1
        node = node - grid.sizes[edge]
        go = node >= first
        live, node, first = live[go], node[go], first[go]
        turn += 1
    ends = np.cumsum(used)
    flat, char = np.empty(int(ends[-1]), np.int32), np.empty(int(ends[-1]), np.uint32)
    for turn, (at, piece, code) in enumerate(steps):
        flat[ends[at] - 1 - turn], char[ends[at] - 1 - turn] = piece, code
    per_row = np.bincount(row, weights=used, minlength=len(texts)).astype(np.int64)
    if (flat == BYTE).any():
        flat, per_row = with_bytes(flat, char, np.repeat(np.arange(len(texts)), per_row), v, len(texts))
    return np.split(flat.astype(np.int32), np.cumsum(per_row)[:-1])


def with_bytes(flat: np.ndarray, char: np.ndarray, row: np.ndarray, v: Vocabulary, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with each unknown character replaced by the ids of its bytes, and the number of ids in each row."""
    lone = np.flatnonzero(flat == BYTE)
    width = np.ones(len(flat), np.int64)
    code = char[lone]
    width[lone] = byte_width(code)
    out = np.repeat(flat, width)
    chars, inverse = np.unique(code, return_inverse=True)
    raw = [v.byte_ids[np.frombuffer(chr(int(c)).encode(), np.uint8)] for c in chars]
    begin = (np.cumsum(width) - width)[lone]
    for k in range(4):
        has = width[lone] > k
        if has.any():
            table = np.array([r[k] if len(r) > k else 0 for r in raw], np.int64)
            out[begin[has] + k] = table[inverse[has]]
    return out, np.bincount(row, weights=width, minlength=rows).astype(np.int64)


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text again: the pieces' bytes in a row, without the space that encoding put first."""
    return b"".join(map(v.decoded.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def sampled_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, seed: int = 7, theta: float = 1.0) -> DataFrame:
    """(doc_id, pieces, n_pieces, lossless) for every row of docs: the ids of a sampled segmentation of its whole text.

    The sample depends on the id (as text, null like the empty text), the seed and the text. lossless says that
    decoding gave the text back (an empty one for null). Repeated rows stay rows and get the same pieces, and rows
    without id those of the empty id. Texts of any length are read whole; one word of a million characters is a
    lattice of a million characters, walked one by one. An empty table gives no rows. Other columns aren't read. The model file is read once, on the driver; its pieces (about a megabyte) go to all tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model, theta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = shared.value, Known()
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // AT_ONCE
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(sizes)) + 1):
                some = batch.column(2).slice(part[0], len(part)).to_pylist()
                ids = batch.column(1).slice(part[0], len(part)).to_pylist()
                keys = mix64(np.array([zlib.crc32((i or "").encode()) << 32 | (seed & 0xFFFFFFFF) for i in ids], np.uint64))
                known = known.trimmed()
                found = encode(some, keys, v, known)
                fine = [decode(p, v) == (t or "") for p, t in zip(found, some, strict=True)]
                n = np.array([len(p) for p in found], np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part[0], len(part)), lists, pa.array(n), pa.array(fine)], ["doc_id", "pieces", "n_pieces", "lossless"])

    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("__key"), F.col(text_col).alias("__text")))
    return rows.mapInArrow(lean(run), f"doc_id {dict(rows.dtypes)['doc_id']}, pieces array<int>, n_pieces int, lossless boolean")


def decoded_texts(encoded: DataFrame, pieces_col: str = "pieces", model: str = MODEL) -> DataFrame:
    """encoded with a column text, in place of one of that name: what its pieces stand for (null for null pieces)."""
    encoded = encoded.drop("text")
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(pieces_col))
            texts = [None if not x.is_valid else decode(np.array(x.as_py(), np.int64), shared.value) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("text", StringType())]))
