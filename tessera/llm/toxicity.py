"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training is online, with a learning rate for each coordinate and L1 that leaves most weights at exactly zero; what
is left is a compact table that every task gets by broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, lean, mix64, spread

#: Places in the weight table: 2^BITS single-precision numbers, 4 MB, whatever the corpus; only those that L1 leaves are sent.
BITS = 20
#: Labelled ids to fit on at most, one text each: those of the smallest hash of their id. And features of these texts together (160 MB).
TRAIN_ROWS, TRAIN_FEATURES = 8_000, 40_000_000
#: Words a task remembers hashes of before it starts afresh.
MEMORY = 200_000


class WordHash(dict):
    """Hashes of words in lower case without punctuation at their ends; a task meets most words many times."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        h = self[word] = zlib.crc32(word.lower().strip(b"\"'.,;:!?()[]{}<>*%#$&|-_/")) | 1 << 33
        return h


def features(words: np.ndarray) -> np.ndarray:
    """Places of a text's distinct features from its words' hashes: words, pairs, and pairs with one word between."""
    w = words.astype(np.uint64)
    grams = [w, w[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ w[1:] + np.uint64(1 << 40), w[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) ^ w[2:] + np.uint64(1 << 41)]
    return np.unique((mix64(np.concatenate(grams)) >> np.uint64(64 - BITS)).astype(np.int64))


def text_features(text: str | None, seen: WordHash) -> np.ndarray:
    parts = (text or "").encode().split()
    return features(np.fromiter(map(seen.__getitem__, parts), np.int64, len(parts)))


def ftrl(rows: list[tuple[np.ndarray, int]], alpha: float = 2.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1, passes: int = 3, lift: float = 8.0) -> tuple[np.ndarray, float]:
    """Weights and bias. Rows of label 1, the rarer ones, count `lift` times; with under 8,000 rows l1 shrinks by the root of their share."""
    l1 *= min(1.0, len(rows) / 8000.0) ** 0.5
    z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)
    strong = np.append(np.full(2**BITS, l1), 0.0)  # no L1 on the bias

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= strong[at], 0.0, -(z[at] - np.sign(z[at]) * strong[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(passes):
        for feats, label in rows:
            at = np.append(feats, 2**BITS)
            x = value(len(feats))
            w = weights(at)
            margin = w[:-1].sum() * x + w[-1]
            g = np.full(len(at), (1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35))) - label))
            g *= lift if label else 1.0
            g[:-1] *= x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(2**BITS + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def value(count: int) -> float:
    """What each of a text's features counts, at training and scoring alike: less in long texts, but less so than an average."""
    return 1.0 / max(1.0, float(count)) ** 0.15


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray, float]:
        """What is broadcast: places and values of the weights that aren't zero."""
        at = np.flatnonzero(self.weights).astype(np.int32)
        return at, self.weights[at], self.bias

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray, float]) -> None:
        at, values, self.bias = state
        self.weights = np.zeros(2**BITS, np.float32)
        self.weights[at] = values

    def score(self, text: str | None, seen: WordHash) -> float:
        at = text_features(text, seen)
        margin = float(self.weights[at].sum(dtype=np.float64)) * value(len(at)) + self.bias
        return float(1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, margin)))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS, most_features: int = TRAIN_FEATURES) -> Model:
    """Fits on at most `most` labelled ids whose crc32(id as text) mod 3 isn't 1, those of the smallest hash of their id.

    An id counts with one text, however many rows it has: that of the smallest hash; of its labels the largest counts.
    The chosen texts are a sample bounded twice: if they have more than `most_features` features together, those of the largest
    hashes of ids are left out.
    The labels chosen (at most `most` pairs of numbers) are broadcast to a scan of docs, which keeps their rows only;
    what reaches the driver is hashed features of these, in an order that depends on ids alone. Labels that are null
    or not 0 or 1, and rows without id, don't count. Without labels the model is empty and every score is 0.5.
    """
    key = F.col(id_col).cast("long")
    chosen = labels.select(key.alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    chosen = chosen.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(key.alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text"))).alias("one")).select("doc_id", "label", "one.text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHash()
        for batch in batches:
            found = [text_features(t, seen).astype(np.int32) for t in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "label", "at"])

    found = cut(rows.select("doc_id", "text", "label").mapInArrow(hashed, "doc_id long, label int, at array<int>"))
    sizes = found.select("doc_id", F.size("at").alias("n")).toArrow()  # `most` rows at most
    order = np.lexsort((sizes["doc_id"].to_numpy(), mix64(sizes["doc_id"].to_numpy().astype(np.uint64))))
    fit = sizes["doc_id"].to_numpy()[order][np.cumsum(sizes["n"].to_numpy()[order].astype(np.int64)) <= most_features]
    if len(fit) < len(order):
        found = found.where(F.col("doc_id").isin(fit.tolist()))
    table = found.toArrow()
    ids, label, at = table["doc_id"].to_numpy(), table["label"].to_numpy(), table["at"]
    order = np.lexsort((ids, mix64(ids.astype(np.uint64)))) if len(ids) else []
    lists = at.combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()  # views: rows are slices of one array
    return Model(*ftrl([(flat[ends[i] : ends[i + 1]], int(label[i])) for i in order]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, out: str = "toxicity") -> DataFrame:
    """Column `out` (0 to 1) beside the id as doc_id (or beside the columns in keep) for every row of docs.

    The score depends on the whole text alone, of any length. Null and empty texts get the model's bias alone. Repeated
    rows stay rows, null ids too. A column of docs that is named like `out` is replaced. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [F.col(id_col).alias("doc_id")] if keep is None else [F.col(c) for c in keep]
    rows = spread(docs.select(*columns, F.col(text_col).alias("__text")))
    schema = rows.drop("__text").schema.add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHash()
        for batch in batches:
            found = pa.array([shared.value.score(t, seen) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*batch.schema.names[:-1], out])

    return rows.mapInArrow(lean(run), schema)
