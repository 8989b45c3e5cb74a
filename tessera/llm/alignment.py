"""Alignment of two tokenizers by byte offsets, as an associative composition of fragments.

A fragment says what a byte range knows of the tokens that end in it: an open prefix up to the first offset where
tokens of both end, closed groups between such offsets, and an open suffix behind the last. Fragments of neighbouring
ranges compose, and composition is associative, so a long document is cut into byte ranges, whose fragments are made
in many tasks and composed in a tree; a range may begin within a token. Neither tokenizer joins what stands before a
space or newline to it if that is no white space, so units between such places are encoded once and kept.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate, chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ROWS_AT_MOST, cut, shared_folder, spread

FOLDER, BYTE_LEVEL, PIECES = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of a range of a long document; ranges that are composed at a time.
RANGE, FAN = 65_536, 16
#: Texts whose units are put together at a time.
AT_ONCE = 350
#: Units a worker keeps, and characters of the longest of them.
KEPT, LONG = 170_000, 60
#: How the first tokenizer's pre-tokenizer parts a text (fixed).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units, where there is other white space than spaces and newlines, and where there is none.
OTHER, PLAIN = re.compile(r"[^\S \n]"), re.compile(r"\s*\S+|\s+")
UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+")
SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)
#: An id pair as one number.
SHIFT = 65_536


@dataclass(slots=True)
class Fragment:
    """Tokens of both kinds that end in a range. Before the first common end all is in `prefix`; links are pairs that end together."""

    prefix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    closed: list[str] = field(default_factory=list)
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    split: bool = False
    links: list[int] = field(default_factory=list)
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    whole: bool = True


def group(a: list[int], b: list[int]) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    left, right = x.suffix if x.split else x.prefix, y.prefix
    joined = left[0] + right[0], left[1] + right[1]
    closing = [group(*joined)] if x.split and y.split else []
    return Fragment(
        x.prefix if x.split else joined,
        x.closed + closing + y.closed,
        y.suffix if y.split else joined if x.split else ([], []),
        x.split or y.split,
        x.links + y.links,
        x.n_a + y.n_a,
        x.n_b + y.n_b,
        x.n_groups + y.n_groups,
        x.whole and y.whole,
    )


def fragment(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int], whole: bool = True) -> Fragment:
    """The fragment of the given tokens by their end offsets, which rise."""
    ends, i, j = sorted(set(a_ends) & set(b_ends)), 0, 0
    pieces, links = [], []
    at, bt = {e: k + 1 for k, e in enumerate(a_ends)}, {e: k + 1 for k, e in enumerate(b_ends)}
    for e in ends:
        pieces.append((a[i : at[e]], b[j : bt[e]]))
        i, j = at[e], bt[e]
        links.append(a[i - 1] * SHIFT + b[j - 1])
    rest = a[i:], b[j:]
    return Fragment(pieces[0] if ends else rest, [group(*p) for p in pieces[1:]], rest if ends else ([], []), bool(ends), links, len(a), len(b), len(ends), whole)


#: A unit's groups as text, its links and its numbers of tokens.
Closed = tuple[str, tuple[int, ...], int, int]
MARKS, NAMES = ("", ",", "|", ";"), [str(i) for i in range(SHIFT)]


class Encoder:
    """Both tokenizers with the units met so far: for each its groups as text, its links and numbers of tokens; None if it isn't given back."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken

        model = json.loads(Path(f"{folder}/{BYTE_LEVEL}").read_text())["model"]
        # Byte-level BPE shows printable bytes as themselves and the others, in order, from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in set(shown)]
        byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if all(c in byte for c in t)}
        if any(ranks[bytes(map(byte.__getitem__, "".join(m)))] != 256 + i for i, m in enumerate(model["merges"])):
            raise ValueError("merges must be in the order of the ids")
        self.a = tiktoken.Encoding(BYTE_LEVEL, pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.a_bytes[i] = raw
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = pieces.index("▁")
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("a vocabulary with pieces that go on after a space or hold a newline can't be encoded by units")
        self.a_sizes, self.b_sizes = np.array([*map(len, self.a_bytes)]), np.array([*map(len, self.b_bytes)])
        self.kept: dict[str, Closed | None] = {}

    def units(self, text: str) -> list[str]:
        """Units of a text that begins with a space; they tile it."""
        return (UNIT if OTHER.search(text) else PLAIN).findall(text)

    def encode(self, units: list[str]) -> Iterator[tuple[list[int], list[int], list[int], list[int], bool]]:
        """Ids and ends of both, and whether both give the unit back.

        The second tokenizer adds a space before all it gets, so a unit goes without its own; before a newline that space is a token, which is dropped.
        """
        for u, y in zip(units, self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1), strict=True):
            a, b = self.a(u), y or [self.space] if u[0] == " " else y[1:]
            raw, x, y = u.encode(), [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
            yield a, [*accumulate(map(len, x))], b, [*accumulate(map(len, y))], b"".join(x) == raw == b"".join(y)

    def close(self, units: list[str]) -> list[Closed | None]:
        """Units by themselves; those that need no care at once."""
        plain = [u for u in units if "▁" not in u and not u[-1].isspace()]
        found = {}
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            made = self.close_all(some)
            if made is not None:
                found |= zip(some, made, strict=True)
        rest = [u for u in units if u not in found]
        found |= zip(rest, (closed(a, x, b, y) if whole else None for a, x, b, y, whole in self.encode(rest)), strict=True)
        return [found[u] for u in units]

    def close_all(self, units: list[str]) -> list[Closed] | None:
        """Units that end in no space, encoded as one text by the first tokenizer; nothing if the second does not give them back."""
        text = "".join(units)
        raw, a, pieces = text.encode(), np.array(self.a(text), np.int64), self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        b = np.fromiter(chain.from_iterable(y if u[0] == " " else y[1:] for u, y in zip(units, pieces, strict=True)), np.int64)
        if b"".join(map(self.b_bytes.__getitem__, b.tolist())) != raw or b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw:
            return None
        ends, a_ends, b_ends = np.cumsum([len(u.encode()) for u in units]), np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        links = a[np.searchsorted(a_ends, common)] * SHIFT + b[np.searchsorted(b_ends, common)]
        unit = np.searchsorted(ends, common)  # of each group
        part = np.concatenate([2 * np.searchsorted(common, a_ends), 2 * np.searchsorted(common, b_ends) + 1])
        order = np.argsort(part, kind="stable")
        part, ids = part[order], np.concatenate([a, b])[order]
        first = np.append(True, part[1:] != part[:-1])
        opens = np.append(True, unit[1:] != unit[:-1])[part >> 1]
        mark = np.where(~first, 1, np.where(part % 2 == 1, 2, np.where(opens, 0, 3)))
        shown = [MARKS[m] + NAMES[i] for m, i in zip(mark.tolist(), ids.tolist(), strict=True)]
        stops = np.cumsum(np.bincount(unit[part >> 1], np.fromiter(map(len, shown), np.int64, len(shown)), len(units))).astype(np.int64).tolist()
        cuts, all_, flat = np.cumsum(np.bincount(unit, minlength=len(units))).tolist(), "".join(shown), links.tolist()
        n_a, n_b = (np.bincount(np.searchsorted(ends, e), minlength=len(units)).tolist() for e in (a_ends, b_ends))
        return [(all_[i:j], tuple(flat[k:m]), x, y) for i, j, k, m, x, y in zip([0, *stops], stops, [0, *cuts], cuts, n_a, n_b)]

    def learn(self, units: list[str]) -> list[Closed | None]:
        """What the units give; it is kept for those that aren't long."""
        new = [u for u in units if u not in self.kept]
        made = dict(zip(new, self.close(new), strict=True))
        found = [made[u] if u in made else self.kept[u] for u in units]
        if len(self.kept) + len(new) > KEPT:
            self.kept = {}
        self.kept |= {u: x for u, x in made.items() if len(u) <= LONG}
        return found

    def range(self, text: str, start: int, low: int, high: int) -> Fragment:
        """The fragment of the tokens that end in (low, high] of the units of text, which begins at byte start."""
        units = self.units(text)
        parts, at = [Fragment()], start
        for u, (a, x, b, y, whole) in zip(units, self.encode(units), strict=True):
            x, y = [e + at for e in x], [e + at for e in y]
            i, j = (bisect_right(x, low), bisect_right(x, high)), (bisect_right(y, low), bisect_right(y, high))
            parts.append(fragment(a[slice(*i)], x[slice(*i)], b[slice(*j)], y[slice(*j)], whole))
            at += len(u.encode())
        while len(parts) > 1:
            parts = [compose(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0]


def closed(a: list[int], x: list[int], b: list[int], y: list[int]) -> Closed:
    """Groups as text, links and numbers of tokens of a unit by ids and ends; both end where it ends."""
    ends, groups, links, i, j = set(y), [], [], 0, 0
    for m, e in enumerate(x, 1):
        if e in ends:
            n = bisect_right(y, e, j)
            groups.append(group(a[i:m], b[j:n]))
            links.append(a[m - 1] * SHIFT + b[n - 1])
            i, j = m, n
    return ";".join(groups), tuple(links), len(a), len(b)


ENCODERS: dict[str, Encoder] = {}


def encoder(folder: str) -> Encoder:
    """One for each worker: later tasks find its units."""
    if folder not in ENCODERS:
        ENCODERS[folder] = Encoder(folder)
    return ENCODERS[folder]


def ranges(text: str, size: int) -> Iterator[tuple[int, str, int, int, int]]:
    """(number, units that cover the range, their first byte, low, high) of byte ranges of a text with its space.

    A range ends at a multiple of size unless the unit around it is longer than half of size; that range goes on.
    """
    text = " " + text
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum(np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4))))])
    solid = ~np.isin(code, SPACES)
    places = np.concatenate([[0], np.flatnonzero(np.isin(code[1:], [10, 32]) & solid[:-1]) + 1, [len(code)]])
    marks = np.arange(size, at[-1], size)
    before, after = places[np.searchsorted(at[places], marks, "right") - 1], places[np.searchsorted(at[places], marks)]
    fine = at[after] - at[before] <= size / 2
    marks, before, after = marks[fine], before[fine], after[fine]
    lows, highs = [0, *marks.tolist()], [*marks.tolist(), int(at[-1])]
    firsts, lasts = [0, *before.tolist()], [*after.tolist(), len(code)]
    for k, (low, high, f, last) in enumerate(zip(lows, highs, firsts, lasts, strict=True)):
        yield k, text[f:last], int(at[f]), low, high


ROW = "n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>, times array<int>"
FRAGMENT = "prefix_a array<int>, prefix_b array<int>, closed string, suffix_a array<int>, suffix_b array<int>, split boolean, links array<long>, n_a long, n_b long, n_groups long, whole boolean"
NOTHING = {"n_a": 0, "n_b": 0, "n_groups": 0, "groups_sha256": "", "links": [], "times": []}


def finished(text: str, links: list[int], n_a: int, n_b: int, n_groups: int) -> dict:
    pairs, times = np.unique(np.array(links, np.int64), return_counts=True)
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "groups_sha256": hashlib.sha256(text.encode()).hexdigest(), "links": pairs, "times": times}


def columns(rows: list[dict], schema: str) -> list[pa.Array]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return [pa.array([r[name] for r in rows], kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))]


def whole_rows(e: Encoder, units: list[list[str]]) -> list[pa.Array]:
    """ROW's columns of texts as lists of units: what their distinct units give is put together by numbers."""
    distinct = [*set().union(*units)]
    known = e.learn(distinct)
    number = {u: i for i, u in enumerate(distinct)}.__getitem__
    each = [np.fromiter(map(number, us), np.int64, len(us)) for us in units]
    bad = np.array([x is None for x in known], bool)
    each = [i if not bad[i].any() else i[:0] for i in each]
    texts = [x[0] if x else "" for x in known]
    n_a, n_b, n_links = (np.array([f(x) if x else 0 for x in known], np.int64) for f in (lambda x: x[2], lambda x: x[3], lambda x: len(x[1])))
    flat, first = np.fromiter(chain.from_iterable(x[1] for x in known if x), np.int64), np.cumsum(n_links) - n_links
    at = np.concatenate([*each, np.zeros(0, np.int64)])
    doc, sizes = np.repeat(np.arange(len(each)), [len(i) for i in each]), n_links[at]
    place = np.repeat(first[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    pairs, times = np.unique(np.repeat(doc, sizes) << 33 | flat[place], return_counts=True)
    offsets = pa.array(np.searchsorted(pairs, np.arange(len(each) + 1) << 33).astype(np.int32))
    total = lambda n: pa.array(np.bincount(doc, n[at], len(each)).astype(np.int64))
    hashes = [hashlib.sha256(";".join([texts[j] for j in i.tolist()]).encode()).hexdigest() if len(i) else "" for i in each]
    return [total(n_a), total(n_b), total(n_links), pa.array(hashes, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(pairs & ((1 << 33) - 1))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]


def short_rows(docs: DataFrame, folder: str) -> DataFrame:
    """(id, ROW) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder)
        for big in batches:
            for first in range(0, big.num_rows, AT_ONCE):
                batch = big.slice(first, AT_ONCE)
                units = [e.units(" " + t) if t else [] for t in batch["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch["id"], *whole_rows(e, units)], ["id", *(x.split()[0] for x in ROW.split(", "))])

    return docs.mapInArrow(run, f"id long, {ROW}")


def long_rows(texts: DataFrame, folder: str, size: int) -> DataFrame:
    """(key, ROW) of distinct long texts (key, text): fragments of ranges in many tasks, composed FAN at a time until each text has one."""

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for k, part, start, low, high in ranges(text, size):
                    yield pa.RecordBatch.from_pydict({"key": [key], "k": [k], "part": [part], "start": [start], "low": [low], "high": [high]})

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder)
        for batch in batches:
            for r in batch.to_pylist():
                yield flat(r["key"], r["k"], e.range(r["part"], r["start"], r["low"], r["high"]))

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield flat(r["key"], r["k"], reduce(compose, (raised(x) for x in sorted(r["all"], key=lambda x: x["k"]))))

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [finished(";".join([group(*f.prefix), *f.closed]), f.links, f.n_a, f.n_b, f.n_groups) if f.whole else NOTHING for f in map(raised, batch.to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["key"], *columns(rows, ROW)], ["key", *(x.split()[0] for x in ROW.split(", "))])

    most = texts.agg(F.max(F.octet_length("text"))).first()[0]
    if most is None:
        return texts.sparkSession.createDataFrame([], f"key string, {ROW}")
    names = ["k", *(x.split()[0] for x in FRAGMENT.split(", "))]
    kind = f"key string, k long, {FRAGMENT}"
    parts = texts.mapInArrow(cuts, "key string, k long, part string, start long, low long, high long")
    done = parts.repartition("key", "k").mapInArrow(fragments, kind)
    for _ in range(max(1, math.ceil(math.log(most // size + 1, FAN) - 1e-9))):
        done = done.groupBy("key", F.floor(F.col("k") / FAN).alias("k")).agg(F.collect_list(F.struct(*names)).alias("all")).mapInArrow(composed, kind)
    return done.mapInArrow(closed, f"key string, {ROW}")


def flat(key: str, k: int, f: Fragment) -> pa.RecordBatch:
    row = {"prefix_a": f.prefix[0], "prefix_b": f.prefix[1], "closed": ";".join(f.closed), "suffix_a": f.suffix[0], "suffix_b": f.suffix[1], "split": f.split, "links": f.links, "n_a": f.n_a, "n_b": f.n_b, "n_groups": f.n_groups, "whole": f.whole}
    return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k], pa.int64()), *columns([row], FRAGMENT)], ["key", "k", *row])


def raised(r: dict) -> Fragment:
    return Fragment((r["prefix_a"], r["prefix_b"]), [r["closed"]] if r["closed"] else [], (r["suffix_a"], r["suffix_b"]), r["split"], r["links"], r["n_a"], r["n_b"], r["n_groups"], r["whole"])


def aligned(docs: DataFrame, folder: str = FOLDER, size: int = RANGE) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, groups_sha256, links, times), kept in the shared folder; links are the distinct id pairs that end together, times how often.

    Equal long texts are aligned once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    long = F.coalesce(F.octet_length("text") > size, F.lit(False))
    keyed = rows.where(long).select("id", F.sha2("text", 256).alias("key"), "text")
    found = long_rows(keyed.groupBy("key").agg(F.first("text").alias("text")), folder, size)
    both = short_rows(spread(rows).where(~long), folder).unionByName(keyed.select("id", "key").join(found, "key").drop("key"))
    place = f"{shared_folder(docs.sparkSession)}/aligned-{uuid.uuid4().hex}"
    both.withColumnRenamed("id", "doc_id").withColumn("row", F.monotonically_increasing_id()).write.parquet(place)
    return docs.sparkSession.read.parquet(place)


def linked(rows: DataFrame) -> DataFrame:
    """(row, pair, times)."""
    return rows.select("row", F.explode(F.arrays_zip("links", "times")).alias("x")).select("row", F.col("x.links").alias("pair"), F.col("x.times").alias("times"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best): how many links of the corpus hold an id pair, and whether no other pair of its second id has more."""
    counts = cut(linked(rows).groupBy("pair").agg(F.sum("times").alias("count")))
    second: Column = F.col("pair") % SHIFT
    most = counts.groupBy(second.alias("b")).agg(F.max("count").alias("most"))  # a row for each id of the second vocabulary
    return counts.join(F.broadcast(most), second == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, folder: str = FOLDER, size: int = RANGE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs.

    Texts that are null, empty or not given back byte for byte by both tokenizers have zeros and an empty hash.
    Repeated rows and rows without id count like any. A run of more than half of size bytes without a place to cut
    is encoded in one task. Other columns of docs are not read; no rows give none. The pairs that are met most are
    joined by a broadcast of 500,000 rows at most; what the others have left, few links each, is shuffled.
    """
    rows = aligned(docs, folder, size)
    counts = cut(pair_counts(rows))
    powers = {r["p"]: r["n"] for r in counts.groupBy(F.floor(F.log2("count")).alias("p")).agg(F.count("*").alias("n")).collect()}
    least = min((p for p in powers if sum(n for q, n in powers.items() if q >= p) <= ROWS_AT_MOST), default=62)
    near = counts.where(F.col("count") >= 2**least)
    links = linked(rows).join(F.broadcast(near), "pair", "left")
    if sum(powers.values()) > ROWS_AT_MOST:
        rest = links.where("count is null").select("row", "pair", "times").join(counts.where(F.col("count") < 2**least), "pair")
        links = links.where("count is not null").select("row", "pair", "times", "count", "best").unionByName(rest)
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
