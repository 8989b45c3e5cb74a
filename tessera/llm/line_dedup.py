"""Repeated runs of lines, by prefix doubling and one distributed sort that lays out intervals of the suffix array.

It is done twice: over whole lines, and then, over what that leaves, over lines cut further at sentence ends, so that
passages within lines are found too; the first turn spares the second most positions.
In each turn positions that no repeated run can hold are passed over first: each unit opens the shortest run from it on
with enough words, and one whose opening run has a hash that occurs once in the corpus opens no repeated run. The
hashes travel packed, each once for a task, so a hot one is no one task's; those that occur twice are bits of a table of
bounded size that every task reads, and one that is there by chance only costs a position that the sort drops.
Prefix doubling then names every position's first 2^k units by the names of its first and second 2^(k-1) units; names
are 128 bits that follow from the units alone, as the units' own digests do, so that no level has to be dealt out. A run
of L units is named by two overlapping names, and sorting all runs by their names and places lays out the intervals of
common prefixes of L units, each with its first copy in front. The shortest runs with enough words, from every unit on
and up to every unit, cover each maximal repeated run; all but first copies go. Of texts that are equal as a whole only
the first takes part, as the others are later copies of it from end to end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tessera.llm.common import cut, free, lean, mix64, shuffle_partitions, small, spread

#: A position: its text (is the id null, the id or 0, a hash of id and text) and the unit's number in it.
TEXT = ["none", "id", "doc"]
PLACE = [*TEXT, "seq"]
PLACE_DDL = "none int, id long, doc long, seq int"
#: Bits of the table of repeated hashes at most, as a power of 2 (16 MB).
TABLE_BITS = 27


def units(text: str) -> list[bytes]:
    """A text's lines cut further after each full stop, question or exclamation mark with a space. Joined they are the text."""
    raw = text.encode("utf-8", "surrogatepass")
    mark = b"\xff"  # no byte of UTF-8
    for end in (b". ", b"? ", b"! ", b"\n"):
        raw = raw.replace(end, end + mark)
    parts = raw.split(mark)
    return parts if parts[-1] else parts[:-1]


def numbered(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(line, unit, part): parts of units() with the numbers of their line and unit, neither counting those without words (-1)."""
    line, seq, in_line = 0, 0, False
    for part in units(text):
        if held := bool(part.split()):
            yield line, seq, part
            seq, in_line = seq + 1, True
        else:
            yield line, -1, part
        if part.endswith(b"\n"):
            line, in_line = line + (in_line or held), False


def stretches(text: np.ndarray, seq: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each unit (in order of text and number) where its stretch of consecutive units begins and ends, and the words before each unit and before the end."""
    new = np.append(True, (np.diff(text) != 0) | (np.diff(seq) != 1))
    begin = np.maximum.accumulate(np.where(new, np.arange(len(seq)), 0))
    ends = np.append(np.flatnonzero(new)[1:], len(seq))
    return begin, ends[np.cumsum(new) - 1], np.concatenate([[0], np.cumsum(words)])


def windows(text: np.ndarray, seq: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, units): for each unit the shortest stretch of consecutive units from it on, and up to it, with `least` words."""
    begin, end, total = stretches(text, seq, words)
    at = np.arange(len(seq))
    upto = np.searchsorted(total, total[:-1] + least)  # total[upto] - total[i] >= least
    fits = upto <= end
    since = np.searchsorted(total, total[1:] - least, side="right") - 1
    back = since >= begin
    code = np.unique(np.concatenate([at[fits] * (len(seq) + 1) + (upto - at)[fits], since[back] * (len(seq) + 1) + (at + 1 - since)[back]]))
    return code // (len(seq) + 1), code % (len(seq) + 1)


#: Base of the hashes of opening runs and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def openings(text: np.ndarray, seq: np.ndarray, words: np.ndarray, digest: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash): the units from which on a text has `least` words, and a hash of the shortest such run, which equal runs share."""
    _, end, total = stretches(text, seq, words)
    upto = np.searchsorted(total, total[:-1] + least)
    at = np.flatnonzero(upto <= end)
    power, inverse = (np.cumprod(np.append(np.uint64(1), np.full(len(text), b, np.uint64))) for b in (BASE, INVERSE))
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digest.view(np.uint64) * power[:-1])])
    return at, ((summed[upto[at]] - summed[at]) * inverse[at]).view(np.int64)


def reached(text: np.ndarray, seq: np.ndarray, words: np.ndarray, opening: np.ndarray, least: int) -> np.ndarray:
    """Whether each unit is in one of the shortest runs, from a unit on or up to a unit, that begin at the places `opening`."""
    _, end, total = stretches(text, seq, words)
    upto = np.searchsorted(total, total + least)
    last = np.minimum(np.maximum(upto[opening], upto[opening + 1] - 1), end[opening])
    step = np.zeros(len(text) + 1, np.int64)
    np.add.at(step, opening, 1)
    np.add.at(step, last, -1)
    return np.cumsum(step[:-1]) > 0


def names(digest: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two numbers for each run (first, size) over units with two digests each, which runs of equal units share: doubling names 2^k units by two names of 2^(k-1)."""
    out, name, level = np.zeros((len(first), 2), np.uint64), digest.view(np.uint64), 1
    while len(first) and level <= size.max():
        m = (size >= level) & (size < 2 * level)
        out[m] = mix64(mix64(name[first[m]]) + name[first[m] + size[m] - level])
        name, level = mix64(mix64(name[:-level]) + name[level:]), 2 * level
    return out.view(np.int64)


def text_key(id_: Column, text: Column) -> Column:
    return F.xxhash64(id_.cast("string"), text)


def later_copies(df: DataFrame, key: list[str]) -> DataFrame:
    """The suffix-array intervals of positions (columns PLACE) that agree in the integer columns key.

    Positions are sorted by key, then place, over range partitions; a class may span any number of them, so a key of
    very many positions is no one task's. Each task learns from a summary of a row for each partition, which the
    driver holds, where the class that it begins with began. Gives PLACE, the first column of key, and the place of the
    class's first position (lead_...) for all but that first position. Places must be distinct within a class.
    """
    order = [*key, *PLACE]
    dealt = df.select(*order).repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = cut(dealt.select("*", F.monotonically_increasing_id().alias("at")))
    last = F.struct(*key, (-F.col("at")).alias("back"))
    edges = placed.groupBy(F.shiftright("at", 33).alias("pid")).agg(F.min(F.struct(*key)).alias("first"), F.max(last).alias("last"), F.max_by(F.struct("at", *PLACE), last).alias("head")).orderBy("pid").collect()
    known: dict[int, tuple] = {}  # by partition: the key and the first position of the class before it
    held_key = held_head = None
    for e in edges:
        known[e["pid"]] = (held_key, held_head)
        ends = tuple(e["last"])[: len(key)]
        held_head = held_head if ends == held_key else tuple(e["head"])[1:]
        held_key = ends
    shared = df.sparkSession.sparkContext.broadcast(known)
    names = [*PLACE, key[0], *(f"lead_{c}" for c in PLACE)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = head = None
        begun = False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not begun:
                before, head = shared.value[batch.column("at")[0].as_py() >> 33]
                begun = True
            columns = {c: batch.column(c).to_numpy() for c in order}
            keys = [columns[c] for c in key]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            new[0] = before != tuple(int(k[0]) for k in keys)
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            heads = [np.where(first >= 0, columns[c][first], 0 if head is None else head[i]).astype(columns[c].dtype) for i, c in enumerate(PLACE)]
            before, head = tuple(int(k[-1]) for k in keys), tuple(int(h[-1]) for h in heads)
            yield pa.RecordBatch.from_arrays([pa.array(x[~new]) for x in (*(columns[c] for c in PLACE), columns[key[0]], *heads)], names)

    kinds = dict(placed.dtypes)
    lead = ", ".join(f"lead_{x}" for x in PLACE_DDL.split(", "))
    return placed.mapInArrow(scan, f"{PLACE_DDL}, {key[0]} {kinds[key[0]]}, {lead}")


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(none, id, doc, text) of the rows with a text."""
    id_ = F.col(id_col).cast("long")
    return docs.where(F.col(text_col).isNotNull()).select(id_.isNull().cast("int").alias("none"), F.coalesce(id_, F.lit(0)).alias("id"), text_key(id_, F.col(text_col)).alias("doc"), F.col(text_col).alias("text"))


def later_texts(texts: DataFrame) -> DataFrame:
    """(none, id, doc) of the texts that equal one of a smaller place."""
    once = texts.select(*TEXT, F.lit(0).alias("seq"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2")).distinct()
    return later_copies(once, ["t1", "t2"]).select(*TEXT)


def numbers(ranges: list[int] | None) -> list[int]:
    """The numbers in ranges, given as first, end, first, end and so on."""
    return [i for a, z in zip((ranges or [])[::2], (ranges or [])[1::2], strict=True) for i in range(a, z)]


def packed_units(texts: DataFrame, least: int, whole_lines: bool) -> DataFrame:
    """(none, id, doc, digests, words, seqs) for every text in which `least` words are left: 16, 4 and 4 bytes for each unit."""

    def held(text: str, gone: list[int] | None) -> tuple[list[bytes], range | list[int]]:
        if gone:
            drop = set(numbers(gone))
            left = [(i, x.strip()) for line, i, x in numbered(text) if i >= 0 and line not in drop]
            return [x for _, x in left], [i for i, _ in left]
        parts = [x for x in map(bytes.strip, text.encode("utf-8", "surrogatepass").split(b"\n") if whole_lines else units(text)) if x]
        return parts, range(len(parts))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, kept = [[], [], []], []
            for row, (text, gone) in enumerate(zip(batch.column("text").to_pylist(), batch.column("gone_lines").to_pylist(), strict=True)):
                parts, seqs = held(text, gone)
                words = np.array([len(x.split()) for x in parts], np.int32)
                if words.sum() >= least:
                    kept.append(row)
                    for column, value in zip(columns, (b"".join(map(xxhash.xxh3_128_digest, parts)), words.tobytes(), np.array(seqs, np.int32).tobytes()), strict=True):
                        column.append(value)
            if kept:
                places = [pa.array(batch.column(c).to_numpy()[kept]) for c in TEXT]
                yield pa.RecordBatch.from_arrays([*places, *(pa.array(c, pa.binary()) for c in columns)], [*TEXT, "digests", "words", "seqs"])

    return spread(texts).mapInArrow(lean(pack), "none int, id long, doc long, digests binary, words binary, seqs binary")


def unpacked(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, row, number, words, digest) for some rows of packed_units() at a time: for every unit its row, number, words and digest, in two columns."""
    for whole in batches:
        for batch in (whole.slice(i, rows) for i in range(0, whole.num_rows, rows)):
            words, seqs, digests = (batch.column(c).to_pylist() for c in ("words", "seqs", "digests"))
            each = np.repeat(np.arange(len(words)), [len(w) // 4 for w in words])
            yield batch, each, np.frombuffer(b"".join(seqs), np.int32), np.frombuffer(b"".join(words), np.int32), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def twice_seen(packed: DataFrame, least: int) -> DataFrame:
    """(run): the hashes of opening runs that occur more than once. Each task sends its own once, marked if it has them more often, as packed ranges of hashes."""
    n = shuffle_partitions(packed.sparkSession)
    edges = np.arange(4 * n + 1, dtype=np.uint64) * np.uint64((1 << 64) // (4 * n))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            run, times = np.unique(np.concatenate(held), return_counts=True)
            at = np.append(np.searchsorted(run, edges[:-1]), len(run))
            rows = [(k, run[a:z], times[a:z] > 1) for k, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if a < z]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows], pa.int32()), pa.array([r[~m].tobytes() for _, r, m in rows], pa.binary()), pa.array([r[m].tobytes() for _, r, m in rows], pa.binary())], ["range", "once", "more"])

        for _, each, seq, words, digest in unpacked(batches):
            held.append(openings(each, seq, words, digest[:, 0], least)[1].view(np.uint64))
            if sum(map(len, held)) > 2_000_000:
                yield out()
                held.clear()
        if sum(map(len, held)):
            yield out()

    def among_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for batch in batches for x in (*batch.column("once").to_pylist(), *2 * batch.column("more").to_pylist())]
        run = np.sort(np.frombuffer(b"".join(found), np.int64))
        run = run[1:][run[1:] == run[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(run[np.append(True, run[1:] != run[:-1])] if len(run) else run)], ["run"])

    return packed.mapInArrow(own, "range int, once binary, more binary").repartition(n, "range").mapInArrow(among_all, "run long")


def table_of(hashes: DataFrame, most: int = TABLE_BITS) -> np.ndarray:
    """A table of bits with one set for each hash (column run), by its leading bits; 32 for each hash, but 2^most in all at most."""
    bits = min(most, max(10, (32 * hashes.count()).bit_length()))
    at = F.shiftrightunsigned("run", 64 - bits)
    set_ = hashes.select((at / 64).cast("long").alias("word"), (at % 64).cast("int").alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[set_["word"].to_numpy()] = set_["bits"].to_numpy().view(np.uint64)
    return table


def held_by(table: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Whether the table has each hash's bit."""
    at = run.view(np.uint64) >> np.uint64(58 - (len(table).bit_length() - 1))
    return table[(at >> np.uint64(6)).view(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) > 0


def repeated_runs(texts: DataFrame, least: int = 30, whole_lines: bool = False) -> DataFrame:
    """(none, id, doc, seq, lines, lead_none, lead_id, lead_doc, lead_seq): each later copy of a run and its first copy.

    A run begins with unit seq of a text and has `lines` units; units (or lines, if whole_lines) are numbered without
    those that hold no words. none, id and doc tell the text: whether its id is null, the id, and text_key(id, text);
    texts has each once. The units of lines in its column gone_lines (ranges), if it isn't null, are passed over.
    """
    packed = cut(packed_units(texts, least, whole_lines))
    twice = texts.sparkSession.sparkContext.broadcast(table_of(cut(twice_seen(packed, least))))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, each, seq, words, digest in unpacked(batches):
            at, run = openings(each, seq, words, digest[:, 0], least)
            keep = reached(each, seq, words, at[held_by(twice.value, run)], least)
            each, seq, digest = each[keep], seq[keep], digest[keep]
            first, size = windows(each, seq, words[keep], least)
            name = names(digest, first, size)
            places = [*(batch.column(c).to_numpy()[each[first]] for c in TEXT), seq[first], size.astype(np.int32), name[:, 0], name[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in places], [*PLACE, "lines", "n1", "n2"])

    return later_copies(packed.mapInArrow(lean(named), f"{PLACE_DDL}, lines int, n1 long, n2 long"), ["lines", "n1", "n2"])


def beyond_first(runs: DataFrame) -> DataFrame:
    """(none, id, doc, gone): the ranges that later copies of runs cover in each text, without what they share with a first copy in it: first, end, first, end and so on."""
    same = (F.col("none") == F.col("lead_none")) & (F.col("id") == F.col("lead_id")) & (F.col("doc") == F.col("lead_doc"))
    begin = F.when(same, F.greatest("seq", F.col("lead_seq") + F.col("lines"))).otherwise(F.col("seq"))
    parts = runs.select(*TEXT, begin.alias("begin"), (F.col("seq") + F.col("lines")).alias("end")).where("begin < end")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                begins, ends = (batch.column(c) for c in ("begins", "ends"))
                each = np.repeat(np.arange(batch.num_rows), np.diff(begins.offsets.to_numpy()))
                first, end = begins.flatten().to_numpy(), ends.flatten().to_numpy()
                order = np.lexsort((first, each))
                shift = each[order] * (1 << 32)  # keeps texts apart
                first, end = first[order] + shift, np.maximum.accumulate(end[order] + shift)
                new = np.append(True, first[1:] > end[:-1])
                last = np.append(new[1:], True)
                flat = np.stack([first[new], end[last]], axis=1) & ((1 << 32) - 1)
                sizes = np.bincount(each[order][new], minlength=batch.num_rows)
                gone = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(2 * sizes)), pa.int32()), pa.array(flat.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in TEXT), gone], [*TEXT, "gone"])

    # A text's runs at most; both lists come in one order, and without nulls.
    of_text = parts.groupBy(*TEXT).agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))
    return of_text.mapInArrow(joined, "none int, id long, doc long, gone array<int>")


def repeats(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(doc_id, key, gone_lines, gone_units, whole): ranges of the lines and units to delete from a text, or whole for a text that equals an earlier one."""
    texts = texts_of(docs, id_col, text_col)
    if texts.groupBy(*TEXT).count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(TEXT)  # rows equal in id and text are one text
    copies = cut(later_texts(texts))
    first = texts.join(small(copies), TEXT, "left_anti")
    none = F.lit(None).cast("array<int>")
    lines = cut(beyond_first(repeated_runs(first.withColumn("gone_lines", none), least, whole_lines=True)))
    left = first.join(small(lines.withColumnRenamed("gone", "gone_lines"), "gone_lines"), TEXT, "left")
    parts = beyond_first(repeated_runs(left, least))
    found = lines.select(*TEXT, F.col("gone").alias("gone_lines"), none.alias("gone_units"), F.lit(False).alias("whole"))
    found = found.unionByName(parts.select(*TEXT, none.alias("gone_lines"), F.col("gone").alias("gone_units"), F.lit(False).alias("whole")))
    found = found.unionByName(copies.select(*TEXT, none.alias("gone_lines"), none.alias("gone_units"), F.lit(True).alias("whole")))
    one = found.groupBy(*TEXT).agg(F.max("gone_lines").alias("gone_lines"), F.max("gone_units").alias("gone_units"), F.max("whole").alias("whole"))  # at most one of each
    return cut(one.select(F.when(F.col("none") == 0, F.col("id")).alias("doc_id"), F.col("doc").alias("key"), "gone_lines", "gone_units", "whole"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 30) -> DataFrame:
    """(doc_id, key, gone): for every text with units to delete their numbers (from 0, in order), counting units that hold words.

    key is text_key(id, text); rows equal in id and text are one text. Units are compared exactly but for white space
    at their ends; a run counts with `least` words or more in whole units, so a passage that begins or ends within a
    unit counts without that unit. Its first copy is the one of the smallest (doc_id, key, place), null ids last. A
    copy that overlaps the first in one text loses only what lies beyond it.
    """
    id_, text = F.col("doc_id").cast("long"), F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(id_col).cast("long"), F.col(text_col)).alias("key"))
    done = without_repeats(rows.select(id_.alias("doc_id"), text, "key"), least=least)
    return done.where(F.size("gone") > 0).select("doc_id", "key", "gone").dropDuplicates(["doc_id", "key"])


def rest_of(text: str, gone_lines: list[int], gone_units: list[int], whole: bool, least: int) -> tuple[str, int, list[int]]:
    """What is left of a text without its lines and units gone (or all, if it has `least` words), how many units with words it had, and which went.

    A line that loses all its words goes with its end.
    """
    if not (gone_lines or gone_units or whole):
        return text, sum(not part.isspace() for part in units(text)), []
    parts = list(numbered(text))
    n = sum(i >= 0 for _, i, _ in parts)
    if whole:
        gone = list(range(n)) if sum(len(x.split()) for _, _, x in parts) >= least else []
    else:
        lines, drop = set(gone_lines), set(gone_units)
        gone = [i for line, i, _ in parts if i >= 0 and (line in lines or i in drop)]
    if not gone:
        return text, n, gone
    out, drop = [], set(gone)
    line, lost, left = [], False, False
    for k, (_, i, part) in enumerate(parts):
        if i in drop:
            lost = True
        else:
            line.append(part)
            left |= i >= 0
        if part.endswith(b"\n") or k + 1 == len(parts):
            if not lost:
                out += line
            elif left:
                out.append(b"".join(line).rstrip(b" \n") + (b"\n" if part.endswith(b"\n") else b""))
            line, lost, left = [], False, False
    raw = b"".join(out)
    if raw.endswith(b"\n") and not text.endswith("\n"):
        raw = raw[:-1]
    return raw.decode("utf-8", "surrogatepass"), n, gone


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 30, prefix: str = "") -> DataFrame:
    """docs with the units that repeated_lines() names taken out of its texts, and with columns n_lines and gone (their names after prefix).

    n_lines counts the units with words of the original text (null: 0), gone numbers those deleted, from 0. Every row
    stays, null and empty texts as they are; a text whose units all go is empty. Texts are read whole, at any length.
    Columns of docs that clash with n_lines and gone are replaced unless prefix tells them apart. An empty table gives
    no rows.
    """
    p = free(docs, "doc_id", "key", "lines", "units", "whole", "own")
    gone = repeats(docs, id_col, text_col, least).select(F.col("doc_id").alias(f"{p}doc_id"), F.col("key").alias(f"{p}key"), F.col("gone_lines").alias(f"{p}lines"), F.col("gone_units").alias(f"{p}units"), F.col("whole").alias(f"{p}whole"))
    rows = docs.drop(f"{prefix}n_lines", f"{prefix}gone").withColumn(f"{p}own", text_key(F.col(id_col).cast("long"), F.col(text_col)))
    rows = rows.join(small(gone, f"{p}lines", f"{p}units"), F.col(id_col).cast("long").eqNullSafe(F.col(f"{p}doc_id")) & (F.col(f"{p}own") == F.col(f"{p}key")), "left").drop(f"{p}own", f"{p}doc_id", f"{p}key")
    kept = rows.drop(f"{p}lines", f"{p}units", f"{p}whole").schema
    schema = StructType([*kept.fields, StructField(f"{prefix}n_lines", IntegerType()), StructField(f"{prefix}gone", ArrayType(IntegerType()))])

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            done = [(None, 0, []) if t is None else rest_of(t, numbers(x), numbers(y), bool(w), least) for t, x, y, w in zip(*(batch.column(c).to_pylist() for c in (at, f"{p}lines", f"{p}units", f"{p}whole")), strict=True)]
            columns = [batch.column(c) for c in kept.names]
            columns[kept.names.index(text_col)] = pa.array([t for t, _, _ in done], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n, _ in done], pa.int32()), pa.array([g for _, _, g in done], pa.list_(pa.int32()))], [*kept.names, f"{prefix}n_lines", f"{prefix}gone"])

    return rows.mapInArrow(lean(delete), schema)
