"""Markdown files to chunks: reading, front matter, links, dates, chunk context and the whole ingest."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import documents, order

YAML_FRONT, JSON_FRONT = r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)", r"(?s)\A~~~json\s*\n(.*?)\n~~~\s*(?:\n|\z)"
#: Metadata keys that may hold a chunk's place in its document, the first list found counts.
HIERARCHY = ("hierarchy", "sections", "breadcrumbs", "path")


def read_files(spark: SparkSession, path: str, patterns: tuple[str, ...] = ("*.md", "*.txt")) -> DataFrame:
    """(path, title, text) of the files under a folder, each whole: the title is the file's stem; bytes that are no UTF-8 become U+FFFD."""
    glob = "{" + ",".join(patterns) + "}"
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return files.select(F.input_file_name().alias("path"), F.make_valid_utf8("value").alias("text")).select("path", stem(F.col("path")).alias("title"), "text")


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def body(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, YAML_FRONT, ""), JSON_FRONT, "")


def front_values(text: Column) -> Column:
    """The front matter between --- lines as a map from key to (text, flag, items): items for [a, b], flag for true and false, else text without its quotes.

    Blank lines, comments and lines without a colon are left out. The last of repeated keys counts; without front matter
    the map is empty.
    """
    pairs = F.filter(F.transform(F.split(F.regexp_extract(text, YAML_FRONT, 1), "\n"), lambda x: F.trim(x)), lambda x: x.contains(":") & ~x.startswith("#"))
    bare = lambda v: F.regexp_replace(v, "^[\"']+|[\"']+$", "")
    is_list, is_flag = lambda v: v.rlike(r"(?s)^\[.*\]$"), lambda v: F.lower(v).isin("true", "false")

    def typed(v: Column) -> Column:
        items = F.transform(F.split(F.substring(v, F.lit(2), F.length(v) - 2), ","), lambda i: bare(F.trim(i)))
        plain = F.when(v.rlike("(?s)^\".*\"$|^'.*'$") & (F.length(v) > 1), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
        return F.struct(F.when(~is_list(v) & ~is_flag(v), plain).alias("text"), F.when(is_flag(v), F.lower(v) == "true").alias("flag"), F.when(is_list(v), items).alias("items"))

    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), typed(F.trim(F.regexp_replace(x, r"^[^:]*:", ""))).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def json_front(text: Column) -> Column:
    """The front matter of a ~~~json block as a map of its top keys, nested values as JSON; null if there is none or it is not an object."""
    return F.from_json(F.nullif(F.regexp_extract(text, JSON_FRONT, 1), F.lit("")), "map<string,string>")


def tag_list(text: Column, items: Column) -> Column:
    """Trimmed, non-empty tags of a list, or of a comma-separated string; neither gives none."""
    return F.filter(F.transform(F.coalesce(items, F.split(text, ","), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def plain_date(raw: Column) -> Column:
    return F.nullif(F.trim(raw), F.lit(""))


def links(text: Column) -> Column:
    """(text, url, line) of inline links, lines from 1; lines that open or close a fence are passed over."""
    found = lambda x, n: F.regexp_extract_all(x, F.lit(r"\[([^\]]+)\]\(([^)]+)\)"), F.lit(n))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.when(F.trim(x).startswith("```"), F.lit("")).otherwise(x))
    by_line = F.transform(lines, lambda x, i: F.zip_with(found(x, 1), found(x, 2), lambda a, b: F.struct(a.alias("text"), b.alias("url"), (i + 1).alias("line"))))
    return F.flatten(by_line)


def sentence_start(text: Column, at: Column) -> Column:
    """The start of the sentence in which an index (from 0) falls: past the last . ! or ? before it and white space after that; the index itself if there is none."""
    upto = F.length(F.regexp_extract(F.substring(text, F.lit(1), at), r"(?s)\A.*[.!?]", 0))
    start = upto + F.length(F.regexp_extract(F.substring(text, upto + 1, F.length(text)), r"\A\s*", 0))
    return F.when((at > 0) & (upto > 0) & (start <= at), start).otherwise(at)


def last_sentence(text: Column) -> Column:
    """What follows the last . ! or ? with white space after it; empty for a blank text."""
    return F.coalesce(F.element_at(F.split(F.trim(text), r"(?<=[.!?])\s+"), -1), F.lit(""))


def previous_sentences(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "chunk_text") -> DataFrame:
    """chunks with previous_sentence, the last sentence of the chunk before in the document; empty for the first.

    The last sentences alone are joined by (document, index), so that a document of any number of chunks spreads over tasks.
    """
    before = chunks.select(F.col(id_col).alias("__d"), (F.col("chunk_index") + 1).alias("__i"), last_sentence(F.col(text_col)).alias("previous_sentence"))
    both = chunks.join(before, (F.col(id_col) == F.col("__d")) & (F.col("chunk_index") == F.col("__i")), "left").drop("__d", "__i")
    return both.withColumn("previous_sentence", F.coalesce("previous_sentence", F.lit("")))


def hierarchy_path(metadata: Column) -> Column:
    """Intro > Overview, of the first of the HIERARCHY keys of JSON metadata that holds a list; blank items go; empty if there is none."""
    lists = [F.from_json(F.get_json_object(metadata, f"$.{k}"), "array<string>") for k in HIERARCHY]
    return F.coalesce(F.array_join(F.filter(F.transform(F.coalesce(*lists), lambda x: F.trim(x)), lambda x: x != ""), " > "), F.lit(""))


def origin_line(metadata: Column) -> Column:
    """[Source: f | Date: d | Author: a] of JSON metadata, source_file before source and document_date before date; parts that are missing or empty go."""
    keys = F.coalesce(F.json_object_keys(metadata), F.array().cast("array<string>"))
    one = lambda k: F.nullif(F.get_json_object(metadata, f"$.{k}"), F.lit(""))
    either = lambda a, b: F.when(F.array_contains(keys, a), one(a)).otherwise(one(b))
    parts = [F.concat(F.lit(f"{n}: "), v) for n, v in (("Source", either("source_file", "source")), ("Date", either("document_date", "date")), ("Author", one("author")))]
    joined = F.concat_ws(" | ", *parts)
    return F.when(joined == "", "").otherwise(F.concat(F.lit("["), joined, F.lit("]")))


def header_problem(header: Column, most: int = 200) -> Column:
    """What is wrong with a context header: empty, too_long or no_brackets; null for a valid one."""
    blank = F.coalesce(F.trim(header) == "", F.lit(True))
    return F.when(blank, "empty").when(F.length(header) > most, "too_long").when(~(header.contains("[") & header.contains("]")), "no_brackets")


def displayed(header: Column) -> Column:
    """A header on one line: single spaces, also between bracketed parts and around bars."""
    for pattern, into in ((r"\s+", " "), (r"\]\[", "] ["), (r"\s*\|\s*", " | ")):
        header = F.regexp_replace(header, pattern, into)
    return F.trim(header)


def normal_date(raw: Column, kind: str = "string") -> Column:
    """A date as text: timestamps in ISO form, strings without white space around them, null if nothing is left."""
    if kind == "timestamp":
        return F.date_format(raw, "yyyy-MM-dd'T'HH:mm:ss")
    return F.nullif(F.regexp_replace(raw.cast("string"), r"\A\s+|\s+\z", ""), F.lit(""))


def file_header(path: Column, index: Column) -> Column:
    return F.concat(file_name(path), F.lit(" > Chunk "), index.cast("string"))


def batches(df: DataFrame, size: int, id_col: str) -> DataFrame:
    """df with batch, start and end (exclusive) of slices of a fixed size in the order of a unique integer id, from 0.

    Places come from counts over quantiles of the ids, so that no task orders all rows and ids may bunch anywhere.
    Rows without id are left out.
    """
    placed = order.places(df, id_col, "__at").withColumn("batch", F.floor(F.col("__at") / size)).drop("__at")
    total = df.agg(F.count(id_col).alias("__total"))
    return placed.join(F.broadcast(total)).withColumn("start", F.col("batch") * size).withColumn("end", F.least(F.col("start") + size, F.col("__total"))).drop("__total")


def chunks(files: DataFrame, separator: str = r"\n\s*\n", key: str = "path") -> DataFrame:
    """Files (path, title, text) as chunk rows: paragraphs of the body with index, total, white-space tokens, hash, header and metadata as JSON."""
    rows = files.select(key, "title", F.to_json(front_values(F.col("text"))).alias("front"), F.regexp_replace(body(F.col("text")), r"\A\s+|\s+\z", "").alias("body"))
    parts = documents.paragraphs(rows, separator, key, "body", ("title", "front"))
    meta = F.to_json(F.struct("title", "chunk_index", "total_chunks", "token_count"))
    return parts.withColumn("context_header", file_header(F.col(key), F.col("chunk_index"))).withColumn("metadata", meta)


def ingest(spark: SparkSession, path: str, separator: str = r"\n\s*\n") -> DataFrame:
    """A folder of Markdown and text files as chunk rows with ids: the hash of path, place and text."""
    made = chunks(read_files(spark, path), separator)
    return made.withColumn("chunk_id", F.xxhash64("path", "chunk_index", "chunk_hash"))


@lru_cache(maxsize=2)
def encoding(vocabulary: str, pattern: str):
    """A byte-level BPE from a file of lines "base64 rank"; read once in each Python worker."""
    import base64

    import tiktoken

    with open(vocabulary) as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Fixed value: how a byte-level BPE of this kind cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenized(docs: DataFrame, vocabulary: str, limit: int = 8192, text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """docs with token_ids, n_tokens, within_limit and decoded, which equals the text. Null texts have no tokens.

    The vocabulary is a path that every executor can read.
    """

    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary, pattern)
        for texts in parts:
            ids = [enc.encode_ordinary(x) if x else [] for x in texts]
            yield pd.DataFrame({"token_ids": ids, "decoded": [enc.decode(i) for i in ids]})

    coded = docs.withColumn("__t", F.pandas_udf(encode, "token_ids array<int>, decoded string")(F.col(text_col)))
    return coded.select(*docs.columns, "__t.token_ids", F.size("__t.token_ids").alias("n_tokens"), (F.size("__t.token_ids") <= limit).alias("within_limit"), "__t.decoded")
