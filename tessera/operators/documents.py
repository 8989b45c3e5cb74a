"""Documents to chunks: reading, cleaning, windows, paragraphs, sentences, headers and hashes."""


import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def front_matter(front: Column) -> Column:
    """The key: value lines of a front block as a map; quotes and brackets around values go."""
    pairs = F.filter(F.split(front, "\n"), lambda x: x.contains(":"))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r"^[\"'\[]|[\"'\]]$", "").alias("v")))
    return F.map_from_entries(F.array_distinct(entries))


def clean_markdown(text: Column) -> Column:
    """Text without fences, inline code marks, link targets, emphasis, HTML tags, rules and surplus blank space."""
    for pattern, into in ((r"(?s)```.*?```", ""), (r"`([^`]*)`", "$1"), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"__([^_]+)__", "$1"), (r"\*([^*\n]+)\*", "$1"), (r"(?s)<[^>]+>", ""), (r"(?m)^\s*(?:[-*_]\s*){3,}$", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, into)
    return F.trim(text)


def headings(text: Column) -> Column:
    """(level, text, line) of headings outside fences; lines are counted from 1 in the text as it is."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("line")))
    # Only fences and headings are looked at again; a heading counts if an even number of fences stands before it.
    marked = F.filter(lines, lambda p: p["x"].startswith("```") | p["x"].rlike(r"^#{1,6}\s+\S"))
    fenced = lambda i: F.size(F.filter(F.slice(marked, 1, i), lambda p: p["x"].startswith("```"))) % 2 == 1
    open_ = F.filter(marked, lambda p, i: ~p["x"].startswith("```") & ~fenced(i))
    return F.transform(open_, lambda p: F.struct(F.length(F.regexp_extract(p["x"], r"^(#{1,6})", 1)).alias("level"), F.trim(F.regexp_replace(p["x"], r"^#{1,6}\s+", "")).alias("text"), p["line"].alias("line")))


def links(html: Column) -> Column:
    """The href targets of a page's anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def page_text(html: Column) -> Column:
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<[^>]+>"):
        html = F.regexp_replace(html, pattern, " ")
    return F.trim(F.regexp_replace(html, r"\s+", " "))


def title(text: Column) -> Column:
    """The first heading's text, or Untitled."""
    found = F.regexp_extract(text, r"(?m)^#{1,6}[ \t]+(\S[^\n]*)$", 1)
    return F.when(found == "", "Untitled").otherwise(F.trim(found))


def windows(docs: DataFrame, size: int = 512, overlap: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token windows: a row for each, with its tokens' places, the real overlap with the window before, and its share of the text.

    A text's characters are shared out evenly over its tokens, as the tokenizer keeps no places.
    """
    step = size - overlap
    rows = docs.withColumn("n", F.size(F.filter(F.split(text_col, r"\s+"), lambda t: t != ""))).where("n > 0")
    count = F.when(F.col("n") <= size, 1).otherwise(1 + F.ceil((F.col("n") - size) / float(step))).cast("int")
    rows = rows.withColumn("total_chunks", count).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)))
    rows = rows.withColumn("start", F.col("chunk_index") * step).withColumn("end", F.least(F.col("start") + size, "n"))
    each = F.length(text_col) / F.col("n").cast("double")
    low, high = F.floor(F.col("start") * each).cast("int"), F.when(F.col("end") == F.col("n"), F.length(text_col)).otherwise(F.floor(F.col("end") * each)).cast("int")
    shared = F.when(F.col("chunk_index") == 0, 0).otherwise(F.least(F.lit(overlap), F.col("end") - F.col("start")))
    return rows.select(id_col, "chunk_index", "total_chunks", "start", "end", (F.col("end") - F.col("start")).alias("token_count"), shared.alias("overlap_tokens"), F.trim(F.substring(F.col(text_col), low + 1, high - low)).alias("chunk_text"))


def paragraphs(docs: DataFrame, separator: str = "\n", id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks at separators, blank ones left out, numbered, with white-space token counts and hashes."""
    parts = F.filter(F.transform(F.split(text_col, separator), lambda p: F.trim(p)), lambda p: p != "")
    rows = docs.select(id_col, *keep, F.size(parts).alias("total_chunks"), F.posexplode(parts).alias("chunk_index", "chunk_text"))
    return rows.withColumn("token_count", F.size(F.split("chunk_text", r"\s+"))).withColumn("chunk_hash", F.sha2("chunk_text", 256))


def sentence_count(text: Column) -> Column:
    """Stretches that end in . ! or ? and white space, and what is left after the last."""
    ends = F.regexp_count(text, F.lit(r"[.!?]+\s+"))
    return (ends + F.when(F.regexp_replace(text, r"(?s)^.*[.!?]+\s+", "") != "", 1).otherwise(0)).cast("int")


def char_windows(text: str, size: int = 1500, overlap: int = 300, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " "), least: int = 1) -> list[str]:
    """Windows of characters that end at the last separator within them; each begins after the one before began."""
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            cut = max((text.rfind(s, start + 1, end) + len(s) for s in separators if text.rfind(s, start + 1, end) > start), default=end)
            end = cut if cut > start else end
        if len(part := text[start:end].strip()) >= least:
            out.append(part)
        if end >= len(text):
            break
        start = max(start + 1, end - overlap)
    return out


def char_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1500, overlap: int = 300) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, n, part) for i, t in zip(f[id_col], f[text_col], strict=True) for n, part in enumerate(char_windows(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "chunk_text"])

    return docs.select(id_col, text_col).mapInPandas(run, "doc_id long, chunk_index int, chunk_text string")


def context_header(title_: Column, author: Column, day: Column, tag_list: Column, path: Column, summary: Column) -> Column:
    """[Document: t] [Author: a, Date: d] [Tags: ...] / [Context: a > b] / [Summary: s] / ---; parts that are null or empty go."""
    by = F.nullif(F.concat_ws(", ", F.concat(F.lit("Author: "), author), F.concat(F.lit("Date: "), day)), F.lit(""))
    listed = F.nullif(F.array_join(tag_list, ", "), F.lit(""))
    first = F.concat_ws(" ", F.concat(F.lit("[Document: "), title_, F.lit("]")), F.concat(F.lit("["), by, F.lit("]")), F.concat(F.lit("[Tags: "), listed, F.lit("]")))
    where = F.nullif(F.array_join(F.filter(path, lambda p: p.isNotNull() & (p != "")), " > "), F.lit(""))
    return F.concat_ws("\n", first, F.concat(F.lit("[Context: "), where, F.lit("]")), F.concat(F.lit("[Summary: "), F.nullif(summary, F.lit("")), F.lit("]")), F.lit("---"))


def summary(text: Column, tokens: int = 20) -> Column:
    """The first words, 1.3 for each token allowed."""
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, int(np.ceil(1.3 * tokens))), " ")


def position_label(index: Column, total: Column) -> Column:
    return F.format_string("Chunk %d of %d (%d%%)", index + 1, total, F.floor((index + 1) * 100 / total).cast("int"))


def batch_size(n: Column, most: int) -> Column:
    return F.when(n == 0, 1).when(n <= 100, F.least(n, F.lit(most))).when(n <= 1000, F.least(F.floor(n / 10).cast("int"), F.lit(most))).otherwise(most)


def hash_embed(texts: pd.Series, dim: int = 64) -> pd.Series:
    """A stand-in embedding: signed hashes of words, of unit length. Blank texts are an error."""
    import zlib

    out = []
    for text in texts:
        if not text or not text.strip():
            raise ValueError("a blank text has no embedding")
        v = np.zeros(dim)
        for w in re.findall(r"\w+", text.lower()) or [text.strip()]:
            h = zlib.crc32(w.encode())
            v[h % dim] += 1.0 if h >> 31 else -1.0
        n = np.linalg.norm(v)
        out.append((v / n if n else np.eye(1, dim)[0]).astype(np.float32))
    return pd.Series(out)


def embed(docs: DataFrame, text_col: str = "text", model: Callable[[pd.Series], pd.Series] = hash_embed) -> DataFrame:
    """docs with a column embedding; the model gets Arrow batches and may be any function from texts to vectors."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return model(texts)

    return docs.withColumn("embedding", vectors(F.col(text_col)))
