"""Result pages: projections, cursors, confidence, duplicate flags and size estimates."""

from __future__ import annotations

import base64
import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import snippet
from tessera.functions.vectors import distance

MODES = {
    "ids_only": ("chunk_id", "hybrid_score", "rank"),
    "metadata": ("chunk_id", "hybrid_score", "rank", "source_file", "source_category", "chunk_index", "total_chunks"),
    "preview": ("chunk_id", "hybrid_score", "rank", "source_file", "source_category", "chunk_index", "total_chunks", "chunk_snippet", "context_header"),
}
#: Tokens that a row of each mode is taken to cost, and the envelope.
TOKENS, ENVELOPE = {"ids_only": 10, "metadata": 200, "preview": 800, "full": 1500}, 300


def project(page: DataFrame, mode: str, *more: str) -> DataFrame:
    """The columns of a mode, and more that the page has."""
    if mode == "full":
        return page
    if mode == "preview":
        page = page.withColumn("chunk_snippet", snippet(F.col("chunk_text")))
    return page.select(*MODES[mode], *more)


def only_fields(page: DataFrame, fields: list[str]) -> DataFrame:
    unknown = [f for f in fields if f not in page.columns]
    if not fields or unknown:
        raise ValueError(f"unknown fields: {unknown}" if unknown else "no fields")
    return page.select(*fields)


def shorten(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def query_hash(request: dict) -> str:
    return hashlib.sha256(json.dumps(request, sort_keys=True).encode()).hexdigest()


def cursor(request: dict, offset: int, mode: str) -> str:
    return base64.b64encode(json.dumps({"query_hash": query_hash(request), "offset": offset, "response_mode": mode}).encode()).decode()


def offset_of(text: str | None, request: dict) -> int:
    """The offset that a cursor holds; 0 for none or for one of another request."""
    if not text:
        return 0
    held = json.loads(base64.b64decode(text))
    return held["offset"] if held["query_hash"] == query_hash(request) else 0


def page(ranked: DataFrame, offset: int, size: int) -> DataFrame:
    return ranked.where(F.col("rank").between(offset + 1, offset + size))


def percentile(score: Column, by: tuple[str, ...] = ()) -> Column:
    """100 (1 - index of the first row with the score / rows), best first."""
    own = Window.partitionBy(*by)
    return 100.0 * (1.0 - (F.rank().over(own.orderBy(F.desc("score"))) - 1) / F.count("*").over(own)) if score is not None else F.lit(None)


#: How good sources and how recent documents are taken to be.
SOURCE_QUALITY, RECENCY = 0.9, 0.85


def confidence(score: Column, by: tuple[str, ...] = ()) -> Column:
    """What stands behind a result: where its score lies among the page's (0 to 1), and the two constants."""
    return F.struct((percentile(score, by) / 100.0).alias("score_reliability"), F.lit(SOURCE_QUALITY).alias("source_quality"), F.lit(RECENCY).alias("recency"))


def rank_label(rank: Column) -> Column:
    return F.when(rank == 1, "best").when(rank <= 3, "top").when(rank <= 10, "relevant").otherwise("other")


def similar_rows(page_: DataFrame, id_col: str, score: str, threshold: float = 0.95) -> DataFrame:
    """Each row with up to five ids of rows whose score is within 1 - threshold, and whether one of them ranks before it. Pages are small by contract."""
    a, b = page_.alias("a"), page_.alias("b")
    near = F.col(f"a.{id_col}") != F.col(f"b.{id_col}")
    near = near & (F.abs(F.col(f"a.{score}") - F.col(f"b.{score}")) < 1 - threshold)
    pairs = a.join(b, near, "left").groupBy(F.col(f"a.{id_col}").alias(id_col))
    return pairs.agg(F.slice(F.sort_array(F.collect_list(F.col(f"b.{id_col}"))), 1, 5).alias("similar_ids"), F.coalesce(F.max(F.col("b.rank") < F.col("a.rank")), F.lit(False)).alias("is_duplicate"))


#: Rows of a page at most, by contract; pairs are compared within a page alone.
PAGE_AT_MOST = 50


def content_duplicates(pages: DataFrame, text_col: str = "text", vec_col: str = "embedding", least: float = 0.95, page_col: str = "query_id", rank_col: str = "rank") -> DataFrame:
    """pages with duplicate_of, the best rank of the same page whose content a row repeats, or null.

    Content repeats if the texts are equal in lower case with single spaces, or the vectors' cosine is at least `least`.
    A row without text or vector repeats by the other alone. Rows past PAGE_AT_MOST are no page's and stay as they are.
    """
    same = F.sha2(F.trim(F.regexp_replace(F.lower(text_col), r"\s+", " ")), 256)
    rows = pages.select(F.col(page_col).alias("page"), F.col(rank_col).alias("rank"), same.alias("hash"), F.col(vec_col).alias("vec")).where(F.col("rank") <= PAGE_AT_MOST)
    a, b = rows.alias("a"), rows.alias("b")
    near = (F.col("a.page") == F.col("b.page")) & (F.col("b.rank") < F.col("a.rank")) & (F.coalesce(F.col("a.hash") == F.col("b.hash"), F.lit(False)) | F.coalesce(1.0 - distance(F.col("a.vec"), F.col("b.vec")) >= least, F.lit(False)))
    first = a.join(b, near).groupBy(F.col("a.page").alias("__page"), F.col("a.rank").alias("__rank")).agg(F.min("b.rank").alias("duplicate_of"))
    return pages.join(first, (F.col(page_col) == F.col("__page")) & (F.col(rank_col) == F.col("__rank")), "left").select(*pages.columns, "duplicate_of")


def token_estimate(rows: Column, mode: str) -> Column:
    return rows * TOKENS[mode] + ENVELOPE


def percentile_int(score: Column, by: tuple[str, ...] = ()) -> Column:
    return percentile(score, by).cast("int")


def shorten_nested(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """shorten for columns and, at any depth, the fields of structs within them. Values are kept: structs are cast by place."""

    def renamed(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(names.get(f.name, f.name), renamed(f.dataType), f.nullable) for f in kind])
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(renamed(kind.elementType), kind.containsNull)
        if isinstance(kind, T.MapType):
            return T.MapType(kind.keyType, renamed(kind.valueType), kind.valueContainsNull)
        return kind

    return df.select(*[F.col(f"`{f.name}`").cast(renamed(f.dataType)).alias(names.get(f.name, f.name)) for f in df.schema])


def as_json(df: DataFrame) -> Column:
    """A row as a JSON object, dates in ISO form, null fields kept."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


@F.pandas_udf(T.StringType())
def three_places(x: pd.Series) -> pd.Series:
    """A number to three places by its exact value: 0.0075 lies below the middle and gives 0.007, where format_string rounds its shortest decimal form."""
    return x.map("{:.3f}".format)


def as_text(score: Column, with_metadata: bool = True) -> Column:
    """A result row for a reader: rank, score, origin, place and up to 200 characters of text, a line each."""
    text = F.col("chunk_text")
    lines = [F.format_string("Rank: %d", "rank"), F.concat(F.lit("Score: "), F.when(score.isNotNull(), three_places(score))), F.concat(F.lit("Source: "), "source_file"), F.concat(F.lit("Category: "), "source_category"), F.concat(F.lit("Context: "), "context_header"), F.format_string("Chunk: %d/%d", F.col("chunk_index") + 1, F.col("total_chunks")), F.lit(""), F.concat(F.lit("Text: "), snippet(text))]
    return F.concat_ws("\n", *lines, *([F.concat(F.lit("Metadata: "), "metadata")] if with_metadata else []))


def size_warning(size: Column, large: int = 20_000, excessive: int = 100_000) -> Column:
    """The code of the warning that a response of so many bytes earns, or null."""
    return F.when(size > excessive, "RESPONSE_SIZE_EXCESSIVE").when(size > large, "RESPONSE_SIZE_LARGE")


def envelope(page_: DataFrame, mode: str) -> DataFrame:
    """A page as one row: its results in order as JSON, their number, bytes, the estimate of tokens and a warning. For pages, which a limit bounds."""
    rows = page_.agg(F.sort_array(F.collect_list(F.struct("rank", as_json(page_).alias("row")))).alias("rows"))
    results = F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit("]"))
    out = rows.select(results.alias("results"), F.size("rows").alias("returned")).withColumn("bytes", F.octet_length("results"))
    return out.select("results", "returned", "bytes", token_estimate(F.col("returned"), mode).alias("tokens"), size_warning(F.col("bytes")).alias("warning"))
