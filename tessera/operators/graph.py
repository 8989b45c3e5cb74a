"""Traversals of a property graph held as node, edge and mention DataFrames.

Predicates stand before joins, so that they reach the scans; join strategies are left to the planner, which
broadcasts the few edges of one entity by their measured size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import snippet


def bucket_name(column: str, buckets: int) -> str:
    """The column by which a stored table is cut for lookups by another: it says how."""
    return f"{column}_bucket_{buckets}"


def bucket_of(df: DataFrame, column: str) -> tuple[str, int] | None:
    found = [c for c in df.columns if c.startswith(f"{column}_bucket_")]
    return (found[0], int(found[0].rpartition("_")[2])) if found else None


def hashed(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def keyed(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows whose column has the value; of a stored table only that key's partition, and there the row groups that can hold it."""
    cut = bucket_of(df, column)
    rows = df if cut is None else df.where(F.col(cut[0]) == hashed(F.lit(value), cut[1]))
    return rows.where(F.col(column) == value)


def joined(few: DataFrame, many: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """few with the rows of many that share column. Of a stored table only the partitions of the keys in few are read, which the planner finds at run time."""
    cut = bucket_of(many, column)
    if cut is None:
        return few.join(many, column, how)
    return few.withColumn(cut[0], hashed(F.col(column), cut[1])).join(many, [cut[0], column], how).drop(cut[0])


#: Keys up to which a lookup of many is sent to all tasks.
KEYS_AT_MOST = 500_000


def narrowed(few: DataFrame, many: DataFrame, column: str) -> DataFrame:
    """The rows of many that can join few. Of a table that is not stored by key they are found where it is read, below what it is derived by: the keys of few are counted first and sent to all tasks."""
    if bucket_of(many, column) is not None:
        return many
    keys = few.select(column).distinct()
    return many.join(F.broadcast(keys), column, "left_semi") if keys.limit(KEYS_AT_MOST + 1).count() <= KEYS_AT_MOST else many


def strong(edges: DataFrame, least: float, types: Sequence[str] | None = None) -> DataFrame:
    rows = edges.where(F.col("confidence") >= least)
    return rows.where(F.col("relationship_type").isin(list(types))) if types else rows


def few_columns(nodes: DataFrame, *columns: str) -> DataFrame:
    """Nodes by id with some of their columns."""
    cut = bucket_of(nodes, "id")
    return nodes.select("id", *columns, *([cut[0]] if cut else []))


def one_hop(nodes: DataFrame, edges: DataFrame, start: str, least: float = 0.7, types: Sequence[str] | None = None, most: int = 50, target_types: Sequence[str] | None = None) -> DataFrame:
    """Outbound neighbours of an entity, strongest first."""
    out = keyed(strong(edges, least, types), "source", start).select(F.col("target").alias("id"), "relationship_type", F.col("confidence").alias("relationship_confidence"))
    ends = nodes if target_types is None else nodes.where(F.col("entity_type").isin(list(target_types)))
    return joined(out, ends, "id").orderBy(F.desc("relationship_confidence"), "id", "relationship_type").limit(most)


def two_hop(nodes: DataFrame, edges: DataFrame, start: str, least: float = 0.7, most: int = 100, distinct: bool = True, score: str = "root") -> DataFrame:
    """Paths of two edges that don't return to the start, a row for each path. score: root, sqrt(c1 c2), or product, c1 c2."""
    first = keyed(strong(edges, least), "source", start).select(F.col("target").alias("source"), F.col("relationship_type").alias("first_type"), F.col("confidence").alias("c1"))
    first = first.distinct() if distinct else first
    cut = bucket_of(edges, "source")
    second = strong(edges, least).where(F.col("target") != start).select("source", F.col("target").alias("id"), F.col("relationship_type").alias("second_type"), F.col("confidence").alias("c2"), *([cut[0]] if cut else []))
    product = F.col("c1") * F.col("c2")
    ends, own = few_columns(nodes, "text", "entity_type"), few_columns(nodes, "text").withColumnRenamed("text", "mid_text")
    middle = joined(joined(first, narrowed(first, second, "source"), "source").withColumnRenamed("id", "__end").withColumnRenamed("source", "id"), own, "id").withColumnRenamed("id", "mid_id").withColumnRenamed("__end", "id")
    paths = joined(middle, ends, "id")
    paths = paths.withColumn("path_confidence", F.sqrt(product) if score == "root" else product)
    return paths.orderBy(F.desc("path_confidence"), "id", "mid_id", "first_type", "second_type").limit(most)


def bidirectional(nodes: DataFrame, edges: DataFrame, start: str, least: float = 0.7, most: int = 50, by_target: DataFrame | None = None) -> DataFrame:
    """Entities reached out of or into an entity, with the sets of types each way. count is rows of the two-way join; edge_count the edges.

    by_target: the same edges, stored for lookups by target.
    """
    out = keyed(strong(edges, least), "source", start).select(F.col("target").alias("id"), F.col("relationship_type").alias("out_type"), F.col("confidence").alias("out_conf"))
    into = keyed(strong(edges if by_target is None else by_target, least), "target", start).select(F.col("source").alias("id"), F.col("relationship_type").alias("in_type"), F.col("confidence").alias("in_conf"))
    both = out.join(into, "id", "full_outer").groupBy("id").agg(
        F.sort_array(F.collect_set("out_type")).alias("outbound"), F.sort_array(F.collect_set("in_type")).alias("inbound"),
        F.greatest(F.coalesce(F.max("out_conf"), F.lit(0.0)), F.coalesce(F.max("in_conf"), F.lit(0.0))).alias("max_confidence"), F.count("*").alias("relationship_count"),
        (F.countDistinct("out_type") + F.countDistinct("in_type")).alias("edge_count"),
    )
    return joined(both, few_columns(nodes, "text", "entity_type"), "id").withColumn("min_distance", F.lit(1)).orderBy(F.desc("relationship_count"), F.desc("max_confidence"), "id").limit(most)


def entity_mentions(mentions: DataFrame, start: str, most: int = 100) -> DataFrame:
    """An entity's mentions, newest first."""
    rows = keyed(mentions, "entity_id", start).select("document_id", "chunk_id", "created_at", "line_key", F.lit(1.0).alias("confidence"), F.lit(0).alias("chunk_index"))
    return rows.orderBy(F.desc("created_at"), "document_id", "chunk_id", "line_key").limit(most)


def entities_by_document(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct entities of every document: (document_id, id and the node's columns)."""
    return mentions.select("document_id", F.col("entity_id").alias("id")).distinct().join(nodes, "id")


def co_mentioned(mentions: DataFrame, start: str, most: int = 100, by_document: DataFrame | None = None) -> DataFrame:
    """Entities in the same documents as the given one, by the number of distinct chunks. Only the documents of the start reach the join.

    by_document: the same mentions, stored for lookups by document.
    """
    here = keyed(mentions, "entity_id", start).select("document_id").distinct()
    others = (mentions if by_document is None else by_document).where(F.col("entity_id") != start)
    near = joined(here, narrowed(here, others, "document_id"), "document_id")
    counts = near.groupBy("entity_id").agg(F.countDistinct("document_id", "chunk_id").alias("co_mentions"))
    return counts.orderBy(F.desc("co_mentions"), "entity_id").limit(most)


def lookup(nodes: DataFrame, name: str, kind: str = "ORG") -> DataFrame:
    """Up to two entities of that name: none means not found, two ambiguous."""
    return nodes.where((F.lower("text") == name.lower()) & (F.col("entity_type") == kind)).orderBy(F.desc("confidence"), "id").limit(2)


def type_counts(rows: DataFrame, column: str) -> DataFrame:
    """The distribution of a column as one map, keys in order."""
    counts = rows.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("counts"))


def two_levels(nodes: DataFrame, edges: DataFrame, start: str, least: float = 0.7, most: int = 50, by_target: DataFrame | None = None) -> DataFrame:
    """Entities one or two edges away, edges read both ways: (id, text, entity_type, min_distance, paths, max_confidence).

    The confidence of two edges is the root of their product. An entity at distance 1 is not listed again at 2. Edges
    from the start are gathered first; the second level joins only the edges at their ends.
    """
    out, into = strong(edges, least), strong(edges if by_target is None else by_target, least)
    ends = lambda a, b, df: df.select(F.col(a).alias("a"), F.col(b).alias("b"), "confidence")
    first = ends("source", "target", keyed(out, "source", start)).unionByName(ends("target", "source", keyed(into, "target", start))).where(F.col("b") != start).select(F.col("b").alias("mid"), F.col("confidence").alias("c1"))

    def onward(a: str, b: str, df: DataFrame) -> DataFrame:
        mid, rows = first.withColumnRenamed("mid", a), df.where((F.col(a) != start) & (F.col(b) != start))
        return joined(mid, narrowed(mid, rows, a), a).select(F.col(b).alias("id"), "c1", "confidence")

    both = onward("source", "target", out).unionByName(onward("target", "source", into))
    second = both.select("id", F.lit(2).alias("d"), F.sqrt(F.col("c1") * F.col("confidence")).alias("c"))
    reached = first.select(F.col("mid").alias("id"), F.lit(1).alias("d"), F.col("c1").alias("c")).unionByName(second)
    at = reached.groupBy("id").agg(F.min("d").alias("min_distance"), F.struct(*[F.struct(F.count_if(F.col("d") == n).alias("paths"), F.max(F.when(F.col("d") == n, F.col("c"))).alias("max_confidence")).alias(f"d{n}") for n in (1, 2)]).alias("by"))
    own = F.when(F.col("min_distance") == 1, F.col("by.d1")).otherwise(F.col("by.d2"))
    found = at.select("id", "min_distance", own["paths"].alias("paths"), own["max_confidence"].alias("max_confidence"))
    return joined(found, few_columns(nodes, "text", "entity_type"), "id").orderBy("min_distance", F.desc("paths"), F.desc(F.round("max_confidence", 12)), "id").limit(most)


def chunk_mentions(bridge: DataFrame, chunks: DataFrame, entity: str, most: int = 100) -> DataFrame:
    """The chunks that mention an entity, through the bridge (entity_id, chunk_id, confidence), surest and newest first.

    The bridge is cut to the entity before it meets the chunks; how it is joined the planner decides by size.
    """
    own = bridge.where(F.col("entity_id") == entity).select("chunk_id", F.col("confidence").alias("mention_confidence"))
    return own.join(chunks, "chunk_id").orderBy(F.desc("mention_confidence"), F.desc("created_at"), "chunk_id").limit(most)


#: Entities that each mode of vendor_info lists.
VENDOR_LIMITS = {"ids_only": 0, "metadata": 0, "preview": 5, "full": 100}


def vendor_info(nodes: DataFrame, edges: DataFrame, name: str, mode: str = "metadata", fields: list[str] | None = None) -> DataFrame:
    """One row on a vendor: name, status (found, not_found, ambiguous) and what the mode shows.

    ids_only: entity_ids, the vendor's own. metadata: statistics. preview: also the 5 surest neighbours as entities and
    relationships. full: 100 of them, with snippets and the relationships' confidence. Statistics count the neighbours
    and types over all outbound edges. Null where the name is not found or is that of more than one vendor.
    """
    if mode not in VENDOR_LIMITS:
        raise ValueError(f"mode must be one of {tuple(VENDOR_LIMITS)}")
    named_ = lookup(nodes, name).agg(F.count("*").alias("n"), F.min(F.struct("id", "text")).alias("v"))
    status = F.when(F.col("n") == 0, "not_found").when(F.col("n") > 1, "ambiguous").otherwise("found")
    head = named_.select(F.lit(name).alias("vendor_name"), status.alias("status"), F.when(F.col("n") == 1, F.col("v.id")).alias("vendor_id"))
    out = head.withColumn("entity_ids", F.when(F.col("vendor_id").isNotNull(), F.array("vendor_id")))
    if mode != "ids_only":
        asked = head.where("vendor_id is not null").select(F.col("vendor_id").alias("source"))
        own = joined(F.broadcast(asked), narrowed(asked, edges, "source"), "source").select("source", F.col("target").alias("id"), "relationship_type", F.col("confidence").alias("relationship_confidence"))
        near = joined(own, few_columns(nodes, "text", "entity_type", "confidence"), "id")
        tally = lambda c: near.groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias(f"{c}s"), F.coalesce(F.sum("n"), F.lit(0)).alias(f"n_{c}"))
        stats = tally("entity_type").join(F.broadcast(tally("relationship_type")))
        out = out.join(F.broadcast(stats.select(F.struct(F.col("n_entity_type").alias("entity_count"), F.col("n_relationship_type").alias("relationship_count"), F.col("entity_types").alias("entity_types"), F.col("relationship_types")).alias("statistics"))))
    if VENDOR_LIMITS[mode]:
        first = near.orderBy(F.desc("relationship_confidence"), "id", "relationship_type").limit(VENDOR_LIMITS[mode])
        full = mode == "full"
        entity = [F.col("id").alias("entity_id"), F.col("text").alias("name"), "entity_type", "confidence"] + ([snippet(F.col("text")).alias("snippet")] if full else [])
        relation = [F.col("source").alias("source_id"), F.col("id").alias("target_id"), "relationship_type"] + ([F.col("relationship_confidence").alias("confidence")] if full else [])
        order = [(-F.col("relationship_confidence")).alias("__o"), F.col("id").alias("__i"), F.col("relationship_type").alias("__t")]
        listed = first.agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*entity).alias("e"), F.struct(*relation).alias("r")))).alias("l"))
        out = out.join(F.broadcast(listed.select(F.transform("l", lambda x: x["e"]).alias("entities"), F.transform("l", lambda x: x["r"]).alias("relationships"))))
    out = out.drop("vendor_id")
    for c in set(out.columns) - {"vendor_name", "status"}:
        out = out.withColumn(c, F.when(F.col("status") == "found", F.col(c)))
    return out.select("vendor_name", "status", *fields) if fields else out
