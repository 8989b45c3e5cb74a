"""Personal data: four base patterns, then information-theoretic sanitisation, in DataFrame operations only.

A base match is a protected entity. A term discloses the entity to the extent that seeing the term tells that the
entity is in the text: with N texts, df(t) and df(e) that hold term and entity and co(t, e) that hold both, pointwise
mutual information ln(co N / (df(t) df(e))) as a share of the entity's information ln(N / df(e)). The share is 1
where the term occurs with the entity only. Terms above one threshold are removed, above a lower one generalised to
their shape.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, spread

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns, possessive and anchored at the start of a run where this changes no match but saves retries.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # Matches of fewer than 16 digits would fail, so the pattern asks for 16 at once.
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth a try.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
SPACE = r"[\x20\x09-\x0D]"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def running_sums(numbers: Column, part: int = 32) -> Column:
    """Sums of an array of integers up to each of them: within parts, on top of the parts before, so that no long array is copied for each number."""
    zero = lambda: F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        return F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"] + x)).alias("out"))

    count = F.ceil(F.size(numbers) / part).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.aggregate(F.slice(numbers, i * part + 1, F.lit(part)), zero(), step, lambda a: a["out"]))
    before = lambda p: F.aggregate(F.transform(p, lambda x: F.element_at(x, -1)), zero(), step, lambda a: F.concat(F.array(F.lit(0)), a["out"]))
    both = F.transform(F.array(parts), lambda p: F.flatten(F.zip_with(p, F.slice(before(p), F.lit(1), F.size(p)), lambda x, base: F.transform(x, lambda y: y + base))))
    return F.when(F.size(numbers) > 0, both[0]).otherwise(F.array().cast("array<int>"))


def located(text: Column, pattern: str, kind: str) -> Column:
    """All matches of a pattern as (kind, start, end, value) in code points: matches and the gaps between them tell the places."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.filter(F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("value"), (F.length(g) + F.length(m)).alias("size"))), lambda s: s["value"].isNotNull())

    def spans(s: Column) -> Column:
        ends = running_sums(F.transform(s, lambda x: x["size"]))
        return F.zip_with(s, ends, lambda x, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(x["value"])).alias("start"), e.alias("end"), x["value"].alias("value")))

    return F.transform(F.array(steps), spans)[0]


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def holds(kind: str, value: Column) -> Column:
    """Whether a match of the pattern is one of the kind."""
    if kind == "ip":
        return F.forall(F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "")), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(digits(value)).between(16, 19) & F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def kept(kind: str) -> Callable[[Column], Column]:
    return lambda s: holds(kind, s["value"])


def base(text: Column) -> Column:
    """All base spans of a text by kind, then start."""
    none = F.array().cast(SPAN)
    parts = []
    for kind in KINDS:
        hint = text.contains(HINTS[kind]) if HINTS[kind] else text.rlike(PATTERNS[kind])
        parts.append(F.when(hint, F.filter(located(text, PATTERNS[kind], kind), kept(kind))).otherwise(none))
    return F.concat(*parts)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Stands in a text for what a base pattern matches.
MASK = "\uffff"
#: The most frequent terms, whose hashes a broadcast may hold: they are spared a shuffle that would drop them.
FREQUENT = 10_000


def masked_terms(text: Column) -> Column:
    """The distinct words of a text in lower case, between ASCII white space, that no match of a base pattern touches."""
    for kind in KINDS:
        text = F.regexp_replace(text, PATTERNS[kind], MASK)
    return F.filter(F.array_distinct(F.split(F.lower(text), SPACE + "+")), lambda w: (w != "") & ~w.contains(MASK))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 2, generalise: float = 0.7, remove: float = 0.9) -> DataFrame:
    """(doc_id, key, n_email, n_ip, n_card, n_phone, base, terms) for every row of docs.

    base and terms are arrays of (kind, start, end, value) in code points, ends exclusive: base by kind, then start;
    terms of kinds generalise and remove, by kind, then start. A term is a word in lower case, between ASCII white
    space, that no match of a base pattern touches. It is marked wherever it stands in a text with an entity that it
    discloses to at least a threshold, known from at least `support` texts with both. An entity that all texts hold
    carries no information and is disclosed by nothing. All counts are of whole texts and cover all of them; rows equal
    in id and text are one text (key tells texts apart), repeated rows change no count. Null texts are empty. Null ids
    stay rows (all null ids with one text are one text). Long texts are read whole. Other columns of docs, of any
    name, are not read. An empty table gives no rows.

    A share of at least `generalise` asks for df(t) <= df(e)^g N^(1-g), as co is at most df(e); so other terms and
    pairs are left out before they are counted together, which changes no result. A text's pairs are its terms times
    the distinct sets of texts that its entities stand in, not times its entities.
    """
    spark = docs.sparkSession
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    rows = rows.withColumn("key", F.struct(F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("hash")))
    own = cut(rows.withColumn("base", base(F.col("text"))).select("doc_id", "key", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")))
    times = cut(own.groupBy("key").agg(F.count("*").alias("n")))
    total, rows_of_repeats = times.agg(F.count("*"), F.max("n")).first()
    total = float(total)

    # Texts with a count for each term; of rows that repeat a text all but one are taken off again.
    words = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), SPACE + "+")))
    counted = rows.select(words("text").alias("term"), F.lit(1).alias("n"))
    if (rows_of_repeats or 1) > 1:
        again = rows.join(times.where("n > 1"), "key").dropDuplicates(["key"])
        counted = counted.unionByName(again.select(words("text").alias("term"), (1 - F.col("n")).cast("int").alias("n")))
    spanned = own.where("size(base) > 0").dropDuplicates(["key"])
    entities = spanned.select("key", F.explode(F.array_distinct(F.transform("base", lambda b: F.concat_ws(":", b["kind"], F.lower(b["value"]))))).alias("entity"))
    # Entities of the same texts have the same shares, so they count as one: what tells sets of texts apart is two exclusive ors of hashes.
    sets = [F.bit_xor(F.xxhash64(F.lit(salt), "key")).cast("string") for salt in (1, 2)]
    known = cut(entities.groupBy("entity").agg(F.count("*").alias("df_e"), F.concat_ws(":", *sets).alias("set")).where((F.col("df_e") >= support) & (F.col("df_e") < total)))
    entities = entities.join(known, "entity").select("key", F.concat_ws(":", "set", "df_e").alias("entity"), "df_e").distinct()
    most = known.agg(F.max("df_e")).first()[0] or 0
    limit = lambda df_e: F.pow(df_e, F.lit(generalise)) * total ** (1 - generalise) + 1e-6
    all_terms = cut(counted.groupBy("term").agg(F.sum("n").alias("df_t")).where(F.col("df_t") >= support))
    rare = all_terms.where(F.col("df_t") <= limit(F.lit(float(most))))
    hot = all_terms.orderBy(F.desc("df_t"), "term").limit(FREQUENT).where(F.col("df_t") > limit(F.lit(float(most)))).select(F.xxhash64("term").alias("hash"))
    held = spanned.select("key", F.explode(masked_terms(F.col("text"))).alias("term"))
    held = held.join(F.broadcast(hot), F.xxhash64("term") == F.col("hash"), "left_anti").join(rare, "term")
    pairs = cut(held.join(entities, "key").where(F.col("df_t") <= limit(F.col("df_e"))))

    share = F.log(F.col("co") * total / (F.col("df_t").cast("double") * F.col("df_e"))) / F.log(total / F.col("df_e"))
    told = pairs.groupBy("entity", "term").agg(F.count("*").alias("co"), F.first("df_t").alias("df_t"), F.first("df_e").alias("df_e")).where(F.col("co") >= support)
    told = told.withColumn("share", share).where(F.col("share") >= generalise).select("entity", "term", "share")
    hits = pairs.join(told, ["entity", "term"]).groupBy("key", "term").agg(F.max("share").alias("share"))
    hits = hits.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("told"))  # a text's terms at most

    found = F.filter(located(F.col("text"), r"[^\x20\x09-\x0D]+", "term"), lambda w: F.map_contains_key("told", F.lower(w["value"])))
    free = F.filter(found, lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (b["end"] > w["start"])))
    kind = lambda w: F.when(F.element_at("told", F.lower(w["value"])) >= remove, "remove").otherwise("generalise")
    marked = F.array_sort(F.transform(free, lambda w: F.struct(kind(w).alias("kind"), w["start"].alias("start"), w["end"].alias("end"), w["value"].alias("value"))))
    terms = spanned.join(hits, "key").select("key", marked.alias("terms"))
    counts = [F.size(F.filter(F.col("base.kind"), (lambda name: lambda k: k == name)(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return own.drop("text").join(terms, "key", "left").select("doc_id", "key", *counts, "base", F.coalesce("terms", F.array().cast(SPAN)).alias("terms"))


def sanitised_texts(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): base spans become [KIND], removed terms go, generalised terms become their shape (Aa9 for letters and digits).

    found is sanitise()'s result on the same docs. Spans that overlap one that begins earlier are left to it. Null
    texts come out empty; every row of docs stays.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.struct(F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("hash")))
    spans = found.select("key", F.array_sort(F.transform(F.concat("base", "terms"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))).alias("spans")).dropDuplicates(["key"])
    shape = lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), r"[0-9]+", "9")
    cuts = "array<struct<from:int,start:int,kind:string,value:string>>"

    def step(a: Column, s: Column) -> Column:
        one = F.struct(a["at"].alias("from"), s["start"].alias("start"), s["kind"].alias("kind"), s["value"].alias("value"))
        return F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["cuts"], F.array(one)).alias("cuts"))).otherwise(a)

    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.array().cast(cuts).alias("cuts")), step)

    def stead(s: Column) -> Column:
        new = F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", shape(s["value"])).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.substring(F.col("text"), s["from"] + 1, s["start"] - s["from"]), new)

    joined_up = rows.join(spans, "key", "left").withColumn("done", done)
    text = F.concat(F.array_join(F.transform("done.cuts", stead), ""), F.substring(F.col("text"), F.col("done.at") + 1, F.length("text")))
    return joined_up.select("doc_id", F.when(F.size("spans") > 0, text).otherwise(F.col("text")).alias("text"))
