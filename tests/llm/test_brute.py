"""Operators against plain versions of what they compute, and run() against all stages done plainly."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, line_dedup, mixing, pieces, pii, pivot_search, queries, secrets, simhash, toxicity, urls
from tests.llm.test_copies import groups_of
from tests.llm.test_llm import P, exact, real

D, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(spark, d):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}


# Vector searches.
def ordered(rows, number=float):
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, number(r.score)))
    return got


def plain_product(x, y):
    total = 0.0  # sum() would compensate for rounding
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        total += a * b
    return total


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)], "vec_id long, embedding array<double>").repartition(3)


def test_equal_vectors_tie_by_id_in_any_block(spark):
    x = np.random.default_rng(4).normal(size=(3000, 16))
    x[:2900] = x[0]
    got = ordered(ann.search(frame(spark, x), F.col("vec_id") % 500 == 0, k=5, block_rows=97).collect())
    for q in (0, 500, 1000, 1500, 2000, 2500):
        want = plain_product(x[q], x[0])
        assert got[q] == [(i, want) for i in [j for j in range(7) if j != q][:5]]


def test_lengths_are_searched_apart(spark):
    rng = np.random.default_rng(5)
    x, odd = rng.normal(size=(300, 8)), rng.normal(size=(3, 5))
    df = frame(spark, x, range(10, 310)).union(frame(spark, odd, [0, 1, 2])).withColumn("score", F.lit("x")).withColumn("list", F.lit(1))
    df = df.union(spark.createDataFrame([(400, None, "x", 1), (401, [0.0] * 8, "x", 1), (402, [float("inf")] * 8, "x", 1), (None, [1.0] * 8, "x", 1), (403, [], "x", 1), (404, [1e200] * 4, "x", 1), (405, [1e200] * 4, "x", 1)], df.schema))
    for found, scale in ((ann.search(df, F.col("vec_id") % 10 == 0, k=4), None), (pivot_search.search(df, F.col("vec_id") % 10 == 0, k=4, block_rows=16), 256)):
        got = ordered(found.collect())
        assert {i for i, _ in got[0]} == {1, 2} and len(got[10]) == 4
        y = x if scale is None else np.floor(scale * x)
        want = exact(np.vstack([y, np.zeros((1, 8))]) if scale else y, list(range(0, 300, 10)), 4)
        hits = [[i - 10 if i < 400 else 300 for i, _ in got[q + 10]] for q in want]
        assert np.mean([len(set(a) & {i for i, _ in want[q]}) / 4 for a, q in zip(hits, want, strict=True)]) >= (0.9 if scale is None else 1.0)


def test_repeated_ids_count_once(spark):
    x = np.random.default_rng(6).normal(size=(200, 8))
    ids = [7] * 100 + list(range(100, 200))
    for f in (lambda d: ann.search(d, F.col("vec_id") == 100, k=20), lambda d: pivot_search.search(d, F.col("vec_id") == 100, k=20, block_rows=16)):
        got = [r.vec_id for r in f(frame(spark, x, ids)).orderBy("rank").collect()]
        assert len(got) == len(set(got)) == 20


def test_ann_recall_as_registered(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    e = df.toPandas().sort_values("vec_id")
    x = np.stack(e.embedding).astype(float)
    want = exact(x, list(range(0, len(x), 20)), 20)
    got = ordered(queries.op1_ann(spark, "/root/testdata/sf0.1").collect())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / 20 for q, w in want.items()]) >= 0.9
    assert all(s == plain_product(x[q], x[i]) for q in list(got)[:20] for i, s in got[q])


def test_lists_are_balanced_and_bounded(spark):
    x = np.random.default_rng(8).normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = ann.CentroidGraph(*ann.balanced_lists(x, ann.balanced_centroids(x, 32)))
    assert np.bincount(graph.stored(x, 1, 0.1)[:, 0], minlength=32).max() <= 2 * 4000 / 32
    row, found = graph.probed(x[:50], 0.2, least=1)
    far = np.linalg.norm(x[:50, None] - graph.at[None], axis=2)
    want = far <= 1.2 * far.min(axis=1, keepdims=True)
    assert np.mean([want[i, j] for i, j in zip(row, found, strict=True)]) > 0.99 and len(row) >= 0.97 * want.sum()


@pytest.mark.parametrize("clustered", [False, True])
def test_pivots_are_exact_and_stop(spark, clustered):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 12))
    if clustered:
        x = np.repeat(rng.normal(size=(15, 12)) * 10, 200, axis=0) + 0.1 * x
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    stats = []
    got = ordered(pivot_search.search(frame(spark, x), F.col("vec_id") % 50 == 0, pivots=12, block_rows=32, stats=stats).collect())
    assert got == exact(np.floor(256 * x), list(range(0, 3000, 50)), 5)
    if clustered:  # many annuli lie too far to be read
        assert sum(n for n, _ in stats) < 0.6 * stats[0][1]


# Pieces.
def test_samples_follow_the_lattice():
    v = pieces.Vocabulary.load(pieces.MODEL)
    weight = {p.decode(): w for i, (p, w) in enumerate(zip(v.decoded, v.weights, strict=True)) if np.isfinite(w) and i not in v.byte_ids}
    unit, ways = " then", Counter()

    def split(at, parts):
        if at == len(unit):
            ways[tuple(parts)] = math.exp(sum(weight[p] for p in parts))
        for end in range(at + 1, len(unit) + 1):
            if unit[at:end] in weight:
                split(end, [*parts, unit[at:end]])

    split(0, [])
    n = 20_000
    got = Counter(tuple(v.decoded[i].decode() for i in p) for p in pieces.encode(["then"] * n, np.arange(n, dtype=np.uint64) << np.uint64(20), v))
    total = sum(ways.values())
    assert set(got) <= set(ways)
    for parts, w in ways.items():
        assert abs(got[parts] / n - w / total) < 5 * math.sqrt(w / total / n) + 1e-3


def test_kept_lattices_change_nothing():
    v = pieces.Vocabulary.load(pieces.MODEL)
    texts = ["one two  three", "two three four é👍", "x" * 2000 + " one", None, ""]
    seeds, known = np.arange(5, dtype=np.uint64), pieces.Known()
    pieces.encode(["two four zebra"], seeds[:1], v, known)
    for a, b in zip(pieces.encode(texts, seeds, v), pieces.encode(texts, seeds, v, known), strict=True):
        assert (a == b).all()


# Personal data.
def disclosing(rows, generalise=0.7, remove=0.9):
    """{(id, text): [(kind, start, end)]} of the terms, by counting everything."""
    texts, info = sorted(set(rows), key=repr), []
    for _, t in texts:
        t = t or ""
        touch = [(k, m.start(), m.end()) for k in P for m in re.finditer(P[k], t) if k != "card" or len(re.sub("[^0-9]", "", m[0])) > 15]
        base = [x for x in touch if real(x[0], t[x[1] : x[2]])]
        words = [(m.start(), m.end(), m[0].lower()) for m in WORDS.finditer(t)]
        info.append((base, {f"{k}:{t[a:b].lower()}" for k, a, b in base}, words, {w for a, b, w in words if not any(x[1] < b and x[2] > a for x in touch)}))
    n, dft, dfe = len(texts), Counter(), Counter()
    co = Counter()
    for _, entities, words, terms in info:
        dft.update({w for _, _, w in words})
        dfe.update(entities)
        co.update((e, w) for e in entities for w in terms)
    share = {(e, w): math.log(c * n / (dft[w] * dfe[e])) / math.log(n / dfe[e]) for (e, w), c in co.items() if c >= 2 and dfe[e] < n}
    out = {}
    for row, (base, entities, words, terms) in zip(texts, info, strict=True):
        most = {w: max((share.get((e, w), -1.0) for e in entities), default=-1.0) for w in terms}
        out[row] = sorted(("remove" if most[w] >= remove else "generalise", a, b) for a, b, w in words if most.get(w, -1.0) >= generalise and not any(x[1] < b and x[2] > a for x in base))
    return out


def test_terms_that_disclose(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    want = disclosing([tuple(r) for r in docs.collect()])
    texts = dict(docs.collect())
    got = {(r.doc_id, texts[r.doc_id]): [(x.kind, x.start, x.end) for x in r.terms] for r in pii.sanitise(docs).select("doc_id", "terms").collect()}
    assert got == want and sum(map(len, want.values())) > 100


def test_many_entities_and_terms_of_two_texts(spark):
    """10,000 addresses and 10,000 words in two texts: time grows with them, not with their pairs."""
    text = " ".join(f"u{i}@example.org w{i}" for i in range(10_000))
    docs = spark.createDataFrame([(i, text + f" own{i}" if i < 2 else f"quiet text {i} w{i}") for i in range(12)], "doc_id long, text string")
    began = time.monotonic()
    found = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert time.monotonic() - began < 120
    third = {f"w{k}" for k in range(2, 12)}  # words that one quiet text holds as well disclose less
    for doc in (0, 1):
        assert {s.value for s in found[doc].terms if s.kind == "remove"} >= {f"w{k}" for k in range(12, 10_000)}
        assert not {s.value for s in found[doc].terms if s.kind == "remove"} & third
    assert all(not found[doc].terms for doc in range(2, 12))


def test_terms_on_odd_tables(spark):
    far = "Zorbin " + "word " * 400 + "reach me at a@b.com"
    rows = [(1, far), (2, far.replace("word", "term")), (3, "nothing"), (4, None), (None, "a@b.com here"), (5, "nothing else")]
    results = []
    for times in (1, 7):
        df = spark.createDataFrame(rows * times, "doc_id long, text string").withColumn("terms", F.lit(1)).withColumn("key", F.lit(2)).repartition(5)
        found = pii.sanitise(df)
        assert found.count() == len(rows) * times
        results.append({(r.doc_id, tuple((x.kind, x.start, x.end) for x in r.terms)) for r in found.collect()})
        assert results[-1] == {(i, tuple(v)) for (i, _), v in disclosing(rows).items()}
    assert results[0] == results[1] and any(x[1] for x in results[0])  # far from the entity, and whatever the repeats
    every = spark.createDataFrame([(1, "a@b.com is known"), (2, "a@b.com is known")], "doc_id long, text string")
    assert [r.terms for r in pii.sanitise(every).collect()] == [[], []]  # an entity in every text tells nothing
    clean = {r.doc_id: r.text for r in pii.sanitised_texts(every, pii.sanitise(every)).collect()}
    assert clean == {1: "[EMAIL] is known", 2: "[EMAIL] is known"}
    assert pii.sanitise(every.where("false")).count() == 0


# Fingerprints.
def test_fingerprint_bits():
    for text in ("a b c d e f A B C", "x", "one two", "é é é ü", ""):
        w = text.lower().split()
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(text) == want


# Urls.
def test_url_model(spark):
    scored = urls.held_out()
    assert urls.accuracy(scored) == np.mean([(p >= 0.6) == bool(label) for p, label in scored]) >= 0.9
    assert len(urls.LABELLED) == 324 == len({u for u, _ in urls.LABELLED}) and not any(x in u for u, _ in urls.LABELLED for x in ("therha", "ththin", "tiontion"))
    weights = urls.train()
    for r in urls.judge(spark.read.parquet(f"{SMALL}/pages.parquet")).collect():
        at = {zlib.crc32(g) % 2**16 for mark, t in ((b"h", r.host), (b"p", r.path)) for s in [b"^" + t.encode() + b"$"] for n in (3, 4, 5) for i in range(len(s) - n + 1) for g in [mark + s[i : i + n]]}
        margin = weights[-1] + sum(weights[i] for i in at) / max(1, len(at)) ** 0.5
        assert abs(1 / (1 + math.exp(-margin)) - r.score) < 1e-5
        fits = [(len(h + p), v, h + p) for v, h, p in urls.RULES if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == ((max(fits)[2], max(fits)[1]) if fits else (None, "block" if r.score >= 0.6 else "allow"))


# Lines.
def plain_units(text):
    return [u for line in re.split(r"(?<=\n)", text) for u in re.split(r"(?<=[.?!] )", line)]


def plain_gone(sequences, least):
    """Numbers to delete from each sequence of (number, key, words), in the order of the sequences."""
    first, found, gone = {}, [], defaultdict(set)
    for d, seq in enumerate(sequences):
        for a in range(len(seq)):
            for b in range(a + 1, len(seq) + 1):
                if seq[b - 1][0] != seq[a][0] + b - 1 - a:
                    break
                if sum(x[2] for x in seq[a:b]) >= least:
                    found.append((d, a, b))
                    first.setdefault(tuple(x[1] for x in seq[a:b]), (d, a))
                    if sum(x[2] for x in seq[a + 1 : b]) >= least:  # longer ones are covered by those of later units
                        break
    for d, a, b in found:
        fd, fa = first[tuple(x[1] for x in sequences[d][a:b])]
        if (fd, fa) != (d, a):
            low = max(a, fa + b - a) if fd == d else a
            gone[d].update(sequences[d][i][0] for i in range(low, b))
    return gone


def plain_dedup(texts, least=30):
    """{id: text}, by runs of whole lines, then of units in what is left."""
    ids = sorted(texts)
    lines = [[x for x in (texts[i] or "").split("\n") if x.split()] for i in ids]
    gone_lines = plain_gone([[(k, x.strip(), len(x.split())) for k, x in enumerate(ls)] for ls in lines], least)
    sequences = []
    for d, i in enumerate(ids):
        seq, line, n, held = [], 0, 0, False
        for u in plain_units(texts[i] or ""):
            if u.split():
                if line not in gone_lines[d]:
                    seq.append((n, u.strip(), len(u.split())))
                n, held = n + 1, True
            if u.endswith("\n"):
                line, held = line + held, False
        sequences.append(seq)
    gone_units = plain_gone(sequences, least)
    out = {}
    for d, i in enumerate(ids):
        out[i] = None if texts[i] is None else line_dedup.rest_of(texts[i], sorted(gone_lines[d]), sorted(gone_units[d]), False, least)[0]
    return out


def test_opening_runs_miss_no_repeated_run():
    rng = np.random.default_rng(5)
    for _ in range(40):
        each, seq = np.sort(rng.integers(0, 4, 60)), np.cumsum(1 + (rng.random(60) < 0.1)).astype(np.int32)
        digest = rng.integers(0, 3, 60) * 7919 + 5
        words = digest % 7 + 1  # equal units have equal words
        at, run = line_dedup.openings(each, seq, words, digest, 12)
        hits = {int(h) for h, n in zip(*np.unique(run, return_counts=True), strict=True) if n > 1}
        kept = line_dedup.reached(each, seq, words, at[[int(h) in hits for h in run]], 12)
        first, size = line_dedup.windows(each, seq, words, 12)
        runs = defaultdict(list)
        for f, n in zip(first, size, strict=True):
            runs[tuple(digest[f : f + n])].append((f, n))
        assert all(kept[f : f + n].all() for found in runs.values() if len(found) > 1 for f, n in found)


def test_lines_of_the_corpus(spark):
    got = {r.doc_id: r.text for r in line_dedup.without_repeats(spark.read.parquet(f"{D}/documents.parquet")).collect()}
    assert got == plain_dedup(texts_of(spark, D))


def test_passages_within_lines(spark):
    passage = " ".join(f"This is sentence {w} of a passage that two texts share in the midst of their lines." for w in ("one", "two", "three", "four"))
    texts = {1: f"Begin one. {passage} The end one.\nMore", 2: "Other. Text?\n\n", 3: f"Hello and {passage} Then it goes on", 4: None, 5: "", 6: f"Own line!\n{passage}\nLast."}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("gone", F.lit("x"))
    got = {r.doc_id: r.text for r in line_dedup.without_repeats(df).collect()}
    assert got == plain_dedup(texts)
    assert got[1] == texts[1] and got[6] == "Own line!\nLast." and got[3] == "Hello and This is sentence one of a passage that two texts share in the midst of their lines. Then it goes on"


def test_units_join_to_the_text():
    for text in ("a. b? c!\n\n d.  e\n", "", "\n", "x", "...! ? \n.", "é. ü"):
        assert b"".join(line_dedup.units(text)).decode() == text
        assert line_dedup.rest_of(text, [], [], False, 30)[0] == text


def test_whole_copies_and_hot_lines(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(i, long) for i in range(300)] + [(None, long), (None, long)] + [(1000 + i, f"short {i}\n{long} x\nend {i}") for i in range(50)] + [(2000 + i, "few words") for i in range(20)]
    got = line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == len(rows)
    assert [r.doc_id for r in got if r.text == long] == [0] and sum(r.text == "" for r in got) == 301
    assert {r.doc_id for r in got if long in r.text} == {0, 1000} and sum(r.text == "few words" for r in got) == 20


# Secrets.
def test_base_spans_of_the_corpus(spark):
    kinds = {"assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    texts = texts_of(spark, D)
    for r in secrets.scan(spark.read.parquet(f"{D}/documents.parquet")).collect():
        spans = [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, texts[r.doc_id] or "", re.ASCII) if (len(m[2]) >= 8 if k == "assign" else len(m[0]) >= (16 if k == "access" else 32))]
        spans.sort(key=lambda s: (s[1], list(kinds).index(s[0])))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(",")) | {""}


def test_lexer():
    held = lambda t: [t[a:b] for a, b in secrets.pairs(t)]
    assert held('x = "Zx9Qw7Lk2Pf8"\napi_secret = x') == ["Zx9Qw7Lk2Pf8"]
    assert held("key1='Zx9Qw7'; key2 = 'Lk2Pf8'\nauth_token = key1 + key2") == ["Zx9Qw7", "Lk2Pf8"]
    assert held('password = "a\\"B3xQ9z+7"') == ['a\\"B3xQ9z+7']
    assert held('token: str = """aB3x\nQ9zz7Lk"""') == ["aB3x\nQ9zz7Lk"]
    assert held("# db_password: Zx9Qw7Lk2Pf8\n") == ["Zx9Qw7Lk2Pf8"]
    assert held('token = os.getenv("TOKEN_OF_SERVICE9")') == [] and held("colour = Zx9Qw7Lk2Pf8") == [] and held("password = changeme") == []


def test_lexer_takes_linear_time():
    for text in ("token=" * 170_000, 'token = "abc9X" + token\n' * 40_000, "a=" * 500_000, 'token="\\"' * 100_000, "a" * 10**6 + "=", "a=\"b='c=\"d='" * 80_000):
        begin = time.time()
        secrets.pairs(text), secrets.base_spans(text)
        assert time.time() - begin < 15


# Toxicity.
def test_values_that_grow_without_end():
    for start in ("abc9XYZ!q", "aaaa", "ab"):
        doubled = f"secret = '{start}'\n" + "secret = secret + secret\n" * 5000
        assert len(secrets.pairs(doubled)) == (start != "aaaa")
    began = time.process_time()
    grown = "token = 'x'\n" + "".join(f"token = token + '{chr(0x4E00 + i)}'\n" for i in range(15_000))
    assert len(secrets.pairs(grown)) == 15_001
    assert time.process_time() - began < 5


def test_strength_against_plain_counts():
    r = random.Random(8)
    for _ in range(300):
        parts = ["".join(r.choice("aab1Z- " if r.random() < 0.2 else "aab1Z-x") for _ in range(r.randrange(9))) for _ in range(r.randrange(1, 6))]
        value, text = secrets.Value(), "".join(parts)
        for p in parts:
            one = secrets.Value()
            one.literal(p, 0, len(p))
            value.take(one)
        counts, n = Counter(text), len(text)
        bits = -sum(k * math.log2(k / n) for k in counts.values())
        kinds = len({"a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-" for c in text})
        want = 0.0 if n < 6 or " " in text else min(1.0, bits / 40) * (0.6 + 0.2 * min(2, kinds - 1))
        assert abs(value.strength() - want) < 1e-9 or value.dummy


def test_ftrl_against_plain_dictionaries():
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 50, rng.integers(1, 12))), int(rng.random() < 0.3)) for _ in range(200)]
    got, bias = toxicity.ftrl(rows)
    l1 = 6.0 * (200 / 8000) ** 0.5
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        strong = 0.0 if i == "bias" else l1
        return 0.0 if abs(z[i]) <= strong else -(z[i] - math.copysign(strong, z[i])) / ((1.0 + math.sqrt(n[i])) / 2.0 + 0.1)

    for _ in range(3):
        for at, label in rows:
            x = 1.0 / max(1.0, len(at)) ** 0.15
            held = {i: weight(i) for i in [*at.tolist(), "bias"]}
            margin = sum(w * (1 if i == "bias" else x) for i, w in held.items())
            error = (1 / (1 + math.exp(-margin)) - label) * (8.0 if label else 1.0)
            for i, w in held.items():
                g = error * (1 if i == "bias" else x)
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 2.0
                z[i] += g - sigma * w
                n[i] += g * g
    assert abs(bias - weight("bias")) < 1e-9 and all(abs(got[i] - weight(i)) < 1e-5 for i in range(50))


def test_repeated_ids_train_once(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    hot = docs.where("doc_id = 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3000))).alias("n"), "text").select("doc_id", "text")
    a, b = toxicity.train(docs, labels), toxicity.train(docs.union(hot), labels)
    assert (a.weights == b.weights).all() and a.bias == b.bias
    import pickle

    again = pickle.loads(pickle.dumps(a))
    assert (again.weights == a.weights).all() and len(pickle.dumps(a)) < 12 * np.count_nonzero(a.weights) + 4096


# The pipeline.
def test_mix_takes_rows(spark):
    rows = [(5, f"text {i} " + "w " * (i % 9), "a", i) for i in range(40)] + [(None, f"none {i} x y", "b", i) for i in range(40)] + [(7, "same text here", "b", 0)] * 6
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    want = Counter()
    total = mixing.mix(docs, key=F.xxhash64("text", "n")).where("copies > 0").groupBy("key").agg(F.sum("copies").alias("n")).collect()
    keys = {r.k: (r.doc_id, r.text) for r in docs.select(F.xxhash64("text", "n").alias("k"), "doc_id", "text").collect()}
    for r in total:
        want[keys[r.key]] += r.n
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.mix_sources(spark, docs, D).collect()) == want


def test_run_against_plain_stages(spark, tmp_path):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.train(table, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = {r.doc_id: r.asDict() for r in table.collect()}
    for i in [i for i, r in rows.items() if model.score(r["text"], toxicity.WordHash()) >= 0.7]:
        del rows[i]
    for i, text in plain_dedup({i: r["text"] for i, r in rows.items()}).items():
        had = rows[i]["text"] or ""
        rows[i]["text"] = text
        if had.split() and not text.split():
            del rows[i]
    ids = sorted(rows)
    part = groups_of([rows[i]["text"] for i in ids])
    rows = {i: rows[i] for k, i in enumerate(ids) if part[k] == k}
    rest = spark.createDataFrame([(i, r["text"], r["source"]) for i, r in rows.items()], "doc_id long, text string, source string").toPandas()  # noqa: F841
    taken = duckdb.sql(mixing.MIX_SQL.format(docs="rest")).df()
    want = Counter()
    for r in taken.itertuples():
        size = len(WORDS.findall(rows[r.doc_id]["text"] or ""))
        if size:
            want[r.doc_id, rows[r.doc_id]["text"]] += r.taken // size
    v = pieces.Vocabulary.load(pieces.MODEL)
    got = Counter((r.doc_id, pieces.decode(np.array(r.pieces, np.int64), v)) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert {k: n for k, n in got.items() if WORDS.search(k[1])} == {k: n for k, n in want.items() if n}
