"""URL filter: a rule list first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, ascii_lower, spread

#: Fixed values: (verdict, host, path). A rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Words of hosts and paths to block, and of harmless ones.
UNWANTED = "spam linkfarm clickbait pills pharmacy viagra meds casino poker jackpot betting lottery slots adult xxx porn cams escort loans payday credit replica rolex torrent warez keygen crack serial phish malware trojan scam prize winner doubletrack popads".split()
HARMLESS = (
    "wiki library museum university school science physics history geography music garden recipes bread weather city council travel maps health hospital news economy sports football chess cinema theatre poetry "
    "novel grammar language dictionary forum blog docs manual tutorial software data tables archive atlas birds forest river mountain ocean climate energy solar railway bridge castle cathedral market farming cheese "
    "coffee kitchen furniture painting sculpture photography astronomy planets chemistry biology medicine nursing algebra geometry statistics"
).split()


def labelled_urls(per_word: int = 3) -> tuple[tuple[str, int], ...]:
    """The labelled table that the model is trained on, by a rule: 1 marks a url to block.

    Each word stands in `per_word` urls, beside another word of its kind. Both kinds get the same schemes, domains,
    numbers and places, so the words alone tell them apart, and of urls without any of them the more harmless ones decide.
    """
    ends, tongues, out = ("example.org", "example.net", "info", "biz", "com"), ("en", "de", "es", "fr"), []
    for label, words in ((1, UNWANTED), (0, HARMLESS)):
        for i, word in enumerate(words):
            for k in range(per_word):
                n, other = i * per_word + k, words[(i + 7 * k + 1) % len(words)]
                host = (f"{word}.{ends[n % 5]}", f"www.{other}-{word}.{ends[(n + 1) % 5]}", f"m.{word}{n % 90 + 10}.{ends[(n + 2) % 5]}")[k % 3]
                path = (f"/{tongues[n % 4]}/{n * 7 % 900}", f"/{word}/{n * 11 % 500}.html", f"/{tongues[n % 4]}/{other}")[k % 3]
                out.append((f"http{'s' * (n % 2)}://{host}{path}", label))
    return tuple(out)


LABELLED = labelled_urls()

BITS = 16
#: A url is blocked from this score on: without evidence it passes.
THRESHOLD = 0.6


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or holds no ://."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return ascii_lower(host), path


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (like net/es/) and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last to fit is the longest
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def features(host: str, path: str, low: int = 3, high: int = 5) -> np.ndarray:
    """Places of a url's character n-grams in the weights: each of host and path framed by marks, n from low to high."""
    grams = {mark + text[i : i + n] for mark, text in ((b"h", b"^" + host.encode() + b"$"), (b"p", b"^" + path.encode() + b"$")) for n in range(low, high + 1) for i in range(len(text) - n + 1)}
    return np.unique(np.fromiter((zlib.crc32(g) & (2**BITS - 1) for g in grams), np.int64, len(grams)))


def probability(weights: np.ndarray, at: np.ndarray) -> float:
    """Each url's features weigh 1 / sqrt(their number), so that long urls don't score higher for their length."""
    return float(1.0 / (1.0 + np.exp(-(weights[-1] + weights[at].sum() / max(1, len(at)) ** 0.5))))


def parts_of(url: str) -> tuple[str, str]:
    """Host and path of a labelled url, as url_parts() has them."""
    rest = url.split("://", 1)[1]
    cut = min([len(rest), *(rest.index(c) for c in "/?#" if c in rest)])
    return rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]


def train(labelled: tuple[tuple[str, int], ...] = LABELLED, rounds: int = 300, rate: float = 6.0, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last one is the bias) by gradient descent over the labelled table, which is small by contract. Both labels count alike, however many rows each has."""
    found = [features(*parts_of(url)) for url, _ in labelled]
    label = np.array([y for _, y in labelled], float)
    row, at = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(found))))
    share = np.where(label == 1, 1 / max(1, label.sum()), 1 / max(1, (1 - label).sum())) / 2
    weights = np.zeros(2**BITS + 1)
    for _ in range(rounds):
        margin = weights[-1] + np.bincount(row, weights[at], len(found)) * scale
        error = (1 / (1 + np.exp(-margin)) - label) * share
        weights *= 1 - rate * decay
        weights[:-1] -= 4 * rate * np.bincount(at, (error * scale)[row], 2**BITS)
        weights[-1] -= 4 * rate * error.sum()
    return weights


def held_out(labelled: tuple[tuple[str, int], ...] = LABELLED, folds: int = 8) -> list[tuple[float, int]]:
    """(score, label) of each labelled url by a model that was trained without its fold."""
    out = []
    for fold in range(folds):
        weights = train(tuple(row for i, row in enumerate(labelled) if i % folds != fold))
        out += [(probability(weights, features(*parts_of(url))), label) for i, (url, label) in enumerate(labelled) if i % folds == fold]
    return out


def accuracy(scored: list[tuple[float, int]], threshold: float = THRESHOLD) -> float:
    """The share of (score, label) rows on the right side of the threshold."""
    return sum((score >= threshold) == bool(label) for score, label in scored) / len(scored)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, weights: np.ndarray | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of pages.

    The longest fitting rule decides; where none fits, the model does: block if its score is at least the
    threshold. score is the model's for every row. A url that is null, empty or without :// has empty host and
    path and gets the model's verdict on them. Repeated rows and null ids stay rows; other columns, of any name, aren't
    read. Urls of any length are read whole. Of rules of equal length the later one wins. An empty table gives no rows.
    """
    host, path = url_parts(F.col("url"))
    rows = spread(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))).select("page_id", host.alias("host"), path.alias("path"))
    shared = rows.sparkSession.sparkContext.broadcast((train() if weights is None else weights).astype(np.float32))  # 2^BITS + 1 numbers

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [probability(shared.value, features(h, p)) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], ["page_id", "host", "path", "score"])

        return step

    kind = dict(rows.dtypes)["page_id"]
    scored = arrow_map(rows, make, f"page_id {kind}, host string, path string, score double")
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
