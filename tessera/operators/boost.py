"""Rule-based boosts: query signals are read on the driver, row signals are columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.vectors import clamp

# The word lists that decide the boosts, and their sizes.
KNOWN_VENDORS = ("openai", "anthropic", "google", "aws", "azure", "meta", "xai", "mistral", "huggingface", "cohere", "perplexity", "claude", "gpt", "gemini", "llama", "deepseek", "databricks", "nvidia", "together", "antml ")
STRATEGY_VENDORS = tuple(v.strip() for v in KNOWN_VENDORS)
DOC_TYPES = {
    "api_docs": ("api", "endpoint", "request", "response", "authentication", "authorization", "rate limit", "parameter", "method", "http"),
    "guide": ("guide", "tutorial", "getting started", "introduction", "how to", "step by step", "walkthrough", "best practices", "example"),
    "kb_article": ("kb", "knowledge base", "article", "faq", "frequently asked", "question", "answer", "troubleshooting", "common issue"),
    "code_sample": ("code", "example", "sample", "implementation", "snippet", "github", "repository", "source code", "library"),
    "reference": ("reference", "specification", "spec", "schema", "format", "documentation", "standard", "protocol"),
}
TOPICS = {
    "authentication": ("auth", "authentication", "login", "jwt", "token", "password", "oauth", "saml", "mfa", "two-factor", "identity"),
    "api_design": ("api design", "rest", "graphql", "webhook", "rate limiting", "versioning", "deprecation", "sdks", "compatibility"),
    "data_handling": ("data", "database", "storage", "query", "caching", "indexing", "migration", "backup", "export", "import"),
    "deployment": ("deploy", "production", "staging", "devops", "ci/cd", "docker", "kubernetes", "scaling", "infrastructure"),
    "optimization": ("optimization", "performance", "latency", "throughput", "efficient", "fast", "slow", "benchmark", "profiling"),
    "error_handling": ("error", "exception", "failure", "retry", "timeout", "circuit breaker", "fallback", "debugging", "troubleshoot"),
}
CATEGORY_TYPES = (("api_docs", ("api",)), ("guide", ("guide", "tutorial")), ("kb_article", ("kb", "article")), ("code_sample", ("code", "sample")), ("reference", ("reference", "doc")))
WEIGHTS = {"vendor": 0.15, "doc_type": 0.10, "recency": 0.05, "entity": 0.10, "topic": 0.08}
VENDOR_FIELDS = ("vendor", "vendor_name", "company", "organization", "author")


def holding(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words), F.lit(False))


def first_match(query: str, table: dict[str, tuple[str, ...]]) -> str:
    low = query.lower()
    return next((name for name, words in table.items() if any(w in low for w in words)), "")


def entities(query: str) -> list[str]:
    """Capitalised words, and pairs of neighbours that are both capitalised, in lower case."""
    words = query.split()
    big = [w for w in words if w[0].isupper()]
    return [w.lower() for w in big + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a[0].isupper() and b[0].isupper()]]


def vendor(query: str, metadata: Column, vendors: tuple[str, ...] = KNOWN_VENDORS) -> Column:
    named = [v for v in vendors if v in query.lower()]
    found = F.coalesce(*[F.get_json_object(metadata, f"$.{f}") for f in VENDOR_FIELDS])
    return F.when(F.coalesce(F.lower(found).isin(named), F.lit(False)), 1.0).otherwise(0.0) if named else F.lit(0.0)


def doc_type(query: str, category: Column) -> Column:
    wanted, low = first_match(query, DOC_TYPES), F.lower(category)
    kind = reduce(lambda rest, t: F.when(holding(low, t[1]), t[0]).otherwise(rest), reversed(CATEGORY_TYPES), F.lit(""))
    return F.when(F.coalesce(kind == wanted, F.lit(False)), 1.0).otherwise(0.0) if wanted else F.lit(0.0)


def recency(document_date: Column, as_of: date, very: int = 7, recent: int = 30) -> Column:
    age = F.datediff(F.lit(as_of), document_date)
    return F.when(age < very, 1.0).when(age < recent, 0.7).otherwise(0.0)


def entity(query: str, text: Column) -> Column:
    return F.when(holding(F.lower(text), tuple(entities(query))), 1.0).otherwise(0.0)


def topic(query: str, text: Column) -> Column:
    wanted = first_match(query, TOPICS)
    return F.when(holding(F.lower(text), TOPICS[wanted]), 1.0).otherwise(0.0) if wanted else F.lit(0.0)


Rule = Callable[..., Column]


@dataclass(frozen=True)
class Strategy:
    """A rule (a column from 0 to 1, by query and row) with the factor that it counts by."""

    name: str
    rule: Rule
    factor: float

    def __post_init__(self) -> None:
        if not 0.0 <= self.factor <= 1.0:
            raise ValueError("a factor must lie between 0 and 1")

    def boost(self, *args: object, **options: object) -> Column:
        return self.factor * self.rule(*args, **options)


#: Named rules and their factors unless others are asked for; register adds to them or puts another in a rule's place.
RULES: dict[str, Rule] = {}
FACTORS = dict(WEIGHTS)


def register(name: str, rule: Rule, factor: float | None = None) -> None:
    """Makes a rule known. Without factor a name keeps the one it has, and a new one counts 0 unless create is given another."""
    if not callable(rule):
        raise TypeError("a rule is a function that gives a column")
    if factor is not None:
        FACTORS[name] = Strategy(name, rule, factor).factor
    RULES[name] = rule


def create(name: str, factor: float | None = None) -> Strategy:
    if name not in RULES:
        raise KeyError(f"unknown strategy {name!r}")
    return Strategy(name, RULES[name], FACTORS.get(name, 0.0) if factor is None else factor)


def create_all(factors: dict[str, float] | None = None) -> list[Strategy]:
    """One of each known rule, with its factor or the given one."""
    return [create(name, (factors or {}).get(name)) for name in RULES]


def known_vendor(query: str, metadata: Column) -> Column:
    """The vendor rule by STRATEGY_VENDORS, which differs in one name."""
    return vendor(query, metadata, STRATEGY_VENDORS)


for _name, _rule in (("vendor", known_vendor), ("doc_type", doc_type), ("recency", recency), ("entity", entity), ("topic", topic)):
    register(_name, _rule)


def boosted(base: Column, factors: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """base (1 + sum of weight * factor), added up from 1 on in the order of the factors, within 0 and 1."""
    weights = WEIGHTS | (weights or {})
    return clamp(base * reduce(lambda a, b: a + b, (weights[n] * f for n, f in factors.items()), F.lit(1.0)))
