"""Query routing and rerank pools as column expressions over a query text, for one query or a table of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import occurrences

# The words that tell keyword queries, questions and complex queries.
TECHNICAL = ("api", "endpoint", "request", "response", "http", "rest", "graphql", "webhook", "authentication", "jwt", "oauth", "token", "rate limit", "function", "class", "method", "variable", "parameter", "argument", "return", "import", "library", "module", "package", "dependency", "database", "query", "sql", "nosql", "mongodb", "postgres", "redis", "cache", "index", "schema", "table", "column", "join", "deploy", "docker", "kubernetes", "ci/cd", "pipeline", "container", "infrastructure", "cloud", "aws", "azure", "gcp", "code", "github", "git", "commit", "branch", "merge", "pull request", "bug", "issue", "feature", "refactor", "optimization")
QUESTIONS = ("what", "how", "why", "when", "where", "who", "which", "explain", "describe", "tell me", "help", "show", "find")
COMPLEX = ("multi", "complex", "advanced", "expert", "edge case", "optimization", "architecture", "design pattern")
OPERATORS = (" and ", " or ", " not ")


def words(query: Column) -> Column:
    return F.filter(F.split(query, r"\s+"), lambda w: w != "")


def count_in(tokens: Column, known: tuple[str, ...]) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(list(known))))


def operators(query: Column) -> Column:
    return reduce(lambda a, b: a + b, (occurrences(F.lower(query), o) for o in OPERATORS))


def keyword_density(query: Column) -> Column:
    w = words(F.lower(query))
    return count_in(w, TECHNICAL) / F.greatest(F.size(w), F.lit(1)).cast("double")


def strategy(query: Column) -> Column:
    d = keyword_density(query)
    return F.when(d > 0.7, "bm25").when(d < 0.3, "vector").otherwise("hybrid")


def complexity_class(query: Column) -> Column:
    w = words(F.lower(query))
    n = F.size(w)
    length = F.when(n < 3, 0.2).when(n < 8, 0.5).when(n < 15, 1.0).otherwise(1.5)
    score = length + operators(query) * 0.3 + keyword_density(query) * 0.3 + count_in(w, COMPLEX) * 0.5
    return F.when(score < 0.5, "simple").when(score < 1.5, "moderate").otherwise("complex")


def confidence(query: Column) -> Column:
    d, questions = keyword_density(query), count_in(words(F.lower(query)), QUESTIONS)
    ops = operators(query) + occurrences(query, '"')
    base = F.when((d > 0.7) | (d < 0.2), 0.9).when(questions > 0.3, 0.85).otherwise(0.6)
    return F.when(ops > 2, F.least(base + 0.1, F.lit(1.0))).when((ops == 0) & (d < 0.3), F.greatest(base - 0.05, F.lit(0.5))).otherwise(base)


def pool_complexity(query: Column) -> Column:
    low = F.lower(query)
    return F.least(F.lit(1.0), F.size(words(low)) / 10.0 * 0.6 + F.when(low.rlike(r"\b(and|or|not)\b"), 0.2).otherwise(0.0) + F.when(query.rlike('"[^"]*"'), 0.2).otherwise(0.0))


def pool_type(query: Column) -> Column:
    n = F.length(query)
    return F.when(n < 15, "short").when(n < 50, "medium").when(n < 100, "long").otherwise("complex")


def pool_size(complexity: Column, available: Column, base: int = 50, most: int = 100) -> Column:
    """Candidates to rerank: the base, grown with complexity, within the cap and what there is; five at least where there are five."""
    size = F.least((base * (1.0 + complexity * 1.2)).cast("int"), F.lit(most))
    return F.least(F.greatest(size, F.lit(5)), available)


@dataclass(frozen=True)
class Route:
    strategy: str
    density: float
    reason: str


def route(query: str, available: Sequence[str] = ("hybrid", "vector", "bm25")) -> Route:
    """The strategy for one query by the rule of strategy(), decided on the driver; one that is not available gives way to hybrid, else the first there is."""
    known = query.lower().split()
    density = sum(w in TECHNICAL for w in known) / max(1, len(known))
    wanted = "bm25" if density > 0.7 else "vector" if density < 0.3 else "hybrid"
    chosen = wanted if wanted in available else "hybrid" if "hybrid" in available else available[0]
    return Route(chosen, density, f"{density:.2f} of the words are technical" + ("" if chosen == wanted else f"; {wanted} is not available"))


def signals(query: Column) -> Column:
    """What routing reads of a query: keyword density and the counts of operators with quotes, capitalised words and question words."""
    capital = F.size(F.filter(words(query), lambda w: w.rlike("^[A-Z]"))).alias("entities")
    return F.struct(keyword_density(query).alias("keyword_density"), (operators(query) + occurrences(query, '"')).alias("operators"), capital, count_in(words(F.lower(query)), QUESTIONS).alias("questions"))
