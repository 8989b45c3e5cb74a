"""The English text profile: stop words, and the Snowball English (Porter 2) stemmer as SQL expressions.

A rule is a suffix, what replaces it and a condition on what stands before; a step takes the longest suffix that a word
has. The expressions are plain CASE, left, right and regular expressions, so an engine compiles them like any column,
and any engine's SQL can run the same steps: `steps()` gives them, `stemmed()` applies them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# The stop words of the usual English configuration.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
# Words with stems of their own, and words that are left alone after the first step.
EXCEPTIONS = dict(x.split(":") for x in "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes".split())
KEPT = "inning outing canning herring earring proceed exceed succeed".split()
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
REGION = f"{OTHER}*{VOWEL}+{OTHER}"
#: A short syllable at the end: a vowel between two others (the last not w, x or Y), or a vowel and another that are the whole.
SHORT = f"({OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"
R1, R2 = "length(w) - {n} >= p1", "length(w) - {n} >= p2"
# Suffixes, replacements and conditions ({n} is the suffix's length, {stem} the word before it).
STEP_2 = "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble fulli:ful lessli:less"
STEP_3 = "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize"

Rule = tuple[str, str, str]


def table(rules: str, where: str) -> list[Rule]:
    return [(s, r, where) for s, _, r in (x.partition(":") for x in rules.split())]


def choose(rules: list[Rule], match: str) -> str:
    """The word after the rule of its longest suffix, if that rule's condition holds."""

    def case(suffix: str, to: str, where: str) -> str:
        n = len(suffix)
        stem = f"left(w, length(w) - {n})"
        return f"WHEN right(w, {n}) = '{suffix}' THEN CASE WHEN {where.format(n=n, stem=stem, match=match)} THEN {stem} || '{to}' ELSE w END"

    return f"CASE {' '.join(case(*r) for r in sorted(rules, key=lambda r: -len(r[0])))} ELSE w END"


def steps(match: str = "regexp_like", group: str = "$1", everywhere: str = "") -> list[dict[str, str]]:
    """Columns to compute one after the other from `token`; each step reads only columns of earlier ones. The stem is the last one's w.

    match: the engine's test of a regular expression; group: its name of the first group; everywhere: what its replacing needs to replace all.
    """
    vowel, words = f"{{match}}({{stem}}, '{VOWEL}')", ", ".join(f"'{x}'" for x in KEPT)
    marked = f"regexp_replace(regexp_replace(token, '^y', 'Y'), '([aeiouy])y', '{group}Y'{everywhere})"
    first = f"^(gener|commun|arsen|{REGION})"
    plural = [("sses", "ss", "true"), ("ied", "i", "length(w) > 4"), ("ies", "i", "length(w) > 4"), ("us", "us", "true"), ("ss", "ss", "true"), ("s", "", f"{{match}}({{stem}}, '{VOWEL}.')")]
    past = [("eed", "ee", R1), ("eedly", "ee", R1), *((s, "", vowel) for s in ("ed", "edly", "ing", "ingly"))]
    ied = "CASE WHEN length(w) = 4 AND right(w, 3) IN ('ied', 'ies') THEN left(w, 3) ELSE {} END"
    after = f"CASE WHEN w = cut OR right(cut, 2) = 'ee' AND right(w, 3) = 'eed' OR right(w, 5) = 'eedly' THEN cut WHEN right(cut, 2) IN ('at', 'bl', 'iz') THEN cut || 'e' WHEN {match}(cut, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(cut, length(cut) - 1) WHEN length(cut) <= p1 AND {match}(cut, '{SHORT}') THEN cut || 'e' ELSE cut END"
    two = [*table(STEP_2, R1), ("ogi", "og", f"{R1} AND right({{stem}}, 1) = 'l'"), ("li", "", f"{R1} AND {{match}}({{stem}}, '[cdeghkmnrt]$')")]
    three = [*table(STEP_3, R1), ("ative", "", f"{R1} AND {R2}")]
    four = [*table(STEP_4, R2), ("ion", "", f"{R2} AND {{match}}({{stem}}, '[st]$')")]
    five = [("e", "", f"{R2} OR {R1} AND NOT {{match}}({{stem}}, '{SHORT}')"), ("l", "", f"{R2} AND right({{stem}}, 1) = 'l'")]
    stay = f"fixed IS NOT NULL OR w IN ({words})"
    return [
        {"w": f"CASE WHEN length(token) > 2 AND {match}(token, '^[a-z]+$') THEN {marked} END", "fixed": f"CASE token {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in EXCEPTIONS.items())} ELSE CASE WHEN length(token) <= 2 OR NOT {match}(token, '^[a-z]+$') THEN token END END"},
        {"p1": f"CASE WHEN {match}(w, '{first}') THEN length(regexp_extract(w, '{first}', 0)) ELSE length(w) END"},
        {"p2": f"CASE WHEN {match}(substr(w, p1 + 1), '^{REGION}') THEN p1 + length(regexp_extract(substr(w, p1 + 1), '^{REGION}', 0)) ELSE length(w) END"},
        {"w": ied.format(choose(plural, match))},
        {"fixed": f"CASE WHEN {stay} THEN coalesce(fixed, w) END", "cut": choose(past, match)},
        {"w": after},
        {"w": f"CASE WHEN length(w) > 2 AND {match}(w, '{OTHER}[yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END"},
        {"w": choose(two, match)},
        {"w": choose(three, match)},
        {"w": choose(four, match)},
        {"w": choose(five, match)},
        {"w": "coalesce(fixed, replace(w, 'Y', 'y'))"},
    ]


def stemmed(words: DataFrame, token: str = "token", to: str = "stem") -> DataFrame:
    """words with the stem of each token. Tokens of one or two characters or with other characters than a-z stay as they are."""
    names = {n: f"__{n}" for n in ("token", "w", "fixed", "p1", "p2", "cut")}
    df = words.withColumn(names["token"], words[token])
    for step in steps():
        df = df.selectExpr(*[c for c in df.columns if c not in {names[n] for n in step}], *[f"{renamed(e, names)} AS {names[n]}" for n, e in step.items()])
    return df.withColumnRenamed(names["w"], to).drop(*names.values())


def renamed(expression: str, names: dict[str, str]) -> str:
    """An expression with its columns renamed, strings left alone."""
    parts = expression.split("'")
    for i in range(0, len(parts), 2):
        parts[i] = "".join(names.get(x, x) for x in re.split(r"\b", parts[i]))
    return "'".join(parts)


def duckdb_sql(source: str, token: str = "token") -> str:
    """Common table expressions that end in stems(token, stem), for an engine whose functions differ in name."""
    out, before, have = [f"s0 AS (SELECT DISTINCT {token} AS token FROM {source})"], "s0", ["token"]
    for k, step in enumerate(steps("regexp_matches", "\\1", ", 'g'"), 1):
        kept = [c for c in have if c not in step]
        have = kept + list(step)
        out.append(f"s{k} AS (SELECT {', '.join([*kept, *(f'{e} AS {n}' for n, e in step.items())])} FROM {before})")
        before = f"s{k}"
    return ", ".join(out) + f", stems AS (SELECT token, w AS stem FROM {before})"
