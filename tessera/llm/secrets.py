"""Secret scan: three base patterns, and an assignment-aware lexer over the whole text.

The lexer goes through the text once. It finds names with an operator (=, :=, =>, :) after them, reads the strings
(with escapes, of one line or of many), bare values, names or sums of these that follow, keeps what names stand for in
the order of the text, and scores what is assigned by the most sensitive of its target names. Comments are read like
code, as a secret that is commented out is one still.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, spread

#: Fixed patterns. The letters of the key words match in either case, ASCII only.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
HINT = re.compile(r"(?i:passw|secret|token|api_?key)", re.ASCII)
#: Fixed least lengths: of an assignment's value, of an access key and of a run of hex digits.
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "pair")

#: How sensitive a name's parts are.
NAMES = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "private": 0.6, "signing": 0.6, "encryption": 0.6, "access": 0.4, "api": 0.4, "key": 0.5, "salt": 0.5, "session": 0.3, "conn": 0.3, "dsn": 0.6}
#: Literals that stand for no secret.
DUMMY = re.compile(r"(?i)^(?:none|null|true|false|undefined|changeme|example|placeholder|your.*|xxx+|\*+|<.*>|\$\{.*\}|test|todo)$")

#: A name from its first character on, what may close it, and an operator.
TARGET = re.compile(r"""(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]++)(?:["']\]?|\])?[\x20\t]*+(?::=|=>|=(?![=>])|:(?![:/=]))""")
SPACE = re.compile(r"[\x20\t]*+(?:[fFrRbBuU]{1,2}(?=[\"'`]))?")
STRING = {q: re.compile(rf"{q}((?:[^{q}\\\n]|\\.)*+){q}") for q in "\"'`"}
#: A value without quotes; signs of equality may only end it.
BARE = re.compile(r"[A-Za-z0-9_+/.~!@#$%^&*-]++(?:={1,2}(?=[\s,;)]|\Z))?")
CHAINED = re.compile(r"[\x20\t]*+=(?![=>])")
PLUS = re.compile(r"[\x20\t]*+\+(?=[\x20\t\"'])")
LOWER, UPPER, DIGITS = (frozenset(x) for x in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
#: Bits that make a value fully strong, and a bound of its counts.
FULL, MOST = 40.0, 10**12
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in PARTS.findall(name)]
    return max([sum(NAMES.get(p, 0.0) for p in parts), NAMES.get("".join(parts), 0.0)])


class Value:
    """What a name stands for: its own literals' spans, the values it takes over, and what is needed of their characters.

    The bits of a sum are at least those of its parts, so once they reach FULL the counts are dropped: a value keeps some
    twelve counts at most, however often it is passed on or doubled.
    """

    def __init__(self):
        self.spans: list[tuple[int, int]] = []
        self.parts: list[Value] = []
        self.counts: Counter = Counter()
        self.size, self.marked, self.dummy, self.full, self.spaced = 0, False, True, False, False
        self.classes: set[str] = set()

    def literal(self, text: str, a: int, b: int) -> None:
        self.spans.append((a, b))
        self.add(Counter(text[a:b]), b - a, {"a" if c in LOWER else "A" if c in UPPER else "0" if c in DIGITS else "-" for c in set(text[a:b])}, " " in text[a:b])
        self.dummy = self.dummy and bool(DUMMY.match(text, a, b))

    def take(self, other: Value) -> None:
        self.parts.append(other)
        self.full = self.full or other.full
        self.add(other.counts, other.size, other.classes, other.spaced)
        self.dummy = self.dummy and other.dummy

    def add(self, counts: Counter, size: int, classes: set[str], spaced: bool) -> None:
        self.size, self.spaced = min(self.size + size, MOST), self.spaced or spaced
        self.classes |= classes
        if not self.full:
            for c, n in counts.items():
                self.counts[c] = min(self.counts[c] + n, MOST)
            self.full = self.bits() >= FULL
        if self.full:
            self.counts = Counter()

    def bits(self) -> float:
        size = sum(self.counts.values())
        return -sum(n * math.log2(n / size) for n in self.counts.values())

    def strength(self) -> float:
        """From 0 to 1: bits by the frequencies of its own characters, full at FULL, with a bonus for mixed classes."""
        if self.size < 6 or self.dummy or self.spaced:
            return 0.0
        return (1.0 if self.full else self.bits() / FULL) * (0.6 + 0.2 * min(2, len(self.classes) - 1))

    def mark(self, found: set[tuple[int, int]]) -> None:
        """Adds all spans that it stands for; a value is gone through once, however often it is passed on."""
        stack = [self]
        while stack:
            value = stack.pop()
            if not value.marked:
                value.marked = True
                found.update(s for s in value.spans if s[0] < s[1])
                stack += value.parts


def pairs(text: str, least: float = 0.5) -> list[tuple[int, int]]:
    """Spans of literals whose target name and strength score at least `least`, by place, without repeats."""
    known: dict[str, Value] = {}
    found: set[tuple[int, int]] = set()
    unclosed = dict.fromkeys(STRING, -1)  # up to where a quote is known to have no partner in its line
    unclosed_many = dict.fromkeys(("\"\"\"", "'''"), False)
    at = 0
    while m := TARGET.search(text, at):
        targets, value, end = [m[1].strip("-.")], Value(), m.end()
        at = end
        while True:
            begin = SPACE.match(text, end).end()
            quote, many = text[begin : begin + 1], text[begin : begin + 3]
            inside = None
            if many in unclosed_many and not unclosed_many[many]:
                close = text.find(many, begin + 3)
                unclosed_many[many] = close < 0
                inside = (begin + 3, close, close + 3) if close >= 0 else None
            elif quote in STRING and begin >= unclosed[quote]:
                if s := STRING[quote].match(text, begin):
                    inside = (*s.span(1), s.end())
                else:
                    line = text.find("\n", begin)
                    unclosed[quote] = len(text) if line < 0 else line
            if inside:
                value.literal(text, *inside[:2])
                end, at = inside[2], max(at, inside[0])  # what a string holds is looked through as well
            elif b := BARE.match(text, begin):
                end = at = b.end()
                if chain := CHAINED.match(text, end):
                    targets.append(b[0].strip("-."))
                    end = at = chain.end()
                    continue
                if text[end : end + 1] == "(":  # a call is no literal
                    break
                if b[0] in known:
                    value.take(known[b[0]])
                else:
                    value.literal(text, *b.span())
            else:
                break
            if not (plus := PLUS.match(text, end)):
                break
            end = plus.end()
        if not value.spans and not value.parts:
            continue
        for name in targets:
            if name:
                known[name] = value
        rate = min(1.0, max(map(sensitivity, targets)))
        if rate > 0 and rate * value.strength() >= least:
            value.mark(found)
    return sorted(found)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if HINT.search(text):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind in the order of KINDS, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_pair, base_sha256, spans) for every row of docs.

    spans lists base matches and the lexer's literals (kind pair) in code points, ends exclusive; base_sha256 is over
    the base matches alone. Null and empty texts have no spans. Null ids and repeated rows stay rows, and equal texts get
    equal spans; other columns, of any name, aren't read. Texts of any length are read whole, each once, in time linear
    in their length. An empty table gives no rows.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple] = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                more = [("pair", a, b) for a, b in pairs(text or "", least)]
                n = Counter(k for k, _, _ in base)
                rows.append((n["assign"], n["access"], n["hex"], len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c)) for c in zip(*rows, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "n_pair", "base_sha256", "spans"])

        return step

    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return arrow_map(rows, make, f"doc_id {dict(rows.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, n_pair long, base_sha256 string, spans string")
