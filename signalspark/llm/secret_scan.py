"""Secret scans with a trigram inverted index.

From each rule's regex a Boolean query of mandatory trigrams is derived: an OR of ANDs, with case folded. Each part of
a batch is indexed (which texts hold which of the trigrams that any query names), postings are intersected, and only
the candidates are verified with the regex. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, slices, struct, utf8


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, what part must be how long, and whether case is ignored (for ASCII letters)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost non-overlapping matches, in code points; a match whose part is too short is then dropped."""
        return [m.span() for m in _compiled(self).finditer(text) if len(m[self.group]) >= self.least]


#: The three base kinds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
#: Further kinds: private keys, web tokens, source-hosting and chat tokens, passwords inside addresses.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("url_password", r"[a-z][a-z0-9+.-]+://[^\s/:@]+:[^\s/:@]+@"),
)


@cache
def _compiled(rule: Rule) -> re.Pattern:
    return re.compile(rule.pattern, re.ASCII | re.IGNORECASE if rule.any_case else re.ASCII)


@dataclass
class _Texts:
    """What a part of a regex can match: the exact strings if they're few, and the trigrams that any match holds."""

    exact: set[str] | None
    query: frozenset[frozenset[str]]  # OR of ANDs; one empty AND: no condition


ANY: frozenset[frozenset[str]] = frozenset({frozenset()})


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _settled(part: _Texts) -> frozenset[frozenset[str]]:
    """The part's condition, its exact strings included."""
    return part.query if part.exact is None else _both(part.query, frozenset(_grams(t) for t in part.exact))


def _both(a: frozenset, b: frozenset) -> frozenset:
    """AND of two conditions; if that gets long, the one with more trigrams in its weakest case stands alone."""
    if len(a) * len(b) <= 64:
        return _least(x | y for x in a for y in b)
    return max(a, b, key=lambda q: min(map(len, q)))


def _least(cases) -> frozenset:
    """Without cases that another case implies."""
    cases = set(cases)
    return frozenset(c for c in cases if not any(o < c for o in cases))


def _part(tree, limit: int = 32) -> _Texts:
    whole, all_exact = _Texts({""}, ANY), True
    for code, arg in tree:
        if code is op.LITERAL:
            piece = _Texts({chr(arg)}, ANY)
        elif code is op.IN and all(c is op.LITERAL for c, _ in arg) and len(arg) <= 4:
            piece = _Texts({chr(v) for _, v in arg}, ANY)
        elif code is op.SUBPATTERN:
            piece = _part(arg[-1], limit)
        elif code is op.BRANCH:
            parts = [_part(p, limit) for p in arg[1]]
            if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= limit:
                piece = _Texts(set().union(*(p.exact for p in parts)), ANY)
            else:
                piece = _Texts(None, _least(case for p in parts for case in _settled(p)))
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = arg
            inside = _part(inner, limit)
            if (low, high) == (0, 1) and inside.exact is not None:
                piece = _Texts(inside.exact | {""}, ANY)
            else:
                piece = _Texts(None, _settled(inside) if low else ANY)
        elif code is op.AT:
            continue
        else:
            piece = _Texts(None, ANY)
        if piece.exact is not None and len(whole.exact) * len(piece.exact) <= limit:
            whole = _Texts({a + b for a in whole.exact for b in piece.exact}, _both(whole.query, piece.query))
        else:
            # what came so far is settled; exact strings begin anew, and are no longer all that the part matches
            all_exact = False
            whole = _Texts(piece.exact if piece.exact is not None else {""}, _both(_settled(whole), piece.query))
    return whole if all_exact else _Texts(None, _settled(whole))


def trigram_query(pattern: str) -> frozenset[frozenset[str]]:
    """Cases of which one must hold in any text that matches: sets of trigrams (A-Z lower-cased), all in the text.

    A case without trigrams is met by any text: the rule must scan fully.
    """
    folded = {frozenset(g.translate(_LOWER) for g in case) for case in _settled(_part(parser.parse(pattern)))}
    return _least(folded)


_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass
class Index:
    """Which texts of a part hold which trigrams, for the trigrams that the rules' queries name."""

    rules: tuple[Rule, ...]
    queries: list[frozenset[frozenset[str]]] = field(init=False)

    def __post_init__(self) -> None:
        self.queries = [trigram_query(r.pattern) for r in self.rules]
        grams = sorted({g.encode() for q in self.queries for case in q for g in case if g.isascii()})
        self.number = {g.decode(): i for i, g in enumerate(grams)}
        self.codes = np.array([g[0] << 16 | g[1] << 8 | g[2] for g in grams], np.uint32)
        self.first_two = np.zeros(1 << 16, bool)
        self.first_two[self.codes >> 8] = True

    def postings(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each trigram the sorted places of the texts that hold it."""
        if not len(self.codes):
            return []
        buf = FOLD[np.frombuffer(b"\n".join(texts) + b"\n\n\n", np.uint8)]
        pairs = (buf[:-2].astype(np.uint16) << 8) | buf[1:-1]
        at = np.flatnonzero(self.first_two[pairs])
        code = (pairs[at].astype(np.uint32) << 8) | buf[at + 2]
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        known = self.codes[place] == code
        ends = np.cumsum([len(t) + 1 for t in texts])
        # no query's trigram holds a line break, so none is taken across two texts
        held = np.unique(place[known] * len(texts) + np.searchsorted(ends, at[known], "right"))
        return np.split(held % len(texts), np.searchsorted(held, np.arange(1, len(self.codes)) * len(texts)))

    def candidates(self, texts: list[bytes]) -> list[list[int]]:
        """For each rule the texts that may match."""
        lists, everyone = self.postings(texts), np.arange(len(texts))
        out = []
        for query in self.queries:
            found = everyone[:0]
            for case in query:
                left = everyone
                for gram in case:
                    if gram in self.number:
                        left = np.intersect1d(left, lists[self.number[gram]], assume_unique=True)
                found = np.union1d(found, left)
            out.append(found.tolist())
        return out


@cache
def index_of(rules: tuple[Rule, ...]) -> Index:
    return Index(rules)


def find_all(texts: list[bytes], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text (start, rule's place, end) of all spans, in order of start, then rule."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    decoded: dict[int, str] = {}
    for k, rows in enumerate(index_of(rules).candidates(texts)):
        for row in rows:
            if row not in decoded:
                decoded[row] = texts[row].decode("utf-8", "replace")
            out[row] += [(start, k, end) for start, end in rules[k].spans(decoded[row])]
    return [sorted(spans) for spans in out]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def find_secrets(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """docs plus `secrets`, an array of (kind, start, end) in code points, end exclusive, by start, then rule.

    Spans of unlike kinds may overlap. Null and empty texts have none. Each row is looked at by itself, so repeated
    rows get the same result; an existing column `secrets` is replaced. An empty table gives an empty table.
    """

    @F.arrow_udf("array<struct<kind: string, start: int, end: int>>")
    def of(texts: pa.Array) -> pa.Array:
        found = [spans for part in slices(texts) for spans in find_all(part, rules)]
        return pa.array([[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in spans] for spans in found], pa.list_(_SPAN))

    return docs.withColumn("secrets", of(utf8(F.col(f"`{text_col}`"))))


def span_digests(docs: DataFrame) -> DataFrame:
    """docs without `secrets`, with counts of the base kinds, a digest of the base spans, and all spans as a string."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    kinds = [r.kind for r in BASE]
    of_kind = lambda k: F.size(F.filter("secrets", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s.kind.isin(kinds))
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != "secrets"), *map(of_kind, kinds), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """docs with every secret in `text_col` replaced by [kind]; of overlapping spans the first is named."""

    @F.arrow_udf("struct<text: string>")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for part in slices(texts):
            for text, spans in zip(part, find_all(part, rules), strict=True):
                whole, done, pieces = text.decode("utf-8", "replace"), 0, []
                for a, k, b in spans:
                    if a >= done:
                        pieces += [whole[done:a], f"[{rules[k].kind}]"]
                    done = max(done, b)
                out.append("".join([*pieces, whole[done:]]))
        return struct(text=pa.array(out, pa.string()))

    return docs.withColumn(text_col, F.when(F.col(f"`{text_col}`").isNotNull(), of(utf8(F.col(f"`{text_col}`"))).getField("text")))
