"""Quality rules as a short-circuit cascade.

A rule looks at a text and its measures, which are worked out when a rule first asks for one. On a bounded share of all
rows the tasks measure each rule's CPU seconds and how many rows it rejects; the rules are ordered by rejection per cost,
and a row is tried by the next rule only if the ones before let it pass. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, beside, slices, utf8

SYMBOLS = b"#*$%&|<>"
_NOT_WORD = WHITE.encode()
_CONTINUATION = bytes(range(0x80, 0xC0))
_ASCII = bytes(range(128))
_NO_CAPITAL = bytes(set(range(256)) - set(range(65, 91)))
_NO_LETTER = bytes(set(range(256)) - set(range(65, 91)) - set(range(97, 123)))
_LETTER, _CAPITAL = regex.compile(r"\p{L}"), regex.compile(r"\p{Lu}")
WINDOW = 5


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a window of consecutive words that is found twice or more, the first included."""
    grams = list(zip(*(words[k:] for k in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    number: dict[tuple, int] = {}
    ids = np.array([number.setdefault(g, len(number)) for g in grams])
    twice = np.flatnonzero(np.bincount(ids)[ids] > 1)
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, twice, 1)
    np.add.at(inside, twice + window, -1)
    return int((np.cumsum(inside) > 0).sum())


class Text:
    """A text's bytes and its measures, each worked out once, when it is asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, _NOT_WORD + _CONTINUATION))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def n_lines(self) -> int:
        return self.raw.count(b"\n") + 1

    @cached_property
    def n_dup_lines(self) -> int:
        lines = [line for line in self.raw.split(b"\n") if line.strip()]
        return len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def beyond_ascii(self) -> str:
        return self.raw.translate(None, _ASCII).decode("utf-8", "replace")

    @cached_property
    def letters(self) -> int:
        return len(self.raw.translate(None, _NO_LETTER)) + len(_LETTER.findall(self.beyond_ascii))

    @cached_property
    def capitals(self) -> int:
        return len(self.raw.translate(None, _NO_CAPITAL)) + len(_CAPITAL.findall(self.beyond_ascii))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A rule's name and whether it rejects a text."""

    name: str
    rejects: Callable[[Text], bool]


def base_rules(least_words: int = 10, repeat_per_100: int = 20) -> list[Rule]:
    return [
        Rule("few_words", lambda t: t.n_words < least_words),
        Rule("repeated_words", lambda t: 100 * t.n_repeat_words > repeat_per_100 * t.n_words),
    ]


def rules() -> list[Rule]:
    """The further rules of the cascade; each rejects what no fluent text of any language does."""
    return [
        Rule("symbols", lambda t: 10 * t.n_symbols > t.word_chars),
        Rule("long_words", lambda t: t.word_chars > 60 * t.n_words),
        Rule("repeated_lines", lambda t: 10 * t.n_dup_lines > 3 * t.n_lines),
        Rule("few_letters", lambda t: 10 * t.letters < 5 * t.word_chars),
        Rule("shouting", lambda t: 2 * t.capitals > t.letters),
    ]


def _asked(text: Text, measures: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(getattr(text, m) for m in measures)


def costs(texts: DataFrame, candidates: list[Rule], given: tuple[str, ...] = ()) -> DataFrame:
    """(rule, seconds, rejected): CPU seconds of a rule's calls, and rows that it rejects, of the one column of `texts`.

    Each rule is timed in the tasks on a text of its own, so it pays for the measures that it asks for, but not for the
    `given` ones, which are worked out for every row anyway.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected = [0.0] * len(candidates), [0] * len(candidates)
        for batch in batches:
            for part in slices(batch.column(0)):
                for k, rule in enumerate(candidates):
                    own = [Text(raw) for raw in part]
                    for text in own:
                        _asked(text, given)
                    began = time.thread_time()
                    rejected[k] += sum(bool(rule.rejects(text)) for text in own)
                    spent[k] += time.thread_time() - began
        yield pa.RecordBatch.from_pydict({"rule": [r.name for r in candidates], "seconds": spent, "rejected": rejected})

    each = texts.mapInArrow(measured, "rule string, seconds double, rejected long")
    return each.groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"))


def ordered(texts: DataFrame, candidates: list[Rule], given: tuple[str, ...] = ()) -> list[Rule]:
    """The rules by rejected rows per CPU second, both measured on `texts`; ties keep their order."""
    worth = {r.rule: r.rejected / max(r.seconds, 1e-9) for r in costs(texts, candidates, given).collect()}
    return sorted(candidates, key=lambda rule: -worth.get(rule.name, 0))


def sampled(docs: DataFrame, text: Column, rows: int) -> DataFrame:
    """The bytes of about `rows` whole texts, picked from all partitions alike."""
    return docs.select(text.alias("raw")).sample(fraction=min(1.0, rows / max(1, docs.count())), seed=7)


def judged(docs: DataFrame, *, text_col: str = "text", least_words: int = 10, repeat_per_100: int = 20, sample_rows: int = 2000, more_rules: list[Rule] | None = None, report: tuple[str, ...] = MEASURES) -> DataFrame:
    """docs plus the measures in `report`, base_failed, kept, and rejected_by (a rule that rejects; which one of several
    may vary).

    base_failed: fewer than least_words words, or over repeat_per_100 of 100 words in repeated windows; these two are
    rules of the cascade like the others. A measure that isn't in `report` is only worked out for the rows that come to
    a rule that needs it; without n_words and n_repeat_words in it there is no column base_failed. Null and empty texts
    have no words and fail. Rows are judged by themselves; columns with these names are replaced. An empty table gives an
    empty table. The order of the rules comes from about sample_rows rows of all partitions; it changes no verdict.
    """
    added = (*MEASURES, "base_failed", "kept", "rejected_by")
    text = utf8(F.col(f"`{text_col}`"))
    cascade = ordered(sampled(docs, text, sample_rows), base_rules(least_words, repeat_per_100) + (rules() if more_rules is None else more_rules), report)
    kind = pa.struct([*((m, pa.int64()) for m in report), ("rejected_by", pa.string())])

    @F.arrow_udf("struct<" + "".join(f"{m}: bigint, " for m in report) + "rejected_by: string>")
    def of(texts: pa.Array) -> pa.Array:
        rows = []
        for part in slices(texts):
            for raw in part:
                own = Text(raw)
                rows.append((*_asked(own, report), next((rule.name for rule in cascade if rule.rejects(own)), None)))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], fields=list(kind))

    rows, own = beside(docs, added, of(text))
    out = rows.select(*own, "value.*")
    if {"n_words", "n_repeat_words"} <= set(report):
        out = out.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_per_100 * F.col("n_words")))
    return out.withColumn("kept", F.col("rejected_by").isNull())
