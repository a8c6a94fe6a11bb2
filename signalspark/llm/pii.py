"""Personal data: base kinds by pattern, further identifiers by the company they keep. DataFrame functions only.

Spans of the base kinds are the seeds. The words around them are lexical patterns: the two words before, or one on
either side. A pattern that stands mostly beside identifiers of one kind, of those that are written like identifiers at
all, is trusted for that kind; what else stands beside trusted patterns is trusted as far as they are, and lends its trust
to further patterns in the next round. Rounds are joins and aggregations over the graph of patterns and instances.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# A match may begin where no character of its own kind comes before, or where the last match ended: within a run of such
# characters a later start fails as the first one did. Possessive repetition keeps the search linear in the text.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?+[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Letters and digits in groups, a digit among them.
_WRITTEN = r"(?<![A-Za-z0-9])(?<![A-Za-z0-9][._/@+-])(?=[A-Za-z._/@+-]*+[0-9])[A-Za-z0-9]++(?:[._/@+-][A-Za-z0-9]++)*+"
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"

#: Base kinds in order, each with what a text must hold to have one.
KINDS = {"email": (_EMAIL, "@"), "ip": (_IP, "."), "card": (_CARD, None), "phone": (_PHONE, "+")}
#: Code points around a span in which its neighbours are looked for.
_REACH = 64
_SPACE = r"[\x20\x09-\x0D]+"
_BLOCK = 256


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits, doubled at every second place from the right, sum to a multiple of ten."""
    digits = F.reverse(_digits(value))

    def weight(i: Column) -> Column:
        x = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + weight(i)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of a base kind's pattern is one."""
    size = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return F.when(size.between(16, 19), _luhn(value)).otherwise(False)
    return size.between(8, 15) if kind == "phone" else F.lit(True)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _running(steps: Column) -> Column:
    """The running sums of an array of integers, in blocks, so that the work stays near the array's length."""
    sums = lambda xs: F.aggregate(xs, F.array().cast("array<int>"), lambda got, x: F.concat(got, F.array(F.coalesce(F.try_element_at(got, F.lit(-1)), F.lit(0)) + x)))
    blocks = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda b: sums(F.slice(xs, b * _BLOCK + 1, _BLOCK)))

    def joined(parts: Column) -> Column:
        totals = sums(F.transform(parts, lambda p: F.element_at(p, -1)))
        before = F.zip_with(parts, totals, lambda p, t: F.struct(p.alias("p"), (t - F.element_at(p, -1)).alias("by")))
        return F.flatten(F.transform(before, lambda x: F.transform(x.p, lambda v: v + x.by)))

    none = F.array().cast("array<int>")
    return _bound(steps, lambda xs: F.when(F.size(xs) > 0, _bound(blocks(xs), joined)).otherwise(none))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPACE, -1), lambda w: w != "")


def _items(found: Column, gaps: Column) -> Column:
    """(start, end, value, left, right, first) of each match, from the matches and what lies between them: the nearest words
    on either side, nearest first, and the nearest characters."""
    n = F.size(found)
    before, after = F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n)
    ends = _running(F.zip_with(found, before, lambda m, g: F.length(m) + F.length(g)))
    left = F.transform(before, lambda g: F.struct(F.slice(F.reverse(_words(F.right(g, F.lit(_REACH)))), 1, 2).alias("words"), F.right(g, F.lit(4)).alias("near")))
    right = F.transform(after, lambda g, i: F.struct(F.slice(_words(F.left(g, F.lit(_REACH))), 1, 1).alias("words"), F.left(g, F.lit(4)).alias("near"), (i == n - 1).alias("last")))
    zipped = F.arrays_zip(found.alias("value"), ends.alias("end"), left.alias("left"), right.alias("right"))
    return F.transform(zipped, lambda x, i: F.struct((x.end - F.length(x.value)).alias("start"), x.end.alias("end"), x.value.alias("value"), x.left.alias("left"), x.right.alias("right"), (i == 0).alias("first")))


def _patterns(x: Column) -> Column:
    """The lexical patterns of a place: the two words before it, and a word on either side."""
    two, one = F.concat_ws(" ", F.get(x.left.words, F.lit(1)), F.get(x.left.words, F.lit(0)), F.lit("_")), F.concat_ws(" ", F.get(x.left.words, F.lit(0)), F.lit("_"), F.get(x.right.words, F.lit(0)))
    both = F.array(F.when(F.size(x.left.words) == 2, two), F.when((F.size(x.left.words) > 0) & (F.size(x.right.words) > 0), one))
    return F.filter(both, lambda p: p.isNotNull())


def base_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, base, written): each row of docs but its text, its base spans with their patterns by kind and start, and what
    else is written like an identifier: four digits or more, no base kind, and no part of a longer number."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    t = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select((F.struct(*others) if others else F.struct(F.lit(0).alias("none"))).alias("row"), t.alias("t"))
    none = F.array().cast("array<string>")
    searched = {**KINDS, "written": (_WRITTEN, None)}
    digits = F.col("t").rlike("[0-9]")
    matched = rows.select("row", "t", *(F.when(digits if sign is None else F.contains(F.col("t"), F.lit(sign)), F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none).alias(k) for k, (pattern, sign) in searched.items()))
    parted = matched.select("row", *searched, *(F.when(F.size(k) > 0, F.split("t", pattern, -1)).otherwise(none).alias(f"gaps_{k}") for k, (pattern, _) in searched.items()))
    placed = parted.select("row", *(_items(F.col(k), F.col(f"gaps_{k}")).alias(k) for k in searched))
    kept = lambda k: F.transform(F.filter(k, lambda x: _holds(k, x.value)), lambda x: F.struct(F.lit(k).alias("kind"), x.start.alias("start"), x.end.alias("end"), x.value.alias("value"), _patterns(x).alias("patterns")))
    return placed.select("row", F.concat(*map(kept, KINDS)).alias("base"), F.transform(F.filter("written", _stands_alone), lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.value.alias("value"), _patterns(x).alias("patterns"))).alias("written"))


def _stands_alone(x: Column) -> Column:
    """Whether a written token has four digits, is no base span and has no other group of digits beside it."""
    joint = r"^[\x20().+-]{1,3}$"  # the gap between two groups of one number
    apart = (x.first | ~x.left.near.rlike(joint)) & (x.right.last | ~x.right.near.rlike(joint))
    card = F.regexp_extract(x.value, _CARD, 0)
    known = x.value.rlike(_EMAIL) | (x.value.rlike(_IP) & _holds("ip", F.regexp_extract(x.value, _IP, 0))) | _holds("card", card)
    return (F.length(_digits(x.value)) >= 4) & apart & ~x.left.near.rlike(r"\+$") & ~known


def trusted(occurrences: DataFrame, *, rounds: int, least_seeds: int, least_trust: float) -> tuple[DataFrame, DataFrame]:
    """((pattern, kind, trust), (value, kind, trust)): patterns and further identifiers, from (kind, value, patterns) with
    a null kind where it isn't known.

    A pattern's trust in a kind is the trust of the distinct instances beside it, a seed's being one, divided by their
    number; it counts from least_seeds instances' worth and least_trust on. A value's trust is that at least one of its
    patterns is right; from least_trust on it is taken for its best kind.
    """
    edges = occurrences.select("value", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.min("kind").alias("kind"))
    often = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_seeds)
    edges = stored(edges.join(often, "pattern"))
    open_edges = edges.filter(F.col("kind").isNull()).select("pattern", "value")
    known = edges.filter(F.col("kind").isNotNull()).select("pattern", "value", "kind", F.lit(1.0).alias("trust"), "n")
    seeds = known.groupBy("pattern", "kind", "n").agg(F.sum("trust").alias("of_seeds"))
    values = None
    for _ in range(rounds):
        sums = seeds
        if values is not None:
            learnt = edges.filter(F.col("kind").isNull()).drop("kind").join(values, "value").groupBy("pattern", "kind", "n").agg(F.sum("trust").alias("of_seeds"))
            sums = seeds.unionByName(learnt).groupBy("pattern", "kind", "n").agg(F.sum("of_seeds").alias("of_seeds"))
        trust = F.col("of_seeds") / F.col("n")
        patterns = stored(sums.filter((F.col("of_seeds") >= least_seeds) & (trust >= least_trust)).select("pattern", "kind", trust.alias("trust")))
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))
        each = open_edges.join(patterns, "pattern").groupBy("value", "kind").agg((1 - doubt).alias("trust"))
        best = Window.partitionBy("value").orderBy(F.col("trust").desc(), F.col("kind"))
        values = stored(each.filter(F.col("trust") >= least_trust).withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place"))
    return patterns, values


def find_pii(docs: DataFrame, *, text_col: str = "text", rounds: int = 3, least_seeds: int = 4, least_trust: float = 0.8) -> DataFrame:
    """docs without its text, plus `pii`: an array of (kind, start, end) in code points, end exclusive, by kind as listed in
    KINDS, then `like_` and those kinds, then start.

    The base kinds are judged in each text by itself. A span `like_<kind>` is an identifier that the patterns of a kind
    led to, in this text or another: bootstrapped over all rows, `rounds` times. A pattern needs least_seeds distinct
    instances and, as an identifier, least_trust (see trusted). Null and empty texts have no spans. Repeated rows each get
    a row and the same spans; values, not occurrences, count as evidence. An existing column `pii` is replaced. An empty
    table gives an empty table. Rows are stored without text between the passes; copy the text to another column to keep it.
    """
    kept = [c for c in docs.columns if c not in (text_col, "pii")]
    table = stored(base_spans(docs.select(*(F.col(f"`{c}`") for c in [*kept, text_col])), text_col).withColumn("key", F.monotonically_increasing_id()))
    seeds = table.select(F.explode("base").alias("x")).select("x.kind", "x.value", "x.patterns")
    others = table.select(F.explode("written").alias("x")).select(F.lit(None).cast("string").alias("kind"), "x.value", "x.patterns")
    _, values = trusted(seeds.unionByName(others), rounds=rounds, least_seeds=least_seeds, least_trust=least_trust)
    written = table.select("key", F.explode("written").alias("x")).select("key", "x.start", "x.end", F.col("x.value").alias("value"))
    place = reduce(lambda c, k: c.when(F.col("kind") == k, list(KINDS).index(k)), list(KINDS)[1:], F.when(F.col("kind") == list(KINDS)[0], 0))
    spans = written.join(values, "value").groupBy("key").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "start", "end", F.concat(F.lit("like_"), F.col("kind")).alias("kind")))).alias("more"))
    more = F.coalesce(F.transform("more", lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"))), F.array().cast("array<struct<kind: string, start: int, end: int>>"))
    base = F.transform("base", lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end")))
    return table.drop("written").join(spans, "key", "left").select(*(F.col("row").getField(c).alias(c) for c in kept), F.concat(base, more).alias("pii"))


def span_digests(found: DataFrame) -> DataFrame:
    """found without `pii`, with counts of the base kinds, a digest of the base spans, and all spans as a string."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    of_kind = lambda k: F.size(F.filter("pii", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s.kind.isin(list(KINDS)))
    return found.select(*(F.col(f"`{c}`") for c in found.columns if c != "pii"), *map(of_kind, KINDS), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("pii")).alias("spans"))
