"""Periodic stretches of words, found in a grammar of the texts.

The texts of a part of a batch are compressed together by Re-Pair over word ids: of pairs that occur again, those that
no more frequent pair overlaps become a nonterminal at once, round by round, until no pair occurs twice. A stretch
lies whole inside the expansion of a nonterminal, or it crosses a border of what is left of its text. So each border is
looked at once, however often its nonterminal occurs: near the border a stretch of period q and three periods or more
holds the same words q apart, which an index of word sequences finds, and both are followed to their full length within
the expansion. What is found is carried to every place at which the nonterminal was put, and merged there.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

#: Two polynomial hashes modulo the Mersenne prime 2**31 - 1, with unlike bases.
_PRIME = (1 << 31) - 1
_BASES = (1_210_720_723, 892_153_417)


class Grammar(NamedTuple):
    """Nonterminals of at least `least` words, and the borders that are left in the texts."""

    first: np.ndarray  # of each nonterminal: a place where it stands,
    border: np.ndarray  # where its second symbol begins there,
    size: np.ndarray  # and its words
    rule: np.ndarray  # all places of all nonterminals: which one (ascending),
    place: np.ndarray  # and where it stands
    borders: np.ndarray  # where a symbol follows another one of the same text


def re_pair(ids: np.ndarray, ends: np.ndarray, least: int) -> Grammar:
    """The grammar of texts of word ids that end before `ends`. A pair within one text is replaced; none spans two."""
    symbol, at = ids.astype(np.int64), np.arange(len(ids))
    last = np.zeros(len(ids), bool)
    last[ends[ends > 0] - 1] = True
    size = np.ones(int(symbol.max(initial=0)) + 1, np.int64)
    active = ~last
    first, border, sizes, rules, places, named = [], [], [], [], [], 0
    while active.any():
        here = np.flatnonzero(active)
        pair = symbol[here] * len(size) + symbol[here + 1]
        order = np.argsort(pair)
        pair, here = pair[order], here[order]
        new = np.diff(pair, prepend=-1) != 0
        kind = np.cumsum(new) - 1
        times = np.bincount(kind)
        again = times[kind] > 1
        here, kind = here[again], kind[again]
        rank = np.zeros(len(symbol), np.int64)  # more frequent pairs first, pairs of one number apart
        rank[here] = times[kind] * len(times) + kind + 1
        starts = np.flatnonzero(np.diff(rank, prepend=-1))
        lengths, tops = np.diff(starts, append=len(rank)), rank[starts]
        highest = (tops > 0) & (tops > np.concatenate(([0], tops[:-1]))) & (tops > np.concatenate((tops[1:], [0])))
        even = (np.arange(len(rank)) - np.repeat(starts, lengths)) % 2 == 0  # of aaaa every other pair
        chosen = np.repeat(highest, lengths) & even
        mine = chosen[here]
        where, kind = here[mine], kind[mine]
        if not len(where):
            break
        fresh = np.diff(kind, prepend=-1) != 0
        number = np.cumsum(fresh) - 1
        one = where[fresh]
        made = size[symbol[one]] + size[symbol[one + 1]]
        long = made >= least
        index = np.where(long, np.cumsum(long) - 1 + named, -1)
        first.append(at[one[long]])
        border.append(at[one[long] + 1])
        sizes.append(made[long])
        kept = long[number]
        rules.append(index[number[kept]])
        places.append(at[where[kept]])
        named += int(long.sum())
        symbol[where] = len(size) + number
        size = np.concatenate((size, made))
        last[where] = last[where + 1]
        stays = np.ones(len(symbol), bool)
        stays[where + 1] = False
        # a pair of two old symbols that occurs once stays so; what a new symbol begins or ends may occur again
        active = rank > 0
        active[where] = True
        before = where - 1
        active[before[before >= 0]] = True
        active[np.maximum(where - 2, 0)] = True  # if the place before was swallowed by its own left neighbour
        symbol, at, last, active = symbol[stays], at[stays], last[stays], active[stays]
        active &= ~last
    inner = np.flatnonzero(~last) + 1
    flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Grammar(flat(first), flat(border), flat(sizes), flat(rules), flat(places), at[inner])


class _Sequences:
    """Hashes of any stretch of a row of ids."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.sums, self.powers = [], []
        for base in _BASES:
            power = np.ones(self.n + 1, np.int64)
            done, by = 1, base
            while done < self.n + 1:
                more = min(done, self.n + 1 - done)
                power[done : done + more] = power[:more] * by % _PRIME
                done, by = done + more, by * by % _PRIME
            total = np.zeros(self.n + 1, np.int64)
            np.cumsum((ids + 1) * power[:-1] % _PRIME, out=total[1:])
            self.sums.append(total % _PRIME)
            self.powers.append(power)

    def keys(self, start: np.ndarray, length: int) -> np.ndarray:
        a, b = ((s[start + length] - s[start]) % _PRIME * p[self.n - start] % _PRIME for s, p in zip(self.sums, self.powers, strict=True))
        return a << 31 | b

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches at i and at j >= i are the same."""
        out = np.ones(len(i), bool)
        for s, p in zip(self.sums, self.powers, strict=True):
            out &= (s[i + length] - s[i]) % _PRIME * p[j - i] % _PRIME == (s[j + length] - s[j]) % _PRIME
        return out

    def reach(self, i: np.ndarray, j: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
        """How many words from i and j on (step 1) or before them (step -1) are the same, `room` at most."""
        got = np.zeros(len(i), np.int64)
        width = 1 << int(room.max(initial=0)).bit_length()
        while width:
            more = np.flatnonzero(got + width <= room)
            at = i[more] + got[more] if step > 0 else i[more] - got[more] - width
            ok = more[self.same(at, at + (j - i)[more], np.full(len(more), width))]
            got[ok] += width
            width >>= 1
        return got


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges low <= x < high: the range's number and x, one after the other."""
    n = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + low[owner]


def _crossing(words: _Sequences, text: np.ndarray, stop: np.ndarray, border: np.ndarray, low: np.ndarray, high: np.ndarray, least: int, periods: int) -> tuple[np.ndarray, ...]:
    """(number of the border, start, end, period) of what has a period around a border, between `low` and `high`.

    One side of the border holds half of the stretch, so (half the periods less one) * q words beside the border are the
    same q words further; `length` words of them, and the one beyond the border, are looked up.
    """
    found = [np.zeros((4, 0), np.int64)]
    most = int((high - low).max(initial=0)) // periods
    near, live = 1, np.arange(words.n)
    while near <= most and len(live):
        far = 16 if near == 1 else 2 * near
        on_side = (periods * near + 1) // 2 - near if near > 1 else min(max(-(-least // 2), -(-periods * q // 2)) - q for q in range(1, far))
        length = 1 + max(on_side, 1)
        live = live[live + length <= stop[live]]
        key = words.keys(live, length) * 31 + text[live] * 0x9E3779B1
        order = np.argsort(key)
        ranked = key[order]
        alike = ranked[1:] == ranked[:-1]
        again = np.concatenate((alike, [False])) | np.concatenate(([False], alike)) if len(ranked) else np.zeros(0, bool)
        live, key = live[order[again]], ranked[again]
        group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        listed = np.sort(group * words.n + live)
        group_at = np.full(words.n, -1)
        group_at[live] = group
        live = np.sort(live)
        for side in (1, -1):
            own = border - 1 if side > 0 else border - length + 1
            who = np.flatnonzero(own >= low)
            who = who[group_at[own[who]] >= 0]
            base = group_at[own[who]] * words.n
            if side > 0:
                a, b = base + np.minimum(own[who] + near, words.n), base + np.minimum(own[who] + far, words.n)
            else:
                a, b = base + np.maximum(own[who] - far + 1, 0), base + np.maximum(own[who] - near + 1, 0)
            number, place = _spread(np.searchsorted(listed, a), np.searchsorted(listed, b))
            who, other = who[number], listed[place] - base[number]
            i, j = np.minimum(own[who], other), np.maximum(own[who], other)
            fits = (i >= low[who]) & (j + length <= high[who]) & (periods * (j - i) <= high[who] - low[who])
            who, i, j = who[fits], i[fits], j[fits]
            start = i - words.reach(i, j, i - low[who], -1)
            end = j + words.reach(i, j, high[who] - j, 1)
            whole = end - start >= np.maximum(least, periods * (j - i))
            found.append(np.stack((who, start, end, j - i))[:, whole])
        near = far
    return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


def runs_of(ids: np.ndarray, ends: np.ndarray, least: int, periods: int) -> tuple[np.ndarray, ...]:
    """(text, start, end, period), start and end within all ids, by text, start, period: the longest stretches of smallest
    period `period` with at least `least` words and `periods` periods, in texts that end before `ends`."""
    grammar = re_pair(ids, ends, least)
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    text = np.repeat(np.arange(len(ends)), ends - begins)
    words = _Sequences(ids)
    border = np.concatenate((grammar.border, grammar.borders))
    left = text[grammar.borders]
    low = np.concatenate((grammar.first, begins[left]))
    high = np.concatenate((grammar.first + grammar.size, ends[left]))
    enough = high - low >= least
    at = np.flatnonzero(enough)
    number, start, end, period = _crossing(words, text, ends[text], border[at], low[at], high[at], least, periods)
    number = at[number]
    inside = number < len(grammar.first)
    rule = number[inside]
    owner, place = _spread(np.searchsorted(grammar.rule, rule), np.searchsorted(grammar.rule, rule, "right"))
    moved = grammar.place[place] - grammar.first[rule][owner]
    start = np.concatenate((start[~inside], start[inside][owner] + moved))
    end = np.concatenate((end[~inside], end[inside][owner] + moved))
    period = np.concatenate((period[~inside], period[inside][owner]))
    return _merged(text[start], start, end, period)


def _merged(text: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of one period that share a period's words are one; of equal stretches the smallest period stays."""
    order = np.lexsort((start, period, text))
    text, start, end, period = (x[order] for x in (text, start, end, period))
    group = np.cumsum((np.diff(text, prepend=-1) != 0) | (np.diff(period, prepend=-1) != 0))
    high = int(end.max(initial=0)) + 1
    reached = np.maximum.accumulate(group * high + end) - group * high
    apart = np.ones(len(text), bool)
    apart[1:] = (group[1:] != group[:-1]) | (start[1:] > reached[:-1] - period[1:])
    heads = np.flatnonzero(apart)
    if len(heads):
        text, start, end, period = text[heads], start[heads], np.maximum.reduceat(end, heads), period[heads]
    order = np.lexsort((period, end, start, text))
    text, start, end, period = (x[order] for x in (text, start, end, period))
    smallest = np.ones(len(text), bool)
    smallest[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    text, start, end, period = (x[smallest] for x in (text, start, end, period))
    order = np.lexsort((period, start, text))
    return tuple(x[order] for x in (text, start, end, period))


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _of_part(texts: list[bytes], least: int, periods: int) -> tuple[list[list[dict]], list[bytes]]:
    """The runs of each text, and its words without those that a run repeats."""
    words = [t.split() for t in texts]
    codes: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter((codes[w] for text in words for w in text), np.int64)
    ends = np.cumsum([len(w) for w in words])
    text, start, end, period = runs_of(ids, ends, least, periods)
    mark = np.zeros(len(ids) + 1, np.int64)
    np.add.at(mark, start + period, 1)
    np.add.at(mark, end, -1)
    dropped = np.cumsum(mark)[:-1] > 0
    runs: list[list[dict]] = [[] for _ in texts]
    begins = np.concatenate(([0], ends[:-1]))
    for t, s, e, q in zip(text.tolist(), (start - begins[text]).tolist(), (end - begins[text]).tolist(), period.tolist(), strict=True):
        runs[t].append({"start": s, "length": e - s, "period": q})
    for t in set(text.tolist()):
        words[t] = [w for w, gone in zip(words[t], dropped[begins[t] : ends[t]].tolist(), strict=True) if not gone]
    return runs, [b" ".join(w) for w in words]


def periodic_runs(docs: DataFrame, *, text_col: str = "text", min_words: int = 24, min_periods: int = 3) -> DataFrame:
    """docs plus `runs`, an array of (start, length, period) in words from 0, by start, then period; and `collapsed`, the
    words joined by one space without those that a run holds after its first period.

    Words stand between ASCII white space. A run is a longest stretch whose words are the same `period` (its smallest one)
    words apart, of at least min_words words and min_periods (3 or more) periods. Null and empty texts have no runs and an
    empty collapsed text. Each row is looked at by itself, so repeated rows get the same result; existing columns `runs`
    and `collapsed` are replaced. An empty table gives an empty table.
    """
    if min_periods < 3 or min_words < 3:
        raise ValueError("min_periods and min_words are 3 or more")

    @F.arrow_udf("struct<runs: array<struct<start: long, length: long, period: long>>, collapsed: string>")
    def of(texts: pa.Array) -> pa.Array:
        runs, collapsed = [], []
        for part in slices(texts):
            found, kept = _of_part(part, min_words, min_periods)
            runs.append(pa.array(found, _RUNS))
            collapsed.append(pa.array(kept, pa.binary()).cast(pa.string()))
        both = [pa.concat_arrays(x) if x else pa.array([], kind) for x, kind in ((runs, _RUNS), (collapsed, pa.string()))]
        return pa.StructArray.from_arrays(both, ["runs", "collapsed"])

    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("runs", "collapsed")]
    looked = docs.select(F.struct(*others).alias("row"), of(utf8(F.col(f"`{text_col}`"))).alias("found"))
    return looked.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("runs", "collapsed")), "found.runs", "found.collapsed")


def most_periods(runs: Column) -> Column:
    """The run with the greatest exact length / period, the first of equally great ones; null without runs."""
    more = lambda best, r: best.isNull() | (r.length * best.period > best.length * r.period)
    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda best, r: F.when(more(best, r), r).otherwise(best))


def with_cycle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs whose words repeat from some word on, in every tenth text by the crc32 of its id: test cases of known period.

    With h the hash, g = h div 10 and n words: from word g mod n on the words repeat with period 1 + (n - g mod n) div (3 + g mod 8).
    """
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def cycled(found: Column) -> Column:
        n = F.size(found).cast("long")
        g = F.floor(h / 10).cast("long")
        a = F.when(n > 0, g % n)
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(found, at(i).cast("int"))), " ")

    # one element, so that the words are worked out once
    repeated = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, cycled(w)).otherwise(F.lit("")))[0]
    return docs.withColumn(text_col, F.when(h % 10 == 0, repeated).otherwise(F.col(f"`{text_col}`")))
