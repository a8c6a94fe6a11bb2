"""Benchmark decontamination with training suffix arrays.

Each batch of training documents is a shard: its words that the benchmark also uses become a sequence of numbers, and the
suffixes that can begin a match are sorted. Every test suffix that holds a whole window is binary-searched in them (equal
windows once), which gives all places of its window; from there the match is followed on through the sorted test
suffixes to its full length, so each document gets its longest verbatim match, with its place there and in the item.
The benchmark is cut in blocks of bounded size. One block is broadcast at a time and held against all documents; with
more than one, what each finds is stored and its broadcast released before the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLD, Words, byte_class, slices, stored, utf8

#: Word bytes: letters and digits of ASCII, and every byte of other code points.
WORD = byte_class(without=bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
WORD[65:91] = True  # A-Z are folded to a-z before words are taken


@dataclass
class TestSet:
    """One block of benchmark items as word numbers, its sorted suffixes, and the distinct windows that they begin with."""

    vocabulary: np.ndarray  # sorted hashes of its words; a word's number is its place plus 1
    text: np.ndarray  # word numbers of all items, a 0 after each
    order: np.ndarray  # the sorted suffixes that hold a full window
    begin: np.ndarray  # where each distinct window begins in text
    size: np.ndarray  # words of each window
    low: np.ndarray  # the suffixes in `order` that begin with it, low..high; none for items shorter than a window
    high: np.ndarray
    owners: list[np.ndarray]  # numbers of the items, for each window
    items: list[str | None]
    item: np.ndarray  # item number of each place of text
    first: np.ndarray  # where each item begins in text


def test_set(items: list[tuple[str | None, bytes]], window: int) -> TestSet:
    words = Words([t for _, t in items], WORD, FOLD)
    hashes, counts = words.hashes(), words.counts()
    vocabulary = np.unique(hashes)
    number = (np.searchsorted(vocabulary, hashes) + 1).astype(np.int32)
    text = np.concatenate((np.insert(number, np.cumsum(counts), 0), np.zeros(window, np.int32)))
    item = np.append(np.repeat(np.arange(len(items)), counts + 1), np.full(window, len(items)))
    first = np.cumsum(counts + 1) - counts - 1
    left = np.append(first + counts, 0)[np.minimum(item, len(items))] - np.arange(len(text))
    order = sorted_suffixes(text)
    order = order[left[order] >= window]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in range(window):
            new[1:] |= text[order[1:] + k] != text[order[:-1] + k]
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(order)).astype(np.int64) if len(low) else low
    owners = [np.unique(x) for x in np.split(item[order], low[1:])] if len(low) else []
    begin, size = order[low], np.full(len(low), window)
    short: dict[bytes, tuple[int, int, list[int]]] = {}
    for i in np.flatnonzero((counts > 0) & (counts < window)).tolist():
        at, n = int(first[i]), int(counts[i])
        short.setdefault(text[at : at + n].tobytes(), (at, n, []))[2].append(i)
    more = list(short.values())
    none = np.zeros(len(more), np.int64)
    begin = np.append(begin, np.array([w[0] for w in more], np.int64))
    size = np.append(size, np.array([w[1] for w in more], np.int64))
    return TestSet(vocabulary, text, order, begin, size, np.append(low, none), np.append(high, none), [*owners, *(np.array(w[2]) for w in more)], [i for i, _ in items], item, first)


def sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of text, by ranks of twice the length in each round."""
    order = np.argsort(text, kind="stable")
    rank, h, n = text.astype(np.int64), 1, len(text)
    while h < n:
        following = np.zeros(n, np.int64)
        following[:-h] = rank[h:] + 1
        key = rank * (int(following.max()) + 1) + following
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
        if rank[order[-1]] == n - 1:
            break
        h *= 2
    return order


def suffix_array(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places `at` of text in the order of the `depth` numbers that follow each."""
    rank = text[at].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    grouped = rank[order]
    for k in range(1, depth):
        same = np.flatnonzero(grouped[1:] == grouped[:-1])
        if not len(same):
            break
        # only suffixes that are still tied are compared further
        tied = np.unique(np.concatenate((same, same + 1)))
        part = order[tied]
        following = text[at[part] + k]
        inner = np.lexsort((following, grouped[tied]))
        order[tied] = part[inner]
        new = np.ones(len(order), bool)
        new[1:] = grouped[1:] != grouped[:-1]
        value, before = following[inner], grouped[tied]
        changed = np.ones(len(tied), bool)
        changed[1:] = (value[1:] != value[:-1]) | (before[1:] != before[:-1])
        new[tied] |= changed
        grouped = np.cumsum(new)
    return at[order]


def binary_search(text: np.ndarray, suffixes: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """For each window the range of sorted suffixes that begin with it.

    All windows are searched together, a word further each time: within one word's depth, (group of the words
    before, word) rises along the suffix array.
    """
    n = len(tests.begin)
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    group, base = np.zeros(len(suffixes), np.int64), len(tests.vocabulary) + 1
    alive, at_group = np.arange(n), np.zeros(n, np.int64)
    for k in range(int(tests.size.max())):
        alive = alive[tests.size[alive] > k]
        if not len(alive):
            break
        key = group * base + text[suffixes + k]
        target = at_group[alive] * base + tests.text[tests.begin[alive] + k]
        a, b = np.searchsorted(key, target, "left"), np.searchsorted(key, target, "right")
        low[alive], high[alive] = a, b
        going = a < b
        alive = alive[going]
        group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        at_group[alive] = group[a[going]]
    return low, high


def within(values: np.ndarray, low: np.ndarray, high: np.ndarray, target: np.ndarray, strict: bool) -> np.ndarray:
    """For each range low..high of the rising values[low:high] the first place that is >= target (> if strict)."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        value = values(np.minimum(middle, np.maximum(high - 1, 0)))
        right = open_ & ((value <= target) if strict else (value < target))
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)
    return low


def extended(text: np.ndarray, at: np.ndarray, window: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """For places of text and the window at each: words of the longest match that begins there, or 0 where the one from
    the place before only loses its first word, and where a test suffix that it follows begins.

    All places go on together, a word at a time, through the range of test suffixes that agree so far.
    """
    length, begin = tests.size[window].copy(), tests.begin[window].copy()
    low, high = tests.low[window], tests.high[window]
    alive = np.flatnonzero(high > low)
    k = int(tests.size[window[alive]].max()) if len(alive) else 0
    alive = alive[np.argsort(at[alive], kind="stable")]
    while len(alive):
        word = text[at[alive] + k]
        following = lambda i, k=k: tests.text[tests.order[i] + k]
        a = within(following, low[alive], high[alive], word, False)
        b = within(following, low[alive], high[alive], word, True)
        going = (word > 0) & (a < b)
        # as many test suffixes go on from the place before as have come along from this one: they are the same, less a word
        tail = np.zeros(len(alive), bool)
        tail[1:] = (np.diff(at[alive]) == 1) & going[:-1] & ((high - low)[alive][1:] == (b - a)[:-1])
        length[alive[tail]] = 0
        going &= ~tail
        alive, a, b = alive[going], a[going], b[going]
        k += 1
        low[alive], high[alive], length[alive], begin[alive] = a, b, k, tests.order[a]
    return length, begin


def search_shard(texts: list[bytes], tests: TestSet) -> list[tuple[int, list[int], list[int], tuple[int, int, int, int] | None]]:
    """For each text: how many words, the places of hit words, the items that occur, and the longest verbatim match of a
    window or more, as (words, place in the text, item, place in the item); the first of equally long ones."""
    words = Words(texts, WORD, FOLD)
    counts = words.counts()
    ends = np.cumsum(counts)
    out: list[tuple] = [(n, [], [], None) for n in counts.tolist()]
    if not len(tests.begin) or not len(words.row):
        return out
    hashes = words.hashes()
    place = np.minimum(np.searchsorted(tests.vocabulary, hashes), len(tests.vocabulary) - 1)
    number = np.where(tests.vocabulary[place] == hashes, place + 1, 0).astype(np.int32)
    # words outside the benchmark, and a gap after each text, end every match
    depth = int(tests.size.max())
    text = np.concatenate((np.insert(number, ends, 0), np.zeros(depth + 1, np.int32)))
    known, gap = np.flatnonzero(text), np.flatnonzero(text == 0)
    run = gap[np.searchsorted(gap, known)] - known  # words until the next gap
    starts = known[run >= tests.size.min()]
    starts = starts[np.isin(text[starts], tests.text[tests.begin])]
    if not len(starts):
        return out
    suffixes = suffix_array(text, starts, depth)
    low, high = binary_search(text, suffixes, tests)
    times = high - low
    window = np.repeat(np.arange(len(times)), times)
    at = suffixes[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())]
    row = np.searchsorted(ends + np.arange(1, len(ends) + 1), at, "right")
    cover = np.zeros(len(number) + 1, np.int64)
    np.add.at(cover, at - row, 1)
    np.add.at(cover, at - row + tests.size[window], -1)
    hit = np.cumsum(cover)[:-1] > 0
    length, begin = extended(text, at, window, tests)
    # by text: its windows together, and of its matches the longest first
    by_row = np.lexsort((begin, at, -length, row))
    cuts = np.append(np.flatnonzero(np.diff(row[by_row], prepend=-1)), len(row)).tolist()
    for a, b in pairwise(cuts):
        best = by_row[a]
        r, item = int(row[best]), int(tests.item[begin[best]])
        places = np.flatnonzero(hit[ends[r] - counts[r] : ends[r]])
        items = set().union(*(tests.owners[w].tolist() for w in np.unique(window[by_row[a:b]]).tolist()))
        longest = int(length[best]), int(at[best] - r - (ends[r] - counts[r])), item, int(begin[best] - tests.first[item])
        out[r] = int(counts[r]), places.tolist(), sorted(items), longest
    return out


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_mb: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of at most block_mb MB, each collected when it is asked for (an item over a quarter of that may
    make its block as much longer). Spark deals the items by hash and sums their sizes; the driver packs the sums."""
    text = utf8(F.col(f"`{text_col}`"))
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), text.alias("text"), F.length(text).alias("n")).filter("n > 0")
    limit = block_mb * 1_000_000
    total = rows.agg(F.sum("n")).first()[0] or 0
    rows = rows.withColumn("part", F.pmod(F.xxhash64("text", "item"), F.lit(8 * int(total // limit) + 1)))
    blocks, room = [[]], limit
    for part, n in sorted(tuple(r) for r in rows.groupBy("part").agg(F.sum("n")).collect()):
        if blocks[-1] and n > room:
            blocks.append([])
            room = limit
        blocks[-1].append(part)
        room -= n
    for parts in blocks:
        yield [(r.item, bytes(r.text)) for r in rows.filter(F.col("part").isin(parts)).select("item", "text").collect()]


_LONGEST = pa.struct([("words", pa.int64()), ("at", pa.int64()), ("item", pa.string()), ("item_at", pa.int64())])
_RESULT = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("longest", _LONGEST)])
_COMPILED: dict = {}


def _compiled(name: str, items: list[tuple[str | None, bytes]], window: int) -> TestSet:
    """A block, ready to be searched for; a worker keeps the one it used last."""
    if _COMPILED.get("name") != (name, window):
        _COMPILED.update(name=(name, window), tests=test_set(items, window))
    return _COMPILED["tests"]


def _match(shared: Broadcast, window: int) -> Callable[[Column], Column]:
    @F.arrow_udf("struct<n_words: bigint, hits: array<int>, items: array<string>, longest: struct<words: bigint, at: bigint, item: string, item_at: bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        tests = _compiled(*shared.value, window)
        rows = []
        for n, hits, own, longest in (x for part in slices(texts) for x in search_shard(part, tests)):
            names = sorted({tests.items[i] for i in own}, key=lambda i: (i is None, i or ""))
            words, at, item, item_at = longest or (0, None, None, None)
            rows.append({"n_words": n, "hits": hits, "items": names, "longest": {"words": words, "at": at, "item": None if item is None else tests.items[item], "item_at": item_at}})
        return pa.array(rows, _RESULT)

    return of


def matches(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_mb: int = 16) -> DataFrame:
    """docs plus `match`: n_words, hits (places of hit words), items (sorted ids as strings, null last), and longest, the
    longest verbatim match of a window or more (words, at, item, item_at; 0 and null without one; places count words from
    0; the first of equally long ones; which one of several items that hold it alike may vary).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window.
    Items without an id are searched for like others and share the id null.
    """
    text = utf8(F.col(f"`{text_col}`"))
    hashes = (F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"))
    context = docs.sparkSession.sparkContext
    blocks = _item_blocks(benchmark, item_col, item_text_col, block_mb)
    items, earlier = next(blocks), None
    for following in blocks:
        shared = context.broadcast((uuid4().hex, items))
        found = docs.select(*hashes, _match(shared, window)(text).alias("m")).filter(F.size("m.hits") > 0)
        found = stored(found.dropDuplicates(["t1", "t2"]))
        shared.destroy()
        earlier, items = found if earlier is None else earlier.unionByName(found), following
    last = _match(context.broadcast((uuid4().hex, items)), window)(text)
    if earlier is None:
        return docs.withColumn("match", last)
    # one row for each block that a text was hit by, so the lists are as long as the benchmark has blocks
    sets = [F.array_distinct(F.flatten(F.collect_list(f"m.{c}"))).alias(c) for c in ("hits", "items")]
    # the longest, of those the first, of those the least item
    rank = lambda x: F.struct((-F.col(f"{x}.words")).alias("less"), F.col(f"{x}.at").alias("at"), F.col(f"{x}.item").isNull().alias("unnamed"), F.col(f"{x}.item").alias("item"), F.col(f"{x}.item_at").alias("item_at"))
    longest = F.min_by("m.longest", rank("m.longest")).alias("longest")
    before = earlier.groupBy("t1", "t2").agg(*sets, longest).select("t1", "t2", F.struct("hits", "items", "longest").alias("before"))
    both = F.struct(
        F.col("match.n_words").alias("n_words"),
        F.array_sort(F.array_union("match.hits", "before.hits")).alias("hits"),
        F.array_sort(F.array_union("match.items", "before.items")).alias("items"),
        F.when(rank("match.longest") <= rank("before.longest"), F.col("match.longest")).otherwise(F.col("before.longest")).alias("longest"),
    )
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *hashes, last.alias("match"))
    joined = rows.join(before, ["t1", "t2"], "left")
    return joined.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), F.when(F.col("before").isNull(), F.col("match")).otherwise(both).alias("match"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, hits_per_100: int = 5, **params) -> DataFrame:
    """docs plus n_words, n_hit, n_items, items_sha256, longest_match (words of the longest verbatim match of a window
    or more, else 0), longest_at, longest_item, longest_item_at (its place, and the item's) and contaminated.

    A document is contaminated if it has a hit word and hit words are at least hits_per_100 of 100. Null and empty
    texts have no words; an item without words has no window; a repeated window or item counts once for each item id.
    Items without an id count as one item in n_items, and add nothing to the names of items_sha256.
    Columns with these names are replaced. Empty tables give no hits or no rows.
    """
    names = ("n_words", "n_hit", "n_items", "items_sha256", "longest_match", "longest_at", "longest_item", "longest_item_at", "contaminated", "match")
    kept = [c for c in docs.columns if c not in names]
    found = matches(docs.select(*(F.col(f"`{c}`") for c in kept)), benchmark, **params)
    n_hit = F.size("match.hits").cast("long")
    return found.select(
        *(F.col(f"`{c}`") for c in kept),
        F.col("match.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("match.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("match.items", ",").cast("binary"), 256).alias("items_sha256"),
        F.col("match.longest.words").alias("longest_match"),
        F.col("match.longest.at").alias("longest_at"),
        F.col("match.longest.item").alias("longest_item"),
        F.col("match.longest.item_at").alias("longest_item_at"),
        ((n_hit > 0) & (100 * n_hit >= hits_per_100 * F.col("match.n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of docs that aren't contaminated, with their own columns."""
    return contamination(docs.withColumn("_own_row", F.struct(*(F.col(f"`{c}`") for c in docs.columns))), benchmark, **params).filter(~F.col("contaminated")).select("_own_row.*")
