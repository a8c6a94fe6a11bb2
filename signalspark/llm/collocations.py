"""Phrases whose words belong together, counted in an index of word ids for each shard.

A shard is a bounded stretch of a partition's texts as one row of word ids, a zero between pieces. Its FM-index has the
Burrows-Wheeler transforms of the row and of the reversed row, both sorted to the depth of the longest phrase; an interval
of one is kept in step with that of the other, so a phrase can be extended on either side. All intervals of a depth
are extended at once. Counts are summed across shards.

Phrases are followed only while they may be frequent: after words, and after each depth, hashes of what is frequent in
the whole corpus are set in a bitmap of fixed size that the tasks look up. A bit that is set by
chance costs a row more and changes no result; counts are summed by the phrase itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, stored, utf8

#: A-Z folded, what ends a piece made a full stop, tabs made spaces.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")
#: A shard ends with the text that fills it: bytes of text, and distinct words.
_SHARD_BYTES, _SHARD_WORDS = 4 << 20, 1 << 17
#: Shards for each part of what is counted, at most.
_PART_SHARDS = 4


def shards(docs: DataFrame, text_col: str, group_col: str) -> DataFrame:
    """(ids, words, groups, times): a row for each shard; a word's id, in planes of bytes, is its place in `words`, counted from 1.

    Words are in order, so that those beside one another are alike and take less room once they are compressed."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, dict[bytes, int]] = {}
        rows: list[np.ndarray] = []
        number, size = count(1), 0
        for batch in batches:
            for group, text in zip(*batch.columns, strict=True):
                group, text = group.as_py(), text.as_py()
                code = codes.setdefault(group, defaultdict(number.__next__, {b".": 0}))
                words = text.translate(_PLAIN).replace(b".", b" . ").split()
                rows.append(np.fromiter(map(code.__getitem__, words), np.int32, len(words)))
                rows.append(_BREAK)
                size += len(text)
                if size >= _SHARD_BYTES or sum(map(len, codes.values())) >= _SHARD_WORDS:
                    yield _shard(rows, codes)
                    codes, rows, number, size = {}, [], count(1), 0
        if rows:
            yield _shard(rows, codes)

    kinds = "ids binary, words array<binary>, groups array<string>, times array<long>"
    return docs.select(F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit("und")).alias("g"), utf8(F.col(f"`{text_col}`")).alias("t")).mapInArrow(build, kinds)


_BREAK = np.zeros(1, np.int32)


def _shard(rows: list[np.ndarray], codes: dict[str, dict[bytes, int]]) -> pa.RecordBatch:
    named = sorted((g, w, i) for g, code in codes.items() for w, i in code.items() if i)
    place = np.zeros(len(named) + 1, np.int32)
    place[[i for _, _, i in named]] = np.arange(1, len(named) + 1)
    ids = place[np.concatenate(rows)]
    times = np.bincount(ids, minlength=len(named) + 1)[1:]
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [pa.array([_planes(ids, 4)], pa.binary()), one([w for _, w, _ in named], pa.binary()), one([g for g, _, _ in named], pa.string()), one(times, pa.int64())],
        ["ids", "words", "groups", "times"],
    )


class WordIndex:
    """A bidirectional FM-index of a row of word ids in which 0 ends a piece, for phrases of up to `depth` words."""

    def __init__(self, ids: np.ndarray, depth: int):
        self.n, self.kinds = len(ids), int(ids.max(initial=0)) + 1
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=self.kinds))))
        self._ids, self._depth = ids, depth
        self._ranks: dict[bool, np.ndarray] = {}

    @cached_property
    def before(self) -> np.ndarray:
        """What comes before each place of the sorted row."""
        return self._transform(self._ids, self._depth)

    @cached_property
    def after(self) -> np.ndarray:
        """What comes after each place of the sorted reversed row."""
        return self._transform(self._ids[::-1], self._depth)

    def _transform(self, ids: np.ndarray, depth: int) -> np.ndarray:
        """The word before each place of the row, the places sorted by their next `depth` words; the row is a circle."""
        bits = max(1, (self.kinds - 1).bit_length())
        order, done = None, depth
        while done > 0:  # from the last words to the first, as many at a time as 63 bits hold
            take = min(done, max(1, 63 // bits))
            key = np.zeros(self.n, np.int64)
            for k in range(done - take, done):
                key <<= bits
                key |= np.roll(ids, -k)
            order = np.argsort(key) if done == depth else order[np.argsort(key[order], kind="stable")]
            done -= take
        return ids[order - 1]

    def rank(self, left: bool, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each word stands in the transform before each place."""
        transform = self.before if left else self.after
        if left not in self._ranks:
            at = transform.astype(np.int64)
            at *= self.n
            at += np.arange(self.n)
            at.sort()
            self._ranks[left] = at
        return np.searchsorted(self._ranks[left], word.astype(np.int64) * self.n + place) - self.starts[word]

    def words(self) -> Phrases:
        """All words, as phrases of one."""
        word = np.flatnonzero(np.diff(self.starts))
        word = word[word > 0]
        return Phrases(word[:, None], self.starts[word], self.starts[word], self.starts[word + 1] - self.starts[word])

    def extended(self, phrases: Phrases, *, left: bool) -> Phrases:
        """Every phrase that is one of `phrases` and a word more on the left, or on the right."""
        here, there = (phrases.forward, phrases.backward) if left else (phrases.backward, phrases.forward)
        transform = self.before if left else self.after
        begins = np.cumsum(phrases.times) - phrases.times
        inside = np.arange(int(phrases.times.sum()))  # the places of all intervals, one interval after the other
        inside += np.repeat(here - begins, phrases.times)
        pair = np.repeat(np.arange(len(here)) * self.kinds, phrases.times)
        pair += transform[inside]
        del inside
        pair.sort()
        new = np.flatnonzero(np.diff(pair, prepend=-1) != 0)
        times = np.diff(new, append=len(pair))
        number, word = pair[new] // self.kinds, pair[new] % self.kinds
        # the interval of the other direction is cut in the order of the words
        cut = there[number] + (new - begins[number])
        inner = word > 0
        number, word, times, cut = number[inner], word[inner], times[inner], cut[inner]
        own = self.starts[word] + self.rank(left, word, here[number])
        old = phrases.word[number]
        both = np.concatenate((word[:, None], old) if left else (old, word[:, None]), axis=1)
        return Phrases(both, own if left else cut, cut if left else own, times)


class Phrases:
    """Phrases as rows of word ids, where their intervals begin in either direction, and their number of occurrences."""

    def __init__(self, word: np.ndarray, forward: np.ndarray, backward: np.ndarray, times: np.ndarray):
        self.word, self.forward, self.backward, self.times = word, forward, backward, times

    def __getitem__(self, chosen: np.ndarray) -> Phrases:
        return Phrases(self.word[chosen], self.forward[chosen], self.backward[chosen], self.times[chosen])


def _phrase_hash(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of word ids."""
    out = np.full(len(word), word.shape[1], np.uint64)
    for k in range(word.shape[1]):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[word[:, k]])
    return out


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    at = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _bitmap(hashes: DataFrame, size: int) -> np.ndarray:
    """A bitmap of `size` bits, those of the lowest bits of the hashes `h` set."""
    at = F.col("h").bitwiseAND(F.lit(size - 1))
    # buckets of 32768 bits are counted from 1, and so are the bits that the functions take
    parts = hashes.select(F.bitmap_bucket_number(at + 1).alias("part"), F.bitmap_bit_position(at + 1).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for part, bits in parts.toLocalIterator():
        out[(part - 1) * 4096 : (part - 1) * 4096 + len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def _enumerated(index: WordIndex, hashes: np.ndarray, maps: list[np.ndarray], most: int) -> Iterator[Phrases]:
    """The phrases of two words, of three, and so on to `most`, whose parts one word shorter the bitmaps hold (one bitmap
    for each number of words) and which they hold themselves, where there is a bitmap for their number."""
    phrases = index.words()
    parts = _held(maps[0], hashes)
    phrases = phrases[parts[phrases.word[:, 0]]]
    for size in range(2, most + 1):
        phrases = index.extended(phrases, left=size % 2 == 1)
        held = np.ones(len(phrases.times), bool)
        for part in (phrases.word[:, :-1], phrases.word[:, 1:]):
            held &= parts[part[:, 0]] if size == 2 else _held(maps[size - 2], _phrase_hash(hashes, part))
        phrases = phrases[held]
        if size <= len(maps):
            phrases = phrases[_held(maps[size - 1], _phrase_hash(hashes, phrases.word))]
        yield phrases


_ROWS, _WAITING = 1 << 17, 1 << 20
#: Bits of a hash that are counted. Two phrases of one hash are looked at again, by themselves, so it needn't be longer.
_BITS = 40


def _planes(values: np.ndarray, size: int) -> bytes:
    """Whole numbers as planes of bytes, the lowest first: planes of zeros take no room once they are compressed."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _from_planes(data: bytes, size: int) -> np.ndarray:
    wide = np.zeros((len(data) // size, 8), np.uint8)
    wide[:, :size] = np.frombuffer(data, np.uint8).reshape(size, -1).T
    return wide.view("<u8").ravel()


def _summed(h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, with the sums of their counts."""
    order = np.argsort(h)
    h, f = h[order], f[order]
    first = np.flatnonzero(np.diff(h, prepend=h[:1] + 1) != 0)
    return h[first], np.add.reduceat(f, first) if len(first) else f


def _frequent_hashes(table: DataFrame, maps: list[np.ndarray], min_count: int, n: int) -> DataFrame:
    """(h, f): the hashes of phrases one word longer than there are bitmaps that occur min_count times or more.

    A shard's hashes go out in order, as differences, a row for each range of hashes; a task sums those of its ranges.
    """
    sent, n = table.sparkSession.sparkContext.broadcast(maps), 3 * n  # hardly two of a shard's phrases are alike, so what is counted is large

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.array([(k << _BITS) // n for k in range(1, n)], np.uint64)
        for index, hashes, _, _ in _indexes(batches, len(sent.value) + 1):
            *_, phrases = _enumerated(index, hashes, sent.value, len(sent.value) + 1)
            h, f = _summed(_phrase_hash(hashes, phrases.word) & np.uint64((1 << _BITS) - 1), phrases.times.astype(np.uint64))
            cuts = [0, *np.searchsorted(h, ends).tolist(), len(h)]
            rows = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            columns = [
                pa.array([k for k, _, _ in rows], pa.int32()),
                pa.array([_planes(np.diff(h[a:b], prepend=np.uint64(0)), 5) for _, a, b in rows], pa.binary()),
                pa.array([_planes(f[a:b], 5) for _, a, b in rows], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "h", "f"])

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, size = (np.zeros(0, np.uint64), np.zeros(0, np.uint64)), [], 0
        for batch in batches:
            for h, f in zip(batch.column("h"), batch.column("f"), strict=True):
                waiting.append((np.cumsum(_from_planes(h.as_py(), 5)), _from_planes(f.as_py(), 5)))
                size += len(waiting[-1][0])
                if size > 1 << 20:
                    total, waiting, size = _summed(*map(np.concatenate, zip(total, *waiting, strict=True))), [], 0
        h, f = _summed(*map(np.concatenate, zip(total, *waiting, strict=True)))
        often = f >= min_count
        yield pa.RecordBatch.from_arrays([pa.array(h[often].astype(np.int64)), pa.array(f[often].astype(np.int64))], ["h", "f"])

    return table.mapInArrow(counted, "part int, h binary, f binary").repartitionById(n, "part").mapInArrow(frequent, "h long, f long")


def _packed(part: np.ndarray, group: pa.Array, phrase: pa.Array, times: np.ndarray) -> pa.RecordBatch:
    """(part, g, n, size, data): a row for each stretch of phrases of one part and group: the compressed n counts and texts."""
    group = group.dictionary_encode()
    code = group.indices.to_numpy()
    cuts = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
    ends = np.append(cuts[1:], len(part))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(cuts, len(part)), pa.int32()), phrase), b"\n")
    plain = [_planes(times[a:b], 4) + text.as_py() for a, b, text in zip(cuts, ends, texts, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(part[cuts], pa.int32()), group.take(pa.array(cuts)).cast(pa.string()), pa.array(ends - cuts, pa.int32()), pa.array([len(x) for x in plain], pa.int32()), pa.array([pa.compress(x, "zstd", asbytes=True) for x in plain], pa.binary())],
        ["part", "g", "n", "size", "data"],
    )


def _sums(tables: list[pa.Table]) -> pa.Table:
    """(g, phrase, f): the sums of the counts."""
    sums = pa.concat_tables(tables).group_by(["g", "phrase"], use_threads=False).aggregate([("f", "sum")])
    return sums.select(["g", "phrase", "f_sum"]).rename_columns(["g", "phrase", "f"])


def _summed_texts(rows: DataFrame, n: int, min_count: int) -> DataFrame:
    """(g, phrase, size, f): packed rows summed by the phrase itself, of those that occur min_count times or more."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, new = [], 0
        for batch in batches:
            for g, k, size, data in zip(*(batch.column(c).to_pylist() for c in ("g", "n", "size", "data")), strict=True):
                plain = pa.decompress(data, size, "zstd", asbytes=True)
                text = pc.split_pattern(pa.array([plain[4 * k :]], pa.binary()), b"\n").flatten()
                times = pa.array(_from_planes(plain[: 4 * k], 4).astype(np.int64))
                waiting.append(pa.table([pa.repeat(pa.scalar(g), k), text, times], ["g", "phrase", "f"]))
                new += k
                if new > max(_WAITING, len(waiting[0])):  # the first may be the sums so far
                    waiting, new = [_sums(waiting)], 0
        if waiting:
            found = _sums(waiting)
            for batch in found.filter(pc.greater_equal(found["f"], min_count)).combine_chunks().to_batches(_ROWS):
                size = pc.add(pc.count_substring(batch["phrase"], b" "), 1).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([batch["g"], batch["phrase"], size, batch["f"]], ["g", "phrase", "size", "f"])

    return rows.repartitionById(n, "part").mapInArrow(summed, "g string, phrase binary, size int, f long")


_PACKED = "part int, g string, n int, size int, data binary"


def _word_counts(table: DataFrame, n: int) -> DataFrame:
    """(g, phrase, size, f): how often each word occurs."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, groups, times, hashes in zip(*(batch.column(c) for c in ("words", "groups", "times", "hashes")), strict=True):
                if len(words):
                    part = _part(hashes.values.to_numpy().view(np.uint64), n)
                    order = np.argsort(part, kind="stable")
                    yield _packed(part[order], groups.values.take(pa.array(order)), words.values.take(pa.array(order)), times.values.to_numpy()[order])

    return _summed_texts(table.select("words", "groups", "times", "hashes").mapInArrow(packed, _PACKED), n, 1)


def _part(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(n)).astype(np.int32)


def _phrase_counts(table: DataFrame, maps: list[np.ndarray], min_count: int, n: int) -> DataFrame:
    """(g, phrase, size, f): how often each phrase of two words and more occurs that the bitmaps hold, of those that occur
    min_count times or more.

    A shard's phrases go out in order, those of a part compressed in one row; a task sums those of its parts."""
    sent = table.sparkSession.sparkContext.broadcast(maps)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = len(sent.value)
        for index, hashes, words, groups in _indexes(batches, most):
            word, times, part = [np.zeros((0, most), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for kept in _enumerated(index, hashes, sent.value, most):
                word.append(np.pad(kept.word, ((0, 0), (0, most - kept.word.shape[1]))))
                times.append(kept.times)
                part.append(_part(_phrase_hash(hashes, kept.word), n))
            word, times, part = map(np.concatenate, (word, times, part))
            # words are in the order of their groups, so phrases of a part are
            order = np.lexsort((*word.T[::-1], part))
            for a in range(0, len(order), _ROWS):
                chosen = order[a : a + _ROWS]
                # no word is 0, which stands after the last one: nothing is joined there
                text = pc.binary_join_element_wise(*(words.take(pa.array(word[chosen, k] - 1, mask=word[chosen, k] == 0)) for k in range(most)), b" ", null_handling="skip")
                yield _packed(part[chosen], groups.take(pa.array(word[chosen, 0] - 1)), text, times[chosen])

    return _summed_texts(table.mapInArrow(packed, _PACKED), n, min_count)


def _parts_of(table: DataFrame) -> int:
    """How many parts what is counted is dealt to, a partition each: the partitions of other shuffles, or one for each
    _PART_SHARDS shards where that is more, so that what a task holds doesn't grow with the table."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // _PART_SHARDS))


def _indexes(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[WordIndex, np.ndarray, pa.Array, pa.Array]]:
    """For each shard its index, the hashes of its words by id (0 first), the words and their groups."""
    for batch in batches:
        for row in range(batch.num_rows):
            ids = _from_planes(batch.column("ids")[row].as_py(), 4).astype(np.int32)
            hashes = np.concatenate((np.zeros(1, np.int64), batch.column("hashes")[row].values.to_numpy())).view(np.uint64)
            yield WordIndex(ids, depth), hashes, batch.column("words")[row].values, batch.column("groups")[row].values


def phrase_counts(docs: DataFrame, *, text_col: str = "text", group_col: str = "lang", max_words: int = 3, min_count: int = 10, filter_bits: int = 1 << 26) -> tuple[DataFrame, DataFrame]:
    """(g, phrase, size, f) of the phrases of 1 to max_words words that occur min_count times or more in a group, and (g, n).

    A-Z are lower-cased; texts fall into pieces at .,;:!? and line ends and those into words at spaces and tabs; phrases
    are contiguous within a piece, overlapping ones count. A null group is `und`; null and empty texts have no words.
    filter_bits, a power of two from 32768 on, is the size of each of the max_words bitmaps that are broadcast.
    """
    if not 32768 <= filter_bits <= 1 << _BITS or filter_bits & filter_bits - 1 or max_words < 2:
        raise ValueError("filter_bits is a power of two from 32768 on, max_words is 2 or more")
    # hashes are worked out where they are needed: kept, they would be a quarter of the table
    table = stored(shards(docs, text_col, group_col), "zstd").withColumn("hashes", F.zip_with("groups", "words", lambda g, w: F.xxhash64(g, w)))
    parts = _parts_of(table)
    words = stored(_word_counts(table, parts), "zstd")
    total = words.groupBy("g").agg(F.sum("f").alias("n"))
    one = words.filter(F.col("f") >= min_count)
    index = table.select("ids", "hashes", "words", "groups")
    maps = [_bitmap(one.select(F.xxhash64("g", "phrase").alias("h")), filter_bits)]
    while len(maps) < max_words:
        maps.append(_bitmap(_frequent_hashes(index, maps, min_count, parts), filter_bits))
    counts = one.unionByName(_phrase_counts(index, maps, min_count, parts))
    return stored(counts.withColumn("phrase", F.col("phrase").cast("string"))), total


def _parts(phrase: Column, first: Column | int, size: Column | int) -> Column:
    """The words of a phrase from place `first` (1 on), `size` of them."""
    return F.array_join(F.slice(F.split(phrase, " ", -1), first, size), " ")


def collocations(docs: DataFrame, *, text_col: str = "text", group_col: str = "lang", max_words: int = 3, min_count: int = 10, absorbed_per_100: int = 50, top: int = 2000, filter_bits: int = 1 << 26) -> DataFrame:
    """(group_col, rank, phrase, a, l, r, n, score, left_most, right_most): each group's `top` phrases of 2 to max_words words.

    a is how often the phrase occurs; a cut after k words gives l and r, how often its parts occur, and the score
    floor(1,000,000 a a / (l r)); the cut of least score counts, then of least k. Phrases inside a longer phrase that
    occurs at least absorbed_per_100 percent as often are dropped. left_most and right_most are the counts of the most
    frequent extension by a word on either side (0 for none that is frequent). Order: score, a (both descending), phrase by
    its bytes. n is the number of words of the group. Texts and groups: see phrase_counts. Repeated rows count as often as
    they occur. Other columns of docs are not looked at. Without frequent phrases the result is empty.
    """
    counts, total = phrase_counts(docs, text_col=text_col, group_col=group_col, max_words=max_words, min_count=min_count, filter_bits=filter_bits)
    phrases = counts.filter("size > 1")
    # parts of each phrase: for each cut the first and the rest
    cuts = phrases.select("g", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size")
    cuts = cuts.select("g", "phrase", "a", "k", _parts(F.col("phrase"), F.lit(1), F.col("k")).alias("first"), _parts(F.col("phrase"), F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    left, right = (counts.select(F.col("g").alias(f"g_{x}"), F.col("phrase").alias(x), F.col("f").alias(y)) for x, y in (("first", "l"), ("rest", "r")))
    cut = cuts.join(left, (F.col("g") == F.col("g_first")) & (cuts["first"] == left["first"])).drop("g_first", "first")
    cut = cut.join(right, (F.col("g") == F.col("g_rest")) & (cut["rest"] == right["rest"])).drop("g_rest", "rest")
    # exact: counts of up to 18 digits, products of up to 38
    score = F.expr("cast((cast(a as decimal(18,0)) * cast(a as decimal(18,0)) * 1000000BD) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)")
    scored = cut.withColumn("score", score).groupBy("g", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best"))
    # what each phrase has inside, and how it is extended
    longer = phrases.filter("size > 2").select("phrase", "g", "f", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("inner"))
    longer = longer.select("phrase", "g", "f", "size", "inner", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("inner") + 1)).alias("first"))
    by_one = F.col("size") == F.col("inner") + 1
    inside = longer.select("g", _parts(F.col("phrase"), F.col("first"), F.col("inner")).alias("phrase"), "f", F.when(by_one & (F.col("first") == 2), F.col("f")).alias("left"), F.when(by_one & (F.col("first") == 1), F.col("f")).alias("right"))
    around = inside.groupBy("g", "phrase").agg(F.max("f").alias("most"), F.max("left").alias("left_most"), F.max("right").alias("right_most"))
    joined = scored.join(around, ["g", "phrase"], "left").filter(F.coalesce(100 * F.col("most") < absorbed_per_100 * F.col("best.a"), F.lit(True)))
    order = Window.partitionBy("g").orderBy(F.col("best.score").desc(), F.col("best.a").desc(), F.col("phrase"))
    ranked = joined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).join(total, "g")
    most = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return ranked.select(F.col("g").alias(group_col), F.col("rank").cast("long").alias("rank"), "phrase", "best.a", "best.l", "best.r", "n", "best.score", most("left_most"), most("right_most"))
