"""Suffix-array dedup of byte strings over all documents.

Two equal windows of W bytes choose the same anchor, the window's K-byte gram of least hash. Neighbouring window starts
with one anchor are a run, and a run's bytes are a piece. Copies of a piece are counted by hash, so one piece stands for
all of them; pieces that share an anchor but differ are gathered, and a task merges them block by block: the pieces are
dealt to shards, each shard's suffixes are sorted once and give its Burrows-Wheeler transform, and the transforms are
merged by refining their interleave. Each round deals the rows stably by the symbol before them and steps to the rows
of the suffixes that begin there, so the interleave is in order one byte deeper; no suffix is compared or sorted anew.
A boundary between two rows that appears in round k says that their common prefix is k bytes. Rows that W rounds leave
without a boundary between them are the repeated windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _SPREAD, blobs, mixed, powers, slices, stored, utf8

#: Bytes of a gram; places of a text that are looked at together.
GRAM, STRETCH = 64, 1 << 20


class Hashes:
    """Hashes of any byte ranges of a buffer."""

    def __init__(self, buf: np.ndarray):
        self.forward, self.inverse = powers(len(buf) + 1)
        self.total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_SPREAD[buf] * self.forward[: len(buf)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the place of its least value, the leftmost of equal ones."""
    n = len(values)
    low = np.uint64(2 * STRETCH - 1)
    key = (values & ~low) | np.arange(n, dtype=np.uint64)  # in all texts, equal but for the lowest bits counts as equal
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[: n - width + 1], ahead[width - 1 : n]) & low).astype(np.int64)


def runs_of(text: bytes, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (anchor hash, piece hash, first start, starts, anchor's place in the piece) of a text's runs; no run
    reaches over a stretch."""
    for first in range(0, max(1, len(text) - window + 1), STRETCH):
        buf = np.frombuffer(text[first : first + STRETCH + window - 1], np.uint8)
        if len(buf) < window:
            return
        hashes = Hashes(buf)
        places = np.arange(len(buf) - gram + 1)
        grams = hashes.of(places, places + gram)
        chosen = leftmost_minima(grams, window - gram + 1)
        start = np.flatnonzero(np.diff(chosen, prepend=-1))
        anchor = chosen[start]
        starts = np.diff(start, append=len(chosen))
        piece = hashes.of(start, start + starts + window - 1) ^ mixed((anchor - start).astype(np.uint64))
        yield grams[anchor].view(np.int64), piece.view(np.int64), start + first, starts, anchor - start


_RUN = pa.struct([("g", pa.int64()), ("h", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("a", pa.int32())])


def _lists(parts: list[list[tuple[np.ndarray, ...]]], kind: pa.StructType) -> pa.ListArray:
    """For each row its arrays, as a list of structs."""
    ends = np.cumsum([0, *(sum(len(x[0]) for x in row) for row in parts)]).astype(np.int32)
    flat = [x for row in parts for x in row]
    columns = [pa.array(np.concatenate([x[i] for x in flat]) if flat else [], f.type) for i, f in enumerate(kind)]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=list(kind)))


def _runs(text: Column, window: int, gram: int) -> Column:
    @F.arrow_udf("array<struct<g: bigint, h: bigint, s: int, n: int, a: int>>")
    def of(texts: pa.Array) -> pa.Array:
        return _lists([[(g, h, *(x.astype(np.int32) for x in places)) for g, h, *places in runs_of(t, window, gram)] for part in slices(texts) for t in part], _RUN)

    return of(text)


@dataclass(frozen=True)
class Shard:
    """The transform of some strings, each closed by a sentinel that sorts before all bytes, and by its string's number.

    order: text position of each row (strings one after the other, a sentinel after each); before: the byte before each
    row's suffix (0 at the beginning of a string); first: how many rows begin with a sentinel, and with each byte value.
    """

    order: np.ndarray
    before: np.ndarray
    first: np.ndarray
    starts: np.ndarray  # rows of whole strings: nothing stands before them


def shard_of(strings: list[bytes]) -> Shard:
    """Sorts the suffixes of the strings: the first symbols packed with the position are sorted at once, then suffixes
    that are still tied by the ranks of their halves."""
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    symbol = np.empty(n, np.uint64)  # byte plus 1; 0 is the sentinel
    symbol[:] = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    symbol += np.uint64(1)
    symbol[ends - 1] = 0
    left = np.repeat(ends - 1, sizes) - np.arange(n)  # symbols before the string's sentinel
    bits = n.bit_length()
    depth = (64 - bits) // 9
    packed = symbol.copy()
    for k in range(1, depth):
        packed <<= np.uint64(9)
        ahead = np.zeros(n, np.uint64)
        ahead[:-k] = symbol[k:]
        ahead[left < k] = 0  # nothing behind the sentinel counts
        packed |= ahead
    packed <<= np.uint64(bits)
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << bits) - 1)).astype(np.int32)
    key = packed >> np.uint64(bits)
    # a suffix that has met its sentinel is settled: equal ones stand in the order of their strings
    new = np.diff(key, prepend=~key[:1]) != 0
    new |= left[order] < depth
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(slots):
        at = order[slots]
        packed = rank[at].astype(np.uint64) << np.uint64(bits) | rank[at + depth].astype(np.uint64)
        dealt = np.argsort(packed)
        order[slots] = at = at[dealt]
        packed = packed[dealt]
        new = np.diff(packed, prepend=~packed[:1]) != 0
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        depth *= 2
    before = symbol[order - 1]
    data = (before - np.uint64(1)).astype(np.uint8)
    data[before == 0] = 0
    return Shard(order, data, np.bincount(symbol.astype(np.int64), minlength=257), before == 0)


def merged(shards: list[Shard], depth: int, wanted: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, blocks): rows whose suffixes share their first `depth` bytes with another's, and the number of each one's block.

    Rows of all shards are numbered through. Only the transforms are read. `wanted` marks the rows from which `depth` - 1
    steps to the left stay in their string; others are never asked for. A row alone in its block stays alone with every
    byte before it, so it leaves the merge with the length of its longest common prefix known.
    """
    steps, firsts, offset = [], [], 0
    for shard in shards:  # the row of the suffix that begins a byte earlier: as many rows before it as lesser symbols
        step = np.empty(len(shard.before), np.int32)
        begins = np.flatnonzero(shard.starts)
        inner = np.flatnonzero(~shard.starts)
        step[begins] = np.arange(offset, offset + len(begins))
        step[inner[np.argsort(shard.before[inner], kind="stable")]] = np.arange(offset + len(begins), offset + len(step))
        steps.append(step)
        firsts.append(np.repeat(np.arange(-1, 256), shard.first))
        offset += len(step)
    step, before = np.concatenate(steps), np.concatenate([s.before for s in shards])
    first = np.concatenate(firsts)
    row = np.flatnonzero((first >= 0) & np.concatenate(wanted)).astype(np.int32)
    # interleaved by the first byte: for each byte the rows of the first shard, then the second's
    row = row[np.argsort(first[row].astype(np.uint8), kind="stable")]
    boundary = np.diff(first[row], prepend=-2) != 0
    row, block = _shared(row, boundary)
    for _ in range(1, depth):
        if not len(row):
            break
        symbol = before[row]
        dealt = np.argsort(symbol, kind="stable")
        symbol, block = symbol[dealt], block[dealt]
        row = step[row[dealt]]
        boundary = np.empty(len(row), bool)
        boundary[0] = True
        np.not_equal(symbol[1:], symbol[:-1], out=boundary[1:])
        boundary[1:] |= block[1:] != block[:-1]
        row, block = _shared(row, boundary)
    return row, block


def _shared(row: np.ndarray, boundary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that aren't alone between two boundaries, and their blocks' numbers."""
    block = np.cumsum(boundary, dtype=np.int32)
    kept = ~(boundary & np.append(boundary[1:], True))
    return row[kept], block[kept]


def repeated_starts(strings: list[bytes], window: int, shard_bytes: int = 1 << 17, asked: np.ndarray | None = None) -> list[np.ndarray]:
    """For each string the places where a window begins that also begins elsewhere among the strings.

    asked: a boolean for each byte and sentinel, false where the window that begins there is known to stand alone.
    """
    ends = np.cumsum([len(s) + 1 for s in strings])
    cuts = [0]
    for k, end in enumerate(ends.tolist()):
        if end - (ends[cuts[-1] - 1] if cuts[-1] else 0) >= shard_bytes or k == len(strings) - 1:
            cuts.append(k + 1)
    shards = [shard_of(strings[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    begins = ends - np.array([len(s) + 1 for s in strings])
    text = np.concatenate([s.order + (begins[a] if len(begins) else 0) for s, a in zip(shards, cuts, strict=False)])
    # a window's row is first met at its last byte
    last = np.arange(ends[-1]) - np.repeat(begins, np.diff(ends, prepend=0)) >= window - 1
    if asked is not None:
        last[window - 1 :] &= asked[: 1 - window] if window > 1 else asked
    row, _ = merged(shards, window, np.split(last[text], np.cumsum([len(s.order) for s in shards])[:-1]))
    again = np.zeros(ends[-1], bool)
    again[text[row]] = True
    return [np.flatnonzero(x) for x in np.split(again, ends[:-1])]


def cells_of(hashes: Hashes, sizes: np.ndarray, anchors: np.ndarray, window: int, width: int) -> tuple[np.ndarray, ...]:
    """Arrays (string, core hash, first, past): the window starts first..past, as places in the joined strings, that lie
    in one cell of `width` distances from the string's anchor.

    Equal windows begin equally far before their anchor. All windows of a cell share a core, the bytes from the last
    place of the cell to the end of the window at its first place. So windows of unlike cores are unlike.
    """
    ends = np.cumsum(sizes)
    begins, starts = ends - sizes, np.maximum(sizes - window, 0)  # a sentinel ends each string
    nearest, farthest = (anchors - starts + 1) // width, anchors // width
    n = np.where(starts > 0, farthest - nearest + 1, 0)
    string = np.repeat(np.arange(len(sizes)), n)
    cell = np.repeat(nearest - (np.cumsum(n) - n), n) + np.arange(n.sum())
    last = (begins + anchors)[string] - cell * width
    core = hashes.of(last, last - width + 1 + window) ^ mixed(cell.astype(np.uint64))
    return string, core, np.maximum(last - width + 1, begins[string]), np.minimum(last + 1, (begins + starts)[string])


def perhaps_repeated(strings: list[bytes], anchors: np.ndarray, window: int, width: int = 32) -> np.ndarray:
    """A boolean for each byte and sentinel: false where a window begins whose core no other string has."""
    sizes = np.array([len(s) + 1 for s in strings])
    joined = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    _, core, first, past = cells_of(Hashes(joined), sizes, anchors, window, width)
    _, same, times = np.unique(core, return_inverse=True, return_counts=True)
    edge = np.zeros(len(joined) + 1, np.int32)
    np.add.at(edge, first[times[same] > 1], 1)
    np.add.at(edge, past[times[same] > 1], -1)
    return np.cumsum(edge)[:-1] > 0


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive places as (first, how many)."""
    if not len(starts):
        return []
    edge = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
    return list(zip(starts[edge].tolist(), np.diff(edge, append=len(starts)).tolist(), strict=True))


def _settled(pieces: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """(t1, t2, s, n): repeated window starts of pieces (k, t1, t2, s, a, whole, piece); pieces of one k are merged
    together. Those of a whole piece, which has copies, are known already; it is there for the others."""

    def close(held: list[tuple]) -> pd.DataFrame:
        strings, anchors = [h[5] for h in held], np.array([h[4] for h in held])
        found = repeated_starts(strings, window, asked=perhaps_repeated(strings, anchors, window))
        rows = [(t1, t2, s + at, n) for (t1, t2, s, whole, *_), starts in zip(held, found, strict=True) if not whole for at, n in _spans(starts)]
        out = pd.DataFrame(rows, columns=["t1", "t2", "s", "n"])
        return out.astype({"t1": "int64", "t2": "int64", "s": "int32", "n": "int32"})

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        room, last = block_bytes, None
        for batch in batches:
            for k, t1, t2, s, whole, a, piece in zip(*(batch[c] for c in ("k", "t1", "t2", "s", "whole", "a", "piece")), strict=True):
                if k != last and room <= 0:
                    yield close(held)
                    held, room = [], block_bytes
                last = k
                held.append((t1, t2, s, whole, a, bytes(piece)))
                room -= len(piece)
        if held:
            yield close(held)

    ordered = pieces.repartition("k").sortWithinPartitions("k")
    return ordered.mapInPandas(stream, "t1 long, t2 long, s int, n int")


def _in_cells(pieces: DataFrame, window: int, width: int) -> DataFrame:
    """(k, h, t1, t2, s, n, a, whole, piece): pieces cut at their cells; k stands for the core, h for the whole part."""
    kind = pa.struct([("k", pa.int64()), ("h", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("piece", pa.binary())])

    @F.arrow_udf("array<struct<k: bigint, h: bigint, at: int, n: int, piece: binary>>")
    def of(texts: pa.Array, anchors: pa.Array) -> pa.Array:
        strings = blobs(texts)
        joined = b"\0".join(strings) + b"\0"
        sizes = np.array([len(s) + 1 for s in strings])
        buf = np.frombuffer(joined, np.uint8)
        string, core, first, past = cells_of(Hashes(buf), sizes, anchors.to_numpy(), window, width)
        # unlike the core's, so that both together are 128 bits
        whole = Hashes(buf[::-1]).of(len(buf) - past - window + 1, len(buf) - first)
        begins = (np.cumsum(sizes) - sizes)[string]
        parts = [joined[a : b + window - 1] for a, b in zip(first.tolist(), past.tolist(), strict=True)]
        columns = [pa.array(x) for x in (core.view(np.int64), whole.view(np.int64), (first - begins).astype(np.int32), (past - first).astype(np.int32))]
        ends = np.append(0, np.cumsum(np.bincount(string, minlength=len(strings)))).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([*columns, pa.array(parts, pa.binary())], fields=list(kind)))

    cut = pieces.select("t1", "t2", "s", "a", "whole", F.explode(of(F.col("piece"), F.col("a"))).alias("c"))
    return cut.select("c.k", "c.h", "t1", "t2", (F.col("s") + F.col("c.at")).alias("s"), "c.n", (F.col("a") - F.col("c.at")).alias("a"), "whole", "c.piece")


def _counted(parts: DataFrame, crowd: int) -> DataFrame:
    """One row for each (k, h) that has copies or shares k with unlike parts: whole (it has copies), and crowded (k has
    over `crowd` unlike parts; null if it has no other)."""
    kept = [c for c in parts.columns if c not in ("k", "h", "whole")]
    copies = F.count(F.lit(1)) + (F.count_if("whole") if "whole" in parts.columns else F.lit(0))
    one = parts.groupBy("k", "h").agg(copies.alias("copies"), *(F.first(c).alias(c) for c in kept))
    unlike = one.groupBy("k").agg(F.count(F.lit(1)).alias("unlike")).filter("unlike > 1")
    return one.join(unlike, "k", "left").filter("copies > 1 OR unlike > 1").select("k", "h", *kept, (F.col("copies") > 1).alias("whole"), (F.col("unlike") > crowd).alias("crowded"))


def _split(pieces: DataFrame, window: int, crowd: int, block_bytes: int, width: int = 32) -> DataFrame:
    """(t1, t2, s, n): as _settled, for anchors with too many unlike pieces for one task.

    Pieces are cut at their cells and grouped by core instead, and what is still crowded at narrower cells, down to single
    windows: equal parts are counted, parts of unlike cores part, and the rest is merged. A level makes a few rows of each
    piece that is left.
    """
    found = []
    while True:
        parts = stored(_in_cells(pieces, window, width))
        doubtful = stored(_counted(parts, crowd))
        copies = doubtful.filter("whole").select("k", "h")
        found.append(parts.filter("NOT whole").join(copies, ["k", "h"]).select("t1", "t2", "s", "n"))
        open_parts = doubtful.filter("NOT crowded")
        found.append(stored(_settled(open_parts, window, block_bytes)))
        pieces, width = doubtful.filter("crowded"), width // 4 or 1
        if pieces.isEmpty():
            return reduce(DataFrame.unionByName, found)


def _cut(text: Column, wanted: Column, window: int) -> Column:
    """The bytes of the wanted pieces of a text, in their order."""

    @F.arrow_udf("array<binary>")
    def of(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        rows = zip(blobs(texts), wanted.to_pylist(), strict=True)
        return pa.array([[t[p["s"] : p["s"] + p["n"] + window - 1] for p in ps or []] for t, ps in rows], pa.list_(pa.binary()))

    return of(text, wanted)


def _removed(text: Column, spans: Column, window: int) -> Column:
    @F.arrow_udf("struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept: binary>")
    def of(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for text, found in zip(blobs(texts), spans.to_pylist(), strict=True):
            kept, done, removed, n = [], 0, 0, 0
            end = -1
            for a, b in sorted((x["s"], x["s"] + x["n"] + window - 1) for x in found or []):
                if a > end:
                    n += 1
                    kept.append(text[done:a])
                    removed += b - a
                else:
                    removed += max(0, b - end)
                end = done = max(end, b)
            rows.append({"n_bytes": len(text), "n_removed": removed, "n_spans": n, "kept": b"".join([*kept, text[done:]])})
        return pa.array(rows, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))

    return of(text, spans)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 200, gram: int = GRAM, block_bytes: int = 1 << 19, crowd: int = 1000) -> DataFrame:
    """docs plus kept (binary), n_bytes, n_removed and n_spans: without each byte of a `window`-byte string found twice.

    Strings are judged on the input, within and across documents; matches never cross documents; overlaps count. Null
    and empty texts have no bytes. Rows that agree in id and text are documents of their own, so all their strings
    repeat. Ids may be null or repeated. Columns with the added names are replaced. An empty table gives an empty one.
    An anchor's unlike pieces are merged by one task, about block_bytes at a time. An anchor with over `crowd` of them is a
    hot group; its pieces are cut and grouped anew, by more bytes, until no group is, and then merged in the same way.
    """
    added = ("kept", "n_bytes", "n_removed", "n_spans")
    keep = [c for c in docs.columns if c not in added]
    text = utf8(F.col(f"`{text_col}`"))
    key = ["t1", "t2"]  # a text's 128-bit hash: equal texts lose the same bytes
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), text.alias("bytes"))
    long = named.filter(F.length("bytes") >= window).select(*key, "bytes")
    # twice, here and for `found`: as a table they would take over half as much disk as the texts
    runs = long.select(*key, F.explode(_runs(F.col("bytes"), window, gram)).alias("r")).select(*key, F.col("r.g").alias("k"), "r.h", "r.s", "r.n", "r.a")
    # copies are counted before anything is gathered by anchor, so a piece of many documents is one row from here on
    doubtful = stored(_counted(runs, crowd))
    found = runs.join(doubtful.filter("whole").select("k", "h"), ["k", "h"]).select(*key, "s", "n")
    open_pieces = doubtful.filter("crowded IS NOT NULL")
    if not open_pieces.isEmpty():
        wanted = open_pieces.groupBy(*key).agg(F.collect_list(F.struct("k", "s", "n", "a", "whole", "crowded")).alias("wanted"))
        # copies of a text are put together before the shuffle; one of them brings the text's pieces
        texts = long.groupBy(*key).agg(F.first("bytes").alias("bytes"))
        met = texts.join(wanted, key).select(*key, "wanted", _cut(F.col("bytes"), F.col("wanted"), window).alias("pieces"))
        cut = met.select(*key, F.explode(F.arrays_zip("wanted", "pieces")).alias("p")).select(*key, "p.wanted.*", F.col("p.pieces").alias("piece"))
        crowds = not open_pieces.filter("crowded").isEmpty()
        cut = stored(cut) if crowds else cut
        found = found.unionByName(stored(_settled(cut.filter("NOT crowded"), window, block_bytes)))
        if crowds:
            found = found.unionByName(_split(cut.filter("crowded"), window, crowd, block_bytes))
    spans = found.distinct().groupBy(*key).agg(F.collect_list(F.struct("s", "n")).alias("spans"))
    joined = named.join(spans, key, "left")
    result = joined.select("row", _removed(F.col("bytes"), F.col("spans"), window).alias("r"))
    return result.select(*(F.col("row").getField(c).alias(c) for c in keep), *(F.col(f"r.{c}").alias(c) for c in added))
