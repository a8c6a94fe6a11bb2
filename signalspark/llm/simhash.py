"""SimHash near-dedup by multi-index hashing.

Each text becomes a 64-bit fingerprint of its word shingles. A table files every distinct fingerprint under the value of
each of its segments. Fingerprints within max_bits differ by at most max_bits // segments bits in one segment, so each
asks the table for all values of that small Hamming ball in each segment, and complete distances of what it fetches are
verified. A value that more than `crowd` fingerprints share (those of a cluster) isn't fetched: who has it or asks for
it meets at common centres, whole fingerprints half of max_bits away, and is linked to one other there, so no pairs of a
cluster are made. Components of the links are found by hooking and pointer jumping over stored tables.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, utf8

_SEED = 42
#: For each byte value, its bits (lowest first) in eight 8-bit lanes of one word.
_LANES = np.frombuffer(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").tobytes(), np.uint64)


def fingerprint_bytes(text: bytes, shingle_words: int) -> int:
    """SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space, XXH64 (seed 42) of each shingle.

    A bit is 1 if set in over half of the shingle hashes. Fewer words than a shingle has: the whole sequence is the
    one shingle; no words: 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = np.fromiter((digest(joined[a:b], _SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    octets = hashes.view(np.uint8).reshape(n, 8)
    for first in range(0, n, 255):  # a lane holds up to 255
        sums = _LANES[octets[first : first + 255]].sum(axis=0, dtype=np.uint64)
        counts += sums.view(np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column | str, shingle_words: int = 3) -> Column:
    """The 64-bit fingerprint of a text column as a signed long; null counts as empty."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        values = np.fromiter((fingerprint_bytes(t, shingle_words) for part in slices(texts) for t in part), np.uint64, len(texts))
        return pa.array(values.view(np.int64))

    return of(utf8(text))


def _ball(bits: range, radius: int) -> list[int]:
    """All masks, as signed longs, of up to `radius` of the bits."""
    masks = [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(bits, r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _asked(fps: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """(segment, value, fp): the values of each segment's ball; of two that differ in one bit of a segment the one asks that has it set."""
    size, radius = 64 // segments, max_bits // segments
    once = lambda f: (F.bit_count(f) != 1) | (F.col("fp").bitwiseAND(f) == f)
    value = lambda s, m: F.transform(F.filter(F.lit(_ball(range(s * size, (s + 1) * size), radius)), once), lambda f: F.struct(F.lit(s).alias("segment"), F.col("fp").bitwiseXOR(f).bitwiseAND(F.lit(m)).alias("value")))
    return fps.select("fp", F.explode(F.concat(*(value(s, m) for s, m in enumerate(_segments(segments))))).alias("at")).select("at.segment", "at.value", "fp")


def _segments(segments: int) -> list[int]:
    """The mask of each segment, as a signed long."""
    size = 64 // segments
    masks = [((1 << size) - 1) << (s * size) for s in range(segments)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def candidates(fps: DataFrame, *, max_bits: int, segments: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """((x, y), (fp)): the pairs that lookups in the segments' tables fetch, and the fingerprints that have or ask for a crowded value."""
    filed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(s).alias("segment"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for s, m in enumerate(_segments(segments))))).alias("at"))
    filed = stored(filed.select("at.segment", "at.value", "fp"))
    sizes = filed.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n"))
    crowded = stored(sizes.filter(F.col("n") > crowd).select("segment", "value"))
    asked = _asked(fps, max_bits, segments)
    key = ["segment", "value"]
    # Spark sizes a table before it is exploded, so without the hint it broadcasts what is dozens of times as large
    fetched = asked.withColumnRenamed("fp", "x").hint("shuffle_merge").join(filed.join(crowded, key, "left_anti").withColumnRenamed("fp", "y"), key).filter("x != y").select("x", "y")
    if crowded.isEmpty():
        return fetched, fps.limit(0)
    return fetched, asked.join(crowded, key, "left_semi").select("fp").unionByName(filed.join(crowded, key, "left_semi").select("fp")).distinct()


def _meetings(fps: DataFrame, max_bits: int) -> DataFrame:
    """(x, y): links that connect all of `fps` within max_bits bits, by the centres that they share.

    Two within max_bits have a centre of which one is at most max_bits // 2 bits away and the other the rest; all who are
    as near as the first are within max_bits of each other and of all others, so the least of them is linked to everyone.
    """
    near, far = max_bits // 2, max_bits - max_bits // 2
    flips = F.explode(F.lit(_ball(range(64), far))).alias("flip")
    met = fps.select("fp", flips).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"), "fp", (F.bit_count("flip") <= near).alias("near")).repartition("centre")
    hub = met.groupBy("centre").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("x"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & F.col("x").isNotNull())
    return met.join(hub.select("centre", "x").hint("shuffle_merge"), "centre").filter(F.col("fp") != F.col("x")).select("x", F.col("fp").alias("y"))


def links(fps: DataFrame, *, max_bits: int = 2, segments: int = 2, crowd: int = 8) -> DataFrame:
    """(a, b), a < b: pairs of the distinct longs `fp` within max_bits bits that connect all such pairs.

    segments, a divisor of 64, and crowd change what is looked up, not what is connected.
    """
    if max_bits < 0 or segments < 1 or 64 % segments or crowd < 1:
        raise ValueError("max_bits is 0 or more, segments divide 64, crowd is 1 or more")
    fetched, crowded = candidates(fps, max_bits=max_bits, segments=segments, crowd=crowd)
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits
    pairs = fetched.filter(near).unionByName(_meetings(crowded, max_bits).filter(near))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component, for nodes that have an edge (a, b).

    Each round hooks every node on the smallest of itself and its neighbours, follows the hooks to their roots by
    pointer jumping, and goes on with the edges between different roots. A root on which nothing hooked has a smaller
    neighbour in the next round, so two rounds at least halve the nodes, whatever the shape of a component; a round
    has as many jumps as the logarithm of its longest chain of hooks. Every round is stored.
    """
    edges, hooks = stored(edges.select("a", "b")), []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks.append(_roots(stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))))
        at_a, at_b = (hooks[-1].select(F.col("node").alias(f"node_{x}"), F.col("label").alias(f"root_{x}")) for x in "ab")
        between = edges.join(at_a, F.col("a") == F.col("node_a")).join(at_b, F.col("b") == F.col("node_b")).filter(F.col("root_a") != F.col("root_b"))
        edges = stored(between.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    label = hooks.pop()
    while hooks:  # a root of an earlier round may have been hooked later
        later = label.select(F.col("node").alias("via"), F.col("label").alias("further"))
        label = stored(hooks.pop().join(later, F.col("label") == F.col("via"), "left").select("node", F.coalesce("further", "label").alias("label")))
    return label


def _roots(hooks: DataFrame) -> DataFrame:
    """(node, label) with each label followed to the end; labels are nodes, and smaller unless a node is a root."""
    while True:
        up = hooks.select(F.col("node").alias("via"), F.col("label").alias("further"))
        jumped = stored(hooks.join(up, F.col("label") == F.col("via")).select("node", F.col("label").alias("old"), F.col("further").alias("label")))
        hooks = jumped.select("node", "label")
        if jumped.filter(F.col("old") != F.col("label")).isEmpty():
            return hooks


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 2, segments: int = 2) -> DataFrame:
    """docs without its text, plus fingerprint (16 hex digits) and component_id, the smallest id reachable over links.

    Null and empty texts have the fingerprint zero and link like any other. Rows with equal fingerprints form one
    component; a component without any id has a null component_id. Repeated rows each get a row. Columns named
    fingerprint or component_id are replaced. An empty table gives an empty table.
    """
    keep = [c for c in docs.columns if c not in ("fingerprint", "component_id", text_col)]
    row = stored(docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), fingerprint(F.col(f"`{text_col}`"), shingle_words).alias("fp")))
    groups = component_of(row.select(F.col("row").getField(id_col).alias("id"), "fp"), max_bits=max_bits, segments=segments)
    joined = row.join(groups, row["fp"] == groups["group_fp"])
    return joined.select(*(F.col("row").getField(c).alias(c) for c in keep), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def component_of(ids: DataFrame, *, max_bits: int, segments: int) -> DataFrame:
    """(group_fp, component_id) for each distinct fp of (id, fp)."""
    smallest = stored(ids.groupBy("fp").agg(F.min("id").alias("least_id")))
    label = components(links(smallest.select("fp"), max_bits=max_bits, segments=segments))
    named = smallest.join(label, smallest["fp"] == label["node"], "left").select("fp", "least_id", F.coalesce("label", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return named.join(least, "root").select(F.col("fp").alias("group_fp"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 2, segments: int = 2) -> DataFrame:
    """One row of docs for each component: the one with the smallest (id, hash of the text); a null id comes last.

    Rows that agree in id and text count as one row, of which one stays.
    """
    hashed = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text_hash")
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), hashed, F.col(f"`{text_col}`").alias("text"))
    row = stored(keyed.select("id", "text_hash", fingerprint("text", shingle_words).alias("fp")))
    order = F.struct(F.col("id").isNull().alias("unnamed"), F.col("id"), F.col("text_hash"))
    smallest = stored(row.groupBy("fp", "id", "text_hash").agg(F.count(F.lit(1)).alias("n")).groupBy("fp").agg(F.min(order).alias("least"), F.max("n").alias("most")))
    label = components(links(smallest.select("fp"), max_bits=max_bits, segments=segments))
    named = smallest.join(label, smallest["fp"] == label["node"], "left").select(F.coalesce("label", "fp").alias("root"), "least", "most")
    chosen = stored(named.groupBy("root").agg(F.min("least").alias("least"), F.max("most").alias("most")).select(F.col("least.id").alias("chosen_id"), F.col("least.text_hash").alias("chosen_hash"), "most"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), hashed)
    picked = whole.join(chosen, F.col("id").eqNullSafe(F.col("chosen_id")) & (F.col("text_hash") == F.col("chosen_hash")), "left_semi")
    if not chosen.filter(F.col("most") > 1).isEmpty():
        picked = picked.dropDuplicates(["id", "text_hash"])
    return picked.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
