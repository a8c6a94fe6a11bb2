"""Joins in time and by likeness: intervals, nearest times, aligned frames, perceptual hashes.

Interval and nearest joins go through buckets of time, so they are equi-joins that spread and never compare all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .series import along


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], width: float) -> DataFrame:
    """(keys, a0, a1, b0, b1, shared): every pair of intervals (t0, t1) that overlap, once; `width` is a bucket's."""
    left = a.select(*keys, F.col("t0").alias("a0"), F.col("t1").alias("a1"), _buckets(F.col("t0"), F.col("t1"), width).alias("bucket"))
    right = b.select(*keys, F.col("t0").alias("b0"), F.col("t1").alias("b1"), _buckets(F.col("t0"), F.col("t1"), width).alias("bucket"))
    low, high = F.greatest("a0", "b0"), F.least("a1", "b1")
    met = left.join(right, [*keys, "bucket"]).filter(high > low)
    first = F.floor(low / width) == F.col("bucket")  # the pair's first shared bucket
    return met.filter(first).select(*keys, "a0", "a1", "b0", "b1", (high - low).alias("shared"))


def stabbed(points: DataFrame, spans: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The columns of points and those of spans (begin, end and others) for each span with begin <= at < end.

    A span is filed in buckets of the power of two from its length on, so in two at most, whatever its length; a point
    looks once into each power that spans have. begin, end and `at` are whole numbers.
    """
    wide = F.col("end") - F.col("begin")
    power = F.greatest(F.lit(0), F.ceil(F.log2(wide)).cast("int"))
    bucket = lambda x, p: F.call_function("shiftright", x, p)
    sized = spans.filter(wide > 0).withColumn("_power", power)
    filed = sized.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("begin"), F.col("_power")), bucket(F.col("end") - 1, F.col("_power")))))
    # 64 powers at most, so this is a short list for each key
    powers = sized.groupBy(*keys).agg(F.collect_set("_power").alias("_powers"))
    asked = points.join(powers, keys).withColumn("_power", F.explode("_powers")).drop("_powers").withColumn("_bucket", bucket(F.col(at), F.col("_power")))
    return asked.join(filed, [*keys, "_power", "_bucket"]).filter((F.col("begin") <= F.col(at)) & (F.col(at) < F.col("end"))).drop("_power", "_bucket")


def coverage(spans: DataFrame, covers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, covered, share): how much of the spans the covers overlap; covers that overlap count twice.

    One pass over the ends of both in order: between two ends next to one another the open spans times the open covers
    overlap. No pairs are made, however long or many they are.
    """
    true = F.coalesce(F.col("t1") > F.col("t0"), F.lit(False))
    end = lambda t, a, b, own: F.struct(F.when(true, t).alias("t"), F.when(true, F.lit(a)).otherwise(0).alias("a"), F.when(true, F.lit(b)).otherwise(0).alias("b"), own.alias("own"))
    none, t0, t1 = F.lit(None).cast("double"), F.col("t0"), F.col("t1")
    first = spans.select(*keys, F.explode(F.array(end(t0, 1, 0, (t1 - t0).cast("double")), end(t1, -1, 0, none))).alias("e"), F.lit(True).alias("_span"))
    second = covers.select(*keys, F.explode(F.array(end(t0, 0, 1, none), end(t1, 0, -1, none))).alias("e"), F.lit(False).alias("_span"))
    w = along(keys, ["_t"])
    ends = first.unionByName(second).select(*keys, F.col("e.t").alias("_t"), "e.a", "e.b", "e.own", "_span")
    open_now = lambda c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    shared = ends.withColumn("_shared", open_now("a") * open_now("b") * (F.lead("_t").over(w) - F.col("_t")))
    summed = shared.groupBy(*keys).agg(F.sum("own").alias("total"), F.coalesce(F.sum("_shared"), F.lit(0.0)).alias("covered"), F.bool_or("_span").alias("_span")).filter("_span")
    return summed.select(*keys, "total", "covered", F.try_divide(F.col("covered"), F.col("total")).alias("share"))


def nearest(a: DataFrame, b: DataFrame, keys: list[str], within: float) -> DataFrame:
    """(keys, t, near, offset): for each time of a the nearest of b within a distance; of two as near the earlier."""
    left = a.select(*keys, "t", F.floor(F.col("t") / within).alias("bucket"))
    right = b.select(*keys, F.col("t").alias("near")).withColumn("at", F.floor(F.col("near") / within))
    right = right.select(*keys, "near", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)).alias("bucket"))
    met = left.join(right, [*keys, "bucket"], "left")
    close = F.abs(F.col("near") - F.col("t")) <= within
    picked = met.groupBy(*keys, "t").agg(F.min(F.when(close, F.struct(F.abs(F.col("near") - F.col("t")).alias("d"), F.col("near").alias("near")))).alias("m"))
    return picked.select(*keys, "t", F.col("m.near").alias("near"), (F.col("m.near") - F.col("t")).alias("offset"))


def near_any(events: DataFrame, marks: DataFrame, keys: list[str], within: float, name: str = "near") -> DataFrame:
    """events plus whether any mark is closer than `within`."""
    at = marks.select(*keys, F.col("t").alias("_m")).withColumn("_at", F.floor(F.col("_m") / within))
    at = at.select(*keys, "_m", F.explode(F.array(F.col("_at") - 1, F.col("_at"), F.col("_at") + 1)).alias("_b"))
    times = events.select(*keys, "t").distinct().withColumn("_b", F.floor(F.col("t") / within))
    hit = times.join(at, [*keys, "_b"]).filter(F.abs(F.col("t") - F.col("_m")) < within).select(*keys, "t").distinct().withColumn(name, F.lit(True))
    return events.join(hit, [*keys, "t"], "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def frames_in(spans: DataFrame, ranges: DataFrame, keys: list[str], width: int = 1024) -> DataFrame:
    """(keys, q0, q1, frames): how many frames of inclusive spans (f0, f1) lie in inclusive ranges (q0, q1).

    Spans and ranges meet in buckets of `width` frames, each pair in the first that they share.
    """
    cut = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))).alias("bucket")
    asked = ranges.select(*keys, "q0", "q1").distinct()
    met = asked.filter("q0 <= q1").select(*keys, "q0", "q1", cut("q0", "q1")).join(spans.filter("f0 <= f1").select(*keys, "f0", "f1", cut("f0", "f1")), [*keys, "bucket"])
    low, high = F.greatest("f0", "q0"), F.least("f1", "q1")
    shared = met.filter((high >= low) & (F.floor(low / width) == F.col("bucket"))).groupBy(*keys, "q0", "q1").agg(F.sum(high - low + 1).alias("frames"))
    return asked.join(shared, [*keys, "q0", "q1"], "left").select(*keys, "q0", "q1", F.coalesce("frames", F.lit(0)).alias("frames"))


def scenes(cuts: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scene, a, b): half-open frame ranges between the sorted bounds 0, cuts, n."""
    bounds = cuts.select(*keys, F.col("frame").cast("long").alias("a")).unionByName(sizes.select(*keys, F.lit(0).cast("long").alias("a"))).unionByName(sizes.select(*keys, F.col("n").cast("long").alias("a")))
    w = along(keys, ["a"])
    ranged = bounds.distinct().withColumn("b", F.lead("a").over(w)).withColumn("scene", F.row_number().over(w) - 1)
    return ranged.filter("b IS NOT NULL").select(*keys, "scene", "a", "b")


def scene_peaks(frames: DataFrame, ranges: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, scene, a, b, peak): the highest value of each scene. A frame finds its scene by the bounds before it,
    in one pass over frames and bounds in order, without comparing them in pairs."""
    bound = ranges.select(*keys, F.col("a").alias("at"), F.lit(0).alias("is_frame"), F.col("scene"), F.lit(None).cast("double").alias("v"))
    rows = frames.select(*keys, F.col("frame").alias("at"), F.lit(1).alias("is_frame"), F.lit(None).cast("int").alias("scene"), F.col(value).alias("v"))
    placed = bound.unionByName(rows).withColumn("scene", F.last("scene", ignorenulls=True).over(along(keys, ["at", "is_frame"])))
    peak = placed.filter("is_frame = 1").groupBy(*keys, "scene").agg(F.max("v").alias("peak"))
    return ranges.join(peak, [*keys, "scene"], "left").select(*keys, "scene", "a", "b", "peak")


def psnr(reference: DataFrame, distorted: DataFrame, keys: list[str], value: str, peak: float = 255.0) -> DataFrame:
    """(keys, frames, mse, psnr) over the frames that both have; infinite where nothing differs."""
    both = reference.select(*keys, F.col(value).alias("a")).join(distorted.select(*keys, F.col(value).alias("b")), keys)
    group = keys[:-1]
    agg = both.groupBy(*group).agg(F.count(F.lit(1)).alias("frames"), F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("mse"))
    return agg.withColumn("psnr", F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(peak * peak / F.col("mse"))))


def hash_pairs(hashes: DataFrame, key: str, words: list[str], max_bits: int, segment: int = 16) -> DataFrame:
    """(a, b, bits), a < b: pairs of different hashes, of 64-bit words, that differ in at most max_bits bits, each by the
    least key of its rows (hash_members has the others; copies aren't paired with each other). Rows with a null word have
    no hash.

    The hash is cut in segments of `segment` bits. Two hashes within max_bits bits differ by at most max_bits // segments
    bits in one of them, so each looks up all segment values within that radius and complete distances are verified; no
    pair is missed.
    """
    if 64 % segment or segment > 32:
        raise ValueError("a segment is an equal part of a word, of 32 bits at most")
    each = 64 // segment
    radius = max_bits // (each * len(words))
    if radius > 2:
        raise ValueError("so many bits need shorter segments")
    cut = [F.shiftrightunsigned(F.col(w), 64 - segment * (k + 1)).bitwiseAND(F.lit((1 << segment) - 1).cast("long")) for w in words for k in range(each)]
    flips = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(segment), r)]
    ball = F.array(*(F.lit(f).cast("long") for f in flips))
    distinct = hashes.dropna(subset=words).groupBy(*words).agg(F.min(key).alias("first"))
    filed = distinct.select(F.col("first").alias("_a"), *words, F.posexplode(F.array(*cut)).alias("_place", "_value"))
    asked = filed.select(F.col("_a").alias("_b"), *(F.col(w).alias(f"{w}_b") for w in words), "_place", F.explode(F.transform(ball, lambda f: F.col("_value").bitwiseXOR(f))).alias("_value"))
    bits = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_b"))) for w in words), F.lit(0))
    near = filed.join(asked, ["_place", "_value"]).filter((F.col("_a") < F.col("_b")) & (bits <= max_bits))
    return near.select(F.col("_a").alias("a"), F.col("_b").alias("b"), bits.alias("bits")).distinct()


def hash_members(hashes: DataFrame, key: str, words: list[str]) -> DataFrame:
    """(key, words, first): the least key of the rows with the same hash."""
    known = hashes.select(key, *words).dropna(subset=words)
    return known.join(known.groupBy(*words).agg(F.min(key).alias("first")), words).select(key, *words, "first")


def loops(frames: DataFrame, keys: list[str], hash_col: str, least: int, kinds: int = 3) -> DataFrame:
    """(keys, delta, source, repeat, n): every longest stretch of frames that comes again, hash for hash, `delta`
    frames later.

    A stretch has `kinds` different pictures (2 at least) and one for each four frames, and isn't longer than its
    distance. So it has a certain number of changes of picture in a row: held frames are collapsed to runs, and only
    places with that many equal changes are paired, with all such places before them. Material of period p makes
    frames * frames / p pairs.
    """
    if kinds < 2:
        raise ValueError("a stretch has two different pictures at least")
    changes = max(kinds, least // 4) - 1
    w = along(keys, ["frame"])
    broken = F.coalesce(F.col("frame") != F.lag("frame").over(w) + 1, F.lit(True))  # frames are missing before it
    marked = frames.select(*keys, F.col("frame").cast("long").alias("frame"), F.col(hash_col).alias("_h"))
    marked = marked.withColumn("_broken", broken).withColumn("_new", F.col("_broken") | ~F.col("_h").eqNullSafe(F.lag("_h").over(w)))
    counted = marked.withColumn("_part", F.sum(F.col("_broken").cast("long")).over(w)).withColumn("_run", F.sum(F.col("_new").cast("long")).over(w))
    runs = counted.groupBy(*keys, "_part", "_run").agg(F.min("frame").alias("_at"), F.count(F.lit(1)).alias("_len"), F.first("_h").alias("_h"))
    row = F.collect_list(F.struct("_h", "_at", "_len")).over(along([*keys, "_part"], ["_run"]).rowsBetween(-1, changes - 1))
    places = runs.withColumn("_row", row).filter(F.size("_row") == changes + 1)
    inner = F.transform("_row", lambda r, i: F.struct(r["_h"].alias("h"), F.when((i > 0) & (i < changes), r["_len"]).alias("len")))
    first, last = F.element_at("_row", 1), F.element_at("_row", -1)
    places = places.select(*keys, inner.alias("_like"), "_run", "_at", first["_h"].alias("_h"), first["_len"].alias("_before"), last["_at"].alias("_last"), last["_len"].alias("_after"))
    again = places.select(*keys, "_like", F.col("_run").alias("_run_b"), F.col("_at").alias("_at_b"), F.col("_before").alias("_before_b"), F.col("_after").alias("_after_b"))
    met = places.join(again, [*keys, "_like"]).filter(F.col("_at") < F.col("_at_b"))
    met = met.select(*keys, (F.col("_at_b") - F.col("_at")).alias("delta"), (F.col("_run_b") - F.col("_run")).alias("_ahead"), "_run", "_like", "_h", (F.col("_at") - F.least("_before", "_before_b")).alias("_from"), (F.col("_last") + F.least("_after", "_after_b")).alias("_to"))
    chained = met.withColumn("_chain", F.col("_run") - F.row_number().over(along([*keys, "delta", "_ahead"], ["_run"])))
    pictures = F.concat(F.collect_set("_h"), F.transform(F.max_by("_like", "_run"), lambda r: r["h"]))
    out = chained.groupBy(*keys, "delta", "_ahead", "_chain").agg(F.min_by("_from", "_run").alias("source"), F.max_by("_to", "_run").alias("_to"), F.size(F.filter(F.array_distinct(pictures), lambda h: h.isNotNull())).alias("_kinds"))
    out = out.withColumn("n", F.col("_to") - F.col("source")).withColumn("repeat", F.col("source") + F.col("delta"))
    varied = F.col("_kinds") >= F.greatest(F.lit(kinds), F.floor(F.col("n") / 4))
    return out.filter((F.col("n") >= least) & (F.col("n") <= F.col("delta")) & varied).select(*keys, "delta", "source", "repeat", "n")


def next_loops(frames: DataFrame, keys: list[str], hash_col: str, least: int, kinds: int = 3) -> DataFrame:
    """(keys, delta, source, repeat, n): stretches of frames that come again, hash for hash, `delta` frames later.

    A frame is paired with the next frame of its hash only, and stretches are the runs of one distance: held frames and
    pictures that come in between hide a stretch. loops() finds all. A stretch needs some different pictures and may not be longer than its distance.
    """
    w = Window.partitionBy(*keys, hash_col).orderBy("frame")
    paired = frames.withColumn("_later", F.lead("frame").over(w)).filter("_later IS NOT NULL").withColumn("delta", F.col("_later") - F.col("frame"))
    run = paired.withColumn("_run", F.col("frame") - F.row_number().over(along([*keys, "delta"], ["frame"])))
    out = run.groupBy(*keys, "delta", "_run").agg(F.min("frame").alias("source"), F.min("_later").alias("repeat"), F.count(F.lit(1)).alias("n"), F.count_distinct(hash_col).alias("_kinds"))
    varied = F.col("_kinds") >= F.greatest(F.lit(kinds), F.floor(F.col("n") / 4))
    return out.filter((F.col("n") >= least) & (F.col("n") <= F.col("delta")) & varied).select(*keys, "delta", "source", "repeat", "n")


def loop_scan(frames: DataFrame, keys: list[str], words: list[str], least: int, tolerance: int, segment: int = 16) -> DataFrame:
    """(keys, delta, source, repeat, n, periodic): longest stretches that come again `delta` frames later, frame for frame
    within `tolerance` bits of a hash; at least `least` frames long and apart, and not longer than their distance.

    Alike hashes are found through hash_pairs' balls within a series. Pictures that a quarter of a series (and over 64
    frames) is like say nothing and are left out, as are stretches of fewer than max(3, n / 4) pictures (a freeze) and those that are like
    themselves a half, a third or a quarter of their distance before (seven in ten of their frames).
    periodic: the stretches of about one distance tile the series (a quarter of it, two and a half times or more).
    """
    shots = frames.select(*keys, F.col("frame").cast("long").alias("frame"), *words).dropna(subset=words)
    size = shots.groupBy(*keys).agg((F.max("frame") + 1).alias("_size"))
    kinds = shots.groupBy(*keys, *words).agg(F.count(F.lit(1)).alias("_n"))
    near = _near_hashes(kinds, keys, words, tolerance, segment)
    crowd = near.groupBy(*keys, *words).agg(F.sum("_n_b").alias("_like")).join(size, keys)
    telling = crowd.filter(F.col("_like") <= F.greatest(F.lit(64), F.floor(F.col("_size") / 4))).select(*keys, *words)
    later = shots.join(telling, [*keys, *words])
    pairs = later.join(near.select(*keys, *words, *(f"{w}_b" for w in words)), [*keys, *words])
    earlier = shots.select(*keys, F.col("frame").alias("_from"), *(F.col(w).alias(f"{w}_b") for w in words))
    met = pairs.join(earlier, [*keys, *(f"{w}_b" for w in words)]).withColumn("delta", F.col("frame") - F.col("_from")).filter(F.col("delta") >= 2)
    run = met.filter(F.col("delta") >= least).withColumn("_run", F.col("frame") - F.row_number().over(along([*keys, "delta"], ["frame"])))
    out = run.groupBy(*keys, "delta", "_run").agg(F.min("_from").alias("source"), F.min("frame").alias("repeat"), F.count(F.lit(1)).alias("n"), F.count_distinct(*words).alias("_kinds"))
    out = out.filter((F.col("n") >= least) & (F.col("n") <= F.col("delta")) & (F.col("_kinds") >= F.greatest(F.lit(3), F.floor(F.col("n") / 4)))).join(size, keys)
    parts = F.filter(F.transform(F.array(*(F.lit(k) for k in (2, 3, 4))), lambda k: F.floor(F.col("delta") / k)), lambda d: d >= 2)
    inner = run.select(*keys, "delta", "_run", "frame", F.explode(F.array_distinct(parts)).alias("_part")).join(met.select(*keys, "frame", F.col("delta").alias("_part"), F.lit(1).alias("_hit")), [*keys, "frame", "_part"], "left")
    cyclic = inner.groupBy(*keys, "delta", "_run", "_part").agg(F.count("_hit").alias("_hits"), F.count(F.lit(1)).alias("_all")).filter("10 * _hits >= 7 * _all").select(*keys, "delta", "_run").distinct()
    out = out.join(cyclic, [*keys, "delta", "_run"], "left_anti")
    about = Window.partitionBy(*keys, F.rint(F.col("delta") / least))
    tiles = (F.col("_size") >= 2.5 * F.percentile("delta", F.lit(0.5)).over(about)) & (F.sum("n").over(about) >= 0.25 * F.greatest(F.lit(1), F.col("_size") - F.percentile("delta", F.lit(0.5)).over(about)))
    return out.select(*keys, "delta", "source", "repeat", "n", tiles.alias("periodic"))


def ranked_loops(loops: DataFrame, keys: list[str], least: int, most: int = 20) -> DataFrame:
    """The stretches of loop_scan that don't tile their series, the longest first in order of `rank`, `most` at most.

    A stretch is left out if one before it in that order begins its repeat within `least` frames of its own and has a
    distance within `least` of its own. Of equally long ones the nearer source comes first, then the earlier repeat. What
    stays of a series lies in a grid of cells of `least` by `least`, so a stretch is compared with nine cells.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, cells, n = None, {}, 0
        for batch in batches:
            ranks = []
            for *k, repeat, delta in batch[[*keys, "repeat", "delta"]].itertuples(index=False):
                if k != key:
                    key, cells, n = k, {}, 0
                a, b = repeat // least, delta // least
                near = n >= most or any(abs(repeat - r) < least and abs(delta - d) < least for i in (-1, 0, 1) for j in (-1, 0, 1) for r, d in cells.get((a + i, b + j), ()))
                if not near:
                    cells.setdefault((a, b), []).append((repeat, delta))
                    n += 1
                ranks.append(0 if near else n)
            yield batch.assign(rank=ranks)[lambda x: x["rank"] > 0]

    single = loops.filter(~F.col("periodic")).select(*keys, "delta", "source", "repeat", "n")
    ordered = single.repartition(*keys).sortWithinPartitions(*keys, F.desc("n"), "delta", "repeat")
    return ordered.mapInPandas(stream, T.StructType([*single.schema.fields, T.StructField("rank", T.IntegerType())]))


def periods(loops: DataFrame, frames: DataFrame, keys: list[str], least: int, most: int = 6) -> DataFrame:
    """(keys, period, stretches, coverage_pct, cycles): one row for each distance at which a series tiles, the best covered
    first, `most` at most; `least` is that of the scan. Coverage is the share of the frames that could come again which do."""
    size = frames.groupBy(*keys).agg((F.max("frame") + 1).alias("_size"))
    tiled = loops.filter("periodic").groupBy(*keys, F.rint(F.col("delta") / least).alias("_about"))
    found = tiled.agg(F.floor(F.percentile("delta", F.lit(0.5))).cast("long").alias("period"), F.count(F.lit(1)).alias("stretches"), F.sum("n").alias("_total")).join(size, keys)
    share = 100 * F.col("_total") / F.greatest(F.lit(1), F.col("_size") - F.col("period"))
    out = found.select(*keys, "period", "stretches", F.round(share, 1).alias("coverage_pct"), F.round(F.col("_size") / F.col("period"), 1).alias("cycles"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("coverage_pct"), "period"))
    return out.withColumn("_n", nth).filter(F.col("_n") <= most).drop("_n")


def _near_hashes(kinds: DataFrame, keys: list[str], words: list[str], tolerance: int, segment: int) -> DataFrame:
    """(keys, words, words_b, _n_b): for each distinct hash of a series all within `tolerance` bits, itself included."""
    each = 64 // segment
    radius = tolerance // (each * len(words))
    if 64 % segment or segment > 32 or radius > 2:
        raise ValueError("a segment is an equal part of a word, and short enough for two bits each")
    cut = [F.shiftrightunsigned(F.col(w), 64 - segment * (k + 1)).bitwiseAND(F.lit((1 << segment) - 1).cast("long")) for w in words for k in range(each)]
    flips = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(segment), r)]
    filed = kinds.select(*keys, *words, "_n", F.posexplode(F.array(*cut)).alias("_place", "_value"))
    asked = filed.select(*keys, *(F.col(w).alias(f"{w}_b") for w in words), F.col("_n").alias("_n_b"), "_place", F.explode(F.transform(F.array(*(F.lit(f).cast("long") for f in flips)), lambda f: F.col("_value").bitwiseXOR(f))).alias("_value"))
    bits = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_b"))) for w in words), F.lit(0))
    return filed.join(asked, [*keys, "_place", "_value"]).filter(bits <= tolerance).select(*keys, *words, *(f"{w}_b" for w in words), "_n_b").distinct()
