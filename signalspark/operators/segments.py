"""Segments of time in which something holds, and what is done with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import frames_in
from .series import along, chain, mark_runs, median, robust_z, runs


def black(frames: DataFrame, ratio: Column, keys: list[str], least: float = 0.05, share: float = 0.98) -> DataFrame:
    """Stretches with at least `share` black pixels."""
    return runs(frames, ratio >= share, keys, ["frame"], "t", least)


def frozen(frames: DataFrame, change: Column, keys: list[str], limit: float, least: float = 0.5) -> DataFrame:
    """Stretches whose change from frame to frame stays at or below the limit."""
    return runs(frames, change <= limit, keys, ["frame"], "t", least)


def silent(levels: DataFrame, level: Column, keys: list[str], limit: float = -50.0, least: float = 0.5) -> DataFrame:
    """Stretches at or below a level; -inf is a level."""
    return runs(levels, level <= limit, keys, ["t"], "t", least)


def clean(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Ends put in order, empty ones dropped, of equal ones one kept."""
    low, high = F.least("t0", "t1"), F.greatest("t0", "t1")
    return segments.select(*keys, low.alias("a"), high.alias("b")).filter("b > a").distinct().select(*keys, F.col("a").alias("t0"), F.col("b").alias("t1"))


def pair_to_end(starts: DataFrame, ends: DataFrame, durations: DataFrame, keys: list[str]) -> DataFrame:
    """The nth start with the nth end; a start without one runs to the end of its series."""
    nth = lambda df, name: df.select(*keys, F.col("t").alias(name), F.row_number().over(along(keys, ["t"])).alias("nth"))
    both = nth(starts, "t0").join(nth(ends, "t1"), [*keys, "nth"], "left").join(durations, keys, "left")
    return both.select(*keys, "t0", F.coalesce("t1", F.greatest("duration", "t0")).alias("t1"))


def complement(segments: DataFrame, durations: DataFrame, keys: list[str], least: float = 0.05) -> DataFrame:
    """What lies between the segments in 0 to duration, in pieces of over `least`."""
    cut = segments.join(durations, keys).select(*keys, F.greatest("t0", F.lit(0.0)).alias("t0"), F.least("t1", "duration").alias("t1"))
    edge = durations.select(*keys, F.col("duration").alias("t0"), F.col("duration").alias("t1"))
    w = along(keys, ["t0", "t1"])
    done = F.coalesce(F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    gaps = cut.unionByName(edge).withColumn("done", done)
    return gaps.filter(F.col("t0") - F.col("done") > least).select(*keys, F.col("done").alias("t0"), F.col("t0").alias("t1"))


def clipping(samples: DataFrame, keys: list[str], rate: Column | float, limit: float = 0.985, least: int = 3, join_s: float = 0.05) -> DataFrame:
    """Stretches of at least `least` samples at or beyond the limit, joined over under join_s seconds."""
    found = runs(samples, F.abs("x") >= limit, keys, ["i"], "i").filter(F.col("n") >= least)
    timed = found.select(*keys, (F.col("t0") / rate).alias("t0"), ((F.col("t1") + 1) / rate).alias("t1"))
    return chain(timed, keys, "t0", "t1", join_s)


def dropouts(samples: DataFrame, keys: list[str], rate: float, least_s: float = 0.02, guard_s: float = 0.1) -> DataFrame:
    """Stretches of exact zeros, not at either end of a series."""
    least = max(2, int(least_s * rate))
    ends = samples.groupBy(*keys).agg((F.max("i") + 1).alias("size"))
    found = runs(samples, F.col("x") == 0, keys, ["i"], "i").filter(F.col("n") >= least).join(ends, keys)
    inside = (F.col("t0") >= guard_s * rate) & (F.col("t1") < F.col("size") - guard_s * rate)
    return found.filter(inside).select(*keys, (F.col("t0") / rate).alias("t"), (F.col("n") / rate).alias("duration"))


def clicks(samples: DataFrame, keys: list[str], rate: float, times: float = 16.0, floor: float = 0.1, join_s: float = 0.03) -> DataFrame:
    """Jumps between samples far above the series' own, one for each chain, at its highest jump."""
    w = along(keys, ["i"])
    jumps = samples.withColumn("jump", F.abs(F.col("x") - F.lag("x").over(w))).filter(F.col("jump").isNotNull())
    stats = Window.partitionBy(*keys)
    jumps = jumps.withColumn("med", median(F.col("jump"), stats)).withColumn("mad", median(F.abs(F.col("jump") - F.col("med")), stats))
    high = jumps.filter(F.col("jump") > F.greatest(F.col("med") + times * 1.4826 * F.col("mad"), F.lit(floor)))
    apart = F.when(F.col("i") - F.lag("i").over(w) <= join_s * rate, 0).otherwise(1)
    grouped = high.withColumn("apart", apart).withColumn("g", F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    peak = grouped.groupBy(*keys, "g").agg(F.max_by("i", F.struct("jump", -F.col("i"))).alias("i"), F.max("jump").alias("jump"))
    return peak.select(*keys, (F.col("i") / rate).alias("t"), "jump")


def load_kinds(frames: DataFrame, keys: list[str], fps: float, still: float = 0.9, dark: float = 18.0, match: float = 14.0, still_s: float = 0.5) -> DataFrame:
    """frames plus kind: 3 matches a reference, 2 black, 1 part of a still stretch, else 0."""
    held = F.coalesce(F.col("diff") < still, F.lit(False))
    marked = mark_runs(frames.withColumn("_held", held), F.col("_held"), keys, ["frame"], "_run")
    enough = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run")) >= still_s * fps  # the rows lie together already
    kind = F.when(F.col("refd") < match, 3).when(F.col("luma") < dark, 2).when(F.col("_held") & enough, 1).otherwise(0)
    return marked.withColumn("kind", kind).drop("_held", "_run")


def load_segments(kinds: DataFrame, keys: list[str], fps: float, bridge_s: float = 0.15, least_s: float = 0.30) -> DataFrame:
    """(keys, kind, f0, f1, t0, t1): stretches of loading, short gaps between equal kinds bridged, short ones dropped."""
    marked = mark_runs(kinds, F.col("kind"), keys, ["frame"])
    groups = marked.groupBy(*keys, "run", "kind").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.count(F.lit(1)).alias("n"))
    w = along(keys, ["f0"])
    same = F.lag("kind").over(w) == F.lead("kind").over(w)
    bridged = groups.withColumn("kind", F.when((F.col("kind") == 0) & (F.col("n") <= bridge_s * fps) & same, F.lag("kind").over(w)).otherwise(F.col("kind")))
    loading = mark_runs(bridged.withColumn("on", F.col("kind") > 0), F.col("on"), keys, ["f0"], "span").filter("on")
    counted = loading.groupBy(*keys, "span", "kind").agg(F.sum("n").alias("n"), F.min("f0").alias("f0"), F.max("f1").alias("f1"))
    out = counted.groupBy(*keys, "span").agg(F.max_by("kind", F.struct("n", -F.col("kind"))).alias("kind"), F.min("f0").alias("f0"), F.max("f1").alias("f1"))
    timed = out.select(*keys, "kind", "f0", "f1", (F.col("f0") / fps).alias("t0"), ((F.col("f1") + 1) / fps).alias("t1"))
    return timed.filter(F.col("t1") - F.col("t0") >= least_s)


def noise_outliers(samples: DataFrame, keys: list[str], x: str, least: int = 6, floor: float = 0.05, limit: float = 3.0) -> DataFrame:
    """samples plus z and outlier; a series with few samples or a low median says nothing."""
    w = Window.partitionBy(*keys)
    out = robust_z(samples, x, keys, eps=1e-4, eps_inside=False)
    tells = (F.count(F.lit(1)).over(w) >= least) & (median(F.col(x), w) >= floor)
    return out.withColumn("outlier", tells & (F.abs("z") > limit))


# fixed values: limits of the load scan by preset
PRESETS = {
    "strict": {"dark": 12.0, "still": 0.55, "match": 10.0, "still_s": 0.80},
    "normal": {"dark": 18.0, "still": 0.9, "match": 14.0, "still_s": 0.50},
    "loose": {"dark": 26.0, "still": 1.60, "match": 20.0, "still_s": 0.35},
}


def load_scan(frames: DataFrame, keys: list[str], fps: float, preset: str = "normal", **limits: float) -> DataFrame:
    """Stretches of loading by a preset's limits (an unknown name means normal); `limits` go before them."""
    return load_segments(load_kinds(frames, keys, fps, **(PRESETS.get(preset, PRESETS["normal"]) | limits)), keys, fps)


def retimed(runs: DataFrame, loads: DataFrame, keys: list[str], fps: Column, game_fps: Column | None = None) -> DataFrame:
    """(keys, start, end, frames, rta, load_frames, lrt, game_frames): a run's time from its first frame to the one after
    its last, as it is and without the frames of loading in it; an end that isn't after the start gives no row."""
    valid = runs.filter("end > start")
    ranges = valid.select(*keys, F.col("start").alias("q0"), (F.col("end") - 1).alias("q1"))
    loading = frames_in(loads, ranges, keys).select(*keys, F.col("q0").alias("start"), (F.col("q1") + 1).alias("end"), F.col("frames").alias("load_frames"))
    out = valid.join(loading, [*keys, "start", "end"], "left").withColumn("load_frames", F.coalesce("load_frames", F.lit(0))).withColumn("frames", F.col("end") - F.col("start"))
    rta = F.col("frames") / fps
    game = F.rint(rta * game_fps).cast("long") if game_fps is not None else F.lit(None).cast("long")
    return out.select(*keys, "start", "end", "frames", rta.alias("rta"), "load_frames", (F.greatest(F.lit(0), F.col("frames") - F.col("load_frames")) / fps).alias("lrt"), game.alias("game_frames"))
