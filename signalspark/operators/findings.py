"""Findings, marks, issues and splice candidates: union, scoring, demotion, ranking, roll-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import near_any
from .series import along, median, top_k

RANK = {"pass": 0, "info": 1, "warn": 2, "fail": 3}
VERDICTS = {"clear": 0, "note": 1, "review": 2}


def rank_of(value: Column, names: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), value)


def union(parts: list[DataFrame]) -> DataFrame:
    """All findings (media, severity, area, t, text), with the ordinal of their part."""
    return reduce(DataFrame.unionByName, (p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)))


def demoted(findings: DataFrame, cuts: DataFrame, keys: list[str], area: str = "audio splice", within: float = 0.5) -> DataFrame:
    """Warnings of the area that lie at a scene cut become info."""
    marked = near_any(findings, cuts, keys, within, "_cut")
    low = (F.col("area") == area) & (F.col("severity") == "warn") & F.col("_cut")
    return marked.withColumn("severity", F.when(low, "info").otherwise(F.col("severity"))).drop("_cut")


def ranked(findings: DataFrame, keys: list[str]) -> DataFrame:
    """findings plus place: warnings first, then by time (file-level ones last), then by part and text."""
    order = [rank_of(F.col("severity"), RANK).desc(), F.col("t").asc_nulls_last(), F.col("part"), F.col("text")]
    return findings.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def worst(checks: DataFrame, keys: list[str], status: str = "status", names: dict[str, int] | None = None) -> DataFrame:
    """(keys, verdict): the gravest status."""
    names = names or RANK
    return checks.groupBy(*keys).agg(F.max_by(status, rank_of(F.col(status), names)).alias("verdict"))


def marks(findings: DataFrame, keys: list[str], most: int = 200) -> DataFrame:
    """(keys, t, label): one for each tenth of a second, the first by time and label."""
    at = findings.filter(F.col("t") > 0).withColumn("_slot", F.rint(F.col("t") * 10))
    one = at.groupBy(*keys, "_slot").agg(F.min(F.struct("t", "label")).alias("m")).select(*keys, F.col("m.t").alias("t"), F.col("m.label").alias("label"))
    return top_k(one, keys, [F.col("t"), F.col("label")], most)


def issues(events: DataFrame, keys: list[str], fps: float, priority: dict[str, int]) -> DataFrame:
    """(keys, frame, label): of several events at a frame the one of highest priority (lowest number)."""
    at = events.withColumn("frame", F.rint(F.col("t") * fps).cast("long")).withColumn("_p", F.coalesce(rank_of(F.col("label"), priority), F.lit(99)))
    return at.groupBy(*keys, "frame").agg(F.min(F.struct("_p", "label")).alias("m")).select(*keys, "frame", F.col("m.label").alias("label"))


def neighbours(issue_frames: DataFrame, keys: list[str]) -> DataFrame:
    """issues plus the frames before and after, wrapping at both ends."""
    w, whole = along(keys, ["frame"]), Window.partitionBy(*keys)
    return issue_frames.withColumn("after", F.coalesce(F.lead("frame").over(w), F.min("frame").over(whole))).withColumn("before", F.coalesce(F.lag("frame").over(w), F.max("frame").over(whole)))


def size_jumps(packets: DataFrame, keys: list[str], times: float = 4.0) -> DataFrame:
    """Frames whose size differs from the one before by over mean + times standard deviations of such differences."""
    w, whole = along(keys, ["frame"]), Window.partitionBy(*keys)
    jumps = packets.withColumn("jump", F.abs(F.col("size") - F.lag("size").over(w))).filter("jump IS NOT NULL")
    limit = F.avg("jump").over(whole) + times * F.stddev_pop("jump").over(whole)
    return jumps.withColumn("limit", limit).filter(F.col("jump") > F.col("limit"))


def time_gaps(packets: DataFrame, keys: list[str], times: float = 1.75) -> DataFrame:
    """Frames that don't come after the one before, or over `times` median steps later."""
    w, whole = along(keys, ["frame"]), Window.partitionBy(*keys)
    steps = packets.withColumn("step", F.col("t") - F.lag("t").over(w)).filter("step IS NOT NULL").withColumn("usual", median(F.col("step"), whole))
    return steps.filter((F.col("step") <= 0) | (F.col("step") > times * F.col("usual")))


def early_keys(packets: DataFrame, keys: list[str], share: float = 0.7, least_gop: float = 8) -> DataFrame:
    """Key frames that come sooner than `share` of the median distance, in series of four key frames or more."""
    w, whole = along(keys, ["frame"]), Window.partitionBy(*keys)
    kf = packets.filter("key = 1").withColumn("gap", F.col("frame") - F.lag("frame").over(w)).withColumn("_n", F.count(F.lit(1)).over(whole))
    kf = kf.filter("gap IS NOT NULL").withColumn("usual", median(F.col("gap"), whole))
    return kf.filter((F.col("_n") >= 4) & (F.col("usual") >= least_gop) & (F.col("gap") < share * F.col("usual"))).drop("_n")


#: How much each kind of signal says.
WEIGHTS = {"size": 1, "pts": 2, "idr": 1, "audio": 1}


def splice_candidates(signals: DataFrame, cuts: DataFrame, durations: DataFrame, keys: list[str], slot_s: float = 0.25, most: int = 50) -> DataFrame:
    """(keys, t, score, signals, at_cut): signals (t, kind) of one quarter second together, scored.

    An audio signal joins the slot beside it if only that one has other signals. A cut within 0.3 s takes a point off;
    candidates at either end of a series, or without a point left, are dropped.
    """
    slot = F.rint(F.col("t") / slot_s).cast("long")
    placed = signals.withColumn("slot", slot)
    visual = placed.filter("kind != 'audio'").select(*keys, "slot").distinct()
    near = visual.select(*keys, F.col("slot").alias("_to"), F.explode(F.array(*(F.col("slot") + d for d in (0, -1, 1)))).alias("slot"))
    target = near.groupBy(*keys, "slot").agg(F.min(F.struct(F.abs(F.col("_to") - F.col("slot")).alias("d"), F.col("_to").alias("to"))).alias("m"))
    heard = placed.filter("kind = 'audio'").join(target, [*keys, "slot"], "left").withColumn("slot", F.coalesce("m.to", "slot")).drop("m")
    merged = placed.filter("kind != 'audio'").unionByName(heard).groupBy(*keys, "slot").agg(F.min("t").alias("t"), F.array_sort(F.collect_set("kind")).alias("signals"))
    weight = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    scored = merged.withColumn("score", F.aggregate("signals", F.lit(0), lambda a, k: a + F.coalesce(F.element_at(weight, k), F.lit(0))))
    cut = near_any(scored, cuts, keys, 0.3, "at_cut").withColumn("score", F.col("score") - F.col("at_cut").cast("int"))
    inside = cut.join(durations, keys).filter((F.col("t") >= 0.3) & (F.col("t") <= F.col("duration") - 0.25) & (F.col("score") >= 1))
    return top_k(inside.select(*keys, "t", "score", "signals", "at_cut"), keys, [F.desc("score"), F.size("signals").desc(), F.col("t")], most)


def metadata_mismatch(containers: DataFrame, streams: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, time_differs, duration_differs): streams against their container; unknown values say nothing."""
    s = streams.select(*keys, F.col("created").alias("_c"), F.col("duration").alias("_d"))
    both = containers.join(s, keys)
    room = F.greatest(F.lit(1.0), 0.05 * F.col("duration"))
    return both.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("_c") != F.col("created")), F.lit(False)).alias("time_differs"), F.coalesce(F.bool_or(F.abs(F.col("_d") - F.col("duration")) > room), F.lit(False)).alias("duration_differs"))


def ingredient_chain(links: DataFrame, roots: DataFrame, most: int = 6) -> DataFrame:
    """(root, node, depth): what a manifest is made of, followed at most `most` links deep; a circle ends its branch."""
    level = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.array("node").alias("path"))
    out = [level]
    step = links.select(F.col("parent").alias("node"), "child")
    for depth in range(1, most + 1):
        level = level.join(step, "node").filter(~F.array_contains("path", F.col("child"))).select("root", F.col("child").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.array("child")).alias("path"))
        out.append(level)
    return reduce(DataFrame.unionByName, out).select("root", "node", "depth").distinct()
