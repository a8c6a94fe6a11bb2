"""Captions: reading speed, layout, coverage of speech, synchrony."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import coverage, nearest
from .series import along, upper_median


def cue_checks(cues: DataFrame, keys: list[str], durations: DataFrame) -> DataFrame:
    """cues (t0, t1, text) plus cps, lines, widest and flags: fast, brief, tall_or_wide, overlaps, beyond_end."""
    w = along(keys, ["t0", "t1"])
    length = F.length(F.regexp_replace("text", r"\s+", ""))
    lines = F.split("text", "\n")
    out = cues.withColumn("cps", F.try_divide(length.cast("double"), F.col("t1") - F.col("t0"))).withColumn("lines", F.size(lines)).withColumn("widest", F.array_max(F.transform(lines, F.length)))
    out = out.withColumn("overlaps", F.coalesce(F.lead("t0").over(w) < F.col("t1") - 1e-3, F.lit(False))).join(durations, keys, "left")
    return (
        out.withColumn("fast", F.coalesce(F.col("cps") > 21, F.lit(False)))
        .withColumn("brief", F.col("t1") - F.col("t0") < 0.833)
        .withColumn("tall_or_wide", (F.col("lines") > 2) | (F.col("widest") > 42))
        .withColumn("beyond_end", F.coalesce(F.col("t1") > F.col("duration") + 1, F.lit(False)))
        .drop("duration")
    )


def sync(cues: DataFrame, speech: DataFrame, keys: list[str], within: float = 2.5) -> DataFrame:
    """(keys, matched, offset, spread, systematic): how far cues start after the nearest start of speech."""
    near = nearest(cues.select(*keys, F.col("t0").alias("t")), speech.select(*keys, F.col("t0").alias("t")), keys, within).filter("near IS NOT NULL").select(*keys, (-F.col("offset")).alias("late"))
    offset = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("matched"), upper_median(F.col("late")).alias("offset"))
    spread = near.join(offset, keys).groupBy(*keys).agg(F.first("matched").alias("matched"), F.first("offset").alias("offset"), upper_median(F.abs(F.col("late") - F.col("offset"))).alias("spread"))
    return spread.withColumn("systematic", (F.abs("offset") > 0.30) & (F.col("spread") < 0.45))


def summary(cues: DataFrame, speech: DataFrame, durations: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each media: counts of flags, coverage in percent, and the synchrony."""
    flags = cue_checks(cues, keys, durations).groupBy(*keys).agg(F.count(F.lit(1)).alias("cues"), *(F.count_if(f).alias(f) for f in ("fast", "brief", "tall_or_wide", "overlaps", "beyond_end")))
    covered = coverage(speech, cues, keys).select(*keys, (100 * F.col("share")).alias("coverage_pct"))
    return durations.join(flags, keys, "left").join(covered, keys, "left").join(sync(cues, speech, keys), keys, "left")


def cue_marks(cues: DataFrame, keys: list[str], most: int = 200) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("t0", "text"))
    return cues.filter("t0 > 0").withColumn("_n", nth).filter(F.col("_n") <= most).select(*keys, F.col("t0").alias("t"), F.substring("text", 1, 46).alias("label"))
