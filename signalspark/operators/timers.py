"""On-screen timers read off frames: jumps, freezes, segments, drift. Readings are (keys, t, secs); unread ones null."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import along, cut_points, runs


def changes(readings: DataFrame, keys: list[str], order: str = "frame") -> DataFrame:
    """readings that were read, plus change (of the timer) and passed (of the video) since the reading before."""
    w = along(keys, [order])
    read = readings.filter(F.col("secs").isNotNull())
    return read.withColumn("change", (F.col("secs") - F.lag("secs").over(w)).cast("double")).withColumn("passed", F.col("t") - F.lag("t").over(w))


def jumps(readings: DataFrame, keys: list[str], fps: float, order: str = "frame", back_s: float = 0.25) -> DataFrame:
    """Readings that leap: backward by over back_s, or ahead by far more than the video went on."""
    back = F.col("change") < -back_s
    ahead = F.col("change") > 4 * F.greatest("passed", F.lit(1 / fps)) + 0.75
    return changes(readings, keys, order).filter(back | ahead).withColumn("kind", F.when(back, "backward").otherwise("skip"))


def frozen(readings: DataFrame, keys: list[str], order: str = "frame", least_s: float = 3.0) -> DataFrame:
    """(keys, t0, t1, n): stretches in which the timer stands still for over least_s."""
    return runs(changes(readings, keys, order), F.col("change") == 0, keys, [order], "t").filter(F.col("t1") - F.col("t0") > least_s)


def drift(readings: DataFrame, keys: list[str], order: str = "frame", least: int = 8, least_s: float = 4.0) -> DataFrame:
    """(keys, segment, n, slope, span): seconds of the timer for each second of video, between backward leaps."""
    w = along(keys, [order]).rowsBetween(Window.unboundedPreceding, 0)
    broke = changes(readings, keys, order).withColumn("_b", F.when(F.col("change") < -0.25, 1).otherwise(0))
    cut = broke.withColumn("segment", F.sum("_b").over(w))
    agg = cut.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("secs", "t").alias("slope"), (F.max("t") - F.min("t")).alias("span"))
    return agg.filter((F.col("n") >= least) & (F.col("span") >= least_s))


def drift_verdict(segments: DataFrame, keys: list[str], limit: float = 0.01) -> DataFrame:
    """(keys, slope, flagged): the mean slope weighted by span, and how many segments are off by over the limit."""
    return segments.groupBy(*keys).agg((F.sum(F.col("slope") * F.col("span")) / F.sum("span")).alias("slope"), F.count_if(F.abs(F.col("slope") - 1) > limit).alias("flagged"))


def speed_changes(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches of one speed, cut where two lines fit far better than one."""
    return cut_points(readings.filter(F.col("secs").isNotNull()), keys, "t", "secs")
