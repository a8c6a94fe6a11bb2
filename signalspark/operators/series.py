"""Building blocks over ordered series: differences, runs, chains, robust outliers, rolling medians, greedy picks.

Every function takes the key columns (one series each) and the order columns, so it works on any table. Series are
independent, which is what spreads them over a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def along(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def delta(x: Column, w: WindowSpec) -> Column:
    """The change since the row before; null in the first row."""
    return x - F.lag(x).over(w)


def mark_runs(df: DataFrame, flag: Column, keys: list[str], order: list[str], name: str = "run") -> DataFrame:
    """A number for each stretch of rows with an equal flag (nulls count as a value of their own)."""
    w = along(keys, order)
    changed = F.when(flag.eqNullSafe(F.lag(flag).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_changed", changed).withColumn(name, F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def runs(df: DataFrame, flag: Column, keys: list[str], order: list[str], time: str, min_len: float = 0.0, step: float = 0.0, more: list[Column] | None = None) -> DataFrame:
    """(keys, t0, t1, n): stretches where the flag holds, at least min_len long; `step` is added behind the last row."""
    held = mark_runs(df.withColumn("_flag", F.coalesce(flag, F.lit(False))), F.col("_flag"), keys, order, "_run").filter("_flag")
    out = held.groupBy(*keys, "_run").agg(F.min(time).alias("t0"), (F.max(time) + step).alias("t1"), F.count(F.lit(1)).alias("n"), *(more or []))
    return out.filter(F.col("t1") - F.col("t0") >= min_len).drop("_run")


def chain(df: DataFrame, keys: list[str], start: str, end: str, gap: float) -> DataFrame:
    """(keys, t0, t1, n): intervals in order of start, joined where the gap to all before is at most `gap`."""
    w = along(keys, [start, end])
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(before.isNull() | (F.col(start) - before > gap), 1).otherwise(0)
    numbered = df.withColumn("_apart", apart).withColumn("_chain", F.sum("_apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_chain").agg(F.min(start).alias("t0"), F.max(end).alias("t1"), F.count(F.lit(1)).alias("n")).drop("_chain")


def median(x: Column, w: WindowSpec | None = None) -> Column:
    """The mean of the middle two for an even count."""
    m = F.percentile(x, F.lit(0.5))
    return m if w is None else m.over(w)


def upper_median(x: Column) -> Column:
    """The value at place n // 2 of the sorted values."""
    values = F.array_sort(F.collect_list(x))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def robust_z(df: DataFrame, x: str, keys: list[str], eps: float = 1e-9, eps_inside: bool = True, name: str = "z") -> DataFrame:
    """(x - median) over 1.4826 times the median absolute deviation; eps is added inside or outside of the factor."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("_med", median(F.col(x), w))
    df = df.withColumn("_mad", median(F.abs(F.col(x) - F.col("_med")), w))
    spread = 1.4826 * (F.col("_mad") + eps) if eps_inside else 1.4826 * F.col("_mad") + eps
    return df.withColumn(name, (F.col(x) - F.col("_med")) / spread).drop("_med", "_mad")


def rolling_median(x: Column, w: WindowSpec, first: int, last: int) -> Column:
    return F.percentile(x, F.lit(0.5)).over(w.rowsBetween(first, last))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    if not keys:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= k).drop("_nth")


def drop_repeats(df: DataFrame, x: str, keys: list[str], order: list[str]) -> DataFrame:
    """Without rows whose value equals that of the row before."""
    w = along(keys, order)
    return df.withColumn("_same", F.col(x).eqNullSafe(F.lag(x).over(w)) & (F.row_number().over(w) > 1)).filter(~F.col("_same")).drop("_same")


def spread_out(df: DataFrame, keys: list[str], time: str, gap: float) -> DataFrame:
    """Greedy in time: a row stays if it's over `gap` after the last row that stayed. State is one number a series.
    Rows without a time are left out."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for batch in batches:
            keep = []
            for *k, t in batch[[*keys, time]].itertuples(index=False):
                if k != key:
                    key, last = k, None
                stays = last is None or t - last > gap
                last = t if stays else last
                keep.append(stays)
            yield batch[keep]

    ordered = df.filter(F.col(time).isNotNull() & ~F.isnan(time)).repartition(*keys).sortWithinPartitions(*keys, time)
    return ordered.mapInPandas(stream, df.schema)


def best_first(df: DataFrame, keys: list[str], time: str, score: str, radius: float, most: int) -> DataFrame:
    """Greedy by score: a row stays if no better row within `radius` stayed; at most `most` in a series.

    A series' kept rows are its only state; rows come in order of score. Rows without a time or score are left out.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept = None, []
        for batch in batches:
            keep = []
            for *k, t in batch[[*keys, time]].itertuples(index=False):
                if k != key:
                    key, kept = k, []
                stays = len(kept) < most and all(abs(t - u) >= radius for u in kept)
                if stays:
                    kept.append(t)
                keep.append(stays)
            yield batch[keep]

    known = [F.col(c).isNotNull() & ~F.isnan(c) for c in (time, score)]
    ordered = df.filter(known[0] & known[1]).repartition(*keys).sortWithinPartitions(*keys, F.desc(score), time)
    return ordered.mapInPandas(stream, df.schema)


def cut_points(df: DataFrame, keys: list[str], order: str, x: str, least: int = 24, depth: int = 3) -> DataFrame:
    """(keys, segment, n, x0, x1, slope): x over order cut where two straight lines fit four times better than one.

    Each level measures every possible cut of every segment from running sums, so a level is one window pass; a cut
    needs `least` rows in the segment and max(8, n // 40) on either side.
    """
    seg = df.withColumn("segment", F.lit(1))
    for _ in range(depth):
        whole = Window.partitionBy(*keys, "segment")
        w = whole.orderBy(order)
        run = w.rowsBetween(Window.unboundedPreceding, -1)
        part = seg.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_k", F.row_number().over(w) - 1)
        a, b = F.col(order).cast("double"), F.col(x).cast("double")

        # the sums of the rows from a cut on are those of all rows less those before it
        sums = {"n": F.lit(1), "x": a, "y": b, "xx": a * a, "xy": a * b, "yy": b * b}
        for name, v in sums.items():
            part = part.withColumn(f"_all_{name}", F.sum(v).over(whole)).withColumn(f"_run_{name}", F.coalesce(F.sum(v).over(run), F.lit(0)))

        def residual(of):
            n, x, y, xx, xy, yy = (of(name) for name in sums)
            n = F.nullif(n, F.lit(0))
            vx, vxy, vy = xx - x * x / n, xy - x * y / n, yy - y * y / n
            return F.greatest(F.when(vx > 0, vy - vxy * vxy / vx).otherwise(vy), F.lit(0.0))

        before, after = residual(lambda s: F.col(f"_run_{s}")), residual(lambda s: F.col(f"_all_{s}") - F.col(f"_run_{s}"))
        part = part.withColumn("_one", residual(lambda s: F.col(f"_all_{s}"))).withColumn("_two", F.coalesce(before, F.lit(0.0)) + after)
        side = F.greatest(F.lit(8), F.floor(F.col("_n") / 40))
        may = (F.col("_n") >= least) & (F.col("_k") >= side) & (F.col("_n") - F.col("_k") >= side) & (F.col("_k") % side == 0)
        part = part.withColumn("_best", F.min(F.when(may, F.struct("_two", "_k"))).over(whole))
        cut = F.col("_best").isNotNull() & (F.col("_best._two") <= F.col("_one") / 4) & (F.col("_k") >= F.col("_best._k"))
        seg = part.withColumn("segment", F.col("segment") * 2 + F.when(cut, 1).otherwise(0)).select(*df.columns, "segment")
    out = seg.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("x0"), F.max(order).alias("x1"), F.regr_slope(x, order).alias("slope"))
    return out.withColumn("segment", F.row_number().over(along(keys, ["x0"])))
