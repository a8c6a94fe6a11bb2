"""Structured Streaming: windowed metric summaries, sessions, runs, latest rows, all with watermarks.

Each function takes a streaming DataFrame with an event time and gives one; those without state of their own take a batch
DataFrame too, and give the batch operator's result, which is how the tests compare them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # as a pattern, the path may be one file or a folder of files
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}.parque[t]")


def summary(events: DataFrame, keys: list[str], time: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(keys, start, end, n, low, high, total) for each window of event time."""
    span = F.window(time, size, slide) if slide else F.window(time, size)
    agg = events.withWatermark(time, late).groupBy(*keys, span.alias("w")).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("total"))
    return agg.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "low", "high", "total")


def sessions(events: DataFrame, keys: list[str], time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(keys, start, end, n): events chained over gaps shorter than `gap`."""
    agg = events.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest(events: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key and time that comes; later ones are dropped while the watermark remembers them."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([*keys])


def flagged_runs(events: DataFrame, key: str, time: str, flag: Column, least: int = 2, late: str = "10 minutes", idle: str = "1 hour") -> DataFrame:
    """(key, t0, t1, n, missed): stretches of at least `least` rows in order of time for which the flag holds.

    A stretch is closed by the first row for which it doesn't, or when the watermark (`late` behind the newest row) has
    passed its key's last row by `idle`; then the key's state goes too. Rows older than one of their key from an earlier
    batch are left out; `missed` counts those since the key's stretch before. For streams only; runs() is the batch form.
    """
    wait = max(1, int(pd.Timedelta(idle).total_seconds() * 1000))

    def step(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end, n, seen, missed = state.get if state.exists else (0, 0, 0, -(1 << 62), 0)
        rows = []
        if state.hasTimedOut:
            state.remove()
            rows = [(who[0], start / 1e6, end / 1e6, n, missed)] if n >= least else []
        else:
            for at, on in sorted(row for b in batches for row in zip(b["us"].tolist(), b["on"].tolist(), strict=True)):
                if at < seen:
                    missed += 1
                    continue
                seen = at
                if on:
                    start, end, n = (at if not n else start), at, n + 1
                    continue
                if n >= least:
                    rows.append((who[0], start / 1e6, end / 1e6, n, missed))
                    missed = 0
                n = 0
            state.update((start, end, n, seen, missed))
            state.setTimeoutTimestamp(max(seen // 1000, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame(rows, columns=["key", "t0", "t1", "n", "missed"])

    marked = events.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("at"), F.coalesce(flag, F.lit(False)).alias("on"))
    marked = marked.withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    return marked.groupBy("key").applyInPandasWithState(step, "key string, t0 double, t1 double, n long, missed long", "start long, end long, n long, seen long, missed long", "append", GroupStateTimeout.EventTimeTimeout)


def overlapping(chunks: DataFrame, key: str, order: str, samples: str, size: int = 512, hop: int = 256) -> DataFrame:
    """(key, block, samples): windows of `size` samples, `hop` apart, over a key's chunks one after the other.

    What a window needs of earlier chunks is carried over as state, fewer than size + hop numbers a key. Chunks have to
    come in order for each key; what doesn't fill a window at the end isn't given. For streams only.
    """

    def step(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, block = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for batch in batches:
            rows = []
            for _, chunk in sorted(zip(batch["at"].tolist(), batch["x"].tolist(), strict=True), key=lambda r: r[0]):
                held.extend(map(float, chunk))
                while len(held) >= size:
                    rows.append((who[0], block, held[:size]))
                    held, block = held[hop:], block + 1
            yield pd.DataFrame(rows, columns=["key", "block", "samples"])
        state.update((held, block))

    asked = chunks.select(F.col(key).cast("string").alias("key"), F.col(order).alias("at"), F.col(samples).cast("array<double>").alias("x"))
    return asked.groupBy("key").applyInPandasWithState(step, "key string, block long, samples array<double>", "held array<double>, block long", "append", GroupStateTimeout.NoTimeout)


def current(results: DataFrame, keys: list[str], epoch: str) -> DataFrame:
    """The results of each key's newest epoch; what an older run of the same question still delivers is superseded.

    In a stream the newest epoch is an aggregate, so use it in foreachBatch or on the table that a sink keeps.
    """
    newest = results.groupBy(*keys).agg(F.max(epoch).alias("_newest"))
    return results.join(newest, keys).filter(F.col(epoch) == F.col("_newest")).drop("_newest")
