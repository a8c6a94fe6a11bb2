"""Exports: per-frame rows, CSV, the analysis document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.functions.text import finite


def frame_rows(frames: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Rows as exported: time to four places, NaN as null."""
    return frames.select(*keys, "frame", (F.rint(F.col("t") * 10000) / 10000).alias("t"), *(finite(F.col(m)).alias(m) for m in metrics))


def write_csv(rows: DataFrame, path: str, extra: DataFrame | None = None, on: list[str] | None = None) -> None:
    """CSV with a header; extra series are joined by frame, nulls are empty cells."""
    out = rows.join(extra, on, "left") if extra is not None else rows
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def documents(media: DataFrame, rows: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each media: its record, events and frames in order, as nested columns. The frames of a file are
    bounded by its length, which a document holds whole."""
    frames = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame", *(c for c in rows.columns if c not in (*keys, "frame"))))).alias("frames"))
    found = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("kind", "t0", "t1"))).alias("events"))
    return media.join(found, keys, "left").join(frames, keys, "left")


def write_json(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)
