"""Reading marks off images: normalised glyphs, a template table, the nearest template."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .images import array_of, gray

HEIGHT, WIDTH = 18, 12


def normalised(least: int = 4) -> Column:
    """The marks of an image from left to right, each as 18 by 12 shares of ink of its crop."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def of(p: pd.Series, hs: pd.Series, ws: pd.Series, cs: pd.Series) -> pd.Series:
        def one(x: np.ndarray) -> list:
            low, high = np.percentile(x, (8, 92))
            ink = x > (low + high) / 2
            ink = ~ink if ink.mean() > 0.5 else ink
            edge = np.flatnonzero(np.diff(np.concatenate(([0], ink.any(axis=0).astype(int), [0]))))
            out = []
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                mark = ink[:, a:b]
                if mark.sum() >= least:
                    rows = np.flatnonzero(mark.any(axis=1))
                    crop = mark[rows[0] : rows[-1] + 1].astype(float)
                    at = np.ix_((np.arange(HEIGHT) * crop.shape[0]) // HEIGHT, (np.arange(WIDTH) * crop.shape[1]) // WIDTH)
                    out.append(crop[at].ravel().tolist())
            return out

        return pd.Series([one(gray(array_of(*v))) for v in zip(p, hs, ws, cs, strict=True)])

    return of("pixels", "h", "w", "c")


def templates(samples: DataFrame) -> DataFrame:
    """(ch, glyph) of images with a known text: marks and characters are paired by place; a sample whose counts differ
    teaches nothing."""
    chars = F.split("text", "")
    read = samples.withColumn("_g", normalised()).filter(F.size("_g") == F.length("text"))
    return read.select(F.explode(F.arrays_zip(chars.alias("ch"), F.col("_g").alias("glyph"))).alias("p")).select("p.ch", "p.glyph").dropDuplicates(["ch", "glyph"])


def texts(image_rows: DataFrame, keys: list[str], bank: DataFrame, most: float = 0.22, shapes: int = 5000) -> DataFrame:
    """(keys, text, distance): each mark's nearest template by mean difference (of equally near ones the first character);
    marks farther than `most` read as ?.

    The bank goes to every task, so it may have `shapes` templates at most (1.7 KB each); more is an error.
    """
    known = bank.select("ch", "glyph").limit(shapes + 1).collect()
    if len(known) > shapes:
        raise ValueError(f"the bank has over {shapes} templates")
    known.sort(key=lambda r: (r.ch, r.glyph))
    names, table = [r.ch for r in known], np.array([r.glyph for r in known]).reshape(-1, HEIGHT * WIDTH)

    @F.pandas_udf("ch string, d double")
    def nearest(marks: pd.Series) -> pd.DataFrame:
        rows = []
        for mark in marks:
            apart = np.abs(table - np.asarray(mark)).mean(axis=1) if names else np.array([np.inf])
            k = int(apart.argmin())
            rows.append((names[k] if names else "?", float(apart[k])))
        return pd.DataFrame(rows, columns=["ch", "d"])

    marks = image_rows.select(*keys, F.posexplode(normalised()).alias("place", "mark")).withColumn("m", nearest("mark"))
    ch = F.when(F.col("m.d") <= most, F.col("m.ch")).otherwise("?")
    row = marks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", ch.alias("ch")))).alias("r"), F.avg("m.d").alias("distance"))
    return row.select(*keys, F.array_join(F.transform("r", lambda x: x.ch), "").alias("text"), "distance")
