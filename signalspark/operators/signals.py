"""Spectra and their uses: flux, bandwidth, mains hum, flicker, novelty, re-used passages.

PCM comes in blocks (keys, block, sr, samples array<float>); each block is transformed by itself in an Arrow function
and the series over blocks is a window. Only the transforms are NumPy; thresholds and medians are columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .series import along, best_first, median, robust_z, rolling_median, spread_out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def magnitudes(samples: pd.Series) -> pd.Series:
    """Hann-windowed magnitudes of the real spectrum of each block."""

    def one(x):
        x = np.asarray(x, np.float64)
        return np.abs(np.fft.rfft(x * np.hanning(len(x)))).tolist() if len(x) > 1 else []

    return samples.map(one)


def _sum(array):
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def block_features(pcm: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, rms_db, flux, rolloff, floor): level, spectral change since the block before, the place below
    which 95 % of the energy lies (as a share of the spectrum), and the level of the quiet tenth of the bins."""
    w = along(keys, ["block"])
    x = F.col("samples")
    rms = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) / F.greatest(F.size(x), F.lit(1)))
    out = pcm.select(*keys, "block", (20 * F.log10(rms + 1e-9)).alias("rms_db"), magnitudes("samples").alias("m"))
    out = out.withColumn("before", F.lag("m").over(w))
    flux = F.when(F.size("before") == F.size("m"), _sum(F.zip_with("m", "before", lambda a, b: F.greatest(a - b, F.lit(0.0)))))
    energy = F.transform("m", lambda v: v * v)
    running = F.aggregate(energy, F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("r")), lambda a, v: F.struct((a.s + v).alias("s"), F.concat(a.r, F.array(a.s + v)).alias("r")), lambda a: a.r)
    total = _sum(energy)
    rolloff = F.size(F.filter(running, lambda v: v < 0.95 * total)) / F.size("m")
    quiet = F.get(F.array_sort("m"), F.floor(F.size("m") / 10).cast("int"))
    return out.select(*keys, "block", "rms_db", flux.alias("flux"), rolloff.alias("rolloff"), (20 * F.log10(quiet + 1e-9)).alias("floor"))


def audio_jumps(features: DataFrame, keys: list[str], hop_s: float, z: float = 9.0, step_db: float = 16.0, apart_s: float = 0.3, most: int = 200) -> DataFrame:
    """Times of sudden spectral change or change of level, at least apart_s apart."""
    w = along(keys, ["block"])
    scored = robust_z(features.withColumn("step", F.abs(F.col("rms_db") - F.lag("rms_db").over(w))).withColumn("t", F.col("block") * hop_s), "flux", keys)
    hits = scored.filter((F.col("z") > z) | (F.col("step") > step_db)).select(*keys, "t")
    kept = spread_out(hits, keys, "t", apart_s)
    return kept.withColumn("_n", F.row_number().over(along(keys, ["t"]))).filter(F.col("_n") <= most).drop("_n")


def audio_splices(features: DataFrame, keys: list[str], hop_s: float = 0.1) -> DataFrame:
    """(keys, t, score): lasting steps of noise floor, level or bandwidth, best first, half a second apart."""
    w = along(keys, ["block"])
    for name in ("floor", "rms_db", "rolloff"):
        features = features.withColumn(f"{name}_a", rolling_median(F.col(name), w, -5, -1)).withColumn(f"{name}_b", rolling_median(F.col(name), w, 0, 4))
    n = F.count(F.lit(1)).over(w.rowsBetween(-5, 4))
    jump = F.abs(F.col("floor_a") - F.col("floor_b"))
    ratio = F.greatest("rolloff_a", "rolloff_b") / F.greatest(F.least("rolloff_a", "rolloff_b"), F.lit(1e-3))
    score = (jump >= 8).cast("int") + (jump >= 14).cast("int") + (ratio >= 1.6).cast("int") + (F.abs(F.col("rms_db_a") - F.col("rms_db_b")) >= 10).cast("int")
    heard = (F.least("rms_db_a", "rms_db_b") >= -65) & (F.least("floor_a", "floor_b") >= -75) & (F.col("_n") == 10)
    scored = features.withColumn("score", score.cast("double")).withColumn("_n", n).filter(heard & (F.col("score") >= 2)).select(*keys, (F.col("block") * hop_s).alias("t"), "score")
    return best_first(scored, keys, "t", "score", 0.5, 20)


def loudness_steps(series: DataFrame, keys: list[str], least_lu: float = 6.0, sustain_s: float = 3.0, step_s: float = 0.1, most: int = 20) -> DataFrame:
    """(keys, t, change): lasting steps of short-term loudness (t, m); after a step the search goes on behind it."""
    w = along(keys, ["t"])
    k = max(3, round(sustain_s / step_s))
    before, after = rolling_median(F.col("m"), w, -k, -1), rolling_median(F.col("m"), w, 0, k - 1)
    settled = rolling_median(F.col("m"), w, k, 2 * k - 1)  # behind the step the level has settled
    full = F.count(F.lit(1)).over(w.rowsBetween(-k, k - 1)) == 2 * k
    steps = series.withColumn("_b", before).withColumn("_a", after).withColumn("_s", F.coalesce(settled, after)).withColumn("_full", full).filter(F.col("_full") & (F.abs(F.col("_a") - F.col("_b")) >= least_lu) & (F.col("_a") > -90) & (F.col("_b") > -90))
    kept = spread_out(steps.select(*keys, "t", (F.col("_s") - F.col("_b")).alias("change")), keys, "t", sustain_s)
    return kept.withColumn("_n", F.row_number().over(along(keys, ["t"]))).filter(F.col("_n") <= most).drop("_n")


def mean_spectrum(pcm: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin, level): mean magnitude of each bin over the blocks."""
    return pcm.select(*keys, F.posexplode(magnitudes("samples")).alias("bin", "v")).groupBy(*keys, "bin").agg(F.avg("v").alias("level"))


def cutoff(spectrum: DataFrame, keys: list[str], hz_per_bin: float, below_db: float = 55.0) -> DataFrame:
    """(keys, cutoff_hz, nyquist_hz): the highest smoothed bin less than below_db under the strongest of 200 to 4000 Hz."""
    half = max(1, round(250 / hz_per_bin))
    w = along(keys, ["bin"]).rowsBetween(-half, half)
    smooth = spectrum.withColumn("db", 20 * F.log10(F.sum("level").over(w) / (2 * half + 1) + 1e-12)).withColumn("hz", F.col("bin") * hz_per_bin)
    top = F.max(F.when(F.col("hz").between(200, 4000), F.col("db"))).over(Window.partitionBy(*keys))
    return smooth.withColumn("top", top).groupBy(*keys).agg(F.max(F.when(F.col("db") > F.col("top") - below_db, F.col("hz"))).alias("cutoff_hz"), F.max("hz").alias("nyquist_hz"))


def bandwidth_verdict(cut: DataFrame) -> DataFrame:
    share = F.col("cutoff_hz") / F.col("nyquist_hz")
    return cut.withColumn("bandwidth", F.when(share < 0.70, "suspicious").when(share < 0.85, "mild").otherwise("full"))


def hum(pcm: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """(keys, block, hz, snr_db): the strongest tone between two frequencies in each block, refined by a parabola."""

    @F.pandas_udf(T.StructType([T.StructField("hz", T.DoubleType()), T.StructField("snr_db", T.DoubleType())]))
    def peak(samples: pd.Series, sr: pd.Series) -> pd.DataFrame:
        rows = []
        for x, rate in zip(samples, sr, strict=True):
            x = np.asarray(x, np.float64)
            m = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)), 4 * len(x))) + 1e-12
            hz = np.arange(len(m)) * rate / (4 * len(x))
            band = np.flatnonzero((hz >= low) & (hz <= high))
            if not len(band):
                rows.append((None, None))
                continue
            k = int(band[np.argmax(m[band])])
            a, b, c = np.log(m[max(0, k - 1) : k + 2]) if 0 < k < len(m) - 1 else (0.0, 0.0, 0.0)
            shift = 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c else 0.0
            around = np.flatnonzero((hz >= low - 8) & (hz <= high + 8) & (np.abs(hz - hz[k]) > 0.6))
            rows.append(((k + shift) * rate / (4 * len(x)), 20 * np.log10(m[k] / np.median(m[around])) if len(around) else None))
        return pd.DataFrame(rows, columns=["hz", "snr_db"], dtype="float64")

    return pcm.select(*keys, "block", peak("samples", "sr").alias("p")).select(*keys, "block", "p.*")


def hum_verdict(trace: DataFrame, keys: list[str], jump_hz: float = 0.08) -> DataFrame:
    """(keys, present, jumps, gaps): whether mains hum is there, and where it leaps between good neighbours."""
    w = along(keys, ["block"])
    good = (F.col("snr_db") >= 6) & (F.lag("snr_db").over(w) >= 6)
    marked = trace.withColumn("leap", F.coalesce(good & (F.abs(F.col("hz") - F.lag("hz").over(w)) > jump_hz), F.lit(False)))
    present = (median(F.col("snr_db")) >= 10) & (F.avg((F.col("snr_db") >= 6).cast("double")) >= 0.7)
    return marked.groupBy(*keys).agg(present.alias("present"), F.count_if("leap").alias("jumps"), F.count_if(F.col("snr_db") < 6).alias("gaps"))


def flicker(frames: DataFrame, keys: list[str], fps: float, value: str, low: float = 0.2, high: float = 4.0) -> DataFrame:
    """(keys, hz, ratio): the strongest slow tone of a luma series against the median power of all its frequencies.

    Every frequency of the band is searched: a series of at least four seconds is gathered, as two numbers a frame,
    and transformed whole. Frames without a value count as the mean.
    """
    types = frames.schema

    def tone(rows: pd.DataFrame) -> pd.DataFrame:
        n = len(rows)
        frame, x = rows["_frame"].to_numpy(np.int64), rows["_x"].to_numpy(np.float64)
        x = np.nan_to_num(x - np.nanmean(x) if not np.isnan(x).all() else np.zeros(n))
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * frame / (n - 1))
        power = np.abs(np.fft.rfft(np.bincount(frame % n, x * hann, n))) ** 2
        hz = np.arange(len(power)) * fps / n
        band = np.flatnonzero((hz >= low) & (hz <= high) & (hz > 0))
        out = rows[keys].iloc[:1].copy()
        if not len(band):
            return out.iloc[:0].assign(hz=0.0, ratio=0.0)
        k = band[np.argmax(power[band])]
        return out.assign(hz=hz[k], ratio=power[k] / (np.median(power[1:]) + 1e-12))

    long = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") >= 4 * fps) & (F.col("_n") > 1)).drop("_n")
    series = frames.join(long, keys, "left_semi").select(*keys, F.col("frame").alias("_frame"), F.col(value).cast("double").alias("_x"))
    return series.groupBy(*keys).applyInPandas(tone, T.StructType([*(types[k] for k in keys), T.StructField("hz", T.DoubleType()), T.StructField("ratio", T.DoubleType())]))


def novelty(features: DataFrame, keys: list[str], half: int, x: str = "flux") -> DataFrame:
    """features plus score: how far a value lies above the mean around it, in mean deviations; the ends count as zeros."""
    w = along(keys, ["block"]).rowsBetween(-half, half)
    k = 2 * half + 1
    out = features.withColumn("_m", F.sum(F.coalesce(F.col(x), F.lit(0.0))).over(w) / k)
    out = out.withColumn("_d", F.sum(F.abs(F.coalesce(F.col(x), F.lit(0.0)) - F.col("_m"))).over(w) / k)
    return out.withColumn("score", (F.coalesce(F.col(x), F.lit(0.0)) - F.col("_m")) / (F.col("_d") + 1e-9)).drop("_m", "_d")


def music_cuts(features: DataFrame, keys: list[str], hop_s: float, least: float = 8.0) -> DataFrame:
    scored = novelty(features, keys, max(1, round(1.5 / hop_s))).filter(F.col("score") >= least).select(*keys, (F.col("block") * hop_s).alias("t"), "score")
    return best_first(scored, keys, "t", "score", 0.35, 12)


#: Passages that go to a task together.
_TILE = 1024


def reused(features: DataFrame, keys: list[str], cuts: DataFrame, hop_s: float, span_s: float = 3.0, away_s: float = 6.0) -> DataFrame:
    """(keys, t, source, likeness): for the passage after each cut its likest earlier passage, of equally like ones the first.

    A passage is its blocks' spectra in bands, all blocks there and all bands known. All cuts are compared with all
    passages before them, so the work is their product: tiles of passages meet, a pair of tiles a row, and a task holds
    the likenesses of one pair.
    """
    n, away = round(span_s / hop_s), round(away_s / hop_s)
    row = F.collect_list(F.struct("block", "bands")).over(along(keys, ["block"]).rowsBetween(0, n - 1))
    whole = features.select(*keys, F.col("block").alias("_at"), row.alias("_row")).filter((F.size("_row") == n) & (F.col("_row")[n - 1]["block"] == F.col("_at") + n - 1) & (F.col("_at") >= 0))
    passages = whole.select(*keys, "_at", F.flatten(F.transform("_row", lambda r: r["bands"])).cast("array<double>").alias("_v")).filter(F.col("_v").isNotNull() & ~F.exists("_v", F.isnull))
    after = cuts.select(*keys, F.rint(F.col("t") / hop_s).cast("long").alias("_at")).distinct()
    tiled = lambda df: df.groupBy(*keys, F.size("_v").alias("_size"), F.floor(F.col("_at") / _TILE).alias("_tile")).agg(F.sort_array(F.collect_list(F.struct("_at", "_v"))).alias("_rows"))
    columns = lambda name: (F.col("_rows")["_at"].alias(f"_{name}"), F.col("_rows")["_v"].alias(f"_{name}_v"))
    met = [*keys, "_size", "_tile"]
    # Spark sizes tiles too low to be left the choice of a broadcast, or of how many tasks compare them
    parts = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = tiled(passages.join(after, [*keys, "_at"], "left_semi")).select(*keys, "_size", F.explode(F.sequence(F.lit(0).cast("long"), "_tile")).alias("_tile"), *columns("start"))
    pairs = asked.repartition(parts, *met).hint("shuffle_merge").join(tiled(passages).select(*met, *columns("source")).repartition(parts, *met), met)

    @F.arrow_udf("array<struct<start: long, likeness: double, source: long>>")
    def likest(start: pa.Array, start_v: pa.Array, source: pa.Array, source_v: pa.Array) -> pa.Array:
        flat = lambda x: x.values.to_numpy()
        wide = lambda x: x.values.flatten().to_numpy().reshape(len(x.values), -1)
        return pa.array([_likest(flat(a), wide(u), flat(b), wide(v), n, away) for a, u, b, v in zip(start, start_v, source, source_v, strict=True)], kind)

    kind = pa.list_(pa.struct([("start", pa.int64()), ("likeness", pa.float64()), ("source", pa.int64())]))
    found = pairs.select(*keys, F.explode(likest("_start", "_start_v", "_source", "_source_v")).alias("r")).select(*keys, "r.*")
    best = found.groupBy(*keys, "start").agg(F.max_by("source", F.struct("likeness", -F.col("source"))).alias("s"), F.max("likeness").alias("likeness"))
    return best.select(*keys, (F.col("start") * hop_s).alias("t"), (F.col("s") * hop_s).alias("source"), "likeness")


def _likest(start: np.ndarray, u: np.ndarray, source: np.ndarray, v: np.ndarray, n: int, away: int) -> list[dict]:
    """For each passage of u the likest of v that begins `away` blocks before it or earlier, the first of equal ones. Products
    are summed one after the other, block by block, so that equal passages are equally like."""
    size = u.shape[1] // n

    def summed(products: Callable[[int], np.ndarray]) -> np.ndarray:
        return sum(sum((products(b * size + k) for k in range(1, size)), products(b * size)) for b in range(n))

    both = summed(lambda k: u[:, k, None] * v[None, :, k])
    like = both / (np.sqrt(summed(lambda k: u[:, k] ** 2)[:, None] * summed(lambda k: v[:, k] ** 2)[None, :]) + 1e-12)
    like[source[None, :] > start[:, None] - away] = -np.inf
    at = like.argmax(axis=1)
    return [{"start": int(s), "likeness": float(like[i, k]), "source": int(source[k])} for i, (s, k) in enumerate(zip(start, at, strict=True)) if source[k] <= s - away]


def bands(pcm: DataFrame, keys: list[str], count: int = 24) -> DataFrame:
    """(keys, block, bands): each block's spectrum summed in equal bands."""
    m = F.col("m")
    cut = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: _sum(F.slice(m, F.floor(k * F.size(m) / count).cast("int") + 1, F.greatest(F.lit(1), F.floor((k + 1) * F.size(m) / count).cast("int") - F.floor(k * F.size(m) / count).cast("int")))))
    return pcm.select(*keys, "block", magnitudes("samples").alias("m")).select(*keys, "block", cut.alias("bands"))


def cadence(frames: DataFrame, keys: list[str], change: str, comb: str) -> DataFrame:
    """(keys, dup_pct, spacing, comb_pct, label): repeated frames, how far apart they are, and interlacing."""
    whole, w = Window.partitionBy(*keys), along(keys, ["frame"])
    dup = F.col(change) < F.greatest(F.lit(0.3), 0.12 * F.col("_m"))
    marked = frames.withColumn("_m", median(F.col(change), whole)).withColumn("dup", F.coalesce(dup, F.lit(False)))
    last = F.last(F.when(F.col("dup"), F.col("frame")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("gap", F.when(F.col("dup"), F.col("frame") - last))
    agg = marked.groupBy(*keys).agg((100 * F.avg(F.col("dup").cast("double"))).alias("dup_pct"), median(F.col("gap")).alias("spacing"), (100 * F.avg((F.col(comb) > 1.5).cast("double"))).alias("comb_pct"))
    label = F.when(F.col("dup_pct").between(16, 24) & F.col("spacing").between(4, 6), "2:3 pulldown").when(F.col("dup_pct") >= 40, "heavy duplicates").when(F.col("comb_pct") > 15, "interlaced").when(F.col("dup_pct") >= 3, "duplicates").otherwise("regular")
    return agg.withColumn("label", label)


def flash_rate(frames: DataFrame, keys: list[str], value: str, swing: float, fps: float) -> DataFrame:
    """(keys, per_second): the most flashes (pairs of swings) in any full second."""
    size = max(1, round(fps))
    w = along(keys, ["frame"])
    swung = frames.withColumn("_s", F.coalesce((F.abs(F.col(value) - F.lag(value).over(w)) >= swing).cast("int"), F.lit(0)))
    rolled = swung.withColumn("_r", F.sum("_s").over(w.rowsBetween(-(size - 1), 0))).withColumn("_n", F.count(F.lit(1)).over(w.rowsBetween(-(size - 1), 0)))
    agg = rolled.groupBy(*keys).agg(F.max(F.when(F.col("_n") == size, F.col("_r"))).alias("full"), F.sum("_s").alias("all"))
    return agg.select(*keys, F.round(F.coalesce("full", "all") / 2, 2).alias("per_second"))


def flash_risk(frames: DataFrame, keys: list[str], luma: str, bits: str, jump: float = 40.0) -> DataFrame:
    """Frames whose mean luma leaps by `jump` of 255, scaled to the bit depth. The leap has six decimals, and it is these that
    reach the jump or don't: a difference such as 60.1 - 20.1 lies a little beside its own value."""
    w = along(keys, ["frame"])
    leap = frames.withColumn("leap", F.round(F.abs(F.col(luma) - F.lag(luma).over(w)) * 1e6) / 1e6)
    return leap.filter(F.col("leap") >= jump * (F.pow(F.lit(2.0), F.col(bits)) - 1) / 255)
