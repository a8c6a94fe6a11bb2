"""Analyses composed of operators: one pass over frames, the splice scan, the audio battery, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.operators import aggregates, findings, qc, segments, series, signals


def analysis(frames: DataFrame, keys: list[str], metrics: list[str], still: float, cut: float) -> dict[str, DataFrame]:
    """Summary, black and frozen segments, scene cuts: all from one table of frames, which is scanned with only the
    columns that each needs."""
    cuts = frames.filter(F.col("scene") > cut).select(*keys, "frame", "t")
    return {
        "summary": aggregates.metric_summary(frames, keys, metrics),
        "black": segments.black(frames, F.col("black_ratio"), keys),
        "freeze": segments.frozen(frames, F.col("ydif"), keys, still),
        "cuts": series.drop_repeats(cuts, "t", keys, ["frame"]),
    }


def splices(packets: DataFrame, audio: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Splice candidates from sizes, times, key frames and audio."""
    of = lambda df, kind: df.select(*keys, F.col("t").cast("double").alias("t"), F.lit(kind).alias("kind"))
    signs = of(findings.size_jumps(packets, keys), "size").unionByName(of(findings.time_gaps(packets, keys), "pts")).unionByName(of(findings.early_keys(packets, keys), "idr")).unionByName(of(audio, "audio"))
    ends = packets.groupBy(*keys).agg(F.max("t").alias("duration"))
    return findings.splice_candidates(signs, cuts, ends, keys)


def audio_battery(pcm: DataFrame, samples: DataFrame, keys: list[str], rate: float, hop_s: float) -> DataFrame:
    """Findings (keys, severity, area, t, text, part) of clipping, dropouts, clicks and splices."""
    clip = segments.clipping(samples, keys, rate, least=max(3, int(0.0008 * rate)))
    many = clip.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("t0").alias("t"))
    row = lambda df, severity, area, text: df.select(*keys, severity.alias("severity"), F.lit(area).alias("area"), F.col("t").cast("double").alias("t"), text.alias("text"))
    parts = [
        row(many, F.when(F.col("n") >= 3, "warn").otherwise("info"), "clipping", F.format_string("%d clipped stretches", "n")),
        row(segments.dropouts(samples, keys, rate), F.lit("warn"), "dropout", F.format_string("silent for %.3f s", "duration")),
        row(segments.clicks(samples, keys, rate), F.lit("info"), "click", F.format_string("jump of %.3f", "jump")),
        row(signals.audio_splices(signals.block_features(pcm, keys), keys, hop_s), F.lit("warn"), "audio splice", F.format_string("score %.0f", "score")),
    ]
    return findings.union(parts)


def forensics(parts: list[DataFrame], cuts: DataFrame, keys: list[str]) -> DataFrame:
    """All findings, audio splices at cuts demoted, ranked."""
    return findings.ranked(findings.demoted(findings.union(parts), cuts, keys), keys)


def tempo(cadence: DataFrame, cutoffs: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, label): how likely a recording was slowed or sped up."""
    joined = records.join(cadence, keys, "left").join(cutoffs, keys, "left")
    mismatch = F.when(F.abs(F.col("fps") / F.col("nominal_fps") - 1) > 0.02, 0.15).otherwise(0.0)
    regular = (F.col("duplicates") >= 6) & (F.col("spacing") >= 2) & (F.col("spacing_mad") / F.col("spacing") < 0.25) & (F.col("dup_pct") >= 12)
    dup = F.when(regular, 0.45).when(F.col("dup_pct") >= 40, 0.3).when(F.col("dup_pct") >= 12, 0.1).otherwise(0.0)
    band = F.when(F.col("cutoff_hz") / F.col("nyquist_hz") < 0.40, 0.3).when(F.col("cutoff_hz") / F.col("nyquist_hz") < 0.55, 0.1).otherwise(0.0)
    score = F.least(F.lit(1.0), F.round(F.coalesce(mismatch, F.lit(0.0)) + dup + band, 2))
    return joined.select(*keys, score.alias("score")).withColumn("label", F.when(F.col("score") >= 0.6, "likely changed").when(F.col("score") >= 0.3, "possibly changed").otherwise("unchanged"))


def platform(records: DataFrame) -> DataFrame:
    """records plus platform: whether a file looks as a platform delivers it, or was processed again."""
    handler, tool = F.lower(F.coalesce("handler", F.lit(""))), F.lower(F.coalesce("encoder", F.lit("")))
    verdict = F.when(F.contains(handler, F.lit("google")) | F.contains(handler, F.lit("youtube")), "platform").when(F.col("format") == "mpegts", "broadcast").when(F.col("settings").isNotNull(), "direct encode").when(F.contains(tool, F.lit("lavf")), "processed").otherwise("unknown")
    return records.withColumn("platform", verdict)


def verification(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verdict): review if any row asks for it, else note if any, else clear."""
    return findings.worst(rows, keys, "verdict", findings.VERDICTS)


def analog(frames: DataFrame, keys: list[str], fps: float, head_ratio: float = 2.6, jitter_px: float = 0.55) -> tuple[DataFrame, DataFrame]:
    """((keys, frames, dropout_pct, head_switch_pct, jitter_pct), events (keys, t, kind, severity, text)) of frames with
    dropouts (an array of rows), head (the ratio of the last rows) and jitter (pixels).

    Each frame with dropouts is an event; of frames that wobble the first, the fifth and every sixtieth. Over half the
    frames with rough last rows, or a quarter that wobble, is an event of the whole file.
    """
    marked = frames.withColumn("_drop", F.size("dropouts") > 0).withColumn("_head", F.coalesce(F.col("head") > head_ratio, F.lit(False))).withColumn("_wobble", F.coalesce(F.col("jitter") > jitter_px, F.lit(False)))
    pct = lambda c, digits: F.round(100 * F.avg(F.col(c).cast("double")), digits)
    stats = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), pct("_drop", 2).alias("dropout_pct"), pct("_head", 1).alias("head_switch_pct"), pct("_wobble", 1).alias("jitter_pct"), F.avg(F.col("_head").cast("double")).alias("_h"), F.avg(F.col("_wobble").cast("double")).alias("_w"))
    row = lambda df, t, kind, severity, text: df.select(*keys, t.cast("double").alias("t"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), text.alias("text"))
    at = F.col("frame") / fps
    nth = F.row_number().over(series.along(keys, ["frame"]))
    wobbles = marked.filter("_wobble").withColumn("_n", nth).filter("_n IN (1, 5) OR _n % 60 = 0")
    events = row(marked.filter("_drop"), at, "dropout", "warn", F.concat(F.lit("streaks at rows "), F.array_join(F.transform(F.slice("dropouts", 1, 4), lambda r: r.cast("string")), ",")))
    events = events.unionByName(row(wobbles, at, "jitter", "info", F.format_string("line wobble of %.2f px", "jitter")))
    events = events.unionByName(row(stats.filter("_h > 0.5"), F.lit(0), "head_switch", "warn", F.format_string("rough last rows on %.0f%% of frames", F.rint(100 * F.col("_h")))))
    events = events.unionByName(row(stats.filter("_w > 0.25"), F.lit(0), "jitter", "warn", F.format_string("line wobble on %.0f%% of frames", F.rint(100 * F.col("_w")))))
    return stats.drop("_h", "_w"), events


# fixed values: codecs that keep the lowest bits, and codecs that carry free data in messages
LOSSLESS = ("ffv1", "huffyuv", "ffvhuff", "utvideo", "magicyuv", "rawvideo", "qtrle", "msrle", "png", "apng", "tiff", "v210", "r210", "ljpeg", "gif")
MESSAGING = ("h264", "avc", "h265", "hevc")


def hidden_data_scan(records: DataFrame, channels: DataFrame, tallies: DataFrame, anomalies: DataFrame, container: DataFrame, keys: list[str]) -> DataFrame:
    """Findings (keys, severity, kind, offset, size) of hidden data, container findings first.

    Lowest bits count for lossless codecs of 8 bits, where over a tenth of the sampled frames, and more than one, are
    suspicious; free data in messages from 2 KB on; frames far larger than their picture is complex are information.
    """
    row = lambda df, severity, kind, size: df.select(*keys, F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("offset"), size.cast("long").alias("size"))
    keeps = records.filter(F.lower("codec").isin(*LOSSLESS) & (F.coalesce("bit_depth", F.lit(8)) == 8)).select(*keys)
    frames = channels.join(keeps, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("suspicious").alias("odd"))
    bits = row(frames.filter(F.col("odd") > F.greatest(F.lit(1), F.floor(F.col("n") / 10))), "warn", "lsb", F.lit(0))
    carries = records.filter(F.lower("codec").isin(*MESSAGING)).select(*keys)
    free = row(tallies.join(carries, keys).filter("user_bytes > 2048"), "warn", "sei_userdata", F.col("user_bytes"))
    large = row(anomalies.select(*keys).distinct(), "info", "size_anomaly", F.lit(0))
    return container.select(*keys, "severity", "kind", "offset", "size").unionByName(bits).unionByName(free).unionByName(large)


def hidden_data_marks(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, label): one mark at the beginning for findings that have a place in the file, by the first of their kinds."""
    order = F.array_position(F.array(*(F.lit(k) for k in ("appended_data", "embedded_file", "padding_atom", "mdat_gap", "sei_userdata"))), F.col("kind"))
    placed = found.withColumn("_order", order).filter("_order > 0")
    return placed.groupBy(*keys).agg(F.min_by("kind", F.struct("_order", "offset")).alias("label")).select(*keys, F.lit(0.0).alias("t"), "label")


#: What a platform's own encoder wipes out or brings in: traces of cuts, of a first compression, of the camera's noise.
FADING = {"strong_splices", "double_quant", "noise_outliers"}


def weakened_ids(profile: str = "integrity") -> list[str]:
    """The checks of a profile whose evidence an encoder takes away."""
    return [x.id for x in qc.checks_of(profile) if FADING & set(x.needs)]


def weakened(checks: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """checks plus weakened: whether the file was encoded anew and the check's evidence with it."""
    again = records.select(*keys, F.col("reencoded").alias("_again"))
    return checks.join(again, keys, "left").withColumn("weakened", F.coalesce(F.col("_again"), F.lit(False)) & F.col("check_id").isin(weakened_ids())).drop("_again")
