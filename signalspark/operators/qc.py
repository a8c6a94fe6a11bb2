"""Quality-control rules, profiles and verdicts over one wide row for each media; null is 'not measured'."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import RANK, rank_of


@dataclass(frozen=True)
class Check:
    """An id, a label, and its status as a Column over the wide row."""

    id: str
    label: str
    status: Column
    needs: tuple[str, ...]


def c(name: str) -> Column:
    return F.col(name)


def loudness(low: float, high: float) -> Check:
    i = c("integrated_lufs")
    inside, near = i.between(low, high), i.between(low - 2, high + 2)
    return Check("loudness", f"Loudness {low:g} to {high:g} LUFS", F.when(i.isNull(), "warn").when(i <= -69, "fail").when(inside, "pass").when(near, "warn").otherwise("fail"), ("integrated_lufs",))


def true_peak(most: float) -> Check:
    p = c("true_peak_dbfs")
    return Check("true_peak", f"True peak at most {most:g} dBFS", F.when(p.isNull(), "warn").when(p <= most, "pass").when(p <= most + 1, "warn").otherwise("fail"), ("true_peak_dbfs",))


def none_of(id: str, label: str, count: str, severity: str) -> Check:
    return Check(id, label, F.when(c(count).isNull() | (c(count) == 0), "pass").otherwise(severity), (count,))


def at_most(id: str, label: str, value: str, limit: float, severity: str = "warn") -> Check:
    return Check(id, label, F.when(c(value).isNull() | (c(value) <= limit), "pass").otherwise(severity), (value,))


def below(id: str, label: str, value: str, limit: float, severity: str = "warn") -> Check:
    return Check(id, label, F.when(c(value).isNull() | (c(value) < limit), "pass").otherwise(severity), (value,))


def holds(id: str, label: str, flag: str, severity: str = "warn") -> Check:
    return Check(id, label, F.when(F.coalesce(c(flag), F.lit(False)), "pass").otherwise(severity), (flag,))


def absent(id: str, label: str, flag: str, severity: str = "warn") -> Check:
    return Check(id, label, F.when(F.coalesce(c(flag), F.lit(False)), severity).otherwise("pass"), (flag,))


def matches(id: str, label: str, text: str, pattern: str, severity: str = "warn") -> Check:
    return Check(id, label, F.when(F.coalesce(F.rlike(c(text), F.lit(pattern)), F.lit(False)), severity).otherwise("pass"), (text,))


def broadcast_range(limit: float) -> Check:
    return Check("range", f"At most {limit:.0%} out of broadcast range", F.when(F.coalesce(c("is_hdr"), F.lit(False)) | c("brng_p99").isNull() | (c("brng_p99") <= limit), "pass").otherwise("warn"), ("is_hdr", "brng_p99"))


def hdr_signalling() -> Check:
    return Check("hdr", "HDR signalling complete", F.when(~F.coalesce(c("is_hdr"), F.lit(False)) | c("hdr_complete"), "pass").otherwise("warn"), ("is_hdr", "hdr_complete"))


def recompression(limit: float = 0.35) -> Check:
    return Check("recompress", "Not compressed twice", F.when(F.coalesce(c("platform_reencode"), F.lit(False)) | c("double_quant").isNull() | (c("double_quant") <= limit), "pass").otherwise("warn"), ("platform_reencode", "double_quant"))


def _forensic() -> list[Check]:
    return [
        matches("provenance", "Content credentials valid", "provenance", "(?i)invalid", "fail"),
        none_of("container", "Container without warnings", "container_warnings", "warn"),
        none_of("splices", "No splice candidates", "strong_splices", "warn"),
        none_of("loops", "No repeated footage", "loops", "warn"),
        none_of("noise", "Noise floor consistent", "noise_outliers", "warn"),
        none_of("enf", "Mains hum continuous", "enf_jumps", "warn"),
        recompression(),
        none_of("audio", "Audio without warnings", "audio_warnings", "warn"),
    ]


def _picture(black: str = "warn", freeze: str = "warn", brng: float = 0.05) -> list[Check]:
    return [
        none_of("black", "No black segments", "black_segments", black),
        none_of("freeze", "No frozen segments", "freeze_segments", freeze),
        broadcast_range(brng),
        hdr_signalling(),
        at_most("banding", "Banding at most 8 %", "banding_pct", 8.0),
        absent("pse", "No flashing", "pse_risk", "fail"),
        matches("cadence", "Regular cadence", "cadence", "(?i)pulldown|duplicate|interlac"),
        matches("maxcll", "Light levels as declared", "light_note", "exceeds"),
        none_of("dynhdr", "Dynamic metadata consistent", "dynhdr_flags", "warn"),
    ]


#: Profiles by name; further checks can be registered under a name, later ones with the same id win.
PROFILES: dict[str, Callable[[], list[Check]]] = {
    "broadcast-r128": lambda: [loudness(-24, -22), true_peak(-1), holds("has_audio", "Audio present", "has_audio", "fail"), at_most("silence", "Silence at most 5 s", "silence_total", 5.0), *_picture("fail", "fail", 0.02)],
    "web-streaming": lambda: [loudness(-15, -13), true_peak(-1), holds("has_audio", "Audio present", "has_audio"), at_most("silence", "Silence at most 5 s", "silence_total", 5.0), *_picture()],
    "general": lambda: [holds("has_audio", "Audio present", "has_audio"), at_most("silence", "Silence at most 10 s", "silence_total", 10.0), *_picture()],
    "integrity": _forensic,
    "speedrun": lambda: [*_forensic(), absent("platform", "From the platform", "platform_doubt"), below("tempo", "Tempo unchanged", "tempo_score", 0.45)],
    "analog": lambda: [at_most("dropouts", "Dropouts at most 0.5 %", "dropout_pct", 0.5), at_most("head_switch", "Head switching at most 50 %", "head_switch_pct", 50.0), at_most("jitter", "Line jitter at most 25 %", "jitter_pct", 25.0), at_most("flicker", "Flicker at most 30 times", "flicker_ratio", 30.0)],
    "captions": lambda: [holds("presence", "Captions present", "has_captions"), Check("coverage", "Speech covered by 70 %", F.when(c("coverage_pct").isNull() | (c("coverage_pct") >= 70), "pass").otherwise("warn"), ("coverage_pct",)), at_most("sync", "In sync", "sync_offset", 0.3), none_of("speed", "Readable speed", "fast_cues", "warn"), none_of("layout", "Readable layout", "layout_cues", "warn")],
    "hidden-data": lambda: [none_of("appended", "Nothing appended", "appended", "warn"), none_of("embedded", "Nothing embedded", "embedded", "warn"), none_of("padding", "Padding empty", "padding", "warn"), none_of("mdat_gap", "No unused media data", "mdat_gap", "warn"), absent("lsb", "Low bits unsuspicious", "lsb_suspicious"), none_of("sei", "No large user data", "large_sei", "warn")],
}


def checks_of(profile: str) -> list[Check]:
    """The profile's checks; an unknown name means general."""
    found = {}
    for check in PROFILES.get(profile, PROFILES["general"])():
        found[check.id] = check
    return list(found.values())


def register(profile: str, check: Callable[[], Check]) -> None:
    """Adds a check to a profile, or makes a profile of it."""
    before = PROFILES.get(profile, list)
    PROFILES[profile] = lambda: [*before(), check()]


def evaluate(context: DataFrame, keys: list[str], profile: str) -> DataFrame:
    """(keys, profile, ord, check_id, label, status): columns that the context lacks count as not measured."""
    checks = checks_of(profile)
    for name in {n for check in checks for n in check.needs} - set(context.columns):
        kind = "boolean" if name in ("is_hdr", "hdr_complete", "has_audio", "pse_risk", "platform_reencode", "platform_doubt", "has_captions", "lsb_suspicious") else "string" if name in ("provenance", "cadence", "light_note") else "double"
        context = context.withColumn(name, F.lit(None).cast(kind))
    rows = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(x.id).alias("check_id"), F.lit(x.label).alias("label"), x.status.alias("status")) for k, x in enumerate(checks)))
    return context.select(*keys, F.lit(profile).alias("profile"), F.explode(rows).alias("r")).select(*keys, "profile", "r.*")


def verdicts(checks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, profile, verdict, failed, warned)."""
    agg = checks.groupBy(*keys, "profile").agg(F.max_by("status", rank_of(F.col("status"), RANK)).alias("verdict"), F.count_if(F.col("status") == "fail").alias("failed"), F.count_if(F.col("status") == "warn").alias("warned"))
    return agg


def dashboard(media: DataFrame, verdict: DataFrame, loud: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each media, with its verdict and loudness where known."""
    return media.join(verdict, keys, "left").join(loud, keys, "left")


def exit_code(verdict: DataFrame) -> DataFrame:
    """One row: 1 if any media failed, else 0."""
    return verdict.agg(F.coalesce(F.max((F.col("verdict") == "fail").cast("int")), F.lit(0)).alias("code"))
