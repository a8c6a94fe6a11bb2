"""Text, time and rate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hms(seconds: Column, wrapped: bool = True) -> Column:
    """HH:MM:SS, wrapped at a day unless told otherwise; n/a if negative, missing or over a hundred years."""
    s = F.floor(seconds) % 86400 if wrapped else F.floor(seconds)
    text = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when((seconds >= 0) & (seconds <= 100 * 365.25 * 86400), text).otherwise("n/a")


def hms_millis(seconds: Column) -> Column:
    """H:MM:SS.mmm."""
    ms = F.rint(seconds * 1000).cast("long")
    return F.format_string("%d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms % 3600000 / 60000), F.floor(ms % 60000 / 1000), ms % 1000)


def rate(text: Column) -> Column:
    """A rational such as 60000/1001, or a number; 0 for anything else."""
    parts = F.split(text, "/")
    top, bottom = F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double")
    return F.coalesce(F.when(F.size(parts) <= 2, F.try_divide(top, bottom)), F.lit(0.0))


def aspect(text: Column) -> Column:
    """A sample aspect ratio n:d; 1 if it's missing or outside 0.1 to 10."""
    value = rate(F.regexp_replace(text, ":", "/"))
    return F.when((value >= 0.1) & (value <= 10), value).otherwise(1.0)


_STAMP = {
    "smpte": r"^(\d+):([0-5]?\d):([0-5]?\d)[:;](\d+)$",
    "hms": r"^(\d+):([0-5]?\d):([0-5]?\d)(?:[.,](\d+))?$",
    "ms": r"^(\d+):([0-5]?\d)(?:[.,](\d+))?$",
    "s": r"^(\d+)[.,](\d+)$",
    "count": r"^(\d+)$",
}


def timer(text: Column, fps: Column | float | None = None) -> Column:
    """A struct (kind, seconds) of an on-screen timer; null where nothing fits or a digit is unread (?).

    Kinds are tried in order: smpte, hms, ms, s, count. smpte and count need a frame rate.
    """
    t = F.trim(text)
    part = lambda kind, k: F.regexp_extract(t, _STAMP[kind], k)
    whole = lambda kind, k: part(kind, k).try_cast("double")
    fraction = lambda kind, k: F.when(part(kind, k) == "", 0.0).otherwise(part(kind, k).try_cast("double") / F.pow(F.lit(10.0), F.length(part(kind, k))))
    frames = F.lit(None).cast("double") if fps is None else (F.lit(float(fps)) if isinstance(fps, (int, float)) else fps)
    seconds = {
        "smpte": whole("smpte", 1) * 3600 + whole("smpte", 2) * 60 + whole("smpte", 3) + whole("smpte", 4) / frames,
        "hms": whole("hms", 1) * 3600 + whole("hms", 2) * 60 + whole("hms", 3) + fraction("hms", 4),
        "ms": whole("ms", 1) * 60 + whole("ms", 2) + fraction("ms", 3),
        "s": whole("s", 1) + fraction("s", 2),
        "count": whole("count", 1) / frames,
    }
    out = None
    for kind, value in seconds.items():
        fits = F.rlike(t, F.lit(_STAMP[kind])) & value.isNotNull()
        row = F.struct(F.lit(kind).alias("kind"), value.alias("seconds"))
        out = F.when(fits, row) if out is None else out.when(fits, row)
    return F.when(~F.contains(t, F.lit("?")), out)


def slug(text: Column) -> Column:
    """Path separators and other odd characters to _, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9.-]+", "_"), "^_+|_+$", "")


def one_in(log10_p: Column) -> Column:
    """'1 in N' for a base-10 logarithm of a probability, named by thousands."""
    x = -log10_p
    band = F.floor(x / 3).cast("int")
    names = F.array(*(F.lit(n) for n in ("", " thousand", " million", " billion", " trillion", " quadrillion", " quintillion")))
    worded = F.concat(F.lit("1 in "), F.format_number(F.pow(F.lit(10.0), x - 3 * band), 0), F.get(names, band))
    return F.when(x < 0.05, "about certain").when(x < 21, worded).otherwise(F.format_string("1 in 10^%.0f", x))


def mp4_time(seconds: Column) -> Column:
    """A count of seconds since 1904 as a timestamp; null if zero, negative or after the year 2100."""
    unix = seconds - 2082844800
    return F.when((seconds > 0) & (unix > -2082844800) & (unix < 4133980800), F.timestamp_seconds(unix))


def finite(x: Column) -> Column:
    """NaN to null; infinities stay."""
    return F.when(~F.isnan(x), x)


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounding with ties to even."""
    return F.rint(x) if digits == 0 else F.bround(x, digits)


def frame_to_x(frame: Column, width: Column | int, n: Column | int) -> Column:
    """Where a frame of n stands on an axis of `width` pixels; 0 for a single frame."""
    n, width = (F.lit(v) if isinstance(v, int) else v for v in (n, width))
    share = F.least(F.greatest(F.try_divide(frame, n - 1), F.lit(0.0)), F.lit(1.0))
    return F.when(n > 1, share * (width - 1)).otherwise(0.0)


def x_to_frame(x: Column, width: Column | int, n: Column | int) -> Column:
    """The frame of n that stands at a place of the axis, to the nearest, ties to even."""
    n, width = (F.lit(v) if isinstance(v, int) else v for v in (n, width))
    share = F.least(F.greatest(F.try_divide(x, width - 1), F.lit(0.0)), F.lit(1.0))
    return F.when((n > 1) & (width > 1), F.rint(share * (n - 1)).cast("long")).otherwise(F.lit(0).cast("long"))


def cell(x: Column) -> Column:
    """A number as a cell shows it: n/a for null, minus infinity as silence."""
    return F.when(x.isNull(), "n/a").when(x == float("-inf"), "-inf (digital silence)").otherwise(x.cast("string"))


def evenly_spaced(n: Column, samples: int, middle: bool = False) -> Column:
    """The frames, an array, that cut n frames in samples + 1 equal parts, or that stand in the middle of `samples`."""
    place = lambda i: (i + 0.5) / samples if middle else (i + 1.0) / (samples + 1)
    return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.floor(n * place(i)).cast("long"))
