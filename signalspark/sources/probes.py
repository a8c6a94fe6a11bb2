"""Probe documents (JSON text) to typed media records, and logs of measuring tools to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalspark.functions.text import aspect, hms, rate

#: The part of a probe document that is read.
PROBE = """struct<
  format: struct<filename: string, duration: string, format_name: string, format_long_name: string, bit_rate: string, tags: map<string, string>>,
  streams: array<struct<index: int, codec_type: string, codec_name: string, profile: string, width: int, height: int, pix_fmt: string, bits_per_raw_sample: string,
    avg_frame_rate: string, r_frame_rate: string, nb_frames: string, duration: string, sample_aspect_ratio: string, sample_rate: string, channels: int,
    color_transfer: string, color_primaries: string, color_space: string, tags: map<string, string>, side_data_list: array<map<string, string>>>>,
  frames: array<struct<media_type: string, pts_time: string, pkt_pts_time: string, best_effort_timestamp_time: string, side_data_list: array<map<string, string>>>>>"""
#: File name endings that are taken for media.
MEDIA_ENDINGS = ("mp4", "mov", "mkv", "webm", "avi", "m4v", "ts", "m2ts", "mts", "mpg", "mpeg", "wmv", "flv", "mxf", "vob", "ogv", "3gp")


def media_files(spark: SparkSession, path: str, recurse: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of the media files below a folder; the content is read if asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recurse).lower()).option("pathGlobFilter", "*.{" + ",".join(MEDIA_ENDINGS) + "}").load(path)


def parsed(docs: DataFrame, body: str = "body") -> DataFrame:
    return docs.withColumn("probe", F.from_json(body, PROBE))


def _first(streams: Column, kind: str) -> Column:
    return F.get(F.filter(streams, lambda s: s.codec_type == kind), F.lit(0))


def bit_depth(pix_fmt: Column) -> Column:
    return F.when(F.contains(pix_fmt, F.lit("p16")) | F.contains(pix_fmt, F.lit("48")), 16).when(F.contains(pix_fmt, F.lit("12")), 12).when(F.contains(pix_fmt, F.lit("10")), 10).otherwise(8)


def media(probes: DataFrame) -> DataFrame:
    """probes plus one typed column for each property of the first video stream and the file.

    A rate counts from 0 to 1000, else 30; frames are counted or follow from the duration; a missing stream gives
    ok = false.
    """
    v = _first(F.col("probe.streams"), "video")
    side = F.coalesce(v.side_data_list, F.array().cast("array<map<string,string>>"))
    dovi = F.get(F.filter(side, lambda d: F.rlike(d["side_data_type"], F.lit("(?i)dovi|dolby vision"))), F.lit(0))
    usable = lambda r: F.when((r > 0) & (r <= 1000), r)
    fps = F.coalesce(usable(rate(v.avg_frame_rate)), usable(rate(v.r_frame_rate)), F.lit(30.0))
    seconds = F.greatest(F.lit(0.0), F.coalesce(F.col("probe.format.duration").try_cast("double"), v.duration.try_cast("double"), F.lit(0.0)))
    turned = F.get(F.filter(side, lambda d: F.map_contains_key(d, "rotation")), F.lit(0))["rotation"].try_cast("double")
    out = probes.select(
        "*",
        v.isNotNull().alias("ok"),
        v.width.alias("width"),
        v.height.alias("height"),
        fps.alias("fps"),
        seconds.alias("duration"),
        F.coalesce(v.nb_frames.try_cast("long"), F.rint(seconds * fps).cast("long")).alias("nb_frames"),
        v.codec_name.alias("codec"),
        v.pix_fmt.alias("pix_fmt"),
        bit_depth(v.pix_fmt).alias("bit_depth"),
        F.lower(v.color_transfer).alias("transfer"),
        F.lower(v.color_primaries).alias("primaries"),
        F.lower(v.color_space).alias("matrix"),
        aspect(v.sample_aspect_ratio).alias("sar"),
        F.pmod(F.coalesce(v.tags["rotate"].try_cast("double"), -turned, F.lit(0.0)), F.lit(360.0)).cast("int").alias("rotation"),
        dovi["dv_profile"].try_cast("int").alias("dv_profile"),
        dovi["dv_bl_signal_compatibility_id"].try_cast("int").alias("dv_compat"),
        F.exists(F.col("probe.streams"), lambda s: s.codec_type == "audio").alias("has_audio"),
    )
    out = out.withColumn("is_pq", F.coalesce(F.col("transfer") == "smpte2084", F.lit(False))).withColumn("is_hlg", F.coalesce(F.col("transfer") == "arib-std-b67", F.lit(False)))
    out = out.withColumn("is_dovi", F.col("dv_profile").isNotNull()).withColumn("is_hdr", F.col("is_pq") | F.col("is_hlg") | F.col("is_dovi")).withColumn("is_wide_gamut", F.coalesce(F.col("primaries").isin("bt2020", "smpte432", "smpte431"), F.lit(False)))
    wide = F.rint(F.col("width") * F.col("sar")).cast("int")
    across = F.col("rotation").isin(90, 270)
    return out.withColumn("display_width", F.when(across, F.col("height")).otherwise(wide)).withColumn("display_height", F.when(across, wide).otherwise(F.col("height")))


def _shared_factor(a: Column, b: Column) -> Column:
    """The greatest common divisor of two numbers under 2**31, by a fold of Euclid's steps."""
    step = lambda s, _: F.when(s["b"] > 0, F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b"))).otherwise(s)
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(46)), start, step)["a"]


def headline(records: DataFrame) -> DataFrame:
    """records (with `probe` and the columns of media) plus headline: an array of (name, value), what is known of container,
    codec, size, shape as shown, rate, pixels, depth, length and bit rate, in this order."""
    f, v = F.col("probe.format"), _first(F.col("probe.streams"), "video")
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    pair = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.alias("value")))
    shape = F.when(~v.sample_aspect_ratio.isin("", "1:1", "0:1", "N/A"), F.concat(F.lit("anamorphic SAR "), v.sample_aspect_ratio))
    turned = F.when(F.col("rotation") != 0, F.concat(F.lit("rotated "), F.col("rotation").cast("string"), F.lit("\u00b0")))
    extra = F.array_join(F.array_compact(F.array(shape, turned)), ", ")
    size = F.when(v.width > 0, F.concat(v.width.cast("string"), F.lit("x"), v.height.cast("string"), F.when(extra != "", F.concat(F.lit("  ("), extra, F.lit(")"))).otherwise("")))
    w, h = F.col("display_width"), F.col("display_height")
    other = (w != v.width) | (h != v.height)
    by = _shared_factor(w, h)
    shown = F.when(other & (h > 0) & (w > 0), F.format_string("%d:%d (%.2f:1, shown %dx%d)", (w / by).cast("int"), (h / by).cast("int"), w / h, w, h))
    stated = F.coalesce(said(v.avg_frame_rate), said(v.r_frame_rate))
    over, under = F.split_part(stated, F.lit("/"), F.lit(1)).try_cast("int"), F.split_part(stated, F.lit("/"), F.lit(2)).try_cast("int")
    fps = F.when(F.contains(stated, F.lit("/")) & (under != 0) & over.isNotNull(), F.format_string("%.3f fps", over / under))
    codec = F.when(v.isNotNull(), F.concat(F.coalesce(v.codec_name, F.lit("?")), F.coalesce(F.concat(F.lit(" ("), said(v.profile), F.lit(")")), F.lit(""))))
    seconds, bits = f.duration.try_cast("double"), f.bit_rate.try_cast("double")
    pairs = [
        pair("Container", F.coalesce(said(f.format_long_name), said(f.format_name))),
        pair("Codec", codec),
        pair("Resolution", size),
        pair("Display AR", shown),
        pair("Frame Rate", fps),
        pair("Pixel Format", said(v.pix_fmt)),
        pair("Bit Depth", F.concat(said(v.bits_per_raw_sample), F.lit("-bit"))),
        pair("Duration", F.when(said(f.duration).isNotNull(), F.coalesce(hms(seconds, wrapped=False), F.lit("n/a")))),
        pair("Bit Rate", F.when(bits.isNotNull(), F.format_string("%.0f kbps", bits / 1000))),
    ]
    return records.withColumn("headline", F.array_compact(F.array(*pairs)))


def hdr_lines(records: DataFrame) -> DataFrame:
    """records (with the columns of media, hdr_class and declared_light) plus hdr_lines: the dynamic metadata in words."""
    data = side_data(records)
    has = lambda pattern: F.exists(data, lambda d: F.coalesce(F.rlike(d["side_data_type"], F.lit(pattern)), F.lit(False)))
    present = lambda name, on: F.concat(F.lit(name), F.when(on, "present").otherwise("none"))
    profile = F.concat(F.lit("Dolby Vision: profile "), F.col("dv_profile").cast("string"), F.coalesce(F.concat(F.lit(", base compatibility "), F.col("dv_compat").cast("string")), F.lit("")))
    cll, fall = F.col("declared_cll"), F.col("declared_fall")
    number = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    light = F.when(cll.isNotNull() | fall.isNotNull(), F.concat(F.lit("MaxCLL/MaxFALL: "), number(cll), F.lit(" / "), number(fall), F.lit(" nits"))).when(has("(?i)content light"), "MaxCLL/MaxFALL: declared, values unknown").otherwise("MaxCLL/MaxFALL: none")
    lines = (F.coalesce(profile, F.lit("Dolby Vision: none")), present("HDR10+: ", has("(?i)2094-40|hdr10\\+|hdr dynamic metadata")), present("Mastering display: ", has("(?i)mastering display")), light)
    return records.withColumn("hdr_lines", F.array(*lines))


def signal_tags(records: DataFrame) -> DataFrame:
    """records plus signal (pq, hlg, sdr) and gamut (2020, p3, 709)."""
    signal = F.when(F.col("is_pq"), "pq").when(F.col("is_hlg"), "hlg").otherwise("sdr")
    gamut = F.when(F.col("primaries") == "bt2020", "2020").when(F.col("primaries").isin("smpte432", "smpte431"), "p3").otherwise("709")
    return records.withColumn("signal", signal).withColumn("gamut", gamut)


def side_data(probes: DataFrame) -> Column:
    """All side data of video streams and frames, one array of maps."""
    empty = F.array().cast("array<map<string,string>>")
    of = lambda x: F.coalesce(x.side_data_list, empty)
    streams = F.transform(F.filter(F.col("probe.streams"), lambda s: s.codec_type == "video"), of)
    return F.concat(F.flatten(streams), F.coalesce(F.flatten(F.transform("probe.frames", of)), empty))


def hdr_class(records: DataFrame) -> DataFrame:
    """records plus hdr_format and flags (what is odd about the dynamic metadata), from stream tags and side data."""
    data = side_data(records)
    has = lambda pattern: F.exists(data, lambda d: F.coalesce(F.rlike(d["side_data_type"], F.lit(pattern)), F.lit(False)))
    out = records.withColumn("_plus", has("(?i)2094-40|hdr10\\+|hdr dynamic metadata")).withColumn("_mdcv", has("(?i)mastering display")).withColumn("_cll", has("(?i)content light"))
    p, k = F.col("dv_profile"), F.col("dv_compat")
    dv = F.when(p == 5, "Dolby Vision P5").when(p == 7, "Dolby Vision P7").when((p == 8) & (k == 1), "Dolby Vision P8.1 + HDR10").when((p == 8) & (k == 4), "Dolby Vision P8.4 + HLG").when(p.isNotNull(), F.concat(F.lit("Dolby Vision P"), p.cast("string")))
    kind = F.coalesce(dv, F.when(F.col("is_pq") & F.col("_plus"), "HDR10+").when(F.col("is_pq"), "HDR10").when(F.col("is_hlg"), "HLG").otherwise("SDR"))
    flags = F.array_compact(
        F.array(
            F.when(p == 7, "dual-layer profile 7"),
            F.when(p == 5, "profile 5 has no compatible base"),
            F.when((k == 1) & ~F.col("_mdcv"), "HDR10 base without mastering display"),
            F.when((k == 1) & ~F.col("_cll"), "HDR10 base without light levels"),
            F.when(F.col("_plus") & ~F.col("_mdcv"), "HDR10+ without mastering display"),
        )
    )
    return out.withColumn("hdr_format", kind).withColumn("flags", flags).withColumn("hdr_complete", ~F.col("is_pq") | (F.col("_mdcv") & F.col("_cll"))).drop("_plus", "_mdcv", "_cll")


def declared_light(records: DataFrame) -> DataFrame:
    """records plus the declared light levels: the first content-light block; 0 and junk are unknown."""
    block = F.get(F.filter(side_data(records), lambda d: F.coalesce(F.rlike(d["side_data_type"], F.lit("(?i)content light")), F.lit(False))), F.lit(0))
    known = lambda v: F.when(v.try_cast("int") > 0, v.try_cast("int"))
    return records.withColumn("declared_cll", known(block["max_content"])).withColumn("declared_fall", known(block["max_average"]))


def subtitles(probes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sidx, codec, kind, lang): subtitle streams, numbered among themselves."""
    rows = probes.select(*keys, F.explode("probe.streams").alias("s")).filter("s.codec_type = 'subtitle'")
    kind = F.when(F.col("s.codec_name").isin("subrip", "srt", "ass", "ssa", "mov_text", "webvtt", "text"), "text").when(F.col("s.codec_name").isin("eia_608", "eia_708"), "cc").otherwise("bitmap")
    return rows.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("s.index")) - 1).alias("sidx"), F.col("s.codec_name").alias("codec"), kind.alias("kind"), F.col("s.tags")["language"].alias("lang"))


def frame_time(frame: Column) -> Column:
    """A frame's time: pts, packet pts or best effort, N/A skipped."""
    return F.coalesce(*(F.nullif(frame[c], F.lit("N/A")).try_cast("double") for c in ("pts_time", "pkt_pts_time", "best_effort_timestamp_time")))


# ---- logs: one line a row, (keys, line_no, line)

#: A number as tools write it, small ones with an exponent.
NUMBER = r"[-\d.]+(?:[eE][-+]?\d+)?"
METRICS = ("YMIN", "YAVG", "YMAX", "UAVG", "VAVG", "SATAVG", "SATMAX", "HUEMED", "HUEAVG", "YDIF", "TOUT", "VREP", "BRNG")


def frame_log(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, t, 13 metrics) of a log of `frame:N pts_time:T` heads and `key.NAME=value` lines."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.rlike("line", F.lit(r"^frame:"))
    numbered = lines.withColumn("frame", F.sum(F.when(head, 1).otherwise(0)).over(w) - 1).filter("frame >= 0")
    value = F.regexp_extract("line", r"\.([A-Z]+)=", 1)
    number = F.regexp_extract("line", r"=(.+)$", 1).try_cast("double")
    at = F.regexp_extract("line", r"pts_time:\s*([-\d.]+)", 1).try_cast("double")
    return numbered.groupBy(*keys, "frame").agg(F.max(F.when(head, at)).alias("t"), *(F.max(F.when(value == m, number)).alias(m) for m in METRICS))


def frame_csv(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, t, 13 metrics) of comma-separated rows: one or two times, the first that is a number, then metrics."""
    cells = F.split("line", ",")
    n = F.size(cells)
    times = F.filter(F.transform(F.slice(cells, 1, F.greatest(n - 13, F.lit(0))), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    out = lines.withColumn("_c", F.slice(cells, -13, 13)).withColumn("t", F.get(times, F.lit(0))).filter((n >= 14) & F.col("t").isNotNull())
    frame = F.row_number().over(Window.partitionBy(*keys).orderBy("line_no")) - 1
    return out.select(*keys, frame.alias("frame"), "t", *(F.get("_c", F.lit(k)).try_cast("double").alias(m) for k, m in enumerate(METRICS)))


def black_log(lines: DataFrame, keys: list[str]) -> DataFrame:
    number = lambda name: F.regexp_extract("line", rf"{name}:\s*([-\d.]+)", 1).try_cast("double")
    return lines.select(*keys, number("black_start").alias("t0"), number("black_end").alias("t1")).filter("t0 IS NOT NULL AND t1 IS NOT NULL")


def loudness_series(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, M, S) of `pts_time:` heads and `lavfi.r128.M=` lines."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    at = F.regexp_extract("line", r"pts_time:\s*([-\d.]+)", 1).try_cast("double")
    value = lambda k: F.regexp_extract("line", rf"r128\.{k}=(-?inf|{NUMBER})", 1)
    number = lambda k: F.when(value(k) == "-inf", F.lit(float("-inf"))).otherwise(value(k).try_cast("double"))
    timed = lines.withColumn("t", F.last(at, ignorenulls=True).over(w)).filter("t IS NOT NULL")
    return timed.groupBy(*keys, "t").agg(F.max(number("M")).alias("M"), F.max(number("S")).alias("S")).filter("M IS NOT NULL OR S IS NOT NULL")


def loudness_summary(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts plus integrated_lufs, lra_lu, threshold_lufs and true_peak_dbfs of a summary; -inf is a value."""

    def number(pattern: str) -> Column:
        found = F.regexp_extract(text, pattern + rf":\s*(-?inf|{NUMBER})", 1)
        return F.when(found == "-inf", F.lit(float("-inf"))).otherwise(found.try_cast("double"))

    return texts.withColumn("integrated_lufs", number(r"\bI")).withColumn("lra_lu", number("LRA")).withColumn("threshold_lufs", number("Threshold")).withColumn("true_peak_dbfs", number("Peak"))


def packet_log(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, t, size, type, key) of `name=value|name=value` lines; bad values become frame number, 0, ?."""
    frame = F.row_number().over(Window.partitionBy(*keys).orderBy("line_no")) - 1
    out = lines.withColumn("frame", frame).withColumn("_m", F.expr(r"str_to_map(line, '\\|', '=')"))
    field = lambda k: F.try_element_at("_m", F.lit(k))
    return out.select(*keys, "frame", F.coalesce(field("pts_time").try_cast("double"), F.col("frame").cast("double")).alias("t"), F.coalesce(field("pkt_size").try_cast("long"), F.lit(0)).alias("size"), F.coalesce(F.nullif(field("pict_type"), F.lit("")), F.lit("?")).alias("type"), F.coalesce(field("key_frame").try_cast("int"), F.lit(0)).alias("key"))


def psnr_log(lines: DataFrame, keys: list[str]) -> DataFrame:
    number = F.regexp_extract("line", rf"psnr_avg:(inf|{NUMBER})", 1)
    return lines.select(*keys, F.regexp_extract("line", r"\bn:(\d+)", 1).try_cast("long").alias("n"), F.when(number == "inf", F.lit(float("inf"))).otherwise(number.try_cast("double")).alias("psnr")).filter("psnr IS NOT NULL")


def ssim_log(lines: DataFrame, keys: list[str]) -> DataFrame:
    return lines.select(*keys, F.regexp_extract("line", r"\bn:(\d+)", 1).try_cast("long").alias("n"), F.regexp_extract("line", rf"All:({NUMBER})", 1).try_cast("double").alias("ssim")).filter("ssim IS NOT NULL")


# ---- captions


def srt_cues(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, t0, t1, text): cues of SubRip text in order; tags are stripped, empty cues dropped."""
    stamp = r"(\d+):(\d\d):(\d\d)[,.](\d{1,3})"
    arrow = stamp + r"\s*-->\s*" + stamp
    block = texts.select(*keys, F.explode(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n[ \t]*\n")).alias("b")).filter(F.rlike("b", F.lit(arrow)))
    part = lambda k: F.regexp_extract("b", arrow, k)
    seconds = lambda k: part(k).cast("double") * 3600 + part(k + 1).cast("double") * 60 + part(k + 2).cast("double") + F.rpad(part(k + 3), 3, "0").cast("double") / 1000
    words = F.regexp_replace(F.regexp_extract("b", arrow + r"[^\n]*\n([\s\S]*)$", 9), r"<[^>]*>|\{\\[^}]*\}", "")
    return block.select(*keys, seconds(1).alias("t0"), seconds(5).alias("t1"), F.btrim(words, F.lit(" \n\t")).alias("text")).filter("text != ''")


def sidecars(media: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """media plus sidecar: the caption file beside it, of the same name with .srt, else .en.srt; null without one."""
    stem = F.regexp_replace(F.col(path), r"\.[^./]*$", "")
    found = files.select(F.col(path).alias("_file")).filter(F.endswith("_file", F.lit(".srt")))
    named = found.select(F.regexp_replace("_file", r"\.srt$", "").alias("_stem"), F.lit(0).alias("_rank"), "_file").unionByName(found.filter(F.endswith("_file", F.lit(".en.srt"))).select(F.regexp_replace("_file", r"\.en\.srt$", "").alias("_stem"), F.lit(1).alias("_rank"), "_file"))
    best = named.groupBy("_stem").agg(F.min_by("_file", "_rank").alias("sidecar"))
    return media.withColumn("_stem", stem).join(best, "_stem", "left").drop("_stem")


def xpsnr_log(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, xpsnr): luma values of a log, one line a frame."""
    number = F.regexp_extract("line", rf"\by:\s*(inf|{NUMBER})", 1)
    return lines.select(*keys, "line_no", F.when(number == "inf", F.lit(float("inf"))).otherwise(number.try_cast("double")).alias("xpsnr")).filter("xpsnr IS NOT NULL")


def pooled_xpsnr(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, average): the mean of the finite frames; infinite if there is none."""
    finite = F.when(F.col("xpsnr") < float("inf"), F.col("xpsnr"))
    return frames.groupBy(*keys).agg(F.coalesce(F.avg(finite), F.lit(float("inf"))).alias("average"))


# fixed values: names of the quality models that can be asked for
MODELS = {"4k": "vmaf_4k_v0.6.1", "neg": "vmaf_v0.6.1neg"}


def quality_model(choice: Column, width: Column, height: Column) -> Column:
    """The model's name, null for the default: by choice, or for `auto` by the reference's size."""
    large = (F.coalesce(height, F.lit(0)) >= 1620) | (F.coalesce(width, F.lit(0)) >= 2880)
    return F.when(choice == "4k", MODELS["4k"]).when(choice == "neg", MODELS["neg"]).when(choice == "default", F.lit(None).cast("string")).when(large, MODELS["4k"])


def scale_note(width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    """What is said where a distorted picture is scaled to its reference; null where it isn't."""
    differs = (width > 0) & (to_width > 0) & ((width != to_width) | (height != to_height))
    return F.when(differs, F.format_string("distorted scaled %dx%d -> %dx%d to match reference", width, height, to_width, to_height))
