"""Registered queries over records: probe documents, tool logs, captions, container bytes, rules, small pictures.

The tables' rows are written in the form that a tool would give them (JSON, log lines, boxes, pixels) and read back by the
operators; the SQL works the same values out of the tables without that detour.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalspark.functions import colour
from signalspark.functions import text as texts
from signalspark.operators import aggregates, captions, findings, glyphs, images, joins, qc, segments, series, signals, verdict_rules
from signalspark.plans import packs, reports
from signalspark.queries import FRAMES, PACKETS, QUERIES, SQL, K, frames, packets, query, r6
from signalspark.session import new_folder, table
from signalspark.sources import containers, dynamic, exports, probes, ranges

__all__ = ["QUERIES", "SQL"]


def pick(key: Column, values: list) -> Column:
    """One of some values (null among them) by a number."""
    return F.get(F.array(*(F.lit(v) for v in values)), F.pmod(key, F.lit(len(values))).cast("int"))


def sql_pick(key: str, values: list) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {k} THEN " + ("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)) for k, v in enumerate(values)) + " END"


# ---- probe documents

_RATES = ["30000/1001", "25/1", "0/0", "junk", "120000/0", "50"]
_FORMATS = ["yuv420p", "yuv420p10le", "yuv444p12le", "rgb48le", "gray16le"]
_TRANSFERS = ["smpte2084", "arib-std-b67", "bt709", None, "SMPTE2084"]
_PRIMARIES = ["bt2020", "smpte432", "bt709", None]
_ASPECTS = ["4:3", "1:1", "0:1", "N/A", "16:11"]
_DOVI = [None, 5, 7, 8, 8, 4]


def _probes(spark: SparkSession, sf: str) -> DataFrame:
    """A probe document for each order."""
    k = F.col("o_orderkey")
    pair = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, (str, int)) else x for x in kv))
    side = F.array_compact(
        F.array(
            F.when(k % 7 == 0, pair("side_data_type", "Display Matrix", "rotation", pick(k, ["-90", "90", "180"]))),
            F.when(pick(k, _DOVI).isNotNull(), pair("side_data_type", "DOVI configuration record", "dv_profile", pick(k, _DOVI).cast("string"), "dv_bl_signal_compatibility_id", pick(k, ["1", "4", "0"]))),
            F.when(k % 2 == 0, pair("side_data_type", "Mastering display metadata", "red_x", "34000/50000")),
            F.when(k % 3 == 0, pair("side_data_type", "Content light level metadata", "max_content", pick(k, ["1000", "0", "junk", "4000"]), "max_average", pick(k, ["400", "0"]))),
        )
    )
    video = F.struct(
        F.lit(0).alias("index"),
        F.lit("video").alias("codec_type"),
        F.lit("hevc").alias("codec_name"),
        (1280 + F.col("o_custkey") % 5 * 160).alias("width"),
        F.lit(720).alias("height"),
        pick(k, _FORMATS).alias("pix_fmt"),
        pick(k, _RATES).alias("avg_frame_rate"),
        pick(F.col("o_custkey"), _RATES).alias("r_frame_rate"),
        F.when(k % 3 > 0, (k % 5000).cast("string")).alias("nb_frames"),
        pick(k, _ASPECTS).alias("sample_aspect_ratio"),
        pick(k, _TRANSFERS).alias("color_transfer"),
        pick(F.col("o_custkey"), _PRIMARIES).alias("color_primaries"),
        F.when(k % 11 == 0, pair("rotate", "450")).alias("tags"),
        side.alias("side_data_list"),
    )
    audio = F.struct(F.lit(1).alias("index"), F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"))
    whole = F.struct(
        F.struct(F.when(k % 4 > 0, (F.col("o_custkey") % 600).cast("string")).otherwise("N/A").alias("duration"), F.lit("mov").alias("format_name")).alias("format"),
        F.when(k % 2 == 0, F.array(F.to_json(video), F.to_json(audio))).when(k % 13 == 0, F.array(F.to_json(audio))).otherwise(F.array(F.to_json(video))).alias("streams"),
    )
    body = F.concat(F.lit('{"format":'), F.to_json(whole["format"]), F.lit(',"streams":['), F.array_join(whole["streams"], ","), F.lit("]}"))
    return probes.parsed(table(spark, sf, "orders").select(k.alias("media"), body.alias("body")))


def _rate_sql(key: str) -> str:
    return f"CASE {key} % 6 WHEN 0 THEN 30000 / 1001.0::DOUBLE WHEN 1 THEN 25 WHEN 5 THEN 50 END"


_PROBE_SQL = f"""p AS (SELECT o_orderkey AS k, o_custkey AS c, (o_orderkey % 2 = 0 OR o_orderkey % 13 <> 0) AS ok, 1280 + o_custkey % 5 * 160 AS w,
    coalesce({_rate_sql("o_orderkey")}, {_rate_sql("o_custkey")}, 30)::DOUBLE AS fps, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 600 ELSE 0 END::DOUBLE AS seconds,
    CASE o_orderkey % 5 WHEN 0 THEN 4 / 3.0::DOUBLE WHEN 1 THEN 1 WHEN 4 THEN 16 / 11.0::DOUBLE ELSE 1 END::DOUBLE AS sar,
    CASE WHEN o_orderkey % 11 = 0 THEN 90 WHEN o_orderkey % 7 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 90 WHEN 1 THEN 270 ELSE 180 END ELSE 0 END AS turn,
    lower({sql_pick("o_orderkey", _TRANSFERS)}) AS transfer, {sql_pick("o_custkey", _PRIMARIES)} AS primaries, {sql_pick("o_orderkey", _DOVI)} AS dv, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 0 END AS compat FROM orders),
v AS (SELECT *, ok AND coalesce(transfer = 'smpte2084', false) AS pq, ok AND coalesce(transfer = 'arib-std-b67', false) AS hlg, ok AND dv IS NOT NULL AS dovi FROM p)"""


@query(f"""WITH {_PROBE_SQL} SELECT k AS media, ok, CASE WHEN ok THEN w END AS width, round(CASE WHEN ok THEN fps ELSE 30 END, 6) AS fps, seconds AS duration,
    CASE WHEN ok AND k % 3 > 0 THEN k % 5000 ELSE round_even(seconds * CASE WHEN ok THEN fps ELSE 30 END, 0)::BIGINT END AS nb_frames,
    CASE WHEN NOT ok THEN 8 WHEN k % 5 = 1 THEN 10 WHEN k % 5 = 2 THEN 12 WHEN k % 5 > 2 THEN CASE k % 5 WHEN 3 THEN 16 ELSE 8 END ELSE 8 END AS bit_depth,
    CASE WHEN ok THEN turn ELSE 0 END AS rotation, pq AS is_pq, hlg AS is_hlg, pq OR hlg OR dovi AS is_hdr, ok AND coalesce(primaries IN ('bt2020', 'smpte432'), false) AS is_wide_gamut, (k % 2 = 0 OR k % 13 = 0) AS has_audio,
    CASE WHEN ok THEN CASE WHEN turn IN (90, 270) THEN 720 ELSE round_even(w * sar, 0)::INT END END AS display_width, CASE WHEN ok THEN CASE WHEN turn IN (90, 270) THEN round_even(w * sar, 0)::INT ELSE 720 END END AS display_height,
    CASE WHEN pq THEN 'pq' WHEN hlg THEN 'hlg' ELSE 'sdr' END AS signal, CASE WHEN ok AND primaries = 'bt2020' THEN '2020' WHEN ok AND primaries = 'smpte432' THEN 'p3' ELSE '709' END AS gamut FROM v""")
def probe_records(spark, sf):
    df = probes.signal_tags(probes.media(_probes(spark, sf)))
    return df.select("media", "ok", F.col("width").cast("long").alias("width"), r6("fps").alias("fps"), "duration", "nb_frames", "bit_depth", "rotation", "is_pq", "is_hlg", "is_hdr", "is_wide_gamut", "has_audio", "display_width", "display_height", "signal", "gamut")


@query(f"""WITH {_PROBE_SQL}, s AS (SELECT *, ok AND k % 2 = 0 AS mdcv, ok AND k % 3 = 0 AS cll FROM v)
SELECT k AS media, CASE WHEN dovi THEN CASE WHEN dv = 5 THEN 'Dolby Vision P5' WHEN dv = 7 THEN 'Dolby Vision P7' WHEN dv = 8 AND compat = 1 THEN 'Dolby Vision P8.1 + HDR10' WHEN dv = 8 AND compat = 4 THEN 'Dolby Vision P8.4 + HLG' ELSE 'Dolby Vision P' || dv END WHEN pq THEN 'HDR10' WHEN hlg THEN 'HLG' ELSE 'SDR' END AS hdr_format,
    array_to_string(list_filter([CASE WHEN dovi AND dv = 7 THEN 'dual-layer profile 7' END, CASE WHEN dovi AND dv = 5 THEN 'profile 5 has no compatible base' END, CASE WHEN dovi AND compat = 1 AND NOT mdcv THEN 'HDR10 base without mastering display' END, CASE WHEN dovi AND compat = 1 AND NOT cll THEN 'HDR10 base without light levels' END], lambda x: x IS NOT NULL), ',') AS flags,
    NOT pq OR (mdcv AND cll) AS hdr_complete, CASE WHEN cll THEN CASE k % 4 WHEN 0 THEN 1000 WHEN 3 THEN 4000 END END AS declared_cll, CASE WHEN cll AND k % 2 = 0 THEN 400 END AS declared_fall FROM s""")
def hdr_classes(spark, sf):
    df = probes.declared_light(probes.hdr_class(probes.media(_probes(spark, sf))))
    return df.select("media", "hdr_format", F.array_join("flags", ",").alias("flags"), "hdr_complete", "declared_cll", "declared_fall")


_SUBTITLES = ["subrip", "ass", "mov_text", "dvd_subtitle", "hdmv_pgs_subtitle", "eia_608"]


@query(f"""WITH s AS (SELECT l_orderkey AS media, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS idx, l_partkey AS p FROM lineitem)
SELECT media, row_number() OVER (PARTITION BY media ORDER BY idx) - 1 AS sidx, {sql_pick("p", _SUBTITLES)} AS codec, CASE WHEN p % 6 < 3 THEN 'text' WHEN p % 6 = 5 THEN 'cc' ELSE 'bitmap' END AS kind, CASE WHEN p % 2 = 0 THEN 'en' END AS lang FROM s WHERE p % 4 <> 1""")
def subtitle_tracks(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    kind = F.when(F.col("l_partkey") % 4 == 1, "audio").otherwise("subtitle")
    stream = F.struct((F.row_number().over(w) - 1).alias("index"), kind.alias("codec_type"), pick(F.col("l_partkey"), _SUBTITLES).alias("codec_name"), F.when(F.col("l_partkey") % 2 == 0, F.create_map(F.lit("language"), F.lit("en"))).alias("tags"))
    docs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("media"), stream.alias("s")).groupBy("media").agg(F.to_json(F.struct(F.collect_list("s").alias("streams"))).alias("body"))
    return probes.subtitles(probes.parsed(docs), K).withColumn("sidx", F.col("sidx").cast("long"))


@query("""SELECT event_id AS media, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN user_id WHEN 2 THEN 7.5 END::DOUBLE AS t FROM events""")
def frame_times(spark, sf):
    k = F.col("event_id") % 4
    frame = F.struct(F.when(k == 0, F.col("value").cast("string")).otherwise("N/A").alias("pts_time"), F.when(k == 1, F.col("user_id").cast("string")).when(k == 3, "N/A").alias("pkt_pts_time"), F.when(k == 2, "7.5").alias("best_effort_timestamp_time"))
    return table(spark, sf, "events").select(F.col("event_id").alias("media"), probes.frame_time(frame).alias("t"))


# ---- logs of measuring tools


def _lines(df: DataFrame, order: list[str], lines: Column) -> DataFrame:
    """(media, line_no, line): the lines of each row, one row after the other."""
    w = Window.partitionBy("media").orderBy(*order, "_k")
    long = df.select("*", F.posexplode(lines).alias("_k", "line"))
    return long.select("media", F.row_number().over(w).alias("line_no"), "line")


@query(f"WITH {FRAMES} SELECT media, frame, frame * 2.5 AS t, value AS YAVG, CASE WHEN frame % 2 = 0 THEN 235 END::DOUBLE AS YMAX, (value + 1) AS BRNG FROM f")
def frame_log(spark, sf):
    f = frames(spark, sf)
    lines = F.array_compact(F.array(F.format_string("frame:%d pts:%d pts_time:%.1f", "frame", "frame", F.col("frame") * 2.5), F.concat(F.lit("lavfi.signalstats.YAVG="), F.col("value").cast("string")), F.when(F.col("frame") % 2 == 0, F.lit("lavfi.signalstats.YMAX=235")), F.concat(F.lit("lavfi.signalstats.BRNG="), (F.col("value") + 1).cast("string")), F.lit("lavfi.signalstats.YMIN=junk")))
    return probes.frame_log(_lines(f, ["frame"], lines), K).select("media", F.col("frame").cast("long").alias("frame"), "t", "YAVG", "YMAX", "BRNG")


@query(f"""WITH {FRAMES}, k AS (SELECT media, frame, value FROM f WHERE frame % 7 <> 6) SELECT media, row_number() OVER (PARTITION BY media ORDER BY frame) - 1 AS frame, frame * 0.5 AS t, value AS YMIN, CASE WHEN frame % 3 = 0 THEN NULL ELSE value END AS YAVG, 12.0::DOUBLE AS BRNG FROM k""")
def frame_csv(spark, sf):
    f = frames(spark, sf)
    at, value = F.format_string("%.1f", F.col("frame") * 0.5), F.col("value").cast("string")
    middle = [value, F.when(F.col("frame") % 3 == 0, "N/A").otherwise(value), *[F.lit(str(k)) for k in range(2, 13)]]
    cells = F.when(F.col("frame") % 7 == 6, F.lit("only,three,cells")).when(F.col("frame") % 2 == 0, F.concat_ws(",", F.lit("N/A"), at, *middle)).otherwise(F.concat_ws(",", at, *middle))
    return probes.frame_csv(_lines(f, ["frame"], F.array(cells)), K).select("media", F.col("frame").cast("long").alias("frame"), "t", "YMIN", "YAVG", "BRNG")


@query(f"WITH {FRAMES} SELECT media, frame * 1.5 AS t0, frame * 1.5 + 0.25 AS t1 FROM f WHERE value < 20")
def black_log(spark, sf):
    line = F.when(F.col("value") < 20, F.format_string("[blackdetect @ 0x1] black_start:%.1f black_end:%.2f black_duration:0.25", F.col("frame") * 1.5, F.col("frame") * 1.5 + 0.25)).otherwise("frame= 12 fps=0.0")
    return probes.black_log(_lines(frames(spark, sf), ["frame"], F.array(line)), K)


@query(f"WITH {FRAMES} SELECT media, frame * 0.5 AS t, CASE WHEN frame % 5 = 0 THEN '-inf'::DOUBLE ELSE -value END AS M, CASE WHEN frame % 2 = 0 THEN -value - 1 END AS S FROM f")
def loudness_log(spark, sf):
    f = frames(spark, sf)
    short = F.when(F.col("frame") % 2 == 0, F.concat(F.lit("lavfi.r128.S="), (-F.col("value") - 1).cast("string")))
    lines = F.array_compact(F.array(F.format_string("frame:%d pts_time:%.1f", "frame", F.col("frame") * 0.5), F.concat(F.lit("lavfi.r128.M="), F.when(F.col("frame") % 5 == 0, "-inf").otherwise((-F.col("value")).cast("string"))), short))
    return probes.loudness_series(_lines(f, ["frame"], lines), K)


@query("""SELECT c_custkey AS media, CASE WHEN c_custkey % 9 = 0 THEN '-inf'::DOUBLE WHEN c_custkey % 9 = 1 THEN NULL ELSE -(c_custkey % 40) - 0.5 END::DOUBLE AS integrated_lufs, (c_custkey % 20)::DOUBLE AS lra_lu, -33.25::DOUBLE AS threshold_lufs, (c_custkey % 5 - 3)::DOUBLE AS true_peak_dbfs FROM customer""")
def loudness_summary(spark, sf):
    k = F.col("c_custkey")
    i = F.when(k % 9 == 0, "-inf").when(k % 9 == 1, "nan").otherwise(F.format_string("%.1f", -(k % 40) - 0.5))
    text = F.concat(F.lit("Summary:\n  Integrated loudness:\n    I:  "), i, F.lit(" LUFS\n    Threshold: -33.25 LUFS\n  Loudness range:\n    LRA: "), (k % 20).cast("string"), F.lit(" LU\n  True peak:\n    Peak: "), (k % 5 - 3).cast("string"), F.lit(" dBFS"))
    return probes.loudness_summary(table(spark, sf, "customer").select(k.alias("media"), text.alias("text"))).drop("text")


@query(f"""WITH {PACKETS} SELECT media, frame, CASE WHEN frame % 6 = 0 THEN frame ELSE frame * 0.04 END::DOUBLE AS t, CASE WHEN frame % 5 = 0 THEN 0 ELSE complexity END::BIGINT AS size, CASE WHEN frame % 4 = 0 THEN '?' ELSE 'P' END AS type, key FROM p""")
def packet_log(spark, sf):
    p = packets(spark, sf)
    at = F.when(F.col("frame") % 6 == 0, "N/A").otherwise(F.format_string("%.2f", F.col("frame") * 0.04))
    line = F.concat_ws("|", F.concat(F.lit("pts_time="), at), F.concat(F.lit("pkt_size="), F.when(F.col("frame") % 5 == 0, "N/A").otherwise(F.col("complexity").cast("long").cast("string"))), F.concat(F.lit("pict_type="), F.when(F.col("frame") % 4 == 0, "").otherwise("P")), F.concat(F.lit("key_frame="), F.col("key").cast("string")))
    return probes.packet_log(_lines(p, ["frame"], F.array(line)), K).withColumn("frame", F.col("frame").cast("long"))


@query(f"WITH {FRAMES} SELECT media, frame + 1 AS n, CASE WHEN frame % 8 = 0 THEN 'inf'::DOUBLE ELSE value END AS psnr, (frame % 100) / 100.0::DOUBLE AS ssim FROM f")
def quality_logs(spark, sf):
    f = frames(spark, sf)
    one = F.concat(F.lit("n:"), (F.col("frame") + 1).cast("string"), F.lit(" mse_avg:1.2 psnr_avg:"), F.when(F.col("frame") % 8 == 0, "inf").otherwise(F.col("value").cast("string")), F.lit(" psnr_y:1"))
    two = F.concat(F.lit("n:"), (F.col("frame") + 1).cast("string"), F.lit(" Y:0.9 All:"), F.format_string("%.2f", F.col("frame") % 100 / 100), F.lit(" (12.3)"))
    return probes.psnr_log(_lines(f, ["frame"], F.array(one, F.lit("junk"))), K).join(probes.ssim_log(_lines(f, ["frame"], F.array(two)), K), ["media", "n"])


# ---- captions

_CUE = "c AS (SELECT conv_id AS media, turn AS k, trim(regexp_replace(substr(coalesce(text, ''), 1, 30), '[^A-Za-z ]', '', 'g')) AS words FROM conversations)"


@query(f"WITH {_CUE} SELECT media, k * 3661.5::DOUBLE AS t0, k * 3661.5::DOUBLE + 1.25 AS t1, words || chr(10) || 'line two' AS text FROM c")
def srt_cues(spark, sf):
    cue = table(spark, sf, "conversations").select(F.col("conv_id").alias("media"), F.col("turn").alias("k"), F.trim(F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 30), "[^A-Za-z ]", "")).alias("words"))
    stamp = lambda s: F.concat(F.regexp_replace(F.lpad(texts.hms_millis(s), 12, "0"), r"\.", ","))
    block = F.concat((F.col("k") + 1).cast("string"), F.lit("\r\n"), stamp(F.col("k") * 3661.5), F.lit(" --> "), stamp(F.col("k") * 3661.5 + 1.25), F.lit("\r\n<i>"), F.col("words"), F.lit("</i>\r\n{\\an8}line two\r\n"))
    whole = cue.groupBy("media").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", block.alias("b")))), lambda x: x.b), "\r\n").alias("text"))
    return probes.srt_cues(whole, K).withColumn("text", F.when(F.startswith("text", F.lit("line two")), F.concat(F.lit("\n"), F.col("text"))).otherwise(F.col("text")))


def _cues(spark: SparkSession, sf: str) -> DataFrame:
    """(media, t0, t1, text): a turn of a conversation begins every four seconds and is read at 25 characters a second."""
    t0 = F.col("turn") * 4.0
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("media"), t0.alias("t0"), (t0 + F.length("text") / 25.0).alias("t1"), "text", "turn")


_CUE_ROWS = r"""q AS (SELECT conv_id AS media, turn * 4.0::DOUBLE AS t0, turn * 4.0::DOUBLE + length(text) / 25.0::DOUBLE AS t1, text FROM conversations),
d AS (SELECT media, max(t0) AS duration FROM q GROUP BY media),
g AS (SELECT q.*, duration, length(regexp_replace(text, '\s+', '', 'g')) / nullif(t1 - t0, 0) AS cps, coalesce(lead(t0) OVER (PARTITION BY q.media ORDER BY t0, t1) < t1 - 1e-3, false) AS over FROM q JOIN d ON q.media = d.media)"""


@query(rf"""WITH {_CUE_ROWS}, c AS (SELECT media, count(*) AS cues, count(*) FILTER (cps > 21) AS fast, count(*) FILTER (t1 - t0 < 0.833) AS brief,
    count(*) FILTER (len(string_split(text, chr(10))) > 2 OR list_max(list_transform(string_split(text, chr(10)), lambda l: length(l))) > 42) AS tall_or_wide, count(*) FILTER (over) AS overlaps, count(*) FILTER (t1 > duration + 1) AS beyond_end FROM g GROUP BY media),
s AS (SELECT media, t0, t0 + 3 AS t1 FROM q), x AS (SELECT s.media, sum(least(s.t1, q.t1) - greatest(s.t0, q.t0)) AS covered FROM s JOIN q ON s.media = q.media AND s.t0 < q.t1 AND q.t0 < s.t1 GROUP BY s.media), l AS (SELECT media, sum(t1 - t0) AS total FROM s GROUP BY media)
SELECT c.*, round(100 * coalesce(covered, 0) / total, 6) AS coverage_pct FROM c JOIN l ON c.media = l.media LEFT JOIN x ON x.media = c.media""")
def caption_summary(spark, sf):
    cues = _cues(spark, sf).drop("turn")
    speech = cues.select("media", "t0", (F.col("t0") + 3).alias("t1"))
    out = captions.summary(cues, speech, cues.groupBy("media").agg(F.max("t0").alias("duration")), K)
    return out.select("media", "cues", "fast", "brief", "tall_or_wide", "overlaps", "beyond_end", r6("coverage_pct").alias("coverage_pct"))


@query("""WITH q AS (SELECT conv_id AS media, turn * 4.0::DOUBLE AS t, substr(text, 1, 46) AS label, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations WHERE turn > 0 AND text IS NOT NULL) SELECT media, t, label FROM q WHERE k <= 3""")
def cue_marks(spark, sf):
    return captions.cue_marks(_cues(spark, sf).filter("text IS NOT NULL"), K, 3)


# ---- container bytes


def _be(value: Column, size: int) -> Column:
    """A number as `size` big-endian bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def _box(name: str, *content: Column) -> Column:
    body = F.concat(*content) if len(content) > 1 else content[0]
    return F.concat(_be(F.length(body) + 8, 4), F.lit(name.encode()), body)


def _zeros(n: Column | int) -> Column:
    return F.unhex(F.repeat(F.lit("00"), F.lit(n) if isinstance(n, int) else n))


def _mp4(spark: SparkSession, sf: str) -> DataFrame:
    """An MP4 file for each supplier: type, padding, index (its times in 32 or 64 bits, a sample table), media, and now and
    then bytes behind the last box."""
    k = F.col("s_suppkey")
    created = k % 3 * 1000
    mvhd = F.when(k % 2 == 0, F.concat(F.lit(bytes(4)), _be(created, 4), _be(created + 5, 4), _be(F.lit(600), 4), _be(k * 10, 4))).otherwise(F.concat(F.lit(b"\x01\0\0\0"), _be(created, 8), _be(created + 5, 8), _be(F.lit(600), 4), _be(k * 10, 8)))
    uniform = F.concat(_zeros(4), _be(F.lit(7), 4), _be(k % 50, 4))
    listed = F.concat(_zeros(4), _be(F.lit(0), 4), _be(F.lit(3), 4), _be(k, 4), _be(k + 1, 4), _be(k + 2, 4))
    stsz = _box("stsz", F.when(k % 2 == 0, uniform).otherwise(listed))
    elst = _box("elst", _zeros(4), _be(k % 4, 4))
    moov = _box("moov", _box("mvhd", mvhd), _box("trak", _box("edts", elst), _box("mdia", _box("minf", _box("stbl", stsz)))))
    padding = _box("free", F.when(k % 5 == 0, F.unhex(F.repeat(F.lit("41"), 100))).otherwise(_zeros(100)))
    media = F.concat(_be(k % 100 * 100 + 8, 4), F.lit(b"mdat"), F.unhex(F.repeat(F.lit("5A"), (k % 100 * 100).cast("int"))))
    tail = F.when(k % 4 == 0, F.lit(b"PK\x03\x04 hidden")).otherwise(F.lit(b""))
    content = F.concat(_box("ftyp", F.lit(b"isom\0\0\0\1")), padding, F.when(k % 3 == 0, F.concat(media, moov)).otherwise(F.concat(moov, media)), tail)
    return table(spark, sf, "supplier").select(k.alias("media"), content.alias("content"))


# sizes of the boxes above: the movie header 8 + 20 or 32, the sample table 8 + 12 or 24
_MP4_SQL = """z AS (SELECT s_suppkey AS media, s_suppkey AS k, 8 + CASE WHEN s_suppkey % 2 = 0 THEN 20 ELSE 32 END AS mvhd, 8 + CASE WHEN s_suppkey % 2 = 0 THEN 12 ELSE 24 END AS stsz, 8 + s_suppkey % 100 * 100 AS mdat FROM supplier),
y AS (SELECT *, 8 + mvhd + 8 + 24 + 24 + stsz AS moov FROM z), m AS (SELECT *, CASE WHEN k % 3 = 0 THEN 124 + mdat ELSE 124 END AS moov_at, CASE WHEN k % 3 = 0 THEN 124 ELSE 124 + moov END AS mdat_at FROM y)"""


@query(f"""WITH {_MP4_SQL} SELECT media, unnest([{{'depth': 0, 'type': 'ftyp', 'offset': 0, 'size': 16}}, {{'depth': 0, 'type': 'free', 'offset': 16, 'size': 108}}, {{'depth': 0, 'type': 'mdat', 'offset': mdat_at, 'size': mdat}},
    {{'depth': 0, 'type': 'moov', 'offset': moov_at, 'size': moov}}, {{'depth': 1, 'type': 'mvhd', 'offset': moov_at + 8, 'size': mvhd}}, {{'depth': 1, 'type': 'trak', 'offset': moov_at + 8 + mvhd, 'size': moov - 8 - mvhd}},
    {{'depth': 2, 'type': 'edts', 'offset': moov_at + 16 + mvhd, 'size': 24}}, {{'depth': 3, 'type': 'elst', 'offset': moov_at + 24 + mvhd, 'size': 16}}, {{'depth': 2, 'type': 'mdia', 'offset': moov_at + 40 + mvhd, 'size': 24 + stsz}},
    {{'depth': 3, 'type': 'minf', 'offset': moov_at + 48 + mvhd, 'size': 16 + stsz}}, {{'depth': 4, 'type': 'stbl', 'offset': moov_at + 56 + mvhd, 'size': 8 + stsz}}, {{'depth': 5, 'type': 'stsz', 'offset': moov_at + 64 + mvhd, 'size': stsz}}], recursive := true) FROM m""")
def mp4_boxes(spark, sf):
    return containers.mp4_boxes(_mp4(spark, sf), K).drop("head").withColumn("depth", F.col("depth").cast("int"))


SQL["mp4_boxes"] = SQL["mp4_boxes"].replace("'depth': 0", "'depth': 0::INT")


@query(f"""WITH {_MP4_SQL} SELECT media, (k % 2 <> 0)::INT AS version, (k % 3 * 1000)::BIGINT AS created, (k % 3 * 1000 + 5)::BIGINT AS modified, 600::BIGINT AS timescale, (k * 10)::BIGINT AS duration FROM m""")
def movie_times(spark, sf):
    return containers.movie_times(containers.mp4_boxes(_mp4(spark, sf), K), K).select("media", "version", *(F.col(c).cast("long").alias(c) for c in ("created", "modified", "timescale", "duration")))


@query(f"""WITH {_MP4_SQL}, r AS (SELECT media, unnest([CASE WHEN k % 3 = 0 THEN 'info:index behind the media' END, CASE WHEN k % 4 > 1 THEN 'warn:edit list of several entries' END, CASE WHEN k % 3 = 0 THEN 'info:creation time zeroed' END]) AS r FROM m)
SELECT media, split_part(r, ':', 1) AS severity, split_part(r, ':', 2) AS text FROM r WHERE r IS NOT NULL""")
def container_findings(spark, sf):
    return containers.container_findings(containers.mp4_boxes(_mp4(spark, sf), K), K).select("media", "severity", "text")


@query(f"""WITH {_MP4_SQL}, r AS (SELECT *, CASE WHEN k % 2 = 0 THEN 7 * (k % 50) ELSE 3 * k + 3 END AS used FROM m),
f AS (SELECT media, unnest([CASE WHEN k % 4 = 0 THEN {{'kind': 'appended_data', 'offset': 124 + moov + mdat, 'size': 11}} END, CASE WHEN k % 5 = 0 THEN {{'kind': 'padding_atom', 'offset': 16, 'size': 108}} END,
    CASE WHEN mdat - 8 - used > greatest(4096, 0.02 * mdat) THEN {{'kind': 'mdat_gap', 'offset': mdat_at, 'size': mdat - 8 - used}} END]) AS f FROM r) SELECT media, f.kind AS kind, f.offset AS "offset", f.size AS size FROM f WHERE f IS NOT NULL""")
def hidden_in_container(spark, sf):
    files = _mp4(spark, sf)
    return containers.hidden_data(containers.mp4_boxes(files, K), files, K).select("media", "kind", "offset", "size")


@query("""WITH p AS (SELECT page_id AS media, strlen(html) AS n FROM pages) SELECT media, 'ZIP' AS format, n AS "offset" FROM p UNION ALL SELECT media, 'GIF89a', n + 20 FROM p""")
def magic_hits(spark, sf):
    content = F.concat(F.col("html").cast("binary"), F.lit(b"PK\x03\x04" + bytes(16) + b"GIF89a"))
    return containers.magic_hits(table(spark, sf, "pages").select(F.col("page_id").alias("media"), content.alias("content")), K, block=1000)


@query(f"""WITH {_MP4_SQL} SELECT media, CASE kind WHEN 'a' THEN 'warn' WHEN 'b' THEN 'info' WHEN 'c' THEN 'warn' ELSE 'info' END AS severity, CASE kind WHEN 'a' THEN 124 + mdat + moov WHEN 'b' THEN 24 WHEN 'c' THEN 40 ELSE mdat_at + 8 END::BIGINT AS "offset",
    CASE kind WHEN 'a' THEN 'ZIP' WHEN 'b' THEN 'GZIP' WHEN 'c' THEN 'PDF' ELSE 'BZIP2' END AS format, CASE kind WHEN 'a' THEN 'trailing' WHEN 'd' THEN 'media' ELSE 'header' END AS place, CASE kind WHEN 'a' THEN NULL WHEN 'd' THEN 'mdat' ELSE 'free' END AS held_by
    FROM m, (VALUES ('a'), ('b'), ('c'), ('d')) v(kind) WHERE CASE kind WHEN 'a' THEN k % 4 = 0 WHEN 'd' THEN k % 100 > 0 ELSE true END""")
def embedded_files(spark, sf):
    """Signatures planted in the padding, at the head of the media, and behind the last box."""
    begins = F.expr("CASE WHEN media % 3 = 0 THEN 133 ELSE locate('mdat', decode(content, 'ISO-8859-1')) + 4 END")
    planted = F.concat(F.substring("content", 1, 24), F.lit(b"\x1f\x8b\x08" + bytes(13) + b"%PDF-" + bytes(79)), F.expr("substring(content, 125, length(content))"))
    files = _mp4(spark, sf).withColumn("content", planted)
    opening = F.concat(F.expr("substring(content, 1, _at - 1)"), F.lit(b"BZhBZ"), F.expr("substring(content, _at + 5, length(content))"))
    files = files.withColumn("_at", begins).withColumn("content", F.when(F.col("media") % 100 > 0, opening).otherwise(F.col("content"))).select("media", "content")
    found = containers.embedded_files(containers.magic_hits(files, K), containers.mp4_boxes(files, K), K)
    return found.select("media", "severity", "offset", "format", "place", "held_by")


@query(f"""WITH {_MP4_SQL}, e AS (SELECT media, 124 + mdat + moov AS behind FROM m WHERE k % 4 = 0)
SELECT media, behind::BIGINT AS "offset", 11::BIGINT AS size, round(log2(11.0) - 2.0 / 11, 6) AS entropy, false AS packed FROM e""")
def appended_entropy(spark, sf):
    files = _mp4(spark, sf)
    found = containers.appended_data(containers.mp4_boxes(files, K), files, K)
    return found.withColumn("entropy", r6("entropy"))


_SIGNED = "html || CASE page_id % 5 WHEN 0 THEN 'PK' || chr(3) || chr(4) WHEN 1 THEN 'GIF89a' WHEN 2 THEN '%PDF-' || 'BZh' WHEN 3 THEN '-----BEGIN ' ELSE '' END"


@query(f"""WITH p AS (SELECT page_id % 4 AS bucket, page_id, {_SIGNED} AS x, strlen({_SIGNED}) + 1 AS n FROM pages), s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY bucket ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM p),
g AS (SELECT * FROM (VALUES ('ZIP', 'PK' || chr(3) || chr(4)), ('GIF89a', 'GIF89a'), ('PDF', '%PDF-'), ('BZIP2', 'BZh'), ('PEM', '-----BEGIN ')) v(format, sign)),
c AS (SELECT bucket, format, sign, base, string_split(x, sign) AS parts FROM s, g WHERE contains(x, sign)), r AS (SELECT *, unnest(range(1, len(parts))) AS i FROM c)
SELECT bucket::BIGINT AS bucket, format, (base + list_sum([strlen(y) FOR y IN parts[1:i]]) + (i - 1) * strlen(sign))::BIGINT AS "offset" FROM r""")
def file_signatures(spark, sf):
    """Pages written to four files, which are read back as byte ranges of 10,000 bytes, two to a partition."""
    rows = table(spark, sf, "pages").select((F.col("page_id") % 4).cast("long").alias("bucket"), "page_id", F.expr(_SIGNED).alias("value"))
    folder = new_folder(spark)
    rows.repartition("bucket").sortWithinPartitions("bucket", "page_id").select("bucket", "value").write.partitionBy("bucket").text(folder)
    found = ranges.signature_hits(spark, folder, size=10_000, stretch=20_000)
    return found.select(F.regexp_extract("path", r"bucket=(\d+)", 1).cast("long").alias("bucket"), "format", "offset")


@query("""SELECT s_suppkey AS media, 3 AS messages, 2 AS user_data, (s_suppkey % 3000 + 20)::BIGINT AS user_bytes, (s_suppkey % 3000 > 2048)::BIGINT AS large FROM supplier""")
def sei_tally(spark, sf):
    k = F.col("s_suppkey") % 3000
    size = F.concat(F.unhex(F.repeat(F.lit("FF"), F.floor(k / 255).cast("int"))), _be(k % 255, 1))
    message = lambda kind, n, body: F.concat(F.lit(bytes([kind])), n, body)
    free = message(5, size, F.unhex(F.repeat(F.lit("41"), k.cast("int"))))
    unit = F.concat(F.lit(b"\0\0\0\1\x06"), free, message(1, F.lit(b"\4"), F.lit(b"abcd")), message(5, F.lit(b"\x14"), F.lit(b"B" * 20)), F.lit(b"\x80"))
    stream = F.concat(F.lit(b"\0\0\1\x67abc"), unit, F.lit(b"\0\0\1\x65\x88\x84"))
    files = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("media"), stream.alias("content"))
    return containers.sei_tally(containers.sei_messages(files, K), K)


@query("""WITH b AS (SELECT page_id, unnest(range(0, strlen(html), 4096)) AS a, hex(encode(html)) AS h FROM pages), c AS (SELECT page_id, a // 4096 AS block, unnest(regexp_extract_all(substr(h, a * 2 + 1, 8192), '..')) AS x FROM b),
n AS (SELECT page_id, block, x, count(*) AS c FROM c GROUP BY ALL) SELECT page_id, block::INT AS block, sum(c)::INT AS n, round(log2(sum(c)) - sum(c * log2(c)) / sum(c) + 0.0, 6) AS entropy FROM n GROUP BY page_id, block""")
def entropy_blocks(spark, sf):
    return containers.entropy_blocks(table(spark, sf, "pages").select("page_id", F.col("html").cast("binary").alias("content")), ["page_id"], 4096).withColumn("entropy", r6("entropy"))


# ---- text and colour functions


@query(r"""SELECT o_orderkey AS media, CASE WHEN o_totalprice < 0 THEN 'n/a' ELSE printf('%02d:%02d:%02d', (floor(o_totalprice)::BIGINT % 86400 // 3600)::INT, (floor(o_totalprice)::BIGINT % 3600 // 60)::INT, (floor(o_totalprice)::BIGINT % 60)::INT) END AS hms,
    printf('%d:%02d:%02d.%03d', (o_custkey * 1777 // 3600000)::INT, (o_custkey * 1777 % 3600000 // 60000)::INT, (o_custkey * 1777 % 60000 // 1000)::INT, (o_custkey * 1777 % 1000)::INT) AS stamp,
    CASE o_orderkey % 4 WHEN 0 THEN round(o_custkey / 1001.0::DOUBLE, 6) WHEN 1 THEN o_custkey ELSE 0 END::DOUBLE AS rate, CASE WHEN o_custkey / 100.0 BETWEEN 0.1 AND 10 THEN round(o_custkey / 100.0::DOUBLE, 6) ELSE 1 END::DOUBLE AS aspect,
    regexp_replace(regexp_replace(o_orderpriority || '/' || o_orderstatus || '_', '[^A-Za-z0-9.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
    CASE WHEN o_custkey = 0 THEN NULL ELSE epoch(TIMESTAMP '1904-01-01' + to_seconds(2082844800 + o_custkey * 1000)) END::BIGINT AS written FROM orders""")
def text_functions(spark, sf):
    k = F.col("o_custkey")
    o = table(spark, sf, "orders")
    ratio = F.when(F.col("o_orderkey") % 4 == 0, F.concat(k.cast("string"), F.lit("/1001"))).when(F.col("o_orderkey") % 4 == 1, k.cast("string")).when(F.col("o_orderkey") % 4 == 2, "1/0").otherwise("n/a")
    written = F.unix_seconds(texts.mp4_time(F.when(k == 0, F.lit(0)).otherwise(2082844800 + k * 1000)))
    return o.select(F.col("o_orderkey").alias("media"), texts.hms(F.col("o_totalprice")).alias("hms"), texts.hms_millis(k * 1.777).alias("stamp"), r6(texts.rate(ratio)).alias("rate"), r6(texts.aspect(F.concat(k.cast("string"), F.lit(":100")))).alias("aspect"), texts.slug(F.concat("o_orderpriority", F.lit("/"), "o_orderstatus", F.lit("_"))).alias("slug"), written.alias("written"))


@query("""WITH x AS (SELECT event_id, least(greatest(value / 400, 0), 1) AS e, value / 40 AS h FROM events), p AS (SELECT *, pow(e, 0.1593017578125) AS p FROM x)
SELECT event_id, round(pow((0.8359375 + 18.8515625 * p) / (1 + 18.6875 * p), 78.84375), 6) AS pq, round(CASE WHEN e <= 0.5 THEN e * e / 3 ELSE (exp((e - 0.55991073) / 0.17883277) + 0.28466892) / 12 END, 6) AS hlg,
    round(CASE WHEN e < 0.018 THEN 4.5 * e ELSE 1.099 * pow(e, 0.45) - 0.099 END, 6) AS oetf, round((h * (0.15 * h + 0.05) + 0.004) / (h * (0.15 * h + 0.5) + 0.06) - 0.02 / 0.3, 6) AS hable,
    round(0.2627 * e + 0.6780 * e * e + 0.0593 * (1 - e), 6) AS luma FROM p""")
def colour_curves(spark, sf):
    e = F.least(F.greatest(F.col("value") / 400, F.lit(0.0)), F.lit(1.0))
    return table(spark, sf, "events").select("event_id", r6(colour.pq_oetf(e)).alias("pq"), r6(colour.hlg_inverse_oetf(e)).alias("hlg"), r6(colour.bt709_oetf(e)).alias("oetf"), r6(colour.hable(F.col("value") / 40)).alias("hable"), r6(colour.luma(e, e * e, 1 - e, "2020")).alias("luma"))


# ---- rules

#: Each measured column of the wide row, in Spark SQL that DuckDB reads too.
_MEASURED = {
    "integrated_lufs": "avg(value) / 10 - 29",
    "true_peak_dbfs": "max(value) / 100 - 3",
    "has_audio": "count(*) > 30",
    "silence_total": "count(CASE WHEN value < 8 THEN 1 END) * 1.0",
    "black_segments": "count(CASE WHEN value < 2 THEN 1 END) * 1.0",
    "freeze_segments": "count(CASE WHEN value > 180 THEN 1 END) * 1.0",
    "brng_p99": "min(value) / 40",
    "is_hdr": "count(*) % 3 = 0",
    "hdr_complete": "max(value) > 150",
    "banding_pct": "stddev_pop(value) / 5",
    "pse_risk": "count(CASE WHEN value > 150 THEN 1 END) > 3",
    "cadence": "CASE WHEN count(*) % 4 = 0 THEN '2:3 Pulldown' ELSE 'regular' END",
    "light_note": "CASE WHEN max(value) > 200 THEN 'MaxCLL exceeds the declared' ELSE 'as declared' END",
    "dynhdr_flags": "count(CASE WHEN value < 1 THEN 1 END) * 1.0",
    "provenance": "CASE WHEN count(*) % 5 = 0 THEN 'INVALID' WHEN count(*) % 5 = 1 THEN 'VALID' END",
    "container_warnings": "count(CASE WHEN value BETWEEN 30 AND 30.5 THEN 1 END) * 1.0",
    "strong_splices": "count(CASE WHEN value BETWEEN 31 AND 31.5 THEN 1 END) * 1.0",
    "loops": "count(CASE WHEN value BETWEEN 32 AND 32.5 THEN 1 END) * 1.0",
    "noise_outliers": "count(CASE WHEN value BETWEEN 33 AND 33.5 THEN 1 END) * 1.0",
    "enf_jumps": "count(CASE WHEN value BETWEEN 34 AND 34.5 THEN 1 END) * 1.0",
    "platform_reencode": "count(*) % 7 = 0",
    "double_quant": "avg(value) / 150",
    "audio_warnings": "count(CASE WHEN value BETWEEN 35 AND 35.5 THEN 1 END) * 1.0",
    "platform_doubt": "count(*) % 4 = 1",
    "tempo_score": "stddev_pop(value) / 110",
    "dropout_pct": "min(value) * 2",
    "head_switch_pct": "avg(value)",
    "jitter_pct": "avg(value) / 2",
    "flicker_ratio": "stddev_pop(value) * 0.6",
    "has_captions": "count(*) % 6 > 0",
    "coverage_pct": "100 - avg(value) / 2",
    "sync_offset": "min(value)",
    "fast_cues": "count(CASE WHEN value BETWEEN 36 AND 36.5 THEN 1 END) * 1.0",
    "layout_cues": "count(CASE WHEN value BETWEEN 37 AND 37.5 THEN 1 END) * 1.0",
    "appended": "count(CASE WHEN value BETWEEN 38 AND 38.5 THEN 1 END) * 1.0",
    "embedded": "count(CASE WHEN value BETWEEN 39 AND 39.5 THEN 1 END) * 1.0",
    "padding": "count(CASE WHEN value BETWEEN 40 AND 40.5 THEN 1 END) * 1.0",
    "mdat_gap": "count(CASE WHEN value BETWEEN 41 AND 41.5 THEN 1 END) * 1.0",
    "lsb_suspicious": "count(*) % 8 = 0",
    "large_sei": "count(CASE WHEN value BETWEEN 42 AND 42.5 THEN 1 END) * 1.0",
}


def _none_of(column: str, severity: str = "warn") -> str:
    return f"CASE WHEN {column} = 0 THEN 'pass' ELSE '{severity}' END"


def _when(condition: str, severity: str = "warn") -> str:
    return f"CASE WHEN {condition} THEN '{severity}' ELSE 'pass' END"


def _loud(low: int, high: int) -> str:
    return f"CASE WHEN integrated_lufs <= -69 THEN 'fail' WHEN integrated_lufs BETWEEN {low} AND {high} THEN 'pass' WHEN integrated_lufs BETWEEN {low - 2} AND {high + 2} THEN 'warn' ELSE 'fail' END"


def _picture_sql(black: str, brng: float) -> dict[str, str]:
    return {
        "black": _none_of("black_segments", black),
        "freeze": _none_of("freeze_segments", black),
        "range": _when(f"NOT is_hdr AND brng_p99 > {brng}"),
        "hdr": _when("is_hdr AND NOT hdr_complete"),
        "banding": _when("banding_pct > 8"),
        "pse": _when("pse_risk", "fail"),
        "cadence": _when("contains(cadence, 'Pulldown')"),
        "maxcll": _when("contains(light_note, 'exceeds')"),
        "dynhdr": _none_of("dynhdr_flags"),
    }


_PEAK = "CASE WHEN true_peak_dbfs <= -1 THEN 'pass' WHEN true_peak_dbfs <= 0 THEN 'warn' ELSE 'fail' END"
_FORENSIC = {
    "provenance": _when("coalesce(provenance = 'INVALID', false)", "fail"),
    "container": _none_of("container_warnings"),
    "splices": _none_of("strong_splices"),
    "loops": _none_of("loops"),
    "noise": _none_of("noise_outliers"),
    "enf": _none_of("enf_jumps"),
    "recompress": _when("NOT platform_reencode AND double_quant > 0.35"),
    "audio": _none_of("audio_warnings"),
}
_PROFILES = {
    "broadcast-r128": {"loudness": _loud(-24, -22), "true_peak": _PEAK, "has_audio": _when("NOT has_audio", "fail"), "silence": _when("silence_total > 5"), **_picture_sql("fail", 0.02)},
    "web-streaming": {"loudness": _loud(-15, -13), "true_peak": _PEAK, "has_audio": _when("NOT has_audio"), "silence": _when("silence_total > 5"), **_picture_sql("warn", 0.05)},
    "general": {"has_audio": _when("NOT has_audio"), "silence": _when("silence_total > 10"), **_picture_sql("warn", 0.05)},
    "integrity": _FORENSIC,
    "speedrun": {**_FORENSIC, "platform": _when("platform_doubt"), "tempo": _when("tempo_score >= 0.45")},
    "analog": {"dropouts": _when("dropout_pct > 0.5"), "head_switch": _when("head_switch_pct > 50"), "jitter": _when("jitter_pct > 25"), "flicker": _when("flicker_ratio > 30")},
    "captions": {"presence": _when("NOT has_captions"), "coverage": _when("coverage_pct < 70"), "sync": _when("sync_offset > 0.3"), "speed": _none_of("fast_cues"), "layout": _none_of("layout_cues")},
    "hidden-data": {"appended": _none_of("appended"), "embedded": _none_of("embedded"), "padding": _none_of("padding"), "mdat_gap": _none_of("mdat_gap"), "lsb": _when("lsb_suspicious"), "sei": _none_of("large_sei")},
}


def _context(spark: SparkSession, sf: str) -> DataFrame:
    """One wide row for each media, every column measured from its frames."""
    return frames(spark, sf).groupBy("media").agg(*(F.expr(x).cast("double" if "1.0" in x else "string").alias(c) if "1.0" in x else F.expr(x).alias(c) for c, x in _MEASURED.items()))


_CHECKS_SQL = f"""WITH {FRAMES}, m AS (SELECT media, {", ".join(f"{x} AS {c}" for c, x in _MEASURED.items())} FROM f GROUP BY media),
k AS (SELECT media, unnest([{", ".join(f"{{'profile': '{p}', 'check_id': '{i}', 'status': {x}}}" for p, checks in _PROFILES.items() for i, x in checks.items())}]) AS s FROM m)"""


def _all_profiles(spark: SparkSession, sf: str) -> DataFrame:
    context = _context(spark, sf)
    return findings.union([qc.evaluate(context, K, p) for p in _PROFILES])


@query(f"{_CHECKS_SQL} SELECT media, s.profile AS profile, s.check_id AS check_id, s.status AS status FROM k")
def qc_profiles(spark, sf):
    return _all_profiles(spark, sf).select("media", "profile", "check_id", "status")


@query(f"""{_CHECKS_SQL}, v AS (SELECT media, s.profile AS profile, CASE WHEN bool_or(s.status = 'fail') THEN 'fail' WHEN bool_or(s.status = 'warn') THEN 'warn' ELSE 'pass' END AS verdict FROM k GROUP BY ALL)
SELECT profile, verdict, count(*) AS n, max((verdict = 'fail')::INT) AS code FROM v GROUP BY profile, verdict""")
def profile_verdicts(spark, sf):
    v = qc.verdicts(_all_profiles(spark, sf), K)
    return v.groupBy("profile", "verdict").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("verdict") == "fail").cast("int")).alias("code"))


# ---- findings, plans


@query("""WITH RECURSIVE l AS (SELECT c_custkey AS parent, c_custkey * 7 % 100 + 1 AS child FROM customer WHERE c_custkey <= 100), w AS (SELECT c_custkey AS root, c_custkey AS node, 0 AS depth, [c_custkey] AS path FROM customer WHERE c_custkey <= 100 AND c_custkey % 5 = 0
    UNION ALL SELECT root, child, depth + 1, list_append(path, child) FROM w JOIN l ON parent = node WHERE depth < 6 AND NOT list_contains(path, child)) SELECT DISTINCT root, node, depth FROM w""")
def ingredient_chain(spark, sf):
    c = table(spark, sf, "customer").filter("c_custkey <= 100")
    links = c.select(F.col("c_custkey").alias("parent"), (F.col("c_custkey") * 7 % 100 + 1).alias("child"))
    return findings.ingredient_chain(links, c.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("node")))


@query(f"""WITH {FRAMES}, l AS (SELECT media, t, CASE WHEN value > 150 THEN 'cut' WHEN value < 10 THEN 'black' WHEN value < 20 THEN 'freeze' WHEN value > 140 THEN 'other' END AS label FROM f), i AS (SELECT media, round_even(t / 3600 * 0.5, 0)::BIGINT AS frame, label, CASE label WHEN 'black' THEN 0 WHEN 'freeze' THEN 1 WHEN 'cut' THEN 2 ELSE 99 END AS p FROM l WHERE label IS NOT NULL)
SELECT media, frame, arg_min(label, (p, label)) AS label FROM i GROUP BY ALL""")
def issue_index(spark, sf):
    label = F.when(F.col("value") > 150, "cut").when(F.col("value") < 10, "black").when(F.col("value") < 20, "freeze").when(F.col("value") > 140, "other")
    return findings.issues(frames(spark, sf).select("media", (F.col("t") / 3600).alias("t"), label.alias("label")).filter("label IS NOT NULL"), K, 0.5, {"black": 0, "freeze": 1, "cut": 2})


@query("""WITH r AS (SELECT c_custkey AS media, 24 + c_custkey % 3 AS fps, c_custkey % 20 AS duplicates, c_custkey % 6 AS spacing, c_custkey % 4 / 10.0 AS mad, c_custkey % 50 AS dup_pct, 3000.0 * (c_custkey % 9) AS cutoff FROM customer),
s AS (SELECT media, least(1, round(CASE WHEN abs(fps / 25.0 - 1) > 0.02 THEN 0.15 ELSE 0 END + CASE WHEN duplicates >= 6 AND spacing >= 2 AND mad / spacing < 0.25 AND dup_pct >= 12 THEN 0.45 WHEN dup_pct >= 40 THEN 0.3 WHEN dup_pct >= 12 THEN 0.1 ELSE 0 END + CASE WHEN cutoff / 24000 < 0.4 THEN 0.3 WHEN cutoff / 24000 < 0.55 THEN 0.1 ELSE 0 END, 2))::DOUBLE AS score FROM r)
SELECT media, score, CASE WHEN score >= 0.6 THEN 'likely changed' WHEN score >= 0.3 THEN 'possibly changed' ELSE 'unchanged' END AS label FROM s""")
def tempo_score(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    records = c.select(k.alias("media"), (24 + k % 3).cast("double").alias("fps"), F.lit(25.0).alias("nominal_fps"))
    cadence = c.select(k.alias("media"), (k % 20).alias("duplicates"), (k % 6).cast("double").alias("spacing"), (k % 4 / 10).alias("spacing_mad"), (k % 50).cast("double").alias("dup_pct"))
    # a spacing of zero says nothing
    cadence = cadence.withColumn("spacing", F.nullif("spacing", F.lit(0.0)))
    return reports.tempo(cadence, c.select(k.alias("media"), (3000.0 * (k % 9)).alias("cutoff_hz"), F.lit(24000.0).alias("nyquist_hz")), records, K)


@query("""WITH c AS (SELECT c_custkey AS media, c_custkey AS k FROM customer) SELECT media, CASE WHEN k % 7 = 0 THEN 'platform' WHEN k % 5 = 0 THEN 'broadcast' WHEN k % 3 = 0 THEN 'direct encode' WHEN k % 2 = 0 THEN 'processed' ELSE 'unknown' END AS platform FROM c""")
def platform_screen(spark, sf):
    k = F.col("c_custkey")
    records = table(spark, sf, "customer").select(k.alias("media"), F.when(k % 7 == 0, "ISO Media file produced by Google Inc.").alias("handler"), F.when(k % 5 == 0, "mpegts").otherwise("mov").alias("format"), F.when(k % 3 == 0, "x264 - core 164").alias("settings"), F.when(k % 2 == 0, "Lavf60").alias("encoder"))
    return reports.platform(records).select("media", "platform")


@query(f"""WITH {FRAMES}, b AS (SELECT media, min(t) AS t0, max(t) AS t1 FROM f WHERE value < 5 GROUP BY media), n AS (SELECT media, count(*) AS n FROM f GROUP BY media), e AS (SELECT media, count(*) AS events FROM b GROUP BY media) SELECT c_custkey AS media, coalesce(n, 0) AS frames, coalesce(events, 0) AS events FROM customer LEFT JOIN n ON n.media = c_custkey LEFT JOIN e ON e.media = c_custkey""")
def analysis_documents(spark, sf):
    f = frames(spark, sf)
    events = f.filter("value < 5").groupBy("media").agg(F.min("t").alias("t0"), F.max("t").alias("t1")).withColumn("kind", F.lit("black"))
    docs = exports.documents(table(spark, sf, "customer").select(F.col("c_custkey").alias("media")), exports.frame_rows(f, K, ["value"]), events, K)
    return docs.select("media", F.coalesce(F.size("frames"), F.lit(0)).cast("long").alias("frames"), F.coalesce(F.size("events"), F.lit(0)).cast("long").alias("events"))


# ---- hidden bits, chance


_RS = f"""{PACKETS}, g AS (SELECT media, frame // 4 AS g, list(complexity::INT ORDER BY frame) AS x FROM p GROUP BY ALL HAVING count(*) = 4),
v AS (SELECT media, turned, flip, CASE WHEN turned = 1 THEN list_transform(x, lambda a: xor(a, 1)) ELSE x END AS x FROM g, (VALUES (0, 1), (0, -1), (1, 1), (1, -1)) t(turned, flip)),
y AS (SELECT *, list_transform([x[1], x[4]], lambda a: least(greatest(CASE WHEN flip = 1 THEN xor(a, 1) ELSE xor(a + 1, 1) - 1 END, 0), 255)) AS z FROM v),
d AS (SELECT media, turned, flip, abs(x[2] - z[1]) + abs(x[3] - x[2]) + abs(z[2] - x[3]) - abs(x[2] - x[1]) - abs(x[3] - x[2]) - abs(x[4] - x[3]) AS change FROM y),
rs AS (SELECT media, turned, flip, count(*) AS groups, avg((change > 0)::INT) AS regular, avg((change < 0)::INT) AS singular FROM d GROUP BY ALL)"""


@query(f"WITH {_RS} SELECT media, turned, flip, groups, round(regular, 6) AS regular, round(singular, 6) AS singular FROM rs")
def rs_counts(spark, sf):
    return aggregates.regular_singular(packets(spark, sf), K, "frame", "complexity").withColumn("regular", r6("regular")).withColumn("singular", r6("singular"))


@query(f"""WITH {_RS}, w AS (SELECT media, max(groups) AS n, max(regular - singular) FILTER (turned = 0 AND flip = 1) AS d0, max(regular - singular) FILTER (turned = 0 AND flip = -1) AS e0, max(regular - singular) FILTER (turned = 1 AND flip = 1) AS d1, max(regular - singular) FILTER (turned = 1 AND flip = -1) AS e1 FROM rs GROUP BY media),
a AS (SELECT media, n, 2 * (d1 + d0) AS a, e0 - e1 - d1 - 3 * d0 AS b, d0 - e0 AS c FROM w), q AS (SELECT *, CASE WHEN abs(a) > 1e-12 THEN CASE WHEN abs((-b + sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a)) <= abs((-b - sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a)) THEN (-b + sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a) ELSE (-b - sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a) END WHEN abs(b) > 1e-12 THEN -c / b END AS z FROM a),
r AS (SELECT media, CASE WHEN n >= 64 AND abs(z - 0.5) > 1e-9 THEN least(abs(z / (z - 0.5)), 1.5) ELSE 0 END AS rate FROM q)
SELECT media, round(rate, 6) AS rate, rate > 0.10 AS suspicious, CASE WHEN rate > 0.10 THEN 'some' WHEN rate > 0.05 THEN 'weak' ELSE 'clean' END AS confidence FROM r""")
def hidden_bit_rates(spark, sf):
    p = packets(spark, sf).withColumn("v", F.col("complexity").cast("long"))
    rate = aggregates.hidden_bit_rate(aggregates.regular_singular(p, K, "frame", "complexity"), K)
    out = aggregates.hidden_bit_verdict(rate, aggregates.with_probability(aggregates.lsb_pairs(p, K, "v")), K)
    sure = F.when(F.col("confidence").isin("high", "medium"), "some").otherwise(F.col("confidence"))
    return out.select("media", r6("rate").alias("rate"), "suspicious", sure.alias("confidence"))


@query("""SELECT l_suppkey AS media, count(*) AS n, sum(l_quantity::BIGINT & 1)::BIGINT AS ones FROM lineitem GROUP BY l_suppkey""")
def lowest_bits(spark, sf):
    return aggregates.lowest_bits(table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "media"), K, "l_quantity")


@query("""WITH e AS (SELECT user_id AS media, event_type, count(*) AS n, count(*) FILTER (value > 100) AS k FROM events GROUP BY ALL),
i AS (SELECT *, unnest(range(k, n + 1)) AS i FROM e), l AS (SELECT media, event_type, k, log10(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.25) + (n - i) * ln(0.75)))) AS lp FROM i GROUP BY ALL),
s AS (SELECT media, sum(least(0, CASE WHEN k = 0 THEN 0 ELSE lp END + log10(2.0))) AS p FROM l GROUP BY media) SELECT media, round(p, 6) AS log10_p, CASE WHEN p < -9 THEN 'implausible' WHEN p < -5 THEN 'suspicious' ELSE 'plausible' END AS verdict FROM s""")
def luck_tail(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("media"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 100).alias("k"))
    return aggregates.luck(e.withColumn("p", F.lit(0.25)).withColumn("select", F.lit(2.0)), K).withColumn("log10_p", r6("log10_p"))


# ---- greedy picks


@query(f"""WITH RECURSIVE {FRAMES}, c AS (SELECT media, frame, t FROM f WHERE value > 50), p AS (SELECT media, min(t) AS t FROM c GROUP BY media UNION ALL SELECT p.media, min(c.t) AS t FROM p JOIN c ON c.media = p.media AND c.t - p.t > 43200 GROUP BY p.media, p.t)
SELECT c.media, arg_min(frame, frame) AS frame, c.t FROM p JOIN c ON c.media = p.media AND c.t = p.t GROUP BY c.media, c.t""")
def anchor_dedupe(spark, sf):
    return series.spread_out(frames(spark, sf).filter("value > 50").select("media", "frame", "t"), K, "t", 43200.0)


@query(f"""WITH RECURSIVE {FRAMES}, p AS (SELECT media, arg_min(t, (-value, t)) AS t, [arg_min(t, (-value, t))] AS kept FROM f GROUP BY media
    UNION ALL SELECT p.media, arg_min(f.t, (-value, f.t)) AS t, list_append(any_value(kept), arg_min(f.t, (-value, f.t))) AS kept FROM p JOIN f ON f.media = p.media WHERE len(kept) < 12 AND len(list_filter(kept, lambda u: abs(f.t - u) < 86400)) = 0 GROUP BY p.media, p.t)
SELECT f.media, frame, f.t, value FROM p JOIN f ON f.media = p.media AND f.t = p.t""")
def nms_pick(spark, sf):
    return series.best_first(frames(spark, sf).select("media", "frame", "t", "value"), K, "t", "value", 86400.0, 12)


# ---- small pictures: a vector as 8 by 8 pixels

_PX = "px AS (SELECT label AS media, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding, lambda e: least(greatest(floor(e::DOUBLE * 60 + 128), 0), 255)::INT) AS v FROM embeddings)"
_CELLS = f"{_PX}, cell AS (SELECT media, frame, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS i FROM px), c AS (SELECT media, frame, v, i // 8 AS y, i % 8 AS x FROM cell)"


def _pictures(spark: SparkSession, sf: str) -> DataFrame:
    level = F.transform("embedding", lambda e: F.least(F.greatest(F.floor(e.cast("double") * 60 + 128), F.lit(0)), F.lit(255)))
    pixels = F.unhex(F.array_join(F.transform(level, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return table(spark, sf, "embeddings").select(F.col("label").alias("media"), nth.cast("long").alias("frame"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(1).alias("c"), pixels.alias("pixels"))


@query(f"""WITH {_CELLS}, s AS (SELECT a.media, a.frame, a.x % 4 = 0 AS edge, 'x' AS d, avg(abs(a.v - b.v)) AS s FROM c a JOIN c b ON a.media = b.media AND a.frame = b.frame AND a.y = b.y AND a.x = b.x + 1 GROUP BY ALL
    UNION ALL SELECT a.media, a.frame, a.y % 4 = 0, 'y', avg(abs(a.v - b.v)) FROM c a JOIN c b ON a.media = b.media AND a.frame = b.frame AND a.x = b.x AND a.y = b.y + 1 GROUP BY ALL)
SELECT media, frame, round(sum(s) FILTER (edge) / sum(s) FILTER (NOT edge) - 1, 6) AS blockiness FROM s GROUP BY media, frame""")
def picture_blocks(spark, sf):
    of = images.measured(partial(images._blockiness, size=4))
    return _pictures(spark, sf).select("media", "frame", r6(of()).alias("blockiness"))


@query(f"""WITH {_CELLS}, k AS (SELECT b.media, b.frame, avg(abs(b.v - a.v)) AS ydif FROM c a JOIN c b ON a.media = b.media AND a.frame + 1 = b.frame AND a.x = b.x AND a.y = b.y GROUP BY ALL),
m AS (SELECT b.media, b.frame, avg(abs(b.v - (a.v + d.v) / 2.0)) / (avg(abs(d.v - a.v)) + 1e-6) AS comb FROM c a JOIN c b ON a.media = b.media AND a.frame = b.frame AND a.x = b.x AND a.y + 1 = b.y JOIN c d ON d.media = b.media AND d.frame = b.frame AND d.x = b.x AND d.y = b.y + 1 GROUP BY ALL),
x AS (SELECT a.media, a.frame, avg(abs(a.v - b.v)) AS dx FROM c a JOIN c b ON a.media = b.media AND a.frame = b.frame AND a.y = b.y AND a.x = b.x + 1 GROUP BY ALL), y AS (SELECT a.media, a.frame, avg(abs(a.v - b.v)) AS dy FROM c a JOIN c b ON a.media = b.media AND a.frame = b.frame AND a.x = b.x AND a.y = b.y + 1 GROUP BY ALL)
SELECT media, frame, round(ydif, 6) AS ydif, round(comb, 6) AS comb, round(dx + dy + coalesce(ydif, 0), 6) AS complexity FROM m JOIN x USING (media, frame) JOIN y USING (media, frame) LEFT JOIN k USING (media, frame)""")
def picture_changes(spark, sf):
    return images.frame_change(_pictures(spark, sf), K).select("media", "frame", r6("ydif").alias("ydif"), r6("comb").alias("comb"), r6("complexity").alias("complexity"))


@query(f"""WITH {_CELLS}, e AS (SELECT b.media, b.frame, avg((b.v - a.v) * (b.v - a.v)) AS mse FROM c a JOIN c b ON a.media = b.media AND a.frame + 1 = b.frame AND a.x = b.x AND a.y = b.y GROUP BY ALL)
SELECT media, frame, CASE WHEN mse = 0 THEN 'inf'::DOUBLE ELSE round(10 * log10(65025 / mse), 6) END AS psnr FROM e""")
def picture_psnr(spark, sf):
    p = _pictures(spark, sf)
    pairs = p.withColumnRenamed("pixels", "b").join(p.select("media", (F.col("frame") + 1).alias("frame"), F.col("pixels").alias("a")), ["media", "frame"])
    return images.pair_measures(pairs).select("media", "frame", r6("psnr").alias("psnr"))


@query(f"WITH {_CELLS} SELECT media, frame, x::INT AS x, y::INT AS y, v AS r FROM c WHERE x % 2 = 0 AND y % 2 = 0")
def picture_pixels(spark, sf):
    return images.pixels(_pictures(spark, sf), K, 2).select("media", "frame", "x", "y", "r")


# ---- signals


@query("""WITH b AS (SELECT label AS media, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS block, list_transform(embedding[1:24], lambda e: abs(e)::DOUBLE) AS v FROM embeddings),
k AS (SELECT media, block AS start FROM b WHERE block % 7 = 6), p AS (SELECT k.media, start, (s.block - o.o) AS source, list_dot_product(a.v, s.v) AS uv, list_dot_product(a.v, a.v) AS uu, list_dot_product(s.v, s.v) AS vv FROM k, (VALUES (0), (1), (2)) o(o), b a, b s WHERE a.media = k.media AND a.block = start + o.o AND s.media = k.media AND s.block - o.o >= 0 AND s.block - o.o <= start - 5),
s AS (SELECT media, start, source, sum(uv) / (sqrt(sum(uu) * sum(vv)) + 1e-12) AS l FROM p GROUP BY ALL HAVING count(*) = 3) SELECT media, start * 1.0::DOUBLE AS t, arg_min(source, (-l, source)) * 1.0::DOUBLE AS source, round(max(l), 6) AS likeness FROM s GROUP BY media, start""")
def restart_match(spark, sf):
    w = Window.partitionBy("label").orderBy("vec_id")
    b = table(spark, sf, "embeddings").select(F.col("label").alias("media"), (F.row_number().over(w) - 1).alias("block"), F.transform(F.slice("embedding", 1, 24), lambda e: F.abs(e).cast("double")).alias("bands"))
    cuts = b.filter("block % 7 = 6").select("media", (F.col("block") * 1.0).alias("t"))
    return signals.reused(b, K, cuts, 1.0, span_s=3.0, away_s=5.0).withColumn("likeness", r6("likeness"))


@query(f"""WITH RECURSIVE {FRAMES}, q AS (SELECT media, frame, frame / 10.0::DOUBLE AS t, value / 4 - 60 AS m FROM f),
w AS (SELECT media, t, median(m) OVER (PARTITION BY media ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, median(m) OVER (PARTITION BY media ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a,
    median(m) OVER (PARTITION BY media ORDER BY t ROWS BETWEEN 5 FOLLOWING AND 9 FOLLOWING) AS s, count(*) OVER (PARTITION BY media ORDER BY t ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS n FROM q),
c AS (SELECT media, t, coalesce(s, a) - b AS change FROM w WHERE n = 10 AND abs(a - b) >= 4 AND a > -90 AND b > -90),
p AS (SELECT media, min(t) AS t, 1 AS k FROM c GROUP BY media UNION ALL SELECT p.media, min(c.t) AS t, any_value(k) + 1 AS k FROM p JOIN c ON c.media = p.media AND c.t - p.t > 0.5 WHERE k < 20 GROUP BY p.media, p.t) SELECT c.media, c.t, round(change, 6) AS change FROM p JOIN c ON p.media = c.media AND p.t = c.t""")
def loudness_steps(spark, sf):
    s = frames(spark, sf).select("media", (F.col("frame") / 10).alias("t"), (F.col("value") / 4 - 60).alias("m"))
    return signals.loudness_steps(s, K, least_lu=4.0, sustain_s=0.5).withColumn("change", r6("change"))


@query(f"""WITH {FRAMES}, s AS (SELECT media, count(*) AS n, avg(value) AS m FROM f GROUP BY media HAVING count(*) >= 40), x AS (SELECT f.media, frame, coalesce(value - m, 0) * (0.5 - 0.5 * cos(2 * pi() * frame / (n - 1))) AS x, n FROM f JOIN s USING (media)),
k AS (SELECT media, n, unnest(range(1, n // 2 + 1)) AS k FROM s), p AS (SELECT media, k, k * 10.0 / k.n AS hz, pow(sum(x * cos(2 * pi() * k * frame / k.n)), 2) + pow(sum(x * sin(2 * pi() * k * frame / k.n)), 2) AS p FROM k JOIN x USING (media) GROUP BY media, k, k.n),
r AS (SELECT media, arg_max(hz, p) FILTER (hz BETWEEN 0.2 AND 4) AS hz, max(p) FILTER (hz BETWEEN 0.2 AND 4) / (median(p) + 1e-12) AS ratio FROM p GROUP BY media) SELECT media, round(hz, 6) AS hz, round(ratio, 4) AS ratio FROM r WHERE hz IS NOT NULL""")
def flicker_tone(spark, sf):
    return signals.flicker(frames(spark, sf), K, 10.0, "value").select("media", r6("hz").alias("hz"), F.round("ratio", 4).alias("ratio"))


# ---- axes, cells, choices


@query("""WITH o AS (SELECT o_orderkey AS media, o_custkey AS k, o_orderkey % 50 AS n FROM orders) SELECT media, round(CASE WHEN n > 1 THEN least(greatest(k / (n - 1.0::DOUBLE), 0), 1) * 799 ELSE 0 END, 6) AS x,
    CASE WHEN n > 1 THEN round_even(least(greatest(k / 799.0::DOUBLE, 0), 1) * (n - 1), 0) ELSE 0 END::BIGINT AS frame, CASE k % 3 WHEN 0 THEN 'n/a' WHEN 1 THEN '-inf (digital silence)' ELSE '1.5' END AS cell,
    array_to_string([floor(n * (i + 1) / 6.0)::BIGINT FOR i IN range(5)], ',') AS spaced, array_to_string([floor(n * (i + 0.5) / 5)::BIGINT FOR i IN range(5)], ',') AS middles,
    CASE WHEN k % 4 < 2 THEN round(k / 7.0::DOUBLE + 3, 6) END AS ratios FROM o""")
def axis_functions(spark, sf):
    k, n = F.col("o_custkey"), F.col("o_orderkey") % 50
    value = F.when(k % 3 == 1, F.lit(float("-inf"))).when(k % 3 == 2, 1.5)
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    listed = F.concat(k.cast("string"), F.when(k % 4 < 2, F.lit("/7 3 9/0")).otherwise("/7 junk"))
    two = dynamic.rationals(listed, 2)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("media"), r6(texts.frame_to_x(k, 800, n)).alias("x"), texts.x_to_frame(k, 800, n).alias("frame"), texts.cell(value).alias("cell"), joined(texts.evenly_spaced(n, 5)).alias("spaced"), joined(texts.evenly_spaced(n, 5, True)).alias("middles"), r6(F.get(two, F.lit(0)) + F.get(two, F.lit(1))).alias("ratios"))


@query("""WITH o AS (SELECT o_orderkey AS media, o_custkey % 4 AS c, 1000 + o_custkey * 2 AS w, 500 + o_orderkey % 1500 AS h FROM orders)
SELECT media, CASE WHEN c = 0 THEN 'vmaf_4k_v0.6.1' WHEN c = 1 THEN 'vmaf_v0.6.1neg' WHEN c = 2 THEN NULL WHEN h >= 1620 OR w >= 2880 THEN 'vmaf_4k_v0.6.1' END AS model, CASE WHEN w <> 1920 OR h <> 1080 THEN printf('distorted scaled %dx%d -> 1920x1080 to match reference', w, h) END AS note FROM o""")
def quality_choices(spark, sf):
    c, w, h = F.col("o_custkey") % 4, 1000 + F.col("o_custkey") * 2, 500 + F.col("o_orderkey") % 1500
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("media"), probes.quality_model(pick(c, ["4k", "neg", "default", "auto"]), w, h).alias("model"), probes.scale_note(w, h, F.lit(1920), F.lit(1080)).alias("note"))


@query(f"""WITH {FRAMES} SELECT media, round(coalesce(avg(value) FILTER (value >= 20 AND frame % 9 > 0), 'inf'::DOUBLE), 6) AS average FROM f WHERE frame % 9 > 0 OR value < 100 GROUP BY media""")
def xpsnr_average(spark, sf):
    f = frames(spark, sf).filter("frame % 9 > 0 OR value < 100")
    line = F.concat(F.lit("n: 1  XPSNR y: "), F.when((F.col("value") >= 20) & (F.col("frame") % 9 > 0), F.col("value").cast("string")).otherwise("inf"), F.lit("  XPSNR u: 3"))
    return probes.pooled_xpsnr(probes.xpsnr_log(_lines(f, ["frame"], F.array(line, F.lit("junk"))), K), K).withColumn("average", r6("average"))


@query("""WITH p AS (SELECT p_partkey AS media, 'shots/' || p_partkey || '.take.mp4' AS path, p_partkey % 3 AS k FROM part) SELECT media, CASE k WHEN 0 THEN 'shots/' || media || '.take.srt' WHEN 1 THEN 'shots/' || media || '.take.en.srt' END AS sidecar FROM p""")
def sidecar_lookup(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("media"), F.concat(F.lit("shots/"), F.col("p_partkey").cast("string"), F.lit(".take")).alias("stem"))
    names = lambda k, *ends: p.filter(F.col("media") % 3 == k).select(F.explode(F.array(*(F.concat("stem", F.lit(e)) for e in ends))).alias("path"))
    files = names(0, ".en.srt", ".srt", ".txt").unionByName(names(1, ".en.srt")).unionByName(names(2, ".srt.bak"))
    return probes.sidecars(p.select("media", F.concat("stem", F.lit(".mp4")).alias("path")), files).select("media", "sidecar")


@query("""WITH c AS (SELECT c_custkey AS k FROM customer) SELECT k AS media, CASE WHEN k % 5 = 4 THEN NULL WHEN k % 5 = 0 THEN 'VALID' WHEN k % 5 = 1 THEN CASE WHEN k % 2 = 0 THEN 'INVALID' ELSE 'VALID' END WHEN k % 5 = 2 THEN 'INVALID' ELSE 'present' END AS state,
    CASE WHEN k % 5 < 4 THEN 'tool ' || k END AS generator, CASE WHEN k % 5 < 4 THEN 'issuer' END AS issuer, CASE WHEN k % 5 < 4 THEN k % 3 ELSE 0 END::INT AS ingredients FROM c""")
def credential_states(spark, sf):
    k = F.col("c_custkey")
    said = F.when(k % 5 == 0, F.lit('"validation_state": "Trusted",')).when(k % 5 == 1, F.concat(F.lit('"validation_status": [{"code": "claim.ok"}, {"code": "'), F.when(k % 2 == 0, "signingCredential.untrusted").otherwise("timeStamp.fine"), F.lit('"}],'))).when(k % 5 == 2, F.lit('"validation_state": "Invalid",')).otherwise(F.when(k % 2 == 0, F.lit('"validation_state": "odd",')).otherwise(F.lit('"validation_status": [],')))
    body = F.concat(F.lit('{"active_manifest": "m", '), said, F.lit('"manifests": {"m": {"claim_generator": "tool '), k.cast("string"), F.lit('", "signature_info": {"issuer": "issuer"}, "ingredients": ['), F.array_join(F.array_repeat(F.lit('{"title": "x"}'), (k % 3).cast("int")), ","), F.lit("]}}}"))
    docs = table(spark, sf, "customer").select(k.alias("media"), F.when(k % 5 == 4, "not json").otherwise(body).alias("body"))
    return containers.credentials_state(docs).drop("body")


# ---- loads, loops


_SCAN = f"""{FRAMES}, q AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY media ORDER BY frame)) / 20 AS diff FROM f), st AS (SELECT *, coalesce(diff < 1.6, false) AS flag FROM q),
si AS (SELECT *, frame - row_number() OVER (PARTITION BY media, flag ORDER BY frame) AS run FROM st), sc AS (SELECT *, count(*) OVER (PARTITION BY media, flag, run) AS len FROM si),
k AS (SELECT media, frame, CASE WHEN abs(value - 60) < 20 THEN 3 WHEN value / 4 < 26 THEN 2 WHEN flag AND len >= 3.5 THEN 1 ELSE 0 END AS kind FROM sc),
kr AS (SELECT *, sum(CASE WHEN kind IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY media ORDER BY frame) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY media ORDER BY frame) AS p FROM k)),
kg AS (SELECT media, run, kind, min(frame) AS f0, max(frame) AS f1, count(*) AS n FROM kr GROUP BY ALL),
kb AS (SELECT media, f0, f1, n, CASE WHEN kind = 0 AND n <= 1.5 AND lag(kind) OVER w = lead(kind) OVER w THEN lag(kind) OVER w ELSE kind END AS kind FROM kg WINDOW w AS (PARTITION BY media ORDER BY f0)),
ks AS (SELECT *, sum(CASE WHEN (kind > 0) IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY media ORDER BY f0) AS span FROM (SELECT *, lag(kind > 0) OVER (PARTITION BY media ORDER BY f0) AS p FROM kb)),
ld AS (SELECT media, min(f0) AS f0, max(f1) AS f1 FROM ks WHERE kind > 0 GROUP BY media, span HAVING (max(f1) + 1) / 10.0 - min(f0) / 10.0 >= 0.30)"""


def _scanned(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).withColumn("diff", F.abs(series.delta(F.col("value"), series.along(K, ["frame"]))) / 20).withColumn("luma", F.col("value") / 4).withColumn("refd", F.abs(F.col("value") - 60))
    return segments.load_scan(f, K, 10.0, "loose")


@query(f"WITH {_SCAN} SELECT media, f0, f1 FROM ld")
def load_presets(spark, sf):
    return _scanned(spark, sf).select("media", "f0", "f1")


@query(f"""WITH {_SCAN}, r AS (SELECT DISTINCT media, 5::BIGINT AS s, 45::BIGINT AS e FROM f UNION SELECT DISTINCT media, 50, media % 60 FROM f), v AS (SELECT * FROM r WHERE e > s),
l AS (SELECT v.media, s, e, sum(greatest(0, least(f1, e - 1) - greatest(f0, s) + 1)) AS n FROM v LEFT JOIN ld USING (media) GROUP BY ALL)
SELECT media, s AS start, e AS "end", e - s AS frames, round((e - s) / 29.97, 6)::DOUBLE AS rta, coalesce(n, 0)::BIGINT AS load_frames, round(greatest(0, e - s - coalesce(n, 0)) / 29.97, 6)::DOUBLE AS lrt, round_even((e - s) / 29.97::DOUBLE * 60, 0)::BIGINT AS game_frames FROM l""")
def retimed_runs(spark, sf):
    media = frames(spark, sf).select("media").distinct()
    asked = media.select("media", F.lit(5).cast("long").alias("start"), F.lit(45).cast("long").alias("end")).unionByName(media.select("media", F.lit(50).cast("long").alias("start"), (F.col("media") % 60).alias("end")))
    out = segments.retimed(asked, _scanned(spark, sf), K, F.lit(29.97), F.lit(60.0))
    return out.withColumn("rta", r6("rta")).withColumn("lrt", r6("lrt"))


@query(f"""WITH {FRAMES}, h AS (SELECT media, frame, (1 << (floor(value / 40)::INT % 12))::BIGINT AS h FROM f), z AS (SELECT media, max(frame) + 1 AS size FROM h GROUP BY media),
c AS (SELECT a.media, a.h, sum(CASE WHEN bit_count(xor(a.h, b.h)) <= 1 THEN b.n ELSE 0 END) AS n FROM (SELECT media, h, count(*) AS n FROM h GROUP BY ALL) a JOIN (SELECT media, h, count(*) AS n FROM h GROUP BY ALL) b USING (media) GROUP BY ALL),
t AS (SELECT media, h FROM c JOIN z USING (media) WHERE n <= greatest(64, size // 4)),
m AS (SELECT b.media, b.frame, b.h, a.frame AS src, b.frame - a.frame AS delta FROM h b JOIN t ON t.media = b.media AND t.h = b.h JOIN h a ON a.media = b.media AND b.frame - a.frame >= 2 AND bit_count(xor(a.h, b.h)) <= 1),
r AS (SELECT *, frame - row_number() OVER (PARTITION BY media, delta ORDER BY frame) AS run FROM m WHERE delta >= 3),
i AS (SELECT DISTINCT r.media, r.delta, r.run, r.frame, r.delta // k AS part FROM r, (VALUES (2), (3), (4)) t(k) WHERE r.delta // k >= 2),
y AS (SELECT DISTINCT media, delta, run FROM (SELECT i.media, i.delta, i.run, i.part FROM i LEFT JOIN m ON m.media = i.media AND m.frame = i.frame AND m.delta = i.part GROUP BY ALL HAVING 10 * count(m.frame) >= 7 * count(*))),
o AS (SELECT media, delta, min(src) AS source, min(frame) AS repeat, count(*) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.media = r.media AND y.delta = r.delta AND y.run = r.run) GROUP BY media, delta, run HAVING count(*) >= 3 AND count(*) <= delta AND count(DISTINCT h) >= greatest(3, count(*) // 4)),
p AS (SELECT o.*, size, round_even(delta / 3.0, 0) AS g FROM o JOIN z USING (media)), d AS (SELECT media, g, median(delta) AS d, sum(n) AS total FROM p GROUP BY media, g)
SELECT p.media, delta, source, repeat, n, size >= 2.5 * d AND total >= 0.25 * greatest(1, size - d) AS periodic FROM p JOIN d USING (media, g)""")
def loop_scan(spark, sf):
    f = frames(spark, sf).withColumn("h", F.call_function("shiftleft", F.lit(1).cast("long"), (F.floor(F.col("value") / 40) % 12).cast("int")))
    return joins.loop_scan(f, K, ["h"], least=3, tolerance=1)


_LOOPS_SQL = SQL["loop_scan"].replace("SELECT p.media, delta, source, repeat, n, size >=", ", loops AS (SELECT p.media, delta, source, repeat, n, size, size >=") + ")"


@query(_LOOPS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, picks AS (
    SELECT media, arg_min({'delta': delta, 'repeat': repeat}, (-n, delta, repeat)) AS one, [arg_min({'delta': delta, 'repeat': repeat}, (-n, delta, repeat))] AS kept FROM loops WHERE NOT periodic GROUP BY media
    UNION ALL SELECT k.media, arg_min({'delta': c.delta, 'repeat': c.repeat}, (-c.n, c.delta, c.repeat)) AS one, list_append(any_value(kept), arg_min({'delta': c.delta, 'repeat': c.repeat}, (-c.n, c.delta, c.repeat))) AS kept
        FROM picks k JOIN loops c ON c.media = k.media AND NOT c.periodic WHERE len(kept) < 20 AND len(list_filter(kept, lambda u: abs(c.repeat - u.repeat) < 3 AND abs(c.delta - u.delta) < 3)) = 0 GROUP BY k.media, len(kept))
SELECT loops.media, loops.delta, source, loops.repeat, n, len(kept)::INT AS rank FROM picks JOIN loops ON loops.media = picks.media AND loops.delta = one.delta AND loops.repeat = one.repeat""")
def loop_ranks(spark, sf):
    return joins.ranked_loops(loop_scan(spark, sf), K, least=3)


@query(_LOOPS_SQL + """, g AS (SELECT media, floor(median(delta))::BIGINT AS period, count(*) AS stretches, sum(n) AS total, any_value(size) AS size FROM loops WHERE periodic GROUP BY media, round_even(delta / 3.0, 0))
SELECT media, period, stretches, round(100 * total / greatest(1, size - period), 1) AS coverage_pct, round(size / period, 1) AS cycles FROM g QUALIFY row_number() OVER (PARTITION BY media ORDER BY round(100 * total / greatest(1, size - period), 1) DESC, period) <= 6""")
def loop_periods(spark, sf):
    return joins.periods(loop_scan(spark, sf), frames(spark, sf), K, least=3)


# ---- colour of reshaped signals, scales


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, least(l_quantity / 50, 1) AS i, l_discount * 5 AS t, l_tax * 8 AS u FROM lineitem),
x AS (SELECT *, least(greatest(i, 0.0625), 0.9375) AS x FROM l), c AS (SELECT *, CASE WHEN x < 0.5 THEN 0.1283791 + 0.5119373 * x + 0.2390761 * x * x ELSE 0.2467109 + 0.5038717 * i + 0.1261397 * t - 0.2517913 * u + 0.0619373 * i * t + 0.0313987 * i * u - 0.0157219 * t * u + 0.4967231 * i * t * u END AS y FROM x)
SELECT k, n, p, s, round(least(greatest(y, 0.0625), 0.9375), 6) AS i FROM c""")
def reshaped_signal(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.least(F.col("l_quantity") / 50, F.lit(1.0)).alias("i"), (F.col("l_discount") * 5).alias("t"), (F.col("l_tax") * 8).alias("u"))
    piece = lambda low, high, kind, *c: F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(kind).alias("kind"), F.array(*(F.lit(v) for v in c)).alias("coefficients"))
    pieces = F.array(piece(0.0625, 0.5, "polynomial", 0.1283791, 0.5119373, 0.2390761), piece(0.5, 0.9375, "mmr", 0.2467109, 0.5038717, 0.1261397, -0.2517913, 0.0619373, 0.0313987, -0.0157219, 0.4967231))
    return line.select("k", "n", "p", "s", r6(colour.reshaped([F.col(c) for c in "itu"], 0, pieces)).alias("i"))


_PQ = "pow(greatest(pow(least(greatest({0}, 0), 1), 1 / 78.84375) - 0.8359375, 0) / greatest(18.8515625 - 18.6875 * pow(least(greatest({0}, 0), 1), 1 / 78.84375), 1e-7), 1 / 0.1593017578125)"


@query(f"""WITH e AS (SELECT event_id, least(value / 500, 1) AS i, 0.5 + value / 5000 AS p, 0.5 - value / 8000 AS t FROM events), n AS (SELECT event_id, {", ".join(f"{_PQ.format(f'(i + {a} * (p - 0.5) + {b} * (t - 0.5))')} AS {c}" for c, a, b in (("l", 0.0975, 0.2052), ("m", -0.1139, 0.1332), ("s", 0.0326, -0.6769)))} FROM e)
SELECT event_id, {", ".join(f"round(greatest({a} * l + {b} * m + {c} * s, 0), 6) AS {n}" for n, (a, b, c) in zip("rgb", colour.LMS_TO_2020, strict=True))} FROM n""")
def ipt_light(spark, sf):
    v = F.col("value")
    array = lambda *x: F.array(*(F.lit(float(c)) for c in x))
    rgb = colour.ipt_linear([F.least(v / 500, F.lit(1.0)), 0.5 + v / 5000, 0.5 - v / 8000], array(1, 0.0975, 0.2052, 1, -0.1139, 0.1332, 1, 0.0326, -0.6769), array(0, 0.5, 0.5), array(1, 0, 0, 0, 1, 0, 0, 0, 1))
    return table(spark, sf, "events").select("event_id", rgb.alias("c")).select("event_id", *(r6(f"c.{n}").alias(n) for n in "rgb"))


_RED = " ".join(f"{v:+.17g} * {n}" for v, n in zip(np.linalg.inv(np.array(colour.XYZ["709"]))[0], "XYZ", strict=True))
_TO_709 = """t AS (SELECT event_id, value, least(value / 500, 1) AS r, least(value / 250, 1) AS g, 0.25 AS b FROM events)"""


@query(f"""WITH {_TO_709}, z AS (SELECT *, 0.6369580 * r + 0.1446169 * g + 0.1688810 * b AS X, 0.2627002 * r + 0.6779981 * g + 0.0593017 * b AS Y, 0.0280727 * g + 1.0609851 * b AS Z FROM t)
SELECT event_id, round({_RED}, 4) AS red, CASE WHEN value < 16 THEN 40 + floor(floor(value) * -10 / 16.0)::INT WHEN value < 45 THEN 30 + floor((floor(value) - 16) * 10 / 29.0)::INT END::INT AS false_red,
    floor(least(greatest(value / 500 / 0.8, 0), 1) * 255)::INT AS px, floor(255 - least(greatest(value / 500 / 0.9, 0), 1) * 255)::INT AS py FROM z""")
def colour_scales(spark, sf):
    v = F.col("value")
    t = colour.to_709(F.least(v / 500, F.lit(1.0)), F.least(v / 250, F.lit(1.0)), F.lit(0.25), "2020")
    place = colour.chart_place(v / 500, v / 500, 256)
    return table(spark, sf, "events").select("event_id", F.round(t["r"], 4).alias("red"), F.when(v < 45, colour.false_colour(v)["r"]).alias("false_red"), place["px"].alias("px"), place["py"].alias("py"))


@query("""WITH o AS (SELECT o_orderkey AS media, o_custkey % 4096 AS q FROM orders), s AS (SELECT media, unnest([q, q // 2, 0]) AS q, unnest([0, 1, 2]) AS k FROM o), l AS (SELECT media, k, pow(q / 4095.0::DOUBLE, 1 / 78.84375) AS p FROM s),
n AS (SELECT media, k, round_even(pow(greatest(p - 0.8359375, 0) / greatest(18.8515625 - 18.6875 * p, 1e-6), 1 / 0.1593017578125) * 10000, 0)::BIGINT AS n FROM l)
SELECT media, 0 AS frame, max(n) FILTER (k = 0) AS max_nits, max(n) FILTER (k = 1) AS avg_nits, max(n) FILTER (k = 2) AS min_nits FROM n GROUP BY media""")
def frame_levels(spark, sf):
    q = F.col("o_custkey") % 4096
    block = F.concat(F.lit('{"level": 1, "min_pq": 0, "max_pq": '), q.cast("string"), F.lit(', "avg_pq": '), F.floor(q / 2).cast("string"), F.lit("}"))
    body = F.concat(F.lit('[{"vdr_dm_data": {"min_pq": 7, "ext_metadata_blocks": [{"level": 5}, '), block, F.lit("]}}]"))
    return dynamic.level_rows(table(spark, sf, "orders").select(F.col("o_orderkey").alias("media"), body.alias("body")), K)


@query("""SELECT l_orderkey AS media, l_linenumber::INT AS frame, l_quantity AS avg_maxrgb, greatest(l_quantity, l_tax * 100) AS maxscl, 400::INT AS target_nits FROM lineitem""")
def scene_levels(spark, sf):
    scene = F.struct(F.col("l_linenumber").alias("SceneFrameIndex"), F.lit(400).alias("TargetedSystemDisplayMaximumLuminance"), F.struct(F.col("l_quantity").alias("AverageRGB"), F.array("l_quantity", F.col("l_tax") * 100).alias("MaxScl")).alias("LuminanceParameters"))
    docs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("media")).agg(F.to_json(F.struct(F.collect_list(scene).alias("SceneInfo"))).alias("body"))
    return dynamic.scene_levels(docs, K)


# ---- roll-ups of scans


def _analog(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = F.when(F.col("value") > 150, F.array(F.lit(3), F.lit(9))).otherwise(F.array().cast("array<int>"))
    f = frames(spark, sf).select("media", "frame", rows.alias("dropouts"), (F.col("value") / 10).alias("head"), (F.col("value") / 60).alias("jitter"))
    return reports.analog(f, K, 25.0)


@query(f"""WITH {FRAMES} SELECT media, count(*) AS frames, round(100 * avg((value > 150)::INT), 2) AS dropout_pct, round(100 * avg((value / 10 > 2.6)::INT), 1) AS head_switch_pct, round(100 * avg((value / 60 > 0.55)::INT), 1) AS jitter_pct FROM f GROUP BY media""")
def analog_summary(spark, sf):
    return _analog(spark, sf)[0]


@query(f"""WITH {FRAMES}, w AS (SELECT *, row_number() OVER (PARTITION BY media ORDER BY frame) AS n FROM f WHERE value / 60 > 0.55), s AS (SELECT media, avg((value / 10 > 2.6)::INT) AS h, avg((value / 60 > 0.55)::INT) AS j FROM f GROUP BY media)
SELECT media, frame / 25.0::DOUBLE AS t, 'dropout' AS kind, 'warn' AS severity FROM f WHERE value > 150 UNION ALL SELECT media, frame / 25.0::DOUBLE, 'jitter', 'info' FROM w WHERE n IN (1, 5) OR n % 60 = 0
UNION ALL SELECT media, 0, 'head_switch', 'warn' FROM s WHERE h > 0.5 UNION ALL SELECT media, 0, 'jitter', 'warn' FROM s WHERE j > 0.25""")
def analog_events(spark, sf):
    return _analog(spark, sf)[1].drop("text")


_HIDDEN = """s AS (SELECT s_suppkey AS k FROM supplier), f AS (SELECT k AS media, unnest([CASE WHEN k % 3 = 0 THEN ['warn', 'appended_data'] END, CASE WHEN k % 4 = 0 AND k % 5 > 1 THEN ['warn', 'lsb'] END, CASE WHEN k % 4 = 1 AND k * 500 > 2048 THEN ['warn', 'sei_userdata'] END, CASE WHEN k % 7 = 0 THEN ['info', 'size_anomaly'] END]) AS f FROM s)"""


def _hidden(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    records = s.select(k.alias("media"), pick(k, ["FFV1", "h264", "png", "vp9"]).alias("codec"), F.when(k % 4 == 2, 10).otherwise(8).alias("bit_depth"))
    channels = s.select(k.alias("media"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).withColumn("suspicious", F.col("i") < F.col("media") % 5)
    tallies = s.select(k.alias("media"), (k * 500).alias("user_bytes"))
    container = s.filter(k % 3 == 0).select(k.alias("media"), F.lit("warn").alias("severity"), F.lit("appended_data").alias("kind"), F.lit(9).cast("long").alias("offset"), F.lit(1).cast("long").alias("size"))
    return reports.hidden_data_scan(records, channels, tallies, s.filter(k % 7 == 0).select(k.alias("media")), container, K)


@query(f"WITH {_HIDDEN} SELECT media, f[1] AS severity, f[2] AS kind FROM f WHERE f IS NOT NULL")
def hidden_data_scan(spark, sf):
    return _hidden(spark, sf).select("media", "severity", "kind")


@query(f"WITH {_HIDDEN} SELECT media, 0.0::DOUBLE AS t, CASE WHEN bool_or(f[2] = 'appended_data') THEN 'appended_data' ELSE 'sei_userdata' END AS label FROM f WHERE f[2] IN ('appended_data', 'sei_userdata') GROUP BY media")
def hidden_data_marks(spark, sf):
    return reports.hidden_data_marks(_hidden(spark, sf), K)


@query(f"{_CHECKS_SQL} SELECT media, s.check_id AS check_id, media % 2 = 0 AND s.check_id IN ('splices', 'recompress', 'noise') AS weakened FROM k WHERE s.profile = 'integrity'")
def weakened_checks(spark, sf):
    checks = qc.evaluate(_context(spark, sf), K, "integrity").select("media", "check_id")
    return reports.weakened(checks, frames(spark, sf).select("media", (F.col("media") % 2 == 0).alias("reencoded")).distinct(), K)


@query("""WITH c AS (SELECT l_suppkey AS media, floor(l_quantity / 2) AS pair, sum(1 - l_quantity::BIGINT % 2) AS even, sum(l_quantity::BIGINT % 2) AS odd FROM lineitem GROUP BY ALL),
q AS (SELECT media, count(*) AS pairs, sum((even - (even + odd) / 2) * (even - (even + odd) / 2) / ((even + odd) / 2)) AS chi2 FROM c GROUP BY media), g AS (SELECT *, (pairs - 1) / 2.0::DOUBLE AS a, chi2 / 2 AS x FROM q),
s AS (SELECT *, coalesce(list_sum([exp((a - i) * ln(x) - x - lgamma(a - i + 1)) FOR i IN range(1, 200) IF a - i > 0]), 0) AS parts, 1 - 2 / sqrt(pi()) * list_sum([exp(2 * i * ln(2.0) + (2 * i + 1) * ln(sqrt(x)) + lgamma(i + 1) - lgamma(2 * i + 2) - x) FOR i IN range(0, 400)]) AS tail FROM g)
SELECT media, pairs, round(chi2, 6) AS chi2, round(CASE WHEN a <= 0 THEN 0 WHEN x <= 0 THEN 1 WHEN a % 1 = 0 THEN parts + exp(-x) ELSE parts + tail END, 8) AS p FROM s""")
def lsb_probability(spark, sf):
    values = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("media"), F.col("l_quantity").cast("long").alias("v"))
    return aggregates.with_probability(aggregates.lsb_pairs(values, K, "v")).withColumn("p", F.round("p", 8)).withColumn("chi2", r6("chi2"))


def _cut_sql(depth: int) -> str:
    """The levels of a change-point search, each a table s<k> (media, segment, x, y)."""
    sums = {"n": "1", "x": "x", "y": "y", "xx": "x * x", "xy": "x * y", "yy": "y * y"}
    fit = lambda n, x, y, xx, xy, yy: f"greatest(CASE WHEN {xx} - {x} * {x} / {n} > 0 THEN {yy} - {y} * {y} / {n} - ({xy} - {x} * {y} / {n}) * ({xy} - {x} * {y} / {n}) / ({xx} - {x} * {x} / {n}) ELSE {yy} - {y} * {y} / {n} END, 0)"
    out = [f"{FRAMES}, s0 AS (SELECT media, 1 AS segment, frame::DOUBLE AS x, t AS y FROM f)"]
    for k in range(depth):
        out.append(f"a{k} AS (SELECT *, row_number() OVER r - 1 AS k, {', '.join(f'sum({v}) OVER w AS all_{n}, sum({v}) OVER b AS run_{n}' for n, v in sums.items())} FROM s{k} WINDOW w AS (PARTITION BY media, segment), r AS (PARTITION BY media, segment ORDER BY x), b AS (PARTITION BY media, segment ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
        before, after, one = (fit(*of) for of in ([f"run_{n}" for n in sums], [f"(all_{n} - run_{n})" for n in sums], [f"all_{n}" for n in sums]))
        out.append(f"c{k} AS (SELECT *, greatest(8, floor(all_n / 40)) AS side, {one} AS one, CASE WHEN k > 0 THEN {before} + {after} END AS two FROM a{k})")
        out.append(f"m{k} AS (SELECT media, segment, min(two) AS two, arg_min(k, (two, k)) AS at FROM c{k} WHERE all_n >= 24 AND k >= side AND all_n - k >= side AND k % side = 0 GROUP BY media, segment)")
        out.append(f"s{k + 1} AS (SELECT c.media, c.segment * 2 + CASE WHEN m.two <= one / 4 AND c.k >= m.at THEN 1 ELSE 0 END AS segment, x, y FROM c{k} c LEFT JOIN m{k} m ON m.media = c.media AND m.segment = c.segment)")
    return ", ".join(out)


@query(f"WITH {_cut_sql(3)} SELECT media, row_number() OVER (PARTITION BY media ORDER BY min(x)) AS segment, count(*) AS n, min(x) AS x0, max(x) AS x1, round(regr_slope(y, x), 4) AS slope FROM s3 GROUP BY media, segment")
def changepoint_split(spark, sf):
    out = series.cut_points(frames(spark, sf).withColumn("x", F.col("frame").cast("double")), K, "x", "t")
    return out.withColumn("slope", F.round("slope", 4)).withColumn("segment", F.col("segment").cast("long"))


# ---- spectra: a vector as a block of 64 samples


def _pcm(spark: SparkSession, sf: str) -> DataFrame:
    """PCM blocks of one recording for each label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf, "embeddings").select(F.col("label").alias("media"), (F.row_number().over(w) - 1).alias("block"), F.lit(64).alias("sr"), F.col("embedding").alias("samples"))


_SAMPLES = """b AS (SELECT label AS media, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS block, embedding FROM embeddings),
s AS (SELECT media, block, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM b), h AS (SELECT media, block, i, x, 0.5 - 0.5 * cos(2 * pi() * i / 63) AS w, x - avg(x) OVER (PARTITION BY media, block) AS c FROM s)"""
_SPECTRUM = f"""{_SAMPLES}, m AS (SELECT media, block, k, sqrt(pow(sum(x * w * cos(2 * pi() * k * i / 64)), 2) + pow(sum(x * w * sin(2 * pi() * k * i / 64)), 2)) AS m FROM h, range(33) t(k) GROUP BY media, block, k)"""


@query(f"""WITH {_SPECTRUM}, l AS (SELECT media, block, round(20 * log10(sqrt(sum(x * x) / 64) + 1e-9), 6) AS rms_db FROM s GROUP BY media, block),
d AS (SELECT *, m - lag(m) OVER (PARTITION BY media, k ORDER BY block) AS d, sum(m * m) OVER (PARTITION BY media, block ORDER BY k) AS run, sum(m * m) OVER (PARTITION BY media, block) AS total FROM m)
SELECT media, block, any_value(rms_db) AS rms_db, round(sum(greatest(d, 0)) FILTER (d IS NOT NULL), 6) AS flux, round(count(*) FILTER (run < 0.95 * total) / 33.0::DOUBLE, 6) AS rolloff, round(20 * log10(list_sort(list(m))[4] + 1e-9), 6) AS floor FROM d JOIN l USING (media, block) GROUP BY media, block""")
def spectral_flux(spark, sf):
    return signals.block_features(_pcm(spark, sf), K).select("media", F.col("block").cast("long").alias("block"), *(r6(c).alias(c) for c in ("rms_db", "flux", "rolloff", "floor")))


@query(f"""WITH {_SPECTRUM}, l AS (SELECT media, k, avg(m) AS level FROM m GROUP BY media, k), d AS (SELECT media, k * 689.0::DOUBLE AS hz, 20 * log10(sum(level) OVER (PARTITION BY media ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 + 1e-12) AS db FROM l),
t AS (SELECT *, max(db) FILTER (hz BETWEEN 200 AND 4000) OVER (PARTITION BY media) AS top FROM d), c AS (SELECT media, max(hz) FILTER (db > top - 12) AS cutoff_hz, max(hz) AS nyquist_hz FROM t GROUP BY media)
SELECT *, CASE WHEN cutoff_hz / nyquist_hz < 0.70 THEN 'suspicious' WHEN cutoff_hz / nyquist_hz < 0.85 THEN 'mild' ELSE 'full' END AS bandwidth FROM c""")
def audio_bandwidth(spark, sf):
    return signals.bandwidth_verdict(signals.cutoff(signals.mean_spectrum(_pcm(spark, sf), K), K, 689.0, below_db=12.0))


_HUM = f"""{_SAMPLES}, m AS (SELECT media, block, k, k * 0.25 AS hz, sqrt(pow(sum(c * w * cos(2 * pi() * k * i / 256)), 2) + pow(sum(c * w * sin(2 * pi() * k * i / 256)), 2)) + 1e-12 AS m FROM h, range(129) t(k) GROUP BY media, block, k),
p AS (SELECT media, block, arg_max(k, m) FILTER (hz BETWEEN 8 AND 24) AS top FROM m GROUP BY media, block),
z AS (SELECT m.media, m.block, any_value(top) AS top, ln(max(m) FILTER (k = top - 1)) AS a, ln(max(m) FILTER (k = top)) AS b, ln(max(m) FILTER (k = top + 1)) AS c, 20 * log10(max(m) FILTER (k = top) / median(m) FILTER (hz BETWEEN 0 AND 32 AND abs(hz - top * 0.25) > 0.6)) AS snr FROM m JOIN p ON p.media = m.media AND p.block = m.block GROUP BY m.media, m.block),
tr AS (SELECT media, block, (top + CASE WHEN a - 2 * b + c = 0 THEN 0 ELSE 0.5 * (a - c) / (a - 2 * b + c) END) * 0.25 AS hz, snr AS snr_db FROM z)"""


@query(f"WITH {_HUM} SELECT media, block, round(hz, 6) AS hz, round(snr_db, 6) AS snr_db FROM tr")
def enf_track(spark, sf):
    return signals.hum(_pcm(spark, sf), K, 8.0, 24.0).select("media", F.col("block").cast("long").alias("block"), r6("hz").alias("hz"), r6("snr_db").alias("snr_db"))


@query(f"""WITH {_HUM}, l AS (SELECT *, lag(hz) OVER w AS h0, lag(snr_db) OVER w AS s0 FROM tr WINDOW w AS (PARTITION BY media ORDER BY block))
SELECT media, median(snr_db) >= 10 AND avg((snr_db >= 6)::INT) >= 0.7 AS present, count(*) FILTER (snr_db >= 6 AND s0 >= 6 AND abs(hz - h0) > 0.08) AS jumps, count(*) FILTER (snr_db < 6) AS gaps FROM l GROUP BY media""")
def hum_gaps(spark, sf):
    return signals.hum_verdict(signals.hum(_pcm(spark, sf), K, 8.0, 24.0), K)


# ---- more containers, texts and pictures


@query("""WITH e AS (SELECT s_suppkey AS media, s_suppkey % 100 AS n FROM supplier) SELECT media, unnest([{'depth': 0::INT, 'type': '1A45DFA3', 'offset': 0, 'size': 9}, {'depth': 0, 'type': '18538067', 'offset': 9, 'size': 30 + n}, {'depth': 1, 'type': 'EC', 'offset': 21, 'size': 9 + n}, {'depth': 1, 'type': '1654AE6B', 'offset': 30 + n, 'size': 9}], recursive := true) FROM e""")
def mkv_elements(spark, sf):
    n = F.col("s_suppkey") % 100
    element = lambda name, length, body: F.concat(F.lit(bytes.fromhex(name)), length, body)
    void = element("EC", F.concat(F.lit(b"\x01"), _be(n, 7)), _zeros(n.cast("int")))
    tracks = element("1654AE6B", F.lit(b"\x84"), F.lit(b"abcd"))
    segment = element("18538067", F.concat(F.lit(b"\x01"), _be(n + 18, 7)), F.concat(void, tracks))
    files = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("media"), F.concat(element("1A45DFA3", F.lit(b"\x84"), F.lit(b"webm")), segment).alias("content"))
    return containers.mkv_elements(files, K).drop("head")


@query("""SELECT s_suppkey AS media, CASE WHEN s_suppkey % 3 > 0 THEN substr('x264 - core ' || s_suppkey || ' crf=' || repeat('9', s_suppkey * 20), 1, 911) END AS settings, CASE WHEN s_suppkey % 3 > 0 THEN 'x264' ELSE '' END || CASE WHEN s_suppkey % 2 = 0 THEN CASE WHEN s_suppkey % 3 > 0 THEN ',' ELSE '' END || 'ffmpeg-mux (Lavf)' ELSE '' END || CASE WHEN s_suppkey % 7 = 0 THEN CASE WHEN s_suppkey % 3 > 0 OR s_suppkey % 2 = 0 THEN ',' ELSE '' END || 'DJI' ELSE '' END AS encoders, CASE WHEN s_suppkey % 5 = 0 THEN 'C2PA,JUMBF' ELSE '' END AS marks FROM supplier""")
def encoder_marks(spark, sf):
    k = F.col("s_suppkey")
    settings = F.when(k % 3 > 0, F.concat(F.lit("x264 - core "), k.cast("string"), F.lit(" crf="), F.repeat(F.lit("9"), (k * 20).cast("int")), F.lit("\0\0"))).otherwise("")
    body = F.concat(F.lit(b"\0\xff\1"), settings.cast("binary"), F.when(k % 2 == 0, F.lit(b"Lavf60.1")).otherwise(F.lit(b"")), F.when(k % 7 == 0, F.lit(b"DJI Air")).otherwise(F.lit(b"")), _zeros(5000), F.when(k % 5 == 0, F.lit(b"jumb....c2pa")).otherwise(F.lit(b"")))
    # files grow with their number, and a small table of them is one partition
    rows = table(spark, sf, "supplier").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")
    files = rows.select(k.alias("media"), body.alias("content"), containers.settings_of(containers.latin1(body)).alias("settings"))
    named = lambda df, marks: containers.marker_scan(df, "content", marks)
    out = named(files, containers.ENCODERS).withColumnRenamed("found", "encoders")
    return named(out, containers.CREDENTIALS).select("media", F.substring("settings", 1, 911).alias("settings"), F.array_join("encoders", ",").alias("encoders"), F.array_join("found", ",").alias("marks"))


@query(f"""WITH {_CELLS}, n AS (SELECT media, max(frame) + 1 AS n FROM c GROUP BY media), p AS (SELECT DISTINCT media, floor(n * (i + 1.0::DOUBLE) / 6)::BIGINT AS frame FROM n, range(5) t(i)),
s AS (SELECT a.media, a.frame, a.x % 4 = 0 AS edge, avg(abs(a.v - b.v)) AS s FROM c a JOIN c b ON a.media = b.media AND a.frame = b.frame AND a.y = b.y AND a.x = b.x + 1 GROUP BY ALL
    UNION ALL SELECT a.media, a.frame, a.y % 4 = 0, avg(abs(a.v - b.v)) FROM c a JOIN c b ON a.media = b.media AND a.frame = b.frame AND a.x = b.x AND a.y = b.y + 1 GROUP BY ALL),
k AS (SELECT s.media, s.frame, sum(s) FILTER (edge) / sum(s) FILTER (NOT edge) - 1 AS b FROM s JOIN p ON p.media = s.media AND p.frame = s.frame GROUP BY s.media, s.frame) SELECT media, count(*) AS frames, round(avg(b), 6) AS blockiness FROM k GROUP BY media""")
def recompression_rollup(spark, sf):
    chosen = images.evenly_sampled(_pictures(spark, sf), K, 5)
    of = images.measured(partial(images._blockiness, size=4))
    return chosen.withColumn("b", of()).groupBy("media").agg(F.count("b").alias("frames"), r6(F.avg("b")).alias("blockiness"))


@query(f"WITH {FRAMES}, c AS (SELECT media, count(*) AS n FROM f GROUP BY media), s AS (SELECT media, count(*) AS cuts FROM (SELECT media, t, lag(t) OVER (PARTITION BY media ORDER BY frame) AS p FROM f WHERE value > 100) WHERE p IS DISTINCT FROM t GROUP BY media) SELECT c.media, n, coalesce(cuts, 0) AS cuts FROM c LEFT JOIN s USING (media)")
def combined_analysis(spark, sf):
    f = frames(spark, sf).withColumn("scene", F.col("value") / 250).withColumn("black_ratio", 1 - F.col("value") / 500).withColumn("ydif", F.col("value") / 9)
    parts = reports.analysis(f, K, ["value"], 1.0, 0.4)
    cuts = parts["cuts"].groupBy("media").agg(F.count(F.lit(1)).alias("cuts"))
    return f.groupBy("media").agg(F.count(F.lit(1)).alias("n")).join(parts["summary"].select("media"), K).join(cuts, K, "left").select("media", "n", F.coalesce("cuts", F.lit(0)).alias("cuts"))


# ---- marks in pictures


def _written(rows: DataFrame, text: Column) -> DataFrame:
    """rows with the picture of a number: each digit is five columns of eight pixels of its own, with two columns between."""
    ink = lambda d, r, c: r == 7 or c == 0 or (d * 37 + 11) >> (r * 4 + c) % 13 & 1
    digits = F.split(text, "")
    lines = []
    for r in range(8):
        shapes = F.create_map(*(F.lit(x) for d in range(10) for x in (str(d), "".join("FA" if ink(d, r, c) else "0A" for c in range(5)) + "0A0A")))
        lines.append(F.concat(F.lit("0A0A"), F.array_join(F.transform(digits, shapes.getItem), "")))
    return rows.select("*", text.alias("text"), F.lit(8).alias("h"), (F.length(text) * 7 + 2).alias("w"), F.lit(1).alias("c"), F.unhex(F.concat(*lines)).alias("pixels"))


@query("""SELECT c_custkey AS media, (c_custkey * 7919 % 1000000)::VARCHAR AS text, 0.0::DOUBLE AS distance, length((c_custkey * 7919 % 1000000)::VARCHAR) AS marks FROM customer""")
def glyph_texts(spark, sf):
    number = (F.col("media") * 7919 % 1000000).cast("string")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("media"))
    # the first customers' numbers have every digit
    bank = glyphs.templates(_written(c.filter("media <= 20"), number))
    read = _written(c, number).drop("text")
    counted = read.select("media", F.size(images.glyphs()).cast("long").alias("marks"))
    return glyphs.texts(read, K, bank).withColumn("distance", r6("distance")).join(counted, K)


@query(f"""WITH {_CELLS}, n AS (SELECT a.media, a.frame, a.y, a.x, any_value(a.v) AS v, median(b.v) AS m FROM c a, range(9) t(k), c b WHERE b.media = a.media AND b.frame = a.frame AND b.y = least(greatest(a.y + k // 3 - 1, 0), 7) AND b.x = least(greatest(a.x + k % 3 - 1, 0), 7) GROUP BY a.media, a.frame, a.y, a.x)
SELECT media, frame, round(1.4826 * median(abs(v - m)), 6) AS noise FROM n GROUP BY media, frame""")
def picture_noise(spark, sf):
    return _pictures(spark, sf).select("media", "frame", r6(images.noise_floor()).alias("noise"))


def _box_sql(k: int, values: dict[str, str]) -> str:
    """For each pixel of pairs p the means of some values over k by k pixels, edges mirrored."""
    at = lambda c: f"7 - abs(7 - abs(p.{c} + o.{c} - {k // 2}))"
    means = ", ".join(f"avg({v}) AS {n}" for n, v in values.items())
    return f"SELECT p.media, p.frame, p.x, p.y, any_value(p.a) AS a, any_value(p.b) AS b, {means} FROM p, (SELECT i % {k} AS x, i // {k} AS y FROM range({k * k}) t(i)) o, p q WHERE q.media = p.media AND q.frame = p.frame AND q.x = {at('x')} AND q.y = {at('y')} GROUP BY p.media, p.frame, p.x, p.y"


@query(f"""WITH {_CELLS}, p AS (SELECT b.media, b.frame, b.x, b.y, a.v::DOUBLE AS a, b.v::DOUBLE AS b FROM c a JOIN c b ON a.media = b.media AND a.frame + 1 = b.frame AND a.x = b.x AND a.y = b.y),
f AS ({_box_sql(5, {"m": "q.a", "mm": "q.a * q.a"})}), v AS (SELECT media, frame, 100 * avg((abs(a - b) / ((1 + 0.6 * sqrt(greatest(mm - m * m, 0))) * (1 + 0.04 * abs(a - 128))) > 1)::INT) AS visible FROM f GROUP BY media, frame),
g AS ({_box_sql(7, {"ma": "q.a", "mb": "q.b", "aa": "q.a * q.a", "bb": "q.b * q.b", "ab": "q.a * q.b"})}),
s AS (SELECT media, frame, avg((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (aa - ma * ma + bb - mb * mb + 58.5225))) AS ssim FROM g GROUP BY media, frame)
SELECT media, frame, round(ssim, 6) AS ssim, round(visible, 6) AS visible_pct, CASE WHEN visible < 0.5 THEN 'lossless' WHEN visible < 2 THEN 'near lossless' ELSE 'visible' END AS verdict FROM v JOIN s USING (media, frame)""")
def picture_visibility(spark, sf):
    p = _pictures(spark, sf)
    pairs = p.withColumnRenamed("pixels", "b").join(p.select("media", (F.col("frame") + 1).alias("frame"), F.col("pixels").alias("a")), ["media", "frame"])
    return images.visually_lossless(images.pair_measures(pairs)).select("media", "frame", r6("ssim").alias("ssim"), r6("visible_pct").alias("visible_pct"), "verdict")


@query(f"""WITH RECURSIVE {FRAMES}, m AS (SELECT *, sum(value) OVER (PARTITION BY media ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) / 31 AS m FROM f), d AS (SELECT *, sum(abs(value - m)) OVER (PARTITION BY media ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) / 31 AS d FROM m),
c AS (SELECT media, frame * 0.1::DOUBLE AS t, (value - m) / (d + 1e-9) AS score FROM d WHERE (value - m) / (d + 1e-9) >= 1.5),
p AS (SELECT media, arg_min(t, (-score, t)) AS t, [arg_min(t, (-score, t))] AS kept FROM c GROUP BY media
    UNION ALL SELECT p.media, arg_min(c.t, (-score, c.t)) AS t, list_append(any_value(kept), arg_min(c.t, (-score, c.t))) AS kept FROM p JOIN c ON c.media = p.media WHERE len(kept) < 12 AND len(list_filter(kept, lambda u: abs(c.t - u) < 0.35)) = 0 GROUP BY p.media, p.t)
SELECT c.media, round(c.t, 4) AS t, round(score, 6) AS score FROM p JOIN c ON c.media = p.media AND c.t = p.t""")
def music_cuts(spark, sf):
    features = frames(spark, sf).select("media", F.col("frame").alias("block"), F.col("value").alias("flux"))
    return signals.music_cuts(features, K, 0.1, least=1.5).select("media", F.round("t", 4).alias("t"), r6("score").alias("score"))


@query(f"""WITH RECURSIVE {FRAMES}, l AS (SELECT media, frame * 0.1::DOUBLE AS t, value, abs(value / 3 - lag(value / 3) OVER (PARTITION BY media ORDER BY frame)) AS step, median(value) OVER (PARTITION BY media) AS med FROM f), d AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY media) AS mad FROM l),
c AS (SELECT media, t FROM d WHERE (value - med) / (1.4826 * (mad + 1e-9)) > 4 OR step > 30), p AS (SELECT media, min(t) AS t FROM c GROUP BY media UNION ALL SELECT p.media, min(c.t) AS t FROM p JOIN c ON c.media = p.media AND c.t - p.t > 0.3 GROUP BY p.media, p.t) SELECT media, round(t, 4) AS t FROM p""")
def audio_jumps(spark, sf):
    features = frames(spark, sf).select("media", F.col("frame").alias("block"), F.col("value").alias("flux"), (F.col("value") / 3).alias("rms_db"))
    return signals.audio_jumps(features, K, 0.1, z=4.0, step_db=30.0).withColumn("t", F.round("t", 4))


# ---- packs and rules


def result_packs() -> list[packs.Pack]:
    """Ten measurements of frames and packets, two of which need others."""
    of = lambda name, source, *columns, **more: packs.Pack(name, (source,), lambda df: df.groupBy("media").agg(*(c.alias(n) for n, c in columns)), **more)
    step = Window.partitionBy("media").orderBy("frame")
    change = F.abs(F.col("value") - F.lag("value").over(step))
    return [
        packs.Pack("changes", ("frames",), lambda f: f.withColumn("change", change), shown=False),
        of("length", "frames", ("n_frames", F.count(F.lit(1))), ("last_t", F.max("t")), always=True),
        of("light", "frames", ("brightest", F.max("value")), ("darkest", F.min("value"))),
        of("black", "frames", ("n_black", F.count_if(F.col("value") < 16))),
        of("still", "changes", ("n_still", F.count_if(F.col("change") < 1))),
        of("flash", "changes", ("n_flash", F.count_if(F.col("change") >= 40))),
        of("sizes", "packets", ("n_packets", F.count(F.lit(1))), ("largest", F.max("size"))),
        of("key frames", "packets", ("n_key", F.sum("key"))),
        of("busy", "packets", ("most_complex", F.max("complexity"))),
        packs.Pack("rate", ("length", "sizes"), lambda a, b: a.join(b, "media").select("media", (F.col("n_packets") / F.col("n_frames")).alias("packets_a_frame"))),
        packs.Pack("broken", ("frames",), lambda f: f.select("media", F.col("no_such_column"))),
        packs.Pack("behind", ("broken",), lambda b: b),
    ]


@query(f"""WITH {FRAMES}, {PACKETS}, d AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY media ORDER BY frame)) AS change FROM f),
a AS (SELECT media, count(*) AS n_frames, max(t) AS last_t, max(value) AS brightest, min(value) AS darkest, count(*) FILTER (value < 16) AS n_black, count(*) FILTER (change < 1) AS n_still, count(*) FILTER (change >= 40) AS n_flash FROM d GROUP BY media),
b AS (SELECT media, count(*) AS n_packets, max(size) AS largest, sum(key)::BIGINT AS n_key, max(complexity) AS most_complex FROM p GROUP BY media)
SELECT coalesce(a.media, b.media) AS media, n_frames, round(last_t, 6) AS last_t, brightest, darkest, n_black, n_still, n_flash, n_packets, largest, n_key, most_complex, round(n_packets / n_frames, 6) AS packets_a_frame FROM a FULL JOIN b ON a.media = b.media""")
def analysis_context(spark, sf):
    """Eight results and one of two of them; two packs fail and the others stay."""
    context, _ = packs.analyse(spark, {"frames": frames(spark, sf), "packets": packets(spark, sf)}, result_packs(), K)
    return context.withColumn("last_t", r6("last_t")).withColumn("packets_a_frame", r6("packets_a_frame"))


_EVIDENCE = """SELECT l_suppkey AS media, l_suppkey % 2 = 0 AS reencoded, count(*) FILTER (l_quantity > 48) // 8 AS strong_splices, count(*) FILTER (l_discount > 0.09) // 20 AS noise_outliers, avg(l_tax) * 9 AS double_quant,
    count(*) FILTER (l_linenumber = 7) // 20 AS loops, count(*) FILTER (l_quantity = 1) % 3 AS enf_jumps, count(*) FILTER (l_returnflag = 'R') * 1.0::DOUBLE / count(*) AS tempo_score, count(*) FILTER (l_linestatus = 'F') % 4 AS audio_warnings, count(*) FILTER (l_returnflag = 'N') % 5 AS container_warnings FROM lineitem GROUP BY l_suppkey"""


@query(f"""WITH e AS ({_EVIDENCE}), r AS (SELECT media, reencoded, unnest([
    CASE WHEN reencoded THEN {{'id': 'source', 'verdict': 'note', 'level': 3}} ELSE {{'id': 'source', 'verdict': 'clear', 'level': 2}} END,
    CASE WHEN strong_splices >= 3 THEN {{'id': 'splices', 'verdict': 'review', 'level': 3}} WHEN strong_splices > 0 THEN {{'id': 'splices', 'verdict': 'note', 'level': 2}} ELSE {{'id': 'splices', 'verdict': 'clear', 'level': 2}} END,
    CASE WHEN noise_outliers > 2 THEN {{'id': 'noise', 'verdict': 'review', 'level': 2}} ELSE {{'id': 'noise', 'verdict': 'clear', 'level': 1}} END,
    CASE WHEN double_quant > 0.35 THEN {{'id': 'recompress', 'verdict': 'note', 'level': 2}} END,
    CASE WHEN loops > 0 THEN {{'id': 'loops', 'verdict': 'review', 'level': 3}} END,
    CASE WHEN enf_jumps > 0 THEN {{'id': 'enf', 'verdict': 'review', 'level': 1}} END,
    CASE WHEN tempo_score >= 0.26 THEN {{'id': 'tempo', 'verdict': 'note', 'level': 2}} END,
    CASE WHEN audio_warnings > 0 THEN {{'id': 'audio', 'verdict': 'note', 'level': 2}} END,
    CASE WHEN container_warnings > 0 THEN {{'id': 'container', 'verdict': 'note', 'level': 2}} END]) AS v FROM e)
SELECT media, v.id AS id, v.verdict AS verdict, ['low', 'medium', 'high'][greatest(1, v.level - (reencoded AND v.id IN ('splices', 'recompress', 'noise'))::INT)] AS confidence FROM r WHERE v IS NOT NULL""")
def verdict_layer(spark, sf):
    """The integrity rules, with an owner's own rule for the tempo and another's that was taken back; evidence that a
    platform's encoder wiped out counts less."""
    n = lambda c: F.count_if(c)
    c = F.col
    evidence = table(spark, sf, "lineitem").groupBy(c("l_suppkey").alias("media")).agg(
        F.floor(n(c("l_quantity") > 48) / 8).alias("strong_splices"),
        F.floor(n(c("l_discount") > 0.09) / 20).alias("noise_outliers"),
        # exact, so that a mean that is the limit itself doesn't depend on the order of the rows
        (F.sum(c("l_tax").cast("decimal(20,18)")) * 9 / F.count("l_tax")).cast("double").alias("double_quant"),
        F.floor(n(c("l_linenumber") == 7) / 20).alias("loops"),
        (n(c("l_quantity") == 1) % 3).alias("enf_jumps"),
        (n(c("l_returnflag") == "R") / F.count(F.lit(1))).alias("tempo_score"),
        (n(c("l_linestatus") == "F") % 4).alias("audio_warnings"),
        (n(c("l_returnflag") == "N") % 5).alias("container_warnings"),
    )
    again = evidence.withColumn("reencoded", c("media") % 2 == 0)
    faded = F.when(c("reencoded"), F.array(*map(F.lit, reports.weakened_ids()))).otherwise(F.array().cast("array<string>"))
    rules = verdict_rules.INTEGRITY.add("league", verdict_rules.Rule("tempo", "tempo_score >= 0.26", "note", "medium", "faster than the league allows"))
    rules = rules.add("trial", verdict_rules.Rule("audio", "true", "review", "high", "listen")).retract("trial")
    return verdict_rules.judged(again.withColumn("faded", faded), K, rules, "faded").select("media", "id", "verdict", "confidence")


@query("""WITH p AS (SELECT l_suppkey AS media, floor(least(greatest((0.15 + l_quantity / 100) / 0.8, 0), 1) * 511)::INT AS px, floor(511 - least(greatest((0.05 + l_extendedprice / 150000 + l_discount) / 0.9, 0), 1) * 511)::INT AS py FROM lineitem),
c AS (SELECT media, px, min(py) AS low, max(py) AS high, count(*) AS n FROM p GROUP BY media, px),
s AS (SELECT media, px, high AS v, 1 AS side FROM c UNION ALL SELECT media, px, -low, 2 FROM c),
b AS (SELECT a.media, a.side, a.px, a.v, min((a.v - q.v) / (a.px - q.px)) FILTER (q.px < a.px) AS before, max((q.v - a.v) / (q.px - a.px)) FILTER (q.px > a.px) AS after FROM s a JOIN s q ON q.media = a.media AND q.side = a.side GROUP BY ALL),
e AS (SELECT *, lead(px) OVER w AS px2, lead(v) OVER w AS v2 FROM b WHERE coalesce(before >= after, true) WINDOW w AS (PARTITION BY media, side ORDER BY px)),
t AS (SELECT media, sum((px2 - px) * (v + v2) / 2.0) AS area FROM e GROUP BY media), z AS (SELECT media, sum(n)::BIGINT AS n FROM c GROUP BY media)
SELECT media, n, round(coalesce(area, 0), 2) AS area, round(least(100, 100 * coalesce(area, 0) / TRIANGLE), 6) AS coverage_pct FROM t JOIN z USING (media)""")
def gamut_area(spark, sf):
    points = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("media"), (0.15 + F.col("l_quantity") / 100).alias("x"), (0.05 + F.col("l_extendedprice") / 150000 + F.col("l_discount")).alias("y"))
    return aggregates.gamut_coverage(points, K, "x", "y").withColumn("area", F.round("area", 2)).withColumn("coverage_pct", r6("coverage_pct"))


# the triangle of BT.2020 on a chart of 512 places
SQL["gamut_area"] = SQL["gamut_area"].replace("TRIANGLE", str(aggregates.chart_triangle("2020", 512)))


# ---- curves in JSON, and their inverse


def _side_data(k: Column) -> Column:
    """A document whose curves rise, of two polynomials each; every seventh lacks a matrix, every fifth a coefficient."""
    whole = lambda v: str(round(v * (1 << 23)))
    gentle = f'"poly_coef": [{whole(0.05)}, {whole(0.9)}]'
    steep = F.when(k % 5 == 0, F.lit('"poly_coef": []')).otherwise(f'"poly_coef": "{whole(0.2)} {whole(0.6)}"')
    one = F.concat(F.lit('{"pivots": [64, 512, 940], "pieces": [{"mapping_idc_name": "polynomial", ' + gentle + '}, {"mapping_idc": 0, '), steep, F.lit("}]}"))
    matrix = F.when(k % 7 == 0, F.lit("")).otherwise(F.lit('"ycc_to_rgb_matrix": "8192/8192 799/8192 1681/8192 1 -933/8192 1091/8192 1 267/8192 -5545/8192", '))
    return F.concat(F.lit("{"), matrix, F.lit('"ycc_to_rgb_offset": "0 1/2 1/2", "rgb_to_lms_matrix": "1 0 0 0 1 0 0 0 1", "source_max_pq": 3079, "components": ['), one, F.lit(", "), one, F.lit(", "), one, F.lit("]}"))


@query("""SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS media, CASE WHEN l_suppkey % 7 = 0 THEN 'none' WHEN l_suppkey % 5 = 0 THEN 'plain' ELSE 'curves' END AS kind,
    round(CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 5 = 0 THEN l_quantity / 50 ELSE least(greatest(l_quantity / 50, 64.0 / 1023), 940.0 / 1023) END, 6) AS back FROM lineitem""")
def curve_round_trip(spark, sf):
    """Signals of all line items through their supplier's curve, read from JSON, and back."""
    docs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("media"), _side_data(F.col("s_suppkey")).alias("body"))
    colours = dynamic.side_data_colour(docs, K)
    streams = colours.limit(0)
    chain = dynamic.colour_chain(docs.select("media"), colours, streams, K)
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("media"), (F.col("l_quantity") / 50).alias("x"))
    pieces = F.coalesce(F.col("curves")[0], F.array().cast("array<struct<low: double, high: double, kind: string, coefficients: array<double>>>"))
    shaped = line.join(chain, "media").withColumn("pieces", pieces).withColumn("y", colour.reshaped([F.col("x")] * 3, 0, F.col("pieces")))
    kind = F.when(F.col("source").isNull(), "none").when(F.col("curves").isNull(), "plain").otherwise("curves")
    back = F.when(F.col("source").isNotNull(), colour.unshaped(F.col("y"), F.col("pieces")))
    return shaped.select("k", "n", "media", kind.alias("kind"), r6(back).alias("back"))


@query("""WITH e AS (SELECT event_id, 0.001 + value / 1013 AS r, 0.002 + value / 2011 AS g, 0.05 AS b FROM events), x AS (SELECT event_id, least(r, 1) AS r, least(g, 1) AS g, b::DOUBLE AS b FROM e)
SELECT event_id, round(r, 5) AS r, round(g, 5) AS g, round(b, 5) AS b, round(pow((0.8359375 + 18.8515625 * pow(r, 0.1593017578125)) / (1 + 18.6875 * pow(r, 0.1593017578125)), 78.84375), 5) AS pq_r FROM x""")
def ipt_round_trip(spark, sf):
    """Light encoded as an IPT signal, decoded again, and as a PQ signal."""
    v = F.col("value")
    array = lambda *x: F.array(*(F.lit(float(c)) for c in x))
    matrices = (array(1, 0.0975, 0.2052, 1, -0.1139, 0.1332, 1, 0.0326, -0.6769), array(0, 0.5, 0.5), array(1, 0, 0, 0, 1, 0, 0, 0, 1))
    encoded = table(spark, sf, "events").select("event_id", colour.ipt_encoded([F.least(0.001 + v / 1013, F.lit(1.0)), F.least(0.002 + v / 2011, F.lit(1.0)), F.lit(0.05)], *matrices).alias("s"))
    signal = [F.col("s")[k] for k in range(3)]
    back = encoded.select("event_id", colour.ipt_linear(signal, *matrices).alias("c"), colour.ipt_native(signal, *matrices).alias("p"))
    return back.select("event_id", *(F.round(F.col("c")[n], 5).alias(n) for n in "rgb"), F.round("p.r", 5).alias("pq_r"))


@query("""WITH c AS (SELECT c_custkey AS media, c_custkey % 4 AS kind FROM customer)
SELECT media, 0 AS depth, 'a' AS manifest, unnest([0, 1]) AS place, unnest(['source ' || media, 'loose']) AS title FROM c WHERE kind < 3
UNION ALL SELECT media, 1, 'b', 0, 'older' FROM c WHERE kind < 3 UNION ALL SELECT media, 2, 'c', 0, 'oldest' FROM c WHERE kind IN (0, 2)""")
def ingredient_lists(spark, sf):
    """Stores whose first ingredient has a manifest, by name or address, and that one another; some turn back in a circle."""
    k = F.col("c_custkey")
    ingredient = lambda title, ref: F.concat(F.lit('{"title": "'), title, F.lit('"'), ref, F.lit("}"))
    named = lambda v: F.lit(f', "active_manifest": "{v}"')
    first = ingredient(F.concat(F.lit("source "), k.cast("string")), F.when(k % 4 == 2, F.lit(', "c2pa_manifest": {"url": "self#jumbf=/c2pa/b"}')).otherwise(named("b")))
    manifest = lambda name, *own: F.concat(F.lit(f'"{name}": {{"ingredients": ['), F.concat_ws(", ", *own), F.lit("]}"))
    second = ingredient(F.lit("older"), F.when(k % 4 == 1, named("a")).otherwise(named("c")))
    body = F.concat(F.lit('{"active_manifest": "a", "manifests": {'), F.concat_ws(", ", manifest("a", first, ingredient(F.lit("loose"), F.lit(""))), manifest("b", second), manifest("c", ingredient(F.lit("oldest"), named("b")))), F.lit("}}"))
    docs = table(spark, sf, "customer").select(k.alias("media"), F.when(k % 4 == 3, '{"active_manifest": "gone", "manifests": {}}').otherwise(body).alias("body"))
    return containers.ingredients(docs, K).select("media", "depth", "manifest", "place", "title")


@query("""WITH s AS (SELECT s_suppkey AS media, s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN '16:11' WHEN s_suppkey % 3 = 1 THEN '1:1' END AS sar, CASE WHEN s_suppkey % 4 = 0 THEN 90 ELSE 0 END AS turn, 720 + s_suppkey % 7 * 16 AS w, 576 AS h FROM supplier),
d AS (SELECT *, CASE WHEN turn = 90 THEN h WHEN sar = '16:11' THEN round_even(w * 16 / 11.0, 0)::INT ELSE w END AS dw, CASE WHEN turn = 90 THEN CASE WHEN sar = '16:11' THEN round_even(w * 16 / 11.0, 0)::INT ELSE w END ELSE h END AS dh FROM s)
SELECT media, list_aggregate(list_filter([
    CASE WHEN k % 5 > 0 THEN 'Container=Long name ' || k ELSE 'Container=mov' END, 'Codec=h264' || CASE WHEN k % 2 = 0 THEN ' (High)' ELSE '' END,
    'Resolution=' || w || 'x' || h || CASE WHEN sar = '16:11' AND turn = 90 THEN '  (anamorphic SAR 16:11, rotated 90\u00b0)' WHEN sar = '16:11' THEN '  (anamorphic SAR 16:11)' WHEN turn = 90 THEN '  (rotated 90\u00b0)' ELSE '' END,
    CASE WHEN dw <> w OR dh <> h THEN printf('Display AR=%d:%d (%.2f:1, shown %dx%d)', (dw // gcd(dw, dh))::INT, (dh // gcd(dw, dh))::INT, dw / dh::DOUBLE, dw, dh) END,
    CASE WHEN k % 6 > 0 THEN printf('Frame Rate=%.3f fps', (24000 + k) / 1001.0::DOUBLE) END, 'Pixel Format=yuv420p', CASE WHEN k % 2 = 1 THEN 'Bit Depth=8-bit' END,
    printf('Duration=%02d:%02d:%02d', (k * 37 // 3600)::INT, (k * 37 % 3600 // 60)::INT, (k * 37 % 60)::INT), CASE WHEN k % 3 = 2 THEN 'Bit Rate=' || (k * 11) || ' kbps' END], lambda x: x IS NOT NULL), 'string_agg', '; ') AS headline FROM d""")
def headlines(spark, sf):
    k = F.col("s_suppkey")
    text = lambda name, value: F.concat(F.lit(f'"{name}": "'), value.cast("string"), F.lit('"'))
    some = lambda on, name, value: F.when(on, text(name, value))
    form = F.concat_ws(", ", text("format_name", F.lit("mov")), some(k % 5 > 0, "format_long_name", F.concat(F.lit("Long name "), k)), text("duration", k * 37), some(k % 3 == 2, "bit_rate", k * 11000))
    ratio = F.when(k % 3 == 0, "16:11").when(k % 3 == 1, "1:1")
    tags = F.when(k % 4 == 0, F.lit('"tags": {"rotate": "90"}'))
    video = F.concat_ws(", ", F.lit('"codec_type": "video", "codec_name": "h264", "height": 576, "pix_fmt": "yuv420p"'), F.concat(F.lit('"width": '), (720 + k % 7 * 16).cast("string")), some(k % 2 == 0, "profile", F.lit("High")), some(k % 2 == 1, "bits_per_raw_sample", F.lit(8)), some(ratio.isNotNull(), "sample_aspect_ratio", ratio), text("avg_frame_rate", F.when(k % 6 > 0, F.concat((24000 + k).cast("string"), F.lit("/1001"))).otherwise("0/0")), tags)
    body = F.concat(F.lit('{"format": {'), form, F.lit('}, "streams": [{"codec_type": "audio"}, {'), video, F.lit("}]}"))
    found = probes.headline(probes.media(probes.parsed(table(spark, sf, "supplier").select(k.alias("media"), body.alias("body")))))
    return found.select("media", F.array_join(F.transform("headline", lambda p: F.concat(p["name"], F.lit("="), p["value"])), "; ").alias("headline"))
