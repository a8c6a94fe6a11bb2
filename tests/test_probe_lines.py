import json

from signalspark.sources import probes

VIDEO = {"codec_type": "video", "codec_name": "hevc", "width": 1920, "height": 1080, "pix_fmt": "yuv420p10le"}


def read(spark, *documents):
    rows = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)], "media int, body string")
    records = probes.declared_light(probes.hdr_class(probes.media(probes.parsed(rows))))
    return probes.hdr_lines(probes.headline(records)).orderBy("media").collect()


def test_lines_say_what_is_known(spark):
    dovi = {"side_data_type": "DOVI configuration record", "dv_profile": "8", "dv_bl_signal_compatibility_id": "1"}
    light = {"side_data_type": "Content light level metadata", "max_content": "1000"}
    full = read(
        spark,
        {"streams": [VIDEO | {"side_data_list": [dovi, light, {"side_data_type": "Mastering display metadata"}, {"side_data_type": "HDR Dynamic Metadata SMPTE2094-40 (HDR10+)"}]}]},
        {"streams": [VIDEO | {"side_data_list": [{"side_data_type": "Content light level metadata", "max_content": "0"}]}]},
        {"streams": []},
    )
    assert full[0].hdr_lines == ["Dolby Vision: profile 8, base compatibility 1", "HDR10+: present", "Mastering display: present", "MaxCLL/MaxFALL: 1000 / ? nits"]
    assert full[1].hdr_lines[3] == "MaxCLL/MaxFALL: declared, values unknown"
    assert full[2].hdr_lines == ["Dolby Vision: none", "HDR10+: none", "Mastering display: none", "MaxCLL/MaxFALL: none"]


def test_a_headline_leaves_out_what_is_unknown(spark):
    rows = read(
        spark,
        {"format": {"format_name": "matroska,webm", "bit_rate": "N/A", "duration": ""}, "streams": [VIDEO | {"avg_frame_rate": "0/0", "sample_aspect_ratio": "4:3", "side_data_list": [{"side_data_type": "Display Matrix", "rotation": "-90"}]}]},
        {"streams": [{"codec_type": "video"}]},
        "no json",
    )
    pairs = [{p["name"]: p["value"] for p in r.headline} for r in rows]
    assert pairs[0] == {"Container": "matroska,webm", "Codec": "hevc", "Resolution": "1920x1080  (anamorphic SAR 4:3, rotated 90°)", "Display AR": "27:64 (0.42:1, shown 1080x2560)", "Pixel Format": "yuv420p10le"}
    assert pairs[1] == {"Codec": "?"} and pairs[2] == {}
