import os

import pytest
from pyspark.sql import functions as F

from signalspark.operators.joins import stabbed
from signalspark.sources import containers
from signalspark.sources.ranges import byte_ranges, listed, signature_hits


def plain(data):
    """(format, offset) of every signature."""
    return sorted((name, i) for name, sign in containers.MAGIC.items() for i in range(len(data)) if data.startswith(sign, i))


def written(folder, files):
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)


def test_a_signature_at_every_border(spark, tmp_path):
    longest = max(containers.MAGIC.values(), key=len)
    files = {f"{k:02d}.bin": bytes(k) + longest + b"BZh" + bytes(40) + b"PK\x03\x04" for k in range(40)}
    written(tmp_path, files | {"empty.bin": b"", "_hidden": longest, "sub/.x/y": longest, "sub/deep.bin": longest * 3})
    for size, stretch in ((10, 10), (16, 48), (1000, 4000)):
        found = signature_hits(spark, str(tmp_path), size=size, stretch=stretch).collect()
        got = {name: sorted((r.format, r.offset) for r in found if r.path.endswith(f"/{name}")) for name in [*files, "sub/deep.bin"]}
        assert got == {name: plain(data) for name, data in files.items()} | {"sub/deep.bin": plain(longest * 3)}
        assert len(found) == sum(map(len, got.values()))


def test_pieces_join_to_the_file(spark, tmp_path):
    data = bytes(range(256)) * 5 + b"tail"
    written(tmp_path, {"a": data, "b": b"x"})
    for size, overlap, stretch in ((100, 0, 100), (100, 7, 300), (1284, 9, 1), (5000, 64, 5000)):
        rows = byte_ranges(spark, [f"{tmp_path}/a", f"file://{tmp_path}/b"], size=size, overlap=overlap, stretch=stretch)
        a = sorted((r.start, r.own, bytes(r.content)) for r in rows.filter("length > 1").collect())
        assert b"".join(c[:own] for _, own, c in a) == data and all(c == data[s : s + own + overlap] for s, own, c in a)
        assert rows.filter("length = 1").count() == 1


def test_partitions_are_ranges(spark, tmp_path):
    written(tmp_path, {"a": bytes(1000)})
    assert byte_ranges(spark, str(tmp_path), size=100, stretch=250).rdd.getNumPartitions() == 5  # whole pieces: 200 bytes each
    assert byte_ranges(spark, str(tmp_path), size=100, stretch=10**6).rdd.getNumPartitions() == 1


def test_partitions_are_no_more_than_asked_for(spark, tmp_path):
    data = bytes(500) + b"PK\x03\x04" + bytes(996)
    written(tmp_path, {"a": data, "b": data})
    rows = byte_ranges(spark, str(tmp_path), size=10, overlap=0, stretch=20, most=12)
    assert rows.rdd.getNumPartitions() == 10  # of 300 bytes in place of 20
    assert {len(r.content) for r in rows.collect()} == {10}
    assert sorted(r.offset for r in signature_hits(spark, str(tmp_path), size=10, stretch=20, most=12).collect()) == [500, 500]
    assert byte_ranges(spark, str(tmp_path), size=1, stretch=1).rdd.getNumPartitions() <= 2000 < 2 * len(data)


def test_a_file_over_two_gigabytes(spark, tmp_path):
    at = (1 << 31) + 12_345
    with open(f"{tmp_path}/sparse.bin", "wb") as f:
        f.seek(at)
        f.write(b"PK\x03\x04")
        f.seek((64 << 20) * 3 - 2)  # across a border
        f.write(b"%PDF-")
    found = sorted((r.format, r.offset) for r in signature_hits(spark, f"{tmp_path}/sparse.bin", size=64 << 20).collect())
    assert found == [("PDF", (64 << 20) * 3 - 2), ("ZIP", at)]


def test_no_files(spark, tmp_path):
    assert signature_hits(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        listed([f"{tmp_path}/nothing"])


def test_stabbed_matches_all_pairs(spark):
    spans = [("m", 0, 100), ("m", 10, 20), ("m", 12, 13), ("m", 64, 128), ("m", 0, 1 << 40), ("m", 50, 50), ("n", 7, 9)]
    points = [("m", x) for x in (0, 10, 12, 13, 19, 20, 63, 64, 99, 100, 127, 128, 1 << 39, 1 << 41)] + [("n", 8), ("o", 1)]
    got = stabbed(spark.createDataFrame(points, "k string, x long"), spark.createDataFrame(spans, "k string, begin long, end long"), ["k"], "x").select("k", "x", "begin", "end").collect()
    assert sorted(map(tuple, got)) == sorted((k, x, a, b) for k, x in points for j, a, b in spans if j == k and a <= x < b)


def box(name, body):
    return (len(body) + 8).to_bytes(4, "big") + name + body


def test_embedded_files_by_place(spark):
    moov = box(b"moov", box(b"udta", box(b"meta", bytes(4) + box(b"ilst", b"SQLite format 3\0 GIF89a"))))
    data = box(b"ftyp", b"isomGIF89a") + moov + box(b"mdat", b"....BZh %PDF-..") + b"XXGIF87a"
    files = spark.createDataFrame([(1, data), (2, b"no boxes at all, BZh and PK\x03\x04")], "media int, content binary")
    boxes = containers.mp4_boxes(files, ["media"])
    assert [(r.depth, r.type) for r in boxes.filter("media = 1 AND type IN ('meta', 'ilst')").orderBy("depth").collect()] == [(2, "meta"), (3, "ilst")]
    found = containers.embedded_files(containers.magic_hits(files, ["media"]), boxes, ["media"])
    got = sorted((r.media, r.format, r.severity, r.place, r.held_by or "") for r in found.collect())
    assert got == [(1, "BZIP2", "info", "media", "mdat"), (1, "GIF87a", "warn", "trailing", ""), (1, "GIF89a", "info", "header", "ilst"), (1, "PDF", "warn", "media", "mdat"), (1, "SQLite", "warn", "header", "ilst"), (2, "BZIP2", "info", "header", ""), (2, "ZIP", "warn", "header", "")]


def test_appended_data_that_looks_compressed(spark):
    files = spark.createDataFrame([(1, box(b"ftyp", b"isom") + bytes(range(256)) * 8), (2, box(b"ftyp", b"isom") + b"abab" * 9), (3, box(b"ftyp", b"isom"))], "media int, content binary")
    got = {r.media: (r.offset, r.size, round(r.entropy, 3), r.packed) for r in containers.appended_data(containers.mp4_boxes(files, ["media"]), files, ["media"]).collect()}
    assert got == {1: (12, 2048, 8.0, True), 2: (12, 36, 1.0, False)}


def test_hits_of_files_meet_boxes(spark, tmp_path):
    written(tmp_path, {"a": box(b"ftyp", b"isom") + box(b"free", b"RaRar!\x1a\x07")})
    files = spark.read.format("binaryFile").load(f"{tmp_path}/a").select("path", "content")
    hits = signature_hits(spark, f"{tmp_path}/a", size=4).withColumn("path", F.concat(F.lit("file:"), F.regexp_replace("path", "^file:", "")))
    found = containers.embedded_files(hits, containers.mp4_boxes(files, ["path"]), ["path"]).collect()
    assert [(r.format, r.severity, r.held_by) for r in found] == [("RAR", "warn", "free")]
