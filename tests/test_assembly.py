import random
import shutil

import pytest
from pyspark.sql import functions as F

from signalspark.sources.probes import METRICS, frame_log
from signalspark.streaming.assembly import Progress, frame_rows
from signalspark.streaming.sinks import by_batch, current_rows, superseded

SCHEMA = "media long, line_no long, line string, at timestamp"


def log_lines(media, frames, seed=0):
    rng = random.Random(media * 100 + seed)
    lines = ["some preamble"]
    for k in range(frames):
        lines.append(f"frame:{k}    pts:{k}       pts_time:{k * 0.04:.2f}")
        lines += [f"lavfi.signalstats.{m}={rng.randint(0, 999) / 10}" for m in METRICS if rng.random() < 0.8]
    return [(media, i, line) for i, line in enumerate(lines)]


def batches_of(spark, folder, rows, size):
    """Files of `size` lines, in the order given; each line's time follows its place in the log."""
    stamped = spark.createDataFrame(rows, "media long, line_no long, line string").coalesce(1)
    stamped = stamped.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("line_no")))
    data = stamped.collect()
    for k in range(0, len(data), size):
        spark.createDataFrame(data[k : k + size], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in/{k:06d}")


def run(spark, folder, name="q"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    out = frame_rows(stream, ["media"], "at", late="100 hours", idle="1 minute")
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/{name}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def rows_of(df):
    return sorted(tuple(r) for r in df.select("media", "frame", "t", *METRICS).collect())


def closing(media, lines):
    """A last head, so that the row before it is whole."""
    return (media, lines, "frame:last pts_time:99")


@pytest.fixture
def shuffled(spark, tmp_path):
    rows = [r for media in (1, 2, 3) for r in log_lines(media, 8)]
    rows += [closing(m, sum(r[0] == m for r in rows)) for m in (1, 2, 3)]
    twice = rows + rows[::5]
    random.Random(1).shuffle(twice)
    return rows, twice


def test_shuffled_lines_give_the_batch_rows(spark, tmp_path, shuffled):
    rows, arriving = shuffled
    batches_of(spark, tmp_path, arriving, 90)
    run(spark, tmp_path)
    want = frame_log(spark.createDataFrame(rows, "media long, line_no long, line string"), ["media"]).filter("frame < 8")
    assert rows_of(spark.read.parquet(f"{tmp_path}/out")) == rows_of(want)


def test_a_restart_loses_and_doubles_nothing(spark, tmp_path, shuffled):
    rows, arriving = shuffled
    batches_of(spark, tmp_path, arriving[:150], 75)
    run(spark, tmp_path)
    before = spark.read.parquet(f"{tmp_path}/out").count() if (tmp_path / "out").exists() else 0
    batches_of(spark, tmp_path / "more", arriving[150:], 120)
    for k, part in enumerate(sorted((tmp_path / "more/in").iterdir())):
        shutil.move(part, f"{tmp_path}/in/9{k:05d}")
    run(spark, tmp_path)
    want = frame_log(spark.createDataFrame(rows, "media long, line_no long, line string"), ["media"]).filter("frame < 8")
    assert rows_of(spark.read.parquet(f"{tmp_path}/out")) == rows_of(want) and before < 24


def test_the_last_row_waits_for_the_timer(spark, tmp_path):
    rows = log_lines(7, 3)
    stamp = lambda r, s: (*r, __import__("datetime").datetime.fromtimestamp(1_700_000_000 + s))
    lost = [r for r in rows if r[1] != 2]  # a line of the first row never comes
    for k, part in enumerate([[stamp(r, 0) for r in lost], [stamp((8, 0, "frame:0 pts_time:1"), 9000)], [stamp((8, 1, "x.YAVG=5"), 20000)]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen = []
    listener = Progress(lambda *x: seen.append(x), every=5)
    spark.streams.addListener(listener)
    q = frame_rows(stream, ["media"], "at", late="1 second", idle="1 minute").writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.media, r.frame, r.t) for r in spark.table("timed").collect())
    spark.streams.removeListener(listener)
    assert [g for g in got if g[0] == 7] == [(7, 0, 0.0), (7, 1, 0.04), (7, 2, 0.08)]
    assert (8, 0, 1.0) in got or all(g[0] == 7 for g in got)  # its own timer is past the stream's end or not
    assert seen and seen[-1][2] >= 5


def test_replayed_batches_and_stale_runs_change_nothing(spark, tmp_path):
    path, schema = f"{tmp_path}/table", "k long, t long, v string"
    first, second = by_batch(path, ["k"], 1), by_batch(path, ["k"], 2)
    a = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (1, 12, "c")], schema)
    b = spark.createDataFrame([(1, 5, "new"), (3, 1, "d")], schema)
    first(a, 0)
    second(b, 0)
    state = lambda: sorted(map(tuple, current_rows(spark.read.parquet(path), ["k"], "t").select("k", "t", "v").collect()))
    want = [(1, 5, "new"), (2, 10, "b"), (3, 1, "d")]
    assert state() == want
    first(a, 0)  # replayed
    second(b, 0)
    assert state() == want and spark.read.parquet(path).count() == 5
    first(spark.createDataFrame([(1, 99, "stale"), (3, 99, "stale")], schema), 1)  # a run that was superseded goes on
    assert state() == want
    assert sorted(r.v for r in superseded(spark.read.parquet(path), ["k"]).collect()) == ["a", "c", "stale", "stale"]
    second(spark.createDataFrame([(1, 6, "newer")], schema), 1)
    assert state() == [(1, 6, "newer"), (2, 10, "b"), (3, 1, "d")]
