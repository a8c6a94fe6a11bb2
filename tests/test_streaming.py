from pyspark.sql import functions as F

from signalspark.streaming import metrics

SF = "/root/testdata/sf0.001"


def streamed(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def events(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def test_windows_match_the_batch(spark):
    batch = metrics.summary(events(spark.read.parquet(f"{SF}/events.parquet")), ["event_type"], "ts", "value", "1 day")
    got = streamed(spark, metrics.summary(events(metrics.table_stream(spark, SF, "events")), ["event_type"], "ts", "value", "1 day"), "daily", "complete")
    key = lambda r: (r.event_type, r.start, r.n, r.low, r.high)
    assert sorted(map(key, got.collect())) == sorted(map(key, batch.collect()))


def test_runs_match_the_batch(spark):
    from signalspark.operators.series import runs

    source = events(metrics.table_stream(spark, SF, "events")).select("event_type", "ts", "value")
    got = streamed(spark, metrics.flagged_runs(source, "event_type", "ts", F.col("value") > 40), "flagged")
    plain = events(spark.read.parquet(f"{SF}/events.parquet")).withColumn("t", F.unix_micros("ts") / 1e6)
    batch = runs(plain, F.col("value") > 40, ["event_type"], ["ts"], "t").filter("n >= 2")
    whole = {(r.event_type, r.t0, r.t1, r.n) for r in batch.collect()}
    last = {r.event_type: r.t for r in plain.groupBy("event_type").agg(F.max("t").alias("t")).collect()}
    rows = {(r.key, r.t0, r.t1, r.n) for r in got.collect()}
    # a stretch that is open at the end is given only if the watermark has passed it
    assert {r for r in whole if r[2] != last[r[0]]} <= rows <= whole


def test_idle_keys_are_closed_and_late_rows_counted(spark, tmp_path):
    rows = [[("a", 0, 9.0), ("a", 60, 9.0), ("b", 0, 9.0)], [("b", 7200, 0.0), ("a", 30, 9.0), ("b", 7260, 9.0), ("b", 7320, 9.0)], [("b", 7300, 9.0), ("b", 7400, 0.0), ("c", 90000, 0.0)], [("c", 90060, 0.0)]]
    schema = "k string, s long, v double"
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if not k:
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds(F.col("s") + 10000))
            q = metrics.flagged_runs(source, "k", "ts", F.col("v") > 5).writeStream.format("memory").queryName("idle_runs").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
    q.stop()
    # a's stretch is closed by the watermark; b's later one by a row, after one that came late
    assert sorted((r.key, r.t0, r.t1, r.n, r.missed) for r in spark.table("idle_runs").collect()) == [("a", 10000.0, 10060.0, 2, 1), ("b", 17260.0, 17320.0, 2, 1)]


def test_windows_carry_over_chunks(spark, tmp_path):
    signal = {"a": [float(i) for i in range(100)], "b": [float(-i) for i in range(37)]}
    rows = [(k, at, x[at : at + 9]) for k, x in signal.items() for at in range(0, len(x), 9)]
    for k in range(2):  # two files: windows over their border
        part = [r for r in rows if (r[1] >= 45) == bool(k)]
        spark.createDataFrame(part, "k string, at int, x array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k string, at int, x array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streamed(spark, metrics.overlapping(source, "k", "at", "x", 16, 8), "carried").collect()
    want = {(k, b, tuple(x[8 * b : 8 * b + 16])) for k, x in signal.items() for b in range((len(x) - 16) // 8 + 1)}
    assert {(r.key, r.block, tuple(r.samples)) for r in got} == want


def test_older_epochs_are_superseded(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, "w")], "k string, epoch int, v string")
    assert sorted(r.v for r in metrics.current(df, ["k"], "epoch").collect()) == ["w", "y", "z"]
