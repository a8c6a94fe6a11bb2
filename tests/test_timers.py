import numpy as np
from pyspark.sql import functions as F

from signalspark.operators import glyphs, timers

K = ["media"]


def test_timer_audit(spark):
    def secs(t):
        if 4 <= t < 9:
            return 4.0
        if t < 10:
            return t
        return t - 3 if t < 15 else 12 + 0.93 * (t - 15)

    rows = [(1, i, i / 10, secs(i / 10)) for i in range(300)] + [(2, i, i / 10, None if i == 7 else i / 10) for i in range(100)]
    df = spark.createDataFrame(rows, "media int, frame long, t double, secs double")
    still = timers.frozen(df, K).collect()
    assert len(still) == 1 and still[0].media == 1 and abs(still[0].t1 - 9) < 0.2
    leap = timers.jumps(df, K, 30.0).filter("kind = 'backward'").collect()
    assert [(r.media, round(r.t, 1)) for r in leap] == [(1, 10.0)]
    slopes = {(r.media, r.segment): r.slope for r in timers.drift(df, K).collect()}
    assert abs(slopes[2, 0] - 1) < 1e-9
    verdict = {r.media: r for r in timers.drift_verdict(timers.drift(df, K), K).collect()}
    assert verdict[2].flagged == 0 and verdict[1].flagged >= 1
    cuts = timers.speed_changes(df.filter("media = 1 AND t >= 10"), K).orderBy("x0").collect()
    assert abs(cuts[-1].slope - 0.93) < 0.012 and abs(cuts[-1].x0 - 15) < 1.2


def test_glyphs_are_read_back(spark):
    shapes = {"1": ["..#..", ".##..", "..#..", "..#..", ".###."], "7": ["#####", "...#.", "..#..", ".#...", ".#..."], "0": [".###.", "#...#", "#...#", "#...#", ".###."]}

    def image(word):
        cells = [np.kron(np.array([[c == "#" for c in row] for row in shapes[ch]]), np.ones((4, 4))) for ch in word]
        x = np.hstack([np.hstack([np.zeros((20, 4)), c]) for c in cells] + [np.zeros((20, 4))])
        return (30 + 200 * x).astype(np.uint8)

    def row(name, word):
        x = image(word)
        return name, word, x.shape[0], x.shape[1], 1, bytearray(x.tobytes())

    df = spark.createDataFrame([row("a", "107"), row("b", "7701")], "media string, text string, h int, w int, c int, pixels binary")
    bank = glyphs.templates(df.filter("media = 'a'"))
    assert bank.select(F.count_distinct("ch")).first()[0] == 3
    assert {r.media: r.text for r in glyphs.texts(df.drop("text"), K, bank).collect()} == {"a": "107", "b": "7701"}
