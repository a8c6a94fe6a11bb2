"""Planted defects and clean controls for the media operators, and plain versions of the greedy and spectral ones."""

import math
import random
import struct
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.functions import colour, text
from signalspark.operators import aggregates, captions, findings, images, joins, qc, segments, series, signals
from signalspark.sources import containers, probes

K = ["media"]


def col(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- functions


def test_transfer_curves_are_inverse(spark):
    df = spark.range(33).select((F.col("id") / 32).alias("x"))
    got = df.select("x", colour.pq_oetf(colour.pq_eotf(F.col("x"))).alias("y"), colour.pq_nits(F.lit(1.0)).alias("top")).collect()
    assert all(abs(r.x - r.y) < 1e-5 for r in got) and abs(got[0].top - 10000) < 1e-6


def test_bars_lie_in_their_own_triangle(spark):
    bars = [(r, g, b) for r in (0.0, 1.0) for g in (0.0, 1.0) for b in (0.0, 1.0) if r + g + b]
    df = col(spark, bars, "r double, g double, b double")
    rgb = [F.col(c) for c in "rgb"]
    share = lambda primaries: df.select(colour.chromaticity(*rgb, primaries).alias("c")).select(F.avg(colour.outside(F.col("c.x"), F.col("c.y"), "709").cast("double"))).first()[0]
    assert share("709") == 0.0 and share("2020") > 0.5


def test_timers_and_rates(spark):
    rows = [("1:23.45", 83.45), ("01:02:03.500", 3723.5), ("00:01:02:15", 62.5), ("1:?3.45", None), ("07:62", None), ("90", 3.0), ("12.5", 12.5), ("", None), (None, None)]
    df = col(spark, rows, "s string, want double").select("want", text.timer(F.col("s"), 30.0).alias("m"))
    assert all((r.m.seconds if r.m else None) == pytest.approx(r.want) if r.want is not None else r.m is None for r in df.collect())
    rates = col(spark, [("60000/1001", 60000 / 1001), ("25", 25.0), ("0/0", 0.0), ("x", 0.0), (None, 0.0)], "s string, want double")
    assert all(r.got == pytest.approx(r.want) for r in rates.select("want", text.rate(F.col("s")).alias("got")).collect())


def test_times_of_day(spark):
    df = spark.createDataFrame([(3661.0,), (-1.0,), (None,)], "s double").select(text.hms(F.col("s")).alias("h"))
    assert [r.h for r in df.collect()] == ["01:01:01", "n/a", "n/a"]


# ---- series and segments


def test_greedy_picks_match_plain_loops(spark):
    rng = random.Random(3)
    rows = [(m, round(rng.uniform(0, 60), 3), round(rng.uniform(0, 9), 3)) for m in range(4) for _ in range(80)]
    df = col(spark, rows, "media int, t double, v double")
    apart, best = set(), set()
    for m in range(4):
        mine = sorted(r for r in rows if r[0] == m)
        last = None
        for r in mine:
            if last is None or r[1] - last > 2.0:
                apart.add(r)
                last = r[1]
        kept = []
        for r in sorted(mine, key=lambda r: (-r[2], r[1])):
            if len(kept) < 7 and all(abs(r[1] - k[1]) >= 3.0 for k in kept):
                kept.append(r)
        best |= set(kept)
    assert {tuple(r) for r in series.spread_out(df, K, "t", 2.0).collect()} == apart
    assert {tuple(r) for r in series.best_first(df, K, "t", "v", 3.0, 7).collect()} == best


def test_change_of_slope_is_found(spark):
    rows = [(1, i / 10, (i / 10) if i < 150 else 15 + 0.5 * (i - 150) / 10) for i in range(300)]
    got = series.cut_points(col(spark, rows, "media int, x double, y double"), K, "x", "y").orderBy("x0").collect()
    assert len(got) >= 2 and got[0].slope == pytest.approx(1, abs=0.05) and got[-1].slope == pytest.approx(0.5, abs=0.05)


def test_audio_defects(spark):
    sr, n = 2000, 6000
    t = np.arange(n) / sr
    rng = np.random.default_rng(1)
    x = 0.2 * np.sin(2 * np.pi * 50 * t) + rng.normal(0, 0.001, n)
    x[2000:2100] = 1.0
    x[4000:4120] = 0.0
    for at in (1000, 5000):
        x[at] += 0.9
    df = spark.createDataFrame([(1, int(i), float(v)) for i, v in enumerate(x)], "media int, i long, x double")
    clip = segments.clipping(df, K, F.lit(float(sr)), least=3).collect()
    assert len(clip) == 1 and clip[0].t0 == pytest.approx(1.0, abs=0.01)
    drop = segments.dropouts(df, K, float(sr)).collect()
    assert len(drop) == 1 and drop[0].t == pytest.approx(2.0, abs=0.05) and drop[0].duration == pytest.approx(0.06, abs=0.01)
    hit = sorted(r.t for r in segments.clicks(df, K, float(sr)).collect())
    assert {0.5, 2.5} <= {round(v, 2) for v in hit}
    clean = spark.createDataFrame([(1, int(i), float(v)) for i, v in enumerate(0.2 * np.sin(2 * np.pi * 50 * t) + 0.01)], "media int, i long, x double")
    assert segments.clipping(clean, K, F.lit(float(sr))).count() == segments.dropouts(clean, K, float(sr)).count() == segments.clicks(clean, K, float(sr)).count() == 0


def test_loads(spark):
    rows = [(1, f, 5.0 if 60 <= f < 90 else 100.0, 0.2 if 150 <= f < 210 or 250 <= f < 253 else 5.0, 99.0) for f in range(300)]
    df = spark.createDataFrame(rows, "media int, frame long, luma double, diff double, refd double")
    got = segments.load_segments(segments.load_kinds(df, K, 30.0), K, 30.0)
    assert sorted((r.kind, r.f0, r.f1) for r in got.collect()) == [(1, 150, 209), (2, 60, 89)]
    ranges = spark.createDataFrame([(1, 80, 160)], "media int, q0 long, q1 long")
    assert joins.frames_in(got, ranges, K).first().frames == 21


def test_loudness_step(spark):
    rows = [(1, i / 10, -30.0 if i < 300 else -18.0) for i in range(600)]
    got = signals.loudness_steps(spark.createDataFrame(rows, "media int, t double, m double"), K).collect()
    assert len(got) == 1 and 25 < got[0].t < 32 and got[0].change == pytest.approx(12, abs=1.5)


# ---- spectra


def test_hum_is_found_and_absent(spark):
    rng = np.random.default_rng(2)
    def blocks(hz):
        t = np.arange(3200) / 400
        return [(hz, b, 400, (0.2 * np.sin(2 * np.pi * hz * (t + 8 * b)) + rng.normal(0, 0.02, 3200)).astype(float).tolist()) for b in range(5)]
    df = spark.createDataFrame([*blocks(60.0), *blocks(140.0)], "media double, block long, sr int, samples array<double>")
    got = {r.media: r for r in signals.hum_verdict(signals.hum(df, K, 59.0, 61.0), K).collect()}
    assert got[60.0].present and got[60.0].jumps == 0 and not got[140.0].present


def test_flicker_tone(spark):
    rng = np.random.default_rng(5)
    rows = [(m, i, 100 + (4 * math.sin(2 * math.pi * i / 25) if m else 0) + float(rng.normal(0, 1))) for m in (0, 1) for i in range(250)]
    got = {r.media: r for r in signals.flicker(spark.createDataFrame(rows, "media int, frame long, v double"), K, 25.0, "v").collect()}
    assert got[1].hz == pytest.approx(1.0, abs=0.2) and got[1].ratio > 100 and got[0].ratio < 25


def test_flicker_in_long_series(spark):
    rng = np.random.default_rng(7)
    tones, n = (None, 0.5, 2.0, 3.9), 15000  # ten minutes
    v = [100 + (np.sin(2 * np.pi * hz * np.arange(n) / 25) if hz else 0) + rng.normal(0, 1, n) for hz in tones]
    rows = [(m, i, float(x)) for m, one in enumerate(v) for i, x in enumerate(one)]
    got = {r.media: r for r in signals.flicker(spark.createDataFrame(rows, "media int, frame long, v double"), K, 25.0, "v").collect()}
    for m, one in enumerate(v):
        power = np.abs(np.fft.rfft((one - one.mean()) * np.hanning(n))) ** 2
        band = power * ((np.fft.rfftfreq(n, 1 / 25) >= 0.2) & (np.fft.rfftfreq(n, 1 / 25) <= 4.0))
        assert got[m].hz == pytest.approx(np.argmax(band) * 25 / n) and got[m].ratio == pytest.approx(band.max() / np.median(power[1:]), rel=1e-6)
        assert tones[m] is None or (got[m].hz == pytest.approx(tones[m], abs=0.01) and got[m].ratio > 1000)


def plain_loops(h, least, kinds):
    """h: frame -> hash. Every longest stretch, frame by frame."""
    out = []
    for delta in range(1, max(h) + 1):
        same = lambda f, d=delta: f in h and f + d in h and h[f] == h[f + d]
        for a in (f for f in h if same(f) and not same(f - 1)):
            n = next(k for k in range(1, len(h) + 1) if not same(a + k))
            seen = {h[f] for f in range(a, a + n)} - {None}
            if least <= n <= delta and len(seen) >= max(kinds, n // 4):
                out.append((delta, a, a + delta, n))
    return sorted(out)


def test_loops_of_held_and_interrupted_frames(spark):
    rng = random.Random(8)
    new = lambda n: [rng.getrandbits(40) for _ in range(n)]
    clip, black = new(50), 0
    doubled = [x for x in new(40) + clip + new(70) + clip + new(10) for _ in range(2)]
    cut = clip[:25] + [black] + clip[25:]
    dark = [black] + cut + [black] * 9 + new(30) + [black] + new(40) + cut + new(5)
    thrice = clip + new(60) + clip[:40] + new(60) + clip
    noise = [[rng.choice([None, 1, 2, 3, 4]) for _ in range(90) for _ in range(rng.choice([1, 1, 3]))] for _ in range(4)]
    media = [dict(enumerate(x)) for x in (doubled, dark, thrice, *noise)]
    media += [{f: x for f, x in m.items() if f not in (40, 90, 91)} for m in media[2:5]]  # missing frames
    df = spark.createDataFrame([(m, f, x) for m, one in enumerate(media) for f, x in one.items()], "media int, frame long, h long")
    for least, kinds in ((30, 3), (3, 2), (5, 3)):
        got = joins.loops(df, K, "h", least, kinds).collect()
        for m, one in enumerate(media):
            assert sorted((r.delta, r.source, r.repeat, r.n) for r in got if r.media == m) == plain_loops(one, least, kinds)
        if least == 30:
            assert [(r.source, r.repeat, r.n) for r in got if r.media == 0] == [(80, 320, 100)]
            assert [(r.source, r.n) for r in got if r.media == 1] == [(1, 51)]
            assert len([r for r in got if r.media == 2]) == 3


def test_reused_passage(spark):
    rng = np.random.default_rng(6)
    v = rng.random((60, 6))
    v[40:50] = v[5:15]
    df = spark.createDataFrame([(1, i, x.tolist()) for i, x in enumerate(v)], "media int, block long, bands array<double>")
    cuts = spark.createDataFrame([(1, 40.0)], "media int, t double")
    got = signals.reused(df, K, cuts, 1.0, span_s=10.0, away_s=6.0).first()
    assert got.source == 5.0 and got.likeness == pytest.approx(1.0)


def test_reused_passages_over_many_tiles(spark, monkeypatch):
    """Against all pairs, with equal passages, missing blocks and an unknown band."""
    monkeypatch.setattr(signals, "_TILE", 7)
    rng = np.random.default_rng(2)
    rows = {(m, i): rng.integers(0, 4, 5).astype(float).tolist() for m in (1, 2) for i in range(60) if (m, i) not in ((1, 20), (2, 33))}
    for i in range(45, 55):
        rows[1, i] = rows[1, 30 + i % 5] = rows[1, 8 + i % 5]
    rows[2, 10] = [1.0, None, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([(m, i, v) for (m, i), v in rows.items()], "media int, block long, bands array<double>")
    cuts = spark.createDataFrame([(m, float(i)) for m in (1, 2) for i in range(3, 60, 4)], "media int, t double")
    whole = {(m, i): sum((rows[m, i + k] for k in range(3)), []) for m, i in rows if all((m, i + k) in rows and None not in rows[m, i + k] for k in range(3))}
    want = {}
    for m, i in ((m, i) for m, i in whole if i % 4 == 3 and i >= 3):
        like = {j: np.dot(whole[m, i], whole[q, j]) / (np.sqrt(np.dot(whole[m, i], whole[m, i]) * np.dot(whole[q, j], whole[q, j])) + 1e-12) for q, j in whole if q == m and j <= i - 5}
        if like:
            top = max(like.values())
            want[m, float(i)] = (float(min(j for j, x in like.items() if x > top - 1e-12)), round(top, 9))
    got = signals.reused(df, K, cuts, 1.0, span_s=3.0, away_s=5.0)
    assert {(r.media, r.t): (r.source, round(r.likeness, 9)) for r in got.collect()} == want


# ---- aggregates


def test_binomial_tails_are_exact():
    for n, k, p in ((10, 3, 0.5), (20, 20, 0.5), (262, 42, 0.0473), (1000, 600, 0.5), (100, 1, 0.01)):
        q = Fraction(p)
        exact = sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k, n + 1))
        assert aggregates.binomial_tail_log10(n, k, p) == pytest.approx(float(math.log10(exact)), abs=1e-9)


def test_incomplete_gamma():
    for x in (0.1, 1.0, 5.0, 30.0):
        assert aggregates.upper_gamma(1.0, x) == pytest.approx(math.exp(-x), rel=1e-12)
        assert aggregates.upper_gamma(0.5, x) == pytest.approx(math.erfc(math.sqrt(x)), rel=1e-10)


def test_hidden_bits_are_seen(spark):
    rng = np.random.default_rng(4)
    clean = np.clip(np.rint(rng.normal(100, 6, 20000) / 2) * 2 + (rng.random(20000) < 0.2), 0, 255).astype(int)
    full = (clean & ~1) | rng.integers(0, 2, 20000)
    df = spark.createDataFrame([(m, int(v)) for m, values in ((0, clean), (1, full)) for v in values], "media int, v int")
    p = {r.media: r.p for r in aggregates.with_probability(aggregates.lsb_pairs(df, K, "v")).collect()}
    assert p[0] < 1e-6 and p[1] > 1e-3


def test_tails_beyond_any_loop():
    assert aggregates.binomial_tail_log10(10_000_000, 4_900_000, 0.5) == pytest.approx(0, abs=1e-9)
    assert aggregates.binomial_tail_log10(10_000_000, 5_000_000, 0.5) == pytest.approx(math.log10(0.5), abs=1e-3)
    assert aggregates.binomial_tail_log10(10**9, 10**9 // 2 + 50_000, 0.5) == pytest.approx(math.log10(math.erfc(50_000 / math.sqrt(2 * 10**9 / 4)) / 2), abs=1e-3)
    assert aggregates.binomial_tail_log10(100, 51, 0.5) == pytest.approx(math.log10((1 - math.comb(100, 50) / 2**100) / 2), abs=1e-12)
    assert aggregates.upper_gamma(0, 3) == 0 and aggregates.upper_gamma(3, 0) == 1 and aggregates.upper_gamma(2.5, 3) == pytest.approx(0.3062189, abs=1e-6)
    with pytest.raises(ValueError):
        aggregates.upper_gamma(0.3, 1)


def test_hidden_bit_rate(spark):
    rng = np.random.default_rng(6)
    smooth = np.clip(np.rint(128 + 60 * np.sin(np.arange(40000) / 90) + rng.normal(0, 1.5, 40000)), 0, 255).astype(int)
    series_of = {0: smooth}
    for media, share in ((1, 0.3), (2, 0.9)):
        hit = rng.random(40000) < share
        series_of[media] = np.where(hit, (smooth & ~1) | rng.integers(0, 2, 40000), smooth)
    df = spark.createDataFrame([(m, i, int(v)) for m, x in series_of.items() for i, v in enumerate(x)] + [(9, i, i) for i in range(40)], "media int, i int, v int")
    rate = aggregates.hidden_bit_rate(aggregates.regular_singular(df, K, "i", "v"), K)
    got = {r.media: r.rate for r in rate.collect()}
    assert got[0] < 0.05 and abs(got[1] - 0.3) < 0.1 and got[2] > 0.7 and got[9] == 0.0
    verdict = aggregates.hidden_bit_verdict(rate, aggregates.with_probability(aggregates.lsb_pairs(df, K, "v")), K)
    assert {r.media: r.suspicious for r in verdict.collect()} == {0: False, 1: True, 2: True, 9: False}


def test_hidden_bit_rate_of_roots_as_near_to_zero(spark):
    """2 (d1 + d0) z^2 + c with no linear part: the positive root counts, as in the SQL."""
    shares = [(1, turned, flip, 99, d, 0.0) for turned, flip, d in ((0, 1, 0.125), (0, -1, 0.75), (1, 1, 0.125), (1, -1, 0.25))]
    counts = col(spark, shares, "media int, turned int, flip int, groups long, regular double, singular double")
    assert [r.rate for r in aggregates.hidden_bit_rate(counts, K).collect()] == [1.5]


def test_greedy_picks_leave_out_unknown_times(spark):
    df = col(spark, [(1, t, s) for t, s in ((0.0, 1.0), (10.0, 3.0), (20.0, 2.0), (30.0, 4.0), (None, 9.0), (float("nan"), 8.0), (40.0, None))], "media int, t double, s double")
    assert sorted(r.t for r in series.spread_out(df, K, "t", 5.0).collect()) == [0.0, 10.0, 20.0, 30.0, 40.0]
    assert sorted(r.t for r in series.best_first(df, K, "t", "s", 5.0, 9).collect()) == [0.0, 10.0, 20.0, 30.0]


def test_coverage_of_long_and_odd_intervals(spark):
    """Without buckets, so a span of any length is two ends: every pair's overlap, repeated ones too."""
    rng = random.Random(9)
    spans, covers = ([(m, float(a), float(a + rng.choice([-3, 0, 1, 9, 10**12]))) for m in (1, 2) for a in rng.choices(range(60), k=40)] for _ in range(2))
    spans += [(3, 5.0, 6.0), (3, None, 6.0), (4, None, None)]
    covers += [(3, None, 9.0), (9, 0.0, 1.0)]
    make = lambda rows: spark.createDataFrame(rows, "media int, t0 double, t1 double")
    got = {r.media: (r.total, r.covered) for r in joins.coverage(make(spans), make(covers), K).collect()}
    shared = lambda m: sum(max(0.0, min(b, d) - max(a, c)) for k, a, b in spans for q, c, d in covers if k == q == m and a < b and c < d)
    assert got == {m: (sum(b - a for k, a, b in spans if k == m), shared(m)) for m in (1, 2)} | {3: (1.0, 0.0), 4: (None, 0.0)}


def test_hash_pairs_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(12):
        base = [rng.getrandbits(64), rng.getrandbits(64)]
        for _ in range(6):
            a, b = base
            for _ in range(rng.randrange(6)):
                a, b = a ^ 1 << rng.randrange(64), b ^ 1 << rng.randrange(64)
            rows.append((len(rows), a, b))
    rows += [(len(rows) + k, *rows[k][1:]) for k in range(5)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(i, signed(a), signed(b)) for i, a, b in rows] + [(999, None, 1)], "id int, a long, b long")
    first = {}
    for i, a, b in rows:
        first.setdefault((a, b), i)
    for most in (3, 11):
        want = {(i, j, d) for (p, i) in first.items() for (q, j) in first.items() if i < j for d in [(p[0] ^ q[0]).bit_count() + (p[1] ^ q[1]).bit_count()] if d <= most}
        assert {tuple(r) for r in joins.hash_pairs(df, "id", ["a", "b"], most).collect()} == want and want
    assert {(r.id, r.first) for r in joins.hash_members(df, "id", ["a", "b"]).collect()} == {(i, first[a, b]) for i, a, b in rows}
    with pytest.raises(ValueError):
        joins.hash_pairs(df, "id", ["a"], 40)


def test_loops_within_a_tolerance(spark):
    rng = random.Random(5)
    shots = [rng.getrandbits(63) for _ in range(200)]
    shots[120:150] = [h ^ 1 << rng.randrange(63) for h in shots[20:50]]  # one bit differs in every frame
    still = [7] * 200
    cyclic = [rng.getrandbits(63) for _ in range(20)] * 5
    tile = [rng.getrandbits(63) for _ in range(29)]
    tiled = [h for _ in range(5) for h in (*tile, rng.getrandbits(63))]
    df = spark.createDataFrame([(m, f, h) for m, x in ((1, shots), (2, still), (3, cyclic), (4, tiled)) for f, h in enumerate(x)], "media int, frame int, h long")
    got = joins.loop_scan(df, K, ["h"], least=10, tolerance=3).collect()
    assert [(r.delta, r.source, r.repeat, r.n, r.periodic) for r in got if r.media == 1] == [(100, 20, 120, 30, False)]
    assert not [r for r in got if r.media in (2, 3)]
    assert {r.periodic for r in got if r.media == 4 and r.delta == 30} == {True}


# ---- findings and rules


def test_empty_context_passes_integrity(spark):
    media = spark.createDataFrame([(1,)], "media int")
    assert qc.verdicts(qc.evaluate(media, K, "integrity"), K).first().verdict == "pass"
    assert all(qc.evaluate(media, K, p).count() > 0 for p in qc.PROFILES)
    loud = spark.createDataFrame([(1, -70.0, float("-inf"), True)], "media int, integrated_lufs double, true_peak_dbfs double, has_audio boolean")
    got = {r.check_id: r.status for r in qc.evaluate(loud, K, "broadcast-r128").collect()}
    assert got["loudness"] == "fail" and got["true_peak"] == "pass" and got["has_audio"] == "pass"


def test_splices_join_audio_to_the_slot_beside(spark):
    signs = spark.createDataFrame([(1, 9.4, "pts"), (1, 9.7, "audio"), (1, 20.0, "size"), (1, 0.1, "pts")], "media int, t double, kind string")
    cuts, ends = spark.createDataFrame([(1, 20.1)], "media int, t double"), spark.createDataFrame([(1, 30.0)], "media int, duration double")
    got = findings.splice_candidates(signs, cuts, ends, K).collect()
    assert [(r.score, r.signals) for r in got] == [(3, ["audio", "pts"])]


def test_ingredient_chain_ends_in_circles(spark):
    links = spark.createDataFrame([("m1", "m0"), ("m0", "capture"), ("capture", "m1")], "parent string, child string")
    got = findings.ingredient_chain(links, spark.createDataFrame([("m1",)], "node string"))
    assert sorted((r.node, r.depth) for r in got.collect()) == [("capture", 2), ("m0", 1), ("m1", 0)]


# ---- sources


def test_probe_documents(spark):
    body = '{"format": {"duration": "10.0"}, "streams": [{"codec_type": "video", "codec_name": "hevc", "width": 1920, "height": 1080, "pix_fmt": "yuv420p10le", "avg_frame_rate": "24000/1001", "color_transfer": "smpte2084", "color_primaries": "bt2020", "sample_aspect_ratio": "1:1", "side_data_list": [{"side_data_type": "DOVI configuration record", "dv_profile": "8", "dv_bl_signal_compatibility_id": "1"}]}, {"codec_type": "audio"}]}'
    df = probes.hdr_class(probes.signal_tags(probes.media(probes.parsed(spark.createDataFrame([(body,), ("{}",), (None,)], "body string")))))
    rows = df.collect()
    assert rows[0].hdr_format == "Dolby Vision P8.1 + HDR10" and rows[0].bit_depth == 10 and rows[0].nb_frames == 240 and rows[0].has_audio
    assert rows[0].flags == ["HDR10 base without mastering display", "HDR10 base without light levels"] and rows[0].signal == "pq"
    assert not rows[1].ok and not rows[2].ok


def test_logs(spark):
    df = spark.createDataFrame([(1, 0, "frame:0 pts:0 pts_time:0"), (1, 1, "lavfi.signalstats.YAVG=16.5"), (1, 2, "frame:1 pts:1 pts_time:0.04"), (1, 3, "lavfi.signalstats.YAVG=nan")], "media int, line_no int, line string")
    got = probes.frame_log(df, K).orderBy("frame").collect()
    assert [(r.frame, r.t, r.YAVG) for r in got][0] == (0, 0.0, 16.5) and got[1].t == 0.04
    loud = probes.loudness_summary(spark.createDataFrame([("I: -23.0 LUFS\nLRA: 5.0 LU\nThreshold: -33.0\nPeak: -inf dBFS",)], "text string")).first()
    assert loud.integrated_lufs == -23.0 and loud.true_peak_dbfs == float("-inf")
    packets = probes.packet_log(spark.createDataFrame([(1, 0, "pts_time=0.0|pkt_size=900|pict_type=I|key_frame=1"), (1, 1, "pts_time=N/A|pkt_size=x|pict_type=")], "media int, line_no int, line string"), K)
    assert [(r.t, r.size, r.type, r.key) for r in packets.orderBy("frame").collect()] == [(0.0, 900, "I", 1), (1.0, 0, "?", 0)]


def test_captions(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\n<i>Tagged line</i>\n\n2\n00:00:03,000 --> 00:00:03,500\nTwo\nlines\n\n3\n00:00:09,000 --> 00:00:10,000\n\n"
    cues = probes.srt_cues(spark.createDataFrame([(1, srt)], "media int, text string"), K)
    assert [(r.t0, r.t1, r.text) for r in cues.orderBy("t0").collect()] == [(1.0, 2.5, "Tagged line"), (3.0, 3.5, "Two\nlines")]
    speech = cues.select("media", (F.col("t0") - 0.4).alias("t0"), F.col("t1"))
    out = captions.summary(cues, speech, spark.createDataFrame([(1, 10.0)], "media int, duration double"), K).first()
    assert out.cues == 2 and out.brief == 1 and out.systematic and out.offset == pytest.approx(0.4) and out.coverage_pct == pytest.approx(100 * 2.0 / 2.8)


def test_containers(spark):
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    data = box(b"ftyp", b"isom") + box(b"mdat", b"x" * 16) + box(b"free", bytes(70000)) + box(b"moov", box(b"mvhd", bytes(100))) + box(b"mdat", b"y" * 16) + b"PK\x03\x04tail"
    files = spark.createDataFrame([(1, data), (2, b""), (3, None)], "media int, content binary")
    boxes = containers.mp4_boxes(files, K)
    assert sorted({r.text for r in containers.container_findings(boxes, K).collect()}) == ["a gap of 64 KiB or more", "creation time zeroed", "index behind the media", "several media boxes"]
    assert {r.media: r.extra for r in containers.appended(boxes, files, K).collect()}[1] == 8
    assert [(r.format, r.offset) for r in containers.magic_hits(files, K).collect()] == [("ZIP", len(data) - 8)]
    entropy = containers.entropy_blocks(spark.createDataFrame([(1, bytes(range(256)) * 4), (2, bytes(999))], "media int, content binary"), K).collect()
    assert {r.media: r.entropy for r in entropy} == {1: 8.0, 2: 0.0}
    sei = b"\x00\x00\x01\x06\x05\x38" + bytes(range(1, 57)) + b"\x80"
    assert [(r.type, r.size) for r in containers.sei_messages(spark.createDataFrame([(1, sei)], "media int, content binary"), K).collect()] == [(5, 56)]
    bits = containers.Bits(bytes([0b10100110, 0b01000000]))
    assert [bits.unsigned(), bits.unsigned(), bits.signed()] == [0, 1, -1]


# ---- pictures


def test_pictures(spark):
    rng = np.random.default_rng(7)
    ramp = np.tile(np.repeat(np.arange(48, 64), 16)[None, :], (64, 1)).astype(np.uint8)
    noisy = np.clip(128 + rng.normal(0, 4, (64, 256)), 0, 255).astype(np.uint8)
    lined = noisy.copy()
    lined[30] = 255
    df = spark.createDataFrame([(n, 0, 64, 256, 1, bytearray(x.tobytes())) for n, x in (("ramp", ramp), ("noisy", noisy), ("lined", lined))], "media string, frame long, h int, w int, c int, pixels binary")
    got = {r.media: r for r in df.select("media", images.noise_floor().alias("noise"), images.dropout_rows(df).alias("rows"), images.picture_hash().alias("hash"), images.glyphs().alias("glyphs")).collect()}
    assert got["ramp"].noise == 0.0 and got["noisy"].noise > 2 and got["noisy"].rows == [] and got["lined"].rows == [30]
    pair = spark.createDataFrame([(bytearray(noisy.tobytes()), bytearray(x.tobytes()), 64, 256, 1) for x in (noisy, lined)], "a binary, b binary, h int, w int, c int")
    one, two = images.visually_lossless(images.pair_measures(pair)).collect()
    assert one.psnr == float("inf") and one.ssim == pytest.approx(1.0) and one.verdict == "lossless" and two.psnr < 40


def picture(spark, **named):
    rows = [(n, 0, x.shape[0], x.shape[1], 1, bytearray(np.clip(x, 0, 255).astype(np.uint8).tobytes())) for n, x in named.items()]
    return spark.createDataFrame(rows, "media string, frame long, h int, w int, c int, pixels binary")


def test_block_edges_of_either_direction(spark):
    rng = np.random.default_rng(2)
    base = 128 + rng.normal(0, 2, (96, 96))
    across = base + np.repeat(rng.normal(0, 30, 12), 8)[:, None]
    df = picture(spark, none=base, across=across, along=across.T, flat=np.full((96, 96), 9.0))
    got = {r.media: r.b for r in df.select("media", images.blockiness().alias("b")).collect()}
    assert abs(got["none"]) < 0.3 and got["across"] > 1 and got["along"] > 1 and got["flat"] is None
    double = {r.media: r.d for r in df.select("media", images.double_quantised().alias("d")).collect()}
    assert all(0 <= d <= 1 for d in double.values())


def test_contours_are_found_and_noise_is_not(spark):
    rng = np.random.default_rng(3)
    ramp = np.linspace(60, 76, 256)[None, :] * np.ones((128, 1))
    steps = np.floor(ramp / 2) * 2
    df = picture(spark, steps=steps, dithered=np.floor(ramp + rng.random((128, 256))), flat=np.full((128, 256), 80.0))
    got = {r.media: r.b for r in df.select("media", images.banding().alias("b")).collect()}
    assert got["steps"] > 3 and got["dithered"] < 1 and got["flat"] == 0


def test_regions_touch_by_corners():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 1, 1]], bool)
    label = images.regions(mask)
    assert len(np.unique(label[mask])) == 3 and label[0, 0] == label[1, 1] != label[0, 3] and (label[~mask] == 0).all()


def test_wobble_without_pans(spark):
    rng = np.random.default_rng(4)
    base = images.blurred(rng.normal(128, 60, (64, 128)), 1.0)
    rows = [base, np.roll(base, 1, axis=1), np.stack([np.roll(r, int(s), axis=0) for r, s in zip(base, rng.integers(-2, 3, 64), strict=True)])]
    df = spark.createDataFrame([(1, k, 64, 128, 1, bytearray(np.clip(x, 0, 255).astype(np.uint8).tobytes())) for k, x in enumerate(rows)], "media int, frame long, h int, w int, c int, pixels binary")
    got = {r.frame: r for r in images.frame_change(df, K).collect()}
    assert got[0].jitter is None and got[1].jitter < 0.2 and got[2].jitter > 0.55 and got[1].complexity > got[0].complexity


def test_what_stands_out(spark):
    rng = np.random.default_rng(5)
    x = 100 + rng.normal(0, 1, (96, 128))
    x[40:48, 90:98] += 100
    place = picture(spark, one=x).select(images.salient_place().alias("p")).select("p.*").first()
    assert 84 <= place.x <= 104 and 34 <= place.y <= 54 and 0 < place.share < 0.3
    y = x.copy()
    y[:48, :64] += rng.normal(0, 9, (48, 64))
    noisy = {r.media: r.n for r in picture(spark, even=x, pasted=y, small=x[:8, :8]).select("media", images.noise_spread().alias("n")).collect()}
    assert noisy["pasted"] > 3 > noisy["even"] and noisy["small"] is None


def test_views_of_two_pictures(spark):
    a, b = np.full((4, 6, 3), 10, np.uint8), np.full((4, 6, 3), 40, np.uint8)
    df = spark.createDataFrame([(bytearray(a.tobytes()), bytearray(b.tobytes()), 4, 6, 3)], "a binary, b binary, h int, w int, c int")
    got = df.select(*(images.view(m).alias(m) for m in images.VIEWS)).first()
    assert set(got["diff"]) == {120} and set(got["blend"]) == {25} and bytes(got["split"][:18]) == bytes([10] * 9 + [40] * 9) and len(got["heat"]) == 24


def test_many_boxes_and_hits(spark):
    data = (struct.pack(">I4s", 8, b"free") * 7000) + struct.pack(">IQ", 1, 0)[:4] + b"mdat" + struct.pack(">Q", 20) + b"abcd"
    files = spark.createDataFrame([(1, data), (2, b"PK\x03\x04" * 60)], "media int, content binary")
    boxes = containers.mp4_boxes(files, K)
    assert boxes.filter("media = 1").count() == 7001 and boxes.filter("type = 'mdat'").first()["size"] == 20
    hits = containers.magic_hits(files, K, block=7).filter("media = 2")
    assert sorted(r.offset for r in hits.collect()) == list(range(0, 240, 4))
    few = containers.magic_hits(files, K, most=40).filter("media = 2").collect()
    assert len(few) == 40 and all(r.truncated for r in few)
