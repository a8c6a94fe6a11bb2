"""Reference processing units written bit by bit and read back, and what follows from them."""

import json

import pytest
from pyspark.sql import functions as F

from signalspark.functions import colour
from signalspark.sources import dynamic

K = ["media"]


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value & ((1 << n) - 1), f"0{n}b")

    def unsigned(self, value):
        digits = format(value + 1, "b")
        self.bits += "0" * (len(digits) - 1) + digits

    def signed(self, value):
        self.unsigned(2 * value - 1 if value > 0 else -2 * value)

    def fixed(self, value, places):
        whole = int(value // 1)
        self.signed(whole)
        self.put(round((value - whole) * (1 << places)), places)

    def bytes(self):
        padded = self.bits + "0" * (-len(self.bits) % 8)
        return bytes(int(padded[i : i + 8], 2) for i in range(0, len(padded), 8))


CURVES = [
    [(0, 512, "polynomial", [0.0, 1.5]), (512, 1023, "polynomial", [0.25, 0.5, -0.125])],
    [(0, 1023, "mmr", [0.5, *(k / 64 - 0.125 for k in range(7))])],
    [(0, 1023, "mmr", [-1.25, *(k / 128 for k in range(14))])],
]
MATRIX = [1.0, 0.5, -0.25, 1.0, -0.125, 0.25, 1.0, 0.0625, -0.75]


def unit(kind=2, residual=False, compressed=False, refers=False, places=20, peak=3079):
    w = Writer()
    w.put(kind, 6), w.put(0, 11), w.put(1, 8), w.put(1, 1), w.put(0, 1), w.put(0, 2), w.unsigned(places), w.put(1, 2), w.put(0, 1)
    w.unsigned(2), w.unsigned(2), w.unsigned(4), w.put(0, 1), w.put(int(compressed), 3), w.put(0, 1), w.put(int(not residual), 1)
    w.put(1, 1), w.put(int(refers), 1)
    for _ in range(3):
        w.unsigned(0)
    for pieces in CURVES:
        pivots = [p[0] for p in pieces] + [pieces[-1][1]]
        w.unsigned(len(pivots) - 2)
        for p in pivots:
            w.put(p, 10)
    w.unsigned(0), w.unsigned(0)
    for pieces in CURVES:
        for _, _, kind_of, coefficients in pieces:
            if kind_of == "polynomial":
                w.unsigned(0), w.unsigned(len(coefficients) - 2)
                if len(coefficients) == 2:
                    w.put(0, 1)
            else:
                w.unsigned(1), w.put(len(coefficients) // 7 - 1, 2)
            for c in coefficients:
                w.fixed(c, places)
    for _ in range(3):
        w.unsigned(0)
    for v in MATRIX:
        w.put(round(v * 8192), 16)
    for v in (0.0, 0.5, 0.5):
        w.put(round(v * (1 << 28)), 32)
    for v in MATRIX:
        w.put(round(v * 16384), 16)
    w.put(0, 91), w.put(62, 12), w.put(peak, 12), w.put(0, 10)
    return b"\x19" + w.bytes()


def escaped(payload):
    out, zeros = bytearray(), 0
    for byte in payload:
        if zeros >= 2 and byte <= 3:
            out.append(3)
            zeros = 0
        out.append(byte)
        zeros = zeros + 1 if byte == 0 else 0
    return bytes(out)


def stream(payload):
    return b"\0\0\0\1\x40\x01abc" + b"\0\0\1\x7c\x01" + escaped(payload) + b"\0\0\1\x02\x01xyz"


def test_units_are_read_back(spark):
    found = dynamic.rpu_of(unit())
    assert found["nonlinear"] == MATRIX and found["offset"] == [0.0, 0.5, 0.5] and (found["source_min_pq"], found["source_max_pq"]) == (62, 3079)
    assert dynamic.rpu_of(unit(peak=0))["source_max_pq"] == dynamic.DEFAULT_PEAK
    want = [(c, k, low / 1023, high / 1023, kind) for c, pieces in enumerate(CURVES) for k, (low, high, kind, _) in enumerate(pieces)]
    assert [(p["component"], p["piece"], p["low"], p["high"], p["kind"]) for p in found["pieces"]] == want
    assert [p["coefficients"] for p in found["pieces"]] == [pytest.approx(x[3], abs=2e-6) for pieces in CURVES for x in pieces]
    files = spark.createDataFrame([(1, stream(unit())), (2, b""), (3, None), (4, stream(b"\x19\0")), (5, stream(unit(residual=True)))], "media int, content binary")
    assert [(r.media, r.linear) for r in dynamic.colour_matrices(files, K).collect()] == [(1, pytest.approx(MATRIX, abs=1e-4))]
    assert dynamic.curve_pieces(files, K).count() == 4


def test_units_that_are_not_read():
    for payload in (b"", b"\x18abc", unit(kind=3), unit(residual=True), unit(compressed=True), unit(refers=True), unit()[:40]):
        assert dynamic.rpu_of(payload) is None


def test_signals_are_reshaped(spark):
    files = spark.createDataFrame([(1, stream(unit()))], "media int, content binary")
    pieces = dynamic.curve_pieces(files, K).groupBy("component").agg(F.array_sort(F.collect_list(F.struct("piece", "low", "high", "kind", "coefficients"))).alias("p"))
    curve = {r.component: r.p for r in pieces.collect()}
    table = spark.createDataFrame([(0.2, 0.4, 0.6), (0.9, 0.1, 0.3)], "i double, t double, u double")
    for row in table.crossJoin(pieces).select("i", "t", "u", "component", *(colour.reshaped([F.col(c) for c in "itu"], k, F.col("p")).alias(f"y{k}") for k in range(3))).collect():
        s = [row.i, row.t, row.u]
        for p in curve[row.component]:
            x = s[row.component]
            if not p.low <= x < p.high:
                continue
            if p.kind == "polynomial":
                y = sum(c * x**k for k, c in enumerate(p.coefficients))
            else:
                terms = [s[0], s[1], s[2], s[0] * s[1], s[0] * s[2], s[1] * s[2], s[0] * s[1] * s[2]]
                y = p.coefficients[0] + sum(c * terms[k % 7] ** (k // 7 + 1) for k, c in enumerate(p.coefficients[1:]))
            assert row[f"y{row.component}"] == pytest.approx(min(1, max(0, y)), abs=1e-9)
    plain = colour.reshaped([F.col(c) for c in "itu"], 1, F.array().cast("array<struct<low: double, high: double, kind: string, coefficients: array<double>>>"))
    assert [r.y for r in table.select(plain.alias("y")).collect()] == [0.4, 0.1]


def test_grey_stays_grey_on_display(spark):
    light = F.struct(*(F.lit(v).alias(n) for v, n in zip((0.005, 0.005, 0.005), "rgb", strict=True)))
    out = spark.range(1).select(colour.displayed(light, F.lit(1000.0)).alias("c")).select("c.*").first()
    assert max(out) - min(out) <= 1 and 100 < out.r < 255


def test_levels_of_frames_without_a_block(spark):
    docs = spark.createDataFrame([(1, json.dumps([{"vdr_dm_data": {"min_pq": 0, "max_pq": 4095, "avg_pq": 0}}, {"vdr_dm_data": {"ext_metadata_blocks": [{"level": 1, "max_pq": 0}]}}])), (2, "junk")], "media int, body string")
    assert [(r.frame, r.max_nits, r.avg_nits) for r in dynamic.level_rows(docs, K).collect()] == [(0, 10000, 0), (1, 0, None)]
