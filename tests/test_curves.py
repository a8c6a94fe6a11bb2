"""Curves in JSON, their inverse, and the choice of a file's colour metadata."""

import json

from pyspark.sql import functions as F

from signalspark.functions import colour
from signalspark.sources import dynamic

KIND = "array<struct<low: double, high: double, kind: string, coefficients: array<double>>>"


def side(**more):
    piece = {"mapping_idc_name": "polynomial", "poly_coef": [1 << 20, 1 << 22]}
    mmr = {"mapping_idc": 1, "mmr_order": 1, "mmr_constant": 1 << 22, "mmr_coef": list(range(7))}
    good = {"pivots": [0, 512, 1023], "pieces": [piece, piece]}
    return {"components": [good, {"pivots": "0 1023", "pieces": [mmr]}, good]} | more


def curves(spark, *documents):
    rows = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)], "k int, body string")
    return [r.c for r in rows.select("k", dynamic.curves_in(F.col("body")).alias("c")).orderBy("k").collect()]


def test_curves_are_read_or_null(spark):
    good = side()
    short = json.loads(json.dumps(good))
    short["components"][1]["pieces"][0]["mmr_coef"] = [1, 2]
    order = json.loads(json.dumps(good))
    order["components"][1]["pieces"][0]["mmr_order"] = 4
    pivots = json.loads(json.dumps(good))
    pivots["components"][0]["pivots"] = [0, 1023]
    empty = json.loads(json.dumps(good))
    empty["components"][2]["pieces"][1]["poly_coef"] = []
    lists = {"coef_log2_denom": 10, "bl_bit_depth": 8, "component_list": [{"pivots": [0, 255], "piece_list": [{"mapping_idc": "0", "poly_coef": "512 -1024"}]}] * 3}
    found = curves(spark, good, short, order, pivots, empty, {"components": good["components"][:2]}, "no json", "{}", lists, side(bl_bit_depth=12))
    first = found[0]
    assert [p.kind for c in first for p in c] == ["polynomial", "polynomial", "mmr", "polynomial", "polynomial"]
    assert first[0][0].low == 0 and first[0][0].high == first[0][1].low == 512 / 1023 and first[0][1].high == 1
    assert first[0][0].coefficients == [0.125, 0.5] and first[1][0].coefficients == [0.5, *(k / (1 << 23) for k in range(7))]
    assert found[1:8] == [None] * 7
    assert found[8][2][0].coefficients == [0.5, -1.0] and found[9][0][1].high == 1023 / 4095


def test_inverse_of_a_rising_curve(spark):
    pieces = [(0.0625, 0.4, "polynomial", [0.05, 0.4, 0.5]), (0.4, 0.9375, "polynomial", [0.13, 0.6, 0.2])]
    rows = spark.createDataFrame([(x / 500, pieces) for x in range(501)] + [(0.3, [])], f"x double, p {KIND}")
    back = rows.withColumn("y", colour.reshaped([F.col("x")] * 3, 0, F.col("p"))).withColumn("back", colour.unshaped(F.col("y"), F.col("p"))).collect()
    assert back[-1].back == 0.3
    assert all(abs(r.back - min(max(r.x, 0.0625), 0.9375)) < 1e-12 for r in back[:-1] if 0.0625 < r.y < 0.9375 and r.p)
    other = spark.createDataFrame([(0.5, [(0.0, 1.0, "mmr", [0.1] * 8)]), (None, pieces), (-3.0, pieces), (3.0, pieces)], f"y double, p {KIND}")
    got = [r[0] for r in other.select(colour.unshaped(F.col("y"), F.col("p"))).collect()]
    assert got[:2] == [None, None] and abs(got[2] - 0.0625) < 1e-12 and got[3] == 0.9375


def test_matrices_have_inverses(spark):
    m = [2.0, 0.5, -1.0, 0.25, 3.0, 1.0, -0.5, 1.5, 4.0]
    rows = spark.createDataFrame([(m,), ([1.0] * 9,)], "m array<double>")
    a, b = (r[0] for r in rows.select(colour.inverse(F.col("m"))).collect())
    whole = [sum(m[3 * i + k] * a[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)]
    assert all(abs(v - (i % 4 == 0)) < 1e-12 for i, v in enumerate(whole)) and b is None


def test_side_data_comes_before_the_stream(spark):
    schema = f"media int, nonlinear array<double>, offset array<double>, linear array<double>, source_max_pq int, curves array<{KIND}>"
    one = [1.0] * 9
    documents = spark.createDataFrame([(1, json.dumps({"ycc_to_rgb_matrix": " ".join(["1/2"] * 9), "ycc_to_rgb_offset": "0 1 2", "rgb_to_lms_matrix": " ".join(["3"] * 9)} | side())), (2, json.dumps({"ycc_to_rgb_matrix": "1 2"})), (3, "junk"), (4, None)], "media int, body string")
    streams = spark.createDataFrame([(1, one, [9.0] * 3, one, 7, None), (2, one, [9.0] * 3, one, 7, None)], schema)
    chain = dynamic.colour_chain(documents.select("media"), dynamic.side_data_colour(documents, ["media"]), streams, ["media"])
    got = {r.media: r for r in chain.collect()}
    assert {m: r.source for m, r in got.items()} == {1: "side data", 2: "stream", 3: None, 4: None}
    assert got[1].nonlinear == [0.5] * 9 and got[1].source_max_pq == dynamic.DEFAULT_PEAK and len(got[1].curves) == 3 and got[2].source_max_pq == 7
