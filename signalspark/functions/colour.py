"""Colour science as Column expressions: transfer curves, luma, chroma, chromaticities, light levels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: SMPTE ST 2084 (PQ)
PQ_M1, PQ_M2, PQ_C1, PQ_C2, PQ_C3 = 0.1593017578125, 78.84375, 0.8359375, 18.8515625, 18.6875
# fixed values: ARIB STD-B67 (HLG)
HLG_A, HLG_B, HLG_C = 0.17883277, 0.28466892, 0.55991073
# fixed values: luma weights of the primaries
LUMA = {"709": (0.2126, 0.7152, 0.0722), "2020": (0.2627, 0.6780, 0.0593), "p3": (0.22897, 0.69174, 0.07929)}
# fixed values: divisors of B-Y and R-Y
CHROMA = {"709": (1.8556, 1.5748), "2020": (1.8814, 1.4746)}
# fixed values: linear RGB to CIE XYZ (D65)
XYZ = {
    "709": ((0.4123908, 0.3575843, 0.1804808), (0.2126390, 0.7151687, 0.0721923), (0.0193308, 0.1191948, 0.9505322)),
    "2020": ((0.6369580, 0.1446169, 0.1688810), (0.2627002, 0.6779981, 0.0593017), (0.0, 0.0280727, 1.0609851)),
    "p3": ((0.4865709, 0.2656677, 0.1982173), (0.2289746, 0.6917385, 0.0792869), (0.0, 0.0451134, 1.0439444)),
}
# fixed values: xy of the red, green and blue primaries
TRIANGLE = {"709": ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06)), "2020": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046)), "p3": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060))}


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x held between two values; null counts as the lower (a condition here would keep Spark from sharing what several
    channels work out)."""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def pq_eotf(signal: Column, floor: float = 1e-7) -> Column:
    """PQ signal (0 to 1) to light relative to 10,000 nits."""
    p = F.pow(clip(signal), F.lit(1 / PQ_M2))
    return F.pow(F.greatest(p - PQ_C1, F.lit(0.0)) / F.greatest(PQ_C2 - PQ_C3 * p, F.lit(floor)), F.lit(1 / PQ_M1))


def pq_nits(signal: Column) -> Column:
    return pq_eotf(signal, floor=1e-6) * 10000.0


def pq_oetf(light: Column) -> Column:
    """Light relative to 10,000 nits to PQ signal."""
    p = F.pow(clip(light), F.lit(PQ_M1))
    return F.pow((PQ_C1 + PQ_C2 * p) / (1 + PQ_C3 * p), F.lit(PQ_M2))


def nits_to_pq(nits: Column) -> Column:
    return pq_oetf(nits / 10000.0)


def hlg_inverse_oetf(signal: Column) -> Column:
    e = clip(signal)
    return F.when(e <= 0.5, e * e / 3).otherwise((F.exp((e - HLG_C) / HLG_A) + HLG_B) / 12)


def linear(signal: Column, transfer: Column | str) -> Column:
    """Signal to linear light by the transfer's name: pq, hlg, or anything else as a 2.4 power."""
    name = F.lit(transfer) if isinstance(transfer, str) else transfer
    return F.when(name == "pq", pq_eotf(signal)).when(name == "hlg", hlg_inverse_oetf(signal)).otherwise(F.pow(clip(signal), F.lit(2.4)))


def bt709_oetf(light: Column) -> Column:
    x = clip(light)
    return F.when(x < 0.018, 4.5 * x).otherwise(1.099 * F.pow(x, F.lit(0.45)) - 0.099)


def hable(x: Column) -> Column:
    """The filmic curve with its usual constants (fixed values: A .15, B .50, C .10, D .20, E .02, F .30)."""
    return (x * (0.15 * x + 0.05) + 0.004) / (x * (0.15 * x + 0.50) + 0.06) - 0.02 / 0.30


def luma(r: Column, g: Column, b: Column, primaries: str = "709") -> Column:
    kr, kg, kb = LUMA[primaries]
    return kr * r + kg * g + kb * b


def ycbcr(r: Column, g: Column, b: Column, primaries: str = "709") -> Column:
    """A struct (y, cb, cr) of signal values."""
    y = luma(r, g, b, primaries)
    cb, cr = CHROMA["2020" if primaries == "2020" else "709"]
    return F.struct(y.alias("y"), ((b - y) / cb).alias("cb"), ((r - y) / cr).alias("cr"))


def chromaticity(r: Column, g: Column, b: Column, primaries: str = "709") -> Column:
    """A struct (x, y) of linear RGB; black has none."""
    big = [m[0] * r + m[1] * g + m[2] * b for m in XYZ[primaries]]
    total = big[0] + big[1] + big[2]
    at = lambda v: F.when(total > 1e-9, v / total)
    return F.struct(at(big[0]).alias("x"), at(big[1]).alias("y"))


def outside(x: Column, y: Column, primaries: str = "709", tolerance: float = 1e-3) -> Column:
    """Whether a chromaticity lies outside the triangle of the primaries, by over `tolerance` from an edge."""
    corners = TRIANGLE[primaries]
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(corners, (*corners[1:], corners[0]), strict=True))
    turn = 1.0 if area > 0 else -1.0
    beyond = None
    for (ax, ay), (bx, by) in zip(corners, (*corners[1:], corners[0]), strict=True):
        length = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        distance = ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) * (turn / length)
        far = distance < -tolerance
        beyond = far if beyond is None else beyond | far
    return beyond


def polar(cb: Column, cr: Column) -> Column:
    """A struct (angle in degrees, saturation) of chroma."""
    return F.struct(F.pmod(F.degrees(F.atan2(cr, cb)), F.lit(360.0)).alias("angle"), F.sqrt(cb * cb + cr * cr).alias("saturation"))


#: Upper ends of the false-colour bands, in nits.
NITS_BANDS = (0.05, 1.0, 10.0, 100.0, 203.0, 400.0, 1000.0, 4000.0)


def nits_band(nits: Column) -> Column:
    """The number of the band, 0 to 8."""
    band = F.when(nits < NITS_BANDS[0], 0)
    for k, end in enumerate(NITS_BANDS[1:], 1):
        band = band.when(nits < end, k)
    return band.otherwise(len(NITS_BANDS))


def _product(matrix: tuple, vector: list[Column]) -> list[Column]:
    return [row[0] * vector[0] + row[1] * vector[1] + row[2] * vector[2] for row in matrix]


def to_709(r: Column, g: Column, b: Column, primaries: str = "709") -> Column:
    """A struct (r, g, b) of linear light in BT.709 primaries, by way of XYZ; unknown primaries count as BT.709."""
    rgb = [r, g, b]
    if primaries in XYZ and primaries != "709":
        matrix = np.linalg.inv(np.array(XYZ["709"])) @ np.array(XYZ[primaries])
        rgb = _product(matrix.tolist(), rgb)
    return F.struct(*(c.alias(n) for c, n in zip(rgb, "rgb", strict=True)))


# fixed values: stops of the false-colour scale, by 8-bit luma
FALSE_STOPS = ((0, 40, 30, 90), (16, 30, 60, 180), (45, 40, 160, 160), (110, 60, 170, 60), (128, 150, 150, 150), (180, 210, 200, 70), (235, 235, 140, 40), (254, 240, 80, 40), (255, 255, 40, 40))


def false_colour(level: Column) -> Column:
    """A struct (r, g, b) of 8-bit values for an 8-bit luma: whole parts of the line between two stops."""
    v = F.floor(clip(level, 0, 255))

    def channel(k: int) -> Column:
        out = F.lit(FALSE_STOPS[-1][k])
        for low, high in reversed(list(zip(FALSE_STOPS, FALSE_STOPS[1:], strict=False))):
            out = F.when(v < high[0], F.expr("0") + low[k] + (high[k] - low[k]) * (v - low[0]) / (high[0] - low[0])).otherwise(out)
        return F.floor(out).cast("int")

    return F.struct(channel(1).alias("r"), channel(2).alias("g"), channel(3).alias("b"))


def chart_place(x: Column, y: Column, size: int) -> Column:
    """A struct (px, py): where a chromaticity stands on a square chart of x to 0.8 and y to 0.9, y upwards."""
    at = lambda v, top: clip(v / top) * (size - 1)
    return F.struct(F.floor(at(x, 0.8)).cast("int").alias("px"), F.floor((size - 1) - at(y, 0.9)).cast("int").alias("py"))


# ---- reshaped IPT signals

# fixed values: LMS to linear BT.2020 RGB
LMS_TO_2020 = ((3.06441879, -2.16597676, 0.10155818), (-0.65612108, 1.78554118, -0.12943749), (0.01736321, -0.04725154, 1.03004253))


def polynomial(x: Column, coefficients: Column) -> Column:
    """The value of a polynomial, lowest coefficient first."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, c: acc * x + c)


def regression(signal: list[Column], coefficients: Column) -> Column:
    """A constant and, for each order, seven products of the three signals, each to the power of the order."""
    a, b, c = signal
    terms = F.array(a, b, c, a * b, a * c, b * c, a * b * c)
    weights = F.slice(coefficients, 2, F.greatest(F.size(coefficients) - 1, F.lit(0)))
    powered = F.transform(weights, lambda w, i: w * F.pow(F.get(terms, i % 7), F.floor(i / 7) + 1))
    return F.aggregate(powered, F.element_at(coefficients, 1), lambda acc, v: acc + v)


def reshaped(signal: list[Column], component: int, pieces: Column) -> Column:
    """A component of a signal (0 to 1) through the pieces of its curve, an array of structs (low, high, kind,
    coefficients) in order; as it is without pieces. The ends of the curve bound what goes in and what comes out."""
    low, high = F.element_at(pieces, 1)["low"], F.element_at(pieces, -1)["high"]
    x = F.least(F.greatest(signal[component], low), high)
    piece = F.coalesce(F.get(F.filter(pieces, lambda p: (x >= p["low"]) & (x < p["high"])), F.lit(0)), F.element_at(pieces, -1))
    value = F.when(piece["kind"] == "polynomial", polynomial(x, piece["coefficients"])).otherwise(regression(signal, piece["coefficients"]))
    return F.when(F.size(pieces) > 0, F.least(F.greatest(value, low), high)).otherwise(signal[component])


def ipt_linear(signal: list[Column], nonlinear: Column, offset: Column, linear: Column) -> Column:
    """A struct (r, g, b) of linear BT.2020 light, 1 for 10,000 nits, of a reshaped IPT signal; the matrices are arrays of
    nine values, rows first."""
    row = lambda m, k, v: F.get(m, F.lit(3 * k)) * v[0] + F.get(m, F.lit(3 * k + 1)) * v[1] + F.get(m, F.lit(3 * k + 2)) * v[2]
    centred = [s - F.get(offset, F.lit(k)) for k, s in enumerate(signal)]
    light = [pq_eotf(row(nonlinear, k, centred)) for k in range(3)]
    lms = [row(linear, k, light) for k in range(3)]
    return F.struct(*(F.greatest(v, F.lit(0.0)).alias(n) for v, n in zip(_product(LMS_TO_2020, lms), "rgb", strict=True)))


def unshaped(value: Column, pieces: Column, steps: int = 52) -> Column:
    """What `reshaped` makes the value of, for a curve of polynomials that nowhere falls: the least such signal to within
    2**-steps of the curve's range; an end of the range for values beyond what the curve reaches, null for other curves,
    and the value itself without pieces.

    The range is halved `steps` times, a fold of fixed length, so there is no test of convergence.
    """
    low, high = F.element_at(pieces, 1)["low"], F.element_at(pieces, -1)["high"]

    def curve(x: Column) -> Column:
        piece = F.coalesce(F.get(F.filter(pieces, lambda p: (x >= p["low"]) & (x < p["high"])), F.lit(0)), F.element_at(pieces, -1))
        return polynomial(x, piece["coefficients"])

    def halved(span: Column, _: Column) -> Column:
        middle = (span["low"] + span["high"]) / 2
        below = curve(middle) < value
        return F.struct(F.when(below, middle).otherwise(span["low"]).alias("low"), F.when(below, span["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(low.cast("double").alias("low"), high.cast("double").alias("high")), halved)["high"]
    return F.when(F.size(pieces) == 0, value).when(F.forall(pieces, lambda p: p["kind"] == "polynomial") & value.isNotNull(), found)


def inverse(matrix: Column) -> Column:
    """The inverse of an array of nine values, rows first; null where there is none."""
    m = [F.get(matrix, F.lit(k)) for k in range(9)]
    minor = lambda r, c: m[(r + 1) % 3 * 3 + (c + 1) % 3] * m[(r + 2) % 3 * 3 + (c + 2) % 3] - m[(r + 1) % 3 * 3 + (c + 2) % 3] * m[(r + 2) % 3 * 3 + (c + 1) % 3]
    whole = m[0] * minor(0, 0) + m[1] * minor(0, 1) + m[2] * minor(0, 2)
    return F.when(whole != 0, F.array(*(minor(c, r) / whole for r in range(3) for c in range(3))))


def ipt_encoded(rgb: list[Column], nonlinear: Column, offset: Column, linear: Column) -> Column:
    """An array of the three signals (not held to 0 to 1) of which ipt_linear makes this linear BT.2020 light, 1 for 10,000 nits."""
    lms_2020 = np.linalg.inv(np.array(LMS_TO_2020)).tolist()
    row = lambda m, k, v: F.get(m, F.lit(3 * k)) * v[0] + F.get(m, F.lit(3 * k + 1)) * v[1] + F.get(m, F.lit(3 * k + 2)) * v[2]
    lms = [row(inverse(linear), k, _product(lms_2020, rgb)) for k in range(3)]
    signal = [pq_oetf(v) for v in lms]
    return F.array(*(row(inverse(nonlinear), k, signal) + F.get(offset, F.lit(k)) for k in range(3)))


def ipt_native(signal: list[Column], nonlinear: Column, offset: Column, linear: Column) -> Column:
    """A struct (r, g, b) of BT.2020 signals in PQ of a reshaped IPT signal: what an HDR10 picture of it would hold."""
    light = ipt_linear(signal, nonlinear, offset, linear)
    return F.struct(*(pq_oetf(light[n]).alias(n) for n in "rgb"))


def displayed(rgb: Column, peak: Column, white_nits: float = 100.0) -> Column:
    """A struct (r, g, b) of 8-bit BT.709 values: linear BT.2020 light (1 for 10,000 nits) through the filmic curve on its
    largest channel, up to the source's peak in nits."""
    white = [rgb[n] * (10000 / white_nits) for n in "rgb"]
    top = F.greatest(*white, F.lit(1e-6))
    most = F.greatest(F.lit(1.0), F.least(peak, F.lit(10000.0)) / white_nits)
    scale = hable(F.least(top, most)) / hable(most) / top
    narrow = to_709(*(v * scale for v in white), "2020")
    return F.struct(*(F.floor(clip(bt709_oetf(narrow[n]) * 255 + 0.5, 0, 255)).cast("int").alias(n) for n in "rgb"))
