"""Dynamic colour metadata: reference processing units of a video stream, and levels per frame or scene in JSON.

A stream's first unit gives one row for its matrices and one for each piece of a reshaping curve; what follows from them
is columns (functions.colour).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.functions.colour import pq_nits

from .containers import Bits, exploded, nal_units, without_escapes

#: NAL unit type that carries a reference processing unit, and the first byte of its payload.
RPU_TYPE, RPU_PREFIX = 62, 0x19
#: What a source peak of 0 stands for, as a 12-bit PQ code.
DEFAULT_PEAK = 3696


class Unsupported(ValueError):
    """The unit is well-formed, but of a kind that isn't read (residual layers, compressed or referenced metadata)."""


def _need(condition: bool) -> None:
    if not condition:
        raise Unsupported


def _fixed(bits: Bits, fraction: int) -> float:
    """A signed whole part, then `fraction` binary places."""
    whole = bits.signed()
    return whole + bits.take(fraction) / (1 << fraction)


def _signed16(bits: Bits) -> int:
    value = bits.take(16)
    return value - (value >> 15 << 16)


def _layout(bits: Bits) -> tuple[int, int]:
    """(bit depth of the base layer, binary places of coefficients) from the unit's header."""
    _need(bits.take(6) == 2)
    coded_apart = bool(bits.take(11) & 0x700)
    bits.take(8)
    depth, fraction = 10, 23
    if bits.take(1):
        bits.take(1)
        kind = bits.take(2)
        _need(kind < 2)
        fraction = 32 if kind else bits.unsigned()
        bits.take(3)
        if not coded_apart:
            depth = 8 + bits.unsigned()
            bits.unsigned(), bits.unsigned(), bits.take(1)
            compressed = bits.take(3) == 1
            bits.take(1)
            _need(bool(bits.take(1)) and not compressed)  # no residual layer
    has_levels, refers_back = bits.take(1), bits.take(1)
    _need(has_levels and not refers_back)
    return depth, fraction


def _pieces(bits: Bits, depth: int, fraction: int) -> list[dict]:
    """The pieces of the three reshaping curves: where one holds, its kind, and its coefficients in their order."""
    for _ in range(3):
        bits.unsigned()
    bounds = [[bits.take(depth) / ((1 << depth) - 1) for _ in range(bits.unsigned() + 2)] for _ in range(3)]
    bits.unsigned(), bits.unsigned()
    out = []
    for component, pivots in enumerate(bounds):
        for place, (low, high) in enumerate(zip(pivots, pivots[1:], strict=False)):
            kind = bits.unsigned()
            _need(kind < 2)
            if kind:
                n = 1 + 7 * (bits.take(2) + 1)
            else:
                n = bits.unsigned() + 2
                _need(n > 2 or not bits.take(1))
            out.append({"component": component, "piece": place, "low": low, "high": high, "kind": ("polynomial", "mmr")[kind], "coefficients": [_fixed(bits, fraction) for _ in range(n)]})
    return out


def rpu_of(payload: bytes) -> dict | None:
    """Matrices (rows first), offsets, source range and curve pieces of one unit's payload; None if it isn't read."""
    if payload[:1] != bytes([RPU_PREFIX]):
        return None
    bits = Bits(payload[1:])
    try:
        pieces = _pieces(bits, *_layout(bits))
        for _ in range(3):
            bits.unsigned()
        to_lms = [_signed16(bits) / (1 << 13) for _ in range(9)]
        offset = [bits.take(32) / (1 << 28) for _ in range(3)]
        to_rgb = [_signed16(bits) / (1 << 14) for _ in range(9)]
        bits.take(64 + 16 + 11)  # the signal's transfer and layout
        low, high = bits.take(12), bits.take(12)
    except ValueError:
        return None
    return {"nonlinear": to_lms, "offset": offset, "linear": to_rgb, "source_min_pq": low, "source_max_pq": high or DEFAULT_PEAK, "pieces": pieces}


def first_rpu(stream: bytes) -> dict | None:
    """The first reference processing unit of an Annex B stream."""
    for unit in nal_units(stream):
        if len(unit) > 2 and unit[0] >> 1 & 63 == RPU_TYPE:
            return rpu_of(without_escapes(unit[2:]))
    return None


def colour_matrices(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, nonlinear, offset, linear, source_min_pq, source_max_pq) of each stream that has a unit that is read."""

    def parse(stream: bytes) -> Iterator[tuple]:
        found = first_rpu(stream)
        if found:
            yield found["nonlinear"], found["offset"], found["linear"], found["source_min_pq"], found["source_max_pq"]

    return exploded(files, parse, "nonlinear array<double>, offset array<double>, linear array<double>, source_min_pq int, source_max_pq int", keys)


def curve_pieces(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, component, piece, low, high, kind, coefficients) of each stream's first unit."""

    def parse(stream: bytes) -> Iterator[tuple]:
        for p in (first_rpu(stream) or {"pieces": []})["pieces"]:
            yield p["component"], p["piece"], p["low"], p["high"], p["kind"], p["coefficients"]

    return exploded(files, parse, "component int, piece int, low double, high double, kind string, coefficients array<double>", keys)


def level_rows(docs: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """(keys, frame, min_nits, max_nits, avg_nits): the levels of each frame of an export in JSON, in whole nits; a frame
    without a block of level 1 has its own numbers."""
    levels = "min_pq: int, max_pq: int, avg_pq: int"
    frame = f"struct<vdr_dm_data: struct<{levels}, ext_metadata_blocks: array<struct<level: int, {levels}>>>>"
    rows = docs.select(*keys, F.posexplode(F.from_json(body, f"array<{frame}>")).alias("frame", "f")).withColumn("d", F.col("f.vdr_dm_data"))
    block = F.element_at(F.filter("d.ext_metadata_blocks", lambda b: b.level == 1), -1)
    of = lambda name: F.when(F.size(F.filter("d.ext_metadata_blocks", lambda b: b.level == 1)) > 0, block[name]).otherwise(F.col("d")[name])
    nits = lambda name: F.when(of(name).isNotNull(), F.rint(pq_nits(of(name) / 4095)).cast("long"))
    return rows.select(*keys, "frame", nits("min_pq").alias("min_nits"), nits("max_pq").alias("max_nits"), nits("avg_pq").alias("avg_nits"))


def scene_levels(docs: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """(keys, frame, avg_maxrgb, maxscl, target_nits) of each scene of an HDR10+ export in JSON."""
    scene = "struct<SceneFrameIndex: int, TargetedSystemDisplayMaximumLuminance: int, LuminanceParameters: struct<AverageRGB: double, MaxScl: array<double>>>"
    rows = docs.select(*keys, F.explode(F.from_json(body, f"struct<SceneInfo: array<{scene}>>")["SceneInfo"]).alias("s"))
    light = F.col("s.LuminanceParameters")
    return rows.select(*keys, F.col("s.SceneFrameIndex").alias("frame"), light.AverageRGB.alias("avg_maxrgb"), F.array_max(light.MaxScl).alias("maxscl"), F.col("s.TargetedSystemDisplayMaximumLuminance").alias("target_nits"))


def rationals(text: Column, n: int) -> Column:
    """The first n numbers or fractions of a list in text; null unless all n are numbers."""
    words = F.slice(F.split(F.trim(text), r"\s+"), 1, n)
    value = lambda w: F.when(F.contains(w, F.lit("/")), F.try_divide(F.split_part(w, F.lit("/"), F.lit(1)).try_cast("double"), F.coalesce(F.nullif(F.split_part(w, F.lit("/"), F.lit(2)).try_cast("double"), F.lit(0.0)), F.when(F.split_part(w, F.lit("/"), F.lit(2)).try_cast("double") == 0, 1.0)))).otherwise(w.try_cast("double"))
    found = F.transform(words, value)
    return F.when((F.size(found) == n) & ~F.exists(found, lambda v: v.isNull()), found)


_WHOLE = r"(-?[0-9]+)"


def curves_in(document: Column) -> Column:
    """The three reshaping curves of a side-data document in JSON: an array of three arrays of (low, high, kind,
    coefficients), as functions.colour takes them; null unless all three are whole.

    Bounds are codes of bl_bit_depth bits (10 by default), coefficients whole numbers over 2 to the coef_log2_denom (23 by
    default); lists may be JSON or text. A polynomial has coefficients, a regression of order 1 to 3 a constant and seven
    for each order.
    """
    piece = "struct<mapping_idc: string, mapping_idc_name: string, poly_coef: string, mmr_order: int, mmr_constant: long, mmr_coef: string>"
    side = F.from_json(document, f"struct<coef_log2_denom: int, bl_bit_depth: int, components: array<struct<pivots: string, pieces: array<{piece}>>>, component_list: array<struct<pivots: string, piece_list: array<{piece}>>>>")
    numbers = lambda text: F.transform(F.regexp_extract_all(text, F.lit(_WHOLE), F.lit(1)), lambda v: v.cast("double"))
    one = lambda value, use: F.transform(F.array(value), use)[0]  # worked out once
    share = F.pow(F.lit(2.0), F.coalesce(side.coef_log2_denom, F.lit(23)))
    top = F.pow(F.lit(2.0), F.coalesce(side.bl_bit_depth, F.lit(10))) - 1

    def shaped(p: Column) -> Column:
        named = F.nullif(p.mapping_idc_name, F.lit(""))
        kind = F.when(F.coalesce(named == "polynomial", p.mapping_idc == "0", F.lit(False)), "polynomial").otherwise("mmr")
        poly, mmr = numbers(F.coalesce(p.poly_coef, F.lit(""))), numbers(F.coalesce(p.mmr_coef, F.lit("")))
        order = p.mmr_order.between(1, 3) & (F.size(mmr) == 7 * p.mmr_order)
        weights = F.when(kind == "polynomial", F.when(F.size(poly) > 0, poly)).when(order, F.concat(F.array(F.coalesce(p.mmr_constant, F.lit(0)).cast("double")), mmr))
        return F.struct(kind.alias("kind"), F.transform(weights, lambda v: v / share).alias("coefficients"))

    def curve(pivots: Column, pieces: Column) -> Column:
        bounds = F.transform(numbers(pivots), lambda v: v / top)
        joined = lambda b: F.zip_with(F.zip_with(F.slice(b, F.lit(1), F.size(b) - 1), F.slice(b, F.lit(2), F.size(b) - 1), lambda x, y: F.struct(x.alias("low"), y.alias("high"))), F.transform(pieces, shaped), lambda s, p: F.struct(s.low.alias("low"), s.high.alias("high"), p.kind.alias("kind"), p.coefficients.alias("coefficients")))
        return one(bounds, lambda b: F.when((F.size(b) >= 2) & (F.size(pieces) == F.size(b) - 1), joined(b)))

    found = F.coalesce(F.transform(side.components, lambda c: curve(c.pivots, c.pieces)), F.transform(side.component_list, lambda c: curve(c.pivots, c.piece_list)))
    whole = lambda cs: F.when((F.size(cs) >= 3) & F.forall(F.slice(cs, 1, 3), lambda c: c.isNotNull() & F.forall(c, lambda p: p.coefficients.isNotNull())), F.slice(cs, 1, 3))
    return one(found, whole)


def side_data_colour(docs: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """(keys, nonlinear, offset, linear, source_max_pq, curves) of side-data documents with all three matrices; curves are
    null where they aren't whole, which means a signal that isn't reshaped."""
    side = F.from_json(body, "struct<ycc_to_rgb_matrix: string, ycc_to_rgb_offset: string, rgb_to_lms_matrix: string, source_max_pq: int>")
    found = docs.select(*keys, side.alias("s"), F.col(body).alias("doc"))
    read = found.select(*keys, rationals(F.col("s.ycc_to_rgb_matrix"), 9).alias("nonlinear"), rationals(F.col("s.ycc_to_rgb_offset"), 3).alias("offset"), rationals(F.col("s.rgb_to_lms_matrix"), 9).alias("linear"), F.coalesce(F.nullif("s.source_max_pq", F.lit(0)), F.lit(DEFAULT_PEAK)).alias("source_max_pq"), curves_in(F.col("doc")).alias("curves"))
    return read.filter(F.col("nonlinear").isNotNull() & F.col("offset").isNotNull() & F.col("linear").isNotNull())


def colour_chain(media: DataFrame, side_data: DataFrame, streams: DataFrame, keys: list[str]) -> DataFrame:
    """media plus (source, nonlinear, offset, linear, source_max_pq, curves): by the side data if it has the matrices, else by
    the stream's own units, else null. Each of the two has one row for a key at most."""
    fields = ("nonlinear", "offset", "linear", "source_max_pq", "curves")
    named = lambda df, source: df.select(*keys, F.struct(F.lit(source).alias("source"), *(F.col(c) for c in fields)).alias(source))
    both = media.join(named(side_data, "side data"), keys, "left").join(named(streams, "stream"), keys, "left")
    chosen = both.withColumn("chosen", F.coalesce(F.col("`side data`"), F.col("stream")))
    return chosen.select(*(F.col(f"`{c}`") for c in media.columns), *(F.col("chosen").getField(c).alias(c) for c in ("source", *fields)))
