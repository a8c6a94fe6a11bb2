"""Per-image measures: images (keys, frame, h, w, c, pixels binary) are rows, each measured by itself in an Arrow
function; what follows over frames is columns and windows. Pixels are 8-bit, in BGR order where there are three."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalspark.functions.text import evenly_spaced

from .series import along


def array_of(pixels: bytes, h: int, w: int, c: int) -> np.ndarray:
    shape = (h, w, c) if c > 1 else (h, w)
    return np.frombuffer(pixels, np.uint8).reshape(shape)


def gray(image: np.ndarray) -> np.ndarray:
    """BT.709 luma of a BGR image, as float."""
    return image.astype(np.float64) if image.ndim == 2 else image.astype(np.float64) @ np.array([0.0722, 0.7152, 0.2126])


def measured(measure: Callable[[np.ndarray], float | None]) -> Callable[..., Column]:
    """A column function (pixels, h, w, c) of a measure of one image's luma; null where the measure doesn't apply."""

    def of(pixels: str = "pixels", h: str = "h", w: str = "w", c: str = "c") -> Column:
        @F.pandas_udf(T.DoubleType())
        def apply(p: pd.Series, hs: pd.Series, ws: pd.Series, cs: pd.Series) -> pd.Series:
            return pd.Series([measure(gray(array_of(*x))) for x in zip(p, hs, ws, cs, strict=True)], dtype="float64")

        return apply(pixels, h, w, c)

    return of


def shifted(x: np.ndarray, dy: int, dx: int) -> np.ndarray:
    return np.roll(np.pad(x, 1, mode="edge"), (-dy, -dx), (0, 1))[1:-1, 1:-1]


def median3(x: np.ndarray) -> np.ndarray:
    return np.median(np.stack([shifted(x, a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]), axis=0)


def box_mean(x: np.ndarray, k: int) -> np.ndarray:
    pad = np.pad(x, k // 2, mode="reflect")
    s = np.pad(pad.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)


def local_std(x: np.ndarray, k: int = 5) -> np.ndarray:
    m = box_mean(x, k)
    return np.sqrt(np.maximum(box_mean(x * x, k) - m * m, 0))


def _blockiness(x: np.ndarray, size: int = 8) -> float | None:
    """How much steeper the steps over block edges are than others, of both directions; null for a small or flat picture."""
    at_edge, inside = [], []
    for axis in (0, 1):
        step = np.abs(np.diff(x, axis=axis)).mean(axis=1 - axis)
        edge = np.arange(1, len(step) + 1) % size == 0
        if not edge.any() or edge.all():
            return None
        at_edge.append(step[edge].mean())
        inside.append(step[~edge].mean())
    return float(sum(at_edge) / sum(inside) - 1) if sum(inside) >= 0.1 else None


def _noise(x: np.ndarray) -> float:
    r = x - median3(x)
    return float(1.4826 * np.median(np.abs(r)))


def _double_quantised(x: np.ndarray, size: int = 8) -> float:
    """How periodic the histogram of one DCT coefficient is: the strongest frequency from the second on, as a share of
    all but the constant; 0 for fewer than 16 blocks."""
    h, w = (n // size * size for n in x.shape)
    if h * w < 16 * size * size:
        return 0.0
    wave = np.cos((2 * np.arange(size) + 1) * np.pi * 2 / (2 * size)) * np.sqrt(2 / size)
    blocks = x[:h, :w].reshape(h // size, size, w // size, size)
    counts = np.histogram(np.einsum("i,aibj,j->ab", wave, blocks, wave), bins=64, range=(-40, 40))[0]
    power = np.abs(np.fft.rfft(counts - counts.mean()))[1:]
    return float(power[1:].max() / power.sum()) if power.sum() > 0 else 0.0


def blurred(x: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian blur, edges mirrored."""
    reach = int(4 * sigma)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    for axis in (0, 1):
        padded = np.pad(x, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
        x = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1, axis=axis) @ weights
    return x


def line_means(x: np.ndarray, size: int = 11, angles: int = 8) -> np.ndarray:
    """For each of the angles the mean along a line of `size` pixels through each pixel, edges mirrored."""
    half = size // 2
    padded = np.pad(x, half, mode="reflect")
    h, w = x.shape
    out = []
    for k in range(angles):
        steps = {(round(r * np.sin(k * np.pi / angles)), round(r * np.cos(k * np.pi / angles))) for r in range(-half, half + 1)}
        out.append(sum(padded[half + dy : half + dy + h, half + dx : half + dx + w] for dy, dx in sorted(steps)) / len(steps))
    return np.stack(out)


def regions(mask: np.ndarray) -> np.ndarray:
    """A number for each pixel's region of touching pixels (diagonals too), 0 outside: labels flow to the least one."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    far = mask.size + 1
    while True:
        near = np.where(mask, label, far)
        for axis in (0, 1):
            pad = np.pad(near, [(1, 1) if k == axis else (0, 0) for k in (0, 1)], constant_values=far)
            near = np.minimum.reduce([np.take(pad, range(s, s + mask.shape[axis]), axis=axis) for s in range(3)])
        least = np.where(mask, near, 0)
        least = np.where(mask, np.append(0, least.ravel())[least], 0)  # and on to the label of that pixel
        if (least == label).all():
            return label
        label = least


def _banding(x: np.ndarray) -> float:
    """Percent of pixels on or beside contours: long thin lines in smooth parts, on which the picture stays on one side of
    its blurred self. Noise, which has no direction, cancels out along the lines."""
    off = x - blurred(x, 2.0)
    smooth = local_std(x, 9) < 3
    noise = float(np.median(np.abs(off[smooth]))) if smooth.any() else 0.0
    label = regions((np.abs(line_means(off)).max(axis=0) > max(0.22, 1.2 * noise)) & smooth)
    band = np.zeros(x.shape, bool)
    least = max(16, min(x.shape) // 16)
    for number in np.unique(label[label > 0]).tolist():
        rows, columns = np.nonzero(label == number)
        tall, wide = np.ptp(rows) + 1, np.ptp(columns) + 1
        long = max(tall, wide)
        if long >= least and (len(rows) <= 0.35 * tall * wide or long >= 4 * min(tall, wide)):
            band[rows, columns] = True
    wider = np.pad(band, 1)
    h, w = x.shape
    return float(100 * np.logical_or.reduce([wider[a : a + h, b : b + w] for a in range(3) for b in range(3)]).mean())


def _head_switch(x: np.ndarray, band: int = 6) -> float:
    """How rough the last rows are against the body; 0 for a picture with too few rows."""
    if x.shape[0] < 4 * band:
        return 0.0
    rough = np.abs(np.diff(x, axis=1))
    return float(rough[-band:].mean() / (rough[x.shape[0] // 4 : -2 * band].mean() + 1e-3))


def _noise_spread(x: np.ndarray, block: int = 16) -> float | None:
    """How far the noise of blocks lies from the usual block's: the 95th percentile, against the median or 0.15."""
    h, w = (n // block for n in x.shape)
    if h < 2 or w < 2:
        return None
    r = (x - median3(x))[: h * block, : w * block].reshape(h, block, w, block).std(axis=(1, 3))
    usual = np.median(r)
    return float(np.percentile(np.abs(r - usual) / max(usual, 0.15), 95))


def _detail(x: np.ndarray) -> float:
    """Mean steps along rows and columns."""
    return float(np.abs(np.diff(x, axis=1)).mean() + np.abs(np.diff(x, axis=0)).mean())


def resized(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """x at h by w points, bilinear, pixel centres aligned."""
    for axis, n in ((0, h), (1, w)):
        at = np.clip((np.arange(n) + 0.5) * x.shape[axis] / n - 0.5, 0, x.shape[axis] - 1)
        low = np.minimum(at.astype(int), max(0, x.shape[axis] - 2))
        share = (at - low).reshape([-1 if k == axis else 1 for k in (0, 1)])
        x = np.take(x, low, axis) * (1 - share) + np.take(x, np.minimum(low + 1, x.shape[axis] - 1), axis) * share
    return x


def saliency_map(x: np.ndarray, size: int = 64) -> np.ndarray:
    """What stands out, 0 to 1, at the picture's size: the picture whose spectrum keeps only what departs from its
    neighbourhood in log amplitude."""
    spectrum = np.fft.fft2(resized(x, size, size))
    log = np.log(np.abs(spectrum) + 1e-8)
    odd = np.abs(np.fft.ifft2(np.exp(log - box_mean(log, 3)) * np.exp(1j * np.angle(spectrum)))) ** 2
    out = resized(blurred(odd, 2.0), *x.shape)
    out = out - out.min()
    return out / out.max() if out.max() > 0 else out


def salient_place(column: str = "pixels") -> Column:
    """A struct (x, y, share): where the most salient point is, and the mean saliency of the picture."""

    @F.pandas_udf("x int, y int, share double")
    def of(p: pd.Series, hs: pd.Series, ws: pd.Series, cs: pd.Series) -> pd.DataFrame:
        rows = []
        for v in zip(p, hs, ws, cs, strict=True):
            m = saliency_map(gray(array_of(*v)))
            y, x = np.unravel_index(int(m.argmax()), m.shape)
            rows.append((int(x), int(y), float(m.mean())))
        return pd.DataFrame(rows, columns=["x", "y", "share"])

    return of(column, "h", "w", "c")


#: Ways to look at two pictures at once: each gives the pixels of one.
VIEWS = {
    "a": lambda a, b, amplify: a,
    "b": lambda a, b, amplify: b,
    "split": lambda a, b, amplify: np.concatenate((a[:, : a.shape[1] // 2], b[:, a.shape[1] // 2 :]), axis=1),
    "blend": lambda a, b, amplify: np.rint((a.astype(float) + b) / 2).astype(np.uint8),
    "diff": lambda a, b, amplify: np.minimum(np.abs(a.astype(int) - b) * amplify, 255).astype(np.uint8),
    "heat": lambda a, b, amplify: np.minimum((np.abs(a.astype(int) - b) if a.ndim == 2 else np.abs(a.astype(int) - b).max(axis=2)) * amplify, 255).astype(np.uint8),
}


def view(mode: str, amplify: int = 4) -> Column:
    """The pixels (binary) of a view of pairs (a, b, h, w, c); heat has one channel. Without b it is a."""

    @F.pandas_udf(T.BinaryType())
    def of(a: pd.Series, b: pd.Series, hs: pd.Series, ws: pd.Series, cs: pd.Series) -> pd.Series:
        rows = zip(a, b, hs, ws, cs, strict=True)
        return pd.Series([p if q is None else VIEWS[mode](array_of(p, h, w, c), array_of(q, h, w, c), amplify).tobytes() for p, q, h, w, c in rows])

    return of("a", "b", "h", "w", "c")


def row_wobble(x: np.ndarray, y: np.ndarray) -> float:
    """Mean distance of rows' sideways shifts since the picture before, in pixels, from the median shift (a pan).

    About 48 rows are looked at, those with steps in both pictures; a shift of up to two pixels is where the rows' steps
    agree best, refined by a parabola. 0 for fewer than six such rows.
    """
    rows = np.arange(8, max(8, x.shape[0] - 8), max(1, x.shape[0] // 48))
    a, b = np.diff(x[rows], axis=1), np.diff(y[rows], axis=1)
    lively = (a.std(axis=1) >= 1) & (b.std(axis=1) >= 1)
    a, b = a[lively], b[lively]
    if len(a) < 6:
        return 0.0
    agree = np.stack([(a[:, 4:-4] * np.roll(b, s, axis=1)[:, 4:-4]).sum(axis=1) for s in range(-2, 3)])
    best = agree.argmax(axis=0)
    inner = np.clip(best, 1, 3)
    left, mid, right = (np.take_along_axis(agree, (inner + k)[None], axis=0)[0] for k in (-1, 0, 1))
    bend = left - 2 * mid + right
    refined = np.where((best == inner) & (bend < 0), 0.5 * (left - right) / np.where(bend < 0, bend, -1), 0)
    shift = best - 2 + refined
    return float(np.abs(shift - np.median(shift)).mean())


blockiness, noise_floor, double_quantised, banding, head_switch, noise_spread, detail = map(measured, (_blockiness, _noise, _double_quantised, _banding, _head_switch, _noise_spread, _detail))


def dropout_rows(images: DataFrame, limit: float = 7.0, share: float = 0.45, skip: int = 10) -> Column:
    """The rows that stand out against the nearest rows over much of their width."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def of(p: pd.Series, hs: pd.Series, ws: pd.Series, cs: pd.Series) -> pd.Series:
        def one(x: np.ndarray) -> list[int]:
            near = np.minimum(np.abs(x[2:-2] - x[:-4]), np.abs(x[2:-2] - x[4:]))
            mid = np.median(near)
            z = (near - mid) / (1.4826 * np.median(np.abs(near - mid)) + 1e-3)
            rows = np.flatnonzero((z > limit).mean(axis=1) > share) + 2
            return rows[rows < x.shape[0] - skip].tolist()

        return pd.Series([one(gray(array_of(*x))) for x in zip(p, hs, ws, cs, strict=True)])

    return of("pixels", "h", "w", "c")


def frame_change(images: DataFrame, keys: list[str]) -> DataFrame:
    """images plus ydif (mean luma change), comb (how comb-like rows are), jitter (rows' wobble, in pixels) and complexity
    (steps within the picture, and since the one before); the first picture of a series has no change and no jitter."""

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("ydif", "comb", "jitter", "complexity")]))
    def of(p: pd.Series, before: pd.Series, hs: pd.Series, ws: pd.Series, cs: pd.Series) -> pd.DataFrame:
        rows = []
        for now, last, h, w, c in zip(p, before, hs, ws, cs, strict=True):
            x = gray(array_of(now, h, w, c))
            inner = np.abs(x[1:-1] - (x[:-2] + x[2:]) / 2).mean()
            comb = float(inner / (np.abs(x[2:] - x[:-2]).mean() + 1e-6))
            if last is None:
                rows.append((None, comb, None, _detail(x)))
                continue
            y = gray(array_of(last, h, w, c))
            ydif = float(np.abs(x - y).mean())
            rows.append((ydif, comb, row_wobble(x, y), _detail(x) + ydif))
        return pd.DataFrame(rows, columns=["ydif", "comb", "jitter", "complexity"], dtype="float64")

    w = along(keys, ["frame"])
    return images.withColumn("_b", F.lag("pixels").over(w)).withColumn("_r", of("pixels", "_b", "h", "w", "c")).select(*images.columns, "_r.*")


def pair_measures(pairs: DataFrame) -> DataFrame:
    """pairs (a, b binary, h, w, c) plus psnr, ssim and visible_pct, the share of pixels with a visible error."""

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("psnr", "ssim", "visible_pct")]))
    def of(a: pd.Series, b: pd.Series, hs: pd.Series, ws: pd.Series, cs: pd.Series) -> pd.DataFrame:
        rows = []
        for p, q, h, w, c in zip(a, b, hs, ws, cs, strict=True):
            x, y = gray(array_of(p, h, w, c)), gray(array_of(q, h, w, c))
            mse = float(((x - y) ** 2).mean())
            mx, my = box_mean(x, 7), box_mean(y, 7)
            vx, vy, vxy = box_mean(x * x, 7) - mx * mx, box_mean(y * y, 7) - my * my, box_mean(x * y, 7) - mx * my
            ssim = float((((2 * mx * my + 6.5025) * (2 * vxy + 58.5225)) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225))).mean())
            seen = np.abs(x - y) / ((1 + 0.6 * local_std(x)) * (1 + 0.04 * np.abs(x - 128)))
            rows.append((float("inf") if mse == 0 else 10 * np.log10(255**2 / mse), ssim, float(100 * (seen > 1).mean())))
        return pd.DataFrame(rows, columns=["psnr", "ssim", "visible_pct"], dtype="float64")

    return pairs.withColumn("_r", of("a", "b", "h", "w", "c")).select(*pairs.columns, "_r.*")


def visually_lossless(measures: DataFrame, limit: float = 0.5) -> DataFrame:
    return measures.withColumn("verdict", F.when(F.col("visible_pct") < limit, "lossless").when(F.col("visible_pct") < 2, "near lossless").otherwise("visible"))


def pixels(images: DataFrame, keys: list[str], step: int = 1) -> DataFrame:
    """(keys, frame, x, y, r, g, b): pixels as rows, every step-th in both directions, for column expressions."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.ShortType())))
    def of(p: pd.Series, hs: pd.Series, ws: pd.Series, cs: pd.Series) -> pd.Series:
        def one(x: np.ndarray) -> list:
            x = x if x.ndim == 3 else np.repeat(x[:, :, None], 3, axis=2)
            y, at = np.mgrid[0 : x.shape[0] : step, 0 : x.shape[1] : step]
            return np.column_stack((at.ravel(), y.ravel(), x[y, at].reshape(-1, 3)[:, ::-1])).astype(np.int16).tolist()

        return pd.Series([one(array_of(*v)) for v in zip(p, hs, ws, cs, strict=True)])

    cell = images.select(*keys, "frame", F.explode(of("pixels", "h", "w", "c")).alias("v"))
    return cell.select(*keys, "frame", *(F.col("v")[k].cast("int").alias(n) for k, n in enumerate(("x", "y", "r", "g", "b"))))


def picture_hash(column: str = "pixels", cells: int = 8) -> Column:
    """A 64-bit difference hash: whether each cell of a 9 by 8 grid is darker than the cell to its right."""

    @F.pandas_udf(T.LongType())
    def of(p: pd.Series, hs: pd.Series, ws: pd.Series, cs: pd.Series) -> pd.Series:
        def one(x: np.ndarray) -> int:
            rows = [r.mean(axis=0) for r in np.array_split(x, cells)]
            grid = np.array([[c.mean() for c in np.array_split(r, cells + 1)] for r in rows])
            return int(np.packbits(grid[:, :-1] < grid[:, 1:]).view(">i8")[0])

        return pd.Series([one(gray(array_of(*v))) for v in zip(p, hs, ws, cs, strict=True)])

    return of(column, "h", "w", "c")


def glyphs(least: int = 4) -> Column:
    """The columns (first, last) of the marks in an image, dark on light or light on dark."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def of(p: pd.Series, hs: pd.Series, ws: pd.Series, cs: pd.Series) -> pd.Series:
        def one(x: np.ndarray) -> list:
            low, high = np.percentile(x, (8, 92))
            ink = x > (low + high) / 2
            ink = ~ink if ink.mean() > 0.5 else ink
            full = np.concatenate(([0], (ink.sum(axis=0) > 0).astype(int), [0]))
            edge = np.flatnonzero(np.diff(full))
            return [[int(a), int(b) - 1] for a, b in zip(edge[::2], edge[1::2], strict=True) if ink[:, a:b].sum() >= least]

        return pd.Series([one(gray(array_of(*v))) for v in zip(p, hs, ws, cs, strict=True)])

    return of("pixels", "h", "w", "c")


def evenly_sampled(images: DataFrame, keys: list[str], samples: int = 5) -> DataFrame:
    """The pictures of `samples` frames that cut each series in equal parts; pixels of others aren't looked at."""
    n = images.groupBy(*keys).agg((F.max("frame") + 1).alias("_n"))
    chosen = n.select(*keys, F.explode(F.array_distinct(evenly_spaced(F.col("_n"), samples))).alias("frame"))
    return images.join(chosen, [*keys, "frame"], "left_semi")
