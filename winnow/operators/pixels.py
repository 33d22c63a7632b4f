"""Metrics of decoded images: one Python stage per image, whatever is asked for; pixels never leave it.

Input is Spark's `image` source (struct height, width, nChannels, mode, data; BGR bytes).  A failing image gives a row
with its error and nulls; the others go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as c
from ..functions import metrics as m
from ..tables import ship
from .frames import ENDS, line_segments, resize

FIELDS = ("tenengrad", "fft_ratio", "motion_ratio", "clip_high", "clip_low", "range_score", "midtone", "cast_a", "cast_b", "cast", "noise", "subject_sharpness", "background_sharpness")
LONG_EDGE = 1280


def gray_of(bgr: np.ndarray) -> np.ndarray:
    return np.rint(bgr[..., 0] * 0.114 + bgr[..., 1] * 0.587 + bgr[..., 2] * 0.299)


def shrink(bgr: np.ndarray, edge: int = LONG_EDGE) -> np.ndarray:
    """Area means to a long edge of at most `edge`; never enlarged."""
    h, w = bgr.shape[:2]
    if max(h, w) <= edge:
        return bgr
    scale = edge / max(h, w)
    out = bgr.astype(np.float64)
    for axis, n in ((0, int(h * scale)), (1, int(w * scale))):
        size = out.shape[axis]
        at = np.linspace(0, size, max(n, 1) + 1)
        sums = np.concatenate((np.zeros_like(out.take([0], axis)), np.cumsum(out, axis=axis)), axis=axis)
        low = np.minimum(at.astype(int), size - 1)
        part = (at - low).reshape([-1 if k == axis else 1 for k in range(out.ndim)])
        edges = sums.take(low, axis) + out.take(low, axis) * part
        out = np.diff(edges, axis=axis) / (size / max(n, 1))
    return np.rint(out)


def _window(gray: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """The image shifted by -1..1 in both directions, mirrored at the border without repeating the edge."""
    p = np.pad(gray, 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray, 1, mode="edge")
    h, w = gray.shape
    return {(y, x): p[1 + y : 1 + y + h, 1 + x : 1 + x + w] for y in (-1, 0, 1) for x in (-1, 0, 1)}


def gradients(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Sobel x, Sobel y, Laplacian)."""
    v = _window(gray.astype(np.float64))
    gx = v[-1, 1] - v[-1, -1] + 2 * (v[0, 1] - v[0, -1]) + v[1, 1] - v[1, -1]
    gy = v[1, -1] - v[-1, -1] + 2 * (v[1, 0] - v[-1, 0]) + v[1, 1] - v[-1, 1]
    return gx, gy, v[0, 1] + v[0, -1] + v[1, 0] + v[-1, 0] - 4 * v[0, 0]


def fft_ratio(gray: np.ndarray) -> float:
    """Spectrum outside a centred disc, over all of it."""
    h, w = gray.shape
    size = np.abs(np.fft.fft2(gray.astype(np.float32)))
    y, x = (np.fft.fftfreq(n, 1 / n).round() for n in (h, w))
    far = np.hypot(y[:, None], x[None, :]) > int(min(h, w) * c.FFT_RADIUS)
    total = float(size.sum())
    return float(size[far].sum()) / total if total else 0.0


def motion_ratio(gray: np.ndarray) -> float:
    """Largest over mean energy of oriented 3x3 responses; energy at any angle follows from three moments of the
    horizontal and the vertical response, as the kernels are linear in cosine and sine."""
    v = _window(gray.astype(np.float64))
    across = sum(v[y, -1] - v[y, 1] for y in (-1, 0, 1))
    down = sum(v[-1, x] - v[1, x] for x in (-1, 0, 1))
    angle = np.deg2rad(np.arange(c.MOTION_DIRECTIONS) * (180 // c.MOTION_DIRECTIONS))
    cos, sin = np.cos(angle), np.sin(angle)
    energy = cos**2 * (across**2).mean() + 2 * cos * sin * (across * down).mean() + sin**2 * (down**2).mean()
    return float(energy.max() / energy.mean()) if energy.mean() > 0 else 0.0


def lab_of(bgr: np.ndarray) -> np.ndarray:
    """CIE Lab (D65) scaled to bytes: L * 255 / 100, a + 128, b + 128."""
    rgb = bgr[..., ::-1] / 255.0
    rgb = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    # sRGB to XYZ, white point D65.
    xyz = rgb @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / [0.950456, 1.0, 1.088754]
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * xyz[..., 1])
    return np.rint(np.stack([light * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1))


def noise(gray: np.ndarray) -> float:
    """Mean variance of the Laplacian over the quarter of tiles with the weakest gradients."""
    gx, gy, lap = gradients(gray)
    t = c.NOISE_TILE
    h, w = (n // t for n in gray.shape)
    if not h or not w:
        return 0.0
    tiles = lambda a: a[: h * t, : w * t].reshape(h, t, w, t).swapaxes(1, 2).reshape(h * w, t * t)
    steep = tiles(np.hypot(gx, gy)).mean(axis=1)
    calm = tiles(lap).var(axis=1)[steep <= np.percentile(steep, 25)]
    return float(min(calm.mean() / c.NOISE_SCALE, 1.0))


def blur_map(gray: np.ndarray, sizes: tuple[int, ...] = (7, 15, 31), step: int = 16) -> np.ndarray:
    """Sharpness in 0..1 on a grid of every step-th pixel: after sorted transform coefficients of gradient magnitudes.

    Around each place and at each size, the high-frequency cosine coefficients of the gradient magnitudes are sorted; each
    rank is scaled over the image, and ranks and sizes are averaged.
    """
    gx, gy, _ = gradients(gray)
    steep, layers = np.hypot(gx, gy), []
    for n in sizes:
        if min(gray.shape) <= n // 2:
            continue
        k = np.arange(n)
        cosine = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
        cosine[0] /= np.sqrt(2)
        places = np.lib.stride_tricks.sliding_window_view(np.pad(steep, n // 2, mode="reflect"), (n, n))[::step, ::step]
        high = k[:, None] + k[None, :] >= n - 1
        ranks = np.stack([np.sort(np.abs(cosine @ row @ cosine.T)[:, high], axis=-1) for row in places])
        low, wide = ranks.min(axis=(0, 1)), np.ptp(ranks, axis=(0, 1))
        layers.append((np.where(wide > 1e-9, (ranks - low) / np.maximum(wide, 1e-9), 0.0)).mean(axis=-1))
    if not layers:
        return np.zeros((1, 1))
    out = np.mean(layers, axis=0)
    return (out - out.min()) / max(np.ptp(out), 1e-9) if np.ptp(out) > 1e-9 else np.zeros_like(out)


def centre_and_rest(sharpness: np.ndarray) -> tuple[float, float]:
    """Means over the middle of a map (a fixed share of each side) and over what is around it."""
    middle = np.zeros(sharpness.shape, dtype=bool)
    cut = tuple(slice(int(n * (1 - c.CENTRE_FRACTION) / 2), max(int(n * (1 + c.CENTRE_FRACTION) / 2), int(n * (1 - c.CENTRE_FRACTION) / 2) + 1)) for n in sharpness.shape)
    middle[cut] = True
    return float(sharpness[middle].mean()), float(sharpness[~middle].mean()) if (~middle).any() else float(sharpness.mean())


def measure(bgr: np.ndarray) -> dict[str, float]:
    small = shrink(bgr)
    gray = gray_of(small)
    gx, gy, _ = gradients(gray)
    lab = lab_of(small)
    a, b = float((lab[..., 1] - 128).mean()), float((lab[..., 2] - 128).mean())
    low, high = np.percentile(lab[..., 0], [1, 99])
    flat = small.reshape(-1, 3)
    centre, rest = centre_and_rest(blur_map(gray))
    return {
        "tenengrad": float((gx * gx + gy * gy).mean()), "fft_ratio": fft_ratio(gray), "motion_ratio": motion_ratio(gray),
        "clip_high": float((flat >= c.CLIP_HIGH).mean(axis=0).max()), "clip_low": float((flat <= c.CLIP_LOW).mean(axis=0).max()),
        "range_score": float((high - low) / 254.0), "midtone": float(((lab[..., 0] >= c.MIDTONE_LOW) & (lab[..., 0] <= c.MIDTONE_HIGH)).mean()),
        "cast_a": a, "cast_b": b, "cast": float(np.hypot(a, b)), "noise": noise(gray),
        "subject_sharpness": centre, "background_sharpness": rest,
    }


def difference_hash(gray: np.ndarray) -> int:
    """64 bits: whether each cell of a 9 x 8 thumbnail is darker than its right neighbour."""
    h, w = gray.shape
    rows, cols = np.linspace(0, h, 9).astype(int), np.linspace(0, w, 10).astype(int)
    sums = np.pad(gray.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    box = sums[rows[1:, None], cols[None, 1:]] - sums[rows[:-1, None], cols[None, 1:]] - sums[rows[1:, None], cols[None, :-1]] + sums[rows[:-1, None], cols[None, :-1]]
    area = np.maximum(np.diff(rows)[:, None] * np.diff(cols)[None, :], 1)
    bits = (box / area)[:, 1:] > (box / area)[:, :-1]
    return int(np.packbits(bits.ravel()).view(">u8")[0])


def image_metrics(images: DataFrame, id_col: str, image: str = "image", lines: bool = False) -> DataFrame:
    """(id, FIELDS, dhash, error) from one decode per image; with lines also the straight lines in it, as geometry takes them
    after segments()."""
    ship(images.sparkSession)
    kind = images.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, w, n, data in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3, 4)]):
                try:
                    px = np.frombuffer(data, np.uint8).reshape(h, w, n)
                    bgr = (np.repeat(px, 3, axis=2) if n == 1 else px[..., :3]).astype(np.float64)
                    bits = difference_hash(gray_of(bgr))
                    found = [dict(zip(ENDS, x)) for x in line_segments(gray_of(shrink(bgr))).tolist()] if lines else None
                    rows.append(measure(bgr) | {"dhash": bits - (1 << 64) if bits >> 63 else bits, "error": None, "lines": found})
                except Exception as e:
                    rows.append(dict.fromkeys(FIELDS) | {"dhash": None, "error": f"{type(e).__name__}: {e}", "lines": None})
            cols = [pa.array([r[k] for r in rows], pa.float64()) for k in FIELDS]
            out = [batch.column(0), *cols, pa.array([r["dhash"] for r in rows], pa.int64()), pa.array([r["error"] for r in rows], pa.string())]
            if lines:
                out.append(pa.array([r["lines"] for r in rows], pa.list_(pa.struct([(k, pa.float64()) for k in ENDS]))))
            yield pa.RecordBatch.from_arrays(out, names=["id", *FIELDS, "dhash", "error", *["lines"] * lines])

    slim = images.select(F.col(id_col).alias("id"), *[F.col(f"{image}.{k}") for k in ("height", "width", "nChannels", "data")])
    schema = f"id {kind}, " + ", ".join(f"{k} double" for k in FIELDS) + ", dhash bigint, error string"
    return slim.mapInArrow(run, schema + f", lines array<struct<{', '.join(f'{k}: double' for k in ENDS)}>>" * lines)


def _bgr(h: int, w: int, n: int, data: bytes) -> np.ndarray:
    px = np.frombuffer(data, np.uint8).reshape(h, w, n)
    return (np.repeat(px, 3, axis=2) if n == 1 else px[..., :3]).astype(np.float64)


def region_sharpness(images: DataFrame, id_col: str, regions: str, image: str = "image") -> DataFrame:
    """(id, name, tenengrad) of each region of each image, from one decode.  regions: array of struct(name, box); boxes are
    cut to the frame, an empty one scores 0; a broken image gives nulls."""
    ship(images.sparkSession)
    kind = images.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, scores = [], [], []
            for key, h, w, n, data, wanted in zip(*[batch.column(k).to_pylist() for k in range(6)]):
                try:
                    gray = gray_of(_bgr(h, w, n, data))
                except Exception:
                    gray = None
                for r in wanted or []:
                    x0, y0 = (max(0, min(r["box"][k], most)) for k, most in (("x0", w or 0), ("y0", h or 0)))
                    x1, y1 = max(x0, min(r["box"]["x1"], w or 0)), max(y0, min(r["box"]["y1"], h or 0))
                    score = None
                    if gray is not None:
                        part = gray[y0:y1, x0:x1]
                        gx, gy, _ = gradients(part) if part.size else (np.zeros(1), np.zeros(1), None)
                        score = float((gx * gx + gy * gy).mean())
                    ids.append(key)
                    names.append(r["name"])
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "name", "tenengrad"])

    slim = images.select(F.col(id_col).alias("id"), *[F.col(f"{image}.{k}") for k in ("height", "width", "nChannels", "data")], regions)
    return slim.mapInArrow(run, f"id {kind}, name string, tenengrad double")


def resample(bgr: np.ndarray, height: int, width: int) -> np.ndarray:
    """Any size: area means down, then straight lines up."""
    h, w = bgr.shape[:2]
    out = bgr.astype(np.float64)
    for axis, n, size in ((0, height, h), (1, width, w)):
        if n < size:
            at = np.linspace(0, size, n + 1)
            sums = np.concatenate((np.zeros_like(out.take([0], axis)), np.cumsum(out, axis=axis)), axis=axis)
            low = np.minimum(at.astype(int), size - 1)
            part = (at - low).reshape([-1 if k == axis else 1 for k in range(out.ndim)])
            out = np.diff(sums.take(low, axis) + out.take(low, axis) * part, axis=axis) / (size / n)
        elif n > size:
            at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
            low = np.minimum(at.astype(int), max(size - 2, 0))
            part = (at - low).reshape([-1 if k == axis else 1 for k in range(out.ndim)])
            out = out.take(low, axis) * (1 - part) + out.take(np.minimum(low + 1, size - 1), axis) * part
    return np.rint(out).astype(np.uint8)


def two_sizes(images: DataFrame, id_col: str, image: str = "image", long_edge: int = LONG_EDGE, square: int = 224) -> DataFrame:
    """(id, height, width, pixels, crop) from one decode: the image with a long edge of at most long_edge, and the middle
    square of the image whose short edge is `square`; BGR bytes.  Filters: windowed sinc, cubic."""
    ship(images.sparkSession)
    kind = images.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                h, w, n, data = (batch.column(k)[row].as_py() for k in range(1, 5))
                large = crop = None
                try:
                    bgr = _bgr(h, w, n, data)
                    scale = min(1.0, long_edge / max(h, w))
                    large = resize(bgr, max(1, round(h * scale)), max(1, round(w * scale)), "sinc")
                    scale = square / min(h, w)
                    small = resize(bgr, max(1, round(h * scale)), max(1, round(w * scale)), "cubic")
                    top, left = (small.shape[0] - square) // 2, (small.shape[1] - square) // 2
                    crop = small[top : top + square, left : left + square]
                except Exception:
                    large = crop = None
                known = large is not None
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([large.shape[0] if known else None], pa.int32()), pa.array([large.shape[1] if known else None], pa.int32()), pa.array([large.tobytes() if known else None], pa.binary()), pa.array([crop.tobytes() if known else None], pa.binary())], names=["id", "height", "width", "pixels", "crop"])

    slim = images.select(F.col(id_col).alias("id"), *[F.col(f"{image}.{k}") for k in ("height", "width", "nChannels", "data")])
    return slim.mapInArrow(run, f"id {kind}, height int, width int, pixels binary, crop binary")


def first_stage(measured: DataFrame, subject: str | None = "subject_sharpness", background: str | None = "background_sharpness") -> DataFrame:
    """Adds exposure flags, blur tier, passed and reject_reason.  Only blur and noise reject; blur is named first.

    subject and background: sharpness of the middle and of the rest, for bokeh (by image_metrics, or of a provider).
    """
    known = {subject, background} <= set(measured.columns)
    soft = m.bokeh(F.col(subject), F.col(background)) if known else F.lit(False)
    out = measured.withColumn("is_bokeh", F.coalesce(soft, F.lit(False)))
    out = out.withColumn("exposure_flags", m.exposure_flags(*[F.col(k) for k in ("clip_high", "clip_low", "cast_a", "cast_b", "cast", "range_score")]))
    out = out.withColumn("blur", m.blur_tier(F.col("tenengrad"), F.col("fft_ratio"), F.col("is_bokeh"), F.col("motion_ratio") > c.MOTION_RATIO))
    noisy = F.col("noise") >= c.NOISE_MAX
    return out.withColumn("reject_reason", F.when(F.col("blur.is_blurry"), "blur").when(noisy, "noise")).withColumn("passed", F.when(F.col("error").isNull(), F.col("reject_reason").isNull()))


def horizon(angles: np.ndarray, draws: int = 50, within: float = 2.0) -> float:
    """Consensus of near-horizontal angles: the median of the largest set within two degrees of one of 50 draws."""
    n = len(angles)
    if n < 4:
        return 0.0
    rng = np.random.default_rng(seed=n)
    picks = np.array([rng.choice(angles) for _ in range(draws)])
    close = np.abs(angles[None, :] - picks[:, None]) <= within
    return float(np.median(angles[close[close.sum(axis=1).argmax()]]))


def geometry(segments: DataFrame, id_col: str) -> DataFrame:
    """(id, tilt, keystone, confidence, has_horizon, has_verticals) from line segments (id, x1, y1, x2, y2)."""
    angle = m.fold_angle(F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))))
    lines = segments.select(F.col(id_col).alias("id"), angle.alias("a")).withColumn("l", m.line_kind(F.col("a"))).where("l is not null")
    sides = lines.groupBy("id").agg(
        F.count_if(F.col("l.kind") == "horizontal").alias("nh"), F.count_if(F.col("l.kind") == "vertical").alias("nv"),
        F.median(F.when(F.col("l.kind") == "vertical", F.col("l.deviation"))).alias("mv"),
        F.collect_list(F.when(F.col("l.kind") == "horizontal", F.col("l.deviation"))).alias("angles"),  # the lines of one image
    )
    ship(segments.sparkSession)

    @F.pandas_udf("double")
    def tilt(angles):
        return angles.map(lambda x: horizon(np.asarray(x, dtype=np.float64)))

    return sides.select(
        F.col("id").alias(id_col), tilt("angles").alias("tilt"), F.when(F.col("nv") >= 4, F.col("mv")).otherwise(0.0).alias("keystone"),
        F.least(F.lit(1.0), (F.col("nh") + F.col("nv")) / 16.0).alias("confidence"), (F.col("nh") >= 4).alias("has_horizon"), (F.col("nv") >= 4).alias("has_verticals"),
    )
