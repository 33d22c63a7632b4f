"""Formulas over the metrics of one asset."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as c
from .vectors import clamp, dot


def tilt_penalty(tilt: Column, keystone: Column) -> Column:
    """Null without geometry."""
    worst = F.greatest(F.abs(tilt) / c.TILT_MAX, F.abs(keystone) / c.KEYSTONE_MAX)
    return F.when(tilt.isNotNull() & keystone.isNotNull(), F.least(F.lit(1.0), worst))


def exposure_flags(high: Column, low: Column, cast_a: Column, cast_b: Column, cast: Column, range_: Column) -> Column:
    return F.struct(
        (high > c.CLIP_HIGH_MAX).alias("highlight_clip"),
        (low > c.CLIP_LOW_MAX).alias("shadow_clip"),
        ((F.abs(cast_a) > c.CAST_A) | (F.abs(cast_b) > c.CAST_B) | (cast > c.CAST_ALL)).alias("color_cast"),
        (range_ < c.RANGE_MIN).alias("low_range"),
    )


def blur_tier(tenengrad: Column, fft_ratio: Column, is_bokeh: Column, is_motion: Column) -> Column:
    """struct(tier, is_blurry): bokeh is never blurry."""
    blurry = ~is_bokeh & (tenengrad < c.TENENGRAD_MIN) & (fft_ratio < c.FFT_MIN)
    return F.struct(F.when(blurry, F.when(is_motion, 3).otherwise(1)).otherwise(2).alias("tier"), blurry.alias("is_blurry"))


def bokeh(subject: Column, background: Column) -> Column:
    return subject > c.BOKEH_RATIO * background


def heat(norms: Column) -> Column:
    """Patch norms scaled to 0..1."""
    low, high = F.array_min(norms), F.array_max(norms)
    return F.transform(norms, lambda x: (x - low) / (high - low + 1e-8))


def peak(heatmap: Column, width: Column | int, height: Column | int) -> Column:
    """struct(x, y) of the first largest cell, as shares of width and height."""
    at = F.array_position(heatmap, F.array_max(heatmap)) - 1
    w, h = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    return F.struct((at % w / w).alias("x"), (F.floor(at / w) / h).alias("y"))


def salient_box(heatmap: Column, width: Column | int, height: Column | int, least: float = 0.5) -> Column:
    """struct(x0, y0, x1, y1) of cells >= least, to the largest index itself; the whole frame if none."""
    w, h = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    cells = F.filter(F.transform(heatmap, lambda x, i: F.when(x >= least, i)), lambda i: i.isNotNull())
    cols, rows = F.transform(cells, lambda i: i % w), F.transform(cells, lambda i: F.floor(i / w))
    some = F.size(cells) > 0
    part = lambda x, n, whole: F.when(some, x / n).otherwise(F.lit(whole))
    return F.struct(part(F.array_min(cols), w, 0.0).alias("x0"), part(F.array_min(rows), h, 0.0).alias("y0"), part(F.array_max(cols), w, 1.0).alias("x1"), part(F.array_max(rows), h, 1.0).alias("y1"))


def thirds(x: Column, y: Column) -> Column:
    """Nearness of the peak to a power point."""
    near = F.least(*[F.hypot(x - px, y - py) for px in (1 / 3, 2 / 3) for py in (1 / 3, 2 / 3)])
    return F.greatest(F.lit(0.0), 1 - near / 0.5)


def edge_clearance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return clamp(F.least(x0, y0, 1 - x1, 1 - y1) / 0.5)


def balance(heatmap: Column, width: int, height: int) -> Column:
    """Evenness of left and right, top and bottom; halves split at half the size, rounded down."""
    total = lambda keep: F.aggregate(F.transform(heatmap, lambda v, i: F.when(keep(i), v.cast("double")).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)

    def even(a: Column, b: Column) -> Column:
        return F.when(a + b <= 0, F.lit(1.0)).otherwise(1 - F.abs(a - b) / (a + b))

    left, right = total(lambda i: i % width < width // 2), total(lambda i: i % width >= width // 2)
    top, bottom = total(lambda i: i < (height // 2) * width), total(lambda i: i >= (height // 2) * width)
    return (even(left, right) + even(top, bottom)) / 2


def composition(thirds_: Column, clearance: Column, balance_: Column, learned: Column | None = None) -> Column:
    learned = F.lit(0.5) if learned is None else F.coalesce(learned, F.lit(0.5))
    return F.round(0.35 * thirds_ + 0.25 * clearance + 0.20 * balance_ + 0.20 * learned, 6)


def eye_aspect(v1: Column, v2: Column, h: Column) -> Column:
    return F.when(h < 1e-6, F.lit(0.0)).otherwise((v1 + v2) / (2 * h))


def linear_head(embedding: Column, layers: list[tuple[list[list[float]], list[float]]]) -> Column:
    """The output of a stack of linear layers (weights by row, bias), the last with one row, over an embedding.

    Layers without a bend between them are one layer: they are multiplied out once, so a row costs one dot product.
    """
    w, b = np.eye(len(layers[0][0][0])), np.zeros(len(layers[0][0][0]))
    for weight, bias in layers:
        w, b = np.asarray(weight, dtype=np.float64) @ w, np.asarray(weight, dtype=np.float64) @ b + np.asarray(bias, dtype=np.float64)
    return dot(embedding, F.array(*[F.lit(float(x)) for x in w[0]])) + F.lit(float(b[0]))


def aesthetic(raw: Column) -> Column:
    """A 1..10 score as 0..1."""
    return (clamp(raw, 1.0, 10.0) - 1) / 9


def musiq(technical: Column, aesthetic_raw: Column) -> Column:
    return F.struct(clamp(technical / 100).alias("technical"), clamp((aesthetic_raw - 1) / 9).alias("aesthetic"))


def fold_angle(angle: Column) -> Column:
    """Degrees in [-90, 90)."""
    return F.pmod(angle + 90.0, F.lit(180.0)) - 90.0


def line_kind(angle: Column) -> Column:
    """struct(kind, deviation) of a folded angle: horizontal, vertical or null."""
    off = F.when(angle >= 0, angle - 90.0).otherwise(angle + 90.0)
    return F.when(F.abs(angle) <= 30, F.struct(F.lit("horizontal").alias("kind"), angle.alias("deviation"))).when(F.abs(off) <= 30, F.struct(F.lit("vertical").alias("kind"), off.alias("deviation")))


def shot_type(has_face: Column, face_ratio: Column, salient: Column) -> Column:
    by_face = F.when(face_ratio.isNull(), "medium").when(face_ratio >= c.CLOSE_UP_MIN, "close").when(face_ratio >= c.MEDIUM_MIN, "medium").otherwise("wide")
    by_box = F.when(salient.isNull(), "medium").when(salient >= c.SALIENT_WIDE_MIN, "wide").otherwise("close")
    return F.when(has_face, by_face).otherwise(by_box)


def portrait_moment(shapes: Column) -> Column:
    """struct(score, eyes, smile, gaze) from a map of expression strengths."""
    get = lambda k, d: F.coalesce(shapes[k], F.lit(d))
    eyes = F.greatest(F.lit(0.0), 1 - (get("eyeBlinkLeft", 1.0) + get("eyeBlinkRight", 1.0)) / 2)
    smile = (get("mouthSmileLeft", 0.0) + get("mouthSmileRight", 0.0)) / 2
    gaze = F.greatest(F.lit(0.0), 1 - (get("eyeLookOutLeft", 0.0) + get("eyeLookOutRight", 0.0)) / 2)
    score = 0.5 * eyes + 0.3 * smile + 0.2 * gaze + F.when(eyes >= c.EYE_OPEN_MIN, 0.05).otherwise(0.0) + F.when(smile >= c.SMILE_MIN, 0.05).otherwise(0.0)
    return F.struct(score.alias("score"), eyes.alias("eyes"), smile.alias("smile"), gaze.alias("gaze"))
