"""Regions of a frame: faces and eyes from landmarks, the subject, crops.  Boxes are struct(x0, y0, x1, y1) in pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as c

# Landmarks around the eyes (corners first and fourth) and the padding of their crops.
LEFT_EYE = (362, 385, 387, 263, 373, 380)
RIGHT_EYE = (33, 160, 158, 133, 153, 144)
EYE_PADDING = 0.20
#: The long edge of the copy that a crop provider sees.
CROP_EDGE = 512


def _whole(x: Column) -> Column:
    """Towards zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("int")


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[v.cast("int").alias(k) for k, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])


def visible_share(landmarks: Column) -> Column:
    """The share of a face's landmarks (structs with visibility) that are surely visible; missing ones are not."""
    seen = F.filter(F.slice(landmarks, 1, c.FACE_LANDMARKS), lambda p: p["visibility"] > c.VISIBILITY_MIN)
    return F.size(seen) / F.lit(float(c.FACE_LANDMARKS))


def is_occluded(landmarks: Column) -> Column:
    return visible_share(landmarks) < c.FACE_VISIBLE_MIN


def eye_ratio(landmarks: Column, eye: Sequence[int]) -> Column:
    """Height over width of an eye; 0 for one without width."""
    p = [F.get(landmarks, F.lit(i)) for i in eye]
    far = lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])
    return F.when(far(p[0], p[3]) < 1e-6, F.lit(0.0)).otherwise((far(p[1], p[5]) + far(p[2], p[4])) / (2 * far(p[0], p[3])))


def eyes_closed(landmarks: Column) -> Column:
    return (eye_ratio(landmarks, LEFT_EYE) + eye_ratio(landmarks, RIGHT_EYE)) / 2 < c.EAR_CLOSED


def _around(points: Column, width: Column, height: Column, padding: float) -> Column:
    xs, ys = F.transform(points, lambda p: _whole(p["x"] * width)), F.transform(points, lambda p: _whole(p["y"] * height))
    pad = lambda v: F.greatest(F.lit(1), _whole((F.array_max(v) - F.array_min(v)) * padding)) if padding else F.lit(0)
    low = lambda v: F.greatest(F.lit(0), F.array_min(v) - pad(v))
    return box(low(xs), low(ys), F.least(width, F.array_max(xs) + pad(xs)), F.least(height, F.array_max(ys) + pad(ys)))


def face_box(landmarks: Column, width: Column, height: Column) -> Column:
    return _around(F.slice(landmarks, 1, c.FACE_LANDMARKS), width, height, 0.0)


def eye_box(landmarks: Column, eye: Sequence[int], width: Column, height: Column) -> Column:
    """The box of an eye with a fifth of its size around it, one pixel at least."""
    return _around(F.array(*[F.get(landmarks, F.lit(i)) for i in eye]), width, height, EYE_PADDING)


def subject_region(has_face: Column, face: Column, salient: Column, width: Column, height: Column) -> Column:
    """struct(box, source, has_subject): the face, else what is salient (a box in shares of the frame), else the frame."""
    x0, y0 = _whole(salient["x0"] * width), _whole(salient["y0"] * height)
    of_salient = box(x0, y0, F.greatest(_whole(salient["x1"] * width), x0 + 1), F.greatest(_whole(salient["y1"] * height), y0 + 1))
    by_face = F.coalesce(has_face, F.lit(False)) & face.isNotNull()
    region = lambda b, source, known: F.struct(b.alias("box"), F.lit(source).alias("source"), F.lit(known).alias("has_subject"))
    whole = box(F.lit(0), F.lit(0), width, height)
    return F.when(by_face, region(face, "face", True)).when(salient.isNotNull(), region(of_salient, "saliency_peak", True)).otherwise(region(whole, "global", False))


def crop_proposal(proposed: Column, salient: Column, width: Column, height: Column) -> Column:
    """struct(top, left, bottom, right, source).

    proposed: what a provider says of a copy of at most CROP_EDGE pixels (struct x, y, width, height), scaled back to
    the frame; without it the salient box, in shares of the frame.
    """
    scale = F.greatest(F.greatest(width, height) / F.lit(float(CROP_EDGE)), F.lit(1.0))
    fit = lambda x, most: F.greatest(F.lit(0), F.least(F.bround(x * scale).cast("int"), most))
    crop = lambda top, left, bottom, right, source: F.struct(top.alias("top"), left.alias("left"), bottom.alias("bottom"), right.alias("right"), F.lit(source).alias("source"))
    p = proposed
    scaled = crop(fit(p["y"], height), fit(p["x"], width), fit(p["y"] + p["height"], height), fit(p["x"] + p["width"], width), "smartcrop")
    thirds = crop(_whole(salient["y0"] * height), _whole(salient["x0"] * width), _whole(salient["y1"] * height), _whole(salient["x1"] * width), "saliency_thirds")
    empty = crop(F.lit(0), F.lit(0), height.cast("int"), width.cast("int"), "saliency_thirds")
    return F.when(p.isNotNull(), scaled).when((width <= 0) | (height <= 0), empty).otherwise(thirds)
