"""Lines, motion, crops and filters on drawn frames and against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.functions import regions
from winnow.operators import frames, pixels, sequence

IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def images(spark, named):
    rows = [(k, ("", *(x.shape[0], x.shape[1], x.shape[2] if x.ndim == 3 else 1), 16, x.tobytes()) if x is not None else ("", 3, 3, 3, 16, b"xx")) for k, x in named.items()]
    return spark.createDataFrame(rows, f"id string, image {IMAGE}")


def drawn(tilt, keystone, h=300, w=420, lines=6):
    """Bars at `tilt` degrees from the horizontal and at `keystone` from the vertical, with soft edges."""
    y, x = np.mgrid[0:h, 0:w].astype(float)
    out = np.full((h, w), 40.0)
    for k in range(lines):
        for angle, at, side in ((tilt, (k + 0.6) * h / lines, 0), (90 + keystone, (k + 0.6) * w / lines, 1)):
            a = math.radians(angle)
            px, py = (w / 2, at) if side == 0 else (at, h / 2)
            d = np.abs((x - px) * -math.sin(a) + (y - py) * math.cos(a))
            s = (x - px) * math.cos(a) + (y - py) * math.sin(a)
            within = np.abs(s) < (w if side == 0 else h) * 0.4
            out = np.maximum(out, np.where(within, 40 + 180 * np.clip(4.5 - d, 0, 1), 0))
    return np.clip(out, 0, 255).astype(np.uint8)


@pytest.mark.parametrize("tilt, keystone", [(0.0, 0.0), (2.5, -3.0), (-7.0, 5.0)])
def test_tilt_and_keystone_of_drawn_lines(spark, tilt, keystone):
    facts = frames.frame_facts(images(spark, {"a": drawn(tilt, keystone)}), "id")
    got = pixels.geometry(frames.segments(facts), "id").first()
    assert got.has_horizon and got.has_verticals
    assert abs(got.tilt - tilt) <= 0.5 and abs(got.keystone - keystone) <= 0.5


def test_noise_and_flat_frames_have_no_lines():
    r = np.random.default_rng(1)
    assert len(frames.line_segments(r.integers(0, 255, (200, 200)))) <= 1
    assert len(frames.line_segments(np.full((100, 100), 7))) == 0 and len(frames.line_segments(np.zeros((3, 3)))) == 0


def test_ends_of_a_line_are_where_it_was_drawn():
    g = np.zeros((80, 120))
    g[40:, 20:100] = 200
    found = frames.line_segments(g)
    top = max(found, key=lambda s: abs(s[2] - s[0]))
    assert abs(min(top[0], top[2]) - 20) < 2 and abs(max(top[0], top[2]) - 100) < 2 and abs(top[1] - 40) < 1 and abs(top[3] - 40) < 1


def textured(h, w, seed=3):
    r = np.random.default_rng(seed)
    return frames.resize(r.integers(0, 255, (h // 4, w // 4)).astype(np.uint8), h, w, "cubic")


@pytest.mark.parametrize("dy, dx", [(0, 0), (3, 0), (-2, 5), (11, -7), (0, 20)])
def test_magnitudes_of_shifted_frames(dy, dx):
    big = textured(260, 320)
    a, b = big[40:200, 40:260], big[40 - dy : 200 - dy, 40 - dx : 260 - dx]
    want = math.hypot(dy, dx)
    assert abs(frames.motion(a, b) - want) <= max(0.1 * want, 0.05)


def test_motion_of_nothing():
    assert frames.motion(np.zeros((50, 50)), np.zeros((50, 50))) == 0 and frames.motion(np.zeros((5, 5)), np.zeros((5, 5))) == 0
    assert frames.motion(np.zeros((50, 50)), np.zeros((50, 60))) == 0


def test_the_peak_of_a_burst_comes_from_its_frames(spark):
    big = textured(200, 260)
    steps, at, named = [1, 2, 9, 3, 1], 0, {}
    for k in range(6):
        named[f"f{k}"] = big[40:160, 100 - at : 220 - at]
        at += steps[k] if k < 5 else 0
    named |= {"other": big[:100, :100], "broken": None}
    facts = frames.frame_facts(images(spark, named), "id")
    shots = spark.createDataFrame([(f"f{k}", "b", k) for k in range(6)] + [("other", "c", 0), ("broken", "b", 9), ("f0", None, 0)], "id string, burst string, t int")
    pairs = frames.motion_pairs(shots, "burst", ["t"], facts)
    got = {r.pos: r.magnitude for r in pairs.collect()}
    assert sorted(got) == list(range(5)) and all(abs(got[k] - s) <= max(0.1 * s, 0.1) for k, s in enumerate(steps))
    peak = sequence.motion_peak(pairs, "burst", "pos", "magnitude").first()
    assert peak.peak_pos == 2 and abs(peak.peak - 9) < 0.9


def test_the_best_crop_equals_brute_force():
    r = np.random.default_rng(7)
    for h, w in ((40, 64), (33, 21), (9, 9)):
        value = r.random((h, w)) ** 6
        value[h // 3 : h // 2, w // 2 : w - 3] += 2
        best = None
        for side in frames.SIDES:
            ch, cw = max(1, round(h * side)), max(1, round(w * side))
            for y in sorted({*range(0, h - ch + 1, frames.STEP), h - ch}):
                for x in sorted({*range(0, w - cw + 1, frames.STEP), w - cw}):
                    score = round(value[y : y + ch, x : x + cw].sum() / value.sum() - frames.AREA_COST * ch * cw / (h * w), 9)
                    if best is None or score > best[0]:
                        best = score, (x, y, cw, ch)
        assert frames.best_crop(value) == best[1]
    assert frames.best_crop(np.zeros((10, 10)))[2:] == (5, 5)


def test_a_crop_holds_what_stands_out_and_is_scaled_back(spark):
    px = np.full((600, 1200, 3), 60, np.uint8)
    px[100:300, 700:1000] = (112, 145, 199)
    facts = frames.frame_facts(images(spark, {"a": px}), "id")
    row = facts.select(regions.crop_proposal(F.col("crop"), F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>"), F.lit(1200), F.lit(600)).alias("c")).first().c
    assert row.source == "smartcrop" and row.left <= 700 and row.right >= 1000 - 20 and row.top <= 100 and row.bottom >= 300 - 12 and row.right - row.left < 1200


def plain_filter(row, n, kernel, half):
    scale = len(row) / n
    wide = max(scale, 1.0)
    out = []
    for i in range(n):
        centre = (i + 0.5) * scale
        w = [(k, kernel((k + 0.5 - centre) / wide)) for k in range(len(row)) if abs(k + 0.5 - centre) < half * wide]
        out.append(sum(row[k] * x for k, x in w) / sum(x for _, x in w))
    return out


def sinc3(x):
    return 1.0 if x == 0 else 0.0 if abs(x) >= 3 else 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2


def cubic(x):
    x = abs(x)
    return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0


@pytest.mark.parametrize("kind, kernel, half", [("sinc", sinc3, 3), ("cubic", cubic, 2)])
def test_filters_are_those_of_the_published_kernels(kind, kernel, half):
    row = np.random.default_rng(2).integers(0, 255, 97)
    for n in (10, 41, 96, 97, 150):
        got = frames.resize(row[None, :].astype(np.uint8), 1, n, kind)[0]
        want = np.clip(plain_filter(row.tolist(), n, kernel, half), 0, 255) if n != 97 else row
        assert np.abs(got - np.asarray(want)).max() <= 1
        assert (frames.resize(np.full((5, 97, 3), 77, np.uint8), 3, n, kind) == 77).all()
        ramp = frames.resize(np.linspace(20, 220, 97)[None, :], 1, n, kind)[0].astype(float)
        inner = slice(n // 4, -(n // 4))
        want = np.interp((np.arange(n) + 0.5) * 97 / n - 0.5, np.arange(97), np.linspace(20, 220, 97))
        assert np.abs(ramp - want)[inner].max() <= 1
