"""What single frames and neighbouring frames show: straight lines, motion, crops, resampling.

Kernels work on arrays of one frame (or two); the DataFrame functions at the end run them once per decoded image.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regions import CROP_EDGE
from ..tables import ship

# ---------------------------------------------------------------- resampling


def _sinc3(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    near, far = ((a + 2) * x - (a + 3)) * x * x + 1, a * (((x - 5) * x + 8) * x - 4)
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


#: name -> (kernel, half its width at scale 1).
KERNELS = {"sinc": (_sinc3, 3.0), "cubic": (_cubic, 2.0)}


def filter_bank(size: int, n: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights), a row for each of n samples over `size`: which inputs it takes and how much of each; weights sum to
    1.  Downwards the kernel widens with the scale, so that nothing is skipped."""
    kernel, half = KERNELS[kind]
    scale = size / n
    wide = max(scale, 1.0)
    centre = (np.arange(n) + 0.5) * scale
    first = np.floor(centre - half * wide).astype(int)
    places = first[:, None] + np.arange(int(math.ceil(2 * half * wide)) + 2)
    weights = kernel((places + 0.5 - centre[:, None]) / wide) * ((places >= 0) & (places < size))
    return np.clip(places, 0, size - 1), weights / weights.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int, kind: str = "sinc") -> np.ndarray:
    """image (h, w[, channels]) at another size by a separable filter, rounded to bytes."""
    out = image.astype(np.float64)
    for axis, n in ((1, width), (0, height)):
        if out.shape[axis] != n:
            places, weights = filter_bank(out.shape[axis], n, kind)
            moved = np.moveaxis(out, axis, 0)
            done = np.zeros((n, *moved.shape[1:]))
            for k in range(places.shape[1]):  # a few taps
                done += moved[places[:, k]] * weights[:, k].reshape(-1, *[1] * (moved.ndim - 1))
            out = np.moveaxis(done, 0, axis)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


# ---------------------------------------------------------------- straight lines


ENDS = ("x1", "y1", "x2", "y2")
SECTORS = 8
#: Half the width of a sector of angles, and the chance that a random gradient lies so near a direction.
TOLERANCE = math.pi / SECTORS
CHANCE = 1 / SECTORS
#: Weaker gradients have no direction to speak of: steps of two grey levels turn it by more than the tolerance.
WEAK = 2 / math.sin(TOLERANCE)


def _labels(sector: np.ndarray) -> np.ndarray:
    """For each pixel the first pixel of its group: pixels that touch and are of one sector (negative: of none)."""
    h, w = sector.shape
    place = np.arange(h * w).reshape(h, w)
    ends = []
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
        a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
        b = (slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
        same = (sector[a] == sector[b]) & (sector[a] >= 0)
        ends.append((place[a][same], place[b][same]))
    u, v = (np.concatenate(x) for x in zip(*ends))
    label = place.ravel().copy()
    while True:
        a, b = label[u], label[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if not (low < high).any():
            return label.reshape(h, w)
        np.minimum.at(label, high, low)
        while True:  # point at the first of the first
            up = label[label]
            if (up == label).all():
                break
            label = up


def _tail(n: int, k: int, p: float) -> float:
    """The natural logarithm of the chance of at least k of n hits at chance p (Hoeffding's bound)."""
    if k <= n * p:
        return 0.0
    q = k / n
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def line_segments(gray: np.ndarray) -> np.ndarray:
    """(n, 4) ends x1, y1, x2, y2 of straight edges.

    Pixels whose gradients point into one sector and that touch form groups, under two sets of sectors of which the second
    is turned by half a sector; a pixel stands for the larger of its two groups, and groups most of whose pixels stand
    for them stay.  Each gets the rectangle of its weighted moments, and is a segment if so many pixels in it agree in
    direction that less than one such rectangle would be found in a frame of noise.
    """
    g = gray.astype(np.float64)
    if min(g.shape) < 8:
        return np.zeros((0, 4))
    gx = (g[:-1, 1:] - g[:-1, :-1] + g[1:, 1:] - g[1:, :-1]) / 2
    gy = (g[1:, :-1] - g[:-1, :-1] + g[1:, 1:] - g[:-1, 1:]) / 2
    steep, angle = np.hypot(gx, gy), np.arctan2(gy, gx)
    h, w = steep.shape
    strong = steep > WEAK
    tests = 2.5 * math.log(h * w)  # the logarithm of how many rectangles a frame has
    least = int(math.ceil(-tests / math.log(CHANCE)))
    groups = []
    for turn in (0.0, TOLERANCE):
        sector = np.where(strong, np.floor(np.mod(angle + turn + TOLERANCE, 2 * math.pi) / (2 * TOLERANCE)).astype(int) % SECTORS, -1)
        label = np.where(strong, _labels(sector), -1)
        groups.append((label, np.bincount(label[strong], minlength=h * w)))
    (one, n_one), (two, n_two) = groups
    first = strong & (np.where(strong, n_one[one], 0) >= np.where(strong, n_two[two], 0))
    out = []
    for (label, sizes), own in zip(groups, (first, strong & ~first)):
        votes = np.bincount(label[own], minlength=h * w)
        kept = np.flatnonzero((sizes >= least) & (2 * votes > sizes))
        if not len(kept):
            continue
        at = np.flatnonzero(strong.ravel() & np.isin(label.ravel(), kept))
        at = at[np.argsort(label.ravel()[at], kind="stable")]
        cut = np.flatnonzero(np.diff(label.ravel()[at])) + 1
        for px in np.split(at, cut):
            found = _rectangle(px, steep, angle, w, tests)
            if found is not None:
                out.append(found)
    return np.array(out).reshape(-1, 4)


def _rectangle(px: np.ndarray, steep: np.ndarray, angle: np.ndarray, w: int, tests: float) -> tuple | None:
    y, x = np.divmod(px, w)
    weight = steep.ravel()[px]
    cx, cy = np.average(x, weights=weight), np.average(y, weights=weight)
    dx, dy = x - cx, y - cy
    xx, yy, xy = (np.average(v, weights=weight) for v in (dx * dx, dy * dy, dx * dy))
    along = 0.5 * math.atan2(2 * xy, xx - yy)
    ux, uy = math.cos(along), math.sin(along)
    s, t = dx * ux + dy * uy, dy * ux - dx * uy
    s0, s1, t0, t1 = s.min(), s.max(), t.min(), t.max()
    length, width = s1 - s0, max(t1 - t0, 1.0)
    if length < 3 * width:
        return None
    # all pixels of the rectangle, and those whose gradients stand across it
    ys = np.arange(max(0, y.min() - 1), min(steep.shape[0], y.max() + 2))
    xs = np.arange(max(0, x.min() - 1), min(w, x.max() + 2))
    gx, gy = np.meshgrid(xs - cx, ys - cy)
    a, b = gx * ux + gy * uy, gy * ux - gx * uy
    inside = (a >= s0) & (a <= s1) & (b >= t0) & (b <= t1)
    box = np.ix_(ys, xs)
    way = math.atan2(np.average(np.sin(angle.ravel()[px]), weights=weight), np.average(np.cos(angle.ravel()[px]), weights=weight))
    across = along + math.pi / 2
    if math.cos(way - across) < 0:
        across += math.pi
    off = np.abs(np.mod(angle[box] - across + math.pi, 2 * math.pi) - math.pi)
    n, k = int(inside.sum()), int((inside & (off <= TOLERANCE) & (steep[box] > WEAK)).sum())
    if not n or tests + _tail(n, k, CHANCE) > 0:
        return None
    return cx + s0 * ux + 0.5, cy + s0 * uy + 0.5, cx + s1 * ux + 0.5, cy + s1 * uy + 0.5


# ---------------------------------------------------------------- motion


PATCH, REACH = 8, 2


def _half(g: np.ndarray) -> np.ndarray:
    h, w = (n // 2 * 2 for n in g.shape)
    return g[:h, :w].reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3))


def motion(before: np.ndarray, after: np.ndarray) -> float:
    """The mean length in pixels of how far patches of one grey frame have moved in the next.

    Coarse to fine over halved frames: each patch starts from twice where the coarser level left it and takes the offset
    within REACH of that with the least absolute difference, the nearest to the start of equal ones; the finest level
    adds the vertex of a parabola through the neighbours.  Patches without any contrast do not count.
    """
    if before.shape != after.shape or min(before.shape) < PATCH:
        return 0.0
    levels = [(before.astype(np.float64), after.astype(np.float64))]
    while min(levels[-1][0].shape) >= 4 * PATCH:
        levels.append(tuple(map(_half, levels[-1])))
    offsets = sorted(((dy, dx) for dy in range(-REACH, REACH + 1) for dx in range(-REACH, REACH + 1)), key=lambda o: (o[0] ** 2 + o[1] ** 2, o))
    move, grid = None, (0, 0)
    for level, (a, b) in enumerate(reversed(levels)):
        ny, nx = (n // PATCH for n in a.shape)
        own = a[: ny * PATCH, : nx * PATCH].reshape(ny, PATCH, nx, PATCH).swapaxes(1, 2)
        y, x = np.meshgrid(np.arange(ny) * PATCH, np.arange(nx) * PATCH, indexing="ij")
        if move is None:
            start = np.zeros((2, ny, nx), int)
        else:
            start = 2 * move[:, np.minimum(np.arange(ny) // 2, grid[0] - 1)[:, None], np.minimum(np.arange(nx) // 2, grid[1] - 1)[None, :]]
        pad = 2 * PATCH
        windows = np.lib.stride_tricks.sliding_window_view(np.pad(b, pad, mode="edge"), (PATCH, PATCH))

        def cost(dy: np.ndarray, dx: np.ndarray, windows=windows, own=own, y=y, x=x, pad=pad) -> np.ndarray:
            at = np.clip(y + dy + pad, 0, windows.shape[0] - 1), np.clip(x + dx + pad, 0, windows.shape[1] - 1)
            return np.abs(windows[at] - own).mean(axis=(2, 3))

        best, move = np.full((ny, nx), np.inf), start.copy()
        for dy, dx in offsets:
            c = cost(start[0] + dy, start[1] + dx)
            better = c < best - 1e-9
            best[better] = c[better]
            move[0][better], move[1][better] = start[0][better] + dy, start[1][better] + dx
        # a patch takes over what a neighbour found if that fits it better
        for axis, shift in ((1, 1), (1, -1), (2, 1), (2, -1)):
            near = np.roll(move, shift, axis=axis)
            c = cost(near[0], near[1])
            better = c < best - 1e-9
            best[better] = c[better]
            move[:, better] = near[:, better]
        grid = (ny, nx)
    fine = move.astype(np.float64)
    for k, (dy, dx) in enumerate(((1, 0), (0, 1))):
        low, high = cost(move[0] - dy, move[1] - dx), cost(move[0] + dy, move[1] + dx)
        bend = low + high - 2 * best
        fine[k] += np.where(bend > 1e-9, np.clip((low - high) / np.where(bend > 1e-9, 2 * bend, 1), -0.5, 0.5), 0.0)
    seen = own.std(axis=(2, 3)) > 1.0
    return float(np.hypot(*fine)[seen].mean()) if seen.any() else 0.0


# ---------------------------------------------------------------- crops


#: What a pixel counts for: steps of brightness, colour, and the tones of skin.
EDGES, COLOUR, SKIN = 0.3, 0.2, 1.0
#: Share of the frame's sides a crop may have, and what area costs against what it holds.
SIDES = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)
AREA_COST, STEP = 0.6, 8


def importance(bgr: np.ndarray) -> np.ndarray:
    """What each pixel of a frame counts for in a crop, 0 or more."""
    x = bgr.astype(np.float64) / 255
    gray = x @ [0.114, 0.587, 0.299]
    p = np.pad(gray, 1, mode="edge")
    edges = np.clip(np.abs(4 * gray - p[:-2, 1:-1] - p[2:, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:]), 0, 1)
    most, least = x.max(axis=2), x.min(axis=2)
    colour = np.where(most > 0, (most - least) / np.maximum(most, 1e-9), 0.0)
    # how near the direction of the colour lies to that of skin
    length = np.sqrt((x * x).sum(axis=2))
    skin = np.clip(1 - np.linalg.norm(x / np.maximum(length, 1e-9)[..., None] - np.array([0.44, 0.57, 0.78]) / np.linalg.norm([0.44, 0.57, 0.78]), axis=2) / 0.2, 0, 1)
    lit = (most >= 0.2) & (most <= 0.95)
    return EDGES * edges + np.where(lit, COLOUR * colour + SKIN * skin, 0.0)


def best_crop(value: np.ndarray) -> tuple[int, int, int, int]:
    """(x, y, width, height) of the window with the largest share of value less AREA_COST times its share of the frame.

    Windows have SIDES of the frame's sides and stand at multiples of STEP, and at the far borders; sums come from one table
    of running sums.  Of equal windows the larger, then the upper, then the left one.
    """
    h, w = value.shape
    sums = np.pad(value.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    total, best = max(float(sums[-1, -1]), 1e-12), None
    for side in SIDES:
        ch, cw = max(1, round(h * side)), max(1, round(w * side))
        ys, xs = (np.unique(np.append(np.arange(0, n - c + 1, STEP), n - c)) for n, c in ((h, ch), (w, cw)))
        inside = sums[ys[:, None] + ch, xs + cw] - sums[ys[:, None], xs + cw] - sums[ys[:, None] + ch, xs] + sums[ys[:, None], xs]
        score = inside / total - AREA_COST * (ch * cw) / (h * w)
        k = int(np.argmax(np.round(score, 9)))
        top = round(float(score.ravel()[k]), 9)
        if best is None or top > best[0]:
            best = top, (int(xs[k % len(xs)]), int(ys[k // len(xs)]), cw, ch)
    return best[1]


# ---------------------------------------------------------------- DataFrames


def _pixels(h: int, w: int, n: int, data: bytes) -> np.ndarray:
    px = np.frombuffer(data, np.uint8).reshape(h, w, n)
    return np.repeat(px, 3, axis=2) if n == 1 else px[..., :3]


def _gray(bgr: np.ndarray) -> np.ndarray:
    return np.rint(bgr @ [0.114, 0.587, 0.299]).astype(np.uint8)


def _down(bgr: np.ndarray, edge: int) -> np.ndarray:
    h, w = bgr.shape[:2]
    scale = min(1.0, edge / max(h, w))
    return bgr if scale == 1 else resize(bgr, max(1, round(h * scale)), max(1, round(w * scale)))


def frame_facts(images: DataFrame, id_col: str, image: str = "image", line_edge: int = 1280, motion_edge: int = 640) -> DataFrame:
    """(id, lines, crop, gray_height, gray_width, gray) from one decode per image; all null for a broken one.

    lines: array of struct(x1, y1, x2, y2) in a copy with a long edge of at most line_edge; crop: struct(x, y, width, height) in
    a copy of at most CROP_EDGE, as crop_proposal takes it; gray: the bytes of a grey copy of at most motion_edge.
    """
    ship(images.sparkSession)
    kind = images.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    point = pa.struct([(k, pa.float64()) for k in ENDS])
    window = pa.struct([(k, pa.int32()) for k in ("x", "y", "width", "height")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                h, w, n, data = (batch.column(k)[row].as_py() for k in range(1, 5))
                lines = crop = gray = None
                try:
                    bgr = _pixels(h, w, n, data)
                    lines = [dict(zip(ENDS, s)) for s in line_segments(_gray(_down(bgr, line_edge))).tolist()]
                    crop = dict(zip(("x", "y", "width", "height"), best_crop(importance(_down(bgr, CROP_EDGE)))))
                    gray = _gray(_down(bgr, motion_edge))
                except (ValueError, TypeError):  # bytes that are no image of that size
                    lines = crop = gray = None
                sizes = gray.shape if gray is not None else (None, None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([lines], pa.list_(point)), pa.array([crop], window), *(pa.array([x], pa.int32()) for x in sizes), pa.array([None if gray is None else gray.tobytes()], pa.binary())], names=["id", "lines", "crop", "gray_height", "gray_width", "gray"])

    slim = images.select(F.col(id_col).alias("id"), *[F.col(f"{image}.{k}") for k in ("height", "width", "nChannels", "data")])
    return slim.mapInArrow(run, f"id {kind}, lines array<struct<x1:double,y1:double,x2:double,y2:double>>, crop struct<x:int,y:int,width:int,height:int>, gray_height int, gray_width int, gray binary")


def segments(facts: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, x1, y1, x2, y2): a row for each line, as geometry() takes them."""
    return facts.select(id_col, F.explode("lines").alias("s")).select(id_col, "s.*")


def motion_pairs(frames: DataFrame, group: str, order: list[str], facts: DataFrame, id_col: str = "id") -> DataFrame:
    """(group, pos, magnitude) for each two consecutive frames of a group, pos from 0 in `order`, as motion_peak takes them.

    frames: (id, group, order...); small grey copies come from facts (see frame_facts).  A group's frames meet in one task in
    order, one pass of Arrow batches in which only the last frame is carried on.  Frames without a grey copy are left
    out, and frames of different sizes have magnitude 0.
    """
    ship(frames.sparkSession)
    own = frames.select(F.col(id_col).alias("id"), F.col(group).alias("group"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).where("group is not null")
    rows = own.join(facts.where("gray is not null").select("id", "gray_height", "gray_width", "gray"), "id")
    keys = [f"o{i}" for i in range(len(order))]
    dealt = rows.repartition("group").sortWithinPartitions("group", *keys, "id").select("group", "gray_height", "gray_width", "gray")
    kind = dealt.schema["group"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pos = None, 0
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                name, h, w, data = (batch.column(i)[k].as_py() for i in range(4))
                now = np.frombuffer(data, np.uint8).reshape(h, w)
                if last is not None and last[0] == name:
                    out.append((name, pos, motion(last[1], now)))
                    pos += 1
                else:
                    pos = 0
                last = name, now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], batch.schema.field(0).type), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], names=["group", "pos", "magnitude"])

    return dealt.mapInArrow(run, f"group {kind}, pos bigint, magnitude double").withColumnRenamed("group", group)
