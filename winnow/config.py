"""Thresholds, weights and the run configuration."""

from __future__ import annotations

from dataclasses import dataclass

# Results depend on each of them.
KEEPER_MIN = 0.72
AMBIGUOUS_MIN = 0.48
SUBJECT_DIVISOR = 1000.0
TASTE_RAMP = 20
TASTE_MIN_LABELS = 5
RETRAIN_BATCH = 50
HAMMING_MAX = 8
DUPLICATE_COSINE = 0.98
TENENGRAD_MIN = 100.0
FFT_MIN = 0.05
FFT_RADIUS = 0.6
BOKEH_RATIO = 2.0
CENTRE_FRACTION = 0.40
MOTION_DIRECTIONS = 8
MOTION_RATIO = 3.0
CLIP_HIGH, CLIP_LOW = 253, 2
CLIP_HIGH_MAX, CLIP_LOW_MAX = 0.03, 0.20
RANGE_MIN = 0.45
MIDTONE_LOW, MIDTONE_HIGH = 64, 192
CAST_A, CAST_B, CAST_ALL = 8.0, 12.0, 18.0
NOISE_MAX = 0.70
NOISE_TILE = 16
NOISE_SCALE = 1000.0
TILT_MAX, KEYSTONE_MAX = 3.0, 5.0
PALETTE_SIGMA, EXPOSURE_SIGMA, EXIF_SIGMA = 2.5, 2.0, 3.0
BURST_GAP = 0.5
SCENE_GAP = 4 * BURST_GAP
TOP_K = 20
CURATE_TARGET = 30
EXIF_SAMPLE = 15
AUTO_ACCEPT = 0.60
MMR_LAMBDA = 0.5
EYE_OPEN_MIN, SMILE_MIN = 0.25, 0.40
EAR_CLOSED, VISIBILITY_MIN, FACE_LANDMARKS, FACE_VISIBLE_MIN = 0.20, 0.70, 468, 0.70
CLOSE_UP_MIN, MEDIUM_MIN, SALIENT_WIDE_MIN = 0.15, 0.03, 0.50
VARIETY_MIN = 0.60
MOTION_WINDOW = 5
MOTION_RISK_SECONDS = 1 / 125
MOTION_ADVICE, EXPOSURE_ADVICE, LOW_KEEP_RATE = 0.30, 0.20, 0.10
LOG_TAIL = 50

KEEP_LABELS = ("keeper", "select")
REJECT_LABELS = ("rejected", "duplicate")
RATINGS = {"keeper": 5, "select": 4, "uncertain": 3, "rejected": 1, "duplicate": 1}

# Weights common to all presets.
COMMON = {"composition": 0.15, "taste": 0.15, "palette": 0.05, "drift": 0.05, "exif": 0.03, "scene": 0.04}
# Weights and policies of each preset.
PRESET_COLUMNS = ("topiq", "laion", "clipiqa", "exposure", "tilt", "blend", "bokeh", "portrait", "eyes", "occlusion", "cluster")
PRESET_ROWS = {
    "general": (0.35, 0.35, 0.20, 0.10, 0.10, 0.25, 0.03, 0.05, 0.12, 0.08, 0.15),
    "wedding": (0.25, 0.40, 0.25, 0.10, 0.05, 0.30, 0.05, 0.08, 0.18, 0.12, 0.10),
    "documentary": (0.30, 0.30, 0.30, 0.10, 0.05, 0.22, 0.02, 0.05, 0.10, 0.08, 0.15),
    "wildlife": (0.50, 0.20, 0.20, 0.10, 0.05, 0.35, 0.01, 0.0, 0.0, 0.0, 0.15),
    "landscape": (0.30, 0.35, 0.15, 0.20, 0.20, 0.10, 0.0, 0.0, 0.0, 0.0, 0.20),
    "street": (0.30, 0.30, 0.30, 0.10, 0.10, 0.20, 0.03, 0.05, 0.08, 0.06, 0.20),
    "holiday": (0.30, 0.325, 0.225, 0.15, 0.10, 0.28, 0.04, 0.06, 0.12, 0.08, 0.18),
}
PRESETS = {name: dict(zip(PRESET_COLUMNS, row)) | COMMON for name, row in PRESET_ROWS.items()}


def preset(name: str) -> dict[str, float]:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; known: {', '.join(PRESETS)}")
    return PRESETS[name]


def fast_weights(name: str) -> dict[str, float]:
    """The preset with only topiq, laion and exposure, scaled to sum 1; tilt and bokeh stay."""
    w = preset(name)
    total = w["topiq"] + w["laion"] + w["exposure"]
    if total <= 0:
        raise ValueError(f"preset {name!r} has no core weights")
    zero = dict.fromkeys(w, 0.0)
    return zero | {k: w[k] / total for k in ("topiq", "laion", "exposure")} | {k: w[k] for k in ("tilt", "bokeh", "cluster")}


@dataclass(frozen=True)
class RunConfig:
    """What a run is asked for.  threshold and pair_threshold are accepted and change nothing.

    is_shoot_a_folder: bursts, scenes and shoot statistics are those of each folder, not of the whole run; runs over many
    shoots need it, to spread them over tasks.
    """

    preset: str = "general"
    burst_gap: float = BURST_GAP
    stages: tuple[int, ...] = (1, 2, 3)
    is_portrait: bool = True
    is_dry_run: bool = False
    is_sidecars: bool = False
    is_fast: bool = False
    refuse_mode: str = "compat"
    is_shoot_a_folder: bool = False
    curate_target: int | None = None
    near_cosine: float = DUPLICATE_COSINE
    model: str | None = None
    threshold: float = 0.65
    pair_threshold: float = 0.02

    def __post_init__(self) -> None:
        preset(self.preset)
        if not set(self.stages) <= {1, 2, 3}:
            raise ValueError("stages are 1, 2 and 3")
        if self.curate_target is not None and not {1, 2} <= set(self.stages):
            raise ValueError("curation needs stages 1 and 2")
        if self.refuse_mode not in ("compat", "clean"):
            raise ValueError("refuse_mode is compat or clean")
