"""Closed configurations, bound at plan time: an unknown key is an error before any job runs."""

from __future__ import annotations

from dataclasses import dataclass, field


def rint(x: float) -> int:
    """Half to even, the rule for every conversion of seconds to frames."""
    return round(x)


def frames(sec: float, fps: float, least: int) -> int:
    return max(least, rint(float(sec) * float(max(1e-6, fps))))


@dataclass(frozen=True)
class Gate:
    """Hysteresis clip gate. start and stay name score columns."""

    enabled: bool = True
    start_metric: str = "fg_pixels"
    start_threshold: float = 550.0
    start_consecutive: int = 1
    stay_metric: str = "stay_score"
    stay_threshold: float = 0.001
    pre_roll_sec: float = 0.0
    post_roll_sec: float = 1.5
    cnn_start_enabled: bool = True
    cnn_start_threshold: float = 0.80
    cnn_start_consecutive: int = 2
    cnn_start_requires_motion: bool = True
    cnn_start_motion_metric: str = "fg_ratio"
    cnn_start_motion_threshold: float = 0.00025


@dataclass(frozen=True)
class Memory:
    """Motion history: every pixel that moves counts down from tau."""

    enabled: bool = True
    tau_sec: float = 1.0
    recent_thresh: float = 0.3


@dataclass(frozen=True)
class Scorer:
    """The frame scorer: when it runs, and the presence latch that it refreshes."""

    enabled: bool = False
    p_set: float = 0.45
    p_start_high: float = 0.80
    presence_tau_sec: float = 2.0
    refresh_requires_motion: bool = True
    motion_min_fg_ratio: float = 0.00025
    stride_recording: int = 8
    stride_idle_motion: int = 15
    idle_fullframe_stride_sec: float = 0.0
    start_requires_motion: bool = True


@dataclass(frozen=True)
class Guard:
    """Night guard against false positives."""

    enabled: bool = False
    night_luma_threshold: float = 70.0
    negative_p: float = 0.25
    negative_streak_to_activate: int = 3
    hold_sec: float = 2.0
    min_matches_boost: int = 1
    update_sf_div: float = 2.0
    mhi_scale_when_active: float = 0.5


@dataclass(frozen=True)
class Adaptive:
    enabled: bool = False
    cnn_motion_low_fg_ratio: float = 0.00025
    cnn_motion_high_fg_ratio: float = 0.01
    stride_rec_weak: int = 6
    stride_rec_nomotion: int = 8
    stride_idle_weak: int = 12
    mhi_requires_arm: bool = True
    mhi_arm_fg_ratio: float = 0.002
    mhi_arm_hold_sec: float = 1.5
    mhi_extra_decay_night_sec: float = 0.8
    fp_guard: Guard = field(default_factory=Guard)


@dataclass(frozen=True)
class Machine:
    """Everything a video's ordered state needs. flavour: `vibe` (motion history) or `mog2` (motion average)."""

    flavour: str = "vibe"
    fps: float = 10.0
    gate: Gate = field(default_factory=Gate)
    memory: Memory = field(default_factory=Memory)
    scorer: Scorer = field(default_factory=Scorer)
    adaptive: Adaptive = field(default_factory=Adaptive)
    motion_alpha: float = 0.2

    def __post_init__(self) -> None:
        if self.flavour not in ("vibe", "mog2"):
            raise ValueError(f"no flavour is called {self.flavour!r}")
        for name in (self.gate.start_metric, self.gate.stay_metric, self.gate.cnn_start_motion_metric):
            if name not in SCORES:
                raise KeyError(f"no score is called {name!r}; there are {', '.join(SCORES)}")


@dataclass(frozen=True)
class Background:
    """Sample-based background model with an adaptive match threshold (AT) and update rate (ALR)."""

    num_samples: int = 20
    min_matches: int = 2
    radius: int = 20
    subsampling_factor: int = 16
    adaptive_min_matches: bool = False
    intensity_min: float = 40.0
    intensity_max: float = 160.0
    min_matches_min: int = 1
    min_matches_max: int = 4
    intensity_ema_alpha: float = 0.2
    adaptive_update: bool = False
    motion_low: float = 0.001
    motion_high: float = 0.05
    update_sf_min: int = 8
    update_sf_max: int = 64
    motion_ema_alpha: float = 0.2


@dataclass(frozen=True)
class Postprocess:
    median_blur_ksize: int = 3
    erode_iters: int = 1
    dilate_iters: int = 2
    min_blob_area: int = 200
    max_blobs: int = 3


#: Scores that a gate can test.
SCORES = ("fg_pixels", "fg_ratio", "mhi_active_ratio", "motion_ema", "cnn_p", "presence_score", "stay_score")
#: Names of the scores in configuration files.
ALIASES = {"vibe_fg_pixels": "fg_pixels", "vibe_fg_ratio": "fg_ratio", "mog2_fg_pixels": "fg_pixels", "mog2_fg_ratio": "fg_ratio", "cnn_p_frame": "cnn_p", "cnn_presence_score": "presence_score"}


def machine_from(config: dict, fps: float, flavour: str = "vibe") -> Machine:
    """Binds the sections of a configuration file; unknown keys of a gate, memory or adaptive section raise TypeError."""
    gate = {k: ALIASES.get(v, v) if k.endswith("_metric") else v for k, v in (config.get("gate") or {}).items()}
    cnn = config.get("cnn") or {}
    adaptive = dict(config.get("adaptive") or {})
    adaptive["fp_guard"] = Guard(**(adaptive.get("fp_guard") or {}))
    alpha = float(config.get("motion_ema_alpha") or (config.get("motion") or {}).get("ema_alpha") or 0.2)
    return Machine(flavour, fps, Gate(**gate), Memory(**(config.get("mhi") or {})), Scorer(**{k: v for k, v in cnn.items() if k in Scorer.__dataclass_fields__}), Adaptive(**adaptive), min(1.0, max(0.0, alpha)))


def background_from(config: dict) -> tuple[Background, Postprocess]:
    return Background(**(config.get("vibe") or {})), Postprocess(**{**(config.get("postprocess") or {}), **(config.get("components") or {})})


@dataclass(frozen=True)
class Mixed:
    """Gaussian mixture background model, and from which level its mask counts."""

    history: int = 500
    var_threshold: float = 16.0
    detect_shadows: bool = True
    keep_shadows_as_fg: bool = False
    learning_rate: float = -1.0
    threshold: int = 200


@dataclass(frozen=True)
class Crops:
    """What the scorer sees of a frame."""

    max_crops: int = 3
    min_crop_area: int = 160
    expand_ratio: float = 1.35
    pad_px: int = 4
    input_size: int = 224
    output: str = "auto"
    positive_index: int = 1
    full_frame_if_no_crops: bool = True


def mixed_from(config: dict) -> Mixed:
    return Mixed(**(config.get("mog2") or {}))


def crops_from(config: dict) -> Crops:
    cnn = config.get("cnn") or {}
    return Crops(**{k: v for k, v in cnn.items() if k in Crops.__dataclass_fields__ and v is not None})


@dataclass(frozen=True)
class Range:
    """Which part of a video is evaluated, and at which width."""

    start_sec: float = 0.0
    end_sec: float | None = None
    warmup_sec: float = 0.0
    resize_width: int | None = None


def range_from(config: dict) -> Range:
    part = {k: v for k, v in (config.get("eval") or {}).items() if k in Range.__dataclass_fields__ and v is not None}
    return Range(**part, resize_width=(config.get("preprocess") or {}).get("resize_width"))
