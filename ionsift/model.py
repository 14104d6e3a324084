"""Schemas, parameters and the settings file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace

POINTS = "frame_id long, point_id long, scan int, tof long, intensity long"
FRAMES = "frame_id long, num_scans int, num_peaks long, ms_ms_type int, rt_seconds double"
#: Intensities are unsigned 32-bit: sums are clipped to this.
MOST = 4_294_967_295


# The documented defaults.
@dataclass(frozen=True)
class Streak:
    mz_half_width: int = 3
    min_feature_length: int = 5
    max_internal_gap: int = 2
    min_window_intensity: int = 0
    min_feature_intensity: int = 0
    iterations: int = 2


#: The streak filter's defaults on combined MS/MS spectra.
MSMS = Streak(3, 3, 8, 0, 0, 1)


@dataclass(frozen=True)
class Halo:
    peak_fraction: float = 0.15
    mz_idx_half_width: int = 80
    scan_half_width: int = 2


@dataclass(frozen=True)
class Smooth:
    mz_idx_half_width: int = 2
    scan_half_width: int = 3
    iterations: int = 1


@dataclass(frozen=True)
class Watershed:
    box_scan: int = 10
    box_mz_idx: int = 3
    min_seed_intensity: int = 0
    min_centroid_total: int = 0
    max_tof_offset: int = 10


@dataclass(frozen=True)
class BoxCentroid:
    mz_idx_half: int = 2
    scan_half: int = 2
    min_total: int = 0


@dataclass(frozen=True)
class Pads:
    mz_pad: float = 5.0
    im_pad: float = 0.05


@dataclass(frozen=True)
class Crop:
    """Bounds are inclusive; m/z in Da, mobility in 1/K0, retention time in minutes."""

    mz_min: float | None = None
    mz_max: float | None = None
    im_min: float | None = None
    im_max: float | None = None
    rt_min: float | None = None
    rt_max: float | None = None
    min_intensity: int | None = None
    max_intensity: int | None = None

    def is_empty(self) -> bool:
        return all(getattr(self, f.name) is None for f in fields(self))

    def has_rt(self) -> bool:
        return self.rt_min is not None or self.rt_max is not None


@dataclass(frozen=True)
class Stages:
    """Optional stages, all off: None or False."""

    all_frames: bool = False
    frame_half_width: int = 0
    halo: Halo | None = None
    denoise_msms: Streak | None = None
    smooth: Smooth | None = None
    watershed: Watershed | None = None
    box_centroid: BoxCentroid | None = None
    dia_window: int | None = None  # scan pad
    dda_window: int | None = None  # scan pad
    dia_per_window: bool = False
    dia_ms1: Pads | None = None
    ms1_polygon: Pads | None = None


@dataclass(frozen=True)
class Calibration:
    """``mz = (a + b * tof) ** 2`` and ``im = c + d * scan`` with ``b > 0 > d``."""

    a: float
    b: float
    c: float
    d: float

    def mz(self, tof: float) -> float:
        return (self.a + self.b * tof) ** 2

    def tof(self, mz: float) -> float:
        return (mz**0.5 - self.a) / self.b

    def im(self, scan: float) -> float:
        return self.c + self.d * scan

    def scan(self, im: float) -> float:
        return (im - self.c) / self.d


def tof_half_width(ppm: float, calibration: Calibration, reference: float | None = None, acquired: tuple[float, float] | None = None) -> int:
    """A relative m/z tolerance as TOF indices at the reference m/z: the given one, else the middle of what was acquired, else 800."""
    at = reference if reference is not None else sum(acquired) / 2 if acquired else 800.0
    width = abs(calibration.tof(at * (1 + ppm * 1e-6)) - calibration.tof(at))
    return max(1, int(width + 0.5))


# The settings file's keys, by the type of their value.
KEYS: dict[type, str] = {
    int: """mz_half_width min_feature_length max_internal_gap min_window_intensity min_feature_intensity iterations
        frame_half_width halo_mz_idx_half_width halo_scan_half_width msms_mz_half_width msms_min_feature_length
        msms_max_internal_gap msms_min_window_intensity msms_min_feature_intensity msms_iterations smooth_mz_idx_half_width
        smooth_scan_half_width smooth_iterations watershed_box_scan watershed_box_mz_idx watershed_min_seed_intensity
        watershed_min_centroid_total watershed_max_tof_offset box_centroid_mz_idx_half box_centroid_scan_half
        box_centroid_min_total dia_window_scan_pad dda_window_scan_pad min_intensity max_intensity threads""",
    float: """halo_peak_fraction dia_ms1_mz_pad dia_ms1_im_pad ms1_polygon_mz_pad ms1_polygon_im_pad mz_min mz_max im_min im_max
        rt_min rt_max mz_ppm mz_ppm_ref""",
    bool: """halo denoise_msms smooth watershed box_centroid dia_window dia_per_window dda_window dia_ms1_window ms1_polygon
        crop_only all_frames""",
}
KIND = {k: t for t, names in KEYS.items() for k in names.split()}


def load_settings(path: str) -> dict:
    """A settings file as a dict; unknown keys and wrong types are errors."""
    with open(path, "rb") as f:
        return check_settings(tomllib.load(f))


def check_settings(given: dict) -> dict:
    for k, v in given.items():
        if k not in KIND:
            raise ValueError(f"unknown setting {k!r}")
        if (isinstance(v, bool) != (KIND[k] is bool)) or not isinstance(v, (int, float) if KIND[k] is float else KIND[k]):
            raise ValueError(f"setting {k!r} must be {KIND[k].__name__}")
        if KIND[k] is int and v < 0:
            raise ValueError(f"setting {k!r} must not be negative")
    return given


def dump_settings(settings: dict) -> str:
    """The settings as TOML; unset ones are left out."""
    show = lambda v: str(v).lower() if isinstance(v, bool) else repr(v)
    return "".join(f"{k} = {show(v)}\n" for k, v in check_settings({k: v for k, v in settings.items() if v is not None}).items())


@dataclass(frozen=True)
class Plan:
    """What a run does."""

    streak: Streak = Streak()
    stages: Stages = Stages()
    crop: Crop = Crop()
    crop_only: bool = False


def resolve(flags: dict | None = None, settings: dict | None = None) -> Plan:
    """Command-line flags over settings file over defaults; a False flag (``--no-x``) beats everything.

    The halo and both MS1 gates are on by default; the MS/MS window gates and the per-window filter are on where MS/MS
    frames are filtered.
    """
    both = check_settings({k: v for k, v in (settings or {}).items() if v is not None}) | check_settings({k: v for k, v in (flags or {}).items() if v is not None})
    get = lambda k, default: both.get(k, default)

    def made(base, prefix: str, names: dict[str, str] | None = None):
        renamed = names or {}
        return replace(base, **{f.name: both[k] for f in fields(base) if (k := f"{prefix}{renamed.get(f.name, f.name)}") in both})

    msms, every = get("denoise_msms", False), get("all_frames", False)
    if get("watershed", False) and get("box_centroid", False):
        raise ValueError("watershed and box_centroid exclude each other")
    crop = Crop(**{f.name: both[f.name] for f in fields(Crop) if f.name in both})
    if get("crop_only", False) and crop.is_empty():
        raise ValueError("crop_only needs a crop bound")
    return Plan(
        made(Streak(), ""),
        Stages(
            all_frames=every,
            frame_half_width=get("frame_half_width", 0),
            halo=made(Halo(), "halo_") if get("halo", True) else None,
            denoise_msms=made(MSMS, "msms_") if msms else None,
            smooth=made(Smooth(), "smooth_") if get("smooth", False) else None,
            watershed=made(Watershed(), "watershed_") if get("watershed", False) else None,
            box_centroid=made(BoxCentroid(), "box_centroid_") if get("box_centroid", False) else None,
            dia_window=get("dia_window_scan_pad", 0) if get("dia_window", msms or every) else None,
            dda_window=get("dda_window_scan_pad", 0) if get("dda_window", msms or every) else None,
            dia_per_window=get("dia_per_window", msms or every),
            dia_ms1=made(Pads(), "dia_ms1_") if get("dia_ms1_window", True) else None,
            ms1_polygon=made(Pads(), "ms1_polygon_") if get("ms1_polygon", True) else None,
        ),
        crop,
        get("crop_only", False),
    )


#: Presets of the desktop program -> gates that are on.
PRESETS = {"dda": ("ms1_polygon",), "dia": ("dia_ms1_window", "dia_window"), "none": ()}


def preset_gates(preset: str, acquisition: str = "Unknown") -> dict[str, bool]:
    """The three gates under a preset; ``auto`` follows the acquisition."""
    chosen = {"DdaPasef": "dda", "DiaPasef": "dia"}.get(acquisition, "none") if preset == "auto" else preset
    return {g: g in PRESETS[chosen] for g in ("ms1_polygon", "dia_ms1_window", "dia_window")}


@dataclass
class Geometry:
    """Tables that describe the acquisition; any may be missing (None), and then its gates do nothing."""

    pasef_windows: object = None  # frame_id, scan_begin, scan_end, precursor, event
    dia_windows: object = None  # frame_id, scan_begin, scan_end: merged, one row per interval
    dia_boxes: object = None  # scan_begin, scan_end, mz_lo, mz_hi
    polygon: list[tuple[float, float]] = field(default_factory=list)  # (m/z, 1/K0)
    calibration: Calibration | None = None
