"""Thresholds and their effective values."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the data model.
STATES = ("discovered", "processing", "ready", "missing", "failed")
FLAGS = ("possibly_blurry", "possibly_underexposed", "possibly_overexposed", "possibly_low_contrast", "low_resolution", "shadows_clipped", "highlights_clipped")
SORTS = ("path", "captured_at", "file_size", "quality", "created_at")
FORMATS = {".jpg": "jpeg", ".jpeg": "jpeg", ".jpe": "jpeg", ".png": "png", ".webp": "webp"}
MAX_FILE_BYTES = 512 * 1024 * 1024
EARTH_RADIUS_METRES = 6371008.8

# Default options, and the thresholds of quality scores and flags below.
DEFAULT_THRESHOLD, MAX_THRESHOLD = 12, 24
DEFAULT_GAP_SECONDS, DEFAULT_RADIUS_METRES = 4 * 3600, 1500.0
QUALITY_EPSILON = 0.02


@dataclass(frozen=True)
class QualityThresholds:
    sharpness: float = 0.12
    dark: float = 46.0
    bright: float = 190.0
    clipping: float = 0.05
    contrast: float = 0.10
    min_pixels: int = 307_200
    full_sharpness: float = 310.0
    full_contrast: float = 64.0
    full_pixels: float = 2_000_000.0


def effective_threshold(requested: int) -> int:
    """0 means the default; others are clamped to 0..24."""
    return DEFAULT_THRESHOLD if requested == 0 else max(0, min(MAX_THRESHOLD, requested))


def effective_gap(seconds: float) -> float:
    return seconds if seconds > 0 else float(DEFAULT_GAP_SECONDS)


def effective_radius(metres: float) -> float:
    return metres if metres > 0 else DEFAULT_RADIUS_METRES


def clamp_limit(limit: int, default: int, most: int) -> int:
    """A limit out of range is replaced by the default."""
    return default if limit <= 0 or limit > most else limit
