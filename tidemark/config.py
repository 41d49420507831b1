"""Parameters of every transform; the defaults are the values that results are defined by."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Windows:
    shortest: float = 20.0
    longest: float = 60.0
    target: float = 40.0
    bucket: float = 8.0
    most: int = 40
    clips: int = 5


@dataclass(frozen=True)
class Captions:
    words: int = 4
    gap: float = 1.0
    breaks: str = ".!?,"


@dataclass(frozen=True)
class Tracking:
    sample_fps: float = 2.0
    link_distance: float = 1.0
    link_gap_seconds: float = 8.0
    merge_distance: float = 1.0
    detect_width: int = 640
    narrowest_fraction: float = 0.035
    narrowest: int = 12

    @property
    def link_gap(self) -> int:
        return int(self.link_gap_seconds * self.sample_fps)


@dataclass(frozen=True)
class Layout:
    persistent: float = 0.40
    span_coverage: float = 0.25
    span: float = 0.70
    single: float = 0.30
    dominance: float = 0.5
    separation: float = 0.15


@dataclass(frozen=True)
class Smoothing:
    smooth_seconds: float = 1.5
    dead_fraction: float = 0.06
    glide_seconds: float = 1.0


# What is shown for stages and layouts.
STATUS = {
    "importing": "Importing video...",
    "transcribing": "Transcribing...",
    "ranking": "Finding best moments...",
    "clipping": "Creating clips...",
    "done": "Done.",
    "error": "Error.",
}
LABELS = {"TWO_PERSON": "split-screen", "SINGLE_PERSON": "face-centred", "CENTER_CROP": "centre crop"}


def setting(name: str, default: str, env: Mapping[str, str] | None = None) -> str:
    """An environment variable, or the default if it is unset or blank."""
    return ((env if env is not None else os.environ).get(name) or "").strip() or default


def truthy(text: str | None) -> bool:
    return (text or "").strip().lower() in ("1", "true", "yes", "on")
