"""Parameters of the engine and their defaults; times are microseconds unless named otherwise."""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
TS_MIN, TS_MAX = 946_684_800_000_000, 4_102_444_800_000_000  # 2000-01-01 and 2100-01-01


@dataclass(frozen=True)
class Grid:
    """Bucket widths delta * base**level, in tiles of ``tile`` buckets."""

    delta: int = SECOND
    base: int = 4
    levels: int = 8
    tile: int = 1024

    def width(self, level: int) -> int:
        return self.delta * self.base**level


@dataclass(frozen=True)
class ChannelParams:
    hampel_window: int = 15
    hampel_kappa: float = 3.0
    hampel_min_sigma: float = 0.0
    feature_window: int = 30
    residual_k: float = 3.0
    episode_gap: int = 5 * SECOND
    warm_up: int = 100
    #: Rows of one channel that a window task holds are those of this much time, and what precedes them.
    chunk: int = 30 * DAY


@dataclass(frozen=True)
class ChartParams:
    width: int = 1200
    per_pixel: float = 2.0
    rho: float = 2.0


ALLOWED_LATENESS, HOT_WINDOW = 30 * SECOND, 600 * SECOND
