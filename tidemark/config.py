"""All tunables of a study in one immutable value that is passed along, never changed in place."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

ANNOUNCEMENTS_FILE = "corporate_announcements.jsonl"


@dataclass(frozen=True)
class StudyConfig:
    # fixed values: a session of 375 one-minute bars from 09:15, and the study's windows
    open_minute: int = 9 * 60 + 15
    close_minute: int = 15 * 60 + 30
    bar_minutes: int = 1
    bars_per_session: int = 375
    intraday_windows: tuple[int, ...] = (5, 30, 60)
    main_window: int = 60
    horizons: tuple[int, ...] = (1, 3, 5, 10, 20)
    baseline_sessions: int = 20
    cluster_hours: int = 36
    namer: str = "any"  # or "substantive"
    bootstrap_iters: int = 10_000
    permutation_iters: int = 10_000
    seed: int = 20260828
    alpha: float = 0.05
    min_events: int = 10
    strong_return: float = 2.0
    strong_volume: float = 2.0
    exclusion_radius: int = 25
    peer_lookback: int = 5
    placebo_iters: int = 2000
    sweep_hours: tuple[int, ...] = (12, 24, 36, 48, 72)
    sweep_returns: tuple[float, ...] = (1.5, 2.0, 2.5, 3.0)
    sweep_volumes: tuple[float, ...] = (1.5, 2.0, 2.5)
    scrip_codes: Mapping[int, str] = field(default_factory=dict)

    @property
    def main(self) -> str:
        return f"{self.main_window}m"


#: The driver's hourly bars: a session is a day of 24 bars. Fewer resamples than a published study would take.
HOURLY = StudyConfig(open_minute=0, close_minute=24 * 60, bar_minutes=60, bars_per_session=24, intraday_windows=(2, 6, 12), main_window=12, horizons=(1, 3, 5), baseline_sessions=20, bootstrap_iters=500, permutation_iters=300, placebo_iters=200, exclusion_radius=1, peer_lookback=1)


def data_dir(variable: str = "TIDEMARK_DATA_DIR", candidates: tuple[str, ...] = ("data/raw", "../data/raw")) -> Path:
    """The named folder if the variable is set (it must exist), else the first candidate with the announcements file."""
    named = os.environ.get(variable)
    if named:
        if not Path(named).is_dir():
            raise FileNotFoundError(f"{variable} names no folder: {named}")
        return Path(named)
    for path in map(Path, candidates):
        if (path / ANNOUNCEMENTS_FILE).exists():
            return path
    raise FileNotFoundError(f"no {ANNOUNCEMENTS_FILE} in {', '.join(candidates)}; set {variable}")
