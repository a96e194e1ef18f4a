"""Thresholds used across the operators, passed explicitly to every job."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # fixed values: sign-off floors and ceilings
    wf_sharpe_floor: float = 0.50
    wf_ece_ceiling: float = 0.05
    cpcv_p30_floor: float = 0.0
    dsr_floor: float = 0.95
    survivorship_floor: float = 0.80
    # fixed values: winsorising and normalisation
    # fixed values: sizing
    # fixed values: data integrity
    max_missing_bar_fraction: float = 0.02
    max_stale_cross_ticker_fraction: float = 0.20
    # fixed values: cross validation
    trial_floor: int = 2000


DEFAULTS = Settings()
