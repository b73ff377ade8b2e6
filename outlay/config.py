"""Thresholds of the audit rules. The defaults are fixed values of the domain."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AnomalyConfig:
    global_z: float = 2.5
    category_z: float = 2.0
    category_min_rows: int = 5
    historical_factor: float = 3.0
    duplicate_tolerance: float = 0.05
    frequency_factor: float = 2.0
    score_cap: int = 10
    medium_score: int = 5
    high_score: int = 8


@dataclass(frozen=True)
class InsightConfig:
    spike_min_rows: int = 10
    spike_percentile: float = 0.25
    spike_factor: float = 1.35
    spike_high_importance: float = 0.15
    subscription_min_rows: int = 3
    subscription_max_cv: float = 0.05
    gap_min_days: int = 25
    gap_max_days: int = 35
    risky_share_pct: float = 5.0
    top: int = 10


@dataclass(frozen=True)
class MatchConfig:
    date_tolerance_days: int = 7
    amount_tolerance: float = 0.02
    min_score: float = 0.6
    similarity: str = "ratcliff"  # or "levenshtein"
    invoice_amount_floor: float = 500.0
    invoice_categories: tuple[str, ...] = (
        "Cloud Services", "Software", "Office Expenses", "Operations",
    )


@dataclass(frozen=True)
class FraudConfig:
    round_amount_floor: float = 1000.0
    calc_tolerance: float = 0.02
    items_tolerance: float = 0.05
    same_amount: float = 0.01
    near_days: int = 7
    min_history: int = 3
    history_z: float = 3.0
    low_confidence: float = 0.5
    payment_days: int = 30
    vendor_chars: int | None = None  # the whole name; 10 compares the first ten characters
