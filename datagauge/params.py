"""Thresholds, patterns and percentile lists; every operator takes them as arguments."""

from __future__ import annotations

from dataclasses import dataclass

# The pattern dictionary (ordered; the first pattern wins a tie).
PATTERNS: dict[str, str] = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "url": r"^https?://[^\s]+$",
    "ip_address": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
    "credit_card": r"^\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}$",
}

# Fixed value: the alternative dictionary has this pattern in place of credit_card.
UUID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"

# Percentiles of the numeric summary, the length summary and the percentile operator.
NUMERIC_PERCENTILES = (1, 5, 25, 75, 95, 99)
LENGTH_PERCENTILES = (25, 75, 95)
DEFAULT_PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)

# Lags of the autocorrelation check.
AUTOCORRELATION_LAGS = (7, 30, 365)


@dataclass(frozen=True)
class Thresholds:
    """Limits of the anomaly flags and of the outlier and correlation tests."""

    high_null_pct: float = 30.0
    very_high_null_pct: float = 50.0
    short_avg_length: float = 2.0
    long_avg_length: float = 500.0
    low_unique_ratio: float = 0.1
    low_unique_min_values: int = 10
    pattern_low_pct: float = 50.0
    pattern_high_pct: float = 90.0
    z_score: float = 3.0
    iqr_multiplier: float = 1.5
    modified_z_score: float = 3.5
    modified_z_scale: float = 0.6745
    high_correlation: float = 0.7
    strong_correlation: float = 0.8
    optional_presence_pct: float = 90.0


DEFAULTS = Thresholds()
