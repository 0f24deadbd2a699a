"""Trend measures as column expressions. Rules are ordered; the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_TOTAL, MIN_PERIOD = 5, 3
WINDOW_DAYS = 90
#: Weights of the score's parts, in percent.
WEIGHTS = {"volume": 25, "growth": 25, "share": 15, "acceleration": 15, "recency": 10, "consistency": 10}
#: Labels of the resolved trend modes.
MODE_LABELS = {
    "CURRENT_OK": "Trending Now",
    "HISTORICAL_OK": "Historical Cohort Comparison",
    "CURRENT_UNAVAILABLE": "Current Trends Unavailable",
    "HISTORICAL_UNAVAILABLE": "Insufficient Data For Historical Comparison",
}


def share_of(part: Column, whole: Column) -> Column:
    """part / whole; null where there is no whole."""
    return part / F.nullif(whole, F.lit(0))


def growth_rate(recent: Column, previous: Column) -> Column:
    return F.when(previous > 0, share_of(recent - previous, previous)).when(recent == 0, 0.0)


def is_new(recent: Column, previous: Column) -> Column:
    return (previous == 0) & (recent > 0)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def growth_normalized(rate: Column) -> Column:
    return F.coalesce((clamp(rate, -1.0, 3.0) + 1) / 4, F.lit(0.5))


def volume(recent: Column, busiest: Column) -> Column:
    return F.coalesce(share_of(recent, busiest), F.lit(0.0))


def momentum(recent: Column, busiest: Column, rate: Column) -> Column:
    return 0.5 * volume(recent, busiest) + 0.5 * growth_normalized(rate)


def acceleration(rates: Column) -> Column:
    """Whether the last three growth rates rise; null with fewer than three or a null among them."""
    last = F.slice(rates, -3, 3)
    a, b, c = (F.element_at(last, i) for i in (1, 2, 3))
    return F.when((F.size(rates) >= 3) & ~F.exists(last, lambda x: x.isNull()), (a < b) & (b < c))


def consistency(flags: Column) -> Column:
    return share_of(F.size(F.filter(flags, lambda x: x)), F.size(flags))


def recency(days: Column, decay: float = 90.0) -> Column:
    return F.exp(-F.greatest(F.lit(0), days) / decay)


def share_part(change: Column) -> Column:
    return F.coalesce((clamp(change, -1.0, 1.0) + 1) / 2, F.lit(0.5))


def acceleration_part(a: Column) -> Column:
    return F.when(a, 1.0).when(~a, 0.3).otherwise(0.5)


def trend_score(parts: dict[str, Column], total: Column, min_total: int = MIN_TOTAL) -> Column:
    """Weighted parts, damped for few papers, rounded half to even, 0 to 100."""
    raw = sum((WEIGHTS[k] * parts[k] for k in WEIGHTS), F.lit(0.0))
    damped = raw * F.least(F.lit(1.0), total / (2 * min_total))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(damped, 0).cast("long")))


def trend_class(
    total: Column, recent: Column, previous: Column, rate: Column, accelerates: Column, steady: Column,
    steady_from: float = 0.75, rise: float = 0.20, band: float = 0.10, fall: float = -0.20,
) -> Column:
    based = previous >= MIN_PERIOD
    return (
        F.when(total < MIN_TOTAL, "Insufficient Data")
        .when(is_new(recent, previous) & (recent >= MIN_PERIOD), "Emerging")
        .when((rate > rise) & accelerates & based, "Accelerating")
        .when((steady >= steady_from) & (rate.isNull() | rate.between(-band, rise)), "Consistently Active")
        .when(rate.between(-band, band) & based, "Stable")
        .when((rate < fall) & based, "Cooling")
        .otherwise("Insufficient Data")
    )


def data_quality(total: Column, previous: Column, days: Column, several_windows: Column, window: int = WINDOW_DAYS, floor: float = 0.10) -> Column:
    """Distinct days beyond the window count as the whole window."""
    thin = F.least(days, F.lit(window)) / window < floor
    return (
        F.when(total < MIN_TOTAL, "INSUFFICIENT").when((previous < MIN_PERIOD) | thin, "LOW").when(several_windows, "HIGH").otherwise("MEDIUM")
    )


def freshness(total: Column, days_since: Column, recent: Column, comparison: Column, days: Column, window: int = WINDOW_DAYS) -> Column:
    least = max(1, round(0.1 * window))
    return (
        F.when(total < 30, "INSUFFICIENT_DATA")
        .when((days_since > 180) | (recent == 0), "HISTORICAL_ONLY")
        .when((comparison < 5) | (days < least), "PARTIALLY_CURRENT")
        .otherwise("CURRENT")
    )


def resolved_mode(requested: Column, status: Column) -> Column:
    enough = status != "INSUFFICIENT_DATA"
    current = F.when(status == "CURRENT", "CURRENT_OK").otherwise("CURRENT_UNAVAILABLE")
    return F.when(requested == "current", current).when(enough, "HISTORICAL_OK").otherwise("HISTORICAL_UNAVAILABLE")


def mode_label(state: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in MODE_LABELS.items() for x in pair])[state]
