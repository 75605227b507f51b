"""Is the weather complete, and are readings without weather truly unmatched?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from loadcurve.operators.diagnostics import unmatched_audit
from loadcurve.operators.timeseries import completeness, overall_completeness
from loadcurve.plans.merge import unique_weather


def audit_weather(
    weather: DataFrame,
    merged: DataFrame,
    measure: str = "temperature_2m",
    step_seconds: int = 3600,
    unit: str = "hour",
    exclude: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Completeness per location and overall, and the audit of unmatched keys."""
    unique = unique_weather(weather)
    per_location = completeness(unique, step_seconds=step_seconds)
    return {
        "per_location": per_location,
        "overall": overall_completeness(per_location),
        "unmatched": unmatched_audit(merged, unique, measure, unit=unit, exclude=exclude),
    }
