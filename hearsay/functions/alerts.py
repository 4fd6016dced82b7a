"""Crisis score and alert state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crisis_score(disaster: Column, total: Column) -> Column:
    """Disaster share times 1000, at most 100; 0 without posts."""
    share = F.try_divide(disaster.cast("double"), total.cast("double"))
    return F.least(F.lit(100.0), F.coalesce(share * 1000.0, F.lit(0.0)))


def alert_state(score: Column) -> Column:
    # Lower bounds of the alert states (exclusive).
    return (
        F.when(score > 75, "Extreme").when(score > 55, "High").when(score > 25, "Moderate").otherwise("Normal")
    )
