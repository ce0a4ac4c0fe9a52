"""Three separate severity scales and the CVSS bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import lookup

# Each scale is its own; never compare ranks across scales.
RULE_SCALE = {"info": 0, "low": 1, "medium": 2, "high": 3}
MONITOR_SCALE = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
CVSS_SCALE = {"none": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}


def rank(severity: Column, scale: dict, default: int | None = None) -> Column:
    value = lookup(severity, scale)
    return value if default is None else F.coalesce(value, F.lit(default))


def monitor_rank(severity: Column) -> Column:
    """Unknown severities of monitor findings count as medium."""
    return rank(severity, MONITOR_SCALE, default=2)


def at_least(severity: Column, minimum: str, scale: dict) -> Column:
    return F.coalesce(rank(severity, scale) >= scale[minimum], F.lit(False))


def cvss_severity(score: Column) -> Column:
    return (
        F.when(score >= 9.0, F.lit("critical"))
        .when(score >= 7.0, F.lit("high"))
        .when(score >= 4.0, F.lit("medium"))
        .when(score > 0.0, F.lit("low"))
        .otherwise(F.lit("none"))
    )
