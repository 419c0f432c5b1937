"""Rounding, grades and severities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import GRADES, SEVERITIES, SEVERITY_CEILING


def half_up(x: Column) -> Column:
    """Rounds halves toward plus infinity."""
    return F.floor(x + 0.5).cast("int")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, half_up(part / whole * 100)).otherwise(0)


def clamp100(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x))


def grade_of(score: Column) -> Column:
    out = F.when(score.isNull(), None)
    for grade, least in GRADES[:-1]:
        out = out.when(score >= least, grade)
    return out.otherwise(GRADES[-1][0])


def severity_of(score: Column) -> Column:
    out = F.when(score.isNull(), None)
    for severity, least in SEVERITIES[:-1]:
        out = out.when(score >= least, severity)
    return out.otherwise(SEVERITIES[-1][0])


def severity_rank(severity: Column) -> Column:
    """3 for Critical to 0 for none."""
    return F.when(severity == "Critical", 3).when(severity == "Moderate", 2).when(severity == "Minor", 1).otherwise(0)


def ceiling_of(rank: Column) -> Column:
    return F.when(rank == 3, SEVERITY_CEILING["Critical"]).when(rank == 2, SEVERITY_CEILING["Moderate"]).when(rank == 1, SEVERITY_CEILING["Minor"]).otherwise(100)


def capped(score: Column, rank: Column) -> Column:
    return F.least(score, ceiling_of(rank))
