"""Hazard factors, calendar features, the rule tree and risk classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reference swell direction in degrees, outcome labels, summer months.
SWELL_DIRECTION = 278.0
POSITIVE, NEGATIVE = "noyade", "pas_de_noyade"
SUMMER_MONTHS = (7, 8)
# Our default: equal fifths of [0, 1].
FIFTHS = (0.2, 0.4, 0.6, 0.8)


def wave_incidence(direction: Column) -> Column:
    """cos(278 - direction)^4 with the direction in degrees; always within [0, 1]."""
    return F.pow(F.cos(F.radians(F.lit(SWELL_DIRECTION) - direction)), F.lit(4.0))


def wave_factor(height: Column, period: Column) -> Column:
    return height * period


def calendar(day: Column) -> dict[str, Column]:
    """Day of month, month and weekday (1 = Monday) of a date."""
    return {"mday": F.dayofmonth(day), "month": F.month(day), "wday": F.weekday(day) + 1}


def rule_risk(
    month: Column,
    t_air: Column,
    wave: Column,
    summer: tuple[float, float] = (20.0, 0.5),
    other: tuple[float, float] = (20.0, 0.5),
) -> Column:
    """The three-level rule tree: season, then air temperature, then wave factor.

    Each season has its own (temperature, wave) cut pair. Missing input gives a missing label.
    """

    def branch(cuts: tuple[float, float]) -> Column:
        t_cut, wave_cut = cuts
        return F.when(t_air > t_cut, POSITIVE).when(wave > wave_cut, POSITIVE).otherwise(NEGATIVE)

    known = month.isNotNull() & t_air.isNotNull() & wave.isNotNull()
    return F.when(known, F.when(month.isin(*SUMMER_MONTHS), branch(summer)).otherwise(branch(other)))


def risk_class(p: Column, cuts: Sequence[float] = FIFTHS) -> Column:
    """Ordered class 1..len(cuts)+1 of a probability; classes are closed on the left."""
    out = F.when(p.isNull(), F.lit(None).cast("int"))
    for i, cut in enumerate(sorted(cuts), start=1):
        out = out.when(p < cut, F.lit(i))
    return out.otherwise(F.lit(len(cuts) + 1))


def logistic(intercept: float, weights: dict[str, float]) -> Column:
    """Probability from fixed coefficients, one term per named column."""
    z = F.lit(float(intercept))
    for name, w in weights.items():
        z = z + F.lit(float(w)) * F.col(name)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def majority(votes: Sequence[Column]) -> Column:
    """1 when more than half of the 0/1 votes of a row are 1."""
    total = sum((v.cast("int") for v in votes[1:]), votes[0].cast("int"))
    return (total * 2 > len(votes)).cast("int")
