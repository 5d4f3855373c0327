"""Shrunk precision: a Beta posterior that starts from four pseudo-judgements
at the tier's bar.  Operation order is fixed so that doubles agree bit by bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the tier bars, in order of strictness
TIER_BARS = {"PROVEN": 0.95, "STRONG": 0.80, "MODERATE": 0.70}
PRIOR_STRENGTH = 4.0
Z95 = 1.96


def posterior(tp: Column, n: Column, bar: Column | float) -> tuple[Column, Column]:
    """Mean and standard deviation of the posterior."""
    bar = bar if isinstance(bar, Column) else F.lit(float(bar))
    a = tp.cast("double") + F.lit(PRIOR_STRENGTH) * bar
    b = (n - tp).cast("double") + F.lit(PRIOR_STRENGTH) * (F.lit(1.0) - bar)
    mean = a / (a + b)
    return mean, F.sqrt(mean * (F.lit(1.0) - mean) / (a + b + F.lit(1.0)))


def score(tp: Column, n: Column, bar: Column | float) -> Column:
    """The mean less one standard deviation."""
    mean, sd = posterior(tp, n, bar)
    return mean - sd


def interval(tp: Column, n: Column, bar: Column | float) -> tuple[Column, Column]:
    """A 95 per cent interval, kept inside [0, 1]."""
    mean, sd = posterior(tp, n, bar)
    return F.greatest(mean - F.lit(Z95) * sd, F.lit(0.0)), F.least(mean + F.lit(Z95) * sd, F.lit(1.0))


def tier_bar(tier: Column) -> Column:
    """The bar of a tier; the lowest for an unknown one."""
    out = F.lit(min(TIER_BARS.values()))
    for name, bar in TIER_BARS.items():
        out = F.when(tier == name, bar).otherwise(out)
    return out


def p_real(judged: Column, tp: Column, n: Column, tier: Column) -> Column:
    """Lower bound of the chance that a finding is real; 0 if never judged."""
    return F.when(judged, score(tp, n, tier_bar(tier))).otherwise(F.lit(0.0))
