"""Two-sided tail probabilities and critical values of test statistics, as columns."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL_CRITICAL = NormalDist().inv_cdf(0.975)  # two-sided 95 %
#: From here on the fraction serves the normal tail, below it the series; enough terms of both for double precision.
FAR, SERIES, LEVELS = 3.0, 60, 80
BISECTIONS, LARGEST = 80, 1e4


def _struct(term: Column, total: Column) -> Column:
    return F.struct(term.alias("term"), total.alias("total"))


def normal_p(z: Column) -> Column:
    """P(|Z| > |z|): one less the central series z + z³/3 + z⁵/15 + …, far out the fraction 1/(z + 1/(z + 2/(z + …)))."""
    near, far = F.abs(z), F.greatest(F.abs(z), F.lit(FAR))
    density = F.exp(-z * z / 2) * F.lit(math.sqrt(2 / math.pi))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(SERIES)), _struct(near, near),
        lambda s, k: _struct(s["term"] * near * near / (2 * k + 1), s["total"] + s["term"] * near * near / (2 * k + 1)), lambda s: s["total"])
    fraction = F.aggregate(F.sequence(F.lit(LEVELS), F.lit(1), F.lit(-1)), F.lit(0.0), lambda below, k: k / (far + below))
    return F.when(near < FAR, 1 - density * series).otherwise(density / (far + fraction))


def student_p(t: Column, df: Column) -> Column:
    """P(|T| > |t|) for whole degrees of freedom from 1 on, to about 1e-15.

    With tan θ = t / √df the central part is a finite sum of powers of cos θ, times sin θ; for
    an odd number θ itself is added and 2/π multiplies both.
    """
    angle = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    square, odd = F.cos(angle) * F.cos(angle), F.pmod(df, F.lit(2))
    first = F.when(odd == 0, F.lit(1.0)).when(df > 1, F.cos(angle)).otherwise(F.lit(0.0))
    more = ((df - 2 - odd) / 2).cast("int")
    steps = F.when(more >= 1, F.sequence(F.lit(1), F.greatest(more, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * square * (2 * k - 1 + odd) / (2 * k + odd)
        return _struct(term, s["total"] + term)

    part = F.sin(angle) * F.aggregate(steps, _struct(first, first), step, lambda s: s["total"])
    return F.greatest(1 - F.when(odd == 1, (angle + part) * F.lit(2 / math.pi)).otherwise(part), F.lit(0.0))


def student_critical(df: Column, level: float = 0.05) -> Column:
    """The value whose two-sided tail is ``level``, by bisection."""
    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        above = student_p(middle, df) > level
        return F.struct(F.when(above, middle).otherwise(s["low"]).alias("low"), F.when(above, s["high"]).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(LARGEST).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, halve, lambda s: (s["low"] + s["high"]) / 2)
