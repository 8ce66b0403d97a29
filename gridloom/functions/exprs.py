"""Column builders that the rest of the package composes. NULL in gives NULL out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def exact(value: Column) -> Column:
    """Six-digit decimal, so that sums don't depend on the order of rows."""
    return value.cast("decimal(20,6)")


def exact_sum(value: Column) -> Column:
    return F.sum(exact(value)).cast("double")


def exact_avg(value: Column) -> Column:
    return F.round(F.sum(exact(value)).cast("double") / F.count(value), 6)


def safe_divide(above: Column, below: Column) -> Column:
    """NULL where the denominator isn't positive."""
    return F.when(below > 0, above / below)


def floor_divide(above: Column, below: Column) -> Column:
    """The denominator is one at least."""
    return above / F.greatest(below, F.lit(1))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def population_cv(x: Column) -> Column:
    """Population deviation over mean: 0 where both are 0, NULL where only the mean is."""
    mean, deviation = F.avg(x), F.stddev_pop(x)
    return F.when(mean != 0, deviation / mean).when(deviation == 0, F.lit(0.0))


def imbalance(max_share: Column, n: Column) -> Column:
    return max_share * n


def imbalance_normalized(isf: Column, n: Column) -> Column:
    """(isf - 1) / (n - 1) within 0..1; 0 for one member."""
    return F.when(n == 1, F.lit(0.0)).when(n > 1, clamp((isf - 1) / F.nullif(n - 1, F.lit(0))))


def cv_normalized(cv: Column, n: Column) -> Column:
    return F.when(n == 1, F.lit(0.0)).when(n > 1, clamp(cv / F.sqrt(F.greatest(n - 1, F.lit(1)))))


def epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def day(ts: Column) -> Column:
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def user_status(user_id: Column) -> Column:
    return F.when(user_id % 53 == 0, "suspended").when(user_id % 17 == 0, "inactive").otherwise("active")


def tenant_tier(tenant_id: Column) -> Column:
    return F.when(tenant_id % 20 == 0, "enterprise").when(tenant_id % 5 == 0, "pro").otherwise("standard")


def tenant_status(tenant_id: Column) -> Column:
    return F.when(tenant_id % 97 == 0, "suspended").when(tenant_id % 31 == 0, "inactive").otherwise("active")


def preceding(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def log_excess(x: Column, base: float, critical: float) -> Column:
    """ln(1 + x - base) over ln(1 + critical), 0 up to the base and 1 from the critical excess on."""
    return F.when(x.isNotNull(), F.least(F.log1p(F.greatest(x - base, F.lit(0.0))) / F.log1p(F.lit(critical)), F.lit(1.0)))


def linear_excess(x: Column, base: float, critical: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x - base, F.lit(0.0)) / critical, F.lit(1.0)))


#: Semantic transforms by name; n is the number of members where one is needed.
def semantic(kind: str, x: Column, n: Column | None = None, neutral: float = 0.0) -> Column:
    two_over_pi = F.lit(2.0) / F.pi()
    made = {
        "bounded_share": lambda: clamp(x),
        "binary": lambda: clamp(x),
        "nonnegative_log_atan": lambda: two_over_pi * F.atan(F.log1p(F.greatest(x, F.lit(0.0)))),
        "positive_baseline_log2_atan": lambda: two_over_pi * F.atan(F.log2(F.greatest(x, F.lit(1.0)))),
        "positive_excess_log_atan": lambda: two_over_pi * F.atan(F.log1p(F.greatest(x - 1, F.lit(0.0)))),
        "signed_atan": lambda: F.lit(0.5) + F.atan(x) / F.pi(),
        "isf_excess_share": lambda: clamp((x - 1) / F.nullif(n - 1, F.lit(0))),
        "max_share_excess": lambda: clamp((x - 1.0 / n) / F.nullif(1 - 1.0 / n, F.lit(0.0))),
    }[kind]()
    return F.when(x.isNull(), F.lit(neutral)).otherwise(F.coalesce(made, F.lit(neutral)))


def distance(a: Column, b: Column, kind: str = "euclidean") -> Column:
    """Between two array<double> columns."""
    total = lambda z: F.aggregate(z, F.lit(0.0), lambda s, v: s + v)
    if kind == "euclidean":
        return F.sqrt(total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q))))
    if kind == "manhattan":
        return total(F.zip_with(a, b, lambda p, q: F.abs(p - q)))
    if kind == "cosine":
        dot = total(F.zip_with(a, b, lambda p, q: p * q))
        norm = lambda v: F.sqrt(total(F.transform(v, lambda p: p * p)))
        return 1.0 - dot / F.nullif(norm(a) * norm(b), F.lit(0.0))
    raise ValueError(f"no such distance: {kind}")
