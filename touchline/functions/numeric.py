"""Numeric column expressions shared by the operators."""

from pyspark.sql import Column, functions as F

from touchline.constants import MINUTES_PER_MATCH


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c) -> Column:
    """Cast to double, NULL when the text is no number."""
    return col(c).try_cast("double")


def filled(c, default=0.0) -> Column:
    """Double with NULL and NaN replaced."""
    c = col(c).try_cast("double")
    return F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(float(default)))


def safe_divide(x, y, default=0.0) -> Column:
    """x / y, with `default` wherever the quotient is NULL, NaN or infinite."""
    q = F.try_divide(col(x).cast("double"), col(y).cast("double"))
    bad = q.isNull() | F.isnan(q) | (F.abs(q) == F.lit(float("inf")))
    return F.when(bad, F.lit(default if default is None else float(default))).otherwise(q)


def per_90(stat, minutes) -> Column:
    return safe_divide(col(stat) * F.lit(MINUTES_PER_MATCH), minutes)


def clamp(x, low, high) -> Column:
    return F.greatest(F.least(col(x), F.lit(high)), F.lit(low))


def flag(condition: Column) -> Column:
    """1 / 0 from a condition; NULL counts as 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def bin_index(p, n_bins: int) -> Column:
    """1-based index of equal-width bins over [0, 1], right-closed, lowest included."""
    return F.greatest(F.ceil(col(p) * F.lit(n_bins)), F.lit(1)).cast("int")


def positive_only(x, y) -> Column:
    """x / y where y > 0, else 0."""
    return F.when(col(y) > 0, F.try_divide(col(x), col(y))).otherwise(F.lit(0.0))


def correlation(x, y) -> Column:
    """Pearson correlation over complete pairs; NULL when one side does not vary."""
    x, y = col(x), col(y)
    spread = F.stddev_samp(F.when(y.isNotNull(), x)) * F.stddev_samp(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_samp(x, y), spread)
