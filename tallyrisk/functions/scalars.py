"""Column expressions and small numeric grids shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reading bands of the stability index, stamp format, clip for empty bins.
PSI_STABLE_BELOW = 0.1
PSI_MODERATE_BELOW = 0.25
PSI_EPSILON = 1e-4
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, and 0.0 where the denominator is zero."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(0.0))


def psi_label(value: Column) -> Column:
    return (F.when(value < PSI_STABLE_BELOW, "stable")
            .when(value < PSI_MODERATE_BELOW, "moderate")
            .otherwise("significant"))


def psi_term(current: Column, reference: Column, epsilon: float = PSI_EPSILON) -> Column:
    """One bin's share of the stability index, both proportions clipped from below."""
    cur, ref = F.greatest(current, F.lit(epsilon)), F.greatest(reference, F.lit(epsilon))
    return (cur - ref) * F.ln(cur / ref)


def iso_millis(stamp: Column) -> Column:
    """ISO-8601 text with millisecond precision; the session zone must be UTC."""
    return F.date_format(stamp, ISO_MILLIS)


def parse_iso(text: Column) -> Column:
    return F.to_timestamp(text, ISO_MILLIS)


def millis_between(later: Column, earlier: Column) -> Column:
    return F.unix_millis(later) - F.unix_millis(earlier)


def map_value(instance: Column, name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.try_element_at(instance, F.lit(name)), F.lit(default))


def encode_label_text(value: Column) -> Column:
    """Metric text allowed in registry labels: 0.8017 becomes 0_8017."""
    return F.replace(F.format_string("%.4f", value), F.lit("."), F.lit("_"))


def decode_label_text(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(".")).cast("double")


def standardise(value: Column, mean: float, deviation: float) -> Column:
    return (value - F.lit(mean)) / F.lit(deviation if deviation else 1.0)


def feature_array(features: Sequence[str], decimals: int | None = None) -> Column:
    """The features in their declared order as one array, optionally rounded."""
    values = [F.col(name).cast("double") for name in features]
    if decimals is not None:
        values = [F.round(value, decimals) for value in values]
    return F.array(*values)


def null_or_nan(name: str) -> Column:
    return F.col(name).isNull() | F.isnan(F.col(name).cast("double"))


def double_array(values: Sequence[float]) -> Column:
    """A constant array<double> as one folded literal instead of one expression per value."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def even_grid(points: int) -> list[float]:
    """`points` values from 0 to 1, the last one exactly 1."""
    step = 1.0 / (points - 1)
    return [i * step for i in range(points - 1)] + [1.0]


def decade_grid(low: float, high: float, points: int) -> list[float]:
    """`points` values evenly spaced in the exponent from 10**low to 10**high."""
    step = (high - low) / (points - 1)
    return [10.0 ** (low + i * step) for i in range(points - 1)] + [10.0 ** high]
