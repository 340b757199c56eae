"""Scalar and array expressions that the operators share."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    """x within low and high; null counts as low."""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def finite(x: Column, otherwise: float | None = 0.0) -> Column:
    """x, or `otherwise` where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(otherwise)).otherwise(x)


def ratio(x: Column, y: Column) -> Column:
    """x / y as floating point has it: over 0 an infinity of x's sign, or NaN of 0 / 0; Spark's division fails there."""
    over_zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).otherwise(F.signum(x) * F.lit(float("inf")))
    return F.when(y == 0, over_zero).otherwise(x / F.nullif(y, F.lit(0.0)))


def ln(x: Column) -> Column:
    """Natural logarithm as floating point has it: minus infinity of 0, NaN below; Spark's is null there."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.log(x))


def tri_state(x: Column, threshold: Column | float) -> Column:
    """1 above the threshold, -1 below its negative, else 0 (null too)."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(x > t, 1).when(x < -t, -1).otherwise(0)


def bit_of(mask: int, position: Column) -> Column:
    """Whether the bit at position (an hour, a regime) is set in mask."""
    return F.lit(mask).cast("long").bitwiseAND(F.pow(F.lit(2), position).cast("long")) != 0


def utc_hour(time_ms: Column) -> Column:
    return F.floor(F.pmod(time_ms, F.lit(86_400_000)) / 3_600_000).cast("int")


def utc_day(time_ms: Column) -> Column:
    """Days since 1970, rounded down also before."""
    return F.floor(time_ms / 86_400_000).cast("long")


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_sum_exp(xs: Column) -> Column:
    top = F.array_max(xs)
    return top + F.log(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def softmax(xs: Column) -> Column:
    total = log_sum_exp(xs)
    return F.transform(xs, lambda x: F.exp(x - total))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Activations by name.
ACTIVATIONS = {
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "leaky_relu": lambda x: F.when(x > 0, x).otherwise(0.01 * x),
    "elu": lambda x: F.when(x > 0, x).otherwise(F.expm1(x)),
    "selu": lambda x: 1.0507009873554805 * F.when(x > 0, x).otherwise(1.6732632423543772 * F.expm1(x)),
    "silu": lambda x: x * sigmoid(x),
    "mish": lambda x: x * F.tanh(softplus(x)),
    "gelu": lambda x: 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x))),
    "tanh": F.tanh,
    "sigmoid": sigmoid,
    "softplus": softplus,
}

#: The rational approximation 7.1.26 of the error function (Abramowitz and Stegun); error under 1.5e-7.
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_ERF_P = 0.3275911


def erf(x: Column) -> Column:
    t = 1 / (1 + _ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(_ERF):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


#: Coefficients of Acklam's inverse normal distribution function.
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)


def _horner(x: Column, factors: Sequence[float]) -> Column:
    out = F.lit(0.0)
    for f in factors:
        out = out * x + f
    return out


def normal_ppf(p: Column) -> Column:
    """Inverse of the normal distribution function; null outside (0, 1)."""
    tail = lambda q: _horner(q, _C) / (_horner(q, _D) * q + 1)
    q, low = p - 0.5, 0.02425
    r = q * q
    middle = _horner(r, _A) * q / (_horner(r, _B) * r + 1)
    return F.when((p <= 0) | (p >= 1), None).when(p < low, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - low, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(middle)


def to_float(text: Column) -> Column:
    """A number from tolerant text: '', nan, none, null and infinities are null."""
    low = F.lower(F.trim(text))
    number = F.expr("cast(null as double)") if text is None else low.try_cast("double")
    return F.when(low.isin("", "nan", "none", "null", "inf", "+inf", "-inf", "infinity", "-infinity"), None).otherwise(number)


def safe_symbol(symbol: Column) -> Column:
    """A symbol as part of a file name."""
    return F.regexp_replace(symbol, r"[^A-Za-z0-9]", "_")


def json_number(x: Column) -> Column:
    """x as JSON writes it: null where it isn't finite."""
    return F.coalesce(finite(x, None).cast("string"), F.lit("null"))
