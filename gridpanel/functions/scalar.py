"""Column expressions: names, numeric policies, transforms and special functions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col.cast("string")), F.lit(""))


def syntactic_name(col: Column) -> Column:
    """Turn a label into a valid identifier: other characters become dots; a bad first character gets an X."""
    dotted = F.regexp_replace(col, r"[^A-Za-z0-9._]", ".")
    return F.when(dotted.rlike(r"^([A-Za-z]|\.(?![0-9]))"), dotted).otherwise(F.concat(F.lit("X"), dotted))


def tokens(col: Column, sep: str = "_") -> Column:
    return F.split(col, sep)


def prefix_of(col: Column, n: int, sep: str = "_") -> Column:
    return F.array_join(F.slice(tokens(col, sep), 1, n), sep)


def finite_or(col: Column, default: Column) -> Column:
    bad = col.isNull() | F.isnan(col) | (F.abs(col) == F.lit(float("inf")))
    return F.when(bad, default).otherwise(col)


def safe_divide(num: Column, den: Column, default: float | None = None) -> Column:
    ratio = F.try_divide(num, den)
    return ratio if default is None else F.coalesce(ratio, F.lit(default))


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(col, F.lit(high)), F.lit(low))


def logistic(col: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col))


def log_floor(col: Column, floor: float = 1e-12) -> Column:
    return F.log(F.greatest(col, F.lit(floor)))


# Registry of named transforms: a design recipe stores the name, never a Python closure.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "identity": lambda c: c,
    "log1p": F.log1p,
    "log": F.log,
    "sqrt": F.sqrt,
    "exp": F.exp,
    "square": lambda c: c * c,
    "round": lambda c: F.bround(c, 0),
}


def register_transform(name: str, fn: Callable[[Column], Column]) -> None:
    TRANSFORMS[name] = fn


def apply_transforms(df: DataFrame, transforms: Sequence[dict]) -> DataFrame:
    """Apply ``{"fn", "cols", "prefix"}`` entries; an empty prefix rewrites the column in place."""
    for step in transforms:
        fn, prefix = TRANSFORMS[step["fn"]], step.get("prefix", "")
        present = [c for c in step["cols"] if c in df.columns]
        df = df.withColumns({f"{prefix}{c}": fn(F.col(c).cast("double")) for c in present})
    return df


# Coefficients of the Lanczos approximation (g = 7, nine terms).
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)


def lgamma(x: Column) -> Column:
    """log Gamma for positive arguments; evaluated at x + 1 and stepped back, so small x keeps its accuracy."""
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(c) / (x + F.lit(float(i)))
    t = x + F.lit(LANCZOS_G + 0.5)
    half_log_2pi = F.lit(0.5 * math.log(2 * math.pi))
    return half_log_2pi + (x + F.lit(0.5)) * F.log(t) - t + F.log(series) - F.log(x)


# Coefficients of Acklam's rational approximation to the inverse normal distribution function.
ICDF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02,
          -3.066479806614716e01, 2.506628277459239e00)
ICDF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01,
          -1.328068155288572e01)
ICDF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00,
          4.374664141464968e00, 2.938163982698783e00)
ICDF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ICDF_LOW = 0.02425


def _horner(coefs: Sequence[float], x: Column, last: float | None = None) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc if last is None else acc * x + F.lit(last)


def normal_icdf(p: Column) -> Column:
    """Standard normal quantile for 0 < p < 1 (relative error below 1.2e-9)."""
    def tail(q: Column) -> Column:
        return _horner(ICDF_C, q) / _horner(ICDF_D, q, 1.0)

    centre = p - 0.5
    r = centre * centre
    middle = _horner(ICDF_A, r) * centre / _horner(ICDF_B, r, 1.0)
    low = tail(F.sqrt(F.lit(-2.0) * F.log(p)))
    high = -tail(F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p)))
    return F.when(p < ICDF_LOW, low).when(p > 1 - ICDF_LOW, high).otherwise(middle)


# Chebyshev coefficients of the complementary error function (fractional error below 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
        -0.82215223, 0.17087277)


def normal_upper_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal Z."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + 0.5 * x)
    poly = _horner(tuple(reversed(ERFC)), t)
    erfc = t * F.exp(-x * x + poly)
    return F.when(z >= 0, erfc / 2).otherwise(F.lit(1.0) - erfc / 2)
