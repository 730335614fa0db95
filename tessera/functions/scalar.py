"""Element functions as Column expressions; every tensor operator is built from these, so they stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float | int


def _c(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def wide(x: Value) -> Column:
    """The value as double: arithmetic is done in double, whatever the storage."""
    return _c(x).cast("double")


def add(x: Value, y: Value) -> Column:
    return _c(x) + _c(y)


def subtract(x: Value, y: Value) -> Column:
    return _c(x) - _c(y)


def multiply(x: Value, y: Value) -> Column:
    return _c(x) * _c(y)


def divide(x: Value, y: Value) -> Column:
    """IEEE division of doubles: by zero it gives an infinity, or NaN for zero and NaN, instead of an error."""
    x, y = wide(x), wide(y)
    inf = F.when((x == 0) | F.isnan(x), F.lit(math.nan)).when(x > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(y == 0, inf).otherwise(x / F.nullif(y, F.lit(0.0)))


def divide_integers(x: Value, y: Value) -> Column:
    """Division of whole numbers, cut towards zero; null for division by zero."""
    y = F.nullif(_c(y), F.lit(0))
    return F.when((_c(x) < 0) != (y < 0), -F.floor(F.abs(_c(x)) / F.abs(y))).otherwise(F.floor(F.abs(_c(x)) / F.abs(y))).cast("long")


def negate(x: Value) -> Column:
    return -_c(x)


def absolute(x: Value) -> Column:
    return F.abs(_c(x))


def sign(x: Value) -> Column:
    """-1, 0 or 1; the slope of the absolute value, 0 at 0."""
    return F.when(_c(x) > 0, 1.0).when(_c(x) < 0, -1.0).when(_c(x) == 0, 0.0)


def clamp(x: Value, low: float, high: float) -> Column:
    """The value held between the bounds; NaN stays NaN."""
    if low > high:
        raise ValueError(f"clamp: low {low} is above high {high}")
    x = _c(x)
    return F.when(F.isnan(x.cast("double")), x).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def greater_than(x: Value, y: Value) -> Column:
    return _c(x) > _c(y)


def less_than(x: Value, y: Value) -> Column:
    return _c(x) < _c(y)


def equal_to(x: Value, y: Value) -> Column:
    return _c(x) == _c(y)


def relu(x: Value) -> Column:
    return F.greatest(wide(x), F.lit(0.0))


def relu_slope(x: Value) -> Column:
    return F.when(_c(x) > 0, 1.0).otherwise(0.0)


def gelu(x: Value) -> Column:
    """The tanh form."""
    x = wide(x)
    return 0.5 * x * (1.0 + F.tanh(F.lit(math.sqrt(2.0 / math.pi)) * (x + 0.044715 * x * x * x)))


def gelu_slope(x: Value) -> Column:
    x, c = wide(x), math.sqrt(2.0 / math.pi)
    t = F.tanh(F.lit(c) * (x + 0.044715 * x * x * x))
    return 0.5 * (1.0 + t) + 0.5 * x * (1.0 - t * t) * F.lit(c) * (1.0 + 3 * 0.044715 * x * x)


def silu(x: Value) -> Column:
    x = wide(x)
    return x / (1.0 + F.exp(-x))


def silu_slope(x: Value) -> Column:
    x = wide(x)
    s = 1.0 / (1.0 + F.exp(-x))
    return s * (1.0 + x * (1.0 - s))


def uniform(idx: Column | str, seed: int = 42) -> Column:
    """A number in [0, 1) that depends on the index and the seed only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), idx), 11)
    return bits.cast("double") / float(1 << 53)


def normal(idx: Column | str, seed: int = 42) -> Column:
    """A standard normal number that depends on the index and the seed only (Box-Muller)."""
    u, v = 1.0 - uniform(idx, seed), uniform(idx, seed + 1_000_003)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def he_uniform(idx: Column | str, fan_in: int, seed: int = 42) -> Column:
    """Uniform in [-k, k), k = sqrt(1 / fan_in)."""
    k = math.sqrt(1.0 / fan_in)
    return 2.0 * k * uniform(idx, seed) - k
