"""Column helpers with the engine's null and zero rules."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def ratio(num: Column, den: Column) -> Column:
    """num / den, and 0.0 where the denominator is 0 or null."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def ratio_or_nan(num: Column, den: Column) -> Column:
    """num / den, and NaN where the denominator is 0: stratified rates keep "no data" apart from 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(float("nan")))


def harmonic(a: Column, b: Column) -> Column:
    return ratio(2 * a * b, a + b)


def wrap_angle(angle: Column) -> Column:
    """To [-pi, pi), with a remainder that is never negative."""
    return F.pmod(angle + F.lit(math.pi), F.lit(TWO_PI)) - F.lit(math.pi)


def digitize(value: Column, edges: list[float]) -> Column:
    """How many edges are not above the value."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= value))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def parse_literal(text: Column) -> Column:
    """The type a command-line value has: boolean, then integer, then float, then string, as a struct."""
    trimmed = F.trim(text)
    as_bool = F.when(F.lower(trimmed).isin("true", "false"), F.lower(trimmed) == "true")
    as_int = F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed.try_cast("long"))
    as_float = F.when(trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), trimmed.try_cast("double"))
    kind = F.when(as_bool.isNotNull(), "bool").when(as_int.isNotNull(), "int").when(as_float.isNotNull(), "float").otherwise("str")
    return F.struct(kind.alias("kind"), as_bool.alias("b"), as_int.alias("i"), F.when(as_int.isNull(), as_float).alias("f"), trimmed.alias("s"))


def uniform(seed: int, *key: Column) -> Column:
    """A uniform number in [0, 1) that only depends on the seed and the key, never on the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)).cast("double") / float(1 << 53)


def normal(seed: int, *key: Column) -> Column:
    """A standard normal number by the Box-Muller transform of two such numbers."""
    u, v = F.greatest(uniform(seed, F.lit("u"), *key), F.lit(2.0**-53)), uniform(seed, F.lit("v"), *key)
    return F.sqrt(-2 * F.log(u)) * F.cos(TWO_PI * v)
