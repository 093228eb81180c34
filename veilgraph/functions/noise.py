"""Keyed randomness and noise as column expressions.

Every draw is a function of a seed, a purpose and the row's key, so it is the
same in every partition layout, after every retry and in any SQL engine that
has md5.  rand() would change with each of these.

Keyed draws under a known seed serve tests and comparisons.  They give no
privacy: a real release needs a secret seed from a cryptographic source, and
geometric() instead of laplace(), as floating-point Laplace noise leaks
through its low bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2**52: the draws are odd multiples of half its inverse, never 0 or 1.
SCALE = float(1 << 52)


def key_bits(seed: int, purpose: str, *keys: Column) -> Column:
    """52 bits of md5 over seed, purpose and keys, as a long."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def uniform(seed: int, purpose: str, *keys: Column) -> Column:
    """A number strictly between 0 and 1."""
    return (key_bits(seed, purpose, *keys) + F.lit(0.5)) / F.lit(SCALE)


def laplace(scale: Column | float, u: Column) -> Column:
    """Laplace noise of the given scale from a uniform draw."""
    b = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.when(u < 0.5, b * F.log(2 * u)).otherwise(-b * F.log(2 * (1 - u)))


def gumbel(u: Column) -> Column:
    return -F.log(-F.log(u))


def geometric(scale: Column | float, u: Column) -> Column:
    """Two-sided geometric noise (discrete Laplace): integers, P(k)
    proportional to exp(-|k| / scale)."""
    b = scale if isinstance(scale, Column) else F.lit(float(scale))
    a = F.exp(-1 / b)
    below = u * (1 + a)
    left = -F.floor(F.log(below) / F.log(a))  # inverse of the lower tail
    right = F.ceil(F.log((1 - u) * (1 + a)) / F.log(a)) - 1
    return F.when(u <= a / (1 + a), left).otherwise(F.greatest(right, F.lit(0))).cast("long")
