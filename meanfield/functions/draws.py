"""Reproducible random draws as column expressions, from the uniforms of ``vectors.uniform``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import uniform

#: Half the step of a uniform, which moves it off 0.
_HALF = 0.5 / 4503599627370496.0


def open_uniform(seed: int, tag: str, *keys) -> Column:
    """In the open interval (0, 1)."""
    return uniform(seed, tag, *keys) + F.lit(_HALF)


def integer(n: int, seed: int, tag: str, *keys) -> Column:
    """One of 0, ..., n, each as likely."""
    return F.floor(uniform(seed, tag, *keys) * (n + 1)).cast("long")


def normal(seed: int, tag: str, *keys) -> Column:
    """Standard normal, from two uniforms by their radius and angle."""
    return F.sqrt(-2 * F.log(open_uniform(seed, f"{tag}:r", *keys))) * F.cos(2 * math.pi * uniform(seed, f"{tag}:a", *keys))


def cauchy(seed: int, tag: str, *keys) -> Column:
    """Standard Cauchy: the tangent of a uniform angle."""
    return F.tan(math.pi * (open_uniform(seed, tag, *keys) - 0.5))
