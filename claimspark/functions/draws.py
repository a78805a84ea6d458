"""Seeded draws that depend only on a key: the same in any order, on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 60  # 15 hex digits of the digest


def _digest(key: Column, seed: object) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))  # null draws as the empty key


def draw(key: Column, seed: object = 42) -> Column:
    """A 60-bit number per key; sorting by it is a seeded shuffle."""
    return F.conv(F.substring(_digest(key, seed), 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def _draw32(key: Column, salt: str, seed: object) -> Column:
    return F.conv(F.substring(_digest(key, f"{seed}:{salt}"), 1, 8), 16, 10).cast("bigint")


def random_int(key: Column, low: int, high: int, salt: str, seed: object = 42) -> Column:
    """Integer in [low, high)."""
    return (F.lit(low) + _draw32(key, salt, seed) % F.lit(high - low)).cast("int")


def bernoulli(key: Column, probability: float, salt: str, seed: object = 42) -> Column:
    return _draw32(key, salt, seed) / F.lit(4294967296.0) < F.lit(float(probability))
