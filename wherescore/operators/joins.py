"""Equi-joins that stay parallel when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPREAD = "_key_hash"


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on ``on``, in a form whose skewed partitions adaptive execution can split.

    Adaptive execution splits a skewed partition only if both join inputs come straight from an
    exchange. An aggregated or windowed side is already partitioned by the key and gets none. Joining
    on the key and its hash gives such a side its own exchange; the rows that match are the same.
    Small sides are still turned into broadcast joins from their known or measured size.
    """
    on = list(on)
    spread = F.xxhash64(*on)
    joined = left.withColumn(_SPREAD, spread).join(right.withColumn(_SPREAD, spread), [*on, _SPREAD], how)
    return joined.drop(_SPREAD)
