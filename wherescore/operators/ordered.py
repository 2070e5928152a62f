"""Running aggregates over long ordered groups.

A window over a whole group runs in one task. Here a group is cut into blocks of consecutive rows:
every block is aggregated, the block results are accumulated (one row per block), and the running
value inside a block starts from what the blocks before it left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SPAN = 1 << 20

_AGGREGATES = {"sum": F.sum, "max": F.max}


def block_of(order, span: int = BLOCK_SPAN) -> Column:
    """First position of the block of an integer row position; a block has at most ``span`` positions."""
    position = F.col(order) if isinstance(order, str) else order
    return position - F.pmod(position, F.lit(span))


def running(
    df: DataFrame,
    by: Sequence[str],
    block: str,
    order: Sequence[str],
    values: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """Add running aggregates of each ``by`` group in ``order``, the current row included.

    ``block`` must not decrease along ``order``. ``values`` maps an output column to
    ("sum" or "max", input column). Input rows with a NULL group key are dropped.
    """
    by = list(by)
    df = df.where(" and ".join(f"`{k}` is not null" for k in [*by, block]))

    totals = df.groupBy(*by, block).agg(
        *[_AGGREGATES[kind](column).alias(f"_block_{name}") for name, (kind, column) in values.items()]
    )
    before = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *by,
        block,
        *[
            _AGGREGATES[kind](f"_block_{name}").over(before).alias(f"_carry_{name}")
            for name, (kind, _) in values.items()
        ],
    )

    inside = (
        Window.partitionBy(*by, block)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = df.join(carry, [*by, block], "left")
    added = {}
    for name, (kind, column) in values.items():
        here, carried = _AGGREGATES[kind](column).over(inside), F.col(f"_carry_{name}")
        if kind == "sum":
            added[name] = F.coalesce(carried, F.lit(0)) + F.coalesce(here, F.lit(0))
        else:
            added[name] = F.greatest(carried, here)
    return out.withColumns(added).drop(*[f"_carry_{name}" for name in values])
