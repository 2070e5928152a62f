"""Running sums and row numbers over groups of any size and any spread of positions, with one exchange of the rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherescore.sources.scratch import settle


def _differs(column: pa.Array) -> np.ndarray:
    """Rows, from the second on, whose value is not that of the row before."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    found = null[1:] != null[:-1]
    if pa.types.is_struct(column.type):
        for part in column.flatten():
            found |= _differs(part)
        return found
    values = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
    return found | pc.fill_null(values, False).to_numpy(zero_copy_only=False)


def _starts(batch: pa.RecordBatch, by: Sequence[str], last: list | None) -> tuple[np.ndarray, list]:
    """Rows of a batch that begin a group, given the key of the row before it; and the key of its last row."""
    n = batch.num_rows
    begins = np.zeros(n, bool)
    begins[0] = last is None
    for i, name in enumerate(by):
        column = batch.column(name)
        begins[1:] |= _differs(column)
        if last is not None:
            begins[0] |= column[0].as_py() != last[i]
    return begins, [batch.column(name)[n - 1].as_py() for name in by]


def _last_of_ties(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The last of each run of rows with equal keys."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        key = None if held is None else [held.column(k)[0].as_py() for k in keys]
        begins, _ = _starts(batch, keys, key)
        if held is not None and begins[0]:
            yield held
        last = np.append(begins[1:], False)  # the very last row waits for the next batch
        yield batch.filter(pa.array(last))
        held = batch.slice(batch.num_rows - 1)
    if held is not None:
        yield held


def _accumulated(by: Sequence[str], sums: Mapping[str, str], ties: Sequence[str] | None):
    """Adds running sums within the task to rows that come in order, with the task's number and whether its first group."""

    def all_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _last_of_ties(run(batches), ties) if ties else run(batches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carried, first = None, dict.fromkeys(sums, 0), True
        for batch in batches:
            if not batch.num_rows:
                continue
            start = 1 if last is None else 0
            begins, last = _starts(batch, by, last)
            group = np.cumsum(begins)  # zero: the group that the batch before ended with
            heads = np.flatnonzero(begins)
            columns, names = list(batch.columns), list(batch.schema.names)
            leading = (group == start) & first
            for name, column in sums.items():
                values = batch.column(column).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
                total = np.cumsum(values)
                offsets = np.concatenate([[-carried[name]], total[heads] - values[heads]])
                running = total - offsets[group]
                carried[name] = int(running[-1])
                columns.append(pa.array(running, pa.int64()))
                names.append(f"_own_{name}")
            first = first and bool(leading[-1])
            columns += [pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(leading)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "_part", "_leading"])

    return all_rows


def _total(name: str, column: str, last_of_ties: bool) -> Column:
    """What a task adds to a group: the sum of its rows, or where only the last of equal ones are there, its running maximum."""
    return (F.max(f"_own_{name}") if last_of_ties else F.sum(column)).alias(f"_sum_{name}")


def running_sums(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], sums: Mapping[str, str], partitions: int | None = None,
    last_of_ties: bool = False,
) -> DataFrame:
    """Add running sums of whole-number columns within each group, in ``order``, the current row included.

    ``sums`` maps an output column to an input column; null values count as 0, null keys are a group like any other. Rows
    are dealt out in ranges of (group, order), so a group of any size is spread over tasks, whatever its positions are; ties
    in ``order`` are in no particular order (``last_of_ties``, for values that are not negative: of rows equal in names ``by`` and ``order`` the last one stays). Only the group that a task begins with can have rows in earlier tasks, and
    needs what they left: one row per task, which is broadcast.
    """
    by = list(by)
    schema = df.schema
    for name in sums:
        schema = schema.add(f"_own_{name}", "long")
    schema = schema.add("_part", "integer").add("_leading", "boolean")
    keys = [*by, *order]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    rows = settle(ranged.sortWithinPartitions(*keys).mapInArrow(_accumulated(by, sums, keys if last_of_ties else None), schema))
    totals = rows.groupBy("_part", *by).agg(F.max("_leading").alias("_leading"), *[_total(n, c, last_of_ties) for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select("_part", "_leading", *[F.sum(f"_sum_{n}").over(before).alias(f"_before_{n}") for n in sums])
    joined = rows.join(F.broadcast(earlier.where("_leading").drop("_leading")), "_part", "left")  # one row per task
    here = [
        (F.col(f"_own_{n}") + F.when(F.col("_leading"), F.coalesce(f"_before_{n}", F.lit(0))).otherwise(0)).alias(n) for n in sums
    ]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *here)


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """Add the number of each row within its group, in ``order``, from 0."""
    columns = df.columns
    counted = running_sums(df.withColumn("_one", F.lit(1).cast("long")), by, order, {name: "_one"})
    return counted.select(*[F.col(f"`{c}`") for c in columns], (F.col(name) - 1).alias(name))
