"""Extendible hashing: a directory indexed by hash-prefix bits whose oversized buckets split on one more bit."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherescore.llm.common import whole_text
from wherescore.operators.joins import spread_join
from wherescore.sources.scratch import settle

HASH_BITS = 60
#: Bits that one pass over the directory looks ahead of the average shard.
LOOK_AHEAD = 6


def key_hash(key: str = "doc_id") -> Column:
    """The first 60 bits of the key's MD5, as a whole number; a null key hashes as the empty string."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def split_buckets(sizes: DataFrame, depth: int, limit: int) -> DataFrame:
    """For each ``depth``-bit cell (_cell, bytes, docs): the depth at which it stops splitting, null if it is still too large.

    A bucket of d bits is a shard if it holds at most ``limit`` bytes or one row, and the bucket of d - 1 bits does not.
    Each cell adds its bytes to its buckets of 0 to ``depth`` bits in one aggregation, so no pass per level is needed.
    """
    levels = sizes.select("_cell", "bytes", "docs", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("_d")).withColumn(
        "_bucket", F.expr(f"shiftright(_cell, {depth} - _d)")
    )
    totals = levels.groupBy("_d", "_bucket").agg(F.sum("bytes").alias("_bytes"), F.sum("docs").alias("_docs"))
    fits = totals.where((F.col("_bytes") <= limit) | (F.col("_docs") == 1))
    leaf = spread_join(levels.select("_cell", "_d", "_bucket"), fits, ["_d", "_bucket"], "inner")
    found = leaf.groupBy("_cell").agg(F.min_by(F.struct("_d", "_bytes", "_docs"), "_d").alias("_leaf"))
    return sizes.select("_cell").join(found.select("_cell", "_leaf._d", "_leaf._bytes", "_leaf._docs"), "_cell", "left")


def assign_shards(
    docs: DataFrame, limit: int, key: str = "doc_id", size: Column | None = None, carry: Sequence[str] | None = None
) -> DataFrame:
    """One row per row of ``docs``: the columns ``carry`` (default: the key), bytes, shard, depth, shard_bytes, shard_docs.

    ``shard`` is the bucket's bit string (the root is empty), with ``+n`` for the n-th overflow page of a bucket whose rows
    have one key hash, which no bit can split. Every shard holds at most ``limit`` bytes, but for a single larger row,
    which has a shard of its own. Null texts have 0 bytes, null keys hash as the empty string. An empty table gives no
    rows. Carried columns with the names of the new ones are replaced by these.

    Each pass adds up the bytes of cells of so many bits that a shard holds several cells; only rows of cells that are
    still too large (large keys) go on to a pass with more bits, until the hash is used up.
    """
    carry = [c for c in (carry or [key]) if c not in ("bytes", "shard", "depth", "shard_bytes", "shard_docs")]
    size = F.octet_length(whole_text()).cast("long") if size is None else size
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), size.alias("bytes"), key_hash(key).alias("_hash"))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth = min(HASH_BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + LOOK_AHEAD)
    out: DataFrame | None = None
    while True:
        celled = rows.withColumn("_cell", F.shiftright("_hash", HASH_BITS - depth))
        sizes = celled.groupBy("_cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
        cells = settle(split_buckets(sizes, depth, limit))
        joined = spread_join(celled, cells, ["_cell"], "inner")
        placed = joined.where("_d is not null").select(
            "_row.*",
            "bytes",
            F.expr(f"substr(lpad(bin(_cell), {depth}, '0'), 1, _d)").alias("shard"),
            F.col("_d").alias("depth"),
            F.col("_bytes").alias("shard_bytes"),
            F.col("_docs").alias("shard_docs"),
        )
        out = placed if out is None else out.unionByName(placed)
        if cells.where("_d is null").isEmpty():
            return out
        rows = settle(joined.where("_d is null").select("_row", "bytes", "_hash"))
        if depth == HASH_BITS:
            return out.unionByName(_overflow(rows, limit))
        depth = min(HASH_BITS, depth + 2 * LOOK_AHEAD)


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Pages for rows of one hash: by halves of the limit along a running total of bytes; larger rows go alone.

    A page takes rows of at most limit / 2 bytes whose running total starts in its half, so it holds at most ``limit``.
    The running total is made of totals by task, not by a window over the bucket.
    """
    half = max(1, limit // 2)
    rows = settle(rows.withColumn("_task", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id()))
    small = F.col("bytes") <= half
    step = Window.partitionBy("_hash", "_task").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    tasks = rows.groupBy("_hash", "_task").agg(F.sum(F.when(small, F.col("bytes")).otherwise(0)).alias("_sum"))
    before = tasks.withColumn(
        "_before",
        F.coalesce(F.sum("_sum").over(Window.partitionBy("_hash").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("_sum")
    started = rows.withColumn("_own", F.coalesce(F.sum(F.when(small, F.col("bytes")).otherwise(0)).over(step), F.lit(0)))
    placed = spread_join(started, before, ["_hash", "_task"], "inner").withColumn(
        "_page",
        F.when(small, F.concat(F.lit("+"), F.floor((F.col("_before") + F.col("_own")) / half).cast("string"))).otherwise(
            F.concat(F.lit("+x"), F.col("_n").cast("string"))
        ),
    )
    pages = placed.groupBy("_hash", "_page").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return spread_join(placed, pages, ["_hash", "_page"], "inner").select(
        "_row.*",
        "bytes",
        F.concat(F.expr(f"lpad(bin(_hash), {HASH_BITS}, '0')"), "_page").alias("shard"),
        F.lit(HASH_BITS).alias("depth"),
        "shard_bytes",
        "shard_docs",
    )


def write_shards(docs: DataFrame, limit: int, path: str, key: str = "doc_id") -> None:
    """Write the rows of ``docs`` to one folder per shard (``shard=b...``) of Parquet files."""
    placed = assign_shards(docs, limit, key, carry=docs.columns).select(
        *[c for c in docs.columns if c not in ("bytes", "shard", "depth", "shard_bytes", "shard_docs")],
        F.concat(F.lit("b"), "shard").alias("shard"),
    )
    placed.repartition("shard").write.partitionBy("shard").parquet(path)
