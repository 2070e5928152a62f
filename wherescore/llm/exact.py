"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherescore.llm.common import repeated, whole_text
from wherescore.operators.joins import spread_join

#: Bits of the filter that says which (length, prefix hash) can still have a copy; 8 bits to a byte are broadcast: 1 MB.
FILTER_BITS = 1 << 23
_BUCKET_BITS = 8 * 4096  # of bitmap_construct_agg


def surviving(rows: DataFrame, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose values in the columns of ``keys`` may be in ``keys``, found without moving the rows."""
    return marked(rows, keys, bits).where("_maybe").select(rows.columns)


def marked(rows: DataFrame, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with ``_maybe``: whether their values in the columns of ``keys`` may be in ``keys``.

    The keys are folded into a bitmap of ``bits`` bits, so at most bits / 8 bytes are broadcast whatever the input.
    A few rows are marked that are not in ``keys``; all others are marked rightly.
    """
    slot = F.pmod(F.xxhash64(*keys.columns), F.lit(bits))
    bitmap = (
        keys.select(slot.alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bitmap"))
    )
    position = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substr("_bitmap", (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr("(_byte >> cast(bitmap_bit_position(_slot) % 8 as int)) & 1")
    return (
        rows.withColumn("_slot", slot)
        .withColumn("_bucket", F.bitmap_bucket_number("_slot"))
        .join(F.broadcast(bitmap), "_bucket", "left")
        .withColumn("_byte", byte)
        .select(*rows.columns, F.coalesce(bit == 1, F.lit(False)).alias("_maybe"))
    )


def exact_groups(docs: DataFrame, prefix_chars: int = 64, bits: int = FILTER_BITS) -> DataFrame:
    """Texts that several rows have: text_sha256, keep_id (largest doc_id), group_size.

    Step one counts lengths, step two hashes of the first ``prefix_chars`` characters within repeated lengths, step three
    hashes whole texts of the rows that are left. Only lengths and hashes are shuffled, never texts.
    Null texts count as empty; a group of null ids only has the keep_id null.
    """
    rows = docs.select("doc_id", whole_text().alias("text")).select(
        "doc_id",
        "text",
        F.octet_length("text").alias("n_bytes"),
        F.xxhash64(F.substring("text", 1, prefix_chars)).alias("prefix"),
    )
    lengths = rows.groupBy("n_bytes").count().where("count > 1")
    counted = rows.groupBy("n_bytes", "prefix").count()  # so that copies are one row in the join
    prefixes = spread_join(counted, lengths.select("n_bytes"), ["n_bytes"], "left_semi").where("count > 1").select("n_bytes", "prefix")
    return (
        surviving(rows, prefixes, bits)
        .select("doc_id", F.sha2("text", 256).alias("text_sha256"))
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )


def exact_dedup(docs: DataFrame, prefix_chars: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; if that id is repeated, one of its rows stays. Null ids are
    smaller than all others. An empty table gives no rows. Columns other than doc_id and text are not looked at.
    """
    ids = (
        docs.select("doc_id", F.sha2(whole_text(), 256).alias("text_sha256")).groupBy("text_sha256", "doc_id").count()
    )  # repeated ids are counted, so that no group of equal rows is gathered
    joined = spread_join(ids, exact_groups(docs, prefix_chars), ["text_sha256"], "left")
    same = F.col("doc_id").eqNullSafe(F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    counted = joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        same.alias("_same"),
        "count",
        "text_sha256",
    )
    return repeated(counted, "count", "_copy").select(
        "doc_id", "keep_id", "group_size", (F.col("_same") & (F.col("_copy") == 0)).alias("kept"), "text_sha256"
    )
