"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wherescore.operators.joins import spread_join


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text as it is; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key() -> list[Column]:
    """Columns that tell rows apart whose doc_id is null or repeated: the id, if it is there, and the text's hash."""
    return [
        F.coalesce("doc_id", F.lit(0)).alias("_row_id"),
        F.xxhash64(F.col("doc_id").isNull(), whole_text()).alias("_row_hash"),
    ]


ROW_KEY = ["_row_id", "_row_hash"]


def packed(docs: DataFrame) -> DataFrame:
    """Row keys and the given columns in one struct (_row), so that no name of theirs can clash with another column."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_key())


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose row key is not in ``rejected`` (columns of ROW_KEY)."""
    return spread_join(packed(docs), rejected.select(*ROW_KEY), ROW_KEY, "left_anti").select("_row.*")


def repeated(rows: DataFrame, times: str, nth: str) -> DataFrame:
    """Each row as often as its column ``times`` says, numbered from 0; two steps, so that no array of all copies is made."""
    step = 1 << 10
    blocks = rows.where(F.col(times) > 0).withColumn("_block", F.explode(F.expr(f"sequence(0L, (`{times}` - 1) div {step})")))
    last = F.least(F.lit(step - 1), F.col(times) - F.col("_block") * step - 1)
    numbered = blocks.withColumn("_in_block", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    return numbered.withColumn(nth, F.col("_block") * step + F.col("_in_block")).drop("_block", "_in_block")
