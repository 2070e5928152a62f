"""Sectioned text lists: country headers, cue headers and id lines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherescore.functions import text
from wherescore.functions.lookups import (
    COUNTRY_RENAMES,
    CUE_HEADERS,
    LABEL_REGIONS,
    MULTI_CUE_HEADER,
    lookup_frame,
)
from wherescore.operators.ordered import BLOCK_SPAN, block_of, running


def with_block(lines: DataFrame, span: int = BLOCK_SPAN) -> DataFrame:
    """Lines numbered by an integer ``pos`` with the block that ``running`` needs."""
    return lines.withColumn("block", block_of("pos", span))


def _id_lines(lines: DataFrame) -> DataFrame:
    """Id lines with the last country header and the last cue header before them.

    A header is carried with its position, so "the cue header came after the country header" is a
    comparison and both fill in one running maximum per block.
    """
    lines = lines.withColumn("line", text.strip("line")).where(F.col("line") != "")
    is_cue = F.col("line").isin(*CUE_HEADERS)
    is_country = ~is_cue & ~text.has_digit("line")
    header = F.struct("pos", "line")
    marked = lines.withColumns(
        {
            "_is_id": ~is_cue & ~is_country,
            "_country": F.when(is_country, header),
            "_cue": F.when(is_cue, header),
        }
    )
    filled = running(
        marked,
        ["file"],
        "block",
        ["pos"],
        {"_last_country": ("max", "_country"), "_last_cue": ("max", "_cue")},
    )
    return filled.where(F.col("_is_id") & F.col("_last_country").isNotNull())


def parse_image_list(
    lines: DataFrame,
    renames: Mapping[str, str] = COUNTRY_RENAMES,
    regions: Mapping[str, str] = LABEL_REGIONS,
    root: str = "data/images",
) -> DataFrame:
    """Annotation rows of a list, with its ``file`` and ``pos``.

    ``lines`` has file, block, pos and line, where pos orders the lines of a file and block does not
    decrease with it. An id needs a country header and, after that, a cue header.
    """
    rows = _id_lines(lines).where(F.col("_last_cue.pos") > F.col("_last_country.pos"))
    words = text.split_words("line")
    rows = rows.select(
        "file",
        "pos",
        words[0].alias("id"),
        F.array_join(F.slice(words, 2, F.size(words)), " ").alias("_notes"),
        text.rename("_last_country.line", renames).alias("country"),
        F.col("_last_cue.line").alias("_header"),
    )
    multi = F.col("_header") == MULTI_CUE_HEADER
    names = lookup_frame(lines.sparkSession, regions, "country", "_region")
    return rows.join(names, "country", "left").select(
        "file",
        "pos",
        "id",
        text.image_path("id", "country", root).alias("filepath"),
        "country",
        text.primary_cue("_header", "_notes").alias("cue_type"),
        multi.alias("multi_cue"),
        F.when(multi, F.col("_notes")).otherwise(F.lit("")).alias("cue_notes"),
        F.coalesce("_region", F.lit("")).alias("region"),
    )


def parse_image_list_ids(lines: DataFrame, renames: Mapping[str, str] = COUNTRY_RENAMES) -> DataFrame:
    """Ids of a list with their country; cue headers are ignored."""
    return _id_lines(lines).select(
        "file",
        "pos",
        text.split_words("line")[0].alias("id"),
        text.rename("_last_country.line", renames).alias("country"),
    )
