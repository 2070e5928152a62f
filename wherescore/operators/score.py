"""Parsing, scoring and tagging of model responses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherescore.functions import text
from wherescore.functions.lookups import COUNTRY_ALIASES, COUNTRY_REGIONS, PARSE_ERROR, lookup_frame
from wherescore.operators.joins import spread_join
from wherescore.schemas import RESULT_COLUMNS


def add_prediction(df: DataFrame, aliases: Mapping[str, str] = COUNTRY_ALIASES) -> DataFrame:
    """Add ``predicted_country`` parsed from ``raw_response``."""
    spark = df.sparkSession
    names = lookup_frame(spark, aliases, "_alias", "_canonical")
    clean = F.col("_clean")
    return (
        df.drop("predicted_country")
        .withColumn("_clean", text.clean_answer(text.extract_answer("raw_response")))
        .withColumn("_alias", text.alias_key("_clean"))
        .join(names, "_alias", "left")
        .withColumn(
            "predicted_country",
            F.when(clean.isNull(), F.lit(PARSE_ERROR)).otherwise(
                F.coalesce(F.col("_canonical"), text.title_case(clean))
            ),
        )
        .drop("_alias", "_clean", "_canonical")
    )


def add_country_score(df: DataFrame) -> DataFrame:
    """Add ``correct``: does the prediction name the true country?"""
    return df.withColumn("correct", text.country_match("predicted_country", "true_country"))


def add_region_score(df: DataFrame, regions: Mapping[str, str] = COUNTRY_REGIONS) -> DataFrame:
    """Add ``region_correct``: does the predicted country lie in the true region?"""
    names = lookup_frame(df.sparkSession, regions, "predicted_country", "_predicted_region")
    return (
        df.join(names, "predicted_country", "left")
        .withColumn(
            "region_correct",
            text.regions_equal("predicted_country", "_predicted_region", "true_region"),
        )
        .drop("_predicted_region")
    )


def attach_region(df: DataFrame, annotations: DataFrame, order: Sequence[str] = ("ord",)) -> DataFrame:
    """Set ``true_region`` from the annotation of the id; the last row of an id wins, '' if none.

    ``order`` names the columns that give the row order of ``annotations``.
    """
    last = annotations.where(F.col("id").isNotNull()).groupBy("id").agg(
        F.max_by("region", F.struct(*order)).alias("_region")
    )
    return (
        spread_join(df, last, ["id"], "left")
        .withColumn("true_region", F.coalesce("_region", F.lit("")))
        .drop("_region")
    )


def fallback_region(df: DataFrame, regions: Mapping[str, str] = COUNTRY_REGIONS) -> DataFrame:
    """Set ``true_region`` from ``true_country`` if the column is absent."""
    if "true_region" in df.columns:
        return df
    names = lookup_frame(df.sparkSession, regions, "true_country", "_region")
    return (
        df.join(names, "true_country", "left")
        .withColumn("true_region", F.coalesce("_region", F.lit("")))
        .drop("_region")
    )


def score_responses(
    df: DataFrame,
    annotations: DataFrame | None = None,
    aliases: Mapping[str, str] = COUNTRY_ALIASES,
    regions: Mapping[str, str] = COUNTRY_REGIONS,
    order: Sequence[str] = ("ord",),
) -> DataFrame:
    """Parse and score responses: prediction, country match, true region, region match.

    Columns that are not part of the results table are kept after it.
    """
    if "raw_response" not in df.columns:
        raise ValueError(f"column 'raw_response' is missing; found {df.columns}")
    out = add_country_score(add_prediction(df, aliases))
    out = fallback_region(out, regions) if annotations is None else attach_region(out, annotations, order)
    out = add_region_score(out, regions)
    if "cue_type" not in out.columns:
        out = out.withColumn("cue_type", F.lit(None).cast("string"))
    others = [c for c in out.columns if c not in RESULT_COLUMNS]
    return out.select(*[c for c in RESULT_COLUMNS if c in out.columns], *others)


def flagged_ids(annotations: DataFrame) -> DataFrame:
    """Distinct ids with at least one row marked multi-cue."""
    return annotations.where(text.parse_bool("multi_cue") & F.col("id").isNotNull()).select("id").distinct()


def tag_multicue(df: DataFrame, annotations: DataFrame) -> DataFrame:
    """Set ``multi_cue`` on every row whose id is marked in any annotation row; never NULL."""
    flags = flagged_ids(annotations).withColumn("_flag", F.lit(True))
    return (
        spread_join(df.drop("multi_cue"), flags, ["id"], "left")
        .withColumn("multi_cue", F.coalesce("_flag", F.lit(False)))
        .drop("_flag")
    )


def multicue_count(df: DataFrame) -> DataFrame:
    """Number of multi-cue rows and of all rows."""
    flags = F.coalesce(F.sum(text.parse_bool("multi_cue").cast("int")), F.lit(0))
    return df.agg(flags.alias("n_multi"), F.count("*").alias("n_rows"))


def single_cue_only(df: DataFrame) -> DataFrame:
    """Drop multi-cue rows if the column exists."""
    return df.where(~text.parse_bool("multi_cue")) if "multi_cue" in df.columns else df
