"""Accuracy tables.

All metrics add up the same few measures. A results table has one row of measures per response;
``cells`` adds them up once per model, cue, country and subset, and every metric takes either form.
A report computes the cells once, in one pass, and derives each of its tables from them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wherescore.functions import text
from wherescore.functions.lookups import CUE_TYPES

ALL_MODELS = "All models"

_MEASURES = ["_rows", "_correct", "_correct_n", "_region", "_region_n"]
_KEYS = ["model", "cue_type", "true_country", "multi_cue"]


def measures(df: DataFrame) -> DataFrame:
    """Results with one set of measure columns per row; cells are returned as they are."""
    if "_rows" in df.columns:
        return df
    added = {"_rows": F.lit(1)}
    for column, name in (("correct", "_correct"), ("region_correct", "_region")):
        if column in df.columns:
            added[name] = F.coalesce(F.col(column).cast("int"), F.lit(0))
            added[f"{name}_n"] = F.col(column).isNotNull().cast("int")
    if "cue_type" in df.columns:
        added["cue_type"] = F.nullif(F.col("cue_type"), F.lit(""))
    if "multi_cue" in df.columns:
        added["multi_cue"] = text.parse_bool("multi_cue")
    return df.withColumns(added)


def cells(df: DataFrame) -> DataFrame:
    """Measures added up per model, cue, true country and subset, as far as the columns exist."""
    rows = measures(df)
    return rows.groupBy(*[k for k in _KEYS if k in rows.columns]).agg(
        *[F.sum(m).alias(m) for m in _MEASURES if m in rows.columns]
    )


def _single(df: DataFrame) -> DataFrame:
    return df.where(~F.col("multi_cue")) if "multi_cue" in df.columns else df


def _rate(name: str = "_correct", when: Column | None = None) -> Column:
    hits, count = F.col(name), F.col(f"{name}_n")
    if when is not None:
        hits, count = F.when(when, hits), F.when(when, count)
    return F.try_divide(F.sum(hits), F.sum(count))


def _count(name: str = "_correct", when: Column | None = None) -> Column:
    count = F.col(f"{name}_n")
    return F.coalesce(F.sum(count if when is None else F.when(when, count)), F.lit(0))


def _empty(df: DataFrame, *fields: tuple[str, T.DataType]) -> DataFrame:
    """Empty table of a metric whose input column is missing; it starts no job."""
    return df.sparkSession.createDataFrame([], T.StructType([T.StructField(n, t) for n, t in fields]))


def _by_key(df: DataFrame, key: str, metric: str, rate_name: str = "_correct") -> DataFrame:
    return (
        measures(df)
        .where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(_rate(rate_name).alias(metric), _count(rate_name).alias("n_images"))
    )


def overall_accuracy(df: DataFrame) -> DataFrame:
    """Share of correct responses, and the row count."""
    return measures(df).agg(
        _rate().alias("accuracy"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_images")
    )


def accuracy_by_model(df: DataFrame) -> DataFrame:
    """Accuracy per model, best first."""
    return _by_key(df, "model", "accuracy").orderBy(F.desc("accuracy"), "model")


def accuracy_by_cue(df: DataFrame) -> DataFrame:
    """Accuracy per cue type over single-cue images."""
    return _by_key(_single(measures(df)), "cue_type", "accuracy").orderBy("cue_type")


def accuracy_by_country(df: DataFrame) -> DataFrame:
    """Accuracy per true country over all images, best first."""
    return _by_key(df, "true_country", "accuracy").orderBy(F.desc("accuracy"), "true_country")


def _cue_columns(rate_name: str) -> list[Column]:
    return [_rate(rate_name, F.col("cue_type") == cue).alias(cue) for cue in CUE_TYPES]


def _model_cue(df: DataFrame, rate_name: str) -> DataFrame:
    """Model x cue over single-cue images; models without any known cue are dropped."""
    return (
        _single(measures(df))
        .where(F.col("model").isNotNull())
        .groupBy("model")
        .agg(*_cue_columns(rate_name), _rate(rate_name).alias("overall"), F.count("cue_type").alias("_cues"))
        .where("_cues > 0")
        .drop("_cues")
        .orderBy(F.desc("overall"), "model")
    )


def accuracy_by_model_and_cue(df: DataFrame) -> DataFrame:
    """Accuracy of each model per cue type and overall, single-cue images only."""
    return _model_cue(df, "_correct")


def region_accuracy_by_model(df: DataFrame) -> DataFrame:
    """Region accuracy per model, best first; empty if it was not scored."""
    rows = measures(df)
    if "_region" not in rows.columns:
        return _empty(
            df, ("model", T.StringType()), ("region_accuracy", T.DoubleType()), ("n_images", T.LongType())
        )
    return _by_key(rows, "model", "region_accuracy", "_region").orderBy(F.desc("region_accuracy"), "model")


def region_accuracy_by_model_and_cue(df: DataFrame) -> DataFrame:
    """Region accuracy of each model per cue type and overall; empty if it was not scored."""
    rows = measures(df)
    if "_region" not in rows.columns:
        return _empty(
            df, ("model", T.StringType()), *[(c, T.DoubleType()) for c in [*CUE_TYPES, "overall"]]
        )
    return _model_cue(rows, "_region")


def accuracy_by_model_and_country(df: DataFrame) -> DataFrame:
    """Accuracy per model and true country, one row each."""
    rows = measures(df)
    return (
        rows.where(F.col("model").isNotNull() & F.col("true_country").isNotNull())
        .groupBy("model", "true_country")
        .agg(_rate().alias("accuracy"), _count().alias("n_images"))
        .orderBy("model", "true_country")
    )


def model_country_map(df: DataFrame) -> DataFrame:
    """Accuracy of each model by country, with the countries that the data hold: model, by_country, overall.

    ``by_country`` is a sorted array of (country, accuracy) with every country of any model, NULL where the model has no
    row of it. It is made of one row per model and country, so it is as long as there are countries; nothing is collected.
    """
    rows = measures(df)
    long = accuracy_by_model_and_country(rows)
    countries = long.agg(F.sort_array(F.collect_set("true_country")).alias("_all"))
    known = long.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("true_country", "accuracy"))).alias("_known"))
    overall = rows.where(F.col("model").isNotNull()).groupBy("model").agg(_rate().alias("overall"))
    every = F.transform("_all", lambda c: F.struct(c.alias("country"), F.try_element_at("_known", c).alias("accuracy")))
    joined = known.join(overall, "model").crossJoin(countries)  # countries are one row
    return joined.select("model", every.alias("by_country"), "overall").orderBy(F.desc("overall"), "model")


def country_columns(wide: DataFrame) -> DataFrame:
    """The table of ``model_country_map`` with a column for each country, for output: names come from its first row."""
    first = wide.select(F.col("by_country.country").alias("names")).first()
    names = first["names"] if first else []
    values = [F.col("by_country")[k]["accuracy"].alias(c) for k, c in enumerate(names)]
    return wide.select("model", *values, "overall")


def model_country_pivot(df: DataFrame, countries: Sequence[str]) -> DataFrame:
    """Accuracy of each model with one column per given true country, and overall.

    All countries of the data, however many, are rows of ``accuracy_by_model_and_country``.
    """
    rows = measures(df).where(F.col("model").isNotNull())
    per_country = [_rate(when=F.col("true_country") == c).alias(c) for c in countries]
    return (
        rows.groupBy("model")
        .agg(*per_country, _rate().alias("overall"), F.count("true_country").alias("_known"))
        .where("_known > 0")
        .drop("_known")
        .orderBy(F.desc("overall"), "model")
    )


def accuracy_multicue(df: DataFrame) -> DataFrame:
    """Accuracy per model of multi-cue and of single-cue images; empty without the flag."""
    if "multi_cue" not in df.columns:
        return _empty(
            df,
            ("model", T.StringType()),
            ("subset", T.StringType()),
            ("accuracy", T.DoubleType()),
            ("n_images", T.LongType()),
        )
    subset = F.when(F.col("multi_cue"), "multi-cue").otherwise("single-cue")
    return (
        measures(df)
        .where(F.col("model").isNotNull())
        .groupBy("model", subset.alias("subset"))
        .agg(_rate().alias("accuracy"), _count().alias("n_images"))
        .orderBy("model", F.desc("subset"))
    )


def multicue_pivot(df: DataFrame) -> DataFrame:
    """Multi-cue and single-cue accuracy as columns, one row per model; empty without the flag."""
    if "multi_cue" not in df.columns:
        return _empty(
            df, ("model", T.StringType()), ("multi-cue", T.DoubleType()), ("single-cue", T.DoubleType())
        )
    return (
        measures(df)
        .where(F.col("model").isNotNull())
        .groupBy("model")
        .agg(
            _rate(when=F.col("multi_cue")).alias("multi-cue"),
            _rate(when=~F.col("multi_cue")).alias("single-cue"),
        )
        .orderBy("model")
    )


def model_summary(df: DataFrame) -> DataFrame:
    """Country, region, single-cue and multi-cue accuracy of each model, in one aggregation.

    Accuracies whose input column is missing are NULL.
    """
    rows = measures(df)
    if "_region" not in rows.columns:
        rows = rows.withColumns({"_region": F.lit(None).cast("long"), "_region_n": F.lit(0)})
    if "multi_cue" not in rows.columns:
        rows = rows.withColumn("multi_cue", F.lit(None).cast("boolean"))
    return (
        rows.where(F.col("model").isNotNull())
        .groupBy("model")
        .agg(
            _rate().alias("country_accuracy"),
            _rate("_region").alias("region_accuracy"),
            _rate(when=~F.col("multi_cue")).alias("single_cue_accuracy"),
            _rate(when=F.col("multi_cue")).alias("multi_cue_accuracy"),
            F.sum("_rows").alias("n_images"),
        )
        .orderBy(F.desc("country_accuracy"), "model")
    )


def model_cue_rollup(df: DataFrame) -> DataFrame:
    """Model x cue with a last row over all models, weighted by images."""
    total = F.grouping("model") == 1
    return (
        _single(measures(df))
        .where(F.col("model").isNotNull())
        .rollup("model")
        .agg(
            *_cue_columns("_correct"),
            _rate().alias("overall"),
            F.count("cue_type").alias("_cues"),
            total.alias("_total"),
        )
        .where("_cues > 0")
        .withColumn("model", F.when(F.col("_total"), ALL_MODELS).otherwise(F.col("model")))
        .orderBy("_total", F.desc("overall"), "model")
        .drop("_cues", "_total")
    )


def accuracy_gaps(df: DataFrame) -> DataFrame:
    """Region minus country and multi-cue minus single-cue accuracy per model, in points."""
    return model_summary(df).select(
        "model",
        ((F.col("region_accuracy") - F.col("country_accuracy")) * 100).alias("region_gap_pp"),
        ((F.col("multi_cue_accuracy") - F.col("single_cue_accuracy")) * 100).alias("multi_gap_pp"),
    )


def cue_spread(df: DataFrame) -> DataFrame:
    """Best minus worst model per cue type, in points."""
    long = accuracy_by_model_and_cue(df).unpivot("model", CUE_TYPES, "cue_type", "accuracy")
    return (
        long.groupBy("cue_type")
        .agg(
            F.max("accuracy").alias("best"),
            F.min("accuracy").alias("worst"),
            ((F.max("accuracy") - F.min("accuracy")) * 100).alias("spread_pp"),
        )
        .orderBy("cue_type")
    )


def provider_delta(df: DataFrame, models: DataFrame) -> DataFrame:
    """Accuracy of each model against the previous generation of its provider.

    ``models`` has the columns model_id, provider and generation.
    """
    per_model = _by_key(df, "model", "accuracy")
    older = Window.partitionBy("provider").orderBy("generation", "model")
    return (
        per_model.join(models.withColumnRenamed("model_id", "model"), "model")
        .select(
            "provider",
            "generation",
            "model",
            "accuracy",
            F.lag("accuracy").over(older).alias("previous_accuracy"),
            (F.col("accuracy") - F.lag("accuracy").over(older)).alias("delta"),
        )
        .orderBy("provider", "generation", "model")
    )


def model_rank(df: DataFrame) -> DataFrame:
    """Models with their rank by accuracy; the window sees one row per model."""
    return accuracy_by_model(df).withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("accuracy"))))


def model_cue_grid(df: DataFrame) -> DataFrame:
    """Complete model x cue grid, missing cells 0, with bar label and colour left to the report."""
    wide = accuracy_by_model_and_cue(df)
    grid = F.explode(
        F.array(
            *[
                F.struct(F.lit(cue).alias("cue_type"), F.coalesce(F.col(cue), F.lit(0.0)).alias("accuracy"))
                for cue in CUE_TYPES
            ]
        )
    )
    return wide.select("model", grid.alias("cell")).select("model", "cell.cue_type", "cell.accuracy")


def dataset_composition(annotations: DataFrame) -> DataFrame:
    """Countries and image count per region, with a total row."""
    total = F.grouping("region") == 1
    return (
        annotations.groupBy("region", "country")
        .agg(F.count("*").alias("n"))
        .rollup("region")
        .agg(
            F.array_join(F.sort_array(F.collect_set("country")), ", ").alias("countries"),
            F.sum("n").alias("n_images"),
            total.alias("_total"),
        )
        .select(
            F.when(F.col("_total"), "Total").otherwise(F.col("region")).alias("region"),
            F.when(F.col("_total"), "").otherwise(F.col("countries")).alias("countries"),
            "n_images",
        )
    )


def cue_composition(annotations: DataFrame) -> DataFrame:
    """Images and marked multi-cue images per cue type."""
    return (
        annotations.where(F.coalesce(F.col("cue_type"), F.lit("")) != "")
        .groupBy("cue_type")
        .agg(
            F.count("*").alias("n_images"),
            F.sum(text.parse_bool("multi_cue").cast("int")).alias("n_multi"),
        )
        .orderBy("cue_type")
    )
