"""Printed tables and the frames behind the figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wherescore.functions import text
from wherescore.functions.lookups import CUE_COLORS, DEFAULT_COLOR
from wherescore.operators import metrics
from wherescore.sources.scratch import settle


def formatted(df: DataFrame, missing: str | None = None) -> DataFrame:
    """Every double column as a percentage with one decimal."""
    return df.withColumns(
        {
            f.name: text.percent_text(f"`{f.name}`", missing)
            for f in df.schema.fields
            if isinstance(f.dataType, T.DoubleType)
        }
    )


def with_axis_limit(df: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Bars with the upper end of their axis: the largest value plus 0.15, at most 1."""
    top = df.agg(F.least(F.lit(1.0), F.max(metric) + 0.15)).scalar()
    return df.withColumn("y_max", top)


def bar_color(cue) -> Column:
    return F.coalesce(F.try_element_at(text.map_literal(CUE_COLORS), F.col(cue)), F.lit(DEFAULT_COLOR))


def with_colors(df: DataFrame) -> DataFrame:
    """Cue bars with their colour."""
    return df.withColumn("color", bar_color("cue_type"))


def with_labels(df: DataFrame) -> DataFrame:
    """Cue bars with the legend label."""
    return df.withColumn("label", F.initcap("cue_type"))


def accuracy_tables(results: DataFrame) -> dict[str, DataFrame]:
    """All accuracy tables, from one pass over the results; tables without their input are left out."""
    cells = settle(metrics.cells(results))
    tables = {
        "overall": metrics.overall_accuracy(cells),
        "by_model": metrics.accuracy_by_model(cells),
        "by_cue": metrics.accuracy_by_cue(cells),
        "model_cue": metrics.accuracy_by_model_and_cue(cells),
    }
    if "region_correct" in results.columns:
        tables["region_by_model"] = metrics.region_accuracy_by_model(cells)
        tables["region_model_cue"] = metrics.region_accuracy_by_model_and_cue(cells)
    tables["by_country"] = metrics.accuracy_by_country(cells)
    tables["model_country"] = metrics.accuracy_by_model_and_country(cells)
    if "multi_cue" in results.columns:
        tables["multicue"] = metrics.accuracy_multicue(cells)
    return tables


def printed_tables(results: DataFrame) -> dict[str, DataFrame]:
    """The accuracy tables as text; missing cells of the wide tables read N/A."""
    wide = {"model_cue", "region_model_cue"}
    return {n: formatted(t, "N/A" if n in wide else None) for n, t in accuracy_tables(results).items()}


def figure_frames(results: DataFrame) -> dict[str, DataFrame]:
    """The data of each figure, in order; figures without their input are left out."""
    cells = settle(metrics.cells(results))
    frames = {
        "accuracy_by_model": with_axis_limit(metrics.accuracy_by_model(cells)),
        "accuracy_by_cue": with_axis_limit(with_colors(metrics.accuracy_by_cue(cells))),
        "heatmap_model_by_cue": metrics.accuracy_by_model_and_cue(cells).drop("overall"),
        "accuracy_grouped_model_cue": with_labels(with_colors(metrics.model_cue_grid(cells))),
    }
    if "multi_cue" in results.columns:
        frames["accuracy_multicue"] = metrics.multicue_pivot(cells)
    if "region_correct" in results.columns:
        frames["region_accuracy_by_model"] = with_axis_limit(
            metrics.region_accuracy_by_model(cells), "region_accuracy"
        )
        frames["heatmap_region_model_by_cue"] = metrics.region_accuracy_by_model_and_cue(cells).drop("overall")
    return frames
