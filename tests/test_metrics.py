import pytest
from pyspark.sql import functions as F

from wherescore.functions.lookups import model_frame, model_id
from wherescore.operators import metrics
from wherescore.plans import report

SCHEMA = "model string, cue_type string, true_country string, multi_cue boolean, correct boolean, region_correct boolean"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [
            ("a", "linguistic", "Japan", False, True, True),
            ("a", "linguistic", "Japan", False, False, True),
            ("a", "", "Japan", False, True, True),
            ("a", "odd", "India", False, False, False),
            ("a", "linguistic", "India", True, True, None),
            ("b", None, "India", False, True, True),
            (None, "linguistic", None, False, True, True),
            ("c", "environmental", "Peru", False, None, None),
        ],
        SCHEMA,
    )


def test_null_keys_and_values(rows):
    by_model = {r.model: (r.accuracy, r.n_images) for r in metrics.accuracy_by_model(rows).collect()}
    assert by_model == {"a": (0.6, 5), "b": (1.0, 1), "c": (None, 0)}
    by_cue = {r.cue_type: r.n_images for r in metrics.accuracy_by_cue(rows).collect()}
    assert by_cue == {"linguistic": 3, "odd": 1, "environmental": 0}
    countries = [r.true_country for r in metrics.accuracy_by_country(rows).collect()]
    assert countries[-1] == "Peru" and None not in countries


def test_pivot_keeps_columns_and_drops_models_without_cue(rows):
    wide = {r.model: r for r in metrics.accuracy_by_model_and_cue(rows).collect()}
    assert set(wide) == {"a", "c"}
    assert wide["a"].linguistic == 0.5 and wide["a"].infrastructure is None
    assert wide["a"].overall == 0.5


def test_cells_give_the_same_tables(rows):
    cells = metrics.cells(rows)

    def pivot(df):
        return metrics.model_country_pivot(df, ["India", "Peru"])

    for metric in (
        metrics.overall_accuracy,
        metrics.accuracy_by_model,
        metrics.accuracy_by_cue,
        metrics.accuracy_by_country,
        metrics.accuracy_by_model_and_cue,
        metrics.region_accuracy_by_model,
        metrics.region_accuracy_by_model_and_cue,
        metrics.accuracy_by_model_and_country,
        pivot,
        metrics.accuracy_multicue,
        metrics.multicue_pivot,
        metrics.model_summary,
        metrics.model_cue_rollup,
        metrics.model_cue_grid,
        metrics.model_rank,
    ):
        assert metric(rows).collect() == metric(cells).collect(), metric.__name__


def test_missing_columns_give_empty_tables(rows):
    plain = rows.drop("region_correct", "multi_cue")
    assert metrics.region_accuracy_by_model(plain).columns == ["model", "region_accuracy", "n_images"]
    assert metrics.region_accuracy_by_model(plain).isEmpty()
    assert metrics.region_accuracy_by_model_and_cue(plain).isEmpty()
    assert metrics.accuracy_multicue(plain).isEmpty()
    assert metrics.multicue_pivot(plain).isEmpty()
    assert {r.region_accuracy for r in metrics.model_summary(plain).collect()} == {None}
    assert {r.multi_gap_pp for r in metrics.accuracy_gaps(plain).collect()} == {None}
    assert sum(r.n_images for r in metrics.accuracy_by_cue(plain).collect()) == 5


def test_pivot_has_the_given_columns(rows):
    assert metrics.model_country_pivot(rows, ["Peru", "Japan"]).columns == ["model", "Peru", "Japan", "overall"]


def test_grid_is_complete(rows):
    grid = {(r.model, r.cue_type): r.accuracy for r in metrics.model_cue_grid(rows).collect()}
    assert len(grid) == 6 and grid["a", "environmental"] == 0.0


def test_empty_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert metrics.overall_accuracy(empty).collect()[0][:] == (None, 0)
    assert metrics.accuracy_by_model(empty).isEmpty()


def test_composition(spark):
    annotations = spark.createDataFrame(
        [("1", "Japan", "linguistic", True, "East Asia"), ("2", "China", "linguistic", False, "East Asia"),
         ("3", "India", "", False, "South Asia")],
        "id string, country string, cue_type string, multi_cue boolean, region string",
    )
    found = {tuple(r) for r in metrics.dataset_composition(annotations).collect()}
    assert found == {("East Asia", "China, Japan", 2), ("South Asia", "India", 1), ("Total", "", 3)}
    assert [tuple(r) for r in metrics.cue_composition(annotations).collect()] == [("linguistic", 2, 1)]


def test_report_bundles(rows):
    tables = report.printed_tables(rows)
    assert list(tables) == [
        "overall", "by_model", "by_cue", "model_cue", "region_by_model", "region_model_cue", "by_country",
        "model_country", "multicue",
    ]
    wide = {r.model: r for r in tables["model_cue"].collect()}
    assert wide["a"].linguistic == "50.0%" and wide["a"].environmental == "N/A"
    frames = report.figure_frames(rows)
    assert list(frames) == [
        "accuracy_by_model", "accuracy_by_cue", "heatmap_model_by_cue", "accuracy_grouped_model_cue",
        "accuracy_multicue", "region_accuracy_by_model", "heatmap_region_model_by_cue",
    ]
    assert {r.y_max for r in frames["accuracy_by_model"].collect()} == {1.0}
    colors = {r.cue_type: r.color for r in frames["accuracy_by_cue"].collect()}
    assert colors["odd"] == "#888888" and colors["linguistic"] == "#4C72B0"
    assert {r.label for r in frames["accuracy_grouped_model_cue"].collect()} == {"Linguistic", "Environmental", "Infrastructure"}
    short = report.printed_tables(rows.drop("region_correct", "multi_cue"))
    assert "region_by_model" not in short and "multicue" not in short


def test_provider_delta(spark):
    rows = spark.createDataFrame([("x1", True), ("x1", False), ("x2", True)], "model string, correct boolean")
    models = model_frame(spark, [("k1", "x1", "p", 0, 0.1, 0.0), ("k2", "x2", "p", 1, 0.1, 0.0)])
    found = metrics.provider_delta(rows, models).select("model", "delta").collect()
    assert [tuple(r) for r in found] == [("x1", None), ("x2", 0.5)]


def test_model_id():
    assert model_id("gpt-4omini") == "gpt-4o-mini"
    with pytest.raises(ValueError):
        model_id("other")


def test_metric_scan_is_narrow(spark, tmp_path):
    path = str(tmp_path / "results")
    spark.range(10).select(
        F.lit("m").alias("model"), (F.col("id") % 2 == 0).alias("correct"), F.lit("long text").alias("raw_response")
    ).write.parquet(path)
    plan = metrics.accuracy_by_model(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "raw_response" not in plan
