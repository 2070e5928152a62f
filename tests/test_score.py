import pytest
from pyspark.sql import functions as F

from wherescore.operators import score
from wherescore.operators.joins import spread_join
from wherescore.schemas import RESULT_COLUMNS


@pytest.fixture(scope="module")
def annotations(spark):
    return spark.createDataFrame(
        [(0, "1", "East Asia", False), (1, "2", "South Asia", True), (2, "1", "Western Europe", True), (3, "3", None, False),
         (4, None, "Nowhere", True)],
        "ord bigint, id string, region string, multi_cue boolean",
    )


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [("1", "COUNTRY: Japan", "Japan"), ("2", "COUNTRY: india", "India"), ("2", None, "India"), ("3", "x", "Peru"),
         ("9", "COUNTRY: Peru", "Peru"), (None, "COUNTRY: Peru", "Peru")],
        "id string, raw_response string, true_country string",
    )


def test_last_annotation_wins_and_no_row_is_multiplied(rows, annotations):
    found = score.attach_region(rows, annotations)
    assert found.count() == rows.count()
    assert {(r.id, r.true_region) for r in found.collect()} == {
        ("1", "Western Europe"), ("2", "South Asia"), ("3", ""), ("9", ""), (None, "")
    }


def test_tagging_is_by_id(rows, annotations):
    found = score.tag_multicue(rows.withColumn("multi_cue", F.lit(None).cast("boolean")), annotations)
    assert found.count() == rows.count()
    assert {(r.id, r.multi_cue) for r in found.collect()} == {
        ("1", True), ("2", True), ("3", False), ("9", False), (None, False)
    }
    text_flags = annotations.withColumn("multi_cue", F.when(F.col("multi_cue"), "Yes").otherwise("no"))
    assert score.tag_multicue(rows, text_flags).where("multi_cue").count() == 3
    assert score.single_cue_only(found).count() == 3
    assert score.single_cue_only(rows) is rows


def test_score(rows, annotations):
    found = score.score_responses(rows.withColumn("model", F.lit("m")), annotations)
    assert found.columns == RESULT_COLUMNS
    by_text = {(r.id, r.raw_response): r for r in found.collect()}
    assert len(by_text) == 6
    assert by_text["1", "COUNTRY: Japan"].correct and not by_text["1", "COUNTRY: Japan"].region_correct
    assert by_text["2", "COUNTRY: india"].region_correct
    assert by_text["2", None].predicted_country == "PARSE_ERROR" and not by_text["2", None].correct


def test_fallback_region_only_if_absent(rows):
    assert {r.true_region for r in score.fallback_region(rows).collect()} == {"East Asia", "South Asia", "South America"}
    given = rows.withColumn("true_region", F.lit("x"))
    assert score.fallback_region(given) is given


def test_raw_response_is_required(rows):
    with pytest.raises(ValueError):
        score.score_responses(rows.drop("raw_response"))


def test_hot_key_is_split(spark):
    """A key with a third of all rows is split over tasks although the other side is aggregated."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100kb",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100kb",
    }
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        facts = spark.range(0, 400_000, 1, 8).selectExpr(
            "case when id % 3 = 0 then '7' else cast(id % 50000 as string) end as id", "id as x"
        )
        dim = spark.range(100_000).selectExpr("cast(id % 50000 as string) as id", "id as o")
        last = dim.groupBy("id").agg(F.max("o").alias("o"))
        joined = spread_join(facts, last, ["id"], "left").groupBy().agg(F.count("o"), F.max("x"))
        assert joined.collect()[0][0] == 400_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        anti = spread_join(facts, last.where("id = '7'"), ["id"], "left_anti")
        assert anti.count() == facts.where("id <> '7'").count()
    finally:
        for key in conf:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
