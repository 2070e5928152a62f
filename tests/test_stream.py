from wherescore.plans import queries
from wherescore.streaming import live

SCHEMA = "id string, cue_type string, true_country string, model string, raw_response string"


def test_new_files_are_scored_once(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    first = [("1", "l", "Japan", "m", "COUNTRY: Japan"), ("2", "l", "Japan", "m", "COUNTRY: China")]
    regions = spark.createDataFrame(
        [("1", "Europe", 0), ("1", "East Asia", 3), ("2", "East Asia", 1), (None, "Europe", 2)], "id string, region string, ord int"
    )
    table, sums = str(tmp_path / "accuracy"), str(tmp_path / "check2")

    def run():
        responses = live.read_responses(spark, source, spark.createDataFrame([], SCHEMA).schema, max_files=1)
        live.write_scores(live.score_stream(responses, regions), out, check).awaitTermination()
        again = live.read_responses(spark, source, spark.createDataFrame([], SCHEMA).schema)
        live.write_accuracy(live.live_accuracy(live.score_stream(again)), table, sums).awaitTermination()
        return (
            sorted((r.id, r.correct, r.region_correct) for r in spark.read.parquet(out).collect()),
            [(r.correct, r.processed, r.accuracy) for r in live.read_accuracy(spark, table).collect()],
        )

    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(source)
    expected = [("1", True, True), ("2", False, True)]
    assert run() == (expected, [(1, 2, 0.5)])
    assert run() == (expected, [(1, 2, 0.5)])
    spark.createDataFrame([("3", "l", "Peru", "m", None)], SCHEMA).write.mode("append").parquet(source)
    assert run() == (expected + [("3", False, False)], [(1, 3, 1 / 3)])


def test_state_has_few_partitions(spark, tmp_path):
    """A micro-batch costs a task for each partition of the state, however many the session has."""
    source, check = str(tmp_path / "in"), tmp_path / "check"
    schema = "model string, correct boolean"
    spark.createDataFrame([(f"m{k % 20}", k % 2 == 0) for k in range(100)], schema).write.parquet(source)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        stream = live.read_responses(spark, source, spark.createDataFrame([], schema).schema)
        live.write_accuracy(live.live_accuracy(stream), str(tmp_path / "out"), str(check)).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "30"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert sorted(r.processed for r in live.read_accuracy(spark, str(tmp_path / "out")).collect()) == [5] * 20
    assert len([p for p in (check / "state" / "0").iterdir() if p.name.isdigit()]) == live.STATE_PARTITIONS


def test_regions_are_aggregated_once(spark, tmp_path):
    """Micro-batches join a table of regions that is there, and do not make it anew."""
    source = str(tmp_path / "in")
    spark.createDataFrame([("1", "l", "Japan", "m", "COUNTRY: Japan")], SCHEMA).write.parquet(source)
    regions = spark.createDataFrame([("1", "Europe", 0), ("1", "East Asia", 3)], "id string, region string, ord int")
    scored = live.score_stream(live.read_responses(spark, source, spark.createDataFrame([], SCHEMA).schema), regions)
    assert "Aggregate" not in scored._jdf.queryExecution().analyzed().toString()


def test_files_of_a_stream(spark, monkeypatch):
    """The number of micro-batches does not grow with the partitions of the job that writes the responses."""
    rows = spark.range(200).selectExpr("id as ord", "'x' as true_region").repartition(60)
    monkeypatch.setattr(queries.fx, "responses", lambda *a: rows)
    path, schema = queries._saved_responses(spark, "")
    saved = spark.read.schema(schema).parquet(path)
    assert saved.count() == 200 and 1 < len(saved.inputFiles()) <= 24
