"""Commits beside a table: order of appended rows, replacement, readers at the same time, mixed headers, wanted files."""

import pytest
from pyspark.sql import functions as F

from wherescore.operators.score import attach_region, score_responses
from wherescore.plans import queries, workflows
from wherescore.sources import log, tables
from wherescore.sources.scratch import scratch_path
from wherescore.streaming import live


def annotations(spark, ids, region, parts=4):
    rows = spark.createDataFrame([(str(k), f"p{k}", "Japan", region) for k in ids], "id string, filepath string, country string, region string")
    return rows.repartition(parts)


@pytest.mark.parametrize("base", ["file", "folder"])
def test_last_appended_row_wins(spark, tmp_path, base):
    path = str(tmp_path / "annotations.csv")
    if base == "file":
        (tmp_path / "annotations.csv").write_text("id,filepath,country,cue_type,multi_cue,cue_notes,region\n" + "".join(f"{k},p{k},Japan,,no,,old\n" for k in range(10)))
    else:
        tables.append_annotations(annotations(spark, range(10), "old"), path)
    for region in ("new", "newer"):
        tables.append_annotations(annotations(spark, range(8 if region == "new" else 6), region), path)
    table = tables.read_annotations(spark, path)
    assert table.count() == 24
    assert [r.ord.commit for r in table.orderBy("ord").collect()] == [0] * 10 + [1] * 8 + [2] * 6
    answers = spark.createDataFrame([(str(k), "m", "COUNTRY: Japan", "Japan") for k in range(10)], "id string, model string, raw_response string, true_country string")
    found = {int(r.id): r.true_region for r in attach_region(answers, table).collect()}
    assert found == {k: "newer" if k < 6 else "new" if k < 8 else "old" for k in range(10)}
    assert {r.true_region for r in score_responses(answers, table).collect()} == {"newer", "new", "old"}
    assert tables.write_annotations(annotations(spark, [77], "again").select("*", *[F.lit("").alias(c) for c in ("cue_type", "cue_notes")], F.lit(False).alias("multi_cue")), str(tmp_path / "other.csv")) == 1


def test_written_anew_after_appending(spark, tmp_path):
    path = str(tmp_path / "annotations.csv")
    for ids in ([1], [2]):
        tables.append_annotations(annotations(spark, ids, "x"), path)
    (tmp_path / "list.txt").write_text("Japan\nLinguistic\n12\n")
    assert workflows.build_annotations(spark, str(tmp_path / "list.txt"), path) == 1
    assert [r.id for r in tables.read_annotations(spark, path).collect()] == ["12"]
    tables.append_annotations(annotations(spark, [3], "x"), path)
    assert [r.id for r in tables.read_annotations(spark, path).orderBy("ord").collect()] == ["12", "3"]


def test_writers_at_the_same_time(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(1).write.parquet(path)
    monkeypatch.setattr(log, "_records", lambda *a: [])
    assert [log.publish(spark.range(k, k + 1), path) for k in (5, 6)] == [1, 1]
    monkeypatch.undo()
    state = log.committed(spark, path)
    rows = log.read_commits(spark, path, state).collect()
    assert sorted(r.id for r in rows) == [5, 6] and sorted(r._commit for r in rows) == [1, 2]


def test_accuracy_after_a_new_checkpoint(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "accuracy")
    schema = "model string, correct boolean"
    for correct, files, check in ((True, 4, "a"), (False, 1, "b")):
        where = f"{source}_{check}"
        for _ in range(files):
            spark.createDataFrame([("m", correct)] * 7, schema).coalesce(1).write.mode("append").parquet(where)
        stream = live.read_responses(spark, where, spark.createDataFrame([], schema).schema, max_files=1)
        live.write_accuracy(live.live_accuracy(stream), table, str(tmp_path / check)).awaitTermination()
        found = live.read_accuracy(spark, table).collect()
        assert [(r.correct, r.processed) for r in found] == [(28, 28) if correct else (0, 7)]
    with pytest.raises(FileNotFoundError):
        live.read_accuracy(spark, str(tmp_path / "nothing"))


def test_headers_in_one_job(spark, tmp_path):
    for k in range(12):
        names = ["id", "model", "correct"] if k % 2 else ["correct", "id", 'a "b", c']
        quoted = ",".join('"' + n.replace('"', '""') + '"' for n in names)
        values = {"id": str(k), "model": "m", "correct": "True", 'a "b", c': '"x\ny"'}
        (tmp_path / f"results_{k}.csv").write_text(quoted + "\n" + ",".join(values[n] for n in names) + "\n")
    (tmp_path / "results_none.csv").write_text("")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "")
    found = tables.load_results(spark, str(tmp_path))
    assert len(jobs.getJobIdsForGroup("headers")) <= 3
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = found.collect()
    assert sorted(int(r.id) for r in rows) == list(range(12)) and all(r.correct is True for r in rows)
    assert {r['a "b", c'] for r in rows if int(r.id) % 2 == 0} == {"x\ny"}


def test_only_wanted_images_are_read(spark, tmp_path):
    folder = tmp_path / "data" / "images" / "New Zealand"
    folder.mkdir(parents=True)
    for k in range(40):
        (folder / f"{k}.jpg").write_bytes(b"%d" % k)
    wanted = [f"data/images/New Zealand/{k}.jpg" for k in (3, 7)]
    images = tables.read_images(spark, str(tmp_path / "data"), wanted=wanted)
    assert sorted((r.filepath, bytes(r.content)) for r in images.collect()) == [(wanted[0], b"3"), (wanted[1], b"7")]
    for p in folder.iterdir():
        if p.name not in ("3.jpg", "7.jpg"):
            p.chmod(0)
    scan = tables.read_images(spark, str(tmp_path / "data"), wanted=wanted)
    assert scan.rdd.getNumPartitions() <= 2


def test_appended_rows_are_dealt_out_before_they_are_sorted(spark, monkeypatch):
    """No task sorts all rows of a file: the exchange is below both aggregations, and a place does not repeat whole paths."""
    rows = spark.createDataFrame(
        [(k, str(k), f"p{k}", "Peru" if k % 9 == 0 else "Japan", "linguistic" if k % 3 == 0 else "infrastructure", False, "", "r") for k in range(90)],
        "ord long, id string, filepath string, country string, cue_type string, multi_cue boolean, cue_notes string, region string",
    )
    monkeypatch.setattr(queries.fx, "annotations", lambda *a: rows)
    found = queries.registered()["appended_annotations"](spark, "")
    assert {int(r.id): (r.region, r.commit, r.n_rows) for r in found.collect()} == {
        k: ("second", 2, 2 + (k % 9 > 0)) if k % 3 else ("first", 1, 2) if k % 9 else ("r", 0, 1) for k in range(90)
    }
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.rindex("Aggregate") < plan.index("Exchange hashpartitioning(id") and plan.count("Exchange hashpartitioning(id") == 1
    path = scratch_path(spark, "t.csv")
    for _ in range(2):
        tables.append_annotations(rows.drop("ord"), path)
    places = tables.read_annotations(spark, path).where("ord.commit = 1").select("ord.place.file").distinct().collect()
    assert places and all("/" not in r.file for r in places)


def test_csv_files_are_bounded(spark, tmp_path, monkeypatch):
    """A CSV file is read by one task, so a long partition becomes several files, whose rows stay in order."""
    monkeypatch.setitem(tables.CSV_WRITE, "maxRecordsPerFile", min(tables.CSV_WRITE["maxRecordsPerFile"], 40))
    path = str(tmp_path / "annotations.csv")
    tables.append_annotations(annotations(spark, range(200), "old", 1), path)
    assert len(list((tmp_path / "annotations.csv").glob("part-*.csv"))) == 5
    rows = tables.read_annotations(spark, path)
    kept = annotations(spark, range(200), "old", 1).collect()
    assert [r.id for r in rows.orderBy("ord").collect()] == [r.id for r in kept]
