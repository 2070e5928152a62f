import base64
import uuid

import pytest
from pyspark.sql import functions as F

from wherescore.operators.respond import batch_responses, image_payload
from wherescore.plans import workflows
from wherescore.sources import tables

ANNOTATIONS = "ord bigint, id string, filepath string, country string, cue_type string, multi_cue boolean, cue_notes string, region string"


@pytest.fixture(scope="module")
def annotations(spark):
    return spark.createDataFrame(
        [(i, str(i), f"data/images/Japan/{i}.jpg", "Japan", "linguistic", False, "", "East Asia") for i in range(6)], ANNOTATIONS
    )


@pytest.fixture(scope="module")
def images(spark):
    return spark.createDataFrame([(f"data/images/Japan/{i}.jpg", bytes([i]) * 100) for i in range(5)], "filepath string, content binary")


def test_payload(annotations, images):
    rows = {r.id: r for r in image_payload(annotations, images, "hi", with_url=True).collect()}
    assert rows["2"].image_b64 == base64.b64encode(b"\x02" * 100).decode()
    assert rows["2"].data_url == "data:image/jpeg;base64," + rows["2"].image_b64 and rows["2"].prompt == "hi"
    assert rows["2"].raw_response is None
    assert rows["5"].image_b64 is None and rows["5"].raw_response == "IMAGE_NOT_FOUND"


@pytest.mark.parametrize("concurrency", [1, 4])
def test_retries(annotations, images, concurrency):
    seen = {}

    def answer(row):
        seen[row["id"]] = seen.get(row["id"], 0) + 1
        if row["id"] == "1" or (row["id"] == "3" and seen["3"] < 3):
            raise OSError("busy")
        return f"{row['id']}:{len(row['image_b64'])}:{seen[row['id']]}"

    out = batch_responses(image_payload(annotations, images), answer, backoff_s=0, concurrency=concurrency)
    assert "image_b64" not in out.columns
    rows = {r.id: (r.status, r.raw_response) for r in out.collect()}
    assert rows["1"] == ("failed", None) and rows["3"] == ("ok", "3:136:3")
    assert rows["5"] == ("missing", "IMAGE_NOT_FOUND") and rows["0"] == ("ok", "0:136:1")


def test_evaluate_resumes(spark, annotations, images, tmp_path):
    path = str(tmp_path / "results")

    def first(row):
        if row["id"] == "1":
            raise OSError("down")
        return "COUNTRY: Japan" if row["id"] != "2" else "COUNTRY: China"

    def second(row):
        return "COUNTRY: Peru"

    workflows.evaluate(annotations, images, first, "gpt-4omini", path, pilot=3, backoff_s=0)
    assert sorted(r.id for r in tables.read_done(spark, path).collect()) == ["0", "2"]
    workflows.evaluate(annotations, images, second, "gpt-4omini", path, backoff_s=0, commit_rows=2)
    rows = {r.id: r for r in tables.load_results(spark, path, "parquet").collect()}
    assert set(rows) == set("012345")
    assert {i: r.predicted_country for i, r in rows.items()} == {
        "0": "Japan", "1": "Peru", "2": "China", "3": "Peru", "4": "Peru", "5": "PARSE_ERROR"
    }
    assert rows["2"].region_correct and not rows["2"].correct
    assert rows["5"].raw_response == "IMAGE_NOT_FOUND" and {r.model for r in rows.values()} == {"gpt-4o-mini"}
    workflows.evaluate(annotations, images, {"openai": second}, "gpt-4omini", path)
    assert tables.load_results(spark, path, "parquet").count() == 6
    with pytest.raises(ValueError):
        workflows.evaluate(annotations, images, second, "unknown", path)


def test_killed_run_loses_one_commit(spark, annotations, images, tmp_path):
    path, paid = str(tmp_path / "results"), tmp_path / "paid"
    paid.mkdir()
    many = spark.range(60).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), F.format_string("f%d", "id").alias("filepath"), *[F.lit(x).alias(n) for n, x in (("country", "Japan"), ("cue_type", "linguistic"), ("multi_cue", False), ("cue_notes", ""), ("region", "East Asia"))])
    pictures = many.select("filepath", F.encode("id", "utf-8").alias("content"))

    def answer(row, dies):
        (paid / f"{row['id']}-{uuid.uuid4().hex}").touch()
        if dies and len(list(paid.iterdir())) > 30:
            raise SystemExit
        return "COUNTRY: Japan"

    with pytest.raises(Exception):
        workflows.evaluate(many, pictures, lambda row: answer(row, True), "gpt-4omini", path, commit_rows=10, backoff_s=0)
    asked, done = [p.name.split("-")[0] for p in paid.iterdir()], {r.id for r in tables.read_done(spark, path).collect()}
    assert 20 <= len(done) < 60 and len(set(asked) - done) <= 10
    workflows.evaluate(many, pictures, lambda row: answer(row, False), "gpt-4omini", path, commit_rows=10, backoff_s=0)
    again = [p.name.split("-")[0] for p in paid.iterdir()]
    assert all(again.count(i) == 1 for i in done) and len(set(again)) == 60
    assert sorted(r.id for r in tables.load_results(spark, path, "parquet").collect()) == sorted(map(str, range(60)))


def test_analyse(spark, annotations, tmp_path):
    results = spark.createDataFrame([("0", "m", "linguistic", "Japan", True, True)], "id string, model string, cue_type string, true_country string, correct boolean, region_correct boolean")
    found = workflows.analyse(results, annotations)
    assert found["overall"].first().accuracy == "100.0%" and found["multicue"].first().subset == "single-cue"


def test_sampling_flows(spark, tmp_path):
    meta = spark.createDataFrame([("1", "u1", True), ("2", "u2", False), ("3", "u3", None)], "id string, thumb_2048_url string, is_pano boolean")
    present = spark.createDataFrame([("data/images/3.jpg",), ("data/images/Japan/3.jpg",)], "filepath string")
    (tmp_path / "ids.txt").write_text("1\n2\n2\n3\n")
    out = str(tmp_path / "annotations.csv")
    assert [r.id for r in workflows.sample_ids(spark, str(tmp_path / "ids.txt"), meta, present, out).collect()] == ["2"]
    assert [r.filepath for r in tables.read_annotations(spark, out).collect()] == ["data/images/2.jpg"]
    (tmp_path / "list.txt").write_text("Japan\n1\n2\n3\nPeru\n3\n")
    found = workflows.sample_list(spark, str(tmp_path / "list.txt"), meta, present).collect()
    assert {(r.id, r.country) for r in found} == {("1", "Japan"), ("2", "Japan"), ("3", "Peru")}
    (tmp_path / "coords.csv").write_text("lat,lon,country,region\n52.5,13.4,Japan,East Asia\n52.5,13.4,Japan,East Asia\n")
    features = spark.createDataFrame(
        [(i, 8801, 5374, "Point", [3500.0 + i, 2990.0], str(i)) for i in (1, 2, 3)],
        "feature_pos bigint, tile_x int, tile_y int, geom_type string, coords array<double>, id string",
    )
    chosen = workflows.sample(spark, str(tmp_path / "coords.csv"), features, meta, None, out).collect()
    assert sorted(r.id for r in chosen) == ["2", "3"]
    assert {r.country for r in tables.read_annotations(spark, out).collect()} == {None, "Japan"}
