import csv

import pytest
from pyspark.sql import functions as F

from wherescore.operators.lists import parse_image_list, parse_image_list_ids, with_block
from wherescore.operators.score import score_responses
from wherescore.plans import workflows
from wherescore.schemas import ANNOTATION_COLUMNS, RESULT_COLUMNS, RESULTS
from wherescore.sources import tables

LIST = "Japan\nLinguistic\n12\nUK\n34\nMulti-Cue\n56 I/E\n"


def write_csv(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.DictWriter(f, fieldnames=list(rows[0]))
        writer.writeheader()
        writer.writerows(rows)


def result(**changes):
    row = dict.fromkeys(RESULT_COLUMNS, "") | {"id": "457715058637396", "true_country": "Japan", "model": "m"}
    return row | {"correct": "True", "region_correct": "False", "raw_response": "COUNTRY: Japan"} | changes


def test_results_of_several_files(spark, tmp_path):
    nasty = 'He said "x, y".\n\nCOUNTRY: Japan \n'
    write_csv(tmp_path / "results_a.csv", [result(raw_response=nasty), result(id="007", correct="False")])
    old = {k: v for k, v in result(model="n", correct="1").items() if k != "region_correct"}
    write_csv(tmp_path / "results_b.csv", [dict(reversed(old.items()))])
    write_csv(tmp_path / "other.csv", [result()])
    found = tables.load_results(spark, str(tmp_path))
    assert set(found.columns) == set(RESULT_COLUMNS)
    rows = {(r.id, r.model): r for r in found.collect()}
    assert len(rows) == 3
    assert rows["457715058637396", "m"].raw_response == nasty and rows["457715058637396", "m"].correct is True
    assert rows["007", "m"].correct is False and rows["007", "m"].region_correct is False
    assert rows["457715058637396", "n"].correct is True and rows["457715058637396", "n"].region_correct is None


def test_no_results(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.load_results(spark, str(tmp_path))


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_append_and_read_again(spark, tmp_path, fmt):
    path = str(tmp_path / "results_m.csv")
    assert tables.read_done(spark, path, fmt).isEmpty()
    text = ' a "b", \r\n c\n'
    row = spark.createDataFrame([("1", "linguistic", "Japan", "Japan", True, "East Asia", True, "m", text)], RESULTS)
    tables.append_results(row, path, fmt)
    tables.append_results(row.withColumn("id", F.lit("2")), path, fmt)
    done = tables.read_done(spark, path, fmt)
    assert sorted(r.id for r in done.collect()) == ["1", "2"]
    where = str(tmp_path) if fmt == "csv" else path
    assert {r.raw_response for r in tables.load_results(spark, where, fmt).collect()} == {text}


@pytest.mark.parametrize("with_annotations", [True, False])
def test_rescore_in_place(spark, tmp_path, with_annotations):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([("1", "m", "COUNTRY: uk", "United Kingdom")], "id string, model string, raw_response string, true_country string")
    rows.write.parquet(path)
    annotations = spark.createDataFrame([("1", "Nowhere", 0)], "id string, region string, ord bigint") if with_annotations else None
    workflows.rescore(spark, path, path, annotations)
    found = tables.load_results(spark, path, "parquet").first()
    assert found.predicted_country == "United Kingdom" and found.correct
    assert (found.true_region, found.region_correct) == (("Nowhere", False) if with_annotations else ("Western Europe", True))
    before = tables.load_results(spark, path, "parquet")  # goes on reading what it has begun with
    workflows.rescore(spark, path, path, annotations)
    tables.append_results(before.withColumn("id", F.lit("2")), path)
    assert before.count() == 1 and sorted(r.id for r in tables.load_results(spark, path, "parquet").collect()) == ["1", "2"]
    assert sorted(r.id for r in tables.read_done(spark, path).collect()) == ["1", "2"]


def test_rescore_needs_raw_response(spark, tmp_path):
    spark.createDataFrame([("1",)], "id string").write.parquet(str(tmp_path / "r"))
    with pytest.raises(ValueError):
        workflows.rescore(spark, str(tmp_path / "r"), str(tmp_path / "s"))


def test_annotations_round_trip_keeps_order(spark, tmp_path):
    path = tmp_path / "annotations.csv"
    rows = [dict(zip(ANNOTATION_COLUMNS, (str(10**14 + i), f"p{i}", "Japan", "linguistic", ("True", "no")[i % 2], "", "East Asia"))) for i in range(50)]
    write_csv(path, rows)
    table = tables.read_annotations(spark, str(path))
    assert [r.id for r in table.orderBy("ord").collect()] == [r["id"] for r in rows]
    assert table.where("multi_cue").count() == 25
    out = str(tmp_path / "copy.csv")
    assert tables.write_annotations(table, out) == 50
    tables.append_annotations(spark.createDataFrame([("9", "p9")], "id string, filepath string"), out)
    assert tables.read_annotations(spark, out).count() == 51
    new = tables.new_annotations(spark.createDataFrame([("9", "p9")], "id string, filepath string")).first()
    assert tuple(new) == ("9", "p9", "", "", False, "", "")


def test_coords(spark, tmp_path):
    path = tmp_path / "coords.csv"
    path.write_text("lat,lon,country,region,note\n1.5,2,Japan,East Asia,x\n-3,4e0,Peru,South America,\n")
    found = tables.read_coords(spark, str(path)).orderBy("ord").collect()
    assert [(r.lat, r.lon, r.country, r.note) for r in found] == [(1.5, 2.0, "Japan", "x"), (-3.0, 4.0, "Peru", None)]
    path.write_text("lat,lon,country\n1,2,Japan\n")
    with pytest.raises(ValueError, match="region"):
        tables.read_coords(spark, str(path))


def test_id_list(spark, tmp_path):
    path = tmp_path / "ids.txt"
    path.write_text(" 1\n\n2 \r\n\t\n3")
    assert sorted(r.id for r in tables.read_id_list(spark, str(path)).collect()) == ["1", "2", "3"]


def test_list_example(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text(LIST)
    lines = tables.read_lines(spark, str(path))
    rows = {r.id: r for r in parse_image_list(lines).collect()}
    assert set(rows) == {"12", "56"}
    assert rows["12"][3:] == ("data/images/Japan/12.jpg", "Japan", "linguistic", False, "", "East Asia")
    assert rows["56"][3:] == ("data/images/United Kingdom/56.jpg", "United Kingdom", "infrastructure", True, "I/E", "Western Europe")
    assert {(r.id, r.country) for r in parse_image_list_ids(lines).collect()} == {
        ("12", "Japan"), ("34", "United Kingdom"), ("56", "United Kingdom")
    }


def restate(text):
    """The list grammar restated line by line."""
    headers = {"Linguistic", "Environmental", "Infrastructural", "Multi-Cue"}
    country = cue = None
    full, ids = [], []
    for line in text.splitlines():
        line = line.strip()
        if line in headers:
            cue = line
        elif line and not any(c.isdigit() for c in line):
            country, cue = line, None
        elif line and country:
            ids.append((line.split()[0], country))
            if cue:
                full.append((line.split()[0], country, cue == "Multi-Cue", " ".join(line.split()[1:]) if cue == "Multi-Cue" else ""))
    return full, ids


@pytest.mark.parametrize("split_bytes", [64, 1000, 1 << 27])
def test_list_split_over_tasks(spark, tmp_path, split_bytes):
    parts = ["99 before any header"]
    for i in range(400):
        parts.append(["Peru", "Linguistic", "", "Multi-Cue", "New Zealand", f"{i} L / E", f"  {i}\t I ", str(i), "Environmental "][(i * i + i // 7) % 9])
    parts[50] = "77\x0b78\x85Multi-Cue 79"
    text = "\n".join(parts)
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text(text, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        lines = tables.read_lines(spark, str(tmp_path))
        full = parse_image_list(lines, renames={}, regions={}).orderBy("file", "pos").collect()
        ids = parse_image_list_ids(lines, renames={}).orderBy("file", "pos").collect()
        if split_bytes == 64:
            assert lines.select("file", "block").distinct().count() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected_full, expected_ids = restate(text)
    assert [(r.id, r.country, r.multi_cue, r.cue_notes) for r in full] == expected_full * 2
    assert [(r.id, r.country) for r in ids] == expected_ids * 2


@pytest.mark.parametrize("span", [1, 5, 1 << 20])
def test_list_table_blocks(spark, span):
    text = LIST * 3
    lines = spark.createDataFrame([("f", i, s) for i, s in enumerate(text.splitlines())], "file string, pos bigint, line string")
    found = parse_image_list(with_block(lines, span), renames={}).orderBy("pos").collect()
    assert [(r.id, r.country, r.multi_cue, r.cue_notes) for r in found] == restate(text)[0]


def test_build_annotations(spark, tmp_path):
    (tmp_path / "list.txt").write_text(LIST)
    out = str(tmp_path / "annotations.csv")
    assert workflows.build_annotations(spark, str(tmp_path / "list.txt"), out) == 2
    assert tables.read_annotations(spark, out).where("multi_cue").first().id == "56"


def test_image_files(spark, tmp_path):
    folder = tmp_path / "data" / "images" / "United Kingdom"
    folder.mkdir(parents=True)
    (folder / "1.jpg").write_bytes(b"\xff\xd8abc")
    images = tables.read_images(spark, str(tmp_path / "data"))
    assert [(r.filepath, bytes(r.content)) for r in images.collect()] == [("data/images/United Kingdom/1.jpg", b"\xff\xd8abc")]


def test_scored_columns_survive(spark):
    rows = spark.createDataFrame([("1", "COUNTRY: Peru", "Peru", 5)], "id string, raw_response string, true_country string, extra int")
    assert "extra" in score_responses(rows).columns
