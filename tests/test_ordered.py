import random

import pytest
from pyspark.sql import functions as F

from wherescore.operators import planning, prefix
from wherescore.operators.ordered import block_of, running
from wherescore.sources import tables


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_running_sum_and_max(spark, span):
    rng = random.Random(span)
    rows = [(g, p, rng.choice([None, rng.randrange(9)])) for g in "ab" for p in sorted(rng.sample(range(200), 60))]
    table = spark.createDataFrame(rows, "g string, p bigint, v bigint").withColumn("b", block_of("p", span))
    out = running(table.repartition(7), ["g"], "b", ["p"], {"total": ("sum", "v"), "top": ("max", "v")})
    found = {(r.g, r.p): (r.total, r.top) for r in out.collect()}
    expected = {}
    for g in "ab":
        total, top = 0, None
        for _, p, v in (r for r in rows if r[0] == g):
            if v is not None:
                total, top = total + v, v if top is None else max(top, v)
            expected[g, p] = (total, top)
    assert found == expected


@pytest.mark.parametrize(("parts", "apart"), [(1, 1), (7, 1), (7, 10**15 + 7), (40, 3)])
def test_running_accuracy(spark, parts, apart):
    rng = random.Random(3)
    rows = [(f"m{i % 2}", i * apart, rng.random() < 0.5) for i in range(100)]
    table = spark.createDataFrame(rows, "model string, ord bigint, correct boolean").repartition(5)
    found = {(r.model, r.ord): (r.processed, r.correct) for r in planning.running_accuracy(table, partitions=parts).collect()}
    for m in ("m0", "m1"):
        hits = 0
        for n, (_, i, c) in enumerate([r for r in rows if r[0] == m], 1):
            hits += c
            assert found[m, i] == (n, hits)


def test_first_rows(spark):
    table = spark.range(0, 300, 3).withColumnRenamed("id", "ord").repartition(6)
    for n in (0, 1, 37, 100, 500):
        found = planning.first_rows(table, n).collect()
        assert sorted(r.ord for r in found) == list(range(0, 300, 3))[:n]
    named = table.select(F.format_string("file/%05d", "ord").alias("ord")).unionByName(spark.createDataFrame([(None,)], "ord string"))
    assert sorted(r.ord for r in planning.first_rows(named, 3).collect()) == ["file/00000", "file/00003", "file/00006"]
    assert planning.first_rows(named, 500).count() == 100


def test_long_pilot_from_a_csv_file(spark, tmp_path):
    path = tmp_path / "annotations.csv"
    path.write_text("id,filepath,country\n" + "".join(f"{i},p{i},Japan\n" for i in range(130_000)))
    rows = tables.read_annotations(spark, str(path))
    assert {int(r.id) for r in planning.pending_work(rows, None, pilot=110_000).select("id").collect()} == set(range(110_000))


def test_pending_work(spark):
    work = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b"), (3, "c"), (4, "d")], "ord bigint, id string")
    done = spark.createDataFrame([("a",), ("a",), (None,)], "id string")

    def left(*args, **kwargs):
        return sorted(r.ord for r in planning.pending_work(work, *args, **kwargs).collect())

    assert left(done) == [1, 2, 3, 4]
    assert left(None) == [0, 1, 2, 3, 4]
    # The pilot counts finished rows too.
    assert left(done, pilot=2) == [1]
    assert left(done, pilot=99) == [1, 2, 3, 4]


def test_numeric_done_ids(spark):
    work = spark.createDataFrame([(0, "7"), (1, "8")], "ord bigint, id string")
    done = spark.createDataFrame([(7,)], "id bigint")
    assert [r.id for r in planning.pending_work(work, done).collect()] == ["8"]


def test_summary_and_cost(spark):
    results = spark.createDataFrame([(True,), (False,), (None,), (True,)], "correct boolean")
    assert planning.run_summary(results).first()[:] == (2, 4, 50.0)
    assert planning.run_summary(results.limit(0)).first()[:] == (0, 0, None)
    models = spark.createDataFrame([("m", 0.05), ("n", None)], "model_key string, cost_per_item double")
    cost = {r.model_key: (r.n_items, r.estimated_cost) for r in planning.cost_estimate(results, models).collect()}
    assert cost == {"m": (4, 0.2), "n": (4, 0.08)}
    pilot = {r.model_key: r.n_items for r in planning.cost_estimate(results, models, pilot=10).collect()}
    assert pilot == {"m": 10, "n": 10}
    assert planning.cost_estimate(results.select(F.lit(1)), models).count() == 2


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_running_sums(spark, parts):
    """Groups that fill several tasks, lie within one, or meet at an edge; null keys, null values, negative values."""
    rng = random.Random(parts)
    rows = [(rng.choice(["a"] * 8 + ["b", None, "c"]), k, rng.choice([None, -3, 5, 2])) for k in range(400)]
    table = spark.createDataFrame(rows, "g string, p bigint, v bigint").repartition(5)
    found = {r.p: (r.g, r.total, r.n) for r in prefix.running_sums(table.withColumn("one", F.lit(1)), ["g"], ["p"], {"total": "v", "n": "one"}, parts).collect()}
    so_far = {}
    for g, p, v in rows:
        total, n = so_far.get(g, (0, 0))
        so_far[g] = (total + (v or 0), n + 1)
        assert found[p] == (g, *so_far[g])
    numbers = prefix.numbered(table, [], [F.col("p").desc()], "k").collect()
    assert all(r.k == 399 - r.p for r in numbers) and len(numbers) == 400
    assert prefix.numbered(table.limit(0), ["g"], ["p"], "k").collect() == []


def test_ties_within_and_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [("m", k // 4, k % 3 == 0) for k in range(60)] + [("n", 5, None)] * 7
        found = planning.running_accuracy(spark.createDataFrame(rows, "model string, ord int, correct boolean").repartition(4), partitions=3)
        shown = {(r.model, r.ord): (r.processed, r.correct) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    hits = [sum(c for _, o, c in rows[:60] if o <= at) for at in range(15)]
    assert shown == {("m", at): (4 * at + 4, hits[at]) for at in range(15)} | {("n", 5): (7, 0)}
