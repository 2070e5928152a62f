"""Mixing of a corpus with a rare domain: the query and the stage reach its target."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wherescore.llm import mixing, queries
from wherescore.llm.common import documents, repeated

TOKENS = {"de": 10, "en": 500, "es": 240, "fr": 250}  # documents; de has 1 % of the tokens against a target of 20 %


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(3)
    word = lambda lang: "".join(draw.choice("abcdefghij") for _ in range(2)) + lang
    langs = [lang for lang, n in TOKENS.items() for _ in range(n)]
    rows = [(i, " ".join(word(lang) if draw.random() < 0.8 else "common" for _ in range(50)), lang) for i, lang in enumerate(langs)]
    path = str(tmp_path_factory.mktemp("rare"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{path}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{path}/labels.parquet")
    return path


def test_query_reaches_the_target_of_a_rare_domain(spark, folder):
    found = queries.op8_mix(spark, folder).collect()
    total = sum(r.tokens for r in found)
    for d, share in mixing.TARGETS.items():
        assert sum(r.rate * r.tokens * r[f"p_{d}"] for r in found) == pytest.approx(share * total, rel=0.01)
    assert max(r.rate for r in found) > 15


def test_stage_reaches_the_target_of_a_rare_domain(spark, folder):
    mixed = corpus_pipeline.mix(spark, documents(spark, folder), folder)
    counts = {r.lang: r["count"] for r in mixed.groupBy("lang").count().collect()}
    for d, share in mixing.TARGETS.items():
        assert counts[d] / sum(counts.values()) == pytest.approx(share, rel=0.05)
    assert mixed.select("doc_id").distinct().count() == sum(TOKENS.values())


def test_domain_without_documents_has_no_target(spark, folder):
    docs = documents(spark, folder).where("lang != 'de'")
    labels = docs.select("doc_id", F.col("lang").alias("domain"))
    for grow in (False, True):
        found = mixing.rates(docs, labels, mixing.TARGETS, grow=grow).collect()
        reached = [sum(r.rate * r.tokens * r[f"p_{k}"] for r in found) for k in range(4)]
        assert max(r.rate for r in found) < 3
        assert [x / sum(reached) for x in reached[1:]] == pytest.approx([0.5625, 0.1875, 0.25], rel=0.01)

def test_a_reachable_target_is_reached(spark):
    """Posteriors that overlap much: plain steps by the domains' totals are slow there."""
    rows = spark.createDataFrame(
        [(k, 0, k, 1, 100, p, 1 - p) for k, p in enumerate([0.6] * 50 + [0.4] * 50)],
        "_row_id long, _row_hash long, doc_id long, copies long, tokens long, p_0 double, p_1 double",
    )
    real = mixing.memberships
    try:
        mixing.memberships = lambda *a: rows
        docs = spark.createDataFrame([(k, "a b") for k in range(100)], "doc_id long, text string")
        labels = docs.select("doc_id", F.when(F.col("doc_id") < 50, "x").otherwise("y").alias("domain"))
        for targets, least in (({"x": 0.55, "y": 0.45}, 0.0), ({"x": 0.6, "y": 0.4}, 0.0), ({"x": 0.55, "y": 0.45}, 0.3)):
            found = mixing.rates(docs, labels, targets, least=least).collect()
            assert sum(r.rate * 100 * r.p_0 for r in found) == pytest.approx(10_000 * targets["x"], abs=1)
            assert sum(r.rate * 100 for r in found) == pytest.approx(10_000, abs=1) and min(r.rate for r in found) >= least
        with pytest.warns(UserWarning, match="gap"):
            assert all(r.rate >= 0 for r in mixing.rates(docs, labels, {"x": 0.7, "y": 0.3}).collect())
    finally:
        mixing.memberships = real


def test_solve():
    assert mixing.solve([[0.0, 2.0], [2.0, 0.0]], [4.0, 6.0]) == [3.0, 2.0]
    assert mixing.solve([[4.0, 0.0], [0.0, 0.0]], [8.0, 5.0]) == [2.0, 0.0]


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_repeated(spark, n):
    found = repeated(spark.createDataFrame([(n, "x")], "n long, t string"), "n", "k")
    assert sorted(r.k for r in found.collect()) == list(range(n))
