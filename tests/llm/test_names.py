"""Columns with the names that operators use inside: every stage and every operator that hands rows on leaves them as they are."""

import pytest

import corpus_pipeline
from wherescore.llm import decontaminate, lines, mixing, sharding, simhash, toxicity

NAMES = (
    "_row", "_row_id", "_row_hash", "_key_hash", "_rate", "_n", "_again", "_kept", "_places", "_times", "_words", "_at", "_size",
    "_known", "_block", "_in_block", "times", "nth", "rate", "word", "copies", "tokens", "label", "fp", "cell", "hash", "_hash",
    "_cell", "_d", "item", "seed", "words", "start", "matched", "band", "_text", "_id", "keep", "line", "f", "c", "count", "n",
)
PASSAGE = "zeta quorum brindle foxtrot amber lattice quiver mossy tundra velvet harbor signal copper meadow drift"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("names"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in NAMES)
    texts = [PASSAGE, "some plain words of a text about the weather in spring", None, "", "plain words\nand a line", "a b c d e f g h"]
    rows = [(k % 7 if k else None, texts[k % 6], "en", "s", 1, *range(len(NAMES))) for k in range(20)]
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, int(k == 2)) for k in range(1, 7)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("number", range(5))
def test_stages(spark, tables, number):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = corpus_pipeline.STAGES[number][1](spark, docs, tables)
    extra = [n for n in docs.columns if n in rows.columns]
    assert extra == docs.columns
    found = rows.select(*[f"`{n}`" for n in docs.columns]).collect()
    assert found and set(found) <= set(docs.collect())


def test_operators(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    benchmark, given = spark.read.parquet(f"{tables}/benchmark.parquet"), set(docs.collect())
    labels = docs.selectExpr("doc_id", "lang as domain")
    for found in (
        simhash.keep_one(docs),
        decontaminate.remove_contaminated(docs, benchmark),
        mixing.resample(docs, mixing.rates(docs, labels, {"en": 1.0})),
        toxicity.keep_clean(docs, toxicity.Model(-1.0)),
        sharding.assign_shards(docs, 100, carry=docs.columns).select(*[f"`{n}`" for n in docs.columns]),
    ):
        assert found.columns == docs.columns and set(found.collect()) <= given
    assert lines.drop_lines(docs).columns == docs.columns and lines.drop_lines(docs).count() == 20
