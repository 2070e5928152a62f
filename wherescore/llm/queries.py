"""Registered queries of the training-data operators: each applies one of them to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from wherescore.llm import decontaminate, exact, html, lines, manifest, middle, mixing, ngrams, pii, sharding, simhash, suffix, toxicity
from wherescore.llm.common import documents, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

#: Bytes of text in a shard of the registered query; of the order of a file, small enough that the test tables have many.
SHARD_BYTES = 1 << 20


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


@query
def op1_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), SHARD_BYTES)


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "n_overlaps")


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in pii.BASE],
        F.sha2(pii.places(pii.BASE).cast("binary"), 256).alias("base_sha256"),
        pii.places(pii.BASE + pii.MORE).alias("spans"),
    )


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def domain_labels(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """Domain of the rows that the table of labels covers: their language."""
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels, "doc_id", "left_semi")


@query
def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = mixing.rates(docs, domain_labels(spark, sf_dir, docs), mixing.TARGETS)
    posteriors = [F.bround(f"p_{k}", 6).alias(f"p_{d}") for k, d in enumerate(sorted(mixing.TARGETS))]
    return found.select("doc_id", "tokens", *posteriors, F.bround("rate", 6).alias("rate"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_components(documents(spark, sf_dir)).drop("_row_hash")


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = middle.fill_in_middle(documents(spark, sf_dir))
    digests = [F.sha2(c.cast("binary"), 256) for c in (F.col("output"), middle.restored())]
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digests[0].alias("output_sha256"), digests[1].alias("restored_sha256")
    )


@query
def op12_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score_documents(documents(spark, sf_dir)).rows


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    tampered = F.when(drawn, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest.manifest(documents(spark, sf_dir), tampered=tampered)
    return found.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof().alias("proof_sha256"), manifest.folded("seen").alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def sql() -> dict[str, str]:
    from wherescore.llm import oracles

    return oracles.sql()
