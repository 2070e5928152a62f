"""Scores that follow the responses as they arrive."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wherescore.functions.lookups import COUNTRY_ALIASES, COUNTRY_REGIONS
from wherescore.operators.joins import spread_join
from wherescore.operators.score import add_country_score, add_prediction, add_region_score, fallback_region
from wherescore.schemas import RESULT_COLUMNS
from wherescore.sources import log
from wherescore.sources.scratch import settle

#: Partitions of the state of running accuracy, one row per model; each costs a task and files in every micro-batch.
STATE_PARTITIONS = 8


def read_responses(
    spark: SparkSession, directory: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    """Stream of response files (Parquet)."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(directory)


def score_stream(
    responses: DataFrame,
    regions_by_id: DataFrame | None = None,
    aliases: Mapping[str, str] = COUNTRY_ALIASES,
    regions: Mapping[str, str] = COUNTRY_REGIONS,
) -> DataFrame:
    """Scored rows of a response stream.

    ``regions_by_id`` (id, region) is a static table that gives the true region. Of a repeated id the last row by
    ``ord`` counts, as in ``attach_region``; without that column the largest region. One row per id is written to
    the checkpoint folder when the stream is set up; each micro-batch joins that table, on the id and its hash, so
    that a frequent id's partition can be split.
    """
    out = add_country_score(add_prediction(responses, aliases))
    if regions_by_id is None:
        out = fallback_region(out, regions)
    else:
        last = F.max_by("region", "ord") if "ord" in regions_by_id.columns else F.max("region")
        static = settle(regions_by_id.where(F.col("id").isNotNull()).groupBy("id").agg(last.alias("_region")))
        out = spread_join(out.drop("true_region"), static, ["id"], "left").withColumn(
            "true_region", F.coalesce("_region", F.lit(""))
        )
    return add_region_score(out, regions).select(*RESULT_COLUMNS)


def write_scores(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append scored rows to a Parquet folder, each input file once, then stop.

    The checkpoint holds what is done; starting again with it takes up only new files.
    """
    return (
        scored.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def live_accuracy(scored: DataFrame) -> DataFrame:
    """Accuracy per model so far; the state is one row per model."""
    hits = F.sum(F.coalesce(F.col("correct").cast("int"), F.lit(0)))
    return (
        scored.where(F.col("model").isNotNull())
        .groupBy("model")
        .agg(hits.alias("correct"), F.count("*").alias("processed"))
        .withColumn("accuracy", F.col("correct") / F.col("processed"))
    )


def write_accuracy(accuracy: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Publish the accuracy table after every micro-batch as a commit that replaces the earlier ones.

    ``read_accuracy`` takes the latest commit. Its number goes on from the last one in the folder, not from the micro-batch,
    so a stream that starts again with a new checkpoint replaces what an earlier one has left. A new checkpoint has at
    most ``STATE_PARTITIONS`` partitions of state; one that exists keeps its own.
    """
    conf, name = accuracy.sparkSession.conf, "spark.sql.shuffle.partitions"
    usual = conf.get(name)

    def add(batch: DataFrame, number: int) -> None:
        log.publish(batch.coalesce(1), path, log.REPLACE)

    conf.set(name, min(int(usual), STATE_PARTITIONS))  # the query takes a copy of the session when it starts
    try:
        return (
            accuracy.writeStream.outputMode("complete")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(add)
            .start()
        )
    finally:
        conf.set(name, usual)


def read_accuracy(spark: SparkSession, path: str) -> DataFrame:
    """The latest table of ``write_accuracy``."""
    latest = log.read_commits(spark, path, log.committed(spark, path))
    if latest is None:
        raise FileNotFoundError(f"no accuracy table at {path}")
    return latest.drop("_commit", "_place")
