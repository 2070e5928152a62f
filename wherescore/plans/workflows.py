"""The jobs end to end: build annotations, sample images, evaluate, re-score, analyse."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wherescore.functions import text
from wherescore.functions.lookups import model_id, model_provider
from wherescore.operators.lists import parse_image_list, parse_image_list_ids
from wherescore.operators.nearby import image_urls
from wherescore.operators.planning import pending_work
from wherescore.operators.respond import FAILED, batch_responses, image_payload
from wherescore.operators.sampling import drop_present, sample_images
from wherescore.operators.score import score_responses, tag_multicue
from wherescore.plans.report import printed_tables
from wherescore.schemas import ANNOTATION_COLUMNS
from wherescore.sources import tables
from wherescore.sources.scratch import scratch_path, settle


def build_annotations(spark: SparkSession, list_path: str, annotations_path: str) -> int:
    """Turn sectioned lists into an annotation table; returns the row count."""
    rows = parse_image_list(tables.read_lines(spark, list_path)).orderBy("file", "pos")
    return tables.write_annotations(rows, annotations_path)


def sample(
    spark: SparkSession,
    coords_path: str,
    features: DataFrame,
    meta: DataFrame,
    present: DataFrame | None,
    annotations_path: str,
    per_target: int = 3,
) -> DataFrame:
    """Choose images for a coordinate file, append their annotation rows, return the fetch list."""
    chosen = settle(
        sample_images(tables.read_coords(spark, coords_path), features, meta, present, per_target)
    )
    tables.append_annotations(chosen.select("id", "filepath", "country", "region"), annotations_path)
    return chosen


def sample_ids(
    spark: SparkSession, ids_path: str, meta: DataFrame, present: DataFrame | None, annotations_path: str
) -> DataFrame:
    """Fetch list of an id file without panoramas; an id listed twice is fetched once."""
    ids = tables.read_id_list(spark, ids_path).distinct().withColumn("filepath", text.image_path("id"))
    chosen = settle(_fetchable(ids, meta, present, skip_pano=True))
    tables.append_annotations(chosen.select("id", "filepath"), annotations_path)
    return chosen


def sample_list(spark: SparkSession, list_path: str, meta: DataFrame, present: DataFrame | None) -> DataFrame:
    """Fetch list of sectioned lists, panoramas kept; no annotation row is written."""
    ids = parse_image_list_ids(tables.read_lines(spark, list_path)).select("id", "country").distinct()
    ids = ids.withColumn("filepath", text.image_path("id", "country"))
    return _fetchable(ids, meta, present, skip_pano=False)


def _fetchable(ids: DataFrame, meta: DataFrame, present: DataFrame | None, skip_pano: bool) -> DataFrame:
    if present is not None:
        ids = drop_present(ids, present)
    return image_urls(ids, meta, skip_pano).where(F.col("url").isNotNull() & (F.col("url") != ""))


def evaluate(
    annotations: DataFrame,
    images: DataFrame,
    respond: Callable[[dict], str] | Mapping[str, Callable[[dict], str]],
    model_key: str,
    results_path: str,
    pilot: int | None = None,
    fmt: str = "parquet",
    commit_rows: int = 1000,
    **calls,
) -> None:
    """Ask the model about every image that has no result yet and append the scored answers.

    ``respond`` is a responder, or one for each provider. Rows whose call failed are not written, so
    the next run takes them up again. The requests are written once and read as a stream: each
    micro-batch has at most ``commit_rows`` of them and commits its answers before the next one starts.
    A run that is killed loses the answers of one micro-batch, however many images are pending, and
    the next run asks only for what is not committed.
    """
    spark = annotations.sparkSession
    model = model_id(model_key)
    if isinstance(respond, Mapping):
        respond = respond[model_provider(model_key)]
    calls = {"tasks": spark.sparkContext.defaultParallelism} | calls
    files = max(1, min(calls["tasks"] or 1, commit_rows))
    work = pending_work(annotations, tables.read_done(spark, results_path, fmt), pilot)
    requests = image_payload(work.select(*ANNOTATION_COLUMNS), images)
    waiting = scratch_path(spark, "requests")
    # Files of so few rows that a trigger's files never hold more than a commit may lose.
    requests.write.option("maxRecordsPerFile", max(1, commit_rows // files)).parquet(waiting)

    def commit(part: DataFrame, _: int) -> None:
        answered = batch_responses(part, respond, **calls)
        rows = (
            answered.where(F.col("status") != FAILED)
            .withColumnRenamed("country", "true_country")
            .withColumn("true_region", F.coalesce("region", F.lit("")))
            .withColumn("model", F.lit(model))
        )
        tables.append_results(score_responses(rows), results_path, fmt)

    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", files).parquet(waiting)
    run = stream.writeStream.foreachBatch(commit).trigger(availableNow=True)
    run.option("checkpointLocation", scratch_path(spark, "progress")).start().awaitTermination()


def rescore(
    spark: SparkSession, results_path: str, output_path: str, annotations: DataFrame | None = None, fmt: str = "parquet"
) -> None:
    """Parse and score saved responses again; the output may be the input."""
    saved = tables.require_raw_response(tables.load_results(spark, results_path, fmt))
    tables.replace_table(score_responses(saved, annotations), output_path)


def analyse(results: DataFrame, annotations: DataFrame | None = None) -> dict[str, DataFrame]:
    """All printed accuracy tables; with annotations, multi-cue images are told apart."""
    tagged = results if annotations is None else tag_multicue(results, annotations)
    return printed_tables(tagged)
