"""Registered queries: each runs one operator over the whole fixture tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wherescore.functions import geo, text
from wherescore.functions.lookups import model_frame
from wherescore.operators import lists, metrics, nearby, planning, respond, sampling, score
from wherescore.plans import fixtures as fx
from wherescore.plans import report
from wherescore.schemas import ANNOTATION_COLUMNS, RESULT_COLUMNS
from wherescore.sources import tables
from wherescore.sources.scratch import scratch_path
from wherescore.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits, ties to even, so that engines can be compared."""
    return df.withColumns(
        {
            f.name: F.bround(f"`{f.name}`", 6)
            for f in df.schema.fields
            if isinstance(f.dataType, T.DoubleType)
        }
    )


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = lambda spark, sf_dir: _rounded(function(spark, sf_dir))
    return function


def exact_query(function: Query) -> Query:
    """A query whose doubles are single divisions, equal to the last bit in every engine."""
    _QUERIES[function.__name__] = function
    return function


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored answers with the position and the multi-cue flag of their image."""
    return score.score_responses(fx.responses(spark, sf_dir))


def _narrow(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return results(spark, sf_dir).select("ord", "id", "model", *columns)


# --- text -----------------------------------------------------------------------------------------


@query
def parse_country(spark, sf_dir):
    rows = fx.responses(spark, sf_dir)
    return rows.select("ord", "id", "model", text.parse_country("raw_response").alias("predicted_country"))


@query
def normalize_country(spark, sf_dir):
    rows = fx.responses(spark, sf_dir)
    said = text.extract_answer("raw_response")
    return rows.select("ord", "id", "model", text.normalize_country(said).alias("country"))


@query
def title_case(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    mixed = F.concat_ws("-", F.upper("p_name"), F.concat(F.lower("p_type"), F.lit("'s 3rd u.k.")))
    return rows.select("p_partkey", text.title_case(mixed).alias("title"))


@query
def get_region(spark, sf_dir):
    rows = fx.annotations(spark, sf_dir)
    return rows.select("id", "country", text.get_region("country").alias("region"))


@query
def country_match(spark, sf_dir):
    return _narrow(spark, sf_dir, "predicted_country", "true_country", "correct")


@query
def region_match(spark, sf_dir):
    rows = results(spark, sf_dir)
    found = text.region_match("predicted_country", "true_region")
    return rows.select("ord", "id", "model", "predicted_country", "true_region", found.alias("region_correct"))


@query
def parse_bool(spark, sf_dir):
    key = F.col("o_orderkey")
    spelling = (
        F.when(key % 7 == 0, "TRUE").when(key % 7 == 1, "1").when(key % 7 == 2, "Yes")
        .when(key % 7 == 3, "t").when(key % 7 == 4, "0").when(key % 7 == 5, "false")
    )
    return fx.table(spark, sf_dir, "orders").select(key.alias("id"), text.parse_bool(spelling).alias("flag"))


@query
def primary_cue(spark, sf_dir):
    key = F.col("o_orderkey")
    header = (
        F.when(key % 5 == 0, "Linguistic").when(key % 5 == 1, "Infrastructural").when(key % 5 == 2, "Other")
        .otherwise("Multi-Cue")
    )
    notes = (
        F.when(key % 4 == 0, "L/I").when(key % 4 == 1, "E").when(key % 4 == 2, "I / E").otherwise("")
    )
    rows = fx.table(spark, sf_dir, "orders")
    return rows.select(key.alias("id"), text.primary_cue(header, notes).alias("cue_type"))


# --- score ----------------------------------------------------------------------------------------


@query
def score_responses(spark, sf_dir):
    rows = fx.responses(spark, sf_dir)
    found = score.score_responses(rows.drop("true_region"), fx.annotations(spark, sf_dir))
    return found.select("ord", *RESULT_COLUMNS)


@query
def tag_multicue(spark, sf_dir):
    tagged = score.tag_multicue(fx.responses(spark, sf_dir), fx.repeated_annotations(spark, sf_dir))
    return tagged.select("ord", "id", "model", "multi_cue")


@query
def multicue_count(spark, sf_dir):
    tagged = score.tag_multicue(fx.responses(spark, sf_dir), fx.repeated_annotations(spark, sf_dir))
    return score.multicue_count(tagged)


@query
def attach_region(spark, sf_dir):
    rows = fx.responses(spark, sf_dir).drop("true_region")
    return score.attach_region(rows, fx.repeated_annotations(spark, sf_dir)).select("ord", "id", "model", "true_region")


@query
def fallback_region(spark, sf_dir):
    rows = fx.responses(spark, sf_dir).drop("true_region")
    return score.fallback_region(rows).select("ord", "id", "model", "true_country", "true_region")


@query
def single_cue_only(spark, sf_dir):
    rows = fx.responses(spark, sf_dir).select("ord", "id", "model", "cue_type", "multi_cue")
    return score.single_cue_only(rows).drop("multi_cue")


# --- metrics --------------------------------------------------------------------------------------


@query
def overall_accuracy(spark, sf_dir):
    return metrics.overall_accuracy(results(spark, sf_dir))


@query
def accuracy_by_model(spark, sf_dir):
    return metrics.accuracy_by_model(results(spark, sf_dir))


@query
def accuracy_by_cue(spark, sf_dir):
    return metrics.accuracy_by_cue(results(spark, sf_dir))


@query
def accuracy_model_cue(spark, sf_dir):
    return metrics.accuracy_by_model_and_cue(results(spark, sf_dir))


@query
def region_by_model(spark, sf_dir):
    return metrics.region_accuracy_by_model(results(spark, sf_dir))


@query
def region_model_cue(spark, sf_dir):
    return metrics.region_accuracy_by_model_and_cue(results(spark, sf_dir))


@query
def accuracy_by_country(spark, sf_dir):
    return metrics.accuracy_by_country(results(spark, sf_dir))


@query
def accuracy_model_country(spark, sf_dir):
    return metrics.accuracy_by_model_and_country(results(spark, sf_dir))


@query
def model_country_wide(spark, sf_dir):
    wide = metrics.model_country_map(results(spark, sf_dir))
    shown = F.transform("by_country", lambda c: F.concat(c["country"], F.lit("="), text.percent_text(c["accuracy"], "N/A")))
    return wide.select("model", F.array_join(shown, ", ").alias("by_country"), "overall")


@query
def model_country_pivot(spark, sf_dir):
    countries = sorted(c[0] for c in fx.COUNTRIES)
    wide = metrics.model_country_pivot(results(spark, sf_dir), countries)
    return wide.toDF(*[c.lower().replace(" ", "_") for c in wide.columns])


@query
def accuracy_multicue(spark, sf_dir):
    return metrics.accuracy_multicue(results(spark, sf_dir))


@query
def model_summary(spark, sf_dir):
    return metrics.model_summary(results(spark, sf_dir))


@query
def model_cue_rollup(spark, sf_dir):
    return metrics.model_cue_rollup(results(spark, sf_dir))


@query
def accuracy_gaps(spark, sf_dir):
    return metrics.accuracy_gaps(results(spark, sf_dir))


@query
def cue_spread(spark, sf_dir):
    return metrics.cue_spread(results(spark, sf_dir))


@query
def provider_delta(spark, sf_dir):
    return metrics.provider_delta(results(spark, sf_dir), model_frame(spark, fx.MODELS))


@query
def model_rank(spark, sf_dir):
    return metrics.model_rank(results(spark, sf_dir))


@query
def dataset_composition(spark, sf_dir):
    return metrics.dataset_composition(fx.annotations(spark, sf_dir))


@query
def cue_composition(spark, sf_dir):
    return metrics.cue_composition(fx.annotations(spark, sf_dir))


# --- planning -------------------------------------------------------------------------------------


@query
def pending_work(spark, sf_dir):
    rows = fx.repeated_annotations(spark, sf_dir)
    done = fx.annotations(spark, sf_dir).where(F.col("ord") % 4 == 0).select("id")
    return planning.pending_work(rows, done).select("ord", "id")


@query
def pending_pilot(spark, sf_dir):
    rows = fx.annotations(spark, sf_dir)
    done = rows.where(F.col("ord") % 4 == 0).select("id")
    return planning.pending_work(rows, done, pilot=500).select("ord", "id")


@query
def run_summary(spark, sf_dir):
    return planning.run_summary(results(spark, sf_dir))


@query
def cost_estimate(spark, sf_dir):
    return planning.cost_estimate(fx.annotations(spark, sf_dir), model_frame(spark, fx.MODELS))


@exact_query
def running_accuracy(spark, sf_dir):
    return planning.running_accuracy(results(spark, sf_dir))


@query
def batch_responses(spark, sf_dir):
    def answer(row: dict) -> str:
        if int(row["id"]) % 10 == 3:
            raise RuntimeError("service unavailable")
        return f"COUNTRY: {row['country']}"

    rows = fx.annotations(spark, sf_dir).select("id", "country")
    return respond.batch_responses(rows, answer, backoff_s=0)


# --- geo ------------------------------------------------------------------------------------------


@query
def geo_tile(spark, sf_dir):
    return nearby.with_tile(fx.coords(spark, sf_dir)).select("ord", "tile_x", "tile_y")


@query
def tile_to_latlon(spark, sf_dir):
    points = nearby.point_features(fx.tile_features(spark, sf_dir))
    return nearby.locate_features(points).select("feature_pos", "feature_lat", "feature_lon")


@query
def haversine(spark, sf_dir):
    rows = fx.coords(spark, sf_dir)
    distance = geo.haversine_m("lat", "lon", F.lit(52.52), F.lit(13.39))
    return rows.select("ord", distance.alias("distance_m"))


@query
def point_features(spark, sf_dir):
    return nearby.point_features(fx.tile_features(spark, sf_dir))


@query
def nearby_topk(spark, sf_dir):
    found = nearby.nearby_topk(fx.coords(spark, sf_dir), fx.tile_features(spark, sf_dir))
    return found.select("ord", "rank", "id", "lat", "lon", "distance_m")


@query
def nearby_topk_neighbors(spark, sf_dir):
    found = nearby.nearby_topk(fx.coords(spark, sf_dir), fx.tile_features(spark, sf_dir), neighbors=True)
    return found.select("ord", "rank", "id", "lat", "lon", "distance_m")


@query
def meta_lookup(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("id"))
    return nearby.image_urls(ids, fx.image_meta(spark, sf_dir))


@query
def sample_images(spark, sf_dir):
    return sampling.sample_images(
        fx.coords(spark, sf_dir),
        fx.tile_features(spark, sf_dir),
        fx.image_meta(spark, sf_dir),
        fx.present_files(spark, sf_dir),
    )


@query
def sample_images_neighbors(spark, sf_dir):
    return sampling.sample_images(
        fx.coords(spark, sf_dir),
        fx.tile_features(spark, sf_dir),
        fx.image_meta(spark, sf_dir),
        fx.present_files(spark, sf_dir),
        neighbors=True,
    )


@query
def sample_images_failed(spark, sf_dir):
    """Fetches of some images fail: the next candidates move up."""
    meta = fx.image_meta(spark, sf_dir)
    failed = meta.where(F.col("id").cast("bigint") % 5 == 2).select("id")
    return sampling.sample_images(
        fx.coords(spark, sf_dir), fx.tile_features(spark, sf_dir), meta, fx.present_files(spark, sf_dir), failed=failed
    )


# --- sources and sinks ----------------------------------------------------------------------------


@query
def load_results(spark, sf_dir):
    rows = results(spark, sf_dir).select(*RESULT_COLUMNS)
    folder = scratch_path(spark, "results")
    early = F.col("model").isin("model_0", "model_1", "model_2")
    tables.append_results(rows.where(early), f"{folder}/results_a.csv", "csv")
    old = rows.where(~early).drop("region_correct")
    old.write.options(**tables.CSV_WRITE).csv(f"{folder}/results_b.csv")
    return tables.load_results(spark, folder)


@query
def load_annotations(spark, sf_dir):
    path = scratch_path(spark, "annotations.csv")
    tables.write_annotations(fx.annotations(spark, sf_dir), path)
    return tables.read_annotations(spark, path).select(*ANNOTATION_COLUMNS)


@query
def coords_checked(spark, sf_dir):
    path = scratch_path(spark, "coords.csv")
    fx.coords(spark, sf_dir).write.option("header", True).csv(path)
    return tables.read_coords(spark, path)


@query
def id_list(spark, sf_dir):
    path = scratch_path(spark, "ids.txt")
    fx.id_lines(spark, sf_dir).write.text(path)
    return tables.read_id_list(spark, path)


@query
def parse_image_list(spark, sf_dir):
    return lists.parse_image_list(lists.with_block(fx.image_list(spark, sf_dir)))


@query
def parse_image_list_ids(spark, sf_dir):
    return lists.parse_image_list_ids(lists.with_block(fx.image_list(spark, sf_dir)))


@query
def new_annotations(spark, sf_dir):
    found = fx.image_meta(spark, sf_dir).where(F.col("thumb_2048_url").isNotNull())
    rows = found.select("id", text.image_path("id").alias("filepath"))
    path = scratch_path(spark, "annotations.csv")
    tables.append_annotations(rows.where(F.col("id").cast("bigint") % 2 == 0), path)
    tables.append_annotations(rows.where(F.col("id").cast("bigint") % 2 == 1), path)
    return tables.read_annotations(spark, path).select(*ANNOTATION_COLUMNS)


@query
def appended_annotations(spark, sf_dir):
    """A table, and two appends of several partitions: the region of an id is that of the row that was appended last."""
    rows = fx.annotations(spark, sf_dir).drop("ord")
    path = scratch_path(spark, "annotations.csv")
    tables.append_annotations(rows, path)
    number = F.pmod(F.xxhash64("id"), F.lit(4))
    for region, turn in (("first", rows.repartition(4, number)), ("second", rows.repartition(3))):
        some = turn.where(F.col("cue_type") != "linguistic") if region == "second" else turn.where(F.col("country") != "Peru")
        tables.append_annotations(some.withColumn("region", F.lit(region)), path)
    # Dealt out before rows are sorted by id: a task then holds what an exchange gives it, not all rows of a file.
    table = tables.read_annotations(spark, path).select("id", "region", "ord").repartition("id")
    return table.groupBy("id").agg(F.max_by("region", "ord").alias("region"), F.max("ord.commit").alias("commit"), F.count("*").alias("n_rows"))


@query
def image_payload(spark, sf_dir):
    rows = respond.image_payload(fx.page_annotations(spark, sf_dir), fx.page_images(spark, sf_dir), with_url=True)
    return rows.select("id", "filepath", "image_b64", "data_url", "prompt", "raw_response")


@query
def results_sink(spark, sf_dir):
    rows = results(spark, sf_dir)
    path = scratch_path(spark, "results")
    tables.append_results(rows.where(F.col("ord") % 2 == 0), path)
    tables.append_results(rows.where(F.col("ord") % 2 == 1), path)
    return tables.load_results(spark, path, "parquet")


@query
def replace_results(spark, sf_dir):
    path = scratch_path(spark, "results")
    tables.append_results(results(spark, sf_dir), path)
    saved = tables.load_results(spark, path, "parquet").drop("true_region", "predicted_country")
    tables.replace_table(score.score_responses(saved), path)
    return tables.load_results(spark, path, "parquet")


# --- report ---------------------------------------------------------------------------------------


@query
def formatted_table(spark, sf_dir):
    return report.formatted(metrics.accuracy_by_model_and_cue(results(spark, sf_dir)), "N/A")


@query
def formatted_percent(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    share = F.col("p_partkey") / F.lit(16000.0)
    return rows.select("p_partkey", text.percent_text(share - F.floor(share)).alias("percent"))


@query
def model_cue_grid(spark, sf_dir):
    return report.with_labels(metrics.model_cue_grid(results(spark, sf_dir)))


@query
def multicue_pivot(spark, sf_dir):
    wide = metrics.multicue_pivot(results(spark, sf_dir))
    return wide.withColumnsRenamed({"multi-cue": "multi_cue", "single-cue": "single_cue"})


@query
def plot_limits(spark, sf_dir):
    return report.with_axis_limit(metrics.accuracy_by_model(results(spark, sf_dir)))


@query
def plot_cue_colors(spark, sf_dir):
    return report.with_colors(metrics.accuracy_by_cue(results(spark, sf_dir)))


# --- streaming ------------------------------------------------------------------------------------


#: Files of responses that a stream reads, at most: a micro-batch has a number of files, and costs much besides its rows.
RESPONSE_FILES, LATER_FILES = 24, 4
#: Bytes of the row groups in them, so that a micro-batch of one file is read by many tasks.
ROW_GROUP = 4 << 20


def _saved_responses(spark: SparkSession, sf_dir: str) -> tuple[str, T.StructType]:
    rows = fx.responses(spark, sf_dir).drop("true_region")
    path = scratch_path(spark, "responses")
    rows.coalesce(RESPONSE_FILES).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return path, rows.schema


@query
def stream_score(spark, sf_dir):
    path, schema = _saved_responses(spark, sf_dir)
    arriving = live.read_responses(spark, path, schema, max_files=4)
    scored = live.score_stream(arriving, fx.annotations(spark, sf_dir))
    out = scratch_path(spark, "scored")
    live.write_scores(scored, out, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out)


@query
def stream_accuracy(spark, sf_dir):
    path, schema = _saved_responses(spark, sf_dir)
    scored = live.score_stream(live.read_responses(spark, path, schema, max_files=4))
    out = scratch_path(spark, "accuracy")
    live.write_accuracy(live.live_accuracy(scored), out, scratch_path(spark, "checkpoint")).awaitTermination()
    return live.read_accuracy(spark, out)


@query
def stream_accuracy_again(spark, sf_dir):
    """A second stream with a checkpoint of its own on the folder of a first one, which had more micro-batches."""
    path, schema = _saved_responses(spark, sf_dir)
    out, later = scratch_path(spark, "accuracy"), scratch_path(spark, "later")
    third = spark.read.schema(schema).parquet(path).where(F.col("ord") % 3 == 0).coalesce(LATER_FILES)
    third.write.option("parquet.block.size", ROW_GROUP).parquet(later)
    for folder in (path, later):
        scored = live.score_stream(live.read_responses(spark, folder, schema, max_files=1))
        live.write_accuracy(live.live_accuracy(scored), out, scratch_path(spark, "checkpoint")).awaitTermination()
    return live.read_accuracy(spark, out)
