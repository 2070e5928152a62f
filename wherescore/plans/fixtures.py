"""Input tables of the registered queries, derived from the given tables.

Ids, cue types, coordinates and answers come from keys of the given tables by arithmetic, so every
fixture grows with them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Nation key -> country, region, spelling used in answers.
COUNTRIES = [
    ("Japan", "East Asia", "japan"),
    ("South Korea", "East Asia", "Republic of Korea"),
    ("Thailand", "Southeast Asia", "Thailand."),
    ("Indonesia", "Southeast Asia", "INDONESIA"),
    ("India", "South Asia", "India,"),
    ("Germany", "Western Europe", "germany;"),
    ("United Kingdom", "Western Europe", "UK"),
    ("Finland", "Northern Europe", "Finland"),
    ("Russia", "Eastern Europe", "Russian Federation"),
    ("Canada", "North America", "canada"),
    ("Mexico", "North America", "Mexico"),
    ("Brazil", "South America", "Brazil."),
    ("Turkey", "Middle East", "turkey"),
    ("United States", "North America", "U.S.A."),
    ("Netherlands", "Western Europe", "the Netherlands"),
    ("Vietnam", "Southeast Asia", "Viet Nam"),
    ("China", "East Asia", "PRC"),
    ("Ivory Coast", "Sub-Saharan Africa", "Cote d'Ivoire"),
    ("Czechia", "", "Czech Republic"),
    ("Poland", "Eastern Europe", "Poland"),
    ("Norway", "Northern Europe", "norway"),
    ("Peru", "South America", "Peru"),
    ("Laos", "Southeast Asia", "Lao PDR"),
    ("Malaysia", "Southeast Asia", "malaysia"),
    ("France", "", "France"),
]

# Model dimension of the fixtures: model_i belongs to provider p(i % 3), generation i // 3.
MODELS = [
    ("model_0", "model_0", "p0", 0, 0.02, 0.0),
    ("model_1", "model_1", "p1", 0, 0.02, 5.0),
    ("model_2", "model_2", "p2", 0, 0.001, 12.0),
    ("model_3", "model_3", "p0", 1, 0.05, 0.0),
    ("model_4", "model_4", "p1", 1, 0.001, 12.0),
    ("model_5", "model_5", "p2", 1, 0.03, 0.0),
    ("model_6", "model_6", "p3", 0, None, 0.0),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_rows(df: DataFrame) -> DataFrame:
    """Rows over all cores if the files have fewer splits; a file with one row group is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def country_dim(spark: SparkSession, prefix: str = "") -> DataFrame:
    columns = list(zip(*COUNTRIES))
    names = ["country", "region", "variant"]
    return spark.createDataFrame(
        pa.table(
            {f"{prefix}nationkey": pa.array(range(len(COUNTRIES)), pa.int32())}
            | {f"{prefix}{n}": pa.array(list(c), pa.string()) for n, c in zip(names, columns)}
        )
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the country of their customer and the annotation columns."""
    orders = spread_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    key = F.col("o_orderkey").cast("string")
    multi = F.col("o_orderpriority") == "1-URGENT"
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(country_dim(spark), F.col("c_nationkey") == F.col("nationkey"))
        .select(
            F.col("o_orderkey").alias("ord"),
            key.alias("id"),
            F.concat(F.lit("data/images/"), "country", F.lit("/"), key, F.lit(".jpg")).alias("filepath"),
            "country",
            F.when(F.col("o_orderkey") % 3 == 0, "linguistic")
            .when(F.col("o_orderkey") % 3 == 1, "environmental")
            .otherwise("infrastructure")
            .alias("cue_type"),
            multi.alias("multi_cue"),
            F.when(multi, "I/E").otherwise("").alias("cue_notes"),
            "region",
            "variant",
        )
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotated image per order."""
    return _orders(spark, sf_dir).drop("variant")


def repeated_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations in which every seventh id is listed a second time, later, with another region and flag."""
    rows = annotations(spark, sf_dir)
    again = rows.where(F.col("ord") % 7 == 0).select(
        (F.col("ord") + 1_000_000_000).alias("ord"),
        "id",
        "filepath",
        "country",
        F.lit("infrastructure").alias("cue_type"),
        (~F.col("multi_cue")).alias("multi_cue"),
        F.lit("L/I").alias("cue_notes"),
        F.when(F.col("ord") % 2 == 0, "East Asia").alias("region"),
    )
    return rows.unionByName(again)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per line item: the true country or that of the supplier, in several text forms."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    said = country_dim(spark, "s_").withColumnRenamed("s_nationkey", "nation")
    answer = F.when((F.col("l_orderkey") + F.col("l_partkey")) % 10 < 6, F.col("variant")).otherwise(
        F.col("s_variant")
    )
    raw = (
        F.when((F.col("l_linenumber") == 7) & (F.col("l_partkey") % 2 == 0), F.lit("I cannot tell."))
        .when(F.col("l_linenumber") == 6, F.concat(F.lit("country:\n\n  "), answer, F.lit(" ")))
        .when(F.col("l_linenumber") == 5, F.concat(F.lit("signs. COUNTRY: "), answer, F.lit("\nCOUNTRY: Peru")))
        .otherwise(F.concat(F.lit("REASONING: signs and roads.\nCOUNTRY: "), answer))
    )
    return (
        lines.join(_orders(spark, sf_dir), F.col("l_orderkey") == F.col("ord"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(said, F.col("s_nationkey") == F.col("nation"))
        .select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
            "id",
            "cue_type",
            F.col("country").alias("true_country"),
            F.concat(F.lit("model_"), (F.col("l_suppkey") % 6).cast("string")).alias("model"),
            raw.alias("raw_response"),
            F.col("region").alias("true_region"),
            "multi_cue",
        )
    )


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One target per supplier in two countries, all within a few tiles."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return suppliers.join(country_dim(spark), F.col("s_nationkey") % 2 == F.col("nationkey")).select(
        F.col("s_suppkey").alias("ord"),
        (F.lit(52.497) + ((F.col("s_suppkey") * 7919) % 1000).cast("double") * 0.000045).alias("lat"),
        (F.lit(13.34) + ((F.col("s_suppkey") * 6101) % 1000).cast("double") * 0.0001).alias("lon"),
        "country",
        "region",
    )


def tile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tile feature per customer; some are lines, some lack an id, coordinates or both."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("feature_pos"),
        (F.lit(8799) + key % 5).cast("int").alias("tile_x"),
        (F.lit(5371) + F.floor(key / 5) % 4).cast("int").alias("tile_y"),
        F.when(key % 17 == 0, "LineString").otherwise("Point").alias("geom_type"),
        F.when(key % 29 != 0, F.array(((key * 7919) % 4096).cast("double"), ((key * 6101) % 4096).cast("double"))).alias(
            "coords"
        ),
        F.when(key % 23 != 0, key.cast("string")).alias("id"),
    )


def image_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL and panorama flag per customer key."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("id"),
        F.when(key % 11 != 0, F.concat(F.lit("https://img.example/"), key.cast("string"))).alias("thumb_2048_url"),
        F.when(key % 7 == 0, True).when(key % 7 != 1, False).alias("is_pano"),
    )


def present_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that exist already: every thirteenth image, in both target countries."""
    key = F.col("c_custkey")
    country = F.explode(F.array(F.lit("Japan"), F.lit("South Korea"))).alias("country")
    return (
        table(spark, sf_dir, "customer")
        .where(key % 13 == 0)
        .select(key.cast("string").alias("id"), country)
        .select(F.concat(F.lit("data/images/"), "country", F.lit("/"), "id", F.lit(".jpg")).alias("filepath"))
    )


def image_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sectioned list with one line per part: a country section of 40 lines with four cue sections."""
    key = F.col("p_partkey")
    step, number = key % 40, (key + 100000).cast("string")
    name = F.when(F.col("country") == "United Kingdom", "UK").otherwise(F.col("country"))
    line = (
        F.when(step == 0, name)
        .when(step == 2, F.lit("Linguistic"))
        .when(step == 12, F.lit("  Environmental "))
        .when(step == 22, F.lit("Infrastructural"))
        .when(step == 32, F.lit("Multi-Cue"))
        .when(step == 11, F.lit(""))
        .when(step == 35, F.concat(number, F.lit(" E/I")))
        .when(step == 36, number)
        .when(step > 32, F.concat(number, F.lit("  L / I")))
        .otherwise(number)
    )
    parts = table(spark, sf_dir, "part").select("p_partkey")
    return parts.join(country_dim(spark), F.floor(key / 40) % len(COUNTRIES) == F.col("nationkey")).select(
        F.lit("list").alias("file"), key.alias("pos"), line.alias("line")
    )


def id_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines with an id each, padded, some of them blank."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.when(key % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), key.cast("string"), F.lit("\t"))).alias("value")
    )


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page text as the bytes of an image file."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.concat(F.lit("data/images/"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("filepath"),
        F.encode("html", "UTF-8").alias("content"),
    )


def page_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images named after pages; every fifth names a page that does not exist."""
    key = F.col("page_id")
    name = F.when(key % 5 == 0, -1 - key).otherwise(key).cast("string")
    return table(spark, sf_dir, "pages").select(
        name.alias("id"), F.concat(F.lit("data/images/"), name, F.lit(".jpg")).alias("filepath")
    )
