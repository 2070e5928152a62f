"""Readers and writers of the annotation, result, coordinate, id, list and image files."""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wherescore.functions import text
from wherescore.operators.joins import spread_join
from wherescore.schemas import ANNOTATION_COLUMNS, ANNOTATIONS, COORDS, RESULT_COLUMNS, RESULTS
from wherescore.sources import log

# Quoted fields may hold line breaks and doubled quotes; blanks belong to the value.
CSV_READ = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
# Such files cannot be split, so a file has a bounded number of rows.
CSV_WRITE = {
    "header": True,
    "maxRecordsPerFile": 1 << 19,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
# Line breaks beyond LF, CR and CRLF, on which the text source does not split.
_OTHER_BREAKS = "[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _truth(column: str) -> Column:
    """Flag from text: a number is true unless it is zero."""
    value = F.col(column)
    return F.coalesce(value.try_cast("double") != 0, value.try_cast("boolean"))


def _missing_as_none(read: Callable[[], DataFrame]) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_annotations(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Annotation table with ``ord``, the order of its rows: the commit that added them, then their place in it.

    ``path`` is a file or folder; rows that ``append_annotations`` added to it follow in the order of the calls.
    """
    state = log.committed(spark, path)

    def base() -> DataFrame:
        if fmt != "csv":
            return spark.read.schema(ANNOTATIONS).format(fmt).load(path)
        as_text = T.StructType([T.StructField(c, T.StringType()) for c in ANNOTATION_COLUMNS])
        return spark.read.schema(as_text).options(**CSV_READ).csv(path)

    def ordered(rows: DataFrame, commit: Column, place: Column) -> DataFrame:
        place = F.struct(commit.alias("commit"), place.alias("place")).alias("ord")
        return rows.select(*ANNOTATION_COLUMNS, place).withColumn("multi_cue", text.parse_bool("multi_cue"))

    parts = []
    if state.base:
        parts.append(ordered(base(), F.lit(0).cast("long"), log.row_place()))
    added = log.read_commits(spark, path, state)
    if added is not None:
        if fmt == "csv":  # where an empty cell is NULL
            added = added.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ANNOTATION_COLUMNS if c != "multi_cue"})
        parts.append(ordered(added, F.col("_commit"), F.col("_place")))
    return reduce(DataFrame.unionByName, parts)


def write_annotations(df: DataFrame, path: str, fmt: str = "csv") -> int:
    """Replace the annotation table and return its row count, counted while it is written."""
    seen = Observation()
    rows = df.select(*ANNOTATION_COLUMNS).observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = rows.write.mode("overwrite").format(fmt)
    (writer.options(**CSV_WRITE) if fmt == "csv" else writer).save(path)
    log.restart(df.sparkSession, path)
    return seen.get["rows"]


def new_annotations(images: DataFrame) -> DataFrame:
    """Annotation rows of new images; fields that are not known yet are '' or false."""
    defaults = {c: F.lit("") for c in ANNOTATION_COLUMNS} | {"multi_cue": F.lit(False)}
    return images.select(*[F.col(c) if c in images.columns else defaults[c].alias(c) for c in ANNOTATION_COLUMNS])


def append_annotations(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Add rows behind all others of an annotation table, a file or a folder; a table that is not there is written."""
    spark, rows = df.sparkSession, new_annotations(df)
    there = _missing_as_none(lambda: spark.read.format("binaryFile").load(path))
    if there is not None or log.has_log(spark, path):
        log.publish(rows, path)
        return
    writer = rows.write.format(fmt)
    (writer.options(**CSV_WRITE) if fmt == "csv" else writer).save(path)


def load_results(spark: SparkSession, directory: str, fmt: str = "csv") -> DataFrame:
    """All results below a directory; columns a file lacks are NULL, flags are booleans.

    ``csv`` takes the entries ``results_*.csv``, each a file or a folder that Spark wrote. CSV with
    line breaks inside quotes cannot be split, so one file is one task; large results belong in
    ``parquet``, the format of ``append_results``.
    """
    state = log.committed(spark, directory)
    parts = [_base_results(spark, directory, fmt)] if state.base else []
    added = log.read_commits(spark, directory, state)
    if added is not None:
        parts.append(added.drop("_commit", "_place"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _base_results(spark: SparkSession, directory: str, fmt: str) -> DataFrame:
    if fmt != "csv":
        return spark.read.option("mergeSchema", True).format(fmt).load(directory)
    pattern = f"{directory.rstrip('/')}/results_*.csv"
    by_header = _headers(spark, pattern)
    if not by_header:
        raise FileNotFoundError(f"no results_*.csv in {directory}")
    out = None
    for header, paths in by_header.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        part = spark.read.schema(schema).options(**CSV_READ).csv(paths)
        flags = [c for c in ("correct", "region_correct") if c in header]
        part = part.withColumns({c: _truth(c) for c in flags})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _headers(spark: SparkSession, pattern: str) -> dict[tuple[str, ...], list[str]]:
    """Column names of CSV files, each with the files that have them: one job over all files, however many there are.

    Empty files have none. Names must not hold line breaks. The driver gets the file names, which Spark lists there anyway.
    """
    lines = _missing_as_none(lambda: spark.read.text(pattern))
    if lines is None:
        return {}
    file, start, row = log.file_order()
    first = lines.select("value", file, start, row).where("start = 0").groupBy("file").agg(F.min_by("value", "row").alias("header"))
    found: dict[tuple[str, ...], list[str]] = {}
    for header, files in sorted(map(tuple, first.groupBy("header").agg(F.sort_array(F.collect_list("file"))).collect())):
        names = tuple(next(csv.reader([header.removeprefix("\ufeff")])))
        found.setdefault(names, []).extend(files)
    return found


def require_raw_response(df: DataFrame) -> DataFrame:
    if "raw_response" not in df.columns:
        raise ValueError(f"column 'raw_response' is missing; found {df.columns}")
    return df


def append_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add scored rows to a results table, fixed columns in fixed order; one commit per call."""
    rows = df.select(*RESULT_COLUMNS)
    if log.has_log(df.sparkSession, path):
        log.publish(rows, path)
        return
    writer = rows.write.mode("append").format(fmt)
    (writer.options(**CSV_WRITE) if fmt == "csv" else writer).save(path)


def read_done(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Results that exist already; empty if there are none yet."""
    state = log.committed(spark, path)
    reader = spark.read.schema(RESULTS).format(fmt)
    base = _missing_as_none(lambda: (reader.options(**CSV_READ) if fmt == "csv" else reader).load(path)) if state.base else None
    added = log.read_commits(spark, path, state)
    parts = [base, None if added is None else added.drop("_commit", "_place")]
    there = [p for p in parts if p is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), there) if there else spark.createDataFrame([], RESULTS)


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a table that ``df`` may still be reading: a commit, from which on the earlier rows do not count.

    There is a whole table at any time, and what others are reading stays. The readers of this module see the new rows;
    the files at ``path`` are left as they are.
    """
    log.publish(df, path, log.REPLACE)


def checked_coords(df: DataFrame) -> DataFrame:
    """Coordinates with the required columns, typed; other columns are kept."""
    missing = [f.name for f in COORDS if f.name not in df.columns]
    if missing:
        raise ValueError(f"coordinates lack the columns {missing}; found {df.columns}")
    return df.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in COORDS})


def read_coords(spark: SparkSession, path: str) -> DataFrame:
    """Coordinate CSV. Without an ``ord`` column the row order of the file is added as ``ord``."""
    table = spark.read.options(**CSV_READ).csv(path)
    if "ord" in table.columns:
        return checked_coords(table).withColumn("ord", F.col("ord").cast("bigint"))
    return checked_coords(table.select("*", log.row_order().alias("ord")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as file, block, pos, line; a file may be split over many tasks.

    A block is one split of a file; pos orders the lines of a file.
    """
    lines = spark.read.text(path).select("value", *log.file_order())
    return lines.select("file", "start", "row", F.posexplode(F.split("value", _OTHER_BREAKS))).select(
        "file",
        F.col("start").alias("block"),
        F.struct("start", "row", F.col("pos").alias("part")).alias("pos"),
        F.col("col").alias("line"),
    )


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a text file, one per line; blank lines are dropped."""
    return read_lines(spark, path).select(text.strip("line").alias("id")).where(F.col("id") != "")


def read_images(spark: SparkSession, directory: str, root: str = "data/images", wanted: Sequence[str] | None = None) -> DataFrame:
    """Image files as filepath and content; the path is given relative to the folder above ``root``.

    ``wanted`` names the only paths to read: the condition is on the path, so files that do not meet it are never opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    relative = F.url_decode(F.regexp_extract("_metadata.file_path", rf"({root}/.*)$", 1))
    if wanted is not None:
        files = files.where(relative.isin(list(wanted)))
    return files.select(relative.alias("filepath"), "content")


def attach_images(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations with the bytes of their image, NULL if there is none."""
    return spread_join(annotations, images, ["filepath"], "left")
