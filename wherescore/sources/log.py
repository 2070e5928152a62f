"""Commits beside a table: rows that were appended later, or that replace all earlier ones, in the order of their commits.

A commit writes its rows to a folder of its own, and only then one file of one row that names the folder and the commit's
number. Spark moves that file into place as a whole, so a reader sees a commit entirely or not at all; what it has begun
to read stays where it is. The table itself, a file or a folder of any format, counts as commit 0 and is not touched.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

APPEND, REPLACE, BASE = "append", "replace", "base"
_RECORD = "commit long, kind string, folder string"


@dataclass(frozen=True)
class Committed:
    """What counts of a table: the table itself or not, and the commits after it (number, folder), in order."""

    base: bool
    commits: tuple[tuple[int, str], ...]


def file_order() -> list[Column]:
    """File, start of the split and row number inside the split: the order of the rows in their file."""
    return [
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    ]


def row_order() -> Column:
    """The same order as one sortable text."""
    file, start, row = file_order()
    width = F.lit(20)
    return F.concat_ws(
        "/", file, F.lpad(start.cast("string"), width, F.lit("0")), F.lpad(row.cast("string"), width, F.lit("0"))
    )


def row_place(name: str = "file_path") -> Column:
    """The same order as a struct, which takes less room; ``file_name`` is enough where all files are in one folder."""
    _, start, row = file_order()
    return F.struct(F.col(f"_metadata.{name}").alias("file"), start, row)


def log_path(path: str) -> str:
    return f"{path.rstrip('/')}.log"


def _records(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    try:
        rows = spark.read.schema(_RECORD).parquet(f"{log_path(path)}/commits").collect()  # one small row per commit
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((r.commit, r.folder, r.kind) for r in rows)


def committed(spark: SparkSession, path: str) -> Committed:
    """The state of a table now. Commits of one number (of writers at the same time) follow in order of their folders."""
    base, commits = True, []
    for commit, folder, kind in _records(spark, path):
        if kind != APPEND:
            base, commits = kind == BASE, []
        if kind != BASE:
            commits.append((commit, folder))
    return Committed(base, tuple(commits))


def has_log(spark: SparkSession, path: str) -> bool:
    return bool(_records(spark, path))


def publish(df: DataFrame, path: str, kind: str = APPEND) -> int:
    """Add a commit with the rows of ``df``, which may read the table; returns its number, from 1."""
    spark, folder = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{log_path(path)}/data/{folder}")
    return _record(spark, path, kind, folder)


def restart(spark: SparkSession, path: str) -> None:
    """The table itself, just written anew, counts again, and no earlier commit does."""
    if has_log(spark, path):
        _record(spark, path, BASE, uuid.uuid4().hex)


def _record(spark: SparkSession, path: str, kind: str, folder: str) -> int:
    number = max((c for c, _, _ in _records(spark, path)), default=0) + 1
    record = spark.createDataFrame([(number, kind, folder)], _RECORD).coalesce(1)
    record.write.mode("append").parquet(f"{log_path(path)}/commits")
    return number


def read_commits(spark: SparkSession, path: str, state: Committed) -> DataFrame | None:
    """Rows of the commits of a state in one scan, with ``_commit`` and ``_place`` in it; None if there are none."""
    if not state.commits:
        return None
    rows = spark.read.option("mergeSchema", True).parquet(*[f"{log_path(path)}/data/{folder}" for _, folder in state.commits])
    numbers = spark.createDataFrame([(folder, place) for place, (_, folder) in enumerate(state.commits, 1)], "_folder string, _commit long")
    folder = F.regexp_extract("_metadata.file_path", r"/data/([0-9a-f]{32})/", 1)
    return rows.select("*", folder.alias("_folder"), row_place("file_name").alias("_place")).join(numbers, "_folder").drop("_folder")
