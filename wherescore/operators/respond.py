"""Batch calls to a user-supplied responder."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherescore.functions import text
from wherescore.functions.lookups import IMAGE_NOT_FOUND, PROMPT
from wherescore.operators.joins import spread_join

OK, MISSING, FAILED = "ok", "missing", "failed"


def image_payload(
    annotations: DataFrame, images: DataFrame, prompt: str = PROMPT, with_url: bool = False
) -> DataFrame:
    """Annotations with the request for their image: base64 text, prompt and, if asked for, data URL.

    ``images`` has one row per filepath: filepath, content. A missing image leaves the payload NULL
    and sets ``raw_response`` to IMAGE_NOT_FOUND. Bytes are encoded after the join, so the shuffle
    carries the shorter form.
    """
    wanted = annotations.select("filepath").distinct()
    bytes_of = spread_join(images.select("filepath", "content"), wanted, ["filepath"], "left_semi")
    joined = spread_join(annotations, bytes_of, ["filepath"], "left")
    out = joined.withColumns(
        {
            "image_b64": text.base64_text("content"),
            "prompt": F.lit(prompt),
            "raw_response": F.when(F.col("content").isNull(), F.lit(IMAGE_NOT_FOUND)),
        }
    ).drop("content")
    return out.withColumn("data_url", text.data_url("image_b64")) if with_url else out


def batch_responses(
    requests: DataFrame,
    respond: Callable[[dict], str],
    max_retries: int = 3,
    backoff_s: float = 2.0,
    concurrency: int = 1,
    tasks: int | None = None,
    payload: tuple[str, ...] = ("image_b64", "data_url", "prompt"),
    with_error: bool = False,
) -> DataFrame:
    """Call ``respond`` for every row and add ``raw_response``, ``status`` and, if asked for, ``error``.

    A call is tried ``max_retries`` times with waits of backoff_s ** attempt seconds. Rows that still
    fail get status ``failed`` and are to be left out of the results, so that a later run tries them
    again; rows without an image keep their marker text and status ``missing``. Answers may differ
    from call to call: write the output once before using it more than once. The payload columns are
    dropped. ``tasks`` spreads the rows over so many tasks, each with ``concurrency`` calls at a time; without it the
    requests are taken as they are dealt out. With ``with_error`` the text of the last failure is kept.
    """
    kept = [f for f in requests.schema.fields if f.name not in {*payload, "raw_response"}]
    names = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "raw_response string, status string", *["error string"] * with_error])

    def call(row: dict) -> tuple[str | None, str, str | None]:
        if row.get("raw_response") == IMAGE_NOT_FOUND:
            return IMAGE_NOT_FOUND, MISSING, None
        reason = None
        for attempt in range(1, max_retries + 1):
            try:
                return respond(row), OK, None
            except Exception as error:
                reason = f"{type(error).__name__}: {error}"
                if attempt < max_retries and backoff_s > 0:
                    time.sleep(backoff_s**attempt)
        return None, FAILED, reason

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            for batch in batches:
                answers = list(pool.map(call, batch.to_dict("records")))
                added = ("raw_response", "status", "error")[: 2 + with_error]
                yield batch[names].assign(**{name: [a[k] for a in answers] for k, name in enumerate(added)})

    return (requests if tasks is None else requests.repartition(tasks)).mapInPandas(run, schema)
