"""Choice of images for a list of coordinates with a quota per coordinate.

Coordinates are served in order; each takes its nearest usable images until its quota is met and
skips images that an earlier coordinate of the same country took. Two coordinates depend on each
other only through an image that both may take.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherescore.functions import text
from wherescore.operators.joins import spread_join
from wherescore.operators.nearby import image_urls, nearby_topk
from wherescore.operators.prefix import numbered
from wherescore.sources.scratch import scratch_path, settle

#: Coordinates of a block, which one task decides; each has at most twice its quota of claims.
BLOCK_TARGETS = 20_000

_CLAIM = ["country", "ord", "rank", "id"]
_TILE = ["tile_x", "tile_y"]
_IMAGE = ["country", "id"]
_TARGET = ["country", "ord"]


def drop_present(df: DataFrame, present: DataFrame) -> DataFrame:
    """Drop rows whose ``filepath`` is already listed in ``present``."""
    return spread_join(df, present.select("filepath").distinct(), ["filepath"], "left_anti")


def image_claims(
    coords: DataFrame,
    features: DataFrame,
    meta: DataFrame,
    present: DataFrame | None,
    per_target: int,
    radius_m: float,
    skip_pano: bool = True,
    neighbors: bool = False,
) -> DataFrame:
    """Images each coordinate may take: of its nearest 2 x quota, those with a URL and not present.

    Unusable and present images count neither as taken nor against the quota, so they go first.
    """
    found = nearby_topk(coords, features, radius_m, 2 * per_target, neighbors)
    claims = found.join(coords.select("ord", "country", "region"), "ord")
    claims = image_urls(claims, meta, skip_pano).where(F.col("url").isNotNull() & (F.col("url") != ""))
    claims = claims.withColumn("filepath", text.image_path("id", "country"))
    return claims if present is None else drop_present(claims, present)


def _block_of_targets(claims: DataFrame, block_targets: int) -> DataFrame:
    """Block of each coordinate (country, ord, block): those of one country and tile, in order, so many to a block."""
    targets = claims.groupBy(*_TARGET).agg(F.min(F.struct(*_TILE)).alias("tile")).select(*_TARGET, "tile.*")
    placed = numbered(settle(targets), ["country", *_TILE], ["ord"], "nth")
    part = F.expr(f"nth div {block_targets}").cast("string")
    tile = [F.col(c).cast("string") for c in _TILE]
    return placed.select(*_TARGET, F.concat_ws("/", *tile, part, "country").alias("block"))


def _decide(block: pd.DataFrame) -> pd.DataFrame:
    """What of a block waits for nothing outside it: claims that are taken, and those of coordinates that stay open.

    A coordinate takes a claim if no earlier one can still take the image, and if its quota would not be met even if it got
    all the undecided claims before that one. ``waits`` tells that another block has an earlier open claim on the image.
    """
    taken: set[str] = set()
    contested: set[str] = set()
    rows: list[tuple] = []
    for (country, ord_), claims in block.sort_values(["ord", "rank"], kind="stable").groupby(["country", "ord"], sort=False, dropna=False):
        quota, got, undecided, rest = int(claims["quota"].iloc[0]), 0, 0, []
        for rank, id_, waits in zip(claims["rank"], claims["id"], claims["waits"], strict=True):
            if id_ in taken:
                continue
            free = id_ not in contested and not waits
            if got + undecided < quota and free:
                taken.add(id_)
                rows.append((country, ord_, rank, id_, 0, True))
                got += 1
            else:
                undecided += got + undecided < quota
                rest.append((rank, id_))
        if undecided:
            contested.update(id_ for _, id_ in rest)
            rows.extend((country, ord_, rank, id_, quota - got, False) for rank, id_ in rest)
    return pd.DataFrame(rows, columns=[*_CLAIM, "quota", "taken"]).assign(block=block["block"].iloc[0])


def take_in_order(claims: DataFrame, per_target: int, block_targets: int = BLOCK_TARGETS) -> DataFrame:
    """Decide claims (country, ord, rank, id, tile_x, tile_y): the rows that are taken.

    Coordinates are dealt into blocks by place and order, of at most ``block_targets`` each. In a round each block decides,
    in one task, all claims that wait for nothing outside; only claims on images that several blocks want are exchanged,
    and coordinates that wait for another block go on to the next round. The earliest open coordinate never waits, so the
    rounds end; a chain of coordinates that wait for each other takes as many rounds as it crosses from block to block.
    """
    blocks = _block_of_targets(claims, block_targets)
    own = claims.groupBy(*_TARGET, "id").agg(F.min("rank").alias("rank")).withColumn("quota", F.lit(per_target))
    state = spread_join(own, blocks, _TARGET, "inner")
    types = dict(claims.select(*_CLAIM).dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in _CLAIM) + ", quota int, taken boolean, block string"
    path = scratch_path(claims.sparkSession, "taken")
    while True:
        state = settle(state.select(*_CLAIM, "quota", "block"))
        sides = state.groupBy(*_IMAGE, "block").agg(F.min("ord").alias("first"))
        # As many sides as blocks that want the image, which lie around it.
        wanted = sides.groupBy(*_IMAGE).agg(F.sort_array(F.collect_list(F.struct("first", "block"))).alias("sides"))
        border = wanted.where(F.size("sides") > 1).select(*_IMAGE, F.slice("sides", 1, 2).alias("sides"))
        mine = F.col("sides")[0]["block"] == F.col("block")
        earlier = F.when(mine, F.col("sides")[1]["first"]).otherwise(F.col("sides")[0]["first"])
        exchanged = spread_join(state, border, _IMAGE, "left").withColumn("waits", F.coalesce(earlier < F.col("ord"), F.lit(False))).drop("sides")
        step = settle(exchanged.groupBy("block").applyInPandas(_decide, schema))
        taken = step.where("taken").select(*_CLAIM)
        taken.write.mode("append").parquet(path)
        waiting = step.where("not taken")
        if waiting.isEmpty():
            return claims.sparkSession.read.schema(taken.schema).parquet(path)
        state = spread_join(waiting, taken.select(*_IMAGE), _IMAGE, "left_anti")


def sample_images(
    coords: DataFrame,
    features: DataFrame,
    meta: DataFrame,
    present: DataFrame | None = None,
    per_target: int = 3,
    radius_m: float = 500.0,
    block_targets: int = BLOCK_TARGETS,
    neighbors: bool = False,
    failed: DataFrame | None = None,
) -> DataFrame:
    """Images to fetch for each coordinate (ord, lat, lon, country, region), in order, with a quota.

    ``failed`` names images (id) that could not be fetched: they use no quota, and the next candidate moves up.
    """
    claims = image_claims(coords, features, meta, present, per_target, radius_m, neighbors=neighbors)
    if failed is not None:
        claims = spread_join(claims, failed.select(F.col("id").cast("string").alias("id")).distinct(), ["id"], "left_anti")
    claims = settle(claims)
    taken = take_in_order(claims, per_target, block_targets)
    return claims.join(taken, _CLAIM).select(
        "ord", "rank", "id", "country", "region", "filepath", "url", "distance_m"
    )
