"""Images near coordinates: tile-keyed radius search with a nearest-k cut."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherescore.functions import geo
from wherescore.operators.joins import spread_join
from wherescore.sources.scratch import settle

# Factor on squared distance bounds; far above rounding and the bulge of a great circle.
_MARGIN = 1.0001
_TILE = ["tile_x", "tile_y"]
# Cells have 8 pixels; a cell of level s is 2**s cells wide, so level 9 is a tile. At most 64 pixels, each cut to the
# nearest copies, lie in a cell: a dense place costs no more than its few cells, whatever the tile holds.
_CELL = 8
_LEVELS = range(10)
# Tiles to each side of a tile whose pixel lengths the distance bounds cover, at least.
_BAND = 8
# Cosine of the latitude at which the tiles end.
_LAST_COSINE = 0.086


def point_features(features: DataFrame) -> DataFrame:
    """Point features with coordinates and an id; adds ``px`` and ``py``.

    The input has tile_x, tile_y, feature_pos, geom_type, coords (array of double) and id.
    """
    return (
        features.where(
            (F.col("geom_type") == "Point")
            & F.col("coords").isNotNull()
            & (F.size("coords") > 0)
            & F.col("id").isNotNull()
            & ~F.col("id").isin("", "0")
        )
        .withColumn("px", F.get("coords", F.lit(0)))
        .withColumn("py", F.get("coords", F.lit(1)))
        .drop("coords", "geom_type")
    )


def with_tile(df: DataFrame, zoom: int = geo.ZOOM) -> DataFrame:
    """Add the tile of a lat/lon row."""
    return df.withColumns({"tile_x": geo.tile_x("lon", zoom), "tile_y": geo.tile_y("lat", zoom)})


def locate_features(points: DataFrame, zoom: int = geo.ZOOM) -> DataFrame:
    """Add the position of a point feature as ``feature_lat`` and ``feature_lon``."""
    return points.withColumns(
        {
            "feature_lat": geo.tile_lat("tile_y", "py", zoom),
            "feature_lon": geo.tile_lon("tile_x", "px", zoom),
        }
    )


def _band(radius_m: float, zoom: int) -> int:
    """Tiles to each side of a tile beyond which no feature is within the radius of a place in the tile."""
    tile_m = 2 * math.pi * geo.EARTH_RADIUS_M / 2**zoom * _LAST_COSINE
    return max(_BAND, math.ceil(radius_m / tile_m) + 1)


def _top(band: int) -> int:
    """Level whose cells are as wide as all pixels of the band: for targets without enough features around them."""
    return math.ceil(math.log2((2 * band + 1) * geo.EXTENT / _CELL))


def _in_band(pixel: str, band: int) -> Column:
    return F.col(pixel).between(-band * geo.EXTENT, (band + 1) * geo.EXTENT - 1)


def _cell(pixel: str) -> Column:
    return F.floor(F.col(pixel) / F.lit(float(_CELL))).cast("int")


def _coarse(cell: str) -> Column:
    """Cell of level ``s`` around a cell."""
    return F.expr(f"shiftright({cell}, s)")


def _search_plan(places: DataFrame, points: DataFrame, radius_m: float, limit: int, zoom: int) -> DataFrame:
    """For each cell that holds targets, the cells where their ``limit`` nearest features can be.

    ``places`` has the distinct (tile_x, tile_y, at_x, at_y) of the targets, so this work is done once
    per cell and not once per target. The smallest cell of any level around a place that holds
    ``limit`` features bounds the search: they are no farther from any target in it than its diagonal.
    ``reach`` is the square of that distance in pixels, or of the radius if that is less. What lies
    within it is in the cells of that level at most two steps away.

    A pixel has between ``low`` and ``high`` metres everywhere in the band around the tile, and
    ``_MARGIN`` covers paths that leave it.
    """
    band = _band(radius_m, zoom)
    top = _top(band)
    levels = F.explode(F.array(*[F.lit(s) for s in _LEVELS])).alias("s")
    all_levels = F.explode(F.array(*[F.lit(s) for s in (*_LEVELS, top)])).alias("s")
    counts = points.groupBy(*_TILE, "cell_x", "cell_y").agg(F.count("*").alias("n"))
    held = (
        counts.select("*", levels)
        .groupBy(*_TILE, "s", _coarse("cell_x").alias("u"), _coarse("cell_y").alias("v"))
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= limit)
        .drop("n")
    )
    at = [*_TILE, "at_x", "at_y"]
    around = places.select("*", levels).withColumns({"u": _coarse("at_x"), "v": _coarse("at_y")})
    bounded = (
        spread_join(around, held.withColumn("_held", F.col("s")), [*_TILE, "s", "u", "v"], "left")
        .groupBy(*at)
        .agg(F.min("_held").alias("s"))
    )

    south = geo.tile_lat("tile_y", F.lit(float((band + 1) * geo.EXTENT)), zoom)
    north = geo.tile_lat("tile_y", F.lit(float(-band * geo.EXTENT)), zoom)
    scales = [geo.metres_per_pixel(edge, zoom) for edge in (south, north)]
    # A band across the equator holds the longest pixel inside.
    equator = F.when(south * north < 0, geo.metres_per_pixel(F.lit(0.0), zoom)).otherwise(F.lit(0.0))
    low, high = F.least(*scales), F.greatest(*scales, equator)
    side = F.pow(F.lit(2.0), F.col("s")) * _CELL
    reach = F.least(
        F.pow(F.lit(radius_m) / low, 2) * _MARGIN,
        F.when(F.col("s").isNotNull(), side * side * 2 * F.pow(high / low, 2) * _MARGIN),
    )
    steps = F.array(*[F.lit(i) for i in range(-2, 3)])
    asked = (
        bounded.withColumn("reach", reach)
        .withColumn("s", F.coalesce("s", F.lit(top)))
        .withColumn("du", F.explode(steps))
        .withColumn("dv", F.explode(steps))
        .select(*at, "reach", "s", (_coarse("at_x") + F.col("du")).alias("u"), (_coarse("at_y") + F.col("dv")).alias("v"))
    )
    occupied = counts.select(*_TILE, "cell_x", "cell_y", all_levels).withColumns(
        {"u": _coarse("cell_x"), "v": _coarse("cell_y")}
    )

    def gap(cell: str, place: str) -> Column:
        """Smallest distance in pixels between points of two cells, along one axis."""
        return F.greatest(F.abs(F.col(cell) - F.col(place)) - 1, F.lit(0)) * float(_CELL)

    near = F.pow(gap("cell_x", "at_x"), 2) + F.pow(gap("cell_y", "at_y"), 2)
    return (
        spread_join(asked, occupied, [*_TILE, "s", "u", "v"], "inner")
        .where(near <= F.col("reach"))
        .select(*at, "cell_x", "cell_y", "reach")
    )


def nearby_topk(
    coords: DataFrame,
    features: DataFrame,
    radius_m: float = 500.0,
    limit: int = 5,
    neighbors: bool = False,
    zoom: int = geo.ZOOM,
) -> DataFrame:
    """The ``limit`` nearest point features of each coordinate within the radius, ranked from 1.

    ``coords`` has a unique ``ord``, lat and lon; features are searched in the tile of the coordinate,
    with ``neighbors`` also in the eight tiles around it. Equal distances rank by feature_pos. Pixels may lie
    outside their tile; those that are too far from it to be within the radius of any place in it are cut early.

    Work per coordinate does not grow with the tile: copies at one pixel are cut to ``limit`` before
    they are shuffled, and of the remaining features only those in grid cells near enough to matter
    are paired. A place that holds much of the data is split by cells of 8 pixels; the targets of one cell, which
    all need the same few cells, by adaptive execution.
    """
    band = _band(radius_m, zoom)
    points = point_features(features).where(_in_band("px", band) & _in_band("py", band))
    pixel = Window.partitionBy("tile_x", "tile_y", "px", "py").orderBy("feature_pos")
    points = points.withColumn("_copy", F.row_number().over(pixel)).where(F.col("_copy") <= limit)
    points = points.withColumns({"cell_x": _cell("px"), "cell_y": _cell("py")})
    # Read three times below: written once, so that the features are scanned and shuffled once.
    points = settle(points.select(*_TILE, "cell_x", "cell_y", "px", "py", "feature_pos", "id"))

    targets = with_tile(coords.select("ord", "lat", "lon"), zoom)
    if neighbors:
        steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
        targets = targets.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
        targets = targets.withColumns(
            {"tile_x": F.col("tile_x") + F.col("_dx"), "tile_y": F.col("tile_y") + F.col("_dy")}
        ).drop("_dx", "_dy")

    targets = targets.withColumns(
        {"x": geo.pixel_x("lon", "tile_x", zoom), "y": geo.pixel_y("lat", "tile_y", zoom)}
    ).withColumns({"at_x": _cell("x"), "at_y": _cell("y")})
    at = [*_TILE, "at_x", "at_y"]
    plan = _search_plan(targets.select(*at).distinct(), points, radius_m, limit, zoom)

    def gap(cell: str, place: str) -> Column:
        """Distance in pixels from a place to a cell, along one axis."""
        left = F.col(cell) * float(_CELL) - F.col(place)
        return F.greatest(left, -left - float(_CELL), F.lit(0.0))

    gap_x, gap_y = gap("cell_x", "x"), gap("cell_y", "y")
    searched = spread_join(targets, plan, at, "inner").where(gap_x * gap_x + gap_y * gap_y <= F.col("reach"))
    located = locate_features(points, zoom).select(
        *_TILE, "cell_x", "cell_y", "px", "py", "feature_pos", "id", "feature_lat", "feature_lon"
    )
    pairs = spread_join(searched.drop("at_x", "at_y"), located, [*_TILE, "cell_x", "cell_y"], "inner")
    # The distance in pixels is cheap and leaves few pairs for the distance in metres.
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    found = pairs.where(dx * dx + dy * dy <= F.col("reach")).withColumn(
        "distance_m", geo.haversine_m("lat", "lon", "feature_lat", "feature_lon")
    )
    nearest = Window.partitionBy("ord").orderBy("distance_m", "feature_pos", *_TILE)
    return (
        found.where(F.col("distance_m") <= radius_m)
        .withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= limit)
        .select(
            "ord",
            "rank",
            "id",
            F.col("feature_lat").alias("lat"),
            F.col("feature_lon").alias("lon"),
            "distance_m",
            *_TILE,
        )
    )


def image_urls(ids: DataFrame, meta: DataFrame, skip_pano: bool = True) -> DataFrame:
    """Add the image ``url`` of an id; NULL if unknown, or panoramic while those are skipped.

    ``meta`` has one row per id: id, thumb_2048_url, is_pano (may be NULL or absent).
    """
    pano = F.coalesce(F.col("is_pano"), F.lit(False)) if "is_pano" in meta.columns else F.lit(False)
    url = F.when(pano & F.lit(skip_pano), F.lit(None)).otherwise(F.col("thumb_2048_url"))
    urls = meta.select("id", url.alias("url"))
    return spread_join(ids, urls, ["id"], "left")
