import math
import random

import pytest
from pyspark.sql import functions as F

from wherescore.functions import geo
from wherescore.operators import nearby, sampling

FEATURES = "feature_pos bigint, tile_x int, tile_y int, geom_type string, coords array<double>, id string"
COORDS = "ord bigint, lat double, lon double, country string, region string"


def tile_of(lat, lon, n=2**14):
    phi = math.radians(lat)
    return int((lon + 180) / 360 * n), int((1 - math.log(math.tan(phi) + 1 / math.cos(phi)) / math.pi) / 2 * n)


def place(tx, ty, px, py, n=2**14):
    lat = math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (ty + py / 4096) / n))))
    return lat, (tx + px / 4096) / n * 360 - 180


def metres(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 6_371_000 * 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def brute(coords, features, radius, limit, neighbors=False):
    out = {}
    for ord_, lat, lon, *_ in coords:
        tx, ty = tile_of(lat, lon)
        found = []
        for pos, x, y, kind, pixel, id_ in features:
            near = (abs(x - tx) <= 1 and abs(y - ty) <= 1) if neighbors else (x, y) == (tx, ty)
            if near and kind == "Point" and pixel and id_:
                d = metres(lat, lon, *place(x, y, *pixel))
                if d <= radius:
                    found.append((round(d, 6), pos, x, y, id_))
        out[ord_] = [(id_, d) for d, *_, id_ in sorted(found)[:limit]]
    return {k: v for k, v in out.items() if v}


def collected(df):
    out = {}
    for r in df.orderBy("ord", "rank").collect():
        out.setdefault(r.ord, []).append((r.id, round(r.distance_m, 6)))
    return out


def make(rng, lat, lon, n_coords, n_features, clustered):
    tx, ty = tile_of(lat, lon)
    features = []
    for i in range(n_features):
        if clustered and i % 3:
            # A third of the features at one pixel, a third in one corner of one tile.
            px, py = (100.0, 100.0) if i % 3 == 1 else (float(rng.randrange(90, 140)), float(rng.randrange(90, 140)))
            x, y = tx, ty
        else:
            px, py = float(rng.randrange(-40, 4140)), float(rng.randrange(-40, 4140))
            x, y = tx + rng.randrange(-1, 2), ty + rng.randrange(-1, 2)
        kind = "LineString" if i % 17 == 5 else "Point"
        features.append((i, x, y, kind, None if i % 19 == 3 else [px, py], None if i % 23 == 7 else f"i{i}"))
    coords = []
    for i in range(n_coords):
        if clustered and i % 3 == 0:
            clat, clon = place(tx, ty, 120.137, 130.731)
        else:
            clat, clon = place(tx, ty, rng.uniform(1, 4095), rng.uniform(1, 4095))
        coords.append((i, clat, clon, ("Japan", "India")[i % 2], "r"))
    return coords, features


@pytest.mark.parametrize("neighbors", [False, True])
@pytest.mark.parametrize(
    "lat, lon, clustered", [(52.5, 13.4, False), (52.5, 13.4, True), (0.0001, -60.0, True), (-77.8, 166.7, True), (84.9, 10.0, False)]
)
def test_nearest_equals_brute_force(spark, lat, lon, clustered, neighbors):
    coords, features = make(random.Random(int(lat * 10)), lat, lon, 40, 900, clustered)
    c, f = spark.createDataFrame(coords, COORDS), spark.createDataFrame(features, FEATURES)
    for radius, limit in ((500.0, 5), (60.0, 3), (5000.0, 1)):
        found = collected(nearby.nearby_topk(c, f, radius, limit, neighbors))
        assert found == brute(coords, features, radius, limit, neighbors)


def metric_rows(plan, kind):
    """Output row counts of the executed operators of a kind."""
    out, waiting = [], [plan]
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            waiting.append(node.plan())
        else:
            rows = node.metrics().get("numOutputRows")
            if kind in name and rows.isDefined():
                out.append(rows.get().value())
            children = node.children()
            waiting += [children.apply(i) for i in range(children.size())]
    return out


def test_search_pairs_stay_few(spark):
    """In a dense tile each coordinate is compared with a small part of the features."""
    rng = random.Random(1)
    tx, ty = tile_of(52.5, 13.4)
    features = [(i, tx, ty, "Point", [float(rng.randrange(4096)), float(rng.randrange(4096))], f"i{i}") for i in range(5000)]
    coords = [(i, *place(tx, ty, rng.uniform(0, 4096), rng.uniform(0, 4096)), "Japan", "r") for i in range(50)]
    frames = spark.createDataFrame(coords, COORDS), spark.createDataFrame(features, FEATURES)
    found = nearby.nearby_topk(*frames, 500.0, 5)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    pairs = max(metric_rows(plan, "Join"))
    assert pairs < 50 * 5000 / 20


def test_hot_cell(spark):
    """Half of all coordinates and features in 64 pixels: pairs follow the coordinates, not the square."""
    rng = random.Random(2)
    tx, ty = tile_of(52.5, 13.4)

    def spot(i):
        return (rng.uniform(128, 191.9), rng.uniform(192, 255.9)) if i % 2 else (rng.uniform(0, 4095), rng.uniform(0, 4095))

    features = [(i, tx, ty, "Point", list(map(float, map(int, spot(i)))), f"i{i}") for i in range(4000)]
    coords = [(i, *place(tx, ty, *spot(i)), "Japan", "r") for i in range(400)]
    found = nearby.nearby_topk(spark.createDataFrame(coords, COORDS), spark.createDataFrame(features, FEATURES), 500.0, 5)
    assert collected(found) == brute(coords, features, 500.0, 5)
    found.collect()
    pairs = max(metric_rows(found._jdf.queryExecution().executedPlan(), "Join"))
    assert pairs < 200 * 2000 / 5


def test_known_values(spark):
    row = spark.range(1).select(
        geo.haversine_m(F.lit(52.5), F.lit(13.4), F.lit(52.503), F.lit(13.401)),
        geo.haversine_m(F.lit(52.503), F.lit(13.401), F.lit(52.5), F.lit(13.4)),
        geo.tile_x(F.lit(13.4)),
        geo.tile_y(F.lit(52.5)),
        geo.tile_y(F.lit(-90.0)),
        geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)),
    ).first()
    assert round(row[0], 6) == 340.383003 and row[0] == row[1]
    assert row[2:5] == (8801, 5374, None)
    assert round(row[5]) == round(math.pi * 6_371_000)


def test_tile_round_trip(spark):
    tiles = spark.range(2000).selectExpr("cast(id * 8 as int) tile_x", "cast(id * 7 + 900 as int) tile_y", "id")
    back = nearby.with_tile(
        tiles.select("tile_x", "tile_y", geo.tile_lat("tile_y", F.lit(2048.0)).alias("lat"), geo.tile_lon("tile_x", F.lit(2048.0)).alias("lon"))
        .withColumnsRenamed({"tile_x": "x", "tile_y": "y"})
    )
    assert back.where("x <> tile_x or y <> tile_y").isEmpty()


def test_image_urls(spark):
    meta = spark.createDataFrame([("1", "u1", True), ("2", "u2", None), ("3", None, False)], "id string, thumb_2048_url string, is_pano boolean")
    ids = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("2",)], "id string")
    assert sorted((r.id, r.url) for r in nearby.image_urls(ids, meta).collect() if r.url) == [("2", "u2"), ("2", "u2")]
    assert {r.url for r in nearby.image_urls(ids, meta, skip_pano=False).collect()} == {"u1", "u2", None}
    assert {r.url for r in nearby.image_urls(ids, meta.drop("is_pano")).collect()} == {"u1", "u2", None}


def greedy(claims, quota):
    """The rule restated: targets in order, images in rank order, first come first served per country."""
    taken, out = set(), set()
    for ord_ in sorted({c[1] for c in claims}):
        left = quota
        for country, _, rank, id_, *_ in sorted((c for c in claims if c[1] == ord_), key=lambda c: c[2]):
            if left and (country, id_) not in taken:
                taken.add((country, id_))
                out.add((country, ord_, rank, id_))
                left -= 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_quota_equals_greedy(spark, seed):
    rng = random.Random(seed)
    claims = []
    for ord_ in range(60):
        country, tile = rng.choice(["Japan", "Japan", "India"]), rng.randrange(3)
        # Ids of tile 0 and 1 overlap, so some groups are bridged; a third of the targets want the same images.
        pool = [f"hot{i}" for i in range(6)] if ord_ % 3 == 0 else [f"i{i + 8 * tile}" for i in range(12)]
        for rank, id_ in enumerate(rng.sample(pool, rng.randrange(1, 7)), 1):
            claims.append((country, ord_, rank, id_, tile, tile))
    table = spark.createDataFrame(claims, "country string, ord bigint, rank int, id string, tile_x int, tile_y int")
    expected = greedy(claims, 3)
    for block_targets in (1, 7, 10_000):
        found = [tuple(r) for r in sampling.take_in_order(table, 3, block_targets).collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_chain_of_targets(spark):
    """Every target shares its first image with the target before it: the longest dependency, in jobs bound by blocks."""
    claims = [("Japan", i, r, f"i{i + r - 1}", 0, 0) for i in range(2000) for r in (1, 2)]
    table = spark.createDataFrame(claims, "country string, ord bigint, rank int, id string, tile_x int, tile_y int")
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for block_targets in (5000, 700):
        spark.sparkContext.setJobGroup(f"chain {block_targets}", "")
        found = {tuple(r) for r in sampling.take_in_order(table, 1, block_targets).collect()}
        jobs.append(len(tracker.getJobIdsForGroup(f"chain {block_targets}")))
        assert found == greedy(claims, 1)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] < 60 and jobs[1] < 3 * jobs[0]


def test_failed_images_use_no_quota(spark):
    coords, features = make(random.Random(6), 52.5, 13.4, 25, 300, True)
    meta = [(f"i{i}", f"u{i}", False) for i in range(300)]
    failed = {f"i{i}" for i in range(0, 300, 4)}
    claims = [
        (coords[ord_][3], ord_, rank, id_)
        for ord_, found in brute(coords, features, 500.0, 6).items()
        for rank, (id_, _) in enumerate(found, 1)
        if id_ not in failed  # the sequential rule: a failed fetch goes on to the next candidate
    ]
    out = sampling.sample_images(
        spark.createDataFrame(coords, COORDS),
        spark.createDataFrame(features, FEATURES),
        spark.createDataFrame(meta, "id string, thumb_2048_url string, is_pano boolean"),
        failed=spark.createDataFrame([(i,) for i in failed], "id string"),
    )
    assert {(r.country, r.ord, r.rank, r.id) for r in out.collect()} == greedy(claims, 3)


def test_sample_images_end_to_end(spark):
    coords, features = make(random.Random(5), 52.5, 13.4, 30, 300, True)
    meta = [(f"i{i}", None if i % 11 == 0 else f"u{i}", i % 7 == 0) for i in range(300)]
    present = [(f"data/images/Japan/i{i}.jpg",) for i in range(0, 300, 13)]
    usable = {id_ for id_, url, pano in meta if url and not pano}
    claims = []
    for ord_, found in brute(coords, features, 500.0, 6).items():
        country = coords[ord_][3]
        for rank, (id_, _) in enumerate(found, 1):
            if id_ in usable and (f"data/images/{country}/{id_}.jpg",) not in present:
                claims.append((country, ord_, rank, id_))
    out = sampling.sample_images(
        spark.createDataFrame(coords, COORDS),
        spark.createDataFrame(features, FEATURES),
        spark.createDataFrame(meta, "id string, thumb_2048_url string, is_pano boolean"),
        spark.createDataFrame(present, "filepath string"),
    )
    assert {(r.country, r.ord, r.rank, r.id) for r in out.collect()} == greedy(claims, 3)


def test_pixels_far_outside_their_tile(spark):
    n, (lat, lon), rng = 2**20, (48.1, 11.5), random.Random(3)
    tx, ty = tile_of(lat, lon, n)
    pixels = [(float(rng.randrange(-25 * 4096, 25 * 4096)), float(rng.randrange(-25 * 4096, 25 * 4096))) for _ in range(60)]
    features = [(i, tx, ty, "Point", list(p), str(i + 1)) for i, p in enumerate(pixels)]
    away = sorted((metres(lat, lon, *place(tx, ty, *p, n)), str(i + 1)) for i, p in enumerate(pixels))
    found = nearby.nearby_topk(
        spark.createDataFrame([(0, lat, lon, "x", "y")], COORDS), spark.createDataFrame(features, FEATURES), 500.0, 20, zoom=20
    )
    expected = [i for d, i in away if d <= 500][:20]
    assert len(expected) > 12 and [i for i, _ in collected(found)[0]] == expected
