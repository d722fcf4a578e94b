"""Fixed examples of the scalar rules."""

import math

import pytest
from pyspark.sql import functions as F

from rasterlake.functions import color, geo, text, validate
from rasterlake.operators import archive, catalog, jobs, ratelimit


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_incoming_rows_meet_the_catalogue_once(spark):
    """The steps that look for first rows read what was kept and not the joins again."""
    new = spark.range(6).select(
        F.col("id").alias("request_id"), (F.col("id") % 2).alias("user_id"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("slug"),
        F.concat(F.lit("p"), F.floor(F.col("id") / 4).cast("string")).alias("storage_path"),
    )
    sets = spark.createDataFrame([], "tileset_id long, user_id long, slug string, storage_path string")
    stored = spark.createDataFrame([("p0", 5), ("p1", 7)], "storage_path string, size_bytes long")
    got = catalog.finalise(sets, new, new.select("storage_path", "user_id"), stored)
    assert "Range (" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.request_id, r.action, r.stored_bytes) for r in got.orderBy("request_id").collect()] == [
        (0, "insert", 5), (1, "not_found", None), (2, "update", None), (3, "not_found", None), (4, "conflict", None), (5, "not_found", None),
    ]


@pytest.mark.parametrize("w,h,want", [(256, 256, 0), (512, 512, 1), (1000, 1000, 2), (2000, 500, 3), (10000, 10000, 6)])
def test_max_zoom(spark, w, h, want):
    assert one(spark, geo.max_zoom(w, h, 256))[0] == want


def test_max_zoom_at_large_exact_power(spark):
    assert one(spark, geo.max_zoom(1 << 29, 1, 1))[0] == 29


@pytest.mark.parametrize("lo,hi,want", [(0, 2, 21), (0, 0, 1), (3, 3, 64), (0, 12, 22369621), (0, 16, 5726623061)])
def test_total_tiles(spark, lo, hi, want):
    assert one(spark, geo.total_tiles(lo, hi))[0] == want


def test_fit_and_prescale(spark):
    got = one(spark, geo.fit(F.lit(1), 1, 4000, 0, 256), geo.prescale(100, 0.5), geo.prescale(100, 1.0009), geo.prescale(1, 0.1))
    assert tuple(got) == (1, 50, 100, 1)


def test_mercator_curve(spark):
    y = lambda t: one(spark, geo.mercator_y(t))[0]
    assert math.isclose(y(0.0), 0.0, abs_tol=1e-12) and math.isclose(y(0.5), 0.5) and math.isclose(y(1.0), 1.0)
    for d in (0.1, 0.2, 0.3, 0.4, 0.49):
        assert math.isclose(y(0.5 - d) + y(0.5 + d), 1.0, abs_tol=1e-10)
    rows = spark.range(101).select(geo.mercator_y(F.col("id") / 100.0).alias("y"), geo.mercator_t(geo.mercator_y(F.col("id") / 100.0)).alias("t")).collect()
    assert all(a.y < b.y for a, b in zip(rows, rows[1:]))
    assert all(math.isclose(r.t, i / 100, abs_tol=1e-9) for i, r in enumerate(rows))


@pytest.mark.parametrize("grid", [4, 8])
def test_row_ranges_are_contiguous(spark, grid):
    low, high = geo.row_range(F.col("id"), grid)
    rows = spark.range(grid).select(low.alias("low"), high.alias("high")).collect()
    assert all(math.isclose(a.high, b.low, abs_tol=1e-10) for a, b in zip(rows, rows[1:]))


def test_strategy(spark):
    got = one(
        spark, geo.strategy(F.lit(True), 1000, 1000), geo.strategy(F.lit(True), 20000, 20000),
        geo.strategy(F.lit(False), 20000, 20000), geo.strategy(F.lit(False), F.lit(None).cast("int"), 5),
    )
    assert tuple(got) == ("naive", "row_streaming", "strip", "naive")


def test_geo_keys_and_bounds(spark):
    keys = F.array(*[F.lit(k) for k in (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 3857)])
    scale = F.array(*[F.lit(v) for v in (2.0, 3.0, 0.0)])
    tie = F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 10.0, 200.0, 0.0)])
    world = F.array(*[F.lit(v) for v in (-180.0, -90.0, 180.0, 90.0)])
    part = F.array(*[F.lit(v) for v in (-80.0, 35.0, -70.0, 45.0)])
    got = one(spark, geo.epsg(keys), geo.bounds(100, 50, scale, tie), geo.is_global(F.lit(4326), world), geo.is_global(F.lit(4326), part))
    assert got[0] == 3857 and got[1] == [10.0, 50.0, 210.0, 200.0] and got[2] is True and got[3] is False
    short = F.array(F.lit(1), F.lit(1))
    null = F.lit(None).cast("array<int>")
    assert tuple(one(spark, geo.epsg(short), geo.epsg(null))) == (None, None)


@pytest.mark.parametrize(
    "text_in,want",
    [("#FF8000", (255, 128, 0, 255)), ("0a0b0c0d", (10, 11, 12, 13)), ("##ffffff", (255, 255, 255, 255)), ("#fff", None), ("gg0000", None), ("", None)],
)
def test_hex_colour(spark, text_in, want):
    got = one(spark, color.parse_hex(F.lit(text_in)))[0]
    assert (tuple(got) if got else None) == want


def test_flatten_and_pack(spark):
    packed = color.pack(F.lit(200), F.lit(1), F.lit(2), F.lit(255))
    back = color.unpack(packed)
    got = one(spark, color.flatten_white(F.lit(0), F.lit(128)), *back.values())
    assert tuple(got) == (127, 200, 1, 2, 255)


def test_first_curve_positions(spark):
    order = [(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0)]
    df = spark.createDataFrame(order, "z int, x int, y int")
    got = [r[0] for r in df.select(archive.tile_id(F.col("z"), F.col("x"), F.col("y"))).collect()]
    assert got == [0, 1, 2, 3, 4, 5]


def test_curve_is_gap_free(spark):
    grid = geo.tile_grid(spark.range(1), 0, 5)
    ids = sorted(r[0] for r in grid.select(archive.tile_id(F.col("z"), F.col("tx"), F.col("ty"))).collect())
    assert ids == list(range(1365))


@pytest.mark.parametrize(
    "page,per_page,want",
    [(None, None, (50, 0)), (1, 20, (20, 0)), (3, 10, (10, 20)), (1, 200, (100, 0)), (1, 0, (1, 0)), (1, -5, (1, 0)), (0, 10, (10, 0)), (-3, 10, (10, 0))],
)
def test_page_window(page, per_page, want):
    assert catalog.page_window(page, per_page) == want


def test_limit_table(spark):
    for endpoint, limits in {"post_tiles": (5, 10, 60), "progress": (30, 60, 300), "download": (15, 30, 120), "mutations": (10, 30, 120)}.items():
        got = one(spark, *[ratelimit.limit_of(F.lit(endpoint), F.lit(p).cast("string")) for p in (None, "free", "pro")])
        assert tuple(got) == limits


def test_client_ip(spark):
    null = F.lit(None).cast("string")
    got = one(
        spark, text.client_ip(F.lit(" 1.1.1.1 "), F.lit("2.2.2.2"), F.lit("3.3.3.3")), text.client_ip(null, F.lit(" 2.2.2.2 , 9.9.9.9"), null),
        text.client_ip(null, null, F.lit("3.3.3.3")), text.client_ip(null, null, null),
    )
    assert tuple(got) == ("1.1.1.1", "2.2.2.2", "3.3.3.3", "unknown")


@pytest.mark.parametrize("name,want", [("maps/a.b.png", "a.b"), ("plain", "plain"), ("dir/.png", "Tileset 01234567"), (None, "Tileset 01234567"), ("", "Tileset 01234567")])
def test_tile_set_name(spark, name, want):
    assert one(spark, text.tile_set_name(F.lit(name).cast("string"), F.lit("0123456789")))[0] == want


@pytest.mark.parametrize(
    "key,want", [("tf_" + "a" * 32, True), ("xx_" + "a" * 32, False), ("tf_short", False), ("tf_" + "a" * 40, False), ("", False)]
)
def test_api_key_shape(spark, key, want):
    assert one(spark, validate.is_api_key(F.lit(key)))[0] is want


def test_percent(spark):
    cases = [(0, 0), (5, 10), (10, 10), (1, 3)]
    got = one(spark, *[jobs.percent(F.lit(d), F.lit(t)) for d, t in cases])
    assert tuple(got) == (0, 50, 99, 33)


def test_notification_limits(spark):
    rows = [("a" * 50, "b" * 200, "c" * 1000), ("a" * 51, "b" * 201, "c" * 1001), ("é" * 26, "b", None)]
    df = spark.createDataFrame(rows, "type string, title string, message string")
    got = [r.violations for r in validate.report(df, validate.NOTIFICATION).collect()]
    assert got == [[], ["type", "title", "message"], ["type"]]


def test_tile_set_rules(spark):
    good = ("map", "a-b_c.1", "flat", 256, "png", 85, 0, 5, 21, 10, "tiles/0a1b2c3d-0000-4000-8000-000000000001")
    names = "name string, slug string, projection string, tile_size int, tile_format string, tile_quality int, min_zoom int, max_zoom int, tile_count int, size_bytes int, storage_path string"
    bad_path = (*good[:-1], "tiles/0A1B2C3D-0000-4000-8000-000000000001")
    bad_size = (*good[:9], -1, good[10])
    bad_zoom = (*good[:7], 13, *good[8:])
    bad_projection = (*good[:2], "round", *good[3:])
    df = spark.createDataFrame([good, bad_path, bad_size, bad_zoom, bad_projection], names)
    got = [r.violations for r in validate.report(df, validate.TILE_SET).collect()]
    assert got == [[], ["storage_path"], ["counts"], ["zoom"], ["projection"]]


def test_error_classes(spark):
    texts = ["Heap exhausted", "bad decode", "HTTP 429", "lost it", "download failed: x"]
    got = [one(spark, text.error_class(F.lit(t)))[0] for t in texts]
    assert got == ["Out of Memory", "Invalid Image", "Rate Limited", "Something Went Wrong", "Download Failed"]
    assert one(spark, text.is_recoverable(F.lit("Corrupt file")))[0] is False
