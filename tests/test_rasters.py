"""Raster operators on small images against plain Python."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.functions.color import Background
from rasterlake.operators import encode, pyramid, raster, tiling
from rasterlake.sources import images, sinks

PIXELS = "raster_id long, width int, height int, x int, y int, r int, g int, b int, a int"


def image(spark, array, raster_id=1):
    h, w, _ = array.shape
    rows = [(raster_id, w, h, x, y, *map(int, array[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, PIXELS)


def solid(w, h, colour):
    return np.tile(np.array(colour, np.uint8), (h, w, 1))


def dense(df, n, x="x", y="y"):
    out = np.zeros((n, n, 4), np.uint8)
    for r in df.collect():
        out[r[y], r[x]] = (r.r, r.g, r.b, r.a)
    return out


def test_solid_image_has_all_tiles(spark):
    px = image(spark, solid(32, 32, (255, 0, 0, 255)))
    tiles = tiling.cut_images(px, tiling.TileConfig(tile_size=16))
    per_zoom = {r.z: r.n for r in tiles.groupBy("z").agg(F.countDistinct("tx", "ty").alias("n")).collect()}
    assert per_zoom == {0: 1, 1: 4}
    assert tiles.filter("ox IS NULL AND a = 0").count() == 5
    assert tiles.filter("ox IS NOT NULL AND (r <> 255 OR g <> 0 OR b <> 0 OR a <> 255)").count() == 0


def test_every_tile_of_the_grid_is_made(spark):
    """A 512 square in tiles of 256 has 1 + 4 tiles; a wide image has blank ones too, as many as the summary says."""
    for w, h in ((512, 512), (512, 100)):
        px = image(spark, solid(8, 8, (1, 2, 3, 255))).withColumn("width", F.lit(w)).withColumn("height", F.lit(h))
        said = raster.run_summary(px.select("raster_id", "width", "height").distinct().withColumns({"tile_size": F.lit(256), "max_zoom": F.lit(None).cast("int")}))
        for method in ("naive", "window"):
            made = tiling.cut_images(px, tiling.TileConfig(tile_size=256, method=method)).select("z", "tx", "ty").distinct().count()
            assert made == said.first().total_tiles == 5


def test_blank_tiles_share_one_file(spark):
    px = image(spark, solid(32, 4, (9, 9, 9, 255)))
    files = tiling.encode_images(px, tiling.TileConfig(tile_size=8, background=Background(1, 2, 3, 255))).collect()
    assert len(files) == 21 and len({bytes(f.content) for f in files if f.z == 2 and f.ty > 0}) == 1


def test_large_blocks_and_images_are_read_quickly(spark, tmp_path):
    """Both take time in proportion to their size: seconds here, where a quadratic form would take hours."""
    side = 256
    raw = np.random.default_rng(3).integers(0, 256, (side, side, 4), dtype=np.uint8)
    blocks = spark.createDataFrame([(1, 0, 0, k, bytearray(raw.tobytes())) for k in range(8)], "raster_id long, z int, tx int, ty int, rgba binary")
    px = encode.unpack_blocks(blocks, side)
    assert px.count() == 8 * side * side
    assert px.filter("ty = 3 AND ox = 5 AND oy = 7").first()[-4:] == tuple(int(v) for v in raw[7, 5])
    big = np.random.default_rng(4).integers(0, 256, (1024, 1024, 4), dtype=np.uint8)
    (tmp_path / "big.png").write_bytes(encode.png_bytes(big.tobytes(), 1024))
    samples = images.read_samples(spark, str(tmp_path))
    assert samples.count() == 4 * 1024 * 1024
    assert [int(r.v) for r in samples.filter("x = 10 AND y = 1000").orderBy("channel").collect()] == big[1000, 10].tolist()
    one = images.read_images(spark, str(tmp_path)).select("width", "channels", F.slice("samples", 1, 4).alias("s")).first()
    assert (one.width, one.channels, [int(v) for v in one.s]) == (1024, 4, big[0, 0].tolist())


def test_many_images_of_nested_folders_are_read_together(spark, tmp_path):
    """Images of two sizes in folders of different depths, of one task; other files are left out."""
    rng = np.random.default_rng(6)
    want = {}
    for k, folder in enumerate(["", "a", "a/b", "c/d/e"] * 5):
        place = tmp_path / folder
        place.mkdir(parents=True, exist_ok=True)
        raw = rng.integers(0, 256, (2 + k % 2, 2 + k % 2, 4), dtype=np.uint8)
        (place / f"{k}.png").write_bytes(encode.png_bytes(raw.tobytes(), 2 + k % 2))
        (place / f"{k}.txt").write_bytes(b"text")
        want |= {(k, 2 + k % 2, x, y, c): float(raw[y, x, c]) for y, x, c in np.ndindex(raw.shape)}
    read = images.read_samples(spark, str(tmp_path), "*.png").select(F.regexp_extract("origin", r"(\d+)\.png$", 1).cast("int").alias("k"), "*")
    got = read.collect()
    assert {(r.k, r.width, r.x, r.y, r.channel): r.v for r in got} == want and len(got) == len(want)
    batch = [(type("Image", (), dict(origin=str(k), width=1, height=1, nChannels=1))(), 0, np.full((1, 1, 1), k, np.uint8)) for k in range(3)]
    assert images._sample_rows(batch)["v"].tolist() == [0.0, 1.0, 2.0]


def _png(rows, colour, filters, extra=b""):
    """A PNG of 8 bits a sample with the given filter (0, 1 or 2) of each row."""
    raw, before = b"", np.zeros_like(rows[0])
    for row, kind in zip(rows, filters):
        left = np.concatenate([np.zeros_like(row[:1]), row[:-1]])
        raw += bytes([kind]) + (row - (left if kind == 1 else before if kind == 2 else 0)).astype(np.uint8).tobytes()
        before = row
    head = struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, colour, 0, 0, 0)
    parts = encode._chunk(b"IHDR", head) + extra + encode._chunk(b"IDAT", zlib.compress(raw)) + encode._chunk(b"IEND", b"")
    return encode.PNG_SIGNATURE + parts


def _image_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_plain_folders_are_read_as_by_the_image_source(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    for k, (colour, channels) in enumerate([(0, 1), (2, 3), (6, 4)] * 4):
        folder = tmp_path / ["", "a b", "c/d%é"][k % 3]
        folder.mkdir(parents=True, exist_ok=True)
        rows = rng.integers(0, 256, (3, 4 + k % 2, channels), dtype=np.uint8)
        (folder / f"{k}#.png").write_bytes(_png(rows, colour, rng.integers(0, 3, 3).tolist()))
        (folder / "text.txt").write_bytes(b"text")
    (tmp_path / "_left").mkdir()
    (tmp_path / "_left" / "x.png").write_bytes(b"no image")
    (tmp_path / ".x.png").write_bytes(b"no image")
    assert images._plain_files(spark, str(tmp_path), "*.png") is not None
    got = _image_rows(images._decoded(spark, str(tmp_path), "*.png"))
    monkeypatch.setattr(images, "_plain_files", lambda *_: None)
    assert len(got) == 12 and got == _image_rows(images._decoded(spark, str(tmp_path), "*.png"))


def test_folders_with_other_files_go_through_the_image_source(spark, tmp_path):
    good = _png(np.full((2, 2, 4), 9, np.uint8), 6, [0, 0])
    (tmp_path / "a.png").write_bytes(good)
    assert images._plain_files(spark, str(tmp_path), "*.png") is not None
    text = encode._chunk(b"tEXt", b"a\0b")
    for content in (b"", b"no image", good[:-20], good + b"x", good.replace(b"IDAT", b"IDAX"), _png(np.full((2, 2, 4), 9, np.uint8), 6, [0, 0], text)):
        assert images.plain_png(content) is None
    (tmp_path / "b.png").write_bytes(b"no image")
    (tmp_path / "c.png").write_bytes(_png(np.full((2, 2, 4), 9, np.uint8), 6, [0, 0], text))
    assert images._plain_files(spark, str(tmp_path), "*.png") is None
    assert images.read_samples(spark, str(tmp_path), "*.png").count() == 2 * 16


def test_wide_windows_take_the_relational_form(spark):
    array = np.random.default_rng(5).integers(0, 256, (40, 70, 4), dtype=np.uint8)
    px = image(spark, array)
    got = {(r.tx, r.ty): bytes(r.rgba) for r in encode.window_blocks(px, 4, 1).collect()}
    want = {(r.tx, r.ty): bytes(r.rgba) for r in encode._gathered(px, 4, 1, "flat").collect()}
    assert got == want and len(got) > 1


def test_square_is_dealt_out(spark):
    plan = raster.fill(image(spark, solid(4, 4, (1, 1, 1, 1))).selectExpr("raster_id", "0 AS z", "4 AS canvas", "x", "y", "r", "g", "b", "a"), spark.sql("SELECT 1L AS raster_id, 0 AS z, 2048 AS canvas"), Background(0, 0, 0, 0))
    assert plan.count() == 2048 * 2048


@pytest.mark.parametrize("projection", ["flat", "mercator"])
def test_window_method_keeps_solid_images(spark, projection):
    px = image(spark, solid(32, 16, (10, 200, 30, 255)))
    tiles = raster.extract_windows(px, 8, 2, projection)
    assert tiles.filter("r <> 10 OR g <> 200 OR b <> 30 OR a <> 255").count() == 0
    if projection == "mercator":  # the bottom row is opaque too
        assert tiles.filter("ty = 3").count() == 4 * 64


def test_two_colour_image(spark):
    array = solid(16, 8, (255, 0, 0, 255))
    array[:, 8:] = (0, 0, 255, 255)
    tiles = tiling.cut_images(image(spark, array), tiling.TileConfig(tile_size=4, max_zoom=2))
    top = tiles.filter("z = 2 AND ox IS NOT NULL")
    assert top.filter("tx <= 1 AND r <> 255").count() == 0 and top.filter("tx >= 2 AND b <> 255").count() == 0
    assert top.agg(F.max("ty")).first()[0] == 1


def test_same_size_resample_copies(spark):
    array = np.random.default_rng(1).integers(0, 256, (7, 9, 4), dtype=np.uint8)
    px = image(spark, array).withColumn("w2", F.col("width")).withColumn("h2", F.col("height"))
    got = raster.resample(px, ["raster_id", "width", "height", "w2", "h2"], "width", "height", "w2", "h2")
    for r in got.collect():
        assert (r.r, r.g, r.b, r.a) == tuple(array[r.y, r.x])


def test_block_resize_equals_relational(spark):
    array = np.random.default_rng(2).integers(0, 256, (11, 13, 4), dtype=np.uint8)
    px = image(spark, array).withColumn("w2", F.lit(5)).withColumn("h2", F.lit(17))
    got = raster.resample(px, ["raster_id", "width", "height", "w2", "h2"], "width", "height", "w2", "h2")
    want = encode._resize(array.astype(float), 17, 5, {})
    for r in got.collect():
        assert (r.r, r.g, r.b, r.a) == tuple(want[r.y, r.x])


def test_four_tiles_merge(spark):
    colours = {(0, 0): (255, 0, 0, 255), (1, 0): (0, 255, 0, 255), (0, 1): (0, 0, 255, 255), (1, 1): (255, 255, 255, 255)}
    rows = [(1, 1, tx, ty, x, y, *c) for (tx, ty), c in colours.items() for x in range(4) for y in range(4)]
    level = spark.createDataFrame(rows, "raster_id long, z int, tx int, ty int, ox int, oy int, r int, g int, b int, a int")
    merged = pyramid.merge(level, 4)
    out = dense(merged, 4, "ox", "oy")
    assert merged.select("z", "tx", "ty").distinct().collect() == [(0, 0, 0)]
    assert tuple(out[0, 0]) == (255, 0, 0, 255) and tuple(out[3, 3]) == (255, 255, 255, 255) and out[..., 3].min() == 255
    blocks = encode.merge_blocks(encode.pack_blocks(level, 4), 4).first()
    assert np.array_equal(np.frombuffer(bytes(blocks.rgba), np.uint8).reshape(4, 4, 4), out)


def test_rasters_with_different_depths(spark):
    px = image(spark, solid(32, 32, (255, 0, 0, 255)), 1).unionByName(image(spark, solid(8, 8, (0, 255, 0, 255)), 2))
    tiles = tiling.cut_images(px, tiling.TileConfig(tile_size=8, method="window"))
    found = {(r.raster_id, r.z): r.n for r in tiles.groupBy("raster_id", "z").agg(F.countDistinct("tx", "ty").alias("n")).collect()}
    assert found == {(1, 0): 1, (1, 1): 4, (1, 2): 16, (2, 0): 1}
    blocks = encode.build_blocks(encode.pack_blocks(tiles.filter("ox IS NOT NULL AND (z = 2 OR raster_id = 2)"), 8), 8, 2)
    assert {(r.raster_id, r.z): r["count"] for r in blocks.groupBy("raster_id", "z").count().collect()} == found


def test_deep_pyramid_with_checkpoint(spark):
    px = image(spark, solid(64, 64, (7, 8, 9, 255)))
    tiles = pyramid.build(raster.extract_windows(px, 2, 5, "flat"), 2, 5, 0, cut_every=2)
    assert {r.z: r["count"] for r in tiles.groupBy("z").count().collect()} == {z: 4 * 4**z for z in range(6)}
    assert tiles.filter("r <> 7 OR g <> 8 OR b <> 9 OR a <> 255").count() == 0


@pytest.mark.parametrize("size", [1, 2, 3])
def test_merge_of_tiny_tiles_keeps_solid(spark, size):
    rows = [(1, 1, tx, ty, x, y, 9, 8, 7, 255) for tx in range(2) for ty in range(2) for x in range(size) for y in range(size)]
    level = spark.createDataFrame(rows, "raster_id long, z int, tx int, ty int, ox int, oy int, r int, g int, b int, a int")
    assert {(r.r, r.g, r.b, r.a) for r in pyramid.merge(level, size).collect()} == {(9, 8, 7, 255)}


def test_float_samples(spark):
    df = spark.createDataFrame([(1, 2, 2, 1, [10.0, 20.0, 30.0, 40.0])], "raster_id long, width int, height int, channels int, samples array<double>")
    samples, rejected = raster.explode_samples(df)
    got = {(r.x, r.y): r.r for r in raster.band_pixels(raster.stretch(samples, ["raster_id", "channel"])).collect()}
    assert got == {(0, 0): 0, (1, 0): 85, (0, 1): 170, (1, 1): 255} and rejected.count() == 0


def test_odd_samples(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, [nan, inf, 5.0, 5.0]), (2, [0.0, 0.0, 0.0, -inf])], "raster_id long, s array<double>")
    df = df.selectExpr("raster_id", "2 AS width", "2 AS height", "1 AS channels", "s AS samples")
    samples, _ = raster.explode_samples(df)
    got = raster.stretch(samples, ["raster_id", "channel"]).groupBy("raster_id").agg(F.sort_array(F.collect_list("level")).alias("l"))
    assert {r.raster_id: r.l for r in got.collect()} == {1: [0, 0, 255, 255], 2: [0, 0, 0, 0]}


def test_background_fills_clear_pixels(spark):
    array = solid(4, 2, (100, 100, 100, 0))
    array[0, 0] = (10, 20, 30, 255)
    levels = raster.at_zooms(image(spark, array), 4, 0, 0)
    bg = Background(1, 2, 3, 255)
    sizes = levels.groupBy("raster_id", "z", "canvas").agg(F.lit(1).alias("one"))
    out = dense(raster.fill(raster.canvas(levels, "flat", bg), sizes, bg), 4)
    assert tuple(out[3, 3]) == (1, 2, 3, 255) and tuple(out[0, 0]) == (10, 20, 30, 255) and tuple(out[1, 2]) == (1, 2, 3, 255)


def test_isometric_keeps_centre(spark):
    levels = raster.at_zooms(image(spark, solid(16, 16, (50, 60, 70, 255))), 16, 0, 0)
    out = dense(raster.canvas(levels, "isometric"), 16)
    assert tuple(out[8, 8]) == (50, 60, 70, 255) and out[0, 0, 3] == 0


def test_png_files_read_back(spark, tmp_path):
    array = np.random.default_rng(3).integers(0, 256, (4, 4, 4), dtype=np.uint8)
    array[..., 3] = 255
    folder = tmp_path / "images"
    folder.mkdir()
    (folder / "a.png").write_bytes(encode.png_bytes(array.tobytes(), 4))
    (folder / "broken.png").write_bytes(b"not an image")
    read = images.read_images(spark, str(folder))
    row = read.collect()
    assert len(row) == 1 and (row[0].width, row[0].height, row[0].channels) == (4, 4, 4)
    assert np.array_equal(np.array(row[0].samples, np.uint8).reshape(4, 4, 4), array)
    sniffed = {r.path.rsplit("/", 1)[1]: r for r in images.sniff_headers(images.read_files(spark, str(folder))).collect()}
    assert sniffed["a.png"].width == 4 and sniffed["a.png"].is_png and not sniffed["broken.png"].is_png


@pytest.mark.parametrize(
    "data,want", [(b"II\x2a\x00", True), (b"MM\x00\x2a", True), (b"II\x2b\x00", True), (b"MM\x00\x2b", True), (b"\x89PNG", False),
                  (b"\xff\xd8\xff\xe0", False), (b"RIFF", False), (b"II", False), (b"", False)],
)
def test_tiff_magic(spark, data, want):
    df = spark.createDataFrame([(bytearray(data),)], "content binary")
    assert images.sniff_headers(df).first().is_tiff is want


def test_png_header_size(spark):
    head = b"\x89PNG\r\n\x1a\n\x00\x00\x00\x0dIHDR" + (320).to_bytes(4, "big") + (240).to_bytes(4, "big")
    df = spark.createDataFrame([(bytearray(head),), (bytearray(head[:23]),), (bytearray(b"x" * 30),)], "content binary")
    assert [(r.width, r.height) for r in images.sniff_headers(df).collect()] == [(320, 240), (None, None), (None, None)]


def test_tile_table_is_partitioned_and_ordered(spark, tmp_path):
    rows = [(1, z, x, y, bytearray(b"t")) for z in range(3) for x in range(2**z) for y in range(2**z)]
    tiles = spark.createDataFrame(rows, "raster_id long, z int, tx int, ty int, content binary")
    seen_rows, seen = sinks.watched(tiles, "tiles")
    sinks.write_tiles(seen_rows, str(tmp_path / "t"))
    back = sinks.read_tiles(spark, str(tmp_path / "t"))
    assert back.count() == 21 and seen.get["rows"] >= 21
    assert back.filter("z = 1").select("path").distinct().count() == 4
    plan = back.filter("z = 1 AND tx = 0")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(z" in plan and "PushedFilters: [IsNotNull(tx), EqualTo(tx,0)]" in plan


def _two_sizes(spark, height=24):
    px = spark.range(3 * 32 * 24).select(
        F.floor(F.col("id") / 768).alias("raster_id"), F.lit(32).alias("width"), F.lit(height).alias("height"), (F.col("id") % 32).cast("int").alias("x"),
        F.floor(F.col("id") % 768 / 32).cast("int").alias("y"), *[(F.xxhash64("id", F.lit(c)) % 256).cast("int").alias(c) for c in "rgba"],
    )
    return px.withColumns({c: F.abs(c) for c in "rgba"})


def test_small_rasters_are_resampled_with_one_shuffle(spark):
    px = _two_sizes(spark)
    for df in (
        raster.flat_canvas(raster.at_zooms(px, 10, 0, 2)), raster.extract_windows(px, 10, 2, "flat"), raster.prescale(px, 0.5),
        raster.resample_columns(raster.at_zooms(px, 10, 0, 2, "y"), raster.LEVEL, "width", "fit_w"),
    ):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_rasters_by_line_and_as_a_whole_give_the_same(spark, monkeypatch):
    px = _two_sizes(spark)

    def found():
        frames = (raster.flat_canvas(raster.at_zooms(px, 10, 0, 2)), raster.extract_windows(px, 10, 2, "mercator"), raster.prescale(px, 0.5))
        return [sorted(map(tuple, df.collect())) for df in frames]

    whole = found()
    monkeypatch.setattr(raster, "WHOLE", 0)
    assert found() == whole and all(whole)


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("projection,by", [("flat", "x"), ("mercator", "y"), ("isometric", "x")])
def test_canvases_of_small_rasters_need_no_join(spark, projection, by):
    px, bg = _two_sizes(spark), Background(1, 2, 3, 255)
    assert _shuffles(raster.canvas(raster.at_zooms(px, 10, 0, 2, by), projection)) == 1
    # One for the pixels and one for the sizes that the grid is made of.
    assert _shuffles(raster.filled_canvas(raster.at_zooms(px, 10, 0, 2, by), projection, bg)) == 2


@pytest.mark.parametrize("projection,by,height", [("flat", "x", 24), ("mercator", "y", 24), ("mercator", "y", 1), ("isometric", "x", 24)])
def test_canvases_by_line_and_as_a_whole_give_the_same(spark, monkeypatch, projection, by, height):
    px, bg = _two_sizes(spark, height).filter(F.col("y") < height), Background(1, 2, 3, 200)

    def found():
        levels = raster.at_zooms(px, 10, 0, 2, by)
        drawn = raster.canvas(levels, projection, bg)
        sizes = levels.select("raster_id", "z", "canvas").distinct()
        full = raster.filled_canvas(levels, projection, bg)
        assert sorted(map(tuple, full.collect())) == sorted(map(tuple, raster.fill(drawn, sizes, bg).collect()))
        return sorted(map(tuple, drawn.collect()))

    whole = found()
    monkeypatch.setattr(raster, "SIDE", 20)
    assert found() == whole and whole


def test_pyramids_are_compared_with_the_shuffle_of_their_pixels(spark, monkeypatch):
    px = _two_sizes(spark)

    def compared(held):
        return pyramid.compare(pyramid.strip_pyramid(px, 10, 2, held=held), pyramid.naive_pyramid(px, 10, 0, 2, held=held))

    whole = compared(True)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "hashpartitioning" in whole._jdf.queryExecution().executedPlan().toString() and "LogicalRDD" not in plan
    assert _shuffles(whole) == plan.count("RepartitionByExpression")
    want = sorted(map(tuple, whole.collect()))
    assert want == sorted(map(tuple, compared(False).collect())) and any(not r[-1] for r in want)
    monkeypatch.setattr(raster, "WHOLE", 0)
    assert want == sorted(map(tuple, compared(True).collect()))
