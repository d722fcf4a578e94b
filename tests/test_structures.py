"""Stored pixels, committed tile files, routes by size and search by pieces: what their queries over the tables don't show."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rasterlake.operators import encode, raster, routing, search
from rasterlake.sources import pixels, tilefiles

PIXEL = "raster_id long, width int, height int, x int, y int, r int, g int, b int, a int"


def wide_image(spark, sizes):
    df = spark.createDataFrame(sizes, "raster_id long, width int, height int")
    df = df.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    level = lambda k: F.pmod(F.xxhash64("raster_id", "x", "y", F.lit(k)), F.lit(256)).cast("int")
    return df.select("raster_id", "width", "height", "x", "y", *[level(k).alias(c) for k, c in enumerate("rgb")], F.lit(255).alias("a"))


def scanned_rows(df):
    """Rows that the scans of the plan gave, from its own metrics, and the filters pushed to them."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in plan.getClass().getSimpleName():
        plan = plan.executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        inner = node.children().toList()
        todo += [inner.apply(i) for i in range(inner.size())]
        if hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
    return total


def test_strips_read_their_lines_only(spark, tmp_path):
    folder = str(tmp_path / "px")
    px = wide_image(spark, [(1, 64, 512), (2, 32, 40)])
    pixels.write_pixels(px, folder, group_rows=1024)
    stored = spark.read.parquet(f"{folder}/lines")
    assert stored.count() == px.count() and pixels.read_sizes(spark, folder).count() == 2
    wanted = spark.createDataFrame([(1, 100, 116)], "raster_id long, row_low int, row_high int")
    lines = pixels.read_lines(spark, folder, wanted)
    assert lines.count() == 16 * 64 and {r.y for r in lines.select("y").distinct().collect()} == set(range(100, 116))
    few = scanned_rows(stored.filter(pixels._bounds(wanted)))
    assert 16 * 64 <= few <= 64 * 512 // 4  # row groups outside are not read
    every = scanned_rows(stored.filter(pixels._bounds(wanted.withColumn("row_low", F.lit(0)).withColumn("row_high", F.lit(512)))))
    assert every >= 64 * 512
    assert pixels.read_lines(spark, folder, wanted.limit(0)).count() == 0


@pytest.mark.parametrize("projection", ["flat", "mercator"])
def test_all_strips_make_all_tiles(spark, tmp_path, projection):
    folder = str(tmp_path / "px")
    px = wide_image(spark, [(1, 40, 64), (-5, 16, 9)])
    pixels.write_pixels(px, folder, group_rows=64)
    want = raster.extract_windows(px, 16, 2, projection)
    got = None
    for ty in range(4):
        strip = pixels.strip_tiles(spark, folder, 16, 2, projection, ty)
        got = strip if got is None else got.unionByName(strip)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_routes_give_equal_bytes(spark):
    px = wide_image(spark, [(1, 40, 64), (2, 16, 9), (3, 10, 10)]).cache()
    want = sorted((r.raster_id, r.tx, r.ty, bytes(r.rgba)) for r in encode.window_blocks(px, 16, 2).collect())
    for limit in (0, 500, 1 << 20):
        got = routing.routed_windows(px, 16, 2, limit=limit)
        assert sorted((r.raster_id, r.tx, r.ty, bytes(r.rgba)) for r in got.collect()) == want
    routes = px.groupBy("raster_id").agg(F.first(routing.route(500)).alias("route")).orderBy("raster_id")
    assert [r.route for r in routes.collect()] == ["row", "row", "block"]


def some_tiles(spark, ids, zooms=(0, 1)):
    rows = [(i, z, x, 0, f"{i}/{z}/{x}".encode()) for i in ids for z in zooms for x in range(2**z)]
    return spark.createDataFrame(rows, "raster_id long, z int, tx int, ty int, content binary")


def seen(spark, root, zoom=None):
    return sorted((r.raster_id, r.z, r.tx, r.ty, bytes(r.content)) for r in tilefiles.read_committed(spark, root, zoom).collect())


def test_tile_files_come_all_at_once(spark, tmp_path):
    root = str(tmp_path / "tiles")
    first = some_tiles(spark, [1, 2])
    tilefiles.write_committed(first.repartition(3), root)
    want = sorted((r.raster_id, r.z, r.tx, r.ty, bytes(r.content)) for r in first.collect())
    assert seen(spark, root) == want
    assert seen(spark, root, 1) == [r for r in want if r[1] == 1] and seen(spark, root, 7) == []
    files = {str(p.relative_to(tmp_path)).split("/", 4)[-1] for p in tmp_path.glob("tiles/data/*/*/*/*/*/*.png")}
    assert files == {f"{i}/{z}/{x}/0.png" for i, z, x, _, _ in want}

    tilefiles.write_committed(some_tiles(spark, [3]), root)
    assert {r[0] for r in seen(spark, root)} == {1, 2, 3}
    tilefiles.write_committed(some_tiles(spark, [4]), root, mode="overwrite")
    assert {r[0] for r in seen(spark, root)} == {4}
    tilefiles.write_committed(some_tiles(spark, []), root)
    assert {r[0] for r in seen(spark, root)} == {4}


def test_a_failed_task_leaves_no_tile(spark, tmp_path):
    root = str(tmp_path / "tiles")
    tilefiles.write_committed(some_tiles(spark, [1]), root)
    before = seen(spark, root)
    bad = some_tiles(spark, range(10, 30)).repartitionByRange(4, "raster_id").withColumn(
        "content", F.when(F.col("raster_id") == 29, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content"))
    )
    with pytest.raises(PySparkException):
        tilefiles.write_committed(bad, root)
    assert seen(spark, root) == before
    assert len(list((tmp_path / "tiles" / "data").iterdir())) == 1  # what the job had written is gone


def test_empty_root_has_no_tiles(spark, tmp_path):
    assert seen(spark, str(tmp_path / "nothing")) == []


def test_postings_are_made_without_a_shuffle(spark):
    """One row for each piece and batch of names, with the ids of all names that have it."""
    named = [(1, "Abab"), (2, None), (3, "ab"), (3, "AB"), (4, "日本"), (5, "")]
    made = search.postings(spark.createDataFrame(named, "id long, name string").coalesce(1), "id")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r.piece: sorted(r.ids) for r in made.collect()} == {
        "": [1, 3, 3, 4, 5], "a": [1, 3, 3], "b": [1, 3, 3], "ab": [1, 3, 3], "ba": [1], "aba": [1], "bab": [1],
        "日": [4], "本": [4], "日本": [4],
    }
    assert search.postings(made.limit(0).select(F.lit(1).alias("id"), F.lit("x").alias("name")), "id").count() == 0


def test_search_finds_what_a_scan_finds(spark, tmp_path):
    named = ["Alpha_map%1", "ALPHABET", "aaaa", "", None, "ab", "é É ß", "10% off", "a_b", "x" * 300, "banana", "map map", "日本語の地図"]
    names = spark.createDataFrame(list(enumerate(named)), "id long, name string")
    texts = ["", "a", "AB", "abc", "alpha", "_map%", "%", "É", "aaa", "aaaaa", "nan", "ANANA", "map m", "本語の", "zzzz", "x" * 299, None, "a"]
    search.write_index(names, str(tmp_path / "i"), "id")
    asked = spark.createDataFrame([(t,) for t in texts], "text string")
    got = search.matches(spark, str(tmp_path / "i"), names, asked, "id")
    assert got.columns == ["text", "id", "name"]
    want = sorted((t, i) for t in set(texts) - {None} for i, n in enumerate(named) if n is not None and t.lower() in n.lower())
    assert sorted((r.text, r.id) for r in got.collect()) == want
    for text in ("", "AB", "anana", "aaaa"):
        ids = {r.id for r in search.candidates(spark, str(tmp_path / "i"), text).collect()}
        assert {i for t, i in want if t.lower() == text.lower()} <= ids
    search.write_index(names.limit(0), str(tmp_path / "none"), "id")
    assert search.matches(spark, str(tmp_path / "none"), names, asked, "id").count() == 0
