"""Byte ranges of tile ids by the archive directory, against a search run by run."""

import random

import pytest

from rasterlake.operators import archive


@pytest.mark.parametrize("piece", [4, 4096])
def test_ids_inside_and_between_runs(spark, piece):
    """Runs over several pieces, gaps, neighbours without a gap, a raster without runs, and one id that most requests are for."""
    rng = random.Random(piece)
    runs, at = [], 0
    for n in range(60):
        at += rng.choice([0, 0, 1, 5, 30])
        size = rng.choice([1, 1, 2, 9, 40])
        runs.append((n % 2, at, size, n * 100, 10 + n))
        at += size
    asked = [(i, rng.randrange(3), rng.randrange(-2, at + 50)) for i in range(3000)] + [(5000 + i, 0, runs[0][1]) for i in range(2000)]
    got = archive.directory_lookup(
        spark.createDataFrame(asked, "request_id long, raster_id int, tile_id long"),
        spark.createDataFrame(runs, "raster_id int, tile_id long, run_length long, offset long, length long"), piece,
    ).collect()
    want = {}
    for i, raster, tile in asked:
        hit = [(o, size) for r, start, n, o, size in runs if r == raster and start <= tile < start + n]
        want[i] = hit[0] if hit else (None, None)
    assert len(got) == len(asked) and {r.request_id: (r.offset, r.length) for r in got} == want


def test_empty_tables(spark):
    runs = spark.createDataFrame([], "raster_id int, tile_id long, run_length long, offset long, length long")
    asked = spark.createDataFrame([(1, 1, 7)], "request_id long, raster_id int, tile_id long")
    assert [tuple(r) for r in archive.directory_lookup(asked, runs).collect()] == [(1, 1, 7, None, None)]
    assert archive.directory_lookup(asked.limit(0), runs).count() == 0
