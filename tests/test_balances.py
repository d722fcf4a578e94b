"""Balances from a stream of changes, replays included, and tile sets compared by digests."""

import random

import pytest
from pyspark.sql import functions as F

from rasterlake.operators import pyramid, storage
from rasterlake.sources import sinks
from rasterlake.streaming import balances

LOG = "op string, user_id long, old_bytes long, new_bytes long"


def changes(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(["insert", "delete", "update"]), rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(9), rng.randrange(9)) for _ in range(n)]


@pytest.mark.parametrize("every", [1, 2, 3, 32])
def test_balances_after_many_batches_and_a_replay(spark, tmp_path, every):
    start = spark.createDataFrame([(1, 10), (2, 0), (4, 7)], "user_id long, used_bytes long")
    inbox, folder, all_rows = tmp_path / "in", str(tmp_path / "out"), []
    for n in range(5):
        rows = changes(40, n)
        all_rows += rows
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(LOG).parquet(str(inbox))
        got = balances.drain(stream, start, folder, every)
        want = storage.apply_changes(start, spark.createDataFrame(all_rows, LOG))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    before = sorted(map(tuple, balances.balances(start, folder, every).collect()))

    class Replay:
        """Keeps the function that the writer calls for each micro-batch."""

        def __init__(self):
            self.writeStream = self

        def foreachBatch(self, save):
            self.save = save
            return self

    replay = Replay()
    balances.fold(replay, folder, every)
    replay.save(spark.createDataFrame(changes(40, 4), LOG), 4)
    assert sorted(map(tuple, balances.balances(start, folder, every).collect())) == before


def test_nothing_written_yet(spark, tmp_path):
    start = spark.createDataFrame([(1, 10)], "user_id long, used_bytes long")
    assert [tuple(r) for r in balances.balances(start, str(tmp_path / "none")).collect()] == [(1, 10)]


def test_compare_by_digests(spark):
    """Equal, unlike and one-sided tiles; a clear pixel equals a missing one; two swapped pixels are not equal."""
    schema = "raster_id int, z int, tx int, ty int, ox int, oy int, r int, g int, b int, a int"
    left = [(1, 0, 0, 0, 0, 0, 5, 5, 5, 255), (1, 0, 0, 0, 1, 0, 0, 0, 0, 0), (1, 0, 1, 0, 0, 0, 9, 1, 1, 9), (1, 0, 1, 0, 1, 0, 2, 1, 1, 9),
            (1, 0, 2, 0, 0, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0, 7, 0, 0, 1)]
    right = [(1, 0, 0, 0, 0, 0, 5, 5, 5, 255), (1, 0, 1, 0, 0, 0, 2, 1, 1, 9), (1, 0, 1, 0, 1, 0, 9, 1, 1, 9), (3, 0, 0, 0, 0, 0, 0, 0, 0, 4)]
    got = pyramid.compare(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 0, 0, 0, 1, 1, 0, 0, True), (1, 0, 1, 0, 1, 1, 2, 7, False), (1, 0, 2, 0, 1, 0, 0, 0, True), (2, 0, 0, 0, 1, 0, 1, 7, False),
        (3, 0, 0, 0, 0, 1, 1, 4, False),
    ]
    assert pyramid.compare(*[spark.createDataFrame([], schema)] * 2).count() == 0


def test_positions_are_the_places_in_the_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(3), z, rng.randrange(1 << z), rng.randrange(1 << z)) for z in range(8) for _ in range(60)]
    tiles = spark.createDataFrame(rows, "raster_id int, z int, tx int, ty int").repartition(7)
    placed = sinks.with_positions(sinks.in_tile_order(tiles)).collect()
    assert [r.position for r in sorted(placed, key=lambda r: r.position)] == list(range(len(rows)))
    assert [(r.raster_id, r.z, r.tx, r.ty) for r in sorted(placed, key=lambda r: r.position)] == sorted(rows, key=lambda r: (r[0], r[1], r[3], r[2]))
    assert sinks.with_positions(sinks.in_tile_order(tiles.filter(F.lit(False)))).count() == 0
