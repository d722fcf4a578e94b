"""Plans for hot keys against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from rasterlake.operators import jobs, ratelimit, storage
from rasterlake.plans.hotkeys import attach, lookup, previous_value, running_sum
from rasterlake.plans.thinning import thin


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(50)}" if rng.random() < 0.9 else None, rng.randrange(1000)) for i in range(3000)]
    return data, spark.createDataFrame(data, "id long, k string, v long")


@pytest.mark.parametrize("floor", [0, 10**9])
def test_attach_equals_plain_join(rows, floor):
    data, df = rows
    per_key = df.filter("k IS NOT NULL").groupBy("k").agg(F.max("v").alias("top"), F.count("*").alias("_n"))
    want = {}
    for _, k, v in data:
        if k is not None:
            want[k] = max(v, want.get(k, 0))
    got = attach(df, per_key, ["k"], ["id"], hot_floor=floor).collect()
    assert len(got) == len(data) and all(r.top == want.get(r.k) for r in got)


def test_lookup_keeps_rows_without_match(rows):
    data, df = rows
    table = df.sparkSession.createDataFrame([("hot", 1), ("k1", 2)], "k string, flag int")
    got = lookup(df, table, ["k"], ["id"], hot_floor=0).collect()
    assert len(got) == len(data) and all(r.flag == {"hot": 1, "k1": 2}.get(r.k) for r in got)


def test_salt_is_part_of_the_shuffle_key(rows):
    _, df = rows
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup(df, spark.createDataFrame([("hot", 1)], "k string, flag int"), ["k"], ["id"], hot_floor=0)
        plan = joined.groupBy("k").agg(F.sum("flag"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    salted = [line for line in plan.splitlines() if "Exchange hashpartitioning(k#" in line and "_salt#" in line]
    assert len(salted) == 2, plan


def test_running_sum_and_previous(rows):
    data, df = rows
    keyed = df.filter("k IS NOT NULL")
    piece = F.floor(F.col("id") / 97)
    got = running_sum(keyed, ["k"], piece, ["id"], F.col("v"), "total")
    got = previous_value(got, ["k"], piece, ["id"], "v", "before")
    total, before = {}, {}
    want = {}
    for i, k, v in data:
        if k is not None:
            total[k] = total.get(k, 0) + v
            want[i] = (total[k], before.get(k))
            before[k] = v
    assert {r.id: (r.total, r.before) for r in got.collect()} == want


@pytest.mark.parametrize("pieces", [1, 3, 4096])
def test_thin_equals_fold(spark, pieces):
    rng = random.Random(7)
    data = [(rng.randrange(4), rng.randrange(-500, 3000)) for _ in range(1500)]
    got = thin(spark.createDataFrame(data, "k int, v long").withColumn("s", F.col("k") * 5 + 1), ["k"], "v", "s", pieces)
    want = set()
    for k in range(4):
        last = None
        for v in sorted({v for kk, v in data if kk == k}):
            if last is None or v - last >= k * 5 + 1:
                want.add((k, v))
                last = v
    assert {(r.k, r.v) for r in got.collect()} == want


@pytest.mark.parametrize("piece", [5, 10**6])
def test_admission_equals_fold(spark, piece):
    rng = random.Random(11)
    asked = [(i, 1 if rng.random() < 0.5 else rng.randrange(2, 12), i // 7, rng.randrange(1, 400)) for i in range(600)]
    requests = spark.createDataFrame(asked, "request_id long, user_id long, sec long, bytes long").withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    balance = spark.createDataFrame([(u, u * 10) for u in range(1, 11)], "user_id long, used_bytes long")
    got = {r.request_id: r.admitted for r in storage.admit(requests, balance, 4000, F.floor(F.unix_seconds("ts") / piece)).collect()}
    room = {u: 4000 - u * 10 for u in range(1, 11)}
    for i, u, _, size in asked:
        fits = u in room and size <= room[u]
        if fits:
            room[u] -= size
        assert got[i] is fits
    assert len(got) == len(asked)


def test_admission_steps_are_bounded(spark, monkeypatch):
    """Requests of 1, 100, 1, 99, 1, 98, ...: the room halves in every step, however many requests there are."""
    sizes = [s for k in range(100) for s in (1, 100 - k)]
    requests = spark.createDataFrame([(i, 1, s) for i, s in enumerate(sizes)], "request_id long, user_id long, bytes long").withColumn("ts", F.timestamp_seconds("request_id"))
    steps, one = [], storage._round
    monkeypatch.setattr(storage, "_round", lambda *a: steps.append(1) or one(*a))
    got = {r.request_id: r.admitted for r in storage.admit(requests, spark.createDataFrame([(1, 0)], "user_id long, used_bytes long"), 100).collect()}
    room, want = 100, {}
    for i, size in enumerate(sizes):
        want[i] = size <= room
        room -= size if want[i] else 0
    assert got == want and len(steps) <= 9


def test_null_and_busy_keys_are_spread(spark):
    """Nine tenths of the ids null and one busy user: no partition of the joined rows has more than a few times its share."""
    rows = spark.range(20_000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 10 == 0, F.when(F.col("id") % 20 == 0, F.lit(7)).otherwise(F.col("id"))).alias("user_id")
    )
    table = spark.range(20_000).select(F.col("id").alias("user_id"), F.lit("x").alias("plan"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        met = lookup(rows, table, ["user_id"], ["event_id"], hot_floor=500)
        sizes = [r.n for r in met.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 20_000 and max(sizes) <= 2 * 20_000 / len(sizes) and len(sizes) == 4
    assert met.filter("plan IS NOT NULL").count() == 2_000


def test_group_limits_run_before_the_shuffle(spark, tables):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "WindowGroupLimit" in plan(ratelimit.verdicts(tables("requests"), tables("users")))
    failures = tables("job_updates").filter("error IS NOT NULL")
    assert "WindowGroupLimit" in plan(jobs.attempts(failures))


def test_flood_in_one_window(spark):
    rows = [(i, None, "10.0.0.1", "post_tiles") for i in range(500)] + [(1000 + i, 1, "x", "post_tiles") for i in range(70)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, peer_ip string, endpoint string").withColumn("ts", F.timestamp_seconds(F.lit(90)))
    df = df.withColumn("cf_ip", F.lit(None).cast("string")).withColumn("forwarded_for", F.lit(None).cast("string"))
    users = spark.createDataFrame([(1, "pro")], "user_id long, plan string")
    got = ratelimit.verdicts(df, users).collect()
    assert sum(r.allowed for r in got if r.identity == "ip:10.0.0.1") == 5
    assert sum(r.allowed for r in got if r.identity == "user:1") == 60
    late = [r for r in got if not r.allowed]
    assert all(r.remaining == 0 and r.retry_after == 30 and r.reset == 120 for r in late)


@pytest.mark.parametrize("walked", [1_000_000, 2_000])
def test_admission_of_many_contested_requests(spark, walked):
    """A hundred thousand requests of one user, of which few fit, beside other users, requests without user or size, and an unknown user."""
    rng = random.Random(11)
    asked = [(i, 1, i // 3, rng.choice([1, 7, 50, 400, 9000])) for i in range(100_000)]
    asked += [(200_000 + i, i % 40, i, rng.randrange(200)) for i in range(2_000)]
    asked += [(300_000, None, 1, 1), (300_001, 2, 1, None), (300_002, 777, 1, 1), (300_003, 3, 0, 0)]
    balance = [(u, 100_000 - 60 * u) for u in range(40)] + [(None, 0)]
    rng.shuffle(asked)
    requests = spark.createDataFrame(asked, "request_id long, user_id long, sec long, bytes long").select(
        "request_id", "user_id", F.timestamp_seconds("sec").alias("ts"), "bytes")
    got = storage.admit(requests, spark.createDataFrame(balance, "user_id long, used_bytes long"), 102_000, walked=walked).collect()
    room, want = {u: 102_000 - b for u, b in balance if u is not None}, {}
    for i, u, _, size in sorted(asked, key=lambda r: (r[2], r[0])):
        want[i] = u in room and size is not None and size <= room[u]
        if want[i]:
            room[u] -= size
    assert len(got) == len(asked) and {r.request_id: r.admitted for r in got} == want
