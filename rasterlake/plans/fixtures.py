"""Views that map the star-schema test tables onto the engine's schemas.

Each view is one SQL text that runs unchanged on Spark (session zone UTC) and on the SQL engine used for
checking; two of them differ by dialect. Keys are plain arithmetic so both engines agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Sizes of the derived rasters.
HEAT_WIDTH, HEAT_HEIGHT = 32, 24

VIEWS: dict[str, str] = {
    "heat_pixels": """
SELECT raster_id, 32 AS width, 24 AS height, x, y,
       CAST(cents % 256 AS INT) AS r, CAST(floor(cents / 256) % 256 AS INT) AS g, CAST((n * 40) % 256 AS INT) AS b,
       CASE WHEN n % 3 = 0 THEN 255 ELSE CAST((n * 60) % 256 AS INT) END AS a
FROM (
  SELECT l_suppkey AS raster_id, CAST((l_partkey * 7) % 32 AS INT) AS x, CAST((l_orderkey + l_linenumber * 5) % 24 AS INT) AS y,
         CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, COUNT(*) AS n
  FROM lineitem GROUP BY 1, 2, 3) q""",
    "image_dims": """
SELECT p_partkey AS raster_id,
       CAST(CASE WHEN p_partkey % 10 = 0 THEN 256 * pow(2, p_partkey % 7) ELSE 1 + (p_partkey * 7919) % 20000 END AS INT) AS width,
       CAST(1 + (p_partkey * 104729 + p_size * 31) % 20000 AS INT) AS height,
       CASE p_size % 4 WHEN 0 THEN 128 WHEN 1 THEN 256 WHEN 2 THEN 512 ELSE 64 END AS tile_size,
       CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 15 END AS max_zoom,
       CASE p_partkey % 5 WHEN 0 THEN 'flat' WHEN 1 THEN 'mercator' WHEN 2 THEN 'isometric' WHEN 3 THEN NULL ELSE 'cylindrical' END AS projection,
       CASE p_partkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' ELSE 'gif' END AS tile_format,
       CAST((p_partkey * 13) % 110 AS INT) AS quality
FROM part""",
    "users": """
SELECT c_custkey AS user_id, c_name AS username, lower(concat('u', CAST(c_custkey % 100 AS STRING), '@example.test')) AS email,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'pro' ELSE 'free' END AS plan,
       CASE WHEN c_custkey % 7 = 0 THEN CAST('2024-01-01' AS TIMESTAMP) WHEN c_custkey % 11 = 0 THEN CAST('2023-11-15' AS TIMESTAMP) END AS deactivated_at,
       concat('cus_', CAST(c_custkey AS STRING)) AS customer_ref
FROM customer""",
    "projects": """
SELECT c_custkey * 10 + k AS project_id, c_custkey AS user_id, concat('Project ', CAST(k AS STRING)) AS name
FROM customer CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks""",
    "tile_sets": """
SELECT o_orderkey AS tileset_id, o_custkey AS user_id, concat(o_orderpriority, '_map%', CAST(o_orderkey % 50 AS STRING)) AS name,
       concat('ts-', CAST(o_orderkey AS STRING)) AS slug, CASE o_orderkey % 3 WHEN 0 THEN 'flat' WHEN 1 THEN 'mercator' ELSE 'isometric' END AS projection,
       256 AS tile_size, 0 AS min_zoom, CAST(o_orderkey % 9 AS INT) AS max_zoom, CAST(round(o_totalprice * 100) AS BIGINT) AS size_bytes,
       concat('tiles/', CAST(o_orderkey - o_orderkey % 2 AS STRING)) AS storage_path, o_orderstatus = 'O' AS is_public,
       CAST(o_orderdate AS TIMESTAMP) AS created_at,
       CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_custkey * 10 + o_orderkey % 4 END AS project_id
FROM orders""",
    "accounts": """
SELECT c_custkey AS user_id, provider, concat(provider, '-', CAST(c_custkey AS STRING)) AS provider_account_id,
       CASE WHEN c_custkey % 2 = 0 THEN upper(concat('u', CAST(c_custkey % 100 AS STRING), '@example.test'))
            ELSE concat('u', CAST(c_custkey % 100 AS STRING), '@example.test') END AS email,
       ord, concat('https://img.test/', provider, '/', CAST(c_custkey AS STRING)) AS avatar_url,
       CASE WHEN ord = 0 THEN CAST('2023-03-01' AS TIMESTAMP) WHEN ord = 1 THEN CAST('2023-02-01' AS TIMESTAMP)
            ELSE CAST('2023-04-01' AS TIMESTAMP) END AS created_at
FROM customer CROSS JOIN (SELECT 'github' AS provider, 0 AS ord UNION ALL SELECT 'google', 1 UNION ALL SELECT 'discord', 2) p
WHERE c_custkey % 3 >= ord""",
    "identities": """
SELECT o_orderkey AS identity_id, CASE o_orderkey % 2 WHEN 0 THEN 'github' ELSE 'google' END AS provider,
       concat(CASE o_orderkey % 2 WHEN 0 THEN 'github' ELSE 'google' END, '-', CAST(o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1000000 END AS STRING)) AS provider_account_id,
       CASE WHEN o_orderkey % 6 = 4 THEN NULL WHEN o_orderkey % 5 = 0 THEN concat('New', CAST(o_custkey % 40 AS STRING), '@Example.test')
            ELSE concat('U', CAST(o_custkey % 130 AS STRING), '@example.test') END AS email,
       o_orderkey % 4 <> 1 AS email_verified,
       CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + o_orderkey % 2 END AS link_user_id
FROM orders""",
    "api_keys": """
SELECT s_suppkey * 4 + k AS key_id, 1 + (s_suppkey * 13 + k) % 150 AS user_id, concat('key ', CAST(k AS STRING)) AS name,
       CASE k WHEN 0 THEN 'read,process,manage' WHEN 1 THEN 'read,process' WHEN 2 THEN 'read' ELSE 'root' END AS scopes_csv,
       (s_suppkey + k) % 5 = 0 AS revoked,
       concat('tf_', lpad(CAST(s_suppkey * 4 + k AS STRING), CASE WHEN k = 3 THEN 30 ELSE 32 END, '0')) AS raw_key,
       CASE WHEN k = 1 THEN NULL WHEN k = 2 THEN CAST('2024-01-15 11:58:00' AS TIMESTAMP) ELSE CAST('2024-01-15 11:50:00' AS TIMESTAMP) END AS last_used_at,
       CAST('2023-06-01' AS TIMESTAMP) AS created_at
FROM supplier CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) ks""",
    "notifications": """
SELECT event_id AS notification_id, user_id, event_type AS type, concat('Event ', CAST(event_id AS STRING)) AS title,
       props AS message, CAST(ts AS TIMESTAMP) AS created_at, event_id % 3 = 0 AS is_read
FROM events""",
    "subscription_events": """
SELECT event_id, concat('cus_', CAST(user_id AS STRING)) AS customer_ref, CAST(ts AS TIMESTAMP) AS ts,
       CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'deleted' ELSE 'updated' END AS kind,
       CASE WHEN event_id % 2 = 0 THEN 'active' ELSE 'past_due' END AS status
FROM events""",
    "job_updates": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, user_id * 6 + CAST(floor(value) AS BIGINT) % 6 AS job_id,
       CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing'
                       WHEN 'purchase' THEN 'complete' ELSE 'failed' END AS status,
       CAST(floor(value * 3) AS INT) - 20 AS progress,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) % 100 END AS tiles_done,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(100 AS BIGINT) END AS tiles_total,
       CASE WHEN event_type = 'error' THEN concat('server timeout ', CAST(event_id % 9 AS STRING)) END AS error,
       CASE WHEN event_type = 'error' THEN CAST(event_id % 5 AS INT) END AS retry_count,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('k', CAST(event_id % 37 AS STRING)) END AS idempotency_key
FROM events""",
    "progress_ticks": """
SELECT event_id, user_id AS job_id, CAST(ts AS TIMESTAMP) AS ts,
       CAST(floor(event_id / 7) AS BIGINT) AS tiles_done, CAST(5 + floor(event_id / 500) AS INT) AS zoom
FROM events""",
    "upload_requests": """
SELECT event_id AS request_id, user_id, CAST(ts AS TIMESTAMP) AS ts,
       CAST(1 + floor(value * 9000000) AS BIGINT) * (1 + event_id % 3) AS body_bytes
FROM events""",
    "requests": """
SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 5 END AS user_id,
       concat('10.0.0.', CAST(event_id % 4 AS STRING)) AS peer_ip,
       CASE WHEN event_id % 11 = 0 THEN concat(' 192.0.2.', CAST(event_id % 7 AS STRING), ' , 10.1.1.1') END AS forwarded_for,
       CASE WHEN event_id % 13 = 0 THEN concat(' 198.51.100.', CAST(event_id % 5 AS STRING)) END AS cf_ip,
       CASE event_type WHEN 'click' THEN 'post_tiles' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'download' ELSE 'mutations' END AS endpoint
FROM events""",
    "headers": """
SELECT p_partkey AS raster_id,
       concat(CASE p_partkey % 4 WHEN 0 THEN '89504E470D0A1A0A0000000D49484452' WHEN 1 THEN '49492A00' WHEN 2 THEN '4D4D002B' ELSE 'FFD8FFE0' END,
              CASE WHEN p_partkey % 4 = 0 THEN concat(lpad(hex(p_partkey), 8, '0'), lpad(hex(p_size), 8, '0')) ELSE '' END) AS header_hex
FROM part""",
}

SPARK_VIEWS = {
    "raster_samples": """
SELECT vec_id AS raster_id, 8 AS width, 8 AS height, 1 AS channels, 0 AS channel, CAST(pos % 8 AS INT) AS x,
       CAST(floor(pos / 8) AS INT) AS y, CAST(v AS DOUBLE) AS v
FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, v""",
    "geo_tags": """
SELECT p_partkey AS raster_id, CASE WHEN p_partkey % 2 = 0 THEN 360 ELSE 100 END AS width, CASE WHEN p_partkey % 2 = 0 THEN 180 ELSE 50 END AS height,
       array(CASE WHEN p_partkey % 7 = 6 THEN 0D ELSE 1D END, 1D, 0D) AS scale, array(0D, 0D, 0D, -180D, 90D, 0D) AS tie,
       array(1, 1, 0, 2, 1024, 0, 1, 2, CASE WHEN p_partkey % 3 = 0 THEN 2048 ELSE 3072 END, CASE WHEN p_partkey % 5 = 4 THEN 1 ELSE 0 END, 1,
             CASE WHEN p_partkey % 3 = 0 THEN 4326 ELSE 3857 END) AS geo_keys,
       CASE WHEN p_partkey % 11 = 0 THEN 'isometric' END AS projection
FROM part""",
    "multiband": """
SELECT vec_id AS raster_id, 4 AS width, 4 AS height, 1 + CAST(vec_id % 5 AS INT) AS channels,
       transform(embedding, v -> CAST(v AS DOUBLE)) AS samples
FROM embeddings""",
}
CHECK_VIEWS = {
    "raster_samples": """
SELECT vec_id AS raster_id, 8 AS width, 8 AS height, 1 AS channels, 0 AS channel, CAST((p - 1) % 8 AS INT) AS x,
       CAST(floor((p - 1) / 8) AS INT) AS y, CAST(embedding[p] AS DOUBLE) AS v
FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS p FROM embeddings)""",
    "geo_tags": """
SELECT p_partkey AS raster_id, CASE WHEN p_partkey % 2 = 0 THEN 360 ELSE 100 END AS width, CASE WHEN p_partkey % 2 = 0 THEN 180 ELSE 50 END AS height,
       [CASE WHEN p_partkey % 7 = 6 THEN 0::DOUBLE ELSE 1 END, 1, 0] AS scale, [0::DOUBLE, 0, 0, -180, 90, 0] AS tie,
       [1, 1, 0, 2, 1024, 0, 1, 2, CASE WHEN p_partkey % 3 = 0 THEN 2048 ELSE 3072 END, CASE WHEN p_partkey % 5 = 4 THEN 1 ELSE 0 END, 1,
        CASE WHEN p_partkey % 3 = 0 THEN 4326 ELSE 3857 END] AS geo_keys,
       CASE WHEN p_partkey % 11 = 0 THEN 'isometric' END AS projection
FROM part""",
    "multiband": """
SELECT vec_id AS raster_id, 4 AS width, 4 AS height, 1 + CAST(vec_id % 5 AS INT) AS channels, embedding AS samples FROM embeddings""",
}


class Tables:
    """Lazy access to the base tables of a folder and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        text = SPARK_VIEWS.get(name) or VIEWS[name]
        used = [b for b in BASE if f"FROM {b}" in text]
        for b in used:
            text = text.replace(f"FROM {b}", "FROM {" + b + "}")
        return self.spark.sql(text, **{b: self.base(b) for b in used})


def check_sql(body: str, *views: str) -> str:
    """SQL text for checking: the named views as common table expressions, then ``body``.

    ``body`` may start with further expressions (``name AS (...), ... SELECT``).
    """
    ctes = ",\n".join(f"{v} AS ({CHECK_VIEWS.get(v) or VIEWS[v]})" for v in views)
    joint = ",\n" if _starts_with_cte(body) else "\n"
    return f"WITH RECURSIVE {ctes}{joint}{body.strip()}" if views else body.strip()


def _starts_with_cte(body: str) -> bool:
    return not body.strip().upper().startswith("SELECT")


QueryFn = Callable[[Tables], DataFrame]


class Registry:
    """Named queries with the SQL text they are checked against."""

    def __init__(self) -> None:
        self.queries: dict[str, QueryFn] = {}
        self.checks: dict[str, str] = {}

    def query(self, *views: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
        def add(fn: QueryFn) -> QueryFn:
            self.queries[fn.__name__] = fn
            if sql is not None:
                self.checks[fn.__name__] = check_sql(sql, *views)
            return fn

        return add
