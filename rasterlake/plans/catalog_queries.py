"""Queries over the catalogue: tile sets, projects, users, accounts, keys, notifications, storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, validate
from ..operators import accounts, catalog, search, storage
from ..streaming.run import new_folder
from .fixtures import Registry, Tables

REG = Registry()
AS_OF_SQL = "CAST('2024-01-20 00:00:00' AS TIMESTAMP)"
TS_COLS = "tileset_id, user_id, name, slug, is_public, created_at, project_id"
TS = TS_COLS.split(", ")
CALLER = 42


def as_of():
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


# --- listing and visibility ------------------------------------------------------------------------


@REG.query("tile_sets", sql=f"SELECT {TS_COLS} FROM tile_sets WHERE is_public ORDER BY created_at DESC, tileset_id LIMIT 50")
def list_public_tile_sets(t: Tables):
    return catalog.list_tile_sets(t("tile_sets")).select(*TS)


@REG.query("tile_sets", sql=f"SELECT {TS_COLS} FROM tile_sets WHERE user_id = {CALLER} ORDER BY created_at DESC, tileset_id LIMIT 4 OFFSET 4")
def list_own_tile_sets_second_page(t: Tables):
    return catalog.list_tile_sets(t("tile_sets"), caller=CALLER, page=2, per_page=4).select(*TS)


@REG.query("tile_sets", sql=f"SELECT {TS_COLS} FROM tile_sets WHERE user_id = 7 AND is_public AND project_id = 71 ORDER BY created_at DESC, tileset_id LIMIT 50")
def list_project_of_other_user(t: Tables):
    return catalog.list_tile_sets(t("tile_sets"), caller=CALLER, target=7, project=71).select(*TS)


@REG.query("tile_sets", sql=f"SELECT {TS_COLS} FROM tile_sets WHERE user_id = {CALLER} AND project_id IS NULL ORDER BY created_at DESC, tileset_id LIMIT 50")
def list_unfiled_tile_sets(t: Tables):
    return catalog.list_tile_sets(t("tile_sets"), caller=CALLER, unfiled=True).select(*TS)


SEARCH_SQL = f"SELECT {TS_COLS} FROM tile_sets WHERE is_public AND name ILIKE '%\\_MAP\\%1%' ESCAPE '\\' ORDER BY created_at DESC, tileset_id LIMIT 100"


@REG.query("tile_sets", sql=SEARCH_SQL)
def search_tile_sets(t: Tables):
    return catalog.list_tile_sets(t("tile_sets"), search="_MAP%1", per_page=500).select(*TS)


@REG.query("tile_sets", sql=SEARCH_SQL)
def search_page_by_pieces(t: Tables):
    """The same page, of which only rows on the posting lists of the text are looked at."""
    folder = new_folder(t.spark, "pieces")
    names = t("tile_sets")
    search.write_index(names, folder, "tileset_id")
    ids = search.candidates(t.spark, folder, "_MAP%1").withColumnRenamed("id", "tileset_id")
    return catalog.list_tile_sets(names.join(ids, "tileset_id", "left_semi"), search="_MAP%1", per_page=500).select(*TS)


SEARCHES = """
SELECT concat(substr(n_name, 1, CAST(n_nationkey % 5 AS INT)), CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE '_map%' END) AS text FROM nation
UNION ALL SELECT concat(upper(substr(r_name, 1, CAST(r_regionkey AS INT))), '_MAP%4') FROM region
UNION ALL SELECT concat(CAST(n_nationkey % 6 AS STRING), '-', CASE WHEN n_nationkey % 2 = 0 THEN 'UR' ELSE 'hi' END) FROM nation
UNION ALL SELECT '%' FROM region UNION ALL SELECT CAST(NULL AS STRING) FROM region"""


@REG.query(
    "tile_sets",
    sql=f"""
q AS (SELECT DISTINCT text FROM ({SEARCHES}) s)
SELECT q.text, tileset_id, slug FROM q JOIN tile_sets ON is_public AND contains(lower(name), lower(q.text))""",
)
def search_by_pieces(t: Tables):
    """Many searches at once through posting lists: short, empty, wildcard and missing texts."""
    folder = new_folder(t.spark, "pieces")
    names = t("tile_sets")
    search.write_index(names, folder, "tileset_id")
    asked = t.spark.sql(SEARCHES.replace("FROM nation", "FROM {nation}").replace("FROM region", "FROM {region}"), nation=t("nation"), region=t("region"))
    found = search.matches(t.spark, folder, names.filter("is_public"), asked, "tileset_id")
    return found.select("text", "tileset_id", "slug")


@REG.query(
    "tile_sets",
    sql="""
SELECT tileset_id, replace(replace(replace(name, '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS pattern,
       name ILIKE concat('%', replace(replace(replace('_MAP%3', '\\', '\\\\'), '%', '\\%'), '_', '\\_'), '%') ESCAPE '\\' AS found FROM tile_sets""",
)
def like_escape(t: Tables):
    return t("tile_sets").select(
        "tileset_id", text.like_escape(F.col("name")).alias("pattern"),
        text.contains_ci(F.col("name"), F.lit("_MAP%3")).alias("found"),
    )


@REG.query(
    "tile_sets",
    sql="""
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, tileset_id) AS rn, COUNT(*) OVER (PARTITION BY user_id) AS n FROM tile_sets)
SELECT user_id, tileset_id, CAST(rn AS INT) AS rn, n > 10 AS has_next FROM r WHERE rn <= 10""",
)
def first_page_per_user(t: Tables):
    return catalog.first_pages(t("tile_sets"), "tileset_id", 10).select("user_id", "tileset_id", "rn", "has_next")


def slug_requests(t: Tables):
    """Every order asks for the tile set of the order before it as its own customer."""
    return t("orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("caller"),
        F.concat(F.lit("ts-"), (F.col("o_orderkey") - F.col("o_orderkey") % 3).cast("string")).alias("slug"),
    )


SLUG_SQL = "req AS (SELECT o_orderkey AS request_id, o_custkey AS caller, concat('ts-', CAST(o_orderkey - o_orderkey % 3 AS VARCHAR)) AS slug FROM orders)"


@REG.query(
    "tile_sets",
    sql=SLUG_SQL + """
SELECT request_id, caller, req.slug, CASE WHEN is_public OR user_id = caller THEN tileset_id END AS tileset_id,
       CASE WHEN is_public OR user_id = caller THEN 'ok' ELSE 'not_found' END AS outcome FROM req LEFT JOIN tile_sets t ON t.slug = req.slug""",
)
def tile_set_by_slug(t: Tables):
    return catalog.visible_by_slug(slug_requests(t), t("tile_sets"))


@REG.query(
    "tile_sets",
    sql="""
req AS (SELECT o_orderkey AS request_id, o_custkey AS caller, concat('s', CAST(o_orderkey % 40 AS VARCHAR)) AS slug FROM orders),
ts AS (SELECT tileset_id, user_id, is_public AND tileset_id % 5 = 0 AS is_public, concat('s', CAST(tileset_id % 60 AS VARCHAR)) AS slug FROM tile_sets),
f AS (SELECT request_id, MIN(tileset_id) AS id FROM req JOIN ts ON ts.slug = req.slug AND (is_public OR user_id = caller) GROUP BY 1)
SELECT req.*, f.id AS tileset_id, CASE WHEN f.id IS NULL THEN 'not_found' ELSE 'ok' END AS outcome FROM req LEFT JOIN f USING (request_id)""",
)
def tile_set_by_shared_slug(t: Tables):
    """Slugs that many users have: one row for each request all the same."""
    key = F.col("o_orderkey")
    asked = t("orders").select(key.alias("request_id"), F.col("o_custkey").alias("caller"), F.concat(F.lit("s"), (key % 40).cast("string")).alias("slug"))
    sets = t("tile_sets").withColumns({
        "slug": F.concat(F.lit("s"), (F.col("tileset_id") % 60).cast("string")), "is_public": F.col("is_public") & (F.col("tileset_id") % 5 == 0),
    })
    return catalog.visible_by_slug(asked, sets)


# --- changes -----------------------------------------------------------------------------------------

# One patch after the other, as the table stands then.
PATCH_SQL = """
patch AS (SELECT tileset_id * 2 AS patch_id, user_id, slug, CASE WHEN tileset_id % 2 = 0 THEN concat('renamed ', slug) END AS new_name, CASE WHEN tileset_id % 5 = 0 THEN TRUE END AS new_public,
                 tileset_id % 7 = 0 AS clear_project, CASE WHEN tileset_id % 3 = 0 THEN user_id * 10 + tileset_id % 4 END AS new_project
          FROM tile_sets WHERE max_zoom >= 4
          UNION ALL SELECT tileset_id * 2 + 1, user_id, slug, CASE WHEN tileset_id % 3 = 0 THEN concat('again ', slug) END, CASE WHEN tileset_id % 4 = 0 THEN FALSE END,
                 tileset_id % 5 = 0, CASE WHEN tileset_id % 2 = 0 THEN user_id * 10 + tileset_id % 3 END
          FROM tile_sets WHERE max_zoom >= 3),
ok AS (SELECT *, row_number() OVER (PARTITION BY user_id, slug ORDER BY patch_id) AS n FROM patch p
       WHERE new_project IS NULL OR EXISTS (SELECT 1 FROM projects j WHERE j.project_id = p.new_project AND j.user_id = p.user_id)),
walk AS (SELECT tileset_id, user_id, slug, name, is_public, project_id, CAST(0 AS BIGINT) AS n FROM tile_sets
         UNION ALL
         SELECT w.tileset_id, w.user_id, w.slug, COALESCE(new_name, name), COALESCE(new_public, is_public),
                CASE WHEN clear_project THEN NULL ELSE COALESCE(new_project, project_id) END, w.n + 1
         FROM walk w JOIN ok ON ok.user_id = w.user_id AND ok.slug = w.slug AND ok.n = w.n + 1)
SELECT tileset_id, name, is_public, project_id, n > 0 AS patched FROM (SELECT *, row_number() OVER (PARTITION BY tileset_id ORDER BY n DESC) AS rn FROM walk) q WHERE rn = 1"""


@REG.query("tile_sets", "projects", sql=PATCH_SQL)
def update_tile_sets(t: Tables):
    """Up to two patches of a tile set."""
    sets, key = t("tile_sets"), F.col("tileset_id")
    first = sets.filter(F.col("max_zoom") >= 4).select(
        (key * 2).alias("patch_id"), "user_id", "slug", F.when(key % 2 == 0, F.concat(F.lit("renamed "), "slug")).alias("name"),
        F.when(key % 5 == 0, True).alias("is_public"), (key % 7 == 0).alias("clear_project"),
        F.when(key % 3 == 0, F.col("user_id") * 10 + key % 4).alias("project_id"),
    )
    second = sets.filter(F.col("max_zoom") >= 3).select(
        (key * 2 + 1).alias("patch_id"), "user_id", "slug", F.when(key % 3 == 0, F.concat(F.lit("again "), "slug")).alias("name"),
        F.when(key % 4 == 0, False).alias("is_public"), (key % 5 == 0).alias("clear_project"),
        F.when(key % 2 == 0, F.col("user_id") * 10 + key % 3).alias("project_id"),
    )
    return catalog.apply_patches(sets, first.unionByName(second), t("projects")).select(
        "tileset_id", "name", "is_public", "project_id", "patched"
    )


def deletion_requests(t: Tables):
    return t("tile_sets").filter(F.col("max_zoom") <= 5).select("user_id", "slug")


@REG.query(
    "tile_sets",
    sql="""
SELECT storage_path, COUNT(*) FILTER (max_zoom <= 5) AS deleted FROM tile_sets GROUP BY 1
HAVING COUNT(*) FILTER (max_zoom <= 5) > 0 AND COUNT(*) FILTER (max_zoom > 5) = 0""",
)
def orphaned_storage(t: Tables):
    return catalog.delete_tile_sets(t("tile_sets"), deletion_requests(t))[1]


@REG.query("tile_sets", sql="SELECT tileset_id, slug FROM tile_sets WHERE max_zoom > 5")
def remaining_after_delete(t: Tables):
    return catalog.delete_tile_sets(t("tile_sets"), deletion_requests(t))[0].select("tileset_id", "slug")


FINAL_SQL = """
new AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey + 1 END AS user_id,
               CASE WHEN o_orderkey % 4 = 0 THEN concat('ts-', CAST(o_orderkey AS VARCHAR)) ELSE concat('new-', CAST(o_orderkey AS VARCHAR)) END AS slug,
               concat('tiles/', CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey + 10000000 END AS VARCHAR)) AS storage_path FROM orders),
fin AS (SELECT DISTINCT storage_path, user_id FROM new WHERE request_id % 5 <> 0),
obj AS (SELECT DISTINCT storage_path, CAST(1000 + length(storage_path) AS BIGINT) AS stored FROM new WHERE request_id % 7 <> 0),
old AS (SELECT storage_path, MIN(tileset_id) AS old_id, arg_min(user_id, tileset_id) AS old_user FROM tile_sets GROUP BY 1),
a AS (SELECT new.*, old_id, stored, CASE WHEN old_id IS NOT NULL AND old_user = new.user_id THEN 'update'
        WHEN old_id IS NOT NULL OR fin.user_id IS NULL OR stored IS NULL THEN 'not_found'
        WHEN EXISTS (SELECT 1 FROM tile_sets s WHERE s.user_id = new.user_id AND s.slug = new.slug) THEN 'conflict' ELSE 'insert' END AS action
      FROM new LEFT JOIN old ON old.storage_path = new.storage_path LEFT JOIN fin ON fin.storage_path = new.storage_path AND fin.user_id = new.user_id
      LEFT JOIN obj ON obj.storage_path = new.storage_path)
SELECT request_id, user_id, slug, storage_path, action, CASE WHEN action = 'update' THEN old_id END AS tileset_id,
       CASE WHEN action = 'insert' THEN stored END AS stored_bytes FROM a"""


@REG.query("tile_sets", sql=FINAL_SQL)
def finalise_tile_sets(t: Tables):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    number = F.when(key % 2 == 0, key).otherwise(key + 10000000)
    slug = F.concat(F.when(key % 4 == 0, "ts-").otherwise("new-"), key.cast("string"))
    new = t("orders").select(
        key.alias("request_id"), F.when(key % 3 == 0, cust).otherwise(cust + 1).alias("user_id"), slug.alias("slug"),
        text.tile_prefix(number).alias("storage_path"),
    )
    finished = new.filter(F.col("request_id") % 5 != 0)
    stored = new.filter(F.col("request_id") % 7 != 0).select("storage_path").distinct().withColumn(
        "size_bytes", (F.length("storage_path") + 1000).cast("long")
    )
    return catalog.finalise(t("tile_sets"), new, finished, stored)


JOB_ROWS_SQL = """
done AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS user_id,
                CASE o_orderkey % 4 WHEN 0 THEN concat('maps/', o_orderpriority, '.final.png') WHEN 1 THEN 'plain' WHEN 2 THEN 'dir/.png' END AS file_name,
                CAST(o_orderkey % 6 AS INT) AS max_zoom, CAST(o_orderkey % 120 AS INT) AS quality, CAST(round(o_totalprice) AS BIGINT) + delivery AS zip_bytes, delivery
         FROM orders, (SELECT unnest([1, 2]) AS delivery) WHERE delivery = 1 OR o_orderkey % 3 = 0),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, job_id ORDER BY delivery) AS rn FROM done) q WHERE rn = 1),
n AS (SELECT *, regexp_replace(regexp_extract(file_name, '([^/]*)$', 1), '\\.[^.]*$', '') AS base FROM once)
SELECT user_id, CASE WHEN length(base) > 0 THEN base ELSE concat('Tileset ', substr(CAST(job_id AS VARCHAR), 1, 8)) END AS name, CAST(job_id AS VARCHAR) AS slug,
       'flat' AS projection, 256 AS tile_size, 0 AS min_zoom, max_zoom, ((CAST(1 AS BIGINT) << (2 * max_zoom + 2)) - 1) // 3 AS tile_count, zip_bytes + 77 AS size_bytes,
       concat('tiles/', CAST(job_id AS VARCHAR)) AS storage_path, 'png' AS tile_format, CAST(least(100, greatest(1, quality)) AS INT) AS tile_quality
FROM n WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = n.job_id AND o.o_orderkey % 9 = 0)"""


@REG.query(sql="WITH " + JOB_ROWS_SQL.strip())
def catalogue_rows_from_jobs(t: Tables):
    key, orders = F.col("o_orderkey"), t("orders")
    name = F.when(key % 4 == 0, F.concat(F.lit("maps/"), "o_orderpriority", F.lit(".final.png"))).when(key % 4 == 1, "plain").when(key % 4 == 2, "dir/.png")
    done = orders.select(
        key.alias("job_id"), F.when(key % 13 != 0, F.col("o_custkey")).alias("user_id"), name.alias("file_name"),
        F.lit(None).cast("string").alias("projection"), F.lit(None).cast("int").alias("tile_size"), F.lit(None).cast("int").alias("min_zoom"),
        (key % 6).cast("int").alias("max_zoom"), (key % 120).cast("int").alias("quality"),
        F.lit(None).cast("string").alias("tile_format"), F.round("o_totalprice").cast("long").alias("zip_bytes"), F.lit(77).alias("archive_bytes"),
    )
    # Every third job is delivered twice, with a larger archive the second time.
    nth = F.explode(F.when(F.col("job_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    done = done.withColumn("delivery", nth).withColumn("zip_bytes", F.col("zip_bytes") + F.col("delivery"))
    existing = orders.filter(key % 9 == 0).select(F.col("o_custkey").alias("user_id"), key.cast("string").alias("slug"))
    return catalog.rows_from_jobs(done, existing)


CHECK_TS = [
    ("name", "length(trim(name)) = 0 OR octet_length(CAST(name AS BLOB)) > 200"),
    ("slug", "NOT regexp_full_match(slug, '[A-Za-z0-9._-]{1,100}')"),
    ("projection", "COALESCE(projection, 'flat') NOT IN ('flat', 'mercator', 'isometric')"),
    ("tile_size", "COALESCE(tile_size, 256) NOT IN (128, 256, 512)"),
    ("tile_format", "COALESCE(tile_format, 'png') NOT IN ('png', 'jpeg', 'webp')"),
    ("tile_quality", "COALESCE(tile_quality, 85) NOT BETWEEN 1 AND 100"),
    ("zoom", "COALESCE(min_zoom, 0) < 0 OR max_zoom < COALESCE(min_zoom, 0) OR max_zoom > 12"),
    ("counts", "tile_count <= 0 OR size_bytes <= 0"),
    ("storage_path", "NOT regexp_full_match(storage_path, 'tiles/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}')"),
]


@REG.query(
    "tile_sets",
    sql="""
v AS (SELECT tileset_id, CASE WHEN tileset_id % 10 = 3 THEN '  ' WHEN tileset_id % 10 = 4 THEN repeat(name, 20) ELSE name END AS name,
             CASE WHEN tileset_id % 11 = 0 THEN concat(slug, ' x') ELSE slug END AS slug, projection, tile_size, CASE WHEN tileset_id % 5 = 0 THEN 'gif' ELSE 'png' END AS tile_format,
             CAST(tileset_id % 103 AS INT) AS tile_quality, CAST(tileset_id % 4 AS INT) - 1 AS min_zoom, max_zoom + 5 AS max_zoom, tileset_id % 17 AS tile_count, size_bytes,
             concat('tiles/', CASE WHEN tileset_id % 2 = 0 THEN '0a1b2c3d-0000-4000-8000-' ELSE '0A1B2C3D-0000-4000-8000-' END, lpad(CAST(tileset_id AS VARCHAR), 12, '0')) AS storage_path
      FROM tile_sets)
SELECT tileset_id, concat_ws(',', """ + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in CHECK_TS) + ") AS violations FROM v",
)
def tile_set_violations(t: Tables):
    key = F.col("tileset_id")
    uuid = F.when(key % 2 == 0, "0a1b2c3d-0000-4000-8000-").otherwise("0A1B2C3D-0000-4000-8000-")
    rows = t("tile_sets").select(
        "tileset_id", F.when(key % 10 == 3, "  ").when(key % 10 == 4, F.repeat("name", 20)).otherwise(F.col("name")).alias("name"),
        F.when(key % 11 == 0, F.concat("slug", F.lit(" x"))).otherwise(F.col("slug")).alias("slug"), "projection", "tile_size",
        F.when(key % 5 == 0, "gif").otherwise("png").alias("tile_format"), (key % 103).cast("int").alias("tile_quality"),
        ((key % 4) - 1).cast("int").alias("min_zoom"), (F.col("max_zoom") + 5).alias("max_zoom"), (key % 17).alias("tile_count"), "size_bytes",
        F.concat(F.lit("tiles/"), uuid, F.lpad(key.cast("string"), 12, "0")).alias("storage_path"),
    )
    return validate.report(rows, validate.TILE_SET).select("tileset_id", F.array_join("violations", ",").alias("violations"))


@REG.query(
    "api_keys", "users", "notifications",
    sql="""
SELECT 'project' AS kind, page_id AS id, concat_ws(',', CASE WHEN length(trim(substr(url, 1, 8 + CAST(page_id % 120 AS INT)))) NOT BETWEEN 1 AND 100 THEN 'name' END,
                 CASE WHEN length(html) > 500 OR regexp_matches(html, '[\\x{0}-\\x{1F}\\x{7F}-\\x{9F}]') THEN 'description' END) AS violations FROM pages
UNION ALL SELECT 'notification', page_id, concat_ws(',', CASE WHEN strlen(url) > 50 THEN 'type' END, CASE WHEN strlen(concat(url, url, url, url)) > 200 THEN 'title' END,
                 CASE WHEN strlen(html) > 1000 THEN 'message' END) FROM pages
UNION ALL SELECT 'api_key', key_id, CASE WHEN scopes_csv = 'root' THEN 'scopes' ELSE '' END FROM api_keys
UNION ALL SELECT 'idempotency', page_id, CASE WHEN strlen(concat(url, url)) > 128 THEN 'idempotency_key' ELSE '' END FROM pages
UNION ALL SELECT 'upload', page_id, concat_ws(',', CASE WHEN page_id % 10 = 0 THEN 'empty' END, CASE WHEN (page_id % 10) * 70000000 > 524288000 THEN 'too_large' END,
                 CASE WHEN page_id % 3 = 0 AND page_id % 2 = 1 THEN 'tiff_needs_pro' END, CASE WHEN page_id % 5 = 0 AND page_id % 2 = 1 THEN 'key_needs_pro' END) FROM pages""",
)
def input_violations(t: Tables):
    pages, pid, url = t("pages"), F.col("page_id"), F.col("url")

    def shown(kind, df, rules, key="id"):
        checked = validate.report(df, rules)
        return checked.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.array_join("violations", ",").alias("violations"))

    projects = pages.select(
        pid.alias("id"), F.call_function("substr", url, F.lit(1), (pid % 120 + 8).cast("int")).alias("name"), F.col("html").alias("description")
    )
    notes = pages.select(pid.alias("id"), url.alias("type"), F.concat(url, url, url, url).alias("title"), F.col("html").alias("message"))
    keys = t("api_keys").select(F.col("key_id").alias("id"), "name", F.split("scopes_csv", ",").alias("scopes"))
    idem = pages.select(pid.alias("id"), F.concat(url, url).alias("idempotency_key"))
    uploads = pages.select(
        pid.alias("id"), ((pid % 10) * 70000000).alias("body_bytes"), (pid % 3 == 0).alias("is_tiff"),
        F.when(pid % 2 == 0, "pro").otherwise("free").alias("plan"), F.when(pid % 5 == 0, url).alias("idempotency_key"),
    )
    return (
        shown("project", projects, validate.PROJECT)
        .unionByName(shown("notification", notes, validate.NOTIFICATION))
        .unionByName(shown("api_key", keys, validate.API_KEY))
        .unionByName(shown("idempotency", idem, validate.IDEMPOTENCY))
        .unionByName(shown("upload", uploads, validate.UPLOAD))
    )


# --- projects, notifications ----------------------------------------------------------------------------


@REG.query(
    "projects", "tile_sets",
    sql="SELECT p.project_id, p.name, COUNT(t.tileset_id) AS tileset_count FROM projects p LEFT JOIN tile_sets t ON t.project_id = p.project_id GROUP BY 1, 2 ORDER BY p.name, 1",
)
def project_counts(t: Tables):
    counted = catalog.project_counts(t("projects"), t("tile_sets"))
    return counted.select("project_id", "name", "tileset_count").orderBy("name", "project_id")


@REG.query(
    "projects",
    sql="""
w AS (SELECT o_orderkey AS request_id, o_custkey AS user_id, trim(concat(' Project ', CAST(o_orderkey % 5 AS VARCHAR), ' ')) AS name,
             nullif(trim(CASE WHEN o_orderkey % 2 = 0 THEN '  ' ELSE o_orderpriority END), '') AS description FROM orders),
f AS (SELECT *, MIN(request_id) OVER (PARTITION BY user_id, name) AS first_id FROM w)
SELECT request_id, user_id, name, description, CASE WHEN request_id <> first_id OR EXISTS (SELECT 1 FROM projects p WHERE p.user_id = f.user_id AND p.name = f.name)
       THEN 'conflict' ELSE 'created' END AS outcome FROM f""",
)
def create_projects(t: Tables):
    key = F.col("o_orderkey")
    wanted = t("orders").select(
        key.alias("request_id"), F.col("o_custkey").alias("user_id"), F.concat(F.lit(" Project "), (key % 5).cast("string"), F.lit(" ")).alias("name"),
        F.when(key % 2 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("description"),
    )
    return catalog.create_projects(t("projects"), wanted)


@REG.query(
    "projects", "tile_sets", "users",
    sql="""
gone AS (SELECT p.project_id FROM projects p JOIN users u ON u.user_id = p.user_id AND u.plan = 'free' WHERE p.project_id % 10 = 1)
SELECT tileset_id, CASE WHEN g.project_id IS NULL THEN t.project_id END AS project_id FROM tile_sets t LEFT JOIN gone g ON g.project_id = t.project_id""",
)
def delete_projects(t: Tables):
    free = t("users").filter(F.col("plan") == "free").select("user_id")
    gone = t("projects").filter(F.col("project_id") % 10 == 1).join(free, "user_id").select("project_id", "user_id")
    return catalog.delete_projects(t("projects"), t("tile_sets"), gone)[1].select("tileset_id", "project_id")


@REG.query(
    "notifications",
    sql="""
SELECT user_id, notification_id, CAST(rn AS INT) AS rn, is_read FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, notification_id DESC) AS rn FROM notifications) q WHERE rn <= 50""",
)
def latest_notifications(t: Tables):
    return catalog.latest_notifications(t("notifications")).select("user_id", "notification_id", "rn", "is_read")


@REG.query("notifications", sql="SELECT user_id, COUNT(*) FILTER (NOT is_read) AS unread, COUNT(*) AS total FROM notifications GROUP BY 1")
def unread_counts(t: Tables):
    return catalog.unread_counts(t("notifications"))


@REG.query(
    "notifications", "users",
    sql="""
SELECT notification_id, is_read OR EXISTS (SELECT 1 FROM users u WHERE u.user_id = n.user_id AND plan = 'pro') AS is_read
FROM notifications n WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.user_id = n.user_id AND deactivated_at IS NOT NULL)""",
)
def mark_read_and_clear(t: Tables):
    users = t("users")
    marked = catalog.mark_read(t("notifications"), users.filter(F.col("plan") == "pro"))
    return catalog.clear_notifications(marked, users.filter(F.col("deactivated_at").isNotNull())).select("notification_id", "is_read")


@REG.query(
    "users",
    sql=f"SELECT user_id, 'news' AS type, 'Maintenance' AS title, 'Tonight' AS message, FALSE AS is_read, {AS_OF_SQL} AS created_at FROM users WHERE deactivated_at IS NULL",
)
def broadcast_notification(t: Tables):
    return catalog.broadcast(t("users"), "news", "Maintenance", "Tonight", as_of())


@REG.query("users", sql="SELECT COUNT(*) AS notified FROM users WHERE deactivated_at IS NULL")
def broadcast_count(t: Tables):
    return catalog.broadcast(t("users"), "news", "Maintenance", "Tonight", as_of()).agg(F.count("*").alias("notified"))


# --- users and accounts ------------------------------------------------------------------------------------

GONE_SQL = f"gone AS (SELECT user_id FROM users WHERE deactivated_at < {AS_OF_SQL} - INTERVAL 30 DAYS)"
NAMES = ["users", "tile_sets", "api_keys", "notifications", "accounts", "projects"]


@REG.query(
    *NAMES,
    sql=GONE_SQL + ", purged AS (SELECT COUNT(*) AS n FROM gone) SELECT 'purged' AS name, n AS rows FROM purged "
    + " ".join(f"UNION ALL SELECT '{n}', COUNT(*) FROM {n} x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = x.user_id)" for n in NAMES),
)
def purge_counts(t: Tables):
    out = accounts.purge({n: t(n) for n in NAMES}, as_of())
    parts = [out[n].agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n in ["purged", *NAMES]]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total


@REG.query(
    "users", "tile_sets",
    sql=GONE_SQL + """, paths AS (SELECT DISTINCT storage_path FROM tile_sets t WHERE EXISTS (SELECT 1 FROM gone g WHERE g.user_id = t.user_id))
SELECT concat(storage_path, '/', s) AS object_key FROM paths CROSS JOIN (SELECT unnest(['tiles.zip', 'tiles.pmtiles', 'thumbnail.jpg']) AS s) q""",
)
def purge_object_keys(t: Tables):
    out = accounts.purge({"users": t("users"), "tile_sets": t("tile_sets")}, as_of())
    return catalog.object_keys(out["paths"])


@REG.query(
    "users", "api_keys",
    sql="""
SELECT k.key_id, k.revoked OR u.plan = 'free' AS revoked, CASE WHEN u.plan = 'free' AND u.deactivated_at IS NULL THEN """ + AS_OF_SQL + """ ELSE u.deactivated_at END AS deactivated_at
FROM api_keys k JOIN users u ON u.user_id = k.user_id""",
)
def deactivate_users(t: Tables):
    users = t("users")
    stamped, keys = accounts.deactivate(users, t("api_keys"), users.filter(F.col("plan") == "free"), as_of())
    return keys.join(stamped.select("user_id", "deactivated_at"), "user_id").select("key_id", "revoked", "deactivated_at")


@REG.query(
    "users",
    sql="""
d AS (SELECT user_id, plan, deactivated_at + INTERVAL 1 MINUTE * CAST(user_id * 31 AS INT) AS off, CAST('2024-01-31 06:00:00' AS TIMESTAMP) AS now FROM users),
o AS (SELECT *, CASE WHEN off IS NULL THEN 'active' WHEN date_sub('day', off, now) > 30 THEN 'expired' ELSE 'reactivated' END AS service_outcome,
             CASE WHEN off IS NULL THEN 'active' WHEN epoch_us(now) - epoch_us(off) BETWEEN 0 AND 2592000000000 THEN 'reactivated' ELSE 'expired' END AS sign_in_outcome FROM d)
SELECT user_id, service_outcome, sign_in_outcome, CASE WHEN sign_in_outcome = 'reactivated' THEN 'free' ELSE plan END AS plan_after_sign_in FROM o""",
)
def reactivate_users(t: Tables):
    users = t("users").withColumn("deactivated_at", F.timestamp_add("MINUTE", (F.col("user_id") * 31).cast("int"), F.col("deactivated_at")))
    now = F.lit("2024-01-31 06:00:00").cast("timestamp")
    return accounts.reactivate(users, now).select("user_id", "service_outcome", "sign_in_outcome", "plan_after_sign_in")


IDENTITY_SQL = """
r AS (SELECT i.*, (SELECT MIN(a.user_id) FROM accounts a WHERE a.provider = i.provider AND a.provider_account_id = i.provider_account_id) AS pair_user,
             EXISTS (SELECT 1 FROM users u WHERE u.user_id = i.link_user_id) AS link_ok FROM identities i),
q AS (SELECT *, pair_user IS NULL AND link_user_id IS NOT NULL AND NOT link_ok AS missing FROM r),
live AS (SELECT *, row_number() OVER (PARTITION BY provider, provider_account_id ORDER BY identity_id) AS n FROM q WHERE pair_user IS NULL AND NOT missing),
e AS (SELECT lower(email) AS em, MIN(user_id) AS email_user FROM users GROUP BY 1),
h AS (SELECT provider, provider_account_id, identity_id AS head_id, link_user_id AS head_link, lower(email) AS em, COALESCE(email_verified, FALSE) AS ver,
             CASE WHEN email_verified AND link_user_id IS NULL THEN e.email_user END AS email_user
      FROM live LEFT JOIN e ON e.em = lower(live.email) WHERE n = 1),
mk AS (SELECT em, MIN(head_id) AS maker FROM h WHERE head_link IS NULL AND email_user IS NULL AND em IS NOT NULL GROUP BY 1),
p AS (SELECT h.*, COALESCE(head_link, email_user) AS new_user,
             CASE WHEN head_link IS NULL AND email_user IS NULL THEN CASE WHEN ver THEN COALESCE(maker, head_id) ELSE head_id END END AS made_by FROM h LEFT JOIN mk ON mk.em = h.em),
f AS (SELECT q.identity_id, q.link_user_id, q.missing, q.pair_user, p.head_id, p.new_user, p.made_by, COALESCE(q.pair_user, p.new_user) AS usr
      FROM q LEFT JOIN p ON p.provider = q.provider AND p.provider_account_id = q.provider_account_id),
o AS (SELECT *, CASE WHEN missing THEN 'missing_user' WHEN link_user_id IS NOT NULL AND COALESCE(usr <> link_user_id, TRUE) THEN 'conflict'
        WHEN link_user_id IS NOT NULL AND identity_id = head_id AND pair_user IS NULL THEN 'linked' WHEN pair_user IS NOT NULL OR identity_id <> head_id THEN 'existing'
        WHEN new_user IS NOT NULL OR made_by <> identity_id THEN 'linked_by_email' ELSE 'created' END AS outcome FROM f)
SELECT identity_id, outcome, CASE WHEN outcome NOT IN ('missing_user', 'conflict') THEN usr END AS user_id,
       CASE WHEN outcome NOT IN ('missing_user', 'conflict') AND usr IS NULL THEN made_by END AS created_by FROM o"""


@REG.query("users", "accounts", "identities", sql=IDENTITY_SQL)
def resolve_identities(t: Tables):
    return accounts.resolve_identities(t("users"), t("accounts"), t("identities"))


@REG.query(
    "accounts",
    sql="SELECT user_id, provider, provider_account_id, n AS n_accounts FROM (SELECT *, COUNT(*) OVER (PARTITION BY user_id) AS n FROM accounts) q WHERE n > 1",
)
def unlinkable_accounts(t: Tables):
    return accounts.linkable(t("accounts")).select("user_id", "provider", "provider_account_id", "n_accounts")


@REG.query(
    "accounts",
    sql="""
SELECT user_id, arg_min(provider, created_at) AS provider, arg_min(avatar_url, created_at) AS avatar_url, MIN(created_at) AS created_at, COUNT(*) AS n_accounts FROM accounts GROUP BY 1""",
)
def primary_accounts(t: Tables):
    return accounts.primary_account(t("accounts"))


@REG.query(
    "users", "accounts",
    sql="""
SELECT u.user_id, c.provider, a.avatar_url FROM users u JOIN (SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'google' ELSE 'discord' END AS provider FROM users) c
ON c.user_id = u.user_id LEFT JOIN accounts a ON a.user_id = u.user_id AND a.provider = c.provider""",
)
def avatar_choices(t: Tables):
    users, uid = t("users"), F.col("user_id")
    wanted = F.when(uid % 3 == 0, "github").when(uid % 3 == 1, "google").otherwise("discord")
    return accounts.avatar_from(users, t("accounts"), users.select("user_id", wanted.alias("provider"))).select("user_id", "provider", "avatar_url")


@REG.query(
    "users", "subscription_events",
    sql="""
l AS (SELECT customer_ref, kind, status FROM (SELECT *, row_number() OVER (PARTITION BY customer_ref ORDER BY ts DESC, event_id DESC) AS rn FROM subscription_events) q WHERE rn = 1)
SELECT user_id, CASE kind WHEN 'completed' THEN 'pro' WHEN 'deleted' THEN 'free' WHEN 'updated' THEN CASE WHEN status = 'active' THEN 'pro' ELSE 'free' END ELSE plan END AS plan
FROM users u LEFT JOIN l ON l.customer_ref = u.customer_ref""",
)
def plans_from_events(t: Tables):
    return accounts.plans_from_events(t("users"), t("subscription_events")).select("user_id", "plan")


CHANGE_SQL = """
ch AS (SELECT o_orderkey AS change_id, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN concat('Customer#', lpad(CAST(o_custkey AS VARCHAR), 9, '0'))
        ELSE concat('u', CAST(o_custkey % 100 AS VARCHAR), '@example.test') END AS who, CASE WHEN o_orderkey % 2 = 0 THEN 'pro' ELSE 'free' END AS plan FROM orders),
m AS (SELECT u.user_id, c.change_id, c.plan FROM users u JOIN ch c ON c.who = CAST(u.user_id AS VARCHAR) UNION ALL
      SELECT u.user_id, c.change_id, c.plan FROM users u JOIN ch c ON c.who = u.username UNION ALL SELECT u.user_id, c.change_id, c.plan FROM users u JOIN ch c ON c.who = u.email),
l AS (SELECT user_id, arg_max(plan, change_id) AS plan FROM m GROUP BY 1)
SELECT u.user_id, COALESCE(l.plan, u.plan) AS plan, l.user_id IS NOT NULL AS changed FROM users u LEFT JOIN l ON l.user_id = u.user_id"""


@REG.query("users", sql=CHANGE_SQL)
def set_plan(t: Tables):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    who = (
        F.when(key % 3 == 0, cust.cast("string"))
        .when(key % 3 == 1, F.concat(F.lit("Customer#"), F.lpad(cust.cast("string"), 9, "0")))
        .otherwise(F.concat(F.lit("u"), (cust % 100).cast("string"), F.lit("@example.test")))
    )
    changes = t("orders").select(
        key.alias("change_id"), who.alias("who"), F.when(key % 2 == 0, "pro").otherwise("free").alias("plan")
    )
    return accounts.set_plan(t("users"), changes).select("user_id", "plan", "changed")


@REG.query(
    sql="""
SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'github' WHEN 1 THEN 'discord' WHEN 2 THEN 'google' ELSE 'other' END AS provider,
       CASE WHEN c_custkey % 4 = 2 THEN concat('s', CAST(c_custkey AS VARCHAR)) ELSE CAST(c_custkey AS VARCHAR) END AS provider_account_id,
       CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 8 = 0 THEN concat('l', CAST(c_custkey AS VARCHAR)) ELSE c_name END WHEN 1 THEN 'glob' ELSE c_name END AS username,
       CASE c_custkey % 4 WHEN 0 THEN 'img' WHEN 1 THEN CASE WHEN c_custkey % 8 = 1 THEN concat('https://cdn.discordapp.com/avatars/', CAST(c_custkey AS VARCHAR), '/abc.png') ELSE '' END
            WHEN 2 THEN 'pic' ELSE 'pic' END AS avatar_url, CASE WHEN c_custkey % 3 = 0 THEN 'a@b.test' END AS email FROM customer""",
)
def profile_fields(t: Tables):
    key = F.col("c_custkey")
    provider = F.when(key % 4 == 0, "github").when(key % 4 == 1, "discord").when(key % 4 == 2, "google").otherwise("other")
    record = F.struct(
        key.alias("id"), F.concat(F.lit("s"), key.cast("string")).alias("sub"), F.when(key % 8 == 0, F.concat(F.lit("l"), key.cast("string"))).alias("login"),
        F.col("c_name").alias("name"), F.lit("glob").alias("global_name"), F.lit("img").alias("image"), F.when(key % 8 == 1, "abc").alias("avatar"),
        F.lit("pic").alias("picture"), F.when(key % 3 == 0, "a@b.test").alias("email"),
    )
    return accounts.normalise_profiles(t("customer").select(key.alias("user_id"), provider.alias("provider"), F.to_json(record).alias("profile")))


# --- keys ---------------------------------------------------------------------------------------------------


@REG.query(
    "api_keys", "users",
    sql="""
SELECT k.key_id, k.user_id, u.plan, list_contains(string_split(scopes_csv, ','), 'process') AS may_process FROM api_keys k JOIN users u ON u.user_id = k.user_id
WHERE NOT k.revoked AND u.deactivated_at IS NULL""",
)
def active_keys(t: Tables):
    live = catalog.active_keys(t("api_keys"), t("users"))
    return live.select("key_id", "user_id", "plan", catalog.allows(F.split("scopes_csv", ","), "process").alias("may_process"))


@REG.query(
    "api_keys",
    sql="SELECT key_id, user_id, name, replace(scopes_csv, ',', '+') AS scopes, sha256(raw_key) AS key_hash, substr(raw_key, 1, 11) AS key_prefix FROM api_keys WHERE scopes_csv <> 'root' AND raw_key LIKE 'tf\\_%' ESCAPE '\\' AND strlen(raw_key) = 35",
)
def new_api_keys(t: Tables):
    return catalog.new_keys(t("api_keys"))[0].withColumn("scopes", F.array_join("scopes", "+"))


@REG.query(
    "api_keys", "users",
    sql="""
a AS (SELECT k.*, u.plan FROM api_keys k LEFT JOIN users u ON u.user_id = k.user_id),
t AS (SELECT *, COALESCE(last_used_at < CAST('2024-01-15 12:00:00' AS TIMESTAMP) - INTERVAL 5 MINUTES, TRUE) AS touched FROM a)
SELECT key_id, touched, CASE WHEN touched THEN CAST('2024-01-15 12:00:00' AS TIMESTAMP) ELSE last_used_at END AS last_used_at, revoked OR COALESCE(plan = 'free', FALSE) OR key_id % 3 = 0 AS revoked FROM t""",
)
def touch_and_revoke_keys(t: Tables):
    keys = t("api_keys")
    touched = catalog.touch_keys(keys, F.lit("2024-01-15 12:00:00").cast("timestamp"))
    every = t("users").filter(F.col("plan") == "free").select("user_id", F.lit(None).cast("long").alias("key_id"))
    some = keys.filter(F.col("key_id") % 3 == 0).select("user_id", "key_id")
    return catalog.revoke_keys(touched, every.unionByName(some)).select("key_id", "touched", "last_used_at", "revoked")


# --- storage ----------------------------------------------------------------------------------------------------

USED_SQL = "used AS (SELECT u.user_id, u.plan, CAST(COALESCE(SUM(t.size_bytes), 0) AS BIGINT) AS used_bytes FROM users u LEFT JOIN tile_sets t ON t.user_id = u.user_id GROUP BY 1, 2)"


@REG.query("users", "tile_sets", sql=USED_SQL + "SELECT * FROM used")
def storage_used(t: Tables):
    return storage.used(t("users"), t("tile_sets"))


@REG.query(
    "users", "tile_sets",
    sql=USED_SQL + """, d AS (SELECT user_id, CAST(SUM(CASE tileset_id % 3 WHEN 0 THEN size_bytes WHEN 1 THEN -size_bytes ELSE size_bytes // 2 - size_bytes END) AS BIGINT) AS delta FROM tile_sets GROUP BY 1)
SELECT used.user_id, used_bytes + COALESCE(delta, 0) AS used_bytes FROM used LEFT JOIN d ON d.user_id = used.user_id""",
)
def storage_after_changes(t: Tables):
    key, size = F.col("tileset_id") % 3, F.col("size_bytes")
    log = t("tile_sets").select(
        "user_id", F.when(key == 0, "insert").when(key == 1, "delete").otherwise("update").alias("op"), size.alias("old_bytes"),
        F.when(key == 0, size).otherwise(F.floor(size / 2)).alias("new_bytes"),
    )
    return storage.apply_changes(storage.used(t("users"), t("tile_sets")), log).select("user_id", "used_bytes")


@REG.query(
    "users", "tile_sets",
    sql=USED_SQL + """
SELECT user_id, CASE WHEN plan = 'pro' THEN used_bytes ELSE 0 END AS storage_used, CAST(CASE WHEN plan = 'pro' THEN 500000000 ELSE 0 END AS BIGINT) AS storage_quota,
       CASE WHEN plan = 'pro' THEN round(least(100.0e0, used_bytes * 100.0e0 / 500000000), 6) ELSE 0.0e0 END AS percent,
       plan = 'pro' AND least(100.0e0, used_bytes * 100.0e0 / 500000000) >= 90 AS critical FROM used""",
)
def storage_view(t: Tables):
    shown = storage.storage_view(storage.used(t("users"), t("tile_sets")), 500_000_000)
    return shown.withColumn("percent", F.round("percent", 6))


ADMIT_SQL = """
up AS (SELECT request_id, user_id, ts, body_bytes * 2 AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY ts, request_id) AS n FROM upload_requests),
room AS (SELECT u.user_id, 5368709120 - COALESCE(SUM(t.size_bytes), 0) AS room FROM users u LEFT JOIN tile_sets t ON t.user_id = u.user_id GROUP BY 1),
fold AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(room AS BIGINT) AS room, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BIGINT) AS bytes, FALSE AS admitted FROM room
         UNION ALL
         SELECT f.user_id, f.n + 1, CASE WHEN up.bytes <= f.room THEN f.room - up.bytes ELSE f.room END, up.request_id, up.bytes, up.bytes <= f.room
         FROM fold f JOIN up ON up.user_id = f.user_id AND up.n = f.n + 1)
SELECT up.request_id, up.user_id, up.bytes, COALESCE(f.admitted, FALSE) AS admitted FROM up LEFT JOIN fold f ON f.request_id = up.request_id"""


@REG.query("users", "tile_sets", "upload_requests", sql=ADMIT_SQL)
def reserve_storage(t: Tables):
    asked = t("upload_requests").withColumn("bytes", storage.estimate(F.col("body_bytes")))
    return storage.admit(asked, storage.used(t("users"), t("tile_sets")))


@REG.query("users", "tile_sets", "upload_requests", sql=ADMIT_SQL)
def reserve_storage_busy_users(t: Tables):
    """The same admission with the requests of a user cut by day."""
    asked = t("upload_requests").withColumn("bytes", storage.estimate(F.col("body_bytes")))
    return storage.admit(asked, storage.used(t("users"), t("tile_sets")), piece=F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400))


@REG.query(
    "users", "job_updates",
    sql="""
once AS (SELECT job_id, MIN(user_id) AS user_id, MAX(COALESCE(tiles_done, 0)) AS bytes FROM job_updates WHERE NOT (retry_count = 3 AND retry_count IS NOT NULL) GROUP BY 1),
per AS (SELECT user_id, CAST(SUM(bytes) AS BIGINT) AS bytes FROM once WHERE bytes > 0 GROUP BY 1)
SELECT u.user_id, greatest(0, u.user_id * 3 - COALESCE(per.bytes, 0)) AS reserved_bytes FROM users u LEFT JOIN per ON per.user_id = u.user_id""",
)
def release_reservations(t: Tables):
    done = t("job_updates").select(
        "job_id", "user_id", F.col("tiles_done").alias("reserved_bytes"), F.coalesce(F.col("retry_count") == 3, F.lit(False)).alias("reservation_released")
    )
    balance = t("users").select("user_id", (F.col("user_id") * 3).alias("reserved_bytes"))
    return storage.release(balance, done)


@REG.query("tile_sets", sql="SELECT storage_path, COUNT(*) AS n_refs, CAST(SUM(size_bytes) AS BIGINT) AS bytes FROM tile_sets GROUP BY 1")
def path_references(t: Tables):
    return storage.reference_counts(t("tile_sets"))


# --- access -------------------------------------------------------------------------------------------------------


@REG.query(
    "tile_sets", "job_updates",
    sql="""
req AS (SELECT o_orderkey AS request_id, o_custkey AS caller, o_orderkey - o_orderkey % 2 AS job_id FROM orders),
own AS (SELECT job_id, arg_max(user_id, event_id) AS owner FROM job_updates GROUP BY 1),
st AS (SELECT storage_path, arg_min(user_id, tileset_id) AS owner FROM tile_sets GROUP BY 1)
SELECT request_id, req.job_id, caller, CASE WHEN COALESCE(own.owner, st.owner) = caller THEN 'ok' ELSE 'not_found' END AS outcome
FROM req LEFT JOIN own ON own.job_id = req.job_id LEFT JOIN st ON st.storage_path = concat('tiles/', CAST(req.job_id AS VARCHAR))""",
)
def archive_access(t: Tables):
    key = F.col("o_orderkey")
    asked = t("orders").select(key.alias("request_id"), F.col("o_custkey").alias("caller"), (key - key % 2).alias("job_id"))
    return catalog.archive_access(asked, t("job_updates"), t("tile_sets"))




COLLIDING_SQL = """
new AS (SELECT o_orderkey AS request_id, o_custkey AS user_id, concat('c', CAST(o_orderkey % 3 AS VARCHAR)) AS slug,
               concat('tiles/', CAST(20000000 + o_custkey * 4 + o_orderkey % 4 AS VARCHAR)) AS storage_path FROM orders
        UNION ALL SELECT -1 - o_orderkey, o_custkey + 1, 'mine', concat('tiles/', CAST(20000000 + o_custkey * 4 + o_orderkey % 4 AS VARCHAR)) FROM orders WHERE o_orderkey % 11 = 0),
p AS (SELECT *, MIN(request_id) OVER (PARTITION BY storage_path) AS head, first_value(user_id) OVER (PARTITION BY storage_path ORDER BY request_id) AS head_user FROM new),
a AS (SELECT *, CASE WHEN head = request_id THEN 'insert' WHEN head_user = user_id THEN 'update' ELSE 'not_found' END AS action FROM p),
s AS (SELECT user_id, slug, MIN(request_id) AS slug_head FROM a WHERE action = 'insert' GROUP BY 1, 2),
z AS (SELECT a.request_id, a.user_id, a.slug, a.storage_path, CASE WHEN action = 'insert' AND slug_head <> request_id THEN 'conflict' ELSE action END AS action FROM a LEFT JOIN s USING (user_id, slug))
SELECT *, CAST(NULL AS BIGINT) AS tileset_id, CASE WHEN action = 'insert' THEN CAST(7 AS BIGINT) END AS stored_bytes FROM z"""


@REG.query("tile_sets", sql=COLLIDING_SQL)
def finalise_colliding_rows(t: Tables):
    """Rows of one batch that share paths and slugs."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    path = text.tile_prefix(20_000_000 + cust * 4 + key % 4)
    rows = t("orders").select(key.alias("request_id"), cust.alias("user_id"), F.concat(F.lit("c"), (key % 3).cast("string")).alias("slug"), path.alias("storage_path"))
    others = t("orders").filter(key % 11 == 0).select((-1 - key).alias("request_id"), (cust + 1).alias("user_id"), F.lit("mine").alias("slug"), path.alias("storage_path"))
    new = rows.unionByName(others)
    stored = new.select("storage_path").distinct().withColumn("size_bytes", F.lit(7).cast("long"))
    return catalog.finalise(t("tile_sets"), new, new.select("storage_path", "user_id").distinct(), stored)


@REG.query(
    "api_keys", "users",
    sql="""
k AS (SELECT k.*, u.plan FROM api_keys k JOIN users u ON u.user_id = k.user_id WHERE NOT revoked AND u.deactivated_at IS NULL),
req AS (SELECT event_id AS request_id, concat('tf_', lpad(CAST(event_id % 60 AS VARCHAR), 32, '0')) AS raw_key FROM events WHERE event_id % 7 <> 0
        UNION ALL SELECT event_id, 'nonsense' FROM events WHERE event_id % 7 = 0)
SELECT request_id, key_id, k.user_id, plan, CASE WHEN key_id IS NULL THEN 'unauthorized' WHEN list_contains(string_split(scopes_csv, ','), 'process') THEN 'ok' ELSE 'forbidden' END AS outcome
FROM req LEFT JOIN k ON k.raw_key = req.raw_key AND strlen(k.raw_key) = 35""",
)
def key_access(t: Tables):
    """Keys looked up by digest, most requests with a few popular ones."""
    stored = t("api_keys").withColumns({"key_hash": validate.key_hash(F.col("raw_key")), "scopes": F.split("scopes_csv", ",")})
    raw = F.concat(F.lit("tf_"), F.lpad((F.col("event_id") % 60).cast("string"), 32, "0"))
    asked = t("events").select(F.col("event_id").alias("request_id"), F.when(F.col("event_id") % 7 == 0, "nonsense").otherwise(raw).alias("raw_key"))
    return catalog.key_access(asked, stored.drop("raw_key"), t("users"), "process")


@REG.query(
    "projects",
    sql=f"""
w AS (SELECT o_orderkey AS request_id, o_custkey * 10 + o_orderkey % 4 AS project_id, CASE WHEN o_orderkey % 9 = 0 THEN o_custkey + 1 ELSE o_custkey END AS user_id,
             CASE o_orderkey % 5 WHEN 0 THEN 'Project 1' WHEN 1 THEN 'Fresh' WHEN 2 THEN '' ELSE concat('Name ', CAST(o_orderkey % 2 AS VARCHAR)) END AS name FROM orders),
m AS (SELECT w.*, p.project_id IS NOT NULL AS mine, n.project_id AS named FROM w LEFT JOIN projects p ON p.project_id = w.project_id AND p.user_id = w.user_id
      LEFT JOIN projects n ON n.user_id = w.user_id AND n.name = w.name),
b AS (SELECT *, name <> '' AND mine AND (named IS NULL OR named = project_id) AS able FROM m),
f AS (SELECT user_id, name, arg_min(project_id, request_id) AS head FROM b WHERE able GROUP BY 1, 2),
o AS (SELECT b.*, CASE WHEN b.name = '' THEN 'invalid' WHEN NOT mine THEN 'not_found' WHEN NOT able OR head <> project_id THEN 'conflict' ELSE 'updated' END AS outcome FROM b LEFT JOIN f USING (user_id, name))
SELECT request_id, project_id, user_id, name, CASE WHEN request_id % 2 = 0 THEN 'about' END AS description, outcome, CASE WHEN outcome = 'updated' THEN {AS_OF_SQL} END AS updated_at FROM o""",
)
def update_projects(t: Tables):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    name = (
        F.when(key % 5 == 0, " Project 1 ").when(key % 5 == 1, "Fresh").when(key % 5 == 2, "  ").otherwise(F.concat(F.lit("Name "), (key % 2).cast("string")))
    )
    wanted = t("orders").select(
        key.alias("request_id"), (cust * 10 + key % 4).alias("project_id"), F.when(key % 9 == 0, cust + 1).otherwise(cust).alias("user_id"),
        name.alias("name"), F.when(key % 2 == 0, " about ").otherwise("  ").alias("description"),
    )
    return catalog.update_projects(t("projects"), wanted, as_of())


@REG.query(sql=f"SELECT user_id, event_type AS type, concat('Event ', CAST(event_id AS VARCHAR)) AS title, NULL AS message, FALSE AS is_read, {AS_OF_SQL} AS created_at FROM events WHERE event_id % 4 <> 0")
def new_notifications(t: Tables):
    """Every fourth title is too long and turned away."""
    title = F.concat(F.lit("Event "), F.col("event_id").cast("string"), F.when(F.col("event_id") % 4 == 0, F.repeat(F.lit("x"), 300)).otherwise(""))
    wanted = t("events").select("user_id", F.col("event_type").alias("type"), title.alias("title"), F.lit(None).cast("string").alias("message"))
    return catalog.new_notifications(wanted, as_of())[0]
