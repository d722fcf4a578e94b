"""Catalogue of tile sets, projects, notifications and keys: tables in, DataFrame out.

Time is always an explicit ``as_of`` column or literal, never the clock, so that a job can be replayed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, validate
from ..plans.hotkeys import attach, first_per_key, lookup
from ..session import cut_lineage

# Page sizes and windows.
TILE_SET_PAGE, JOB_PAGE, MAX_PAGE = 50, 20, 100
LATEST_NOTIFICATIONS = 50
PURGE_DAYS = 30
KEY_TOUCH_MINUTES = 5
WEB_SCOPES = "read,process,manage"


def page_window(page: int | None, per_page: int | None, default: int = TILE_SET_PAGE) -> tuple[int, int]:
    """(limit, offset) with the page size clamped to 1..100 and pages counted from one."""
    size = min(MAX_PAGE, max(1, default if per_page is None else per_page))
    return size, (max(1, page or 1) - 1) * size


def newest_first(df: DataFrame, key: str, limit: int, offset: int) -> DataFrame:
    """Top-k with a tie-break on the key; Spark runs this as take-ordered, not as a full sort."""
    return df.orderBy(F.desc("created_at"), F.col(key)).offset(offset).limit(limit)


# --- tile sets --------------------------------------------------------------------------------


def list_tile_sets(
    tile_sets: DataFrame,
    caller: int | None = None,
    target: int | None = None,
    search: str | None = None,
    project: int | None = None,
    unfiled: bool = False,
    page: int | None = None,
    per_page: int | None = None,
) -> DataFrame:
    """One page, newest first; private rows only when the caller asks for their own."""
    owner = caller if target is None else target
    df = tile_sets
    if owner is not None:
        df = df.filter(F.col("user_id") == owner)
    if owner is None or owner != caller:
        df = df.filter("is_public")
    if search is not None:
        df = df.filter(text.contains_ci(F.col("name"), F.lit(search)))
    if project is not None:
        df = df.filter(F.col("project_id") == project)
    if unfiled:
        df = df.filter(F.col("project_id").isNull())
    return newest_first(df, "tileset_id", *page_window(page, per_page))


def first_pages(rows: DataFrame, key: str, per_page: int) -> DataFrame:
    """The first page of every user in one job, and whether a next page exists (one row more is read)."""
    ranked = first_per_key(rows, ["user_id"], per_page + 1, [F.desc("created_at"), F.col(key)])
    more = ranked.filter(F.col("rn") > per_page).select("user_id", F.lit(True).alias("has_next"))
    return (
        ranked.filter(F.col("rn") <= per_page)
        .join(more, "user_id", "left")
        .withColumn("has_next", F.coalesce("has_next", F.lit(False)))
    )


def visible_by_slug(requests: DataFrame, tile_sets: DataFrame) -> DataFrame:
    """Requests (caller, slug) with the tile set that is public or the caller's own, else not found.

    Slugs are unique for a user only; of several that the caller may see, the one with the smallest id is shown.
    """
    public = tile_sets.filter("is_public").groupBy("slug").agg(F.min("tileset_id").alias("_public"))
    own = tile_sets.groupBy("slug", F.col("user_id").alias("caller")).agg(F.min("tileset_id").alias("_own"))
    met = lookup(lookup(requests, public, ["slug"], ["request_id"]), own, ["slug", "caller"], ["request_id"])
    found = F.least("_public", "_own")
    return met.select(
        "request_id", "caller", "slug", found.alias("tileset_id"), F.when(found.isNotNull(), "ok").otherwise("not_found").alias("outcome")
    )


def apply_patches(tile_sets: DataFrame, patches: DataFrame, projects: DataFrame) -> DataFrame:
    """New version of the table after all patches in order of their ``patch_id``: given fields replace, the project is cleared, set when
    owned, or kept.

    A patch that names a project of somebody else changes nothing. Of several patches of a tile set each field has the value of the last
    one that gives it, so they are folded to one row before they meet the table.
    """
    owned = projects.select("project_id", "user_id").withColumn("_owned", F.lit(True))
    usable = patches.join(owned, ["project_id", "user_id"], "left").filter(F.col("project_id").isNull() | F.col("_owned"))
    clears = F.coalesce("clear_project", F.lit(False))

    def last(value: Column, given: Column) -> Column:
        return F.max_by(value, F.when(given, F.col("patch_id")))

    folded = usable.groupBy("user_id", "slug").agg(
        last(F.col("name"), F.col("name").isNotNull()).alias("_name"),
        last(F.col("is_public"), F.col("is_public").isNotNull()).alias("_public"),
        last(F.struct(F.when(~clears, F.col("project_id")).alias("id")), clears | F.col("project_id").isNotNull()).alias("_project"),
        F.lit(True).alias("_patched"),
    )
    patched = tile_sets.join(folded, ["user_id", "slug"], "left")
    return patched.select(
        *[c for c in tile_sets.columns if c not in ("name", "is_public", "project_id")],
        F.coalesce("_name", "name").alias("name"),
        F.coalesce("_public", "is_public").alias("is_public"),
        F.when(F.col("_project").isNull(), F.col("project_id")).otherwise(F.col("_project.id")).alias("project_id"),
        F.coalesce("_patched", F.lit(False)).alias("patched"),
    )


def delete_tile_sets(tile_sets: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, storage paths nobody refers to any more) after deleting (user_id, slug) requests."""
    keys = ["user_id", "slug"]
    asked = requests.select(*keys).groupBy(*keys).agg(F.lit(1).alias("_one")).drop("_one")
    remaining = tile_sets.join(asked, keys, "left_anti")
    # One grouped pass instead of a self join: a path is orphaned when all its references are deleted.
    marked = tile_sets.join(asked.withColumn("_gone", F.lit(1)), keys, "left")
    references = marked.groupBy("storage_path").agg(
        F.count("_gone").alias("deleted"), (F.count("*") - F.count("_gone")).alias("left_over")
    )
    orphaned = references.filter((F.col("deleted") > 0) & (F.col("left_over") == 0)).select("storage_path", "deleted")
    return remaining, orphaned


def object_keys(paths: DataFrame) -> DataFrame:
    """The stored objects of each storage path."""
    suffix = F.explode(F.array(*[F.lit(s) for s in text.TILE_OBJECTS]))
    return paths.select("storage_path", suffix.alias("suffix")).select(
        F.concat_ws("/", "storage_path", "suffix").alias("object_key")
    )


def finalise(tile_sets: DataFrame, incoming: DataFrame, finished: DataFrame, objects: DataFrame) -> DataFrame:
    """What each incoming catalogue row does: update its owner's row, insert, or be turned away.

    ``finished`` holds (storage_path, user_id) of complete jobs, ``objects`` the stored size per path. An update may not take a slug of
    another row. Of several rows of one batch that would insert the same path, the first (by request_id) does; the others of its user
    update that new row, whose id is not known yet, and those of other users find nothing. Then, of several that would insert the same
    slug of a user, the first does and the others conflict.

    The rows meet the four tables once and are kept; only those that would insert go through the steps that look for first ones.
    """
    by_path = tile_sets.groupBy("storage_path").agg(
        F.min(F.struct("tileset_id", "user_id")).alias("_old"), F.lit(0).alias("_zero")
    ).select("storage_path", F.col("_old.tileset_id").alias("_old_id"), F.col("_old.user_id").alias("_old_user"))
    slugs = tile_sets.groupBy("user_id", "slug").agg(F.min("tileset_id").alias("_slug_id"))
    done = finished.groupBy("storage_path", "user_id").agg(F.lit(True).alias("_finished"))
    rows = (
        incoming.join(by_path, "storage_path", "left")
        .join(slugs, ["user_id", "slug"], "left")
        .join(done, ["storage_path", "user_id"], "left")
        .join(objects.select("storage_path", F.col("size_bytes").alias("_stored")), "storage_path", "left")
    )
    mine = F.col("_old_id").isNotNull() & (F.col("_old_user") == F.col("user_id"))
    action = (
        F.when(mine & (F.col("_slug_id") != F.col("_old_id")), "conflict")
        .when(mine, "update")
        .when(F.col("_old_id").isNotNull() | F.col("_finished").isNull() | F.col("_stored").isNull(), "not_found")
        .when(F.col("_slug_id").isNotNull(), "conflict")
        .otherwise("insert")
    )
    judged = cut_lineage(rows.select(*incoming.columns, "_old_id", "_stored", action.alias("action")))

    def first_of(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
        firsts = rows.filter("action = 'insert'").groupBy(*keys).agg(F.min_by(value, "request_id").alias(name), F.count("*").alias("_n"))
        return attach(rows, firsts, keys, ["request_id"])

    inserts = F.col("action") == "insert"
    new = judged.filter(inserts)
    by_path = first_of(new, ["storage_path"], F.struct("request_id", "user_id"), "_head")
    later = inserts & (F.col("_head.request_id") != F.col("request_id"))
    same = F.col("_head.user_id") == F.col("user_id")
    by_path = by_path.withColumn("action", F.when(later & same, "update").when(later, "not_found").otherwise(F.col("action"))).drop("_head")
    by_slug = first_of(by_path, ["user_id", "slug"], F.col("request_id"), "_slug_head")
    taken = inserts & (F.col("_slug_head") != F.col("request_id"))
    settled = by_slug.withColumn("action", F.when(taken, "conflict").otherwise(F.col("action"))).drop("_slug_head")
    return settled.unionByName(judged.filter(~inserts)).select(
        *incoming.columns, "action",
        F.when(F.col("action") == "update", F.col("_old_id")).alias("tileset_id"),
        F.when(F.col("action") == "insert", F.col("_stored")).alias("stored_bytes"),
    )


def rows_from_jobs(done: DataFrame, existing: DataFrame) -> DataFrame:
    """Catalogue rows of finished jobs, leaving out (user_id, slug) pairs that exist already.

    A job that is delivered again inserts nothing: of the rows of a pair the one with the smallest ``delivery`` counts.
    """
    from ..functions import geo

    zmin, zmax = F.coalesce("min_zoom", F.lit(0)).cast("int"), F.col("max_zoom").cast("int")
    rows = done.filter(F.col("user_id").isNotNull()).select(
        "user_id",
        text.tile_set_name(F.col("file_name"), F.col("job_id")).alias("name"),
        F.col("job_id").cast("string").alias("slug"),
        F.coalesce("projection", F.lit("flat")).alias("projection"),
        F.coalesce("tile_size", F.lit(256)).alias("tile_size"),
        zmin.alias("min_zoom"), zmax.alias("max_zoom"),
        geo.total_tiles(zmin, zmax).alias("tile_count"),
        (F.col("zip_bytes") + F.col("archive_bytes")).alias("size_bytes"),
        text.tile_prefix(F.col("job_id")).alias("storage_path"),
        F.coalesce("tile_format", F.lit("png")).alias("tile_format"),
        F.least(F.lit(100), F.greatest(F.lit(1), F.coalesce("quality", F.lit(85)))).alias("tile_quality"),
        "delivery",
    )
    values = [c for c in rows.columns if c not in ("user_id", "slug", "delivery")]
    first = rows.groupBy("user_id", "slug").agg(F.min(F.struct("delivery", *values)).alias("_first"))
    rows = first.select("user_id", "slug", *[F.col(f"_first.{c}").alias(c) for c in values])
    return rows.join(existing.select("user_id", "slug"), ["user_id", "slug"], "left_anti")


def archive_access(requests: DataFrame, progress: DataFrame, tile_sets: DataFrame) -> DataFrame:
    """Requests (request_id, caller, job_id): the latest progress record's owner decides, else the tile set's."""
    owner = progress.groupBy("job_id").agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("_progress_owner"))
    stored = tile_sets.groupBy("storage_path").agg(F.min_by("user_id", "tileset_id").alias("_stored_owner"))
    asked = requests.withColumn("storage_path", text.tile_prefix(F.col("job_id")))
    met = lookup(lookup(asked, owner, ["job_id"], ["request_id"]), stored, ["storage_path"], ["request_id"])
    allowed = F.coalesce("_progress_owner", "_stored_owner") == F.col("caller")
    return met.select(
        "request_id", "job_id", "caller", F.when(allowed, "ok").otherwise("not_found").alias("outcome")
    )


def unfinished_jobs(jobs: DataFrame, tile_sets: DataFrame) -> DataFrame:
    """Jobs still to be shown: not complete, or complete with no tile set under their id."""
    slugs = tile_sets.groupBy("slug").agg(F.lit(True).alias("_catalogued"))
    met = jobs.withColumn("slug", F.col("job_id").cast("string")).join(slugs, "slug", "left")
    return met.filter((F.col("status") != "complete") | F.col("_catalogued").isNull()).drop("slug", "_catalogued")


# --- projects -----------------------------------------------------------------------------------


def project_counts(projects: DataFrame, tile_sets: DataFrame) -> DataFrame:
    """Projects with their number of tile sets. Counting before the join keeps a huge project off one task."""
    counts = tile_sets.filter(F.col("project_id").isNotNull()).groupBy("project_id").agg(F.count("*").alias("_n"))
    return projects.join(counts, "project_id", "left").withColumn(
        "tileset_count", F.coalesce("_n", F.lit(0).cast("long"))
    ).drop("_n")


def create_projects(projects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Outcome per wanted project (request_id, user_id, name, description): created, conflict or invalid.

    Names are trimmed, an empty description becomes null, and the first request for a name wins.
    """
    clean = validate.report(wanted, validate.PROJECT).withColumn("name", F.trim("name")).withColumn(
        "description", F.nullif(F.trim("description"), F.lit(""))
    )
    valid = F.size("violations") == 0
    first = clean.filter(valid).groupBy("user_id", "name").agg(
        F.min("request_id").alias("_first"), F.count("*").alias("_n")
    )
    taken = projects.groupBy("user_id", "name").agg(F.lit(True).alias("_taken"))
    first = first.join(taken, ["user_id", "name"], "left")
    met = attach(clean, first, ["user_id", "name"], ["request_id"])
    outcome = F.when(~valid, "invalid").when(
        F.col("_taken").isNotNull() | (F.col("_first") != F.col("request_id")), "conflict"
    ).otherwise("created")
    return met.select("request_id", "user_id", "name", "description", outcome.alias("outcome"))


def update_projects(projects: DataFrame, wanted: DataFrame, as_of: Column) -> DataFrame:
    """Outcome per wanted change (request_id, project_id, user_id, name, description): updated, conflict, not_found or invalid.

    Only the owner's project is changed. Names are trimmed and an empty description becomes null. A name that another project of the owner
    has, or that an earlier request of the batch gives to another project, is a conflict.
    """
    clean = validate.report(wanted, validate.PROJECT).withColumn("name", F.trim("name")).withColumn(
        "description", F.nullif(F.trim("description"), F.lit(""))
    )
    owned = projects.select("project_id", "user_id", F.lit(True).alias("_mine"))
    named = projects.groupBy("user_id", "name").agg(F.min("project_id").alias("_named"))
    met = clean.join(owned, ["project_id", "user_id"], "left").join(named, ["user_id", "name"], "left")
    able = (F.size("violations") == 0) & F.col("_mine").isNotNull() & (F.col("_named").isNull() | (F.col("_named") == F.col("project_id")))
    first = met.filter(able).groupBy("user_id", "name").agg(F.min_by("project_id", "request_id").alias("_first"), F.count("*").alias("_n"))
    rows = attach(met, first, ["user_id", "name"], ["request_id"])
    outcome = (
        F.when(F.size("violations") > 0, "invalid")
        .when(F.col("_mine").isNull(), "not_found")
        .when(~able | (F.col("_first") != F.col("project_id")), "conflict")
        .otherwise("updated")
    )
    changed = rows.withColumn("outcome", outcome)
    return changed.select(
        "request_id", "project_id", "user_id", "name", "description", "outcome", F.when(F.col("outcome") == "updated", as_of).alias("updated_at")
    )


def delete_projects(projects: DataFrame, tile_sets: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining projects, tile sets with the deleted projects cleared); ``gone`` has (project_id, user_id)."""
    ids = projects.join(gone, ["project_id", "user_id"], "left_semi").select("project_id")
    cleared = tile_sets.join(ids.withColumn("_gone", F.lit(True)), "project_id", "left").withColumn(
        "project_id", F.when(F.col("_gone").isNull(), F.col("project_id"))
    )
    return projects.join(ids, "project_id", "left_anti"), cleared.drop("_gone")


# --- notifications --------------------------------------------------------------------------------


def latest_notifications(notifications: DataFrame, k: int = LATEST_NOTIFICATIONS) -> DataFrame:
    return first_per_key(notifications, ["user_id"], k, [F.desc("created_at"), F.desc("notification_id")])


def unread_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(F.count_if(~F.col("is_read")).alias("unread"), F.count("*").alias("total"))


def mark_read(notifications: DataFrame, users: DataFrame) -> DataFrame:
    """All notifications of the given users become read."""
    asked = users.select("user_id").distinct().withColumn("_asked", F.lit(True))
    return notifications.join(asked, "user_id", "left").withColumn(
        "is_read", F.col("is_read") | F.coalesce("_asked", F.lit(False))
    ).drop("_asked")


def clear_notifications(notifications: DataFrame, users: DataFrame) -> DataFrame:
    return notifications.join(users.select("user_id"), "user_id", "left_anti")


def new_notifications(wanted: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(unread rows to store, rejected requests with their violations) of wanted notifications (user_id, type, title, message)."""
    valid, rejected = validate.split(wanted, validate.NOTIFICATION)
    rows = valid.select("user_id", "type", "title", "message", F.lit(False).alias("is_read"), as_of.alias("created_at"))
    return rows, rejected


def broadcast(users: DataFrame, kind: str, title: str, message: str | None, as_of: Column) -> DataFrame:
    """One unread row per active user; the message is a literal, so there is nothing to join."""
    return users.filter(F.col("deactivated_at").isNull()).select(
        "user_id", F.lit(kind).alias("type"), F.lit(title).alias("title"), F.lit(message).alias("message"),
        F.lit(False).alias("is_read"), as_of.alias("created_at"),
    )


# --- keys -------------------------------------------------------------------------------------------


def new_keys(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to store, rejected): the key itself is replaced by its digest and prefix."""
    valid, rejected = validate.split(wanted.withColumn("scopes", F.split("scopes_csv", ",")), validate.API_KEY)
    raw = F.col("raw_key")
    stored = valid.filter(validate.is_api_key(raw)).select(
        "key_id", "user_id", "name", "scopes", validate.key_hash(raw).alias("key_hash"), validate.key_prefix(raw).alias("key_prefix")
    )
    return stored, rejected


def active_keys(keys: DataFrame, users: DataFrame) -> DataFrame:
    """Keys that are not revoked, of users that are not deactivated, with the user's plan."""
    active = users.filter(F.col("deactivated_at").isNull()).select("user_id", "plan")
    return keys.filter(~F.col("revoked")).join(active, "user_id")


def key_access(requests: DataFrame, keys: DataFrame, users: DataFrame, scope: str) -> DataFrame:
    """Requests (request_id, raw_key) with the user and plan behind their key and whether it has the scope.

    Keys are found by their digest, so the stored table never holds a key itself; unknown, revoked and malformed keys and those of
    deactivated users are turned away.
    """
    known = active_keys(keys, users).select(
        "key_hash", F.struct("key_id", "user_id", "plan", allows(F.col("scopes"), scope).alias("may")).alias("_key")
    )
    hashed = requests.withColumn("key_hash", F.when(validate.is_api_key(F.col("raw_key")), validate.key_hash(F.col("raw_key"))))
    met = lookup(hashed, known, ["key_hash"], ["request_id"])
    outcome = F.when(F.col("_key").isNull(), "unauthorized").when(~F.col("_key.may"), "forbidden").otherwise("ok")
    return met.select("request_id", *[F.col(f"_key.{c}").alias(c) for c in ("key_id", "user_id", "plan")], outcome.alias("outcome"))


def allows(scopes: Column, needed: str) -> Column:
    return F.array_contains(scopes, needed)


def touch_keys(keys: DataFrame, as_of: Column) -> DataFrame:
    """Set last use, at most every five minutes."""
    due = F.col("last_used_at").isNull() | (
        F.col("last_used_at") < as_of - F.expr(f"INTERVAL {KEY_TOUCH_MINUTES} MINUTES")
    )
    return keys.withColumn("touched", due).withColumn("last_used_at", F.when(due, as_of).otherwise(F.col("last_used_at")))


def revoke_keys(keys: DataFrame, requests: DataFrame) -> DataFrame:
    """Revoke by (user_id, key_id); a null key_id means all keys of the user."""
    every = requests.filter(F.col("key_id").isNull()).select("user_id").distinct().withColumn("_all", F.lit(True))
    one = requests.filter(F.col("key_id").isNotNull()).select("user_id", "key_id").distinct().withColumn("_one", F.lit(True))
    return (
        keys.join(every, "user_id", "left")
        .join(one, ["user_id", "key_id"], "left")
        .withColumn("revoked", F.col("revoked") | F.coalesce("_all", "_one", F.lit(False)))
        .drop("_all", "_one")
    )
