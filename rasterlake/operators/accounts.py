"""Users and their provider accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.hotkeys import attach, lookup
from ..session import cut_lineage

# How long a deactivated user can come back.
WINDOW_DAYS = 30
WINDOW_MICROS = 30 * 86_400_000_000

CASCADE = ("tile_sets", "api_keys", "notifications", "accounts", "jobs", "projects")


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def purge(tables: dict[str, DataFrame], as_of: Column) -> dict[str, DataFrame]:
    """Remove users deactivated more than thirty days ago and their rows everywhere.

    Returns the new tables, ``purged`` with the removed users and ``paths`` with the storage to delete.
    """
    users = tables["users"]
    old = F.coalesce(F.col("deactivated_at") < as_of - F.expr(f"INTERVAL {WINDOW_DAYS} DAYS"), F.lit(False))
    gone = users.filter(old).select("user_id")
    out = {"users": users.filter(~old), "purged": gone}
    for name in CASCADE:
        if name in tables:
            out[name] = tables[name].join(gone, "user_id", "left_anti")
    if "tile_sets" in tables:
        out["paths"] = tables["tile_sets"].join(gone, "user_id", "left_semi").select("storage_path").distinct()
    return out


def deactivate(users: DataFrame, keys: DataFrame, requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(users, keys) after stamping the asked users once and revoking their keys."""
    asked = requests.select("user_id").distinct().withColumn("_asked", F.lit(True))
    stamped = users.join(asked, "user_id", "left").withColumn(
        "deactivated_at", F.when(F.col("_asked") & F.col("deactivated_at").isNull(), as_of).otherwise(F.col("deactivated_at"))
    )
    revoked = keys.join(asked, "user_id", "left").withColumn("revoked", F.col("revoked") | F.coalesce("_asked", F.lit(False)))
    return stamped.drop("_asked"), revoked.drop("_asked")


def may_sign_in_again(deactivated_at: Column, as_of: Column) -> Column:
    """Within thirty times twenty-four hours, inclusive, and not in the future."""
    gap = _micros(as_of) - _micros(deactivated_at)
    return (gap >= 0) & (gap <= WINDOW_MICROS)


def reactivate(users: DataFrame, as_of: Column) -> DataFrame:
    """Outcome of both ways back: the service call keeps the plan, a sign-in resets it to free."""
    off = F.col("deactivated_at").isNotNull()
    whole_days = F.timestamp_diff("DAY", F.col("deactivated_at"), as_of)
    service = F.when(~off, "active").when(whole_days > WINDOW_DAYS, "expired").otherwise("reactivated")
    sign_in = F.when(~off, "active").when(may_sign_in_again(F.col("deactivated_at"), as_of), "reactivated").otherwise("expired")
    return users.withColumn("service_outcome", service).withColumn("sign_in_outcome", sign_in).withColumn(
        "plan_after_sign_in", F.when(F.col("sign_in_outcome") == "reactivated", "free").otherwise(F.col("plan"))
    )


def linkable(accounts: DataFrame) -> DataFrame:
    """Accounts that may be unlinked: their user has more than one."""
    many = accounts.groupBy("user_id").agg(F.count("*").alias("n_accounts")).filter(F.col("n_accounts") > 1)
    return accounts.join(many, "user_id")


def primary_account(accounts: DataFrame) -> DataFrame:
    """The account created first, per user."""
    order = F.struct("created_at", "provider", "provider_account_id")
    return accounts.groupBy("user_id").agg(
        F.min_by("provider", order).alias("provider"),
        F.min_by("avatar_url", order).alias("avatar_url"),
        F.min("created_at").alias("created_at"),
        F.count("*").alias("n_accounts"),
    )


def avatar_from(users: DataFrame, accounts: DataFrame, choices: DataFrame) -> DataFrame:
    """Choices (user_id, provider) with the avatar of that provider's account, null when not linked."""
    found = accounts.groupBy("user_id", "provider").agg(F.min("avatar_url").alias("avatar_url"))
    return users.select("user_id").join(choices, "user_id").join(found, ["user_id", "provider"], "left")


def resolve_identities(users: DataFrame, accounts: DataFrame, incoming: DataFrame) -> DataFrame:
    """Which user each signed-in identity belongs to, as if they came one by one in ``identity_id`` order.

    An identity goes to the user of its (provider, provider_account_id) pair; else, when its email is verified,
    to the user with that email in any case; else a new user is made, named by the identity that caused it. A
    link request goes to the given user unless the pair belongs to somebody else or the user does not exist.
    """
    pair = ["provider", "provider_account_id"]
    known = accounts.groupBy(*pair).agg(F.min("user_id").alias("_pair_user"))
    alive = users.select(F.col("user_id").alias("link_user_id"), F.lit(True).alias("_link_ok"))
    rows = lookup(incoming.join(known, pair, "left"), alive, ["link_user_id"], ["identity_id"]).withColumn(
        "_missing",
        F.col("_pair_user").isNull() & F.col("link_user_id").isNotNull() & F.col("_link_ok").isNull(),
    )

    # The first identity of every new pair decides for the pair.
    first = F.struct("identity_id", "link_user_id", "email", "email_verified")
    fresh = (
        rows.filter(F.col("_pair_user").isNull() & ~F.col("_missing"))
        .groupBy(*pair)
        .agg(F.min_by(first, "identity_id").alias("_head"), F.count("*").alias("_n"))
        .select(*pair, "_n", F.col("_head.identity_id").alias("_head_id"), F.col("_head.link_user_id").alias("_head_link"),
                F.lower(F.col("_head.email")).alias("_email"), F.coalesce(F.col("_head.email_verified"), F.lit(False)).alias("_verified"))
    )
    by_email = users.groupBy(F.lower("email").alias("_email")).agg(F.min("user_id").alias("_email_user"))
    fresh = lookup(fresh, by_email, ["_email"], ["_head_id"]).withColumn(
        "_email_user", F.when(F.col("_verified") & F.col("_head_link").isNull(), F.col("_email_user"))
    )
    # One row per new pair, used several times below.
    fresh = cut_lineage(fresh)

    # New users: a verified email joins the user that the earliest new identity with that email made.
    makes = F.col("_head_link").isNull() & F.col("_email_user").isNull()
    earliest = (
        fresh.filter(makes & F.col("_email").isNotNull())
        .groupBy("_email")
        .agg(F.min("_head_id").alias("_maker"), F.count("*").alias("_n"))
    )
    heads = attach(fresh, earliest, ["_email"], ["_head_id"])
    maker = F.when(makes & F.col("_verified"), F.coalesce("_maker", "_head_id")).when(makes, F.col("_head_id"))
    per_pair = heads.select(
        *pair, "_n", "_head_id", F.coalesce("_head_link", "_email_user").alias("_new_user"), maker.alias("_made_by")
    )

    met = attach(rows, per_pair, pair, ["identity_id"])
    user = F.coalesce("_pair_user", "_new_user")
    is_head = F.col("identity_id") == F.col("_head_id")
    wants_link = F.col("link_user_id").isNotNull()
    outcome = (
        F.when(F.col("_missing"), "missing_user")
        .when(wants_link & ~F.coalesce(user == F.col("link_user_id"), F.lit(False)), "conflict")
        .when(wants_link & is_head & F.col("_pair_user").isNull(), "linked")
        .when(F.col("_pair_user").isNotNull() | ~is_head, "existing")
        .when(F.col("_new_user").isNotNull() | (F.col("_made_by") != F.col("identity_id")), "linked_by_email")
        .otherwise("created")
    )
    refused = F.col("outcome").isin("missing_user", "conflict")
    return met.withColumn("outcome", outcome).select(
        "identity_id", "outcome",
        F.when(~refused, user).alias("user_id"),
        F.when(~refused & user.isNull(), F.col("_made_by")).alias("created_by"),
    )


def plans_from_events(users: DataFrame, events: DataFrame) -> DataFrame:
    """Users with the plan their latest subscription event gives them."""
    latest = events.groupBy("customer_ref").agg(
        F.max_by(F.struct("kind", "status"), F.struct("ts", "event_id")).alias("_e")
    )
    given = (
        F.when(F.col("_e.kind") == "completed", "pro")
        .when(F.col("_e.kind") == "deleted", "free")
        .when(F.col("_e.kind") == "updated", F.when(F.col("_e.status") == "active", "pro").otherwise("free"))
    )
    return users.join(latest, "customer_ref", "left").withColumn("plan", F.coalesce(given, "plan")).drop("_e")


def set_plan(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply changes (change_id, who, plan) where ``who`` is an id, a user name or an email.

    The three-way OR becomes one equi join over a key column; the latest change of a user wins.
    """
    names = F.array_distinct(F.array(F.col("user_id").cast("string"), F.col("username"), F.col("email")))
    keyed = users.select("user_id", F.explode(names).alias("who"))
    wanted = changes.groupBy("who").agg(F.max(F.struct("change_id", F.col("plan").alias("p"))).alias("_c"))
    per_user = keyed.join(wanted, "who").groupBy("user_id").agg(F.max("_c").alias("_c"))
    return users.join(per_user, "user_id", "left").withColumn("changed", F.col("_c").isNotNull()).withColumn(
        "plan", F.coalesce(F.col("_c.p"), F.col("plan"))
    ).drop("_c")


def normalise_profiles(profiles: DataFrame) -> DataFrame:
    """Provider profiles (JSON in ``profile``) to one shape, with each provider's fallbacks."""
    names = ("id", "sub", "login", "name", "username", "global_name", "avatar_url", "image", "avatar", "picture", "email")
    fields = F.from_json("profile", ", ".join(f"{n} STRING" for n in names))
    p = profiles.withColumn("_p", fields)
    f = {n: F.col(f"_p.{n}") for n in names}
    none = F.lit("")
    provider = F.col("provider")
    account = F.when(provider.isin("github", "discord"), f["id"]).when(provider == "google", f["sub"]).otherwise(
        F.coalesce(f["id"], f["sub"])
    )
    username = (
        F.when(provider == "github", F.coalesce(f["login"], f["name"], none))
        .when(provider == "discord", F.coalesce(f["username"], f["global_name"], none))
        .otherwise(F.coalesce(f["name"], none))
    )
    discord_avatar = F.concat(F.lit("https://cdn.discordapp.com/avatars/"), f["id"], F.lit("/"), f["avatar"], F.lit(".png"))
    avatar = (
        F.when(provider == "github", F.coalesce(f["avatar_url"], f["image"], none))
        .when(provider == "discord", F.coalesce(F.when(F.length(f["avatar"]) > 0, discord_avatar), none))
        .when(provider == "google", F.coalesce(f["picture"], none))
        .otherwise(F.coalesce(f["picture"], f["image"], none))
    )
    return p.select(
        *[c for c in profiles.columns if c != "profile"], account.alias("provider_account_id"),
        username.alias("username"), avatar.alias("avatar_url"), f["email"].alias("email"),
    )
