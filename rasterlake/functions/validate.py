"""Rule sets: named predicates that tell which rules a row breaks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import MAX_SERVICE_ZOOM

# A rule set maps a rule name to a predicate that holds for a *bad* row.
Rules = dict[str, Callable[[], Column]]

# Accepted options and limits.
TILE_SIZES = (128, 256, 512)
PROJECTIONS = ("flat", "mercator", "isometric")
REQUEST_FORMATS = ("png", "jpeg", "jpg", "webp")
STORED_FORMATS = ("png", "jpeg", "webp")
SCOPES = ("read", "process", "manage")
MAX_UPLOAD_BYTES = 500 * 1024 * 1024
API_KEY_PATTERN = "^tf_.*$"
API_KEY_LENGTH = 35
API_KEY_PREFIX_LENGTH = 11
UUID_PATH = "^tiles/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
CONTROL = r"[\x{0}-\x{1F}\x{7F}-\x{9F}]"


def _c(name: str, default=None) -> Column:
    return F.col(name) if default is None else F.coalesce(F.col(name), F.lit(default))


def has_control(text: Column) -> Column:
    return F.coalesce(text.rlike(CONTROL), F.lit(False))


TILE_REQUEST: Rules = {
    "tile_size": lambda: ~_c("tile_size", 256).isin(*TILE_SIZES),
    "max_zoom": lambda: F.col("max_zoom") > MAX_SERVICE_ZOOM,
    "projection": lambda: ~_c("projection", "flat").isin(*PROJECTIONS),
    "format": lambda: ~_c("tile_format", "png").isin(*REQUEST_FORMATS),
    "quality": lambda: ~_c("quality", 85).between(1, 100),
}

TILE_SET: Rules = {
    "name": lambda: (F.length(F.trim("name")) == 0) | (F.octet_length("name") > 200),
    "slug": lambda: ~F.col("slug").rlike("^[A-Za-z0-9._-]{1,100}$"),
    "projection": lambda: ~_c("projection", "flat").isin(*PROJECTIONS),
    "tile_size": lambda: ~_c("tile_size", 256).isin(*TILE_SIZES),
    "tile_format": lambda: ~_c("tile_format", "png").isin(*STORED_FORMATS),
    "tile_quality": lambda: ~_c("tile_quality", 85).between(1, 100),
    "zoom": lambda: (_c("min_zoom", 0) < 0)
    | (F.col("max_zoom") < _c("min_zoom", 0))
    | (F.col("max_zoom") > MAX_SERVICE_ZOOM),
    "counts": lambda: (F.col("tile_count") <= 0) | (F.col("size_bytes") <= 0),
    "storage_path": lambda: ~F.col("storage_path").rlike(UUID_PATH),
}

IDEMPOTENCY: Rules = {
    "idempotency_key": lambda: (F.octet_length("idempotency_key") == 0)
    | (F.octet_length("idempotency_key") > 128)
    | has_control(F.col("idempotency_key")),
}

PROJECT: Rules = {
    "name": lambda: ~F.char_length(F.trim("name")).between(1, 100) | has_control(F.col("name")),
    "description": lambda: (F.char_length("description") > 500) | has_control(F.col("description")),
}

NOTIFICATION: Rules = {
    "type": lambda: F.octet_length("type") > 50,
    "title": lambda: F.octet_length("title") > 200,
    "message": lambda: F.octet_length("message") > 1000,
}

API_KEY: Rules = {
    "name": lambda: ~F.char_length(F.trim("name")).between(1, 64) | has_control(F.col("name")),
    "scopes": lambda: (F.size("scopes") == 0)
    | (F.size(F.array_except("scopes", F.array(*[F.lit(s) for s in SCOPES]))) > 0),
}

UPLOAD: Rules = {
    "empty": lambda: F.col("body_bytes") == 0,
    "too_large": lambda: F.col("body_bytes") > MAX_UPLOAD_BYTES,
    "tiff_needs_pro": lambda: F.col("is_tiff") & (F.col("plan") != "pro"),
    "key_needs_pro": lambda: F.col("idempotency_key").isNotNull() & (F.col("plan") != "pro"),
}


def violations(rules: Rules) -> Column:
    """Names of the broken rules; a predicate that is null on a missing value counts as not broken."""
    checks = [F.when(F.coalesce(bad(), F.lit(False)), F.lit(name)) for name, bad in rules.items()]
    return F.array_compact(F.array(*checks))


def report(df: DataFrame, rules: Rules) -> DataFrame:
    return df.withColumn("violations", violations(rules))


def split(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their violations)."""
    checked = report(df, rules)
    valid = checked.filter(F.size("violations") == 0).drop("violations")
    return valid, checked.filter(F.size("violations") > 0)


def is_api_key(key: Column) -> Column:
    return key.rlike(API_KEY_PATTERN) & (F.octet_length(key) == API_KEY_LENGTH)


def key_prefix(key: Column) -> Column:
    return F.substring(key, 1, API_KEY_PREFIX_LENGTH)


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)
