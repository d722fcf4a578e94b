"""String, key and JSON helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Object key layout.
TILE_OBJECTS = ("tiles.zip", "tiles.pmtiles", "thumbnail.jpg")
ARCHIVE_OBJECTS = ("tiles.zip", "tiles.pmtiles")


def upload_key(job_id: Column) -> Column:
    return F.concat(F.lit("uploads/"), job_id.cast("string"), F.lit(".bin"))


def tile_prefix(job_id: Column) -> Column:
    return F.concat(F.lit("tiles/"), job_id.cast("string"))


def tile_path(z: Column, x: Column, y: Column, fmt: Column) -> Column:
    return F.concat_ws("/", z.cast("string"), x.cast("string"), F.concat(y.cast("string"), F.lit("."), extension(fmt)))


def extension(fmt: Column) -> Column:
    return F.when(fmt.isin("jpeg", "jpg"), "jpg").when(fmt == "webp", "webp").otherwise("png")


def like_escape(query: Column) -> Column:
    """Escape the LIKE wildcards of a search text."""
    return F.regexp_replace(query, r"([\\%_])", r"\\$1")


def contains_ci(text: Column, query: Column) -> Column:
    """Case-insensitive literal containment: the same rows as ILIKE over the escaped text, without a pattern."""
    return F.contains(F.lower(text), F.lower(query))


def base_name(file_name: Column) -> Column:
    """File name after the last slash without its last extension."""
    tail = F.regexp_extract(file_name, r"([^/]*)$", 1)
    return F.regexp_replace(tail, r"\.[^.]*$", "")


def tile_set_name(file_name: Column, job_id: Column) -> Column:
    fallback = F.concat(F.lit("Tileset "), F.substring(job_id.cast("string"), 1, 8))
    name = base_name(file_name)
    return F.when(F.length(name) > 0, name).otherwise(fallback)


def client_ip(cf_ip: Column, forwarded: Column, peer: Column) -> Column:
    first_hop = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.coalesce(F.trim(cf_ip), first_hop, peer, F.lit("unknown"))


JOB_SCHEMA = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("tile_size", T.LongType()),
        T.StructField("min_zoom", T.LongType()),
        T.StructField("max_zoom", T.LongType()),
        T.StructField("projection", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("reserved_bytes", T.LongType()),
        T.StructField("scale", T.DoubleType()),
        T.StructField("background_color", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("quality", T.IntegerType()),
    ]
)

# Ordered classes of error texts (title, pattern); the first match wins.
ERROR_CLASSES = [
    ("Out of Memory", "memory|out of memory|oom|allocation failed|heap"),
    ("Browser Memory Limit Reached", "memory access out of bounds|unreachable|wasm trap"),
    ("Not Enough Browser Storage", "quotaexceeded|quota exceeded|storage quota|not enough space"),
    ("Invalid Image", "decode|decoding|invalid image|unsupported format|corrupt"),
    ("Unsupported Format", "unsupported|not supported"),
    ("Engine Failed to Load", "wasm init|wasm.*failed|module.*initialized|instantiate"),
    ("Connection Error", "network|fetch|failed to fetch|connection|offline"),
    ("Request Timed Out", "timeout|timed out"),
    ("Server Unavailable", "server.*unavailable|503|502|504"),
    ("Rate Limited", "rate limit|too many requests|429"),
    ("Access Denied", "unauthorized|401|forbidden|403"),
    ("Storage Full", "quota|storage.*full|disk.*space"),
    ("Download Failed", "download failed|failed.*download"),
    ("Connection Lost", "lost connection|connection.*lost|disconnected"),
]
DEFAULT_ERROR_CLASS = "Something Went Wrong"
FINAL_ERRORS = "unsupported|invalid image|corrupt"


def error_class(message: Column) -> Column:
    """Title of the first matching class: one CASE, so no join with a pattern table is needed."""
    lowered = F.lower(message)
    matched = F.lit(None).cast("string")
    for title, pattern in reversed(ERROR_CLASSES):
        matched = F.when(lowered.rlike(pattern), title).otherwise(matched)
    return F.coalesce(matched, F.lit(DEFAULT_ERROR_CLASS))


def is_recoverable(message: Column) -> Column:
    return ~F.lower(message).rlike(FINAL_ERRORS)
