"""Queries over archive directories, lookups, encoded tiles, headers and stored objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import archive, encode, pyramid, raster, routing
from ..sources import images, manifest, sinks, tilefiles
from ..streaming.run import new_folder
from .fixtures import Registry, Tables
from .raster_queries import GREY_TILES_SQL, GREY_TS, HEAT_TS, HEAT_ZOOM, STRIP_ALL, STRIP_SQL, grey_tiles, merge_sql, window_sql

REG = Registry()


def hilbert_sql(source: str, out: str, steps: int) -> str:
    """Chain of expressions that walks the curve from side 2^(steps-1) down to 1 for rows with x, y, z."""
    parts = [f"{out}_{steps} AS (SELECT *, CAST(tx AS BIGINT) AS hx, CAST(ty AS BIGINT) AS hy, CAST(0 AS BIGINT) AS hd FROM {source})"]
    for k in range(steps - 1, -1, -1):
        s = 1 << k
        rx, ry = f"CASE WHEN hx & {s} > 0 THEN 1 ELSE 0 END", f"CASE WHEN hy & {s} > 0 THEN 1 ELSE 0 END"
        parts.append(f"""{out}_{k}a AS (SELECT *, z > {k} AS live, {rx} AS rx, {ry} AS ry FROM {out}_{k + 1}{'' if k + 1 == steps else 'b'}),
{out}_{k}b AS (SELECT * EXCLUDE (hx, hy, hd, live, rx, ry),
  CASE WHEN NOT live THEN hx WHEN ry = 0 THEN CASE WHEN rx = 1 THEN {s - 1} - hy ELSE hy END ELSE hx END AS hx,
  CASE WHEN NOT live THEN hy WHEN ry = 0 THEN CASE WHEN rx = 1 THEN {s - 1} - hx ELSE hx END ELSE hy END AS hy,
  CASE WHEN live THEN hd + {s * s} * xor(3 * rx, ry) ELSE hd END AS hd FROM {out}_{k}a)""")
    parts.append(f"{out} AS (SELECT * EXCLUDE (hx, hy, hd), ((CAST(1 AS BIGINT) << CAST(2 * z AS INT)) - 1) // 3 + hd AS tile_id FROM {out}_0b)")
    return ",\n".join(parts)


@REG.query(
    "tile_sets",
    sql="s AS (SELECT tileset_id, max_zoom AS z, (tileset_id * 31) % (1 << max_zoom) AS tx, (tileset_id * 17) % (1 << max_zoom) AS ty FROM tile_sets),"
    + hilbert_sql("s", "h", 9) + "SELECT tileset_id, tile_id FROM h",
)
def curve_positions(t: Tables):
    side = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("max_zoom"))
    x, y = (F.col("tileset_id") * 31) % side, (F.col("tileset_id") * 17) % side
    return t("tile_sets").select("tileset_id", archive.tile_id(F.col("max_zoom"), x, y).alias("tile_id"))


@REG.query(
    "tile_sets",
    sql="""
SELECT user_id AS raster_id, max_zoom AS z, (tileset_id * 31) % (1 << max_zoom) AS tx, (tileset_id * 17) % (1 << max_zoom) AS ty,
       row_number() OVER (ORDER BY user_id, max_zoom, (tileset_id * 17) % (1 << max_zoom), (tileset_id * 31) % (1 << max_zoom)) - 1 AS position FROM tile_sets""",
)
def tile_order(t: Tables):
    """The places that rows have in the files once they are put into tile order."""
    side = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("max_zoom"))
    tiles = t("tile_sets").select(
        F.col("user_id").alias("raster_id"), F.col("max_zoom").alias("z"), ((F.col("tileset_id") * 31) % side).alias("tx"),
        ((F.col("tileset_id") * 17) % side).alias("ty"),
    )
    return sinks.with_positions(sinks.in_tile_order(tiles))


def quantised_tiles(t: Tables):
    """Two-tone tiles of the sample rasters, so that equal contents and runs do occur, with all levels."""
    tone = F.when(F.col("r") >= 128, 1).otherwise(0)
    px = pyramid.build(grey_tiles(t), GREY_TS, 1).withColumn("tone", F.when((F.col("tx") + F.col("ty")) % 2 == 0, 0).otherwise(tone))
    cells = px.groupBy("raster_id", "z", "tx", "ty").agg(F.sort_array(F.collect_list(F.struct("oy", "ox", "tone"))).alias("cells"))
    return cells.select(
        "raster_id", "z", "tx", "ty", F.array_join(F.transform("cells", lambda c: c["tone"].cast("string")), "").alias("content")
    ).withColumn("content", F.when(F.col("z") == 0, F.concat("content", F.lit("-top"))).otherwise(F.col("content")))


TILE_CONTENT_SQL = GREY_TILES_SQL + "," + merge_sql("top", "up", 4) + """,
al AS (SELECT raster_id, z, tx, ty, ox, oy, r FROM up UNION ALL SELECT raster_id, z, tx, ty, ox, oy, r FROM top),
ct AS (SELECT raster_id, z, tx, ty, concat(string_agg(CASE WHEN (tx + ty) % 2 = 0 THEN '0' WHEN r >= 128 THEN '1' ELSE '0' END, '' ORDER BY oy, ox), CASE WHEN z = 0 THEN '-top' ELSE '' END) AS content
       FROM al GROUP BY 1, 2, 3, 4),
""" + hilbert_sql("ct", "h", 2) + """,
en AS (SELECT raster_id, z, tile_id, strlen(content) AS length, sha256(content) AS digest, content FROM h)"""


@REG.query(
    "raster_samples",
    sql=TILE_CONTENT_SQL + """,
fi AS (SELECT raster_id, digest, MIN(tile_id) AS first_id, MAX(length) AS length FROM en GROUP BY 1, 2),
os AS (SELECT *, SUM(length) OVER (PARTITION BY raster_id ORDER BY first_id) - length AS off FROM fi),
rn AS (SELECT *, tile_id - row_number() OVER (PARTITION BY raster_id, digest ORDER BY tile_id) AS grp FROM en)
SELECT rn.raster_id, MIN(rn.tile_id) AS tile_id, COUNT(*) AS run_length, CAST(MIN(os.off) AS BIGINT) AS "offset", MIN(rn.length) AS length
FROM rn JOIN os ON os.raster_id = rn.raster_id AND os.digest = rn.digest GROUP BY rn.raster_id, rn.digest, grp""",
)
def archive_directory(t: Tables):
    return archive.directory(quantised_tiles(t))


@REG.query(
    "raster_samples",
    sql=TILE_CONTENT_SQL + """,
fi AS (SELECT raster_id, digest, MIN(tile_id) AS first_id, MAX(length) AS length FROM en GROUP BY 1, 2),
os AS (SELECT *, SUM(length) OVER (PARTITION BY raster_id ORDER BY first_id) - length AS off FROM fi),
rq AS (SELECT raster_id, tile_id + (k * (k - 1)) * 10000 + k AS tile_id, tile_id * 10 + k AS request_id FROM en, range(-1, 3) r(k))
SELECT rq.request_id, rq.raster_id, rq.tile_id, CAST(os.off AS BIGINT) AS "offset", en.length
FROM rq LEFT JOIN en ON en.raster_id = rq.raster_id AND en.tile_id = rq.tile_id LEFT JOIN os ON os.raster_id = en.raster_id AND os.digest = en.digest""",
)
def directory_lookup(t: Tables):
    """Ids inside runs, beside their ends, between runs and beyond the last one, each asked for several times."""
    tiles = quantised_tiles(t)
    k = F.col("k")
    asked = archive.entries(tiles).select("raster_id", "tile_id", F.explode(F.array(*[F.lit(n) for n in (-1, 0, 1, 2)])).alias("k")).select(
        (F.col("tile_id") * 10 + k).alias("request_id"), "raster_id", (F.col("tile_id") + k * (k - 1) * 10000 + k).alias("tile_id")
    )
    return archive.directory_lookup(asked, archive.directory(tiles))


@REG.query(
    "raster_samples",
    sql=TILE_CONTENT_SQL + """
SELECT e.raster_id, MIN(z) AS min_zoom, MAX(z) AS max_zoom, COUNT(*) AS addressed_tiles, COUNT(DISTINCT digest) AS tile_contents,
       (SELECT CAST(SUM(l) AS BIGINT) FROM (SELECT digest, MAX(length) AS l FROM en d WHERE d.raster_id = e.raster_id GROUP BY 1) q) AS data_bytes,
       2 AS tile_type, 1 AS tile_compression, 2 AS internal_compression FROM en e GROUP BY 1""",
)
def archive_header(t: Tables):
    return archive.header(quantised_tiles(t))


@REG.query("raster_samples", sql=TILE_CONTENT_SQL + "SELECT raster_id, CAST(z AS INT) AS z, COUNT(*) AS tiles, CAST(SUM(length) AS BIGINT) AS bytes FROM en GROUP BY 1, 2")
def tiles_per_level(t: Tables):
    return archive.per_level(quantised_tiles(t))


@REG.query(
    "raster_samples",
    sql=TILE_CONTENT_SQL + """
SELECT w.vec_id AS raster_id, 1 AS z, CAST(label % 3 AS INT) AS tx, 1 AS ty, substr(content, 3, 5) AS piece FROM embeddings w
LEFT JOIN ct ON ct.raster_id = w.vec_id AND ct.z = 1 AND ct.tx = label % 3 AND ct.ty = 1""",
)
def tile_lookup(t: Tables):
    wanted = t("embeddings").select(
        F.col("vec_id").alias("raster_id"), F.lit(1).alias("z"), (F.col("label") % 3).cast("int").alias("tx"), F.lit(1).alias("ty")
    )
    found = archive.lookup(wanted, quantised_tiles(t))
    return found.select("raster_id", "z", "tx", "ty", archive.byte_range(F.col("content"), F.lit(2), F.lit(5)).alias("piece"))


@REG.query("raster_samples", sql=TILE_CONTENT_SQL + "SELECT raster_id, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, content FROM ct WHERE z = 1 AND tx BETWEEN 1 AND 1 AND ty BETWEEN 0 AND 1")
def tiles_in_view(t: Tables):
    return archive.visible_window(quantised_tiles(t), 1, 1, 1, 0, 1).select("raster_id", "tx", "ty", "content")


@REG.query(
    "raster_samples",
    sql=TILE_CONTENT_SQL + "SELECT raster_id, concat(CAST(z AS VARCHAR), '/', CAST(tx AS VARCHAR), '/', CAST(ty AS VARCHAR), '.jpg') AS path FROM ct",
)
def tile_paths(t: Tables):
    return sinks.with_paths(quantised_tiles(t), "jpeg").select("raster_id", "path")


BLOCK_SQL = GREY_TILES_SQL + "," + merge_sql("top", "up", 4) + """,
al AS (SELECT raster_id, z, tx, ty, ox, oy, r FROM up UNION ALL SELECT raster_id, z, tx, ty, ox, oy, r FROM top)
SELECT raster_id, CAST(z AS INT) AS z, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, string_agg(concat(repeat(lpad(hex(r), 2, '0'), 3), 'FF'), '' ORDER BY oy, ox) AS rgba FROM al GROUP BY 1, 2, 3, 4"""


@REG.query("raster_samples", sql=BLOCK_SQL)
def block_pyramid(t: Tables):
    """The block form of the pyramid, checked against the same SQL as the relational form."""
    blocks = encode.pack_blocks(grey_tiles(t), GREY_TS)
    return encode.build_blocks(blocks, GREY_TS, 1).withColumn("rgba", F.hex("rgba"))


@REG.query("raster_samples", sql=GREY_TILES_SQL + "SELECT raster_id, 1 AS z, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, CAST(ox AS INT) AS ox, CAST(oy AS INT) AS oy, r, g, b, a FROM top")
def block_round_trip(t: Tables):
    return encode.unpack_blocks(encode.pack_blocks(grey_tiles(t), GREY_TS), GREY_TS)


@REG.query(
    "raster_samples",
    sql=GREY_TILES_SQL + "SELECT DISTINCT raster_id, CAST(z AS INT) AS z, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, TRUE AS is_png, CAST(4 AS BIGINT) AS width, CAST(4 AS BIGINT) AS height FROM top",
)
def encoded_png_headers(t: Tables):
    """Encode every tile as PNG and read the size back from the file bytes."""
    files = encode.encode_png(encode.pack_blocks(grey_tiles(t), GREY_TS), GREY_TS)
    return images.sniff_headers(files).select("raster_id", "z", "tx", "ty", "is_png", "width", "height")


def dense_sql(source: str) -> str:
    """Hex of whole 10x10 tiles, clear where there is no pixel, from tile pixels in ``source``."""
    colour = "concat(" + ", ".join(f"lpad(hex({c}), 2, '0')" for c in "rgba") + ")"
    return f"""
SELECT k.raster_id, CAST(k.z AS INT) AS z, CAST(k.tx AS INT) AS tx, CAST(k.ty AS INT) AS ty, string_agg(CASE WHEN s.r IS NULL THEN '00000000' ELSE {colour} END, '' ORDER BY p.p) AS rgba
FROM (SELECT DISTINCT raster_id, z, tx, ty FROM {source}) k JOIN range(100) p(p) ON TRUE
LEFT JOIN {source} s ON s.raster_id = k.raster_id AND s.z = k.z AND s.tx = k.tx AND s.ty = k.ty AND s.oy * 10 + s.ox = p.p GROUP BY 1, 2, 3, 4"""


@REG.query("heat_pixels", sql=STRIP_SQL + f", al AS ({STRIP_ALL})" + dense_sql("al"))
def block_strip_pyramid(t: Tables):
    """Window method in block form, checked against the same SQL as the relational form."""
    return encode.strip_blocks(t("heat_pixels"), HEAT_TS, HEAT_ZOOM).withColumn("rgba", F.hex("rgba"))


MIXED = """
SELECT raster_id, CASE WHEN raster_id % 2 = 0 THEN 16 ELSE 32 END AS width, CASE WHEN raster_id % 2 = 0 THEN 12 ELSE 24 END AS height, x, y, r, g, b, a
FROM {source} WHERE raster_id % 2 = 1 OR (x < 16 AND y < 12)"""
MIXED_SQL = (
    f"mixed AS ({MIXED.format(source='heat_pixels')}), halves AS (SELECT * FROM mixed WHERE width = 16), wholes AS (SELECT * FROM mixed WHERE width = 32),"
    + window_sql("win16", "flat", "halves", 16, 12, "16") + "," + window_sql("win32", "flat", "wholes", 32, 24, "32")
    + ", win AS (SELECT * FROM win16 UNION ALL SELECT * FROM win32)," + merge_sql("win", "up1", 10) + "," + merge_sql("up1", "up0", 10)
)


@REG.query("heat_pixels", sql=MIXED_SQL + f", al AS ({STRIP_ALL})" + dense_sql("al"))
def routed_pyramid(t: Tables):
    """Rasters of 768 and of 3,072 bytes, of which the larger go by row."""
    mixed = t.spark.sql(MIXED.format(source="{source}"), source=t("heat_pixels"))
    return routing.routed_pyramid(mixed, HEAT_TS, HEAT_ZOOM, HEAT_ZOOM, limit=1000).withColumn("rgba", F.hex("rgba"))


@REG.query("heat_pixels", sql=window_sql("win", "mercator") + dense_sql("win"))
def block_windows_mercator(t: Tables):
    return encode.window_blocks(t("heat_pixels"), HEAT_TS, HEAT_ZOOM, "mercator").withColumn("rgba", F.hex("rgba"))


@REG.query(
    "headers",
    sql="""
SELECT raster_id, substr(header_hex, 1, 16) = '89504E470D0A1A0A' AS is_png, substr(header_hex, 1, 8) IN ('49492A00', '4D4D002A', '49492B00', '4D4D002B') AS is_tiff,
       CASE WHEN substr(header_hex, 1, 16) = '89504E470D0A1A0A' AND length(header_hex) >= 48 THEN CAST('0x' || substr(header_hex, 33, 8) AS BIGINT) END AS width,
       CASE WHEN substr(header_hex, 1, 16) = '89504E470D0A1A0A' AND length(header_hex) >= 48 THEN CAST('0x' || substr(header_hex, 41, 8) AS BIGINT) END AS height FROM headers""",
)
def sniff_headers(t: Tables):
    files = t("headers").withColumn("content", F.unhex("header_hex"))
    return images.sniff_headers(files).select("raster_id", "is_png", "is_tiff", "width", "height")


@REG.query(
    sql="""
SELECT concat('tiles/', CAST(o_orderkey AS VARCHAR)) AS storage_path, CAST(SUM(l_partkey) FILTER (l_linenumber % 3 = 1) + SUM(l_partkey) FILTER (l_linenumber % 3 = 2) AS BIGINT) AS size_bytes
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING SUM(l_partkey) FILTER (l_linenumber % 3 = 1) IS NOT NULL AND SUM(l_partkey) FILTER (l_linenumber % 3 = 2) IS NOT NULL""",
)
def stored_sizes(t: Tables):
    part = F.when(F.col("l_linenumber") % 3 == 1, "tiles.zip").when(F.col("l_linenumber") % 3 == 2, "tiles.pmtiles").otherwise("thumbnail.jpg")
    lines = t("lineitem").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    objects = lines.select(
        F.concat(F.lit("store/tiles/"), F.col("l_orderkey").cast("string"), F.lit("/"), part).alias("path"), F.col("l_partkey").alias("bytes")
    )
    return manifest.tile_set_sizes(objects)


# --- writing and reading back -------------------------------------------------------------------------


def grey_png_files(t: Tables):
    return encode.encode_png(encode.pack_blocks(grey_tiles(t), GREY_TS), GREY_TS)


@REG.query(
    "raster_samples",
    sql=GREY_TILES_SQL + "SELECT raster_id, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, CAST(ox AS INT) AS x, CAST(oy AS INT) AS y, r, g, b, a FROM top",
)
def image_file_round_trip(t: Tables):
    """Encode every tile, write the files, and read them back through the image source."""
    folder = new_folder(t.spark, "images")
    sinks.write_files(grey_png_files(t), folder)
    read = images.read_samples(t.spark, folder, "*.png")
    parts = [F.regexp_extract("origin", r"/(\d+)/(\d+)/(\d+)/(\d+)\.png$", i) for i in range(1, 5)]
    named = read.withColumn("raster_id", F.concat_ws("/", parts[0], parts[2], parts[3]))
    px = raster.band_pixels(named.withColumn("level", F.col("v").cast("int")))
    key = F.split("raster_id", "/")
    return px.select(
        key[0].cast("long").alias("raster_id"), key[1].cast("int").alias("tx"), key[2].cast("int").alias("ty"), "x", "y", "r", "g", "b", "a"
    )


@REG.query(
    "raster_samples",
    sql=GREY_TILES_SQL + "SELECT raster_id, COUNT(*) AS files, TRUE AS sized FROM (SELECT DISTINCT raster_id, tx, ty FROM top) q GROUP BY 1",
)
def listed_objects(t: Tables):
    """Write every tile as a file and list what is stored."""
    folder = new_folder(t.spark, "objects")
    sinks.write_files(grey_png_files(t), folder)
    raster_id = F.regexp_extract("path", r"/(\d+)/\d+/\d+/\d+\.png$", 1).cast("long")
    return manifest.list_objects(t.spark, folder).groupBy(raster_id.alias("raster_id")).agg(
        F.count("*").alias("files"), (F.min("bytes") > 60).alias("sized")
    )


@REG.query(
    "raster_samples",
    sql=TILE_CONTENT_SQL + "SELECT raster_id, CAST(z AS INT) AS z, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, h.tile_id, content, concat(CAST(z AS VARCHAR), '/', CAST(tx AS VARCHAR), '/', CAST(ty AS VARCHAR), '.png') AS path FROM h",
)
def tile_table_round_trip(t: Tables):
    """Write all tiles partitioned by zoom in curve order and read the table back."""
    folder = new_folder(t.spark, "tiles")
    sinks.write_tiles(quantised_tiles(t), f"{folder}/tiles")
    return sinks.read_tiles(t.spark, f"{folder}/tiles").select("raster_id", "z", "tx", "ty", "tile_id", "content", "path")


@REG.query(
    "raster_samples",
    sql=TILE_CONTENT_SQL + "SELECT raster_id, CAST(z AS INT) AS z, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, content FROM h",
)
def committed_tile_files(t: Tables):
    """All tiles written as files by tasks that are committed together, and read by zoom."""
    folder = new_folder(t.spark, "tilefiles")
    tilefiles.write_committed(quantised_tiles(t), folder, "txt")
    return tilefiles.read_committed(t.spark, folder).withColumn("content", F.col("content").cast("string"))


@REG.query(
    "raster_samples",
    sql=TILE_CONTENT_SQL + "SELECT 'paths' AS output, COUNT(*) AS rows FROM ct UNION ALL SELECT 'directory', COUNT(*) FROM (SELECT DISTINCT raster_id, digest, tile_id - rn FROM (SELECT *, row_number() OVER (PARTITION BY raster_id, digest ORDER BY tile_id) AS rn FROM en) q) q2",
)
def tee_two_outputs(t: Tables):
    """One computation of the tiles feeds the tile table and the archive directory."""
    folder = new_folder(t.spark, "tee")
    sinks.tee(
        quantised_tiles(t),
        lambda df: sinks.write_tiles(df, f"{folder}/tiles"),
        lambda df: archive.directory(df).write.parquet(f"{folder}/directory"),
    )
    written = t.spark.read.parquet(f"{folder}/tiles").agg(F.lit("paths").alias("output"), F.count("*").alias("rows"))
    listed = t.spark.read.parquet(f"{folder}/directory").agg(F.lit("directory").alias("output"), F.count("*").alias("rows"))
    return written.unionByName(listed)
