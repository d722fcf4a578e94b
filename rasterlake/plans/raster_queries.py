"""Queries over rasters, tiles and their arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color, geo, text, validate
from ..functions.color import CHANNELS, Background
from ..operators import pyramid, raster, tiling
from ..sources import images, pixels
from ..streaming.run import new_folder
from .fixtures import Registry, Tables

REG = Registry()
HEAT_TS = 10  # tile size for the 32x24 rasters: canvases of 10, 20 and 40 pixels
HEAT_ZOOM = 2
GREY_TS = 4  # tile size for the 8x8 rasters: zooms 0 and 1
SAND = Background(200, 180, 140, 255)
GLASS = Background(10, 120, 240, 128)

# --- scalar arithmetic --------------------------------------------------------------------------


@REG.query(
    "image_dims",
    sql="""
zooms AS (SELECT d.*, (SELECT COUNT(*) FROM range(32) t(z) WHERE CAST(tile_size AS BIGINT) * (CAST(1 AS BIGINT) << z) < greatest(width, height)) AS zmax FROM image_dims d)
SELECT raster_id, CAST(zmax AS INT) AS max_zoom,
       CAST((SELECT SUM(CAST(1 AS BIGINT) << (2 * z)) FROM range(32) t(z) WHERE z <= zmax) AS BIGINT) AS total_tiles,
       CAST(1 AS BIGINT) << CAST(2 * zmax AS INT) AS tiles_at_max,
       CAST(greatest(1, CAST(width AS BIGINT) * 2 * tile_size // greatest(width, height)) AS INT) AS fit_w,
       CAST(greatest(1, CAST(height AS BIGINT) * 2 * tile_size // greatest(width, height)) AS INT) AS fit_h,
       CAST(greatest(1, trunc(width * 0.37)) AS INT) AS scaled_w, width AS kept_w
FROM zooms""",
)
def zoom_arithmetic(t: Tables):
    w, h, ts = F.col("width"), F.col("height"), F.col("tile_size")
    zmax = geo.max_zoom(w, h, ts)
    return t("image_dims").select(
        "raster_id", zmax.alias("max_zoom"), geo.total_tiles(0, zmax).alias("total_tiles"),
        geo.tiles_at(zmax).alias("tiles_at_max"),
        geo.fit(w, w, h, 1, ts).alias("fit_w"), geo.fit(h, w, h, 1, ts).alias("fit_h"),
        geo.prescale(w, 0.37).alias("scaled_w"), geo.prescale(w, 1.0005).alias("kept_w"),
    )


MERC = "(1.4844222297453324e0 - atan(sinh(pi() * (1.0 - 2.0 * ({t}))))) / (2.0 * 1.4844222297453324e0)"


@REG.query(
    "image_dims",
    sql=f"""
SELECT raster_id, round({MERC.format(t="CAST(height AS DOUBLE) / 20001")}, 9) AS source_y,
       round({MERC.format(t="(height % 8) / 8.0e0")}, 9) AS row_start, round({MERC.format(t="(height % 8 + 1) / 8.0e0")}, 9) AS row_end
FROM image_dims""",
)
def mercator_rows(t: Tables):
    low, high = geo.row_range(F.col("height") % 8, 8)
    return t("image_dims").select(
        "raster_id", F.round(geo.mercator_y(F.col("height").cast("double") / 20001), 9).alias("source_y"),
        F.round(low, 9).alias("row_start"), F.round(high, 9).alias("row_end"),
    )


@REG.query(
    "image_dims",
    sql="""
SELECT raster_id, CAST(width AS BIGINT) * height * 4 AS decoded_bytes,
       CASE WHEN CAST(width AS BIGINT) * height * 4 > 268435456 THEN CASE WHEN tile_format = 'png' THEN 'row_streaming' ELSE 'strip' END
            ELSE 'naive' END AS strategy
FROM image_dims""",
)
def processing_strategy(t: Tables):
    w, h = F.col("width"), F.col("height")
    return t("image_dims").select(
        "raster_id", geo.decoded_bytes(w, h).alias("decoded_bytes"),
        geo.strategy(F.col("tile_format") == "png", w, h).alias("strategy"),
    )


@REG.query(
    "image_dims",
    sql="""
z AS (SELECT d.raster_id, d.width, d.height, COALESCE(max_zoom,
        CAST((SELECT COUNT(*) FROM range(32) t(z) WHERE CAST(tile_size AS BIGINT) * (CAST(1 AS BIGINT) << z) < greatest(width, height)) AS INT)) AS zmax FROM image_dims d)
SELECT raster_id, width, height, 0 AS min_zoom, CAST(zmax AS INT) AS max_zoom, CAST(zmax + 1 AS INT) AS zoom_levels,
       CAST(((CAST(1 AS HUGEINT) << CAST(2 * zmax + 2 AS INT)) - 1) // 3 AS BIGINT) AS total_tiles, CAST(NULL AS VARCHAR) AS error FROM z""",
)
def run_summary(t: Tables):
    return raster.run_summary(t("image_dims"))


@REG.query(
    "heat_pixels",
    sql="""
SELECT s.raster_id, CAST(g.z AS INT) AS z, CAST(x.x AS INT) AS tx, CAST(y.y AS INT) AS ty
FROM (SELECT DISTINCT raster_id FROM heat_pixels) s JOIN range(4) g(z) ON TRUE
JOIN range(8) x(x) ON x.x < (1 << CAST(g.z AS INT)) JOIN range(8) y(y) ON y.y < (1 << CAST(g.z AS INT))""",
)
def tile_grid(t: Tables):
    return geo.tile_grid(raster.image_sizes(t("heat_pixels")).select("raster_id"), 0, 3)


# --- georeference ----------------------------------------------------------------------------

GEO_SQL = """
g AS (SELECT *, CASE WHEN geo_keys[10] = 0 AND geo_keys[12] > 0 AND geo_keys[9] IN (2048, 3072) THEN geo_keys[12] END AS epsg,
             CASE WHEN scale[1] > 0 AND scale[2] > 0 THEN tie[4] - tie[1] * scale[1] END AS west,
             CASE WHEN scale[1] > 0 AND scale[2] > 0 THEN tie[5] + tie[2] * scale[2] END AS north FROM geo_tags),
b AS (SELECT *, north - height * scale[2] AS south, west + width * scale[1] AS east FROM g)
SELECT raster_id, CAST(epsg AS INT) AS epsg, west, south, east, north, scale[1] AS scale_x, TRUE AS georeferenced,
       COALESCE(epsg = 4326 AND west <= -179 AND east >= 179 AND south <= -89 AND north >= 89, FALSE) AS is_global,
       COALESCE(projection, CASE WHEN epsg = 4326 AND west <= -179 AND east >= 179 AND south <= -89 AND north >= 89 THEN 'mercator' ELSE 'flat' END) AS projection,
       1.0e0 / (raster_id + 1) * 4.0 AS per_unit, CAST(raster_id + 1 AS DOUBLE) / 256 * 4.0 AS per_tile
FROM b"""


@REG.query("geo_tags", sql=GEO_SQL)
def georeference(t: Tables):
    keys, scale, tie = F.col("geo_keys"), F.col("scale"), F.col("tie")
    code = geo.epsg(keys)
    box = geo.bounds(F.col("width"), F.col("height"), scale, tie)
    value = (F.col("raster_id") + 1).cast("double")
    corner = [F.get(F.col("box"), F.lit(i)).alias(n) for i, n in enumerate(("west", "south", "east", "north"))]
    return (
        t("geo_tags").withColumn("epsg", code).withColumn("box", box)
        .select(
            "raster_id", "epsg", *corner, F.get(geo.pixel_scale(scale), F.lit(0)).alias("scale_x"),
            geo.is_georeferenced(scale, tie, keys).alias("georeferenced"),
            geo.is_global(F.col("epsg"), F.col("box")).alias("is_global"),
            geo.infer_projection(F.col("projection"), F.col("epsg"), F.col("box")).alias("projection"),
            geo.units_per_pixel(F.lit("pixels_per_unit"), value, 256, 3, 5).alias("per_unit"),
            geo.units_per_pixel(F.lit("units_per_tile"), value, 256, 3, 5).alias("per_tile"),
        )
    )


# --- samples to pixels --------------------------------------------------------------------------

STRETCH_SQL = """
rng AS (SELECT raster_id, channel, MIN(v) AS low, MAX(v) AS high FROM raster_samples WHERE isfinite(v) GROUP BY 1, 2),
lvl AS (SELECT s.raster_id, s.width, s.height, s.x, s.y,
               CASE WHEN s.v IS NULL OR NOT isfinite(s.v) THEN 0
                    WHEN high > low THEN CAST(greatest(0, least(255, round((s.v - low) / (high - low) * 255.0))) AS INT)
                    WHEN high > 0 THEN 255 ELSE 0 END AS level
        FROM raster_samples s LEFT JOIN rng USING (raster_id, channel))"""


@REG.query("raster_samples", sql=STRETCH_SQL + "SELECT raster_id, x, y, level FROM lvl")
def sample_stretch(t: Tables):
    return raster.stretch(t("raster_samples"), ["raster_id", "channel"]).select("raster_id", "x", "y", "level")


@REG.query(
    "multiband",
    sql="""
flat AS (SELECT raster_id, channels, width, height, p - 1 AS pos, CAST(samples[p] AS DOUBLE) AS v
         FROM (SELECT *, unnest(range(1, len(samples) + 1)) AS p FROM multiband WHERE len(samples) >= width * height * channels)
         WHERE p - 1 < width * height * channels),
s AS (SELECT raster_id, channels, pos % channels AS channel, (pos // channels) % width AS x, (pos // channels) // width AS y, v FROM flat),
l AS (SELECT s.*, CAST(round((v - MIN(v) OVER w) / (MAX(v) OVER w - MIN(v) OVER w) * 255.0) AS INT) AS level FROM s WINDOW w AS (PARTITION BY raster_id, channel)),
p AS (SELECT raster_id, channels, x, y, MAX(level) FILTER (channel = 0) AS c0, MAX(level) FILTER (channel = 1) AS c1,
             MAX(level) FILTER (channel = 2) AS c2, MAX(level) FILTER (channel = 3) AS c3 FROM l GROUP BY 1, 2, 3, 4)
SELECT raster_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, c0 AS r, CASE WHEN channels <= 2 THEN c0 ELSE c1 END AS g,
       CASE WHEN channels <= 2 THEN c0 ELSE c2 END AS b, CASE channels WHEN 2 THEN c1 WHEN 4 THEN c3 ELSE 255 END AS a FROM p""",
)
def band_normalise(t: Tables):
    samples, _ = raster.explode_samples(t("multiband"))
    px = raster.band_pixels(raster.stretch(samples, ["raster_id", "channel"]))
    return px.select("raster_id", "x", "y", *CHANNELS)


@REG.query(
    "multiband",
    sql="SELECT raster_id, width * height * channels AS needed, len(samples) AS given FROM multiband WHERE len(samples) < width * height * channels",
)
def incomplete_rasters(t: Tables):
    _, rejected = raster.explode_samples(t("multiband"))
    return rejected.select(
        "raster_id", (F.col("width") * F.col("height") * F.col("channels")).alias("needed"), F.size("samples").alias("given")
    )


def grey_tiles(t: Tables):
    levels = raster.stretch(t("raster_samples"), ["raster_id", "channel"])
    px = raster.grey_pixels(levels).withColumn("z", F.lit(1))
    return raster.crop_tiles(px, GREY_TS)


GREY_TILES_SQL = STRETCH_SQL + """,
top AS (SELECT raster_id, 1 AS z, x // 4 AS tx, y // 4 AS ty, x % 4 AS ox, y % 4 AS oy, level AS r, level AS g, level AS b, 255 AS a FROM lvl)"""


def merge_sql(source: str, name: str, ts: int) -> str:
    """One pyramid level from ``source`` by a tap table."""
    taps = f"""(SELECT i, o, CAST(4 - 2 * abs(i - (2 * o + 0.5)) AS INT) AS w FROM range({2 * ts}) a(i), range({ts}) b(o)
                WHERE abs(i - (2 * o + 0.5)) < 2)"""
    chans = ", ".join(f"CAST((2 * SUM({c} * w) + ANY_VALUE(d)) // (2 * ANY_VALUE(d)) AS INT) AS {c}" for c in CHANNELS)
    return f"""
{name}_tap AS (SELECT i, o, w, SUM(w) OVER (PARTITION BY o) AS d FROM {taps}),
{name} AS (SELECT raster_id, z - 1 AS z, tx // 2 AS tx, ty // 2 AS ty, xo AS ox, yo AS oy, {chans} FROM (
  SELECT s.raster_id, s.z, s.tx, s.ty, tx.o AS xo, ty.o AS yo, tx.w * ty.w AS w, CAST(tx.d * ty.d AS BIGINT) AS d, s.r, s.g, s.b, s.a
  FROM {source} s JOIN {name}_tap tx ON tx.i = (s.tx % 2) * {ts} + s.ox JOIN {name}_tap ty ON ty.i = (s.ty % 2) * {ts} + s.oy) q
  GROUP BY 1, 2, 3, 4, 5, 6)"""


TILE_COLS = "raster_id, CAST(z AS INT) AS z, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, CAST(ox AS INT) AS ox, CAST(oy AS INT) AS oy, r, g, b, a"


@REG.query("raster_samples", sql=GREY_TILES_SQL + f"SELECT {TILE_COLS} FROM top")
def tile_crop(t: Tables):
    return grey_tiles(t)


@REG.query(
    "raster_samples",
    sql=GREY_TILES_SQL + "," + merge_sql("top", "up", 4) + f"SELECT {TILE_COLS} FROM up UNION ALL SELECT {TILE_COLS} FROM top",
)
def grey_pyramid(t: Tables):
    return pyramid.build(grey_tiles(t), GREY_TS, 1)


@REG.query(
    "raster_samples",
    sql=GREY_TILES_SQL + "," + merge_sql("top", "up", 4) + """
SELECT raster_id, CAST(z AS INT) AS z, COUNT(DISTINCT tx * 2 + ty) AS tiles, COUNT(*) AS pixels, CAST(SUM(r) AS BIGINT) AS brightness
FROM (SELECT raster_id, z, tx, ty, r FROM up UNION ALL SELECT raster_id, z, tx, ty, r FROM top) GROUP BY 1, 2""",
)
def pyramid_report(t: Tables):
    per_tile = pyramid.build(grey_tiles(t), GREY_TS, 1).groupBy("raster_id", "z", "tx", "ty").agg(
        F.count("*").alias("pixels"), F.sum("r").alias("brightness")
    )
    return per_tile.groupBy("raster_id", "z").agg(
        F.count("*").alias("tiles"), F.sum("pixels").alias("pixels"), F.sum("brightness").alias("brightness")
    )


# --- resampling and canvases --------------------------------------------------------------------

LEVELS_SQL = """
lv AS (SELECT p.*, z, CAST(10 * (1 << z) AS INT) AS canvas, CAST(greatest(1, width * 10 * (1 << z) // greatest(width, height)) AS INT) AS fit_w,
              CAST(greatest(1, height * 10 * (1 << z) // greatest(width, height)) AS INT) AS fit_h
       FROM heat_pixels p CROSS JOIN (SELECT CAST(z AS INT) AS z FROM range(3) t(z)) zs)"""


def taps_sql(name: str, pairs: str) -> str:
    """Weight table (n, n2, i, o, w, d) of the cubic filter for the size pairs given by a SELECT."""
    return f"""
{name} AS (SELECT *, SUM(w) OVER (PARTITION BY n, n2, o) AS d FROM (
  SELECT n, n2, i, o, t, CAST(floor(0.5e0 + CASE WHEN t < 1 THEN 1.5 * t * t * t - 2.5 * t * t + 1.0
                                      WHEN t < 2 THEN -0.5 * t * t * t + 2.5 * t * t - 4.0 * t + 2.0 ELSE 0.0 END / s * 1048576.0) AS BIGINT) AS w
  FROM (SELECT n, n2, i, o, s, abs((i + 0.5) - (o + 0.5) * ratio) / s AS t
        FROM (SELECT n, n2, i, o, CAST(n AS DOUBLE) / n2 AS ratio, greatest(1.0, CAST(n AS DOUBLE) / n2) AS s
              FROM ({pairs}) p, range(4096) a(i), range(4096) b(o) WHERE i < n AND o < n2) q1) q2) q3 WHERE t < 2 AND t <> 1)"""


def clamp_sql(total: str, divisor: str) -> str:
    return f"CAST(least(255, greatest(0, (2 * {total} + {divisor}) // (2 * {divisor}))) AS INT)"


def resample_sql(source: str, name: str, keys: str, w: str, h: str, w2: str, h2: str) -> str:
    vs = ", ".join(f"CAST(SUM(t.w * s.{c}) AS BIGINT) AS {c}" for c in CHANNELS)
    hs = ", ".join(f"SUM(CAST(t.w AS HUGEINT) * v.{c}) AS {c}" for c in CHANNELS)
    out = ", ".join(f"{clamp_sql(c, 'd')} AS {c}" for c in CHANNELS)
    return f"""{taps_sql(name + "_ty", f"SELECT DISTINCT {h} AS n, {h2} AS n2 FROM {source}")},
{taps_sql(name + "_tx", f"SELECT DISTINCT {w} AS n, {w2} AS n2 FROM {source}")},
{name}_v AS (SELECT {keys}, {w}, {w2}, x, t.o AS y, CAST(ANY_VALUE(t.d) AS BIGINT) AS dy, {vs}
  FROM {source} s JOIN {name}_ty t ON t.n = {h} AND t.n2 = {h2} AND t.i = s.y GROUP BY ALL),
{name}_h AS (SELECT {keys}, t.o AS x, y, dy, ANY_VALUE(t.d) AS dx, {hs}
  FROM {name}_v v JOIN {name}_tx t ON t.n = {w} AND t.n2 = {w2} AND t.i = v.x GROUP BY ALL),
{name} AS (SELECT {keys}, CAST(x AS INT) AS x, CAST(y AS INT) AS y, {out} FROM (SELECT *, CAST(dx AS HUGEINT) * dy AS d FROM {name}_h) q)"""


FITTED_SQL = LEVELS_SQL + "," + resample_sql("lv", "fitted", "raster_id, z, canvas, fit_h", "width", "height", "fit_w", "fit_h")
CANVAS_COLS = "raster_id, CAST(z AS INT) AS z, canvas, CAST(x AS INT) AS x, CAST(y AS INT) AS y, r, g, b, a"


def heat_levels(t: Tables, by: str = "x"):
    return raster.at_zooms(t("heat_pixels"), HEAT_TS, 0, HEAT_ZOOM, by)


@REG.query("heat_pixels", sql=FITTED_SQL + "SELECT raster_id, z, x, y, r, g, b, a FROM fitted")
def resample_levels(t: Tables):
    px = raster.resample(heat_levels(t), raster.LEVEL, "width", "height", "fit_w", "fit_h")
    return px.select("raster_id", "z", "x", "y", *CHANNELS)


@REG.query(
    "heat_pixels",
    sql="p2 AS (SELECT *, 16 AS w2, 12 AS h2 FROM heat_pixels)," + resample_sql("p2", "small", "raster_id", "width", "height", "w2", "h2")
    + "SELECT raster_id, 16 AS width, 12 AS height, x, y, r, g, b, a FROM small",
)
def prescaled_image(t: Tables):
    return raster.prescale(t("heat_pixels"), 0.5)


CLEAR_SQL = ", ".join(f"CASE WHEN a > 0 THEN {c} ELSE 0 END AS {c}" for c in "rgb") + ", a"


@REG.query("heat_pixels", sql=FITTED_SQL + f"SELECT raster_id, z, canvas, x, y, {CLEAR_SQL} FROM fitted")
def flat_canvas(t: Tables):
    return raster.canvas(heat_levels(t), "flat")


def blend_sql(bg: Background, always: bool) -> str:
    cols = []
    for c in CHANNELS:
        under = getattr(bg, c)
        mixed = "255" if c == "a" else f"CAST(round({c} * (CAST(a AS DOUBLE) / 255.0) + {under} * (1.0 - CAST(a AS DOUBLE) / 255.0)) AS INT)"
        clear = "" if always else f"WHEN a = 0 THEN {under} "
        cols.append(f"CASE WHEN a = 255 THEN {c} {clear}ELSE {mixed} END AS {c}")
    return ", ".join(cols)


def fill_sql(source: str, bg: Background) -> str:
    chans = ", ".join(f"COALESCE(s.{c}, {getattr(bg, c)}) AS {c}" for c in CHANNELS)
    return f"""
SELECT q.raster_id, q.z, q.canvas, CAST(gx.x AS INT) AS x, CAST(gy.y AS INT) AS y, {chans}
FROM (SELECT DISTINCT raster_id, z, canvas FROM lv) q JOIN range(40) gx(x) ON gx.x < q.canvas JOIN range(40) gy(y) ON gy.y < q.canvas
LEFT JOIN {source} s ON s.raster_id = q.raster_id AND s.z = q.z AND s.x = gx.x AND s.y = gy.y"""


@REG.query("heat_pixels", sql=FITTED_SQL + f", over AS (SELECT raster_id, z, x, y, {blend_sql(SAND, False)} FROM fitted)" + fill_sql("over", SAND))
def flat_canvas_on_background(t: Tables):
    return raster.filled_canvas(heat_levels(t), "flat", SAND)


@REG.query("heat_pixels", sql=f"SELECT raster_id, x, y, {blend_sql(GLASS, False)} FROM heat_pixels")
def background_composite(t: Tables):
    out = color.over_background({c: F.col(c) for c in CHANNELS}, GLASS)
    return t("heat_pixels").select("raster_id", "x", "y", *[out[c].alias(c) for c in CHANNELS])


MERC_ROWS_SQL = f"""
mrow AS (SELECT raster_id, z, canvas, cy, f, CAST(least(floor(f), height - 1) AS INT) AS y0, CAST(least(least(floor(f), height - 1) + 1, height - 1) AS INT) AS y1
  FROM (SELECT raster_id, z, canvas, height, cy, {MERC.format(t="CAST(cy AS DOUBLE) / canvas")} * (height - 1.0) AS f
        FROM (SELECT DISTINCT raster_id, z, canvas, height FROM lv) d JOIN range(40) g(cy) ON cy < canvas) q)"""


def mercator_sql(tail: str) -> str:
    vs = ", ".join(f"SUM(t.w * s.{c}) AS {c}" for c in CHANNELS)
    out = ", ".join(f"{clamp_sql(c, 'd')} AS {c}" for c in CHANNELS)
    mix = ", ".join(
        f"CAST(round(COALESCE(p0.{c}, 0) * (1.0 - (f - y0)) + COALESCE(p1.{c}, 0) * (f - y0)) AS INT) AS {c}" for c in CHANNELS
    )
    return LEVELS_SQL + "," + taps_sql("mtx", "SELECT DISTINCT width AS n, fit_w AS n2 FROM lv") + f""",
across_sum AS (SELECT raster_id, z, canvas, t.o AS x, y, ANY_VALUE(t.d) AS d, {vs} FROM lv s JOIN mtx t ON t.n = width AND t.n2 = fit_w AND t.i = s.x GROUP BY 1, 2, 3, 4, 5),
across AS (SELECT raster_id, z, canvas, x, y, {out} FROM across_sum), {MERC_ROWS_SQL},
mixed AS (SELECT m.raster_id, m.z, m.canvas, k.x, m.cy AS y, {mix}
  FROM mrow m JOIN (SELECT DISTINCT raster_id, z, x FROM across) k ON k.raster_id = m.raster_id AND k.z = m.z
  LEFT JOIN across p0 ON p0.raster_id = m.raster_id AND p0.z = m.z AND p0.x = k.x AND p0.y = m.y0
  LEFT JOIN across p1 ON p1.raster_id = m.raster_id AND p1.z = m.z AND p1.x = k.x AND p1.y = m.y1
  WHERE p0.x IS NOT NULL OR p1.x IS NOT NULL)
""" + tail


@REG.query("heat_pixels", sql=mercator_sql(f"SELECT {CANVAS_COLS} FROM mixed"))
def mercator_canvas(t: Tables):
    return raster.canvas(heat_levels(t, "y"), "mercator")


@REG.query(
    "heat_pixels",
    sql=mercator_sql(f", over AS (SELECT raster_id, z, x, y, {blend_sql(GLASS, True)} FROM mixed)" + fill_sql("over", GLASS)),
)
def mercator_canvas_on_background(t: Tables):
    return raster.filled_canvas(heat_levels(t, "y"), "mercator", GLASS)


ISO = "0.7071067811865476e0"


def iso_sql(tail: str) -> str:
    mix = ", ".join(
        f"""CAST(round((COALESCE(p0.{c}, 0) * (1.0 - fx) + COALESCE(p1.{c}, 0) * fx) * (1.0 - fy)
            + (COALESCE(p2.{c}, 0) * (1.0 - fx) + COALESCE(p3.{c}, 0) * fx) * fy) AS INT) AS {c}"""
        for c in CHANNELS
    )
    joins = "\n".join(
        f"LEFT JOIN fitted p{i} ON p{i}.raster_id = m.raster_id AND p{i}.z = m.z AND p{i}.x = m.x0 + {i % 2} AND p{i}.y = m.y0 + {i // 2}"
        for i in range(4)
    )
    return FITTED_SQL + f""",
place AS (SELECT raster_id, z, canvas, x, y, dx * {ISO} + dy * {ISO} + fit_w / 2.0e0 AS sx, -dx * {ISO} + dy * {ISO} + fit_h / 2.0e0 AS sy, fit_w, fit_h
  FROM (SELECT *, (x - canvas / 2.0e0) / s AS dx, (y - canvas / 2.0e0) / s / 0.5e0 AS dy
        FROM (SELECT d.*, gx.x, gy.y, least(1.0e0, canvas / ((CAST(fit_w AS DOUBLE) + fit_h) * {ISO})) AS s
              FROM (SELECT DISTINCT raster_id, z, canvas, fit_w, fit_h FROM lv) d JOIN range(40) gx(x) ON gx.x < canvas JOIN range(40) gy(y) ON gy.y < canvas) q1) q2),
m AS (SELECT *, CAST(floor(sx) AS INT) AS x0, CAST(floor(sy) AS INT) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM place
      WHERE sx >= 0 AND sx < fit_w - 1 AND sy >= 0 AND sy < fit_h - 1),
mixed AS (SELECT m.raster_id, m.z, m.canvas, m.x, m.y, {mix} FROM m {joins}
          WHERE p0.x IS NOT NULL OR p1.x IS NOT NULL OR p2.x IS NOT NULL OR p3.x IS NOT NULL)
""" + tail


@REG.query("heat_pixels", sql=iso_sql(f"SELECT {CANVAS_COLS} FROM mixed WHERE a > 0"))
def isometric_canvas(t: Tables):
    return raster.canvas(heat_levels(t), "isometric")


@REG.query(
    "heat_pixels",
    sql=iso_sql(f", over AS (SELECT raster_id, z, x, y, {blend_sql(SAND, True)} FROM mixed)" + fill_sql("over", SAND)),
)
def isometric_canvas_on_background(t: Tables):
    return raster.filled_canvas(heat_levels(t), "isometric", SAND)


# --- window method, pyramids ------------------------------------------------------------------------


def window_sql(name: str, projection: str, source: str = "heat_pixels", width: int = 32, height: int = 24, mark: str = "") -> str:
    """Axis windows at the highest zoom (4x4 tiles of 10 pixels); ``mark`` keeps the names of two such chains apart."""
    span = f"{width / 4}"
    flat = f"SELECT {{a}} AS n, tile * 10.0e0 * {width} / 40 AS lo, (tile + 1) * 10.0e0 * {width} / 40 AS hi, tile FROM range(4) g(tile)"
    merc = f"SELECT {height} AS n, ({MERC.format(t='tile / 4.0e0')}) * {height}.0 AS lo, ({MERC.format(t='(tile + 1) / 4.0e0')}) * {height}.0 AS hi, tile FROM range(4) g(tile)"
    y = merc if projection == "mercator" else flat.format(a=height)
    out = f"CAST(greatest(1, round(least(n - lo, {span}) / {span} * 10)) AS INT)"
    out_y = "10" if projection == "mercator" else out
    wy, wx, wty, wtx, wv, wh = (f"{n}{mark}" for n in ("wy", "wx", "wty", "wtx", "wv", "wh"))

    def win(src: str, out: str) -> str:
        return f"""SELECT tile, CAST(least(floor(lo), n - 1) AS INT) AS low, CAST(greatest(1, least(ceil(hi) + 1, n) - least(floor(lo), n - 1)) AS INT) AS cnt,
                   {out} AS out_n FROM ({src}) q WHERE lo < n"""

    vs = ", ".join(f"SUM(t.w * s.{c}) AS {c}" for c in CHANNELS)
    hs = ", ".join(f"SUM(t.w * CAST(v.{c} AS HUGEINT)) AS {c}" for c in CHANNELS)
    levels = ", ".join(f"{clamp_sql(c, 'd')} AS {c}" for c in CHANNELS)
    return f"""
{wy} AS ({win(y, out_y)}), {wx} AS ({win(flat.format(a=width), out)}),
{taps_sql(wty, f"SELECT DISTINCT cnt AS n, out_n AS n2 FROM {wy}")}, {taps_sql(wtx, f"SELECT DISTINCT cnt AS n, out_n AS n2 FROM {wx}")},
{wv} AS (SELECT s.raster_id, s.x, g.tile AS ty, t.o AS oy, ANY_VALUE(t.d) AS dy, {vs} FROM {source} s JOIN {wy} g ON s.y >= low AND s.y < low + cnt
       JOIN {wty} t ON t.n = cnt AND t.n2 = out_n AND t.i = s.y - low GROUP BY 1, 2, 3, 4),
{wh} AS (SELECT v.raster_id, g.tile AS tx, ty, t.o AS ox, oy, CAST(ANY_VALUE(t.d) AS HUGEINT) * dy AS d, {hs} FROM {wv} v JOIN {wx} g ON v.x >= low AND v.x < low + cnt
       JOIN {wtx} t ON t.n = cnt AND t.n2 = out_n AND t.i = v.x - low GROUP BY v.raster_id, g.tile, ty, t.o, oy, dy),
{name} AS (SELECT raster_id, 2 AS z, tx, ty, ox, oy, {levels} FROM {wh})"""


@REG.query("heat_pixels", sql=window_sql("win", "flat") + f"SELECT {TILE_COLS} FROM win")
def window_tiles_flat(t: Tables):
    return raster.extract_windows(t("heat_pixels"), HEAT_TS, HEAT_ZOOM, "flat")


@REG.query("heat_pixels", sql=window_sql("win", "mercator") + f"SELECT {TILE_COLS} FROM win")
def window_tiles_mercator(t: Tables):
    return raster.extract_windows(t("heat_pixels"), HEAT_TS, HEAT_ZOOM, "mercator")


STRIP_SQL = window_sql("win", "flat") + "," + merge_sql("win", "up1", 10) + "," + merge_sql("up1", "up0", 10)
STRIP_ALL = f"SELECT {TILE_COLS} FROM win UNION ALL SELECT {TILE_COLS} FROM up1 UNION ALL SELECT {TILE_COLS} FROM up0"


@REG.query("heat_pixels", sql=STRIP_SQL + STRIP_ALL)
def strip_pyramid(t: Tables):
    return pyramid.strip_pyramid(t("heat_pixels"), HEAT_TS, HEAT_ZOOM)


NAIVE_SQL = f"""naive AS (SELECT raster_id, z, x // 10 AS tx, y // 10 AS ty, x % 10 AS ox, y % 10 AS oy, {CLEAR_SQL} FROM fitted)"""


@REG.query("heat_pixels", sql=FITTED_SQL + "," + NAIVE_SQL + f"SELECT {TILE_COLS} FROM naive")
def naive_pyramid(t: Tables):
    return pyramid.naive_pyramid(t("heat_pixels"), HEAT_TS, 0, HEAT_ZOOM)


def _gap_sql() -> str:
    gaps = ", ".join(f"abs(COALESCE(l.{c}, 0) - COALESCE(r.{c}, 0))" for c in CHANNELS)
    return f"""
SELECT raster_id, CAST(z AS INT) AS z, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, MAX(il) AS in_left, MAX(ir) AS in_right, COUNT(*) FILTER (gap > 0) AS pixels_differ,
       MAX(gap) AS largest_gap, COUNT(*) FILTER (gap > 0) = 0 AS identical
FROM (SELECT COALESCE(l.raster_id, r.raster_id) AS raster_id, COALESCE(l.z, r.z) AS z, COALESCE(l.tx, r.tx) AS tx, COALESCE(l.ty, r.ty) AS ty,
             CASE WHEN l.raster_id IS NULL THEN 0 ELSE 1 END AS il, CASE WHEN r.raster_id IS NULL THEN 0 ELSE 1 END AS ir, greatest({gaps}) AS gap
      FROM strip l FULL JOIN naive r ON l.raster_id = r.raster_id AND l.z = r.z AND l.tx = r.tx AND l.ty = r.ty AND l.ox = r.ox AND l.oy = r.oy) q
GROUP BY 1, 2, 3, 4"""


@REG.query("heat_pixels", sql=STRIP_SQL + f", strip AS ({STRIP_ALL})," + FITTED_SQL + "," + NAIVE_SQL + _gap_sql())
def compare_pyramids(t: Tables):
    px = t("heat_pixels")
    return pyramid.compare(
        pyramid.strip_pyramid(px, HEAT_TS, HEAT_ZOOM, held=True), pyramid.naive_pyramid(px, HEAT_TS, 0, HEAT_ZOOM, held=True)
    )


@REG.query(
    "heat_pixels",
    sql=window_sql("win", "flat") + """
SELECT s.raster_id, CAST(z.z AS INT) AS z, CAST(gx.x AS INT) AS tx, CAST(gy.y AS INT) AS ty, '00000000' AS rgba FROM (SELECT DISTINCT raster_id FROM heat_pixels) s
JOIN range(2, 3) z(z) ON TRUE JOIN range(4) gx(x) ON TRUE JOIN range(4) gy(y) ON TRUE
WHERE NOT EXISTS (SELECT 1 FROM win w WHERE w.raster_id = s.raster_id AND w.tx = gx.x AND w.ty = gy.y)""",
)
def blank_tiles(t: Tables):
    px = t("heat_pixels")
    tiles = raster.extract_windows(px, HEAT_TS, HEAT_ZOOM, "flat")
    return raster.blank_tiles(tiles, raster.image_sizes(px), HEAT_ZOOM, HEAT_ZOOM)


def _rows_sql(projection: str) -> str:
    span = (
        f"({MERC.format(t='ty / 4.0e0')}) * height AS lo, ({MERC.format(t='(ty + 1) / 4.0e0')}) * height AS hi"
        if projection == "mercator"
        else "ty * 10.0e0 * greatest(width, height) / 40.0 AS lo, (ty + 1) * 10.0e0 * greatest(width, height) / 40.0 AS hi"
    )
    return f"""SELECT raster_id, 2 AS z, CAST(ty AS INT) AS ty, CAST(least(greatest(0, floor(lo) - 1), height - 1) AS INT) AS row_low,
       CAST(least(ceil(hi) + 1, height) AS INT) AS row_high FROM (SELECT raster_id, height, ty, {span} FROM image_dims, range(4) g(ty)) q WHERE lo < height"""


def _stored_strip(t: Tables, projection: str, ty: int):
    folder = new_folder(t.spark, "pixels")
    pixels.write_pixels(t("heat_pixels"), folder)
    return pixels.strip_tiles(t.spark, folder, HEAT_TS, HEAT_ZOOM, projection, ty)


@REG.query("heat_pixels", sql=window_sql("win", "flat") + f"SELECT {TILE_COLS} FROM win WHERE ty = 1")
def stored_strip_flat(t: Tables):
    """The second row of tiles from the lines it needs, read from pixels stored by line."""
    return _stored_strip(t, "flat", 1)


@REG.query("heat_pixels", sql=window_sql("win", "mercator") + f"SELECT {TILE_COLS} FROM win WHERE ty = 0")
def stored_strip_mercator(t: Tables):
    return _stored_strip(t, "mercator", 0)


@REG.query("image_dims", sql=_rows_sql("flat"))
def source_rows_flat(t: Tables):
    return raster.source_rows(t("image_dims").withColumn("z", F.lit(2)), HEAT_TS, "flat")


@REG.query("image_dims", sql=_rows_sql("mercator"))
def source_rows_mercator(t: Tables):
    return raster.source_rows(t("image_dims").withColumn("z", F.lit(2)), HEAT_TS, "mercator")


@REG.query(
    "heat_pixels",
    sql="""
cell AS (SELECT u, COUNT(*) AS n FROM (SELECT i * 12 // 32 AS u FROM range(32) a(i)) q GROUP BY 1),
rowc AS (SELECT u, COUNT(*) AS n FROM (SELECT i * 9 // 24 AS u FROM range(24) a(i)) q GROUP BY 1),
s AS (SELECT raster_id, x * 12 // 32 AS ux, y * 9 // 24 AS uy, SUM(r) AS r, SUM(g) AS g, SUM(b) AS b, SUM(a) AS a FROM heat_pixels GROUP BY 1, 2, 3)
SELECT raster_id, 12 AS tw, 9 AS th, CAST(ux AS INT) AS x, CAST(uy AS INT) AS y, """
    + ", ".join(f"CAST((2 * {c} + cell.n * rowc.n) // (2 * cell.n * rowc.n) AS INT) AS {c}" for c in CHANNELS)
    + " FROM s JOIN cell ON cell.u = ux JOIN rowc ON rowc.u = uy",
)
def thumbnail(t: Tables):
    return raster.thumbnail(t("heat_pixels"), 12)


@REG.query(
    "heat_pixels",
    sql="SELECT raster_id, x, y, " + ", ".join(f"CAST(({c} * a + 255 * (255 - a)) // 255 AS INT) AS {c}" for c in "rgb") + " FROM heat_pixels",
)
def flatten_on_white(t: Tables):
    a = F.col("a")
    return t("heat_pixels").select("raster_id", "x", "y", *[color.flatten_white(F.col(c), a).alias(c) for c in "rgb"])


# --- small functions and validation over rasters -------------------------------------------------


@REG.query(
    sql="""
SELECT p_partkey AS raster_id, CASE WHEN regexp_full_match(h, '[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8}') THEN CAST('0x' || substr(h, 1, 2) AS INT) END AS r,
       CASE WHEN regexp_full_match(h, '[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8}') THEN CAST('0x' || substr(h, 3, 2) AS INT) END AS g,
       CASE WHEN regexp_full_match(h, '[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8}') THEN CAST('0x' || substr(h, 5, 2) AS INT) END AS b,
       CASE WHEN NOT regexp_full_match(h, '[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8}') THEN NULL WHEN length(h) = 8 THEN CAST('0x' || substr(h, 7, 2) AS INT) ELSE 255 END AS a
FROM (SELECT p_partkey, lpad(hex(p_partkey * 2654435 + p_size), CASE p_partkey % 3 WHEN 0 THEN 6 WHEN 1 THEN 8 ELSE 7 END, '0') AS h FROM part) q""",
)
def hex_colours(t: Tables):
    digits = F.when(F.col("p_partkey") % 3 == 0, 6).when(F.col("p_partkey") % 3 == 1, 8).otherwise(7)
    value = F.hex(F.col("p_partkey") * 2654435 + F.col("p_size"))
    padded = F.concat(F.lit("##"), F.call_function("lpad", value, digits, F.lit("0")))
    px = t("part").select(F.col("p_partkey").alias("raster_id"), color.parse_hex(padded).alias("px"))
    return px.select("raster_id", *[F.col(f"px.{c}").alias(c) for c in CHANNELS])


def violations_sql(checks: list[tuple[str, str]], source: str, key: str) -> str:
    parts = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in checks)
    return f"SELECT {key}, concat_ws(',', {parts}) AS violations FROM {source}"


@REG.query(
    "image_dims",
    sql=violations_sql(
        [
            ("tile_size", "COALESCE(tile_size, 256) NOT IN (128, 256, 512)"),
            ("max_zoom", "max_zoom > 12"),
            ("projection", "COALESCE(projection, 'flat') NOT IN ('flat', 'mercator', 'isometric')"),
            ("format", "COALESCE(tile_format, 'png') NOT IN ('png', 'jpeg', 'jpg', 'webp')"),
            ("quality", "COALESCE(quality, 85) NOT BETWEEN 1 AND 100"),
        ],
        "image_dims",
        "raster_id",
    ),
)
def tile_request_violations(t: Tables):
    checked = validate.report(t("image_dims"), validate.TILE_REQUEST)
    return checked.select("raster_id", F.array_join("violations", ",").alias("violations"))


@REG.query(
    "image_dims",
    sql="""
SELECT raster_id, concat(CAST(width % 9 AS VARCHAR), '/', CAST(height % 300 AS VARCHAR), '/', CAST(width % 300 AS VARCHAR), '.',
       CASE tile_format WHEN 'jpeg' THEN 'jpg' WHEN 'webp' THEN 'webp' ELSE 'png' END) AS path,
       concat('uploads/', CAST(raster_id AS VARCHAR), '.bin') AS upload_key, concat('tiles/', CAST(raster_id AS VARCHAR)) AS prefix FROM image_dims""",
)
def object_keys(t: Tables):
    path = text.tile_path(F.col("width") % 9, F.col("height") % 300, F.col("width") % 300, F.col("tile_format"))
    rid = F.col("raster_id")
    return t("image_dims").select(
        "raster_id", path.alias("path"), text.upload_key(rid).alias("upload_key"), text.tile_prefix(rid).alias("prefix")
    )


def ground_sql(low: str, top: str, bg: Background) -> str:
    """Every tile of levels ``low`` to ``top`` of each raster, without offsets, in the background's colour."""
    colour = ", ".join(f"{getattr(bg, c)} AS {c}" for c in CHANNELS)
    return f"""
SELECT s.raster_id, CAST(z.z AS INT) AS z, CAST(gx.x AS INT) AS tx, CAST(gy.y AS INT) AS ty, NULL AS ox, NULL AS oy, {colour}
FROM (SELECT DISTINCT raster_id FROM heat_pixels) s JOIN range({low}, {top} + 1) z(z) ON TRUE
JOIN range(16) gx(x) ON gx.x < (1 << z.z) JOIN range(16) gy(y) ON gy.y < (1 << z.z)"""


CUT_SQL = FITTED_SQL.replace("FROM heat_pixels p CROSS JOIN", "FROM small_px p CROSS JOIN")


@REG.query(
    "heat_pixels",
    sql="p2 AS (SELECT *, 16 AS w2, 12 AS h2 FROM heat_pixels)," + resample_sql("p2", "small", "raster_id", "width", "height", "w2", "h2")
    + ", small_px AS (SELECT raster_id, 16 AS width, 12 AS height, x, y, r, g, b, a FROM small),"
    + CUT_SQL.replace("range(3) t(z)", "range(2) t(z)")
    + f", over AS (SELECT raster_id, z, x // 10 AS tx, y // 10 AS ty, x % 10 AS ox, y % 10 AS oy, {blend_sql(SAND, False)} FROM fitted) SELECT {TILE_COLS} FROM over UNION ALL " + ground_sql("0", "1", SAND),
)
def cut_images_scaled(t: Tables):
    """The whole run from one set of options: half size, automatic zooms, opaque background."""
    return tiling.cut_images(t("heat_pixels"), tiling.TileConfig(tile_size=HEAT_TS, scale=0.5, background=SAND))


@REG.query("heat_pixels", sql=STRIP_SQL + f", al AS ({STRIP_ALL}) SELECT raster_id, z, tx, ty, ox, oy, {blend_sql(GLASS, False)} FROM al WHERE z >= 1 UNION ALL " + ground_sql("1", "2", GLASS))
def cut_images_by_window(t: Tables):
    config = tiling.TileConfig(tile_size=HEAT_TS, min_zoom=1, background=GLASS, method="window")
    return tiling.cut_images(t("heat_pixels"), config)


# One pixel here and there of images 16,384 pixels wide, whose own highest zoom at tiles of 2 pixels is 13.
DEEP_SQL = """deep AS (SELECT c_custkey % 7 AS raster_id, 16384 AS width, 9 AS height, CAST((c_custkey * 131) % 16384 AS INT) AS x, CAST(c_custkey % 9 AS INT) AS y,
  CAST(c_custkey % 200 AS INT) AS r, 10 AS g, 20 AS b, 255 AS a, row_number() OVER (PARTITION BY c_custkey % 7, (c_custkey * 131) % 16384, c_custkey % 9 ORDER BY c_custkey) AS nth
  FROM customer)"""
DEEP_TILES = "SELECT raster_id, 13 AS z, x // 2 AS tx, y // 2 AS ty, x % 2 AS ox, y % 2 AS oy, r, g, b, a FROM deep WHERE nth = 1"


def deep_pixels(t: Tables):
    key = F.col("c_custkey")
    px = t("customer").select(
        (key % 7).alias("raster_id"), F.lit(16384).alias("width"), F.lit(9).alias("height"), ((key * 131) % 16384).cast("int").alias("x"),
        (key % 9).cast("int").alias("y"), F.struct(key, (key % 200).cast("int").alias("r")).alias("first"),
    )
    return px.groupBy("raster_id", "width", "height", "x", "y").agg(F.min("first")["r"].alias("r")).select(
        "*", F.lit(10).alias("g"), F.lit(20).alias("b"), F.lit(255).alias("a")
    )


@REG.query(sql=f"WITH {DEEP_SQL} {DEEP_TILES}")
def deep_zoom_naive(t: Tables):
    """The highest of 14 zooms, rendered from the source."""
    return tiling.cut_pixels(deep_pixels(t), tiling.TileConfig(tile_size=2, min_zoom=13))


@REG.query(sql=f"WITH {DEEP_SQL} SELECT raster_id, 13 AS z, COUNT(DISTINCT (x // 2, y // 2)) AS tiles FROM deep GROUP BY 1")
def deep_zoom_by_window(t: Tables):
    """The same by the window method: tiles at the highest zoom that show a pixel in the place of one of the source."""
    px = deep_pixels(t)
    tiles = raster.visible(tiling.cut_pixels(px, tiling.TileConfig(tile_size=2, min_zoom=12, method="window"))).filter("z = 13")
    own = px.select("raster_id", F.floor(F.col("x") / 2).cast("int").alias("tx"), F.floor(F.col("y") / 2).cast("int").alias("ty"))
    return tiles.join(own.distinct(), ["raster_id", "tx", "ty"], "left_semi").groupBy("raster_id", "z").agg(
        F.countDistinct("tx", "ty").alias("tiles")
    )


@REG.query("heat_pixels", sql="SELECT raster_id, CAST(z.z AS INT) AS z, CAST(1 << (2 * z.z) AS BIGINT) AS tiles FROM (SELECT DISTINCT raster_id FROM heat_pixels) s JOIN range(3) z(z) ON TRUE")
def encoded_complete_grid(t: Tables):
    """PNG files of a whole run counted per level: every tile of the grid has one."""
    files = tiling.encode_images(t("heat_pixels"), tiling.TileConfig(tile_size=HEAT_TS, max_zoom=2, method="window", background=SAND))
    ok = files.filter(images.is_png(F.col("content")))
    return ok.groupBy("raster_id", "z").agg(F.count("*").alias("tiles"))
