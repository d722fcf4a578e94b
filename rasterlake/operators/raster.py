"""Relational raster operators on pixel tables.

A pixel table has ``raster_id, width, height, x, y, r, g, b, a``. It is sparse: a pixel that is not there is
fully transparent. Resampling scatters every source pixel to the outputs it contributes to (an expression and
a generator, no join) and sums integer fixed-point weights, so the result does not depend on row order and the
grouping keys stay fine however large one raster is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color, geo
from ..functions.color import CHANNELS, Background
from ..functions.geo import div, nearest
from ..plans import grids
from ..plans.hotkeys import attach

WEIGHT_ONE = 1 << 20
CATMULL_SUPPORT = 2.0
WHOLE = 1 << 16  # pixels of a raster up to which one task takes all of it
SIDE = 1 << 10  # side of its largest canvas up to which it does
SHARES = 4  # tasks for each shuffle partition where pixels are resampled
RASTER = ("raster_id",)
SIZE = ("width", "height")


# --- samples ----------------------------------------------------------------------------------


def explode_samples(rasters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arrays of interleaved samples to one row per sample, and the rasters whose array is too short."""
    complete = F.size("samples") >= F.col("width") * F.col("height") * F.col("channels")
    index = F.col("pos")
    pixel = div(index, F.col("channels"))
    long = (
        rasters.filter(complete)
        .select("raster_id", *SIZE, "channels", F.posexplode("samples").alias("pos", "v"))
        .filter(index < F.col("width") * F.col("height") * F.col("channels"))
        .select(
            "raster_id",
            *SIZE,
            "channels",
            (index % F.col("channels")).alias("channel"),
            (pixel % F.col("width")).cast("int").alias("x"),
            div(pixel, F.col("width")).cast("int").alias("y"),
            F.col("v").cast("double").alias("v"),
        )
    )
    return long, rasters.filter(~F.coalesce(complete, F.lit(False)))


def finite(v: Column) -> Column:
    return ~(F.isnan(v) | (F.abs(v) == float("inf")))


def stretched(v: Column, low: Column, high: Column) -> Column:
    """A sample on the 0..255 scale of its channel's range."""
    level = nearest((v - low) / (high - low) * 255.0)
    scaled = F.greatest(F.lit(0), F.least(F.lit(255), level)).cast("int")
    flat = F.when(high > 0, 255).otherwise(0)
    return F.when(v.isNull() | ~finite(v), 0).when(high > low, scaled).otherwise(flat)


def stretch(samples: DataFrame, keys: Sequence[str] = RASTER) -> DataFrame:
    """Add ``level``: every sample stretched over its raster's and channel's finite range.

    The ranges come from a partial aggregate and are attached so that one very large raster stays spread out.
    """
    usable = F.when(finite(F.col("v")), F.col("v"))
    ranges = samples.groupBy(*keys).agg(F.min(usable).alias("low"), F.max(usable).alias("high"), F.count("*").alias("_n"))
    return attach(samples, ranges, keys, ["x", "y"]).withColumn(
        "level", stretched(F.col("v"), F.col("low"), F.col("high"))
    ).drop("low", "high")


def band_pixels(levels: DataFrame) -> DataFrame:
    """Stretched samples (raster_id, channels, channel, x, y, level) to pixels.

    One band is grey, two are grey with alpha, four are RGBA; any other count of three or more takes its first
    three bands as colour.
    """
    by_channel = [F.max(F.when(F.col("channel") == i, F.col("level"))) for i in range(4)]
    shown = F.when(F.col("channels").isin(1, 2, 4), F.col("channels")).otherwise(F.lit(3))
    return (
        levels.groupBy("raster_id", *SIZE, "channels", "x", "y")
        .agg(F.array(*by_channel).alias("bands"))
        .withColumn("px", color.to_rgba(F.col("bands"), shown))
        .select("raster_id", *SIZE, "x", "y", *[F.col(f"px.{c}").alias(c) for c in CHANNELS])
    )


def grey_pixels(levels: DataFrame) -> DataFrame:
    """Single-band levels to opaque grey pixels."""
    level = F.col("level")
    return levels.select(
        "raster_id", *SIZE, "x", "y", level.alias("r"), level.alias("g"), level.alias("b"), F.lit(255).alias("a")
    )


# --- resampling -------------------------------------------------------------------------------


def _large(width: str = "width", height: str = "height") -> Column:
    return F.coalesce(F.col(width).cast("long") * F.col(height) > WHOLE, F.lit(False))


def _large_canvas(tile_size: int, zmax: Column | int) -> Column:
    return _large() | F.coalesce(geo.canvas_size(geo.as_col(zmax), tile_size) > SIDE, F.lit(False))


def by_line(px: DataFrame, axis: str, width: str = "width", height: str = "height", large: Column | None = None) -> DataFrame:
    """Pixels brought together by column or row (``_line``), those of a small raster all together, where no step needs another shuffle.

    ``_large`` tells which form a raster takes.
    """
    # A hash of the raster stands for all lines of a small one: a constant would be taken out of the grouping, and its shuffle come back.
    line = F.when(F.col("_large"), F.col(axis).cast("long")).otherwise(F.hash(*RASTER).cast("long"))
    # Few pixels become many sums in a task, which Spark can't foresee when it joins small partitions, so their number is given.
    tasks = SHARES * int(px.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = px.withColumn("_large", _large(width, height) if large is None else large)
    return sized.withColumn("_line", line).repartition(tasks, *RASTER, "_line")


def _across(columns: DataFrame, deal: Sequence[str], then: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """The next pass ``then(rows, keys)``: the rows of large rasters are dealt out by ``deal`` first, and lose their ``_line``.

    The rows of small rasters keep it: whatever groups by raster and ``_line`` finds them together (``in_forms``).
    """
    whole = then(columns.filter(~F.col("_large")), ["_line"])
    spread = columns.filter(F.col("_large")).drop("_line")
    return whole.unionByName(then(spread.repartition(*deal) if deal else spread, []).withColumn("_line", F.lit(None).cast("long")))


def in_forms(rows: DataFrame, then: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """``then(rows, keys)`` on the rows of small rasters, whose grouping by ``keys`` and more needs no shuffle, and on all others."""
    whole = then(rows.filter(F.col("_line").isNotNull()), ["_line"])
    spread = then(rows.filter(F.col("_line").isNull()).drop("_line"), [])
    return whole.unionByName(spread.withColumn("_line", F.lit(None).cast("long")))


def catmull_rom(t: Column) -> Column:
    """Kernel for distances below two."""
    near = 1.5 * t * t * t - 2.5 * t * t + 1.0
    far = -0.5 * t * t * t + 2.5 * t * t - 4.0 * t + 2.0
    return F.when(t < 1.0, near).otherwise(far)


def fixed_weight(t: Column, s: Column) -> Column:
    return nearest(catmull_rom(t) / s * float(WEIGHT_ONE))


def with_tap_total(rows: DataFrame, name: str, o: Column, n: Column, n2: Column) -> DataFrame:
    """Add the sum of the weights of all source indices inside the image for output ``o``.

    An enlarged axis has at most five taps, which are columns of their own; a reduced one folds over its taps, but has few outputs. Ratio,
    centre, bounds and distances are columns too, so each is evaluated once per row.
    """
    ratio, s, centre, low, high = (F.col(c) for c in ("_ratio", "_s", "_centre", "_low", "_high"))
    distances = F.transform(F.sequence(low, high), lambda i: F.abs((i + 0.5) - centre) / s)
    zero = F.lit(0).cast("long")
    folded = F.aggregate(distances, zero, lambda acc, t: acc + F.when(t < 2.0, fixed_weight(t, s)).otherwise(zero))
    taps = {f"_t{k}": F.abs((low + k + 0.5) - centre) for k in range(5)}
    written = [
        F.when((low + k <= high) & (F.col(t) < 2.0), fixed_weight(F.col(t), F.lit(1.0))).otherwise(zero) for k, t in enumerate(taps)
    ]
    return (
        rows.select("*", (n.cast("double") / n2).alias("_ratio"))
        .select("*", F.greatest(F.lit(1.0), ratio).alias("_s"), ((o + 0.5) * ratio).alias("_centre"))
        .select(
            "*", F.greatest(F.lit(0), F.ceil(centre - 0.5 - CATMULL_SUPPORT * s).cast("int")).alias("_low"),
            F.least(n.cast("int") - 1, F.floor(centre - 0.5 + CATMULL_SUPPORT * s).cast("int")).alias("_high"),
        )
        .withColumns(taps)
        .withColumn(name, F.when(ratio <= 1.0, sum(written, zero)).otherwise(folded))
        .drop("_ratio", "_s", "_centre", "_low", "_high", *taps)
    )


def _pass(px: DataFrame, keys: Sequence[str], axis: str, n: Column, n2: Column) -> DataFrame:
    """One separable pass: scaled integer sums per output index of ``axis``; ``with_tap_total`` gives their divisor.

    Each source index is scattered to all outputs it can reach. Scale, distance and weight are separate columns,
    which keeps every one of them evaluated once per row.
    """
    other = "y" if axis == "x" else "x"
    ratio, s, i = F.col("_ratio"), F.col("_s"), F.col(axis)
    low = F.ceil((i + 0.5 - CATMULL_SUPPORT * s) / ratio - 0.5).cast("int")
    high = F.floor((i + 0.5 + CATMULL_SUPPORT * s) / ratio - 0.5).cast("int")
    outputs = F.sequence(F.greatest(F.lit(0), low), F.least(n2.cast("int") - 1, high))
    ratio_of = n.cast("double") / n2
    # n and n2 must be part of the keys.
    values = [F.col(c) for c in (*keys, other, *CHANNELS)]
    scaled = px.select("*", ratio_of.alias("_ratio")).select("*", F.greatest(F.lit(1.0), ratio).alias("_s"))
    spread = (
        scaled.select(*values, axis, "_ratio", "_s", F.explode(outputs).alias("_o"))
        .select("*", (F.abs((i + 0.5) - (F.col("_o") + 0.5) * ratio) / s).alias("_t"))
        .filter((F.col("_t") < 2.0) & (F.col("_t") != 1.0))
        .select("*", fixed_weight(F.col("_t"), s).alias("_w"))
    )
    return spread.groupBy(*keys, other, F.col("_o").alias(axis)).agg(
        *[F.sum(F.col("_w") * F.col(c)).alias(c) for c in CHANNELS]
    )


def _rounded(total: Column, divisor: Column) -> Column:
    level = div(total * 2 + divisor, divisor * 2)
    return F.least(F.lit(255), F.greatest(F.lit(0), level)).cast("int")


def resample(px: DataFrame, keys: Sequence[str], width: str, height: str, out_w: str, out_h: str, held: bool = False) -> DataFrame:
    """Catmull-Rom resize of every raster from (width, height) to (out_w, out_h).

    ``keys`` must determine the four size columns and include them. Vertical pass first, rounding once at the
    end. Same size gives the same pixels. Pixels are brought together by column (``by_line``), then by row, before
    they are scattered to their outputs, so each pass moves pixels and not filter taps. ``held`` keeps ``_line``.
    """
    placed = px if "_line" in px.columns else by_line(px, "x", width, height)
    columns = _pass(placed, [*keys, "_large", "_line"], "y", F.col(height), F.col(out_h))
    both = _across(
        columns, [*[k for k in keys if k in (*RASTER, "z")], "y"],
        lambda rows, line: _pass(rows, [*keys, *line], "x", F.col(width), F.col(out_w)),
    )
    return _divided(both, F.col(width), F.col(out_w), F.col(height), F.col(out_h)).select(
        *keys, *_held(held), "x", "y", *CHANNELS
    )


def _held(held: bool) -> list[str]:
    return ["_line"] if held else []


def _divided(sums: DataFrame, n_x: Column, out_x: Column, n_y: Column, out_y: Column) -> DataFrame:
    """The sums of both passes as levels; the divisors are worked out once for each output pixel."""
    totals = with_tap_total(with_tap_total(sums, "_dx", F.col("x"), n_x, out_x), "_dy", F.col("y"), n_y, out_y)
    product = totals.select("*", (F.col("_dx") * F.col("_dy")).alias("_d")).drop("_dx", "_dy")
    return product.withColumns({c: _rounded(F.col(c), F.col("_d")) for c in CHANNELS}).drop("_d")


def resample_columns(px: DataFrame, keys: Sequence[str], width: str, out_w: str, held: Sequence[str] = ()) -> DataFrame:
    """Horizontal resize only, of pixels that ``by_line`` has brought together by row."""
    across = _pass(px, [*keys, "_large", "_line"], "x", F.col(width), F.col(out_w))
    total = with_tap_total(across, "_dx", F.col("x"), F.col(width), F.col(out_w))
    return total.select(*keys, *held, "x", "y", *[_rounded(F.col(c), F.col("_dx")).alias(c) for c in CHANNELS])


def prescale(px: DataFrame, scale: float) -> DataFrame:
    """Resize by a factor before tiling; the new size replaces the old one."""
    sized = by_line(px, "x").withColumn("_w2", geo.prescale(F.col("width"), scale)).withColumn(
        "_h2", geo.prescale(F.col("height"), scale)
    )
    keys = [*RASTER, *SIZE, "_w2", "_h2"]
    return resample(sized, keys, "width", "height", "_w2", "_h2").select(
        *RASTER, F.col("_w2").alias("width"), F.col("_h2").alias("height"), "x", "y", *CHANNELS
    )


# --- canvases ---------------------------------------------------------------------------------

LEVEL = (*RASTER, *SIZE, "z", "canvas", "fit_w", "fit_h")
CANVAS = (*RASTER, "z", "canvas", "x", "y", *CHANNELS)


def at_zooms(px: DataFrame, tile_size: int, zmin: Column | int, zmax: Column | int, by: str = "x") -> DataFrame:
    """Repeat every row for its zoom levels, with the canvas and the fitted size of each.

    Pixels are first brought together by column, or by row where only rows are resampled (``by="y"``, for
    Mercator); the first pass then needs no further shuffle.
    """
    zooms = grids.levels(geo.as_col(zmin), geo.as_col(zmax))
    w, h, z = F.col("width"), F.col("height"), F.col("z")
    return (
        by_line(px, by, large=_large_canvas(tile_size, zmax))
        .withColumn("z", F.explode(zooms))
        .withColumn("canvas", geo.canvas_size(z, tile_size).cast("int"))
        .withColumn("fit_w", geo.fit(w, w, h, z, tile_size))
        .withColumn("fit_h", geo.fit(h, w, h, z, tile_size))
    )


def _composited(px: DataFrame, bg: Background, mercator: bool = False) -> DataFrame:
    out = color.over_background({c: F.col(c) for c in CHANNELS}, bg, mercator)
    return px.select(*[F.col(c) for c in CANVAS if c not in CHANNELS], *_held("_line" in px.columns), *[out[c].alias(c) for c in CHANNELS])


def flat_canvas(levels: DataFrame, bg: Background = Background(), held: bool = False) -> DataFrame:
    """Fitted image at the top left of the canvas of every zoom in ``levels`` (see ``at_zooms``)."""
    return _composited(resample(levels, LEVEL, "width", "height", "fit_w", "fit_h", held), bg)


def over_canvas(px: DataFrame, bg: Background) -> DataFrame:
    """Composite pixels on the background, keeping all other columns."""
    out = color.over_background({c: F.col(c) for c in CHANNELS}, bg)
    return px.select(*[c for c in px.columns if c not in CHANNELS], *[out[c].alias(c) for c in CHANNELS])


def image_sizes(px: DataFrame) -> DataFrame:
    """One row per raster; partial aggregation keeps this cheap next to the pixels."""
    return px.groupBy(*RASTER, *SIZE).agg(F.lit(1).alias("_one")).drop("_one")


def _packed() -> Column:
    return color.pack(*[F.col(c) for c in CHANNELS])


def _tap_channels(name: str) -> dict[str, Column]:
    return color.unpack(F.coalesce(F.col(name), F.lit(0).cast("long")))


def into_rows(px: DataFrame) -> DataFrame:
    """Give every source row's pixels to the canvas rows that blend them: ``cy``, and ``tap`` 0 or 1 for the upper or lower of its two rows.

    Like ``into_windows`` this is arithmetic on each row: candidates come from the inverse curve, one more on each side, and are checked.
    """
    h, canvas, y = F.col("height"), F.col("canvas"), F.col("y")
    steps = F.greatest(F.lit(1.0), h - 1.0)
    first = F.floor(geo.mercator_t((y - 1) / steps) * canvas) - 1
    last = F.ceil(geo.mercator_t((y + 1) / steps) * canvas) + 1
    # All rows of the canvas show the only row of an image of one.
    low, high = F.when(h > 1, F.greatest(F.lit(0), first)).otherwise(0), F.when(h > 1, F.least(canvas - 1, last)).otherwise(canvas - 1)
    spread = px.withColumn("cy", F.explode(grids.levels(low, high)))
    return spread.withColumn("tap", y - _upper_row()).filter(F.col("tap").between(0, 1))


def _source_row() -> Column:
    """Place of canvas row ``cy`` between the rows of the source."""
    return geo.mercator_y(F.col("cy").cast("double") / F.col("canvas")) * (F.col("height") - 1.0)


def _upper_row() -> Column:
    return F.least(F.floor(_source_row()).cast("int"), F.col("height") - 1)


def mercator_canvas(levels: DataFrame, bg: Background = Background(), held: bool = False) -> DataFrame:
    """Columns fitted linearly, rows remapped by the Mercator curve with a linear blend of two source rows."""
    columns = resample_columns(levels, LEVEL, "width", "fit_w", ["_large", "_line"])
    shown = columns.filter((F.col("x") < F.col("canvas")) & F.col("raster_id").isNotNull())
    met = into_rows(shown.withColumn("_p", _packed()).drop(*CHANNELS))
    pairs = _across(met, [], lambda rows, line: rows.groupBy(*RASTER, "height", "z", "canvas", "x", "cy", *line).agg(
        F.max(F.when(F.col("tap") == 0, F.col("_p"))).alias("_p0"),
        F.max(F.when(F.col("tap") == 1, F.col("_p"))).alias("_p1"),
    ))
    placed = pairs.withColumn("_f", _source_row()).withColumn("frac", F.col("_f") - F.least(F.floor("_f").cast("int"), F.col("height") - 1))
    p0, p1, frac = _tap_channels("_p0"), _tap_channels("_p1"), F.col("frac")
    mixed = placed.select(
        *RASTER, "z", "canvas", "x", F.col("cy").alias("y"), *_held(held),
        *[nearest(p0[c] * (1.0 - frac) + p1[c] * frac).cast("int").alias(c) for c in CHANNELS],
    )
    return _composited(mixed, bg, mercator=True)


ISO_ROTATION = 0.7071067811865476  # cos 45 degrees
ISO_FORESHORTENING = 0.5


def _iso_frame(rows: DataFrame) -> DataFrame:
    """Add the scale of the turned image and the halves of its sides, which every place in it is worked out from."""
    w, h, canvas = (F.col(c).cast("double") for c in ("fit_w", "fit_h", "canvas"))
    scale = F.least(F.lit(1.0), canvas / ((w + h) * ISO_ROTATION))
    return rows.select("*", scale.alias("_s"), (canvas / 2.0).alias("_c2"), (w / 2.0).alias("_w2"), (h / 2.0).alias("_h2"))


def _iso_source(rows: DataFrame) -> DataFrame:
    """Add ``sx`` and ``sy``, where in the fitted image the canvas pixel (cx, cy) lies."""
    dy = (F.col("cy") - F.col("_c2")) / F.col("_s") / ISO_FORESHORTENING
    return rows.select("*", dy.alias("_dy")).select(
        "*", (F.col("_dx") * ISO_ROTATION + F.col("_dy") * ISO_ROTATION + F.col("_w2")).alias("sx"),
        (-F.col("_dx") * ISO_ROTATION + F.col("_dy") * ISO_ROTATION + F.col("_h2")).alias("sy"),
    )


def into_diamonds(px: DataFrame) -> DataFrame:
    """Give every fitted pixel to the canvas pixels (cx, cy) inside the rotated image that it is one of four neighbours of.

    ``corner`` is its place among the four, ``_fx`` and ``_fy`` that of the canvas pixel between them. The canvas pixels of a pixel lie in a diamond: its columns, then the rows of each come from the
    inverse of the turn, with a small margin, and are checked. What the check needs is worked out before the generators, since a filter
    takes the expressions up to them into itself.
    """
    # Sum and difference of dy and dx in the middle of the pixel's reach, which is one pixel of the fitted image to each side.
    reach, margin = 1.0 / ISO_ROTATION, 1e-3
    total, gap = (F.col("x") - F.col("_w2")) / ISO_ROTATION, (F.col("y") - F.col("_h2")) / ISO_ROTATION
    placed = _iso_frame(px).select("*", total.alias("_total"), gap.alias("_gap"))

    def inside(rows: DataFrame, name: str, low: Column, high: Column) -> DataFrame:
        ends = rows.select(
            "*", F.greatest(F.lit(0), F.ceil(low - margin).cast("int")).alias("_low"),
            F.least(F.col("canvas") - 1, F.floor(high + margin).cast("int")).alias("_high"),
        )
        return ends.filter(F.col("_low") <= F.col("_high")).withColumn(name, F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")

    middle = F.col("_c2") + (F.col("_total") - F.col("_gap")) / 2.0 * F.col("_s")
    columns = inside(placed, "cx", middle - F.col("_s") * reach, middle + F.col("_s") * reach).withColumn("_dx", (F.col("cx") - F.col("_c2")) / F.col("_s"))
    below = F.greatest(F.col("_total") - F.col("_dx"), F.col("_gap") + F.col("_dx")) - reach
    above = F.least(F.col("_total") - F.col("_dx"), F.col("_gap") + F.col("_dx")) + reach
    squash = F.col("_s") * ISO_FORESHORTENING
    cells = inside(columns, "cy", F.col("_c2") + below * squash, F.col("_c2") + above * squash)
    across, down = F.col("x") - F.floor("sx"), F.col("y") - F.floor("sy")
    shown = (F.col("sx") >= 0) & (F.col("sx") < F.col("fit_w") - 1) & (F.col("sy") >= 0) & (F.col("sy") < F.col("fit_h") - 1)
    met = _iso_source(cells).filter(shown & across.between(0, 1) & down.between(0, 1))
    return met.select(
        *px.columns, "cx", "cy", (across + down * 2).cast("int").alias("corner"),
        (F.col("sx") - F.floor("sx")).alias("_fx"), (F.col("sy") - F.floor("sy")).alias("_fy"),
    )


def isometric_canvas(levels: DataFrame, bg: Background = Background(), held: bool = False) -> DataFrame:
    """Rotate by 45 degrees, halve the height, and sample the fitted image bilinearly."""
    fitted = resample(levels, LEVEL, "width", "height", "fit_w", "fit_h", held=True).filter(F.col("raster_id").isNotNull())
    met = into_diamonds(fitted.withColumn("_p", _packed()).drop(*CHANNELS))
    # All rows of a canvas pixel have the same fractions. As columns of the grouping a filter does not take in what they are made of.
    placed = in_forms(met, lambda rows, line: rows.groupBy(*RASTER, "z", "canvas", *line, "cx", "cy").agg(
        F.max("_fx").alias("_fx"), F.max("_fy").alias("_fy"), *[F.max(F.when(F.col("corner") == i, F.col("_p"))).alias(f"_p{i}") for i in range(4)]
    ))
    fx, fy = F.col("_fx"), F.col("_fy")
    p = [_tap_channels(f"_p{i}") for i in range(4)]

    def mixed(c: str) -> Column:
        top = p[0][c] * (1.0 - fx) + p[1][c] * fx
        bottom = p[2][c] * (1.0 - fx) + p[3][c] * fx
        return nearest(top * (1.0 - fy) + bottom * fy).cast("int").alias(c)

    sampled = placed.select(
        *RASTER, "z", "canvas", F.col("cx").alias("x"), F.col("cy").alias("y"), *_held(held), *[mixed(c) for c in CHANNELS]
    )
    if bg.transparent:
        return sampled.filter(F.col("a") > 0)
    return _composited(sampled, bg, mercator=True)


def canvas(levels: DataFrame, projection: str, bg: Background = Background(), held: bool = False) -> DataFrame:
    form = {"flat": flat_canvas, "mercator": mercator_canvas, "isometric": isometric_canvas}[projection]
    return form(levels, bg, held)


def fill(px: DataFrame, sizes: DataFrame, bg: Background) -> DataFrame:
    """Complete a sparse canvas with background pixels: one generated grid, one equi join."""
    grid = grids.with_square(sizes.select(*RASTER, "z", "canvas"), "y", "x", F.col("canvas"), [*RASTER, "z"])
    keys = [*RASTER, "z", "canvas", "x", "y"]
    return grid.join(px, keys, "left").select(
        *keys, *[F.coalesce(F.col(c), F.lit(getattr(bg, c))).alias(c) for c in CHANNELS]
    )


def filled_canvas(levels: DataFrame, projection: str, bg: Background) -> DataFrame:
    """The canvas of every zoom in ``levels``, completed with background pixels as by ``fill``.

    The cells of small rasters are made in the tasks that have their pixels, and meet them there.
    """
    sizes = levels.select(*RASTER, "z", "canvas", "_large", "_line")
    px = canvas(levels, projection, bg, held=True)
    side = F.sequence(F.lit(0), F.col("canvas") - 1)
    cells = sizes.filter(~F.col("_large")).drop("_large").distinct().withColumn("y", F.explode(side)).withColumn("x", F.explode(side))
    # A raster without an id has no pixel of its own, as in the join.
    whole = px.filter(F.col("_line").isNotNull() & F.col("raster_id").isNotNull()).withColumn("_cell", F.lit(False))
    met = whole.unionByName(cells.select(
        "*", *[F.lit(None).cast("int").alias(c) for c in CHANNELS], F.lit(True).alias("_cell")
    )).groupBy(*RASTER, "z", "canvas", "x", "y", "_line").agg(F.max("_cell").alias("_cell"), *[F.max(c).alias(c) for c in CHANNELS])
    full = met.filter("_cell").select(
        *RASTER, "z", "canvas", "x", "y", *[F.coalesce(F.col(c), F.lit(getattr(bg, c))).alias(c) for c in CHANNELS]
    )
    large = sizes.filter(F.col("_large")).select(*RASTER, "z", "canvas").distinct()
    return full.unionByName(fill(px.filter(F.col("_line").isNull()).drop("_line"), large, bg))


def visible(px: DataFrame) -> DataFrame:
    """Drop fully clear black pixels, which a sparse table does not need."""
    return px.filter((F.col("r") + F.col("g") + F.col("b") + F.col("a")) > 0)


def crop_tiles(canvas_px: DataFrame, tile_size: int) -> DataFrame:
    """Canvas pixels to tile coordinates and offsets within the tile."""
    return canvas_px.select(
        *RASTER, "z",
        div(F.col("x"), tile_size).cast("int").alias("tx"), div(F.col("y"), tile_size).cast("int").alias("ty"),
        (F.col("x") % tile_size).cast("int").alias("ox"), (F.col("y") % tile_size).cast("int").alias("oy"),
        *_held("_line" in canvas_px.columns), *CHANNELS,
    )


# --- window method ----------------------------------------------------------------------------


def _window(tile: Column, axis: str, tile_size: int, projection: str) -> tuple[Column, Column]:
    """Source start and end of a tile along one axis, as fractions of a pixel."""
    n = F.col("width" if axis == "x" else "height").cast("double")
    grid = geo.grid_size(F.col("z"))
    if projection == "mercator" and axis == "y":
        low, high = geo.row_range(tile, grid)
        return low * n, high * n
    canvas_px = (grid * tile_size).cast("double")
    longest = F.greatest("width", "height").cast("double")
    return tile * float(tile_size) * longest / canvas_px, (tile + 1) * float(tile_size) * longest / canvas_px


def axis_windows(rows: DataFrame, axis: str, tile_size: int, projection: str) -> DataFrame:
    """For rows with a tile number ``t{axis}``: first source index, number of indices and output size.

    Tiles that begin beyond the image are left out.
    """
    n = F.col("width" if axis == "x" else "height").cast("double")
    start, end = _window(F.col(f"t{axis}"), axis, tile_size, projection)
    span = tile_size * F.greatest("width", "height").cast("double") / (geo.grid_size(F.col("z")) * tile_size).cast("double")
    covered = F.greatest(F.lit(0.0), F.least(n - F.col("_start"), span)) / span
    whole = projection == "mercator" and axis == "y"
    out = F.lit(tile_size) if whole else F.greatest(F.lit(1), nearest(covered * tile_size)).cast("int")
    low, high = F.least(F.floor("_start"), n - 1).cast("int"), F.least(F.ceil("_end") + 1, n).cast("int")
    return (
        rows.select("*", start.alias("_start"), end.alias("_end"))
        .filter(F.col("_start") < n)
        .select("*", low.alias(f"low_{axis}"), high.alias("_high"), out.alias(f"out_{axis}"))
        .select("*", F.greatest(F.lit(1), F.col("_high") - F.col(f"low_{axis}")).alias(f"n_{axis}"))
        .drop("_start", "_end", "_high")
    )


def _candidates(axis: str, tile_size: int, projection: str) -> Column:
    """Tile numbers whose window may hold the row's source index: the exact ones and a few more."""
    i = F.col(axis)
    grid = geo.grid_size(F.col("z"))
    if projection == "mercator" and axis == "y":
        h = F.col("height").cast("double")
        low, high = geo.mercator_t((i - 2) / h) * grid, geo.mercator_t((i + 2) / h) * grid
    else:
        span = F.greatest("width", "height").cast("double") / grid
        low, high = (i - 2) / span, (i + 2) / span
    first = F.greatest(F.lit(0), F.floor(low).cast("int") - 1)
    last = F.least((grid - 1).cast("int"), F.ceil(high).cast("int"))
    return F.sequence(F.least(first, last), last)


def into_windows(px: DataFrame, axis: str, tile_size: int, projection: str) -> DataFrame:
    """Give every source pixel to the tiles whose window holds it along one axis, numbered from the window's start.

    The range join is plain arithmetic on each row: candidate tiles are generated and checked, nothing is shuffled.
    """
    spread = px.withColumn(f"t{axis}", F.explode(_candidates(axis, tile_size, projection)))
    placed = axis_windows(spread, axis, tile_size, projection)
    offset = F.col(axis) - F.col(f"low_{axis}")
    return placed.filter((offset >= 0) & (offset < F.col(f"n_{axis}"))).withColumn(axis, offset).drop(f"low_{axis}")


def source_rows(sizes: DataFrame, tile_size: int, projection: str) -> DataFrame:
    """Source rows [low, high) that each tile row needs, with a margin of one, for pruning a scan on y."""
    n = F.col("height").cast("double")
    canvas_px = (geo.grid_size(F.col("z")) * tile_size).cast("double")
    longest = F.greatest("width", "height").cast("double")
    row = F.col("ty")
    if projection == "mercator":
        low, high = geo.row_range(row, geo.grid_size(F.col("z")))
        start, end = low * n, high * n
    else:
        start, end = row * float(tile_size) * longest / canvas_px, (row + 1) * float(tile_size) * longest / canvas_px
    return (
        grids.with_range(sizes, "ty", geo.grid_size(F.col("z")), [*RASTER, "z"])
        .withColumn("start", start)
        .withColumn("end", end)
        .filter(F.col("start") < n)
        .select(
            *RASTER, "z", "ty",
            F.least(F.greatest(F.lit(0.0), F.floor("start") - 1), n - 1).cast("int").alias("row_low"),
            F.least(F.ceil("end") + 1, n).cast("int").alias("row_high"),
        )
    )


def extract_windows(px: DataFrame, tile_size: int, zmax: Column | int, projection: str, held: bool = False) -> DataFrame:
    """Tiles of the highest zoom, each cropped and resampled from its own source window."""
    sized = by_line(px, "x", large=_large_canvas(tile_size, zmax)).withColumn("z", geo.as_col(zmax).cast("int"))
    down = into_windows(sized, "y", tile_size, projection)
    kept = [*RASTER, *SIZE, "z", "ty", "n_y", "out_y", "_large", "_line"]
    columns = _pass(down, kept, "y", F.col("n_y"), F.col("out_y"))
    keys = [*RASTER, "z", "tx", "ty", "n_x", "out_x", "n_y", "out_y"]

    def across(rows: DataFrame, line: Sequence[str]) -> DataFrame:
        return _pass(into_windows(rows, "x", tile_size, projection), [*keys, *line], "x", F.col("n_x"), F.col("out_x"))

    both = _across(columns, [*RASTER, "ty", "y"], across)
    return _divided(both, F.col("n_x"), F.col("out_x"), F.col("n_y"), F.col("out_y")).select(
        *RASTER, "z", *_held(held), "tx", "ty", F.col("x").alias("ox"), F.col("y").alias("oy"), *CHANNELS
    )


def ground_tiles(sizes: DataFrame, zmin: Column | int, zmax: Column | int, bg: Background) -> DataFrame:
    """One row for every tile of the complete grid, without offsets: the colour of all its pixels that have no row of their own."""
    ranges = sizes.select(*RASTER, geo.as_col(zmin).alias("_lo"), geo.as_col(zmax).alias("_hi"))
    offset = F.lit(None).cast("int")
    return geo.tile_grid(ranges, F.col("_lo"), F.col("_hi")).select(
        *RASTER, "z", "tx", "ty", offset.alias("ox"), offset.alias("oy"), *[F.lit(getattr(bg, c)).alias(c) for c in CHANNELS]
    )


def blank_tiles(tiles: DataFrame, sizes: DataFrame, zmin: Column | int, zmax: Column | int) -> DataFrame:
    """Tiles of the complete grid that have no pixel, with their zero colour."""
    present = tiles.groupBy(*RASTER, "z", "tx", "ty").agg(F.lit(1).alias("_one")).drop("_one")
    grid = geo.tile_grid(sizes.select(*RASTER, geo.as_col(zmin).alias("_lo"), geo.as_col(zmax).alias("_hi")),
                         F.col("_lo"), F.col("_hi")).drop("_lo", "_hi")
    return grid.join(present, [*RASTER, "z", "tx", "ty"], "left_anti").withColumn("rgba", F.lit("00000000"))


# --- thumbnail and summary --------------------------------------------------------------------


def thumbnail(px: DataFrame, box: int = 480) -> DataFrame:
    """Box average into a frame of ``box`` pixels, aspect kept; pixels that are not there count as clear."""
    w, h = F.col("width"), F.col("height")
    longest = F.greatest(w, h)
    tw = F.greatest(F.lit(1), div(w.cast("long") * box, longest)).cast("int")
    th = F.greatest(F.lit(1), div(h.cast("long") * box, longest)).cast("int")
    shrunk = (
        px.withColumn("tw", F.least(tw, w))
        .withColumn("th", F.least(th, h))
        .withColumn("ux", div(F.col("x").cast("long") * F.col("tw"), w).cast("int"))
        .withColumn("uy", div(F.col("y").cast("long") * F.col("th"), h).cast("int"))
    )

    def cells(u: str, n: Column, m: str) -> Column:
        # How many source indices fall into output cell u: ceil((u+1)n/m) - ceil(u n/m).
        up = lambda k: div(k.cast("long") * n + F.col(m) - 1, F.col(m))
        return up(F.col(u) + 1) - up(F.col(u))

    area = cells("ux", w, "tw") * cells("uy", h, "th")
    return (
        shrunk.groupBy(*RASTER, *SIZE, "tw", "th", "ux", "uy")
        .agg(*[F.sum(c).alias(c) for c in CHANNELS])
        .select(*RASTER, "tw", "th", F.col("ux").alias("x"), F.col("uy").alias("y"),
                *[div(F.col(c) * 2 + area, area * 2).cast("int").alias(c) for c in CHANNELS])
    )


def run_summary(dims: DataFrame, default_tile_size: int = 256) -> DataFrame:
    """One row per raster: output range, level and tile counts; an error text when a side is zero."""
    w, h = F.col("width"), F.col("height")
    ts = F.coalesce(F.col("tile_size"), F.lit(default_tile_size))
    zmax = F.coalesce(F.col("max_zoom").cast("int"), geo.max_zoom(w, h, ts))
    ok = (w > 0) & (h > 0)
    return dims.select(
        *RASTER, *SIZE,
        F.when(ok, F.lit(0)).alias("min_zoom"),
        F.when(ok, zmax).alias("max_zoom"),
        F.when(ok, zmax + 1).alias("zoom_levels"),
        F.when(ok, geo.total_tiles(0, zmax)).alias("total_tiles"),
        F.when(~ok, F.lit("image dimensions are zero")).alias("error"),
    )
