"""Pixel colour rules as column expressions; channels are integers 0..255."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import div, nearest

CHANNELS = ("r", "g", "b", "a")


@dataclass(frozen=True)
class Background:
    r: int = 0
    g: int = 0
    b: int = 0
    a: int = 0

    @property
    def transparent(self) -> bool:
        return self.a == 0


def parse_hex(text: Column) -> Column:
    """``#RRGGBB`` or ``#RRGGBBAA`` to a struct of four integers, else null."""
    digits = F.regexp_replace(text, "^#+", "")

    def byte(position: int) -> Column:
        return F.conv(F.substring(digits, position, 2), 16, 10).cast("int")

    alpha = F.when(F.length(digits) == 8, byte(7)).otherwise(F.lit(255))
    colour = F.struct(byte(1).alias("r"), byte(3).alias("g"), byte(5).alias("b"), alpha.alias("a"))
    return F.when(digits.rlike("^([0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$"), colour)


def blend(c: Column, a: Column, under: int) -> Column:
    """One channel over an opaque background, rounded."""
    alpha = a.cast("double") / 255.0
    return nearest(c * alpha + under * (1.0 - alpha)).cast("int")


def over_background(px: dict[str, Column], bg: Background, mercator: bool = False) -> dict[str, Column]:
    """Composite a pixel on the background.

    Opaque pixels stay. Translucent ones are blended and become opaque when there is a background. Fully
    clear pixels leave the background as it is, except under Mercator where they are blended like any other.
    """
    a = px["a"]
    solid = F.lit(255)
    if bg.transparent:
        return {c: F.when(F.lit(mercator) | (a > 0), px[c]).otherwise(F.lit(0)) for c in CHANNELS}
    mixed = {c: blend(px[c], a, getattr(bg, c)) for c in "rgb"} | {"a": solid}
    keep = (a == 255)
    out = {}
    for c in CHANNELS:
        when = F.when(keep, px[c])
        if not mercator:
            when = when.when(a == 0, F.lit(getattr(bg, c)))
        out[c] = when.otherwise(mixed[c])
    return out


def flatten_white(c: Column, a: Column) -> Column:
    """Channel over white with integer truncation, as needed before an encoder without alpha."""
    return div(c * a + 255 * (255 - a), 255).cast("int")


def to_rgba(samples: Column, channels: Column) -> Column:
    """Samples of one pixel (1, 2, 3 or 4 channels) to a struct of r, g, b, a."""
    s = [F.get(samples, F.lit(i)).cast("int") for i in range(4)]
    grey = channels <= 2
    alpha = F.when(channels == 2, s[1]).when(channels == 4, s[3]).otherwise(F.lit(255))
    return F.struct(
        s[0].alias("r"),
        F.when(grey, s[0]).otherwise(s[1]).alias("g"),
        F.when(grey, s[0]).otherwise(s[2]).alias("b"),
        alpha.alias("a"),
    )


def pack(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Four channels in one long, for moving a pixel through an aggregate as a single value."""
    return r.cast("long") * 16777216 + g * 65536 + b * 256 + a


def unpack(packed: Column) -> dict[str, Column]:
    return {
        c: F.call_function("shiftright", packed, F.lit(bits)).bitwiseAND(F.lit(255).cast("long")).cast("int")
        for c, bits in zip(CHANNELS, (24, 16, 8, 0))
    }
