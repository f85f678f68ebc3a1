"""Colours and WCAG contrast as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel(hex6: Column, k: int) -> Column:
    """Red, green or blue (0, 1, 2) of a colour of six hex digits, 0 to 1."""
    return F.conv(F.substring(hex6, 2 * k + 1, 2), 16, 10).cast("double") / 255.0


def hex6(text: Column) -> Column:
    """#abc or #aabbcc (any case) as six lower-case hex digits, else null."""
    digits = F.lower(F.regexp_extract(text, r"^#([0-9A-Fa-f]{6}|[0-9A-Fa-f]{3})$", 1))
    return F.when(F.length(digits) == 6, digits).when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1"))


def luminance(hex6_: Column) -> Column:
    linear = lambda c: F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * linear(channel(hex6_, 0)) + 0.7152 * linear(channel(hex6_, 1)) + 0.0722 * linear(channel(hex6_, 2))


def contrast(a: Column, b: Column) -> Column:
    """The WCAG contrast ratio of two colours of six hex digits, 1 to 21."""
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


# Names of colours.
NAMED = (
    "black 000000 silver c0c0c0 gray 808080 grey 808080 white ffffff maroon 800000 red ff0000 purple 800080 fuchsia ff00ff magenta ff00ff green 008000 lime 00ff00 olive 808000 yellow ffff00 navy 000080 blue 0000ff "
    "teal 008080 aqua 00ffff cyan 00ffff orange ffa500 pink ffc0cb brown a52a2a gold ffd700 indigo 4b0082 violet ee82ee tomato ff6347 salmon fa8072 khaki f0e68c crimson dc143c coral ff7f50 beige f5f5dc ivory fffff0 "
    "lightgray d3d3d3 lightgrey d3d3d3 darkgray a9a9a9 darkgrey a9a9a9 dimgray 696969 whitesmoke f5f5f5 gainsboro dcdcdc lightblue add8e6 darkblue 00008b steelblue 4682b4 skyblue 87ceeb royalblue 4169e1 "
    "lightgreen 90ee90 darkgreen 006400 forestgreen 228b22 seagreen 2e8b57 darkred 8b0000 firebrick b22222 lightyellow ffffe0 darkorange ff8c00 slategray 708090 rebeccapurple 663399"
)


def _hex2(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.least(F.greatest(F.round(x), F.lit(0)), F.lit(255)).cast("bigint"))), 2, "0")


def hex_of(text: Column) -> Column:
    """A colour in words, #abc, #aabbcc, rgb() or hsl() as six lower-case hex digits; null for others and for those that let through what is below."""
    t = F.lower(F.trim(text))
    names = NAMED.split()
    named = F.try_element_at(F.create_map(*map(F.lit, names)), t)
    number = lambda pattern, k: F.expr("1") * F.regexp_extract(t, pattern, k).try_cast("double")
    alpha = F.coalesce(F.regexp_extract(t, r"^(?:rgb|hsl)a?\(.*[,/]\s*(0?\.\d+|0)\s*\)$", 1), F.lit(""))
    three = r"^rgba?\(\s*(\d+)[\s,]+(\d+)[\s,]+(\d+)\s*(?:[,/].*)?\)$"
    rgb = F.concat(*(_hex2(number(three, k)) for k in (1, 2, 3)))
    turn = r"^hsla?\(\s*([\d.]+)(?:deg)?[\s,]+([\d.]+)%[\s,]+([\d.]+)%\s*(?:[,/].*)?\)$"
    h, s, light = number(turn, 1), number(turn, 2) / 100, number(turn, 3) / 100
    # each channel from hue, saturation and lightness at its own offset on the wheel
    at = lambda n: F.pmod(n + h / 30, F.lit(12.0))
    part = lambda n: light - s * F.least(light, 1 - light) * F.greatest(F.lit(-1.0), F.least(at(n) - 3, 9 - at(n), F.lit(1.0)))
    hsl = F.concat(*(_hex2(part(F.lit(float(n))) * 255) for n in (0, 8, 4)))
    clear = (alpha != "") & (F.coalesce(alpha.try_cast("double"), F.lit(1.0)) < 1) & t.rlike("^(rgba|hsla)|/")
    return F.when(~clear, F.coalesce(hex6(t), named, F.when(t.rlike(three), rgb), F.when(t.rlike(turn), hsl)))
