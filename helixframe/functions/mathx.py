"""Ratios, their formats, and colours as struct<r,g,b,a> of numbers from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .util import ColumnOrName, bind, col


def order_of_magnitude(n: ColumnOrName) -> Column:
    """The power of ten that n rounds up to; 0 for 0, negative for negative n."""
    n = col(n).cast("double")
    up = F.pow(F.lit(10.0), F.ceil(F.log10(F.abs(n))))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.signum(n) * up)


def frequency(amount: ColumnOrName, total: ColumnOrName, one_if_undefined: bool = False) -> Column:
    """amount / total, or 0 (or 1) if total is 0."""
    return F.when(col(total) == 0, F.lit(1.0 if one_if_undefined else 0.0)).otherwise(col(amount) / col(total))


def format_frequency(value: ColumnOrName, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", col(value).cast("double"))


def safe_divide(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b, NaN for a zero divisor."""
    return F.when(col(b) == 0, F.lit(float("nan"))).otherwise(col(a) / col(b))


def rate(count: ColumnOrName, total: ColumnOrName) -> Column:
    """count / total with three decimals; `0` for a total of 0."""
    return F.when(col(total) == 0, "0").otherwise(F.format_string("%.3f", col(count) / col(total)))


# colours


def _number(x) -> Column:
    return (col(x) if isinstance(x, (str, Column)) else F.lit(x)).cast("double")


def rgb(r, g, b, a=None) -> Column:
    alpha = F.lit(None).cast("double") if a is None else _number(a)
    return F.struct(_number(r).alias("r"), _number(g).alias("g"), _number(b).alias("b"), alpha.alias("a"))


def rgb8(r, g, b, a=None) -> Column:
    return rgb(_number(r) / 255, _number(g) / 255, _number(b) / 255, None if a is None else _number(a) / 255)


def parse_rgb8(text: ColumnOrName) -> Column:
    """`r,g,b` or `r,g,b,a`."""
    return bind(F.split(col(text), ","), lambda p: F.struct(*((F.get(p, F.lit(k)).cast("double") / 255).alias(n) for k, n in enumerate("rgba"))))


def parse_html_color(text: ColumnOrName) -> Column:
    """`#rrggbb` or `#rrggbbaa`."""
    part = lambda k: F.conv(F.nullif(F.substring(col(text), 2 + 2 * k, 2), F.lit("")), 16, 10).cast("double") / 255
    return F.struct(*(part(k).alias(n) for k, n in enumerate("rgba")))


def unpack_rgb8(packed: ColumnOrName) -> Column:
    p = col(packed).cast("bigint")
    return rgb8(F.shiftright(p, 16).bitwiseAND(255), F.shiftright(p, 8).bitwiseAND(255), p.bitwiseAND(255))


def _part8(c: Column) -> Column:
    return F.bround(c * 255).cast("int")


def pack_rgb8(c: Column) -> Column:
    return F.shiftleft(_part8(c["r"]), 16) + F.shiftleft(_part8(c["g"]), 8) + _part8(c["b"])


def format_rgb8(c: Column, sep: str = ",", alpha: bool = False) -> Column:
    parts = [_part8(c[n]).cast("string") for n in "rgb"] + [F.coalesce(_part8(c["a"]), F.lit(255)).cast("string")] * alpha
    return F.concat_ws(sep, *parts)


def format_rgb(c: Column, sep: str = ",", digits: int = 4, alpha: bool = False) -> Column:
    parts = [F.format_string(f"%.{digits}f", c[n]) for n in "rgb"] + [F.format_string(f"%.{digits}f", F.coalesce(c["a"], F.lit(1.0)))] * alpha
    return F.concat_ws(sep, *parts)


def format_html_color(c: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(_part8(c[n])), 2, "0")) for n in "rgb"))


def to_hsv(c: Column) -> Column:
    """struct<h,s,v>, each from 0 to 1."""
    hi, lo = F.greatest(c["r"], c["g"], c["b"]), F.least(c["r"], c["g"], c["b"])
    d = hi - lo
    hue = F.when(d == 0, F.lit(0.0)).when(hi == c["r"], (c["g"] - c["b"]) / d).when(hi == c["g"], 2 + (c["b"] - c["r"]) / d).otherwise(4 + (c["r"] - c["g"]) / d)
    return F.struct(F.pmod(hue / 6, F.lit(1.0)).alias("h"), F.when(hi == 0, F.lit(0.0)).otherwise(d / hi).alias("s"), hi.alias("v"))


def from_hsv(h, s, v, a=None) -> Column:
    h, s, v = _number(h), _number(s), _number(v)
    part = lambda n: v - v * s * F.greatest(F.lit(0.0), F.least(F.pmod(n + h * 6, F.lit(6.0)), 4 - F.pmod(n + h * 6, F.lit(6.0)), F.lit(1.0)))
    return rgb(part(F.lit(5.0)), part(F.lit(3.0)), part(F.lit(1.0)), a)


def hsv8(c: Column) -> Column:
    """Hue in degrees, saturation and value in percent, rounded to even."""
    return bind(to_hsv(c), lambda x: F.struct(F.bround(x["h"] * 360).cast("int").alias("h"), F.bround(x["s"] * 100).cast("int").alias("s"), F.bround(x["v"] * 100).cast("int").alias("v")))


def from_hsv8(h, s, v) -> Column:
    return from_hsv(_number(h) / 360, _number(s) / 100, _number(v) / 100)


def color_distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum((F.pow(a[n] - b[n], 2) for n in "rgb"), F.lit(0.0)))


def complementary(c: Column) -> Column:
    return rgb(1 - c["r"], 1 - c["g"], 1 - c["b"], c["a"])


def with_channel(c: Column, channel: str, value) -> Column:
    """The colour with r, g, b or a replaced, or h, s or v of its other form."""
    if channel in "rgba":
        return c.withField(channel, _number(value))
    return bind(to_hsv(c), lambda x: from_hsv(*(_number(value) if n == channel else x[n] for n in "hsv"), c["a"]))
