"""Colour and geometry kernels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def chroma(r: Column, g: Column, b: Column) -> Column:
    """(max - min) / max of channels 0..1; 0 where the maximum is next to nothing."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(high > 1e-6, (high - low) / high).otherwise(0.0)


def posterize(v: Column, levels: int) -> Column:
    step = 256 // levels
    return (F.floor(v / step) * step).cast("int")


def hex_to_rgb(c: Column) -> Column:
    bare = F.regexp_replace(c, "^#", "")
    return F.array(*(F.conv(F.substring(bare, i, 2), 16, 10).cast("int") for i in (1, 3, 5)))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0") for x in (r, g, b)))


# sRGB to XYZ matrix and the D65 white point.
_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
_WHITE = (0.95047, 1.0, 1.08883)


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """struct<L, a, b> of channels 0..255 (D65; L 0..100)."""
    linear = []
    for v in (r / 255, g / 255, b / 255):
        linear.append(F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92))
    f = []
    for row, white in zip(_XYZ, _WHITE, strict=True):
        t = sum(k * v for k, v in zip(row, linear, strict=True)) / white
        f.append(F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0))
    return F.struct((116 * f[1] - 16).alias("L"), (500 * (f[0] - f[1])).alias("a"), (200 * (f[1] - f[2])).alias("b"))


def lab_to_bytes(lab: Column) -> Column:
    """The 8-bit scale: L * 255 / 100, a and b + 128."""
    return F.struct((lab["L"] * 255 / 100).alias("L"), (lab["a"] + 128).alias("a"), (lab["b"] + 128).alias("b"))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays (ΔE76 for Lab triples)."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda acc, v: acc + v))


def polygon_area(points: Column) -> Column:
    """Signed area (shoelace) of array<struct<x, y>>."""
    turned = F.concat(F.slice(points, F.lit(2), F.size(points)), F.slice(points, 1, 1))
    return F.aggregate(F.zip_with(points, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda acc, v: acc + v) / 2


def chaikin(points: Column) -> Column:
    """One corner-cutting step of a closed polygon: each edge gives its points at a quarter and at three quarters."""
    turned = F.concat(F.slice(points, F.lit(2), F.size(points)), F.slice(points, 1, 1))
    at = lambda p, q, t: F.named_struct(F.lit("x"), (1 - t) * p["x"] + t * q["x"], F.lit("y"), (1 - t) * p["y"] + t * q["y"])
    return F.flatten(F.zip_with(points, turned, lambda p, q: F.array(at(p, q, 0.25), at(p, q, 0.75))))


def hue_palette(n: Column) -> Column:
    """array<int>: n hues (0..179), equally far apart."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.pmod(F.floor(i * 180 / n), F.lit(180)).cast("int"))


def _once(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def lab_to_rgb(lab: Column, cut: bool = False) -> Column:
    """struct<r, g, b> (0..255, clamped, rounded or cut down) of struct<L, a, b>: the inverse of rgb_to_lab."""
    named = lambda **c: F.named_struct(*(x for k, v in c.items() for x in (F.lit(k), v)))
    unfold = lambda f, white: F.when(f * f * f > 0.008856, f * f * f).otherwise((f - 16.0 / 116.0) / 7.787) * white

    def channel(v: Column) -> Column:
        encoded = F.when(v > 0.0031308, 1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * v)
        return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(encoded * 255) if cut else F.round(encoded * 255))).cast("int")

    def mixed(xyz: Column) -> Column:
        return named(**{n: _once(sum(k * xyz[c] for k, c in zip(row, "xyz", strict=True)), channel) for n, row in zip("rgb", inverse(_XYZ), strict=True)})

    folded = lambda c: named(x=(c["L"] + 16) / 116 + c["a"] / 500, y=(c["L"] + 16) / 116, z=(c["L"] + 16) / 116 - c["b"] / 200)
    return _once(_once(_once(lab, folded), lambda f: named(**{c: unfold(f[c], w) for c, w in zip("xyz", _WHITE, strict=True)})), mixed)


def lab_hex(lab: Column) -> Column:
    """#RRGGBB of a Lab colour, channels cut down to whole numbers."""
    return _once(lab_to_rgb(lab, cut=True), lambda c: F.upper(rgb_to_hex(c["r"], c["g"], c["b"])))


def inverse(m: tuple) -> list[list[float]]:
    """The inverse of a 3 x 3 matrix by its cofactors."""
    minor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    det = sum(m[0][j] * minor(0, j) for j in range(3))
    return [[minor(j, i) / det for j in range(3)] for i in range(3)]


# Saturation and value (0..255) of the palette schemes; others are as rainbow.
SCHEMES = {"rainbow": (200, 230), "pastel": (80, 240), "vibrant": (220, 200), "soft": (120, 220)}


def hue_to_rgb(hue: Column, saturation: int, value: int) -> Column:
    """array<int> red, green, blue of a hue (0..179, two degrees each) with saturation and value of 0..255, rounded."""
    channel = lambda n: F.pmod(n + hue / 30.0, F.lit(6.0))
    level = lambda k: value - value * saturation / 255.0 * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))
    return F.array(*(F.round(level(channel(F.lit(float(n))))).cast("int") for n in (5, 3, 1)))


def auto_palette(n: Column, scheme: str = "rainbow") -> Column:
    """array<array<int>>: n colours whose hues are equally far apart; none if n is not positive."""
    s, v = SCHEMES.get(scheme, SCHEMES["rainbow"])
    return F.when(n > 0, F.transform(hue_palette(n), lambda h: hue_to_rgb(h, s, v))).otherwise(F.array().cast("array<array<int>>"))
