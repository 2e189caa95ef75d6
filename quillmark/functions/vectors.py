"""Expressions over array columns of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(a: Column, b: Column) -> Column:
    """VP1."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """VP2: length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """VP15."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def closer(first: Column, second: Column, equal: float = 0.0) -> Column:
    """VP15: 0 if the first score is higher, 1 if the second, -1 if they are within ``equal``."""
    return F.when(F.abs(first - second) <= equal, -1).when(first > second, 0).otherwise(1)


def discounted(rewards: Column, gamma: float) -> Column:
    """WN2: the last reward weighs 1, each before it gamma times the next."""
    return F.aggregate(rewards, F.lit(0.0), lambda s, x: s * gamma + x)


def segment(series: Column, start: Column, size: int) -> Column:
    """WN3: ``size`` elements from a 0-based start."""
    return F.slice(series, start + 1, size)


def joined(*vectors: Column) -> Column:
    """VP14, WN4."""
    return F.concat(*vectors)


def cropped(image: Column, top: int, bottom: int, left: int, right: int) -> Column:
    """PF12: rows top..bottom-1 of an image (rows of pixels), and of each the pixels left..right-1."""
    return F.transform(F.slice(image, top + 1, bottom - top), lambda r: F.slice(r, left + 1, right - left))


def upside_down(image: Column) -> Column:
    """PF12."""
    return F.reverse(image)


def every_nth(series: Column, n: int) -> Column:
    """PF12: elements 0, n, 2n, ..."""
    return F.filter(series, lambda x, i: i % n == 0)


def around_colour(image: Column, rgb: tuple[int, int, int], up: int, down: int, left: int, right: int) -> Column:
    """PF16: the image around the mean place of pixels (r, g, b) of exactly this colour; null where there is none."""
    hit = lambda p: (p["r"] == rgb[0]) & (p["g"] == rgb[1]) & (p["b"] == rgb[2])
    places = F.flatten(F.transform(image, lambda row, y: F.filter(F.transform(row, lambda p, x: F.when(hit(p), F.struct(y.alias("y"), x.alias("x")))), lambda c: c.isNotNull())))
    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  an expression is made anew wherever it stands
    middle = lambda found, axis: F.floor(F.try_divide(F.aggregate(found, F.lit(0.0), lambda s, p: s + p[axis]), F.size(found))).cast("int").alias(axis)

    def cut(at: Column) -> Column:
        rows = F.slice(image, F.greatest(at.y - up, F.lit(0)) + 1, F.least(at.y, F.lit(up)) + down)
        return F.when(at.y.isNotNull(), F.transform(rows, lambda r: F.slice(r, F.greatest(at.x - left, F.lit(0)) + 1, F.least(at.x, F.lit(left)) + right)))

    return once(once(places, lambda found: F.struct(middle(found, "y"), middle(found, "x"))), cut)


def blanked(image: Column, low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    """PF16: pixels outside the colour bounds become 0."""
    inside = lambda p: p["r"].between(low[0], high[0]) & p["g"].between(low[1], high[1]) & p["b"].between(low[2], high[2])
    nought = F.struct(*[F.lit(0).alias(c) for c in "rgb"])
    return F.transform(image, lambda row: F.transform(row, lambda p: F.when(inside(p), p).otherwise(nought)))


def fields(observation: Column, sizes: dict[str, int]) -> Column:
    """PF15: a struct of the named parts of an observation, in order; it fails where they are not the whole of it."""
    at, parts = 1, []
    for name, n in sizes.items():
        parts.append(F.slice(observation, at, n).alias(name))
        at += n
    whole = F.assert_true(F.size(observation) == at - 1, F.lit("observation not fully parsed"))
    return F.when(whole.isNull(), F.struct(*parts))
