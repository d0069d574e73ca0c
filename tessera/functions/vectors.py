"""Column expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points that cut the standard normal distribution into equal parts, by number of symbols.
BREAKPOINTS = {3: [-0.4307, 0.4307], 4: [-0.6745, 0.0, 0.6745], 5: [-0.8416, -0.2533, 0.2533, 0.8416], 6: [-0.9674, -0.4307, 0.0, 0.4307, 0.9674]}


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def projection(a: Column) -> Column:
    """The length of a vector's projection on the diagonal."""
    return total(a) / F.sqrt(F.size(a).cast("double"))


def paa(xs: Column, size: int, parts: int) -> Column:
    """Means of `parts` equal segments of `size` values."""
    width = size // parts
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: total(F.slice(xs, i * width + 1, width)) / width)


def symbol(z: Column, n: int) -> Column:
    """The SAX symbol of a normalised value, from 0."""
    out = F.lit(0)
    for b in BREAKPOINTS[n]:
        out = out + (z >= b).cast("int")
    return out


def lower_bound(q: Column, c: Column, size: int, radius: int) -> Column:
    """LB_Keogh: squared distances of c's points from the envelope of q within `radius`."""

    def at(i: Column) -> Column:
        a = F.greatest(i - radius, F.lit(0))
        near = F.slice(q, a + 1, F.least(i + radius, F.lit(size - 1)) - a + 1)
        x, low, high = F.get(c, i), F.array_min(near), F.array_max(near)
        return F.when(x > high, (x - high) * (x - high)).when(x < low, (low - x) * (low - x)).otherwise(F.lit(0.0))

    return total(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at))
