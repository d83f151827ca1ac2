"""Vector expressions and the built-in feature-hashing embedder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.text import once, words


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """Row divided by its length; a zero row stays zero."""
    return once(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0)))


def cosine_to_01(ip: Column) -> Column:
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ip)) + 1) / 2


def cosine_from_l2(d: Column) -> Column:
    """The larger reading of a distance as itself or as its square; negative or null gives 0."""
    read = lambda q: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - q / 2))
    return F.when(d >= 0, F.greatest(read(d * d), read(d))).otherwise(0.0)


def hash_embed(text: Column, dims: int) -> Column:
    """Unit vector of word counts hashed into ``dims`` places (first 32 bits of each word's MD5)."""
    place = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dims
    counts = once(F.transform(words(F.lower(text)), place), lambda at: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(at, lambda p: p == i)).cast("double")))
    return normalize(counts)
