"""Vector columns over array<float> (C3, C4, A16 helpers)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays zero."""
    length = norm(a)
    return F.transform(a, lambda x: F.when(length == 0, F.lit(0.0)).otherwise(x.cast("double") / length))


def cosine(a: Column, b: Column) -> Column:
    """0 when either vector has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / total)


def entity_set(people: Column, organizations: Column, locations: Column) -> Column:
    """Typed, lower-cased names as one set of strings."""

    def typed(names, prefix):
        bare = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.trim(F.lower(n)))
        return F.transform(F.filter(bare, lambda n: n != ""), lambda n: F.concat(F.lit(prefix), n))

    return F.array_distinct(F.concat(typed(people, "person:"), typed(organizations, "org:"), typed(locations, "loc:")))
