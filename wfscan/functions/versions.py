"""Version texts: normal form, order, comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(v: Column) -> Column:
    """Without a leading v, build and pre-release parts; null if nothing is left."""
    t = F.regexp_replace(F.trim(v), "^[vV]", "")
    t = F.trim(F.substring_index(F.substring_index(t, "+", 1), "-", 1))
    return F.when(t != "", t)


def triplet(v: Column) -> Column:
    """struct<major,minor,patch> of the normal form; a part that isn't a number counts as 0, null if none is."""
    parts = F.split(normal(v), r"\.")
    n = [F.get(parts, F.lit(i)).try_cast("int") for i in range(3)]
    return F.when(F.coalesce(*n).isNotNull(), F.struct(*[F.coalesce(x, F.lit(0)).alias(k) for x, k in zip(n, ("major", "minor", "patch"), strict=True)]))


def compare(registry: Column, source: Column) -> Column:
    """How a registry version stands to the one in the source: equal, newer on a side, missing, or unparsable."""
    a, b = triplet(registry), triplet(source)
    return (
        F.when(normal(registry).isNull(), "missing_npm_version")
        .when(normal(source).isNull(), "missing_github_version")
        .when(normal(registry) == normal(source), "equal")
        .when(a.isNull() | b.isNull(), "unparsable")
        .when(a == b, "equal")
        .when(a > b, "npm_newer")
        .otherwise("github_newer")
    )


def consistency(a: Column, b: Column) -> Column:
    return F.when(normal(a).isNull() | normal(b).isNull(), "unknown").when(normal(a) == normal(b), "match").otherwise("mismatch")


def sort_key(v: Column) -> Column:
    """Numbers of a version in order, padded to three: sorts as versions do."""
    n = F.transform(F.filter(F.split(v, "[^0-9]+"), lambda x: x != ""), lambda x: x.try_cast("bigint"))
    return F.slice(F.concat(n, F.array(*[F.lit(0).cast("bigint")] * 3)), 1, 3)
