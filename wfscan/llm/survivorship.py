"""Problem 2: the best representative of each group of duplicate records, built field by field.

One aggregation finds every survivor: for each field the maximum of a composite struct (whether there is a value, priority of the
source, time, what breaks ties, value). Maxima combine on the map side, so a key with a third of all rows costs one row per map task
and nothing is collected per group. Structs have no place in a hash aggregation's buffer, so partial maxima are taken over sorted
runs; one shuffle moves them. What fields a record fills, and which priority it has, are parameters of one operator: whole best
records (`duplicate_groups`) are the case where the field is the record's id.

Results: rows without a key belong to no group; nulls, blanks and the words for 'none' never win over a value and survive only as
null; repeated rows change nothing but n_records; ties end at the smaller record_id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the registry writes where it has nothing, and how far each source is trusted (higher first).
MISSING = ("", "-", "n/a", "na", "none", "null", "unknown", "latest")
SOURCE_TRUST = {"official_registry": 3, "npm": 2, "github_topic": 1}
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_PLAIN = "".join(map(chr, range(0x21, 0x7F)))
_INVISIBLE = r"[\p{Cf}\p{Cc}]"
_SPACES = r"[\s\p{Z}]+"


def clean(c: Column) -> Column:
    """Text without invisible characters, with plain spaces, trimmed; null if it says that there is nothing."""
    t = F.trim(F.regexp_replace(F.regexp_replace(c, r"\p{Cf}", ""), _SPACES, " "))
    return F.when(F.lower(t).isin(*MISSING), None).otherwise(t)


def name_key(c: Column) -> Column:
    """The spelling-free form of a name: width, case, invisible characters, outer spaces and slashes don't count; all else does."""
    t = F.translate(F.regexp_replace(c, _INVISIBLE, ""), _WIDE, _PLAIN)
    t = F.regexp_replace(F.lower(t), r"^[\s\p{Z}/]+|[\s\p{Z}/]+$", "")
    return F.when(t.isin("", "-", "n/a", "none", "null", "unknown"), None).otherwise(t)


def instant(c: Column) -> Column:
    """A time in any of the registry's notations as microseconds since 1970; without a zone it is UTC; null if unreadable."""
    t = F.trim(c)
    t = F.regexp_replace(t, r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})", "$1-$2-$3")
    t = F.regexp_replace(t, r"(?i)\s*(utc|gmt|z)$", "Z")
    zoned = F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & ~t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).otherwise(F.concat(t, F.lit("Z")))
    mail = F.regexp_extract(t, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(?::\d{2})?.*)$", 1)
    return F.coalesce(
        F.when(t.rlike(r"^\d{9,15}$"), t.try_cast("bigint") * 1000),
        F.unix_micros(F.when(t.rlike(r"^\d{4}-"), F.try_to_timestamp(zoned))),
        F.unix_micros(F.when(mail != "", F.try_to_timestamp(F.regexp_replace(mail, "Z$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")))),
    )


def version_number(c: Column) -> Column:
    """A version as array<bigint> of four numbers and a last one that puts releases above pre-releases; null without a number."""
    t = F.regexp_replace(F.trim(F.translate(F.regexp_replace(c, _INVISIBLE, ""), _WIDE, _PLAIN)), r"^[vV]\.?\s*|[\s\p{Z}]+$", "")
    t = F.regexp_replace(t, r"^[\s\p{Z}]+", "")
    ok = t.rlike(r"^\d{1,15}(\.\d{1,15})*([-+].*)?$")
    parts = F.transform(F.split(F.regexp_extract(t, r"^([\d.]+)", 1), r"\."), lambda x: x.cast("bigint"))
    last = F.array(F.when(t.rlike(r"^[\d.]+-"), F.lit(0)).otherwise(F.lit(1)).cast("bigint"))
    padded = F.concat(F.slice(F.concat(parts, F.array(*[F.lit(0).cast("bigint")] * 4)), 1, 4), last)
    return F.when(ok, padded)


def survive(df: DataFrame, key: Column, record_id: Column, fields: Mapping[str, Column], priority: Column, time: Column, ties: Sequence[Column] = ()) -> DataFrame:
    """(group_id, n_records, the fields): one row per key, each field with its best value.

    The best value of a field is that of the record with a value that isn't null, the highest priority, the latest time, the greatest
    ties in their order (nulls are least throughout) and the smallest id.
    """
    kept = {f"_v{i}": c for i, c in enumerate(fields.values())}
    rank = F.struct(F.coalesce(priority.cast("int"), F.lit(0)).alias("priority"), time.alias("time"), *[t.alias(f"tie{i}") for i, t in enumerate(ties)], (-record_id).alias("minus_id"))
    r = df.select(key.alias("_k"), record_id.alias("_id"), rank.alias("_rank"), *[c.alias(v) for v, c in kept.items()]).where("_k is not null and _id is not null")
    best = [F.max(F.struct(F.col(v).isNotNull().alias("there"), F.col("_rank").alias("rank"), F.col(v).alias("value"))).alias(v) for v in kept]
    g = r.groupBy("_k").agg(F.min("_id").alias("group_id"), F.count("*").alias("n_records"), *best)
    return g.select("group_id", "n_records", *[F.col(v)["value"].alias(f) for v, f in zip(kept, fields, strict=True)])


def duplicate_groups(df: DataFrame) -> DataFrame:
    """(group_id, record_id, version_record_id, n_records): one row per key with two or more records: the best of them, and the best with a version.

    Priority is the flag of the latest; then come the time of the update and the version number.
    """
    id_, version = F.col("record_id").cast("bigint"), version_number(F.col("version"))
    fields = {"record_id": id_, "version_record_id": F.when(version.isNotNull(), id_)}
    return survive(df, name_key(F.col("full_name")), id_, fields, F.col("is_latest"), instant(F.col("updated_at")), [version]).where("n_records >= 2").select("group_id", "record_id", "version_record_id", "n_records")


def source_priority(source: Column, trust: Mapping[str, int] = SOURCE_TRUST) -> Column:
    return F.coalesce(*[F.when(source == s, F.lit(t)) for s, t in trust.items()], F.lit(0))


def survivors(df: DataFrame, attributes: Sequence[str], trust: Mapping[str, int] = SOURCE_TRUST) -> DataFrame:
    """One built record per key: each attribute takes the best value that isn't blank, by trust in the source, time, flag and id.

    Columns: group_id, n_records, n_filled and the attributes. Keys with one record give that record, cleaned.
    """
    kinds = dict(df.dtypes)
    fields = {}
    for a in attributes:
        v = clean(F.col(a)) if kinds[a] == "string" else F.when(F.size(a) > 0, F.array_join(F.array_sort(a), ",")) if kinds[a].startswith("array") else F.col(a)
        fields[a] = F.when(version_number(F.col(a)).isNotNull(), v) if a == "version" else v
    g = survive(df, name_key(F.col("full_name")), F.col("record_id").cast("bigint"), fields, source_priority(F.col("source"), trust), instant(F.col("updated_at")), [F.coalesce(F.col("is_latest"), F.lit(False))])
    filled = sum((F.col(a).isNotNull().cast("int") for a in attributes), F.lit(0))
    return g.select("group_id", "n_records", filled.alias("n_filled"), *attributes)
