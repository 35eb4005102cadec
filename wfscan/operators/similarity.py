"""Code similarity by MinHash: normalise, renumber identifiers, shingle, sign, band, verify, and average by package.

All but the renumbering is native. The signature is 80 minima over a generated column; candidates meet by an equi-join on (band, key).
Identical signatures are collapsed to one row first, so a group of copies of any size is one entry in every band. Signatures that agree
in `least` of their hashes must share a number of whole bands, whatever positions differ; so only the rarest bands of each need be
looked up, as many as leave no pair out, and a band that very many signatures have is looked up by hardly any.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wfscan.session import checkpoint, spread

K, HASHES, BANDS, ROWS, LEAST = 5, 80, 20, 4, 0.9
# Words of the language that aren't identifiers, tokens, and the constants of the hash family.
KEYWORDS = [
    "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "enum", "export", "extends", "false",
    "finally", "for", "function", "if", "import", "in", "instanceof", "new", "null", "return", "super", "switch", "this", "throw", "true", "try",
    "typeof", "var", "let", "void", "while", "with", "yield", "async", "await",
]
TOKEN = r"[A-Za-z_$][A-Za-z0-9_$]*|==|===|!=|!==|<=|>=|=>|&&|\|\||[{}()\[\];,\.<>+\-*/%&|^!~?:=]"
A0, A1, B0, B1, PRIME = 1103515245, 12345, 12345, 67890, 2**31 - 1


def normalised(code: Column) -> Column:
    """Without comments, with strings and numbers as words; line comments go first, so an address in a string loses its end."""
    t = F.regexp_replace(code, r"//[^\n]*", "")
    t = F.regexp_replace(t, r"/\*[\s\S]*?\*/", "")
    t = F.regexp_replace(t, "\"[^\"]*\"|'[^']*'|`[^`]*`", " STR ")
    t = F.regexp_replace(t, r"(?<![0-9A-Za-z_])\d+(\.\d+)?(?![0-9A-Za-z_])", " NUM ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


_NOT_NAMES = frozenset(KEYWORDS)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _renumbered(rows: pd.Series) -> pd.Series:
    def one(toks):
        if toks is None:
            return None
        seen: dict[str, dict[str, str]] = {"VAR_": {}, "FUNC_": {}}
        out, before = [], None
        for t in toks:
            if (t[0].isalpha() or t[0] in "_$") and t not in _NOT_NAMES:
                kind = "FUNC_" if before == "function" else "VAR_"
                names = seen[kind]
                out.append(names.get(t) or names.setdefault(t, f"{kind}{len(names) + 1}"))
            else:
                out.append(t)
            before = t
        return out

    return rows.map(one)


def with_renumbered(df: DataFrame, toks: str, out: str) -> DataFrame:
    """Identifiers replaced by their number of first occurrence, those after 'function' in a row of their own.

    An Arrow function: as nested array expressions the names would be searched anew for each token.
    """
    return df.withColumn(out, _renumbered(F.col(toks)))


def shingles(toks: Column, k: int = K) -> Column:
    n = F.size(toks)
    return F.when(n >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(toks, i, k), " ")))).otherwise(F.array().cast("array<string>"))


def crc_hash(s: Column) -> Column:
    return F.crc32(F.encode(s, "UTF-8"))


def md5_hash(s: Column) -> Column:
    """A base hash that other engines have too: the first eight hex digits of md5."""
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def signatures(files: DataFrame, keep: list[str], code: str = "code", base=crc_hash, hashes: int = HASHES) -> DataFrame:
    """keep, n_shingles, signature: files with at least one shingle."""
    f = spread(files.where(F.col(code).isNotNull()).select(*keep, code)).select(*keep, tokens(normalised(F.col(code))).alias("_t"))
    f = with_renumbered(f, "_t", "_r").select(*keep, shingles(F.col("_r")).alias("_s")).where(F.size("_s") > 0)
    e = f.select(*keep, F.size("_s").alias("n_shingles"), F.explode(F.transform("_s", base)).alias("_h"))
    minima = [F.min((F.lit(A0 + i * A1).cast("bigint") * F.col("_h") + F.lit(B0 + i * B1).cast("bigint")) % PRIME).alias(f"_{i}") for i in range(hashes)]
    g = e.groupBy(*keep, "n_shingles").agg(*minima)
    return g.select(*keep, "n_shingles", F.array(*[F.col(f"_{i}") for i in range(hashes)]).alias("signature"))


def agreement(a: Column, b: Column, hashes: int = HASHES) -> Column:
    return F.round(F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / hashes, 4)


HOT_BAND, BROADCAST_ROWS = 1000, 1_000_000  # signatures that make a band count as common; rows of a table that is still broadcast


def looked_up(least: float, hashes: int = HASHES, bands: int = BANDS) -> int:
    """How many bands of each signature suffice to meet every partner: agreeing ones differ in at most so many bands."""
    differ = math.floor((1 - least) * hashes + 1e-9)
    return min(bands, differ + 1)


def similar_signatures(sigs: DataFrame, id_col: str, least: float = LEAST, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of every file, and (rep_a, rep_b, similarity) between different signatures that meet in a band."""
    reps = sigs.groupBy("signature").agg(F.min(id_col).alias("rep"))
    members = sigs.select(id_col, "signature").join(reps, "signature").select(id_col, "rep")
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(F.slice("signature", b * rows + 1, rows))))
    b = reps.select("rep", band.alias("band", "key"))
    few = looked_up(least, bands * rows, bands)
    if few < bands:
        common = b.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_BAND)
        common = checkpoint(common)
        if (count := common.count()) > 0:
            known = b.join(F.broadcast(common) if count <= BROADCAST_ROWS else common, ["band", "key"], "left")
            rare = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "band", "key"))), 1, few)  # one entry a band
            b = known.groupBy("rep").agg(rare.alias("x")).select("rep", F.explode("x").alias("x")).select("rep", "x.band", "x.key")
    x, y = b.select("band", "key", F.col("rep").alias("rep_a")), b.select("band", "key", F.col("rep").alias("rep_b"))
    c = x.join(y, ["band", "key"]).where("rep_a < rep_b").select("rep_a", "rep_b").distinct()
    v = c.join(reps.select(F.col("rep").alias("rep_a"), F.col("signature").alias("sa")), "rep_a").join(reps.select(F.col("rep").alias("rep_b"), F.col("signature").alias("sb")), "rep_b")
    return members, v.select("rep_a", "rep_b", agreement(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= least)


def package_pairs(members: DataFrame, links: DataFrame, files: DataFrame, id_col: str, package: str, least: float = 0.5) -> DataFrame:
    """(pkg_a, pkg_b, avg_sim, num_file_pairs): packages by their similar files, counted by signature and not pair by pair."""
    sizes = members.join(files.select(id_col, package), id_col).groupBy("rep", package).agg(F.count("*").alias("m"))
    same = sizes.select("rep", F.col(package).alias("p"), F.col("m").alias("mp")).join(sizes.select("rep", F.col(package).alias("q"), F.col("m").alias("mq")), "rep").where("p < q").select("p", "q", F.lit(1.0).alias("sim"), (F.col("mp") * F.col("mq")).alias("n"))
    left = sizes.select(F.col("rep").alias("rep_a"), F.col(package).alias("p"), F.col("m").alias("mp"))
    right = sizes.select(F.col("rep").alias("rep_b"), F.col(package).alias("q"), F.col("m").alias("mq"))
    other = links.join(left, "rep_a").join(right, "rep_b").where("p <> q").select("p", "q", F.col("similarity").alias("sim"), (F.col("mp") * F.col("mq")).alias("n"))
    g = same.unionByName(other).groupBy(F.least("p", "q").alias("pkg_a"), F.greatest("p", "q").alias("pkg_b")).agg((F.sum(F.col("sim") * F.col("n")) / F.sum("n")).alias("s"), F.sum("n").alias("num_file_pairs"))
    return g.select("pkg_a", "pkg_b", F.round("s", 4).alias("avg_sim"), "num_file_pairs").where(F.col("avg_sim") >= least)


def top_pairs(pairs: DataFrame, least: float, most: int | None = None) -> DataFrame:
    p = pairs.where(F.col("avg_sim").try_cast("double") >= least).orderBy(F.desc("avg_sim"), "pkg_a", "pkg_b")
    return p.limit(most) if most else p
