"""Code similarity by MinHash over whole files."""

from __future__ import annotations

from pyspark.sql import functions as F

from wfscan.operators import similarity as sim
from wfscan.plans.registry import query, text
from wfscan.session import checkpoint, table

_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(code, '//[^\n]*', '', 'g'), '/\*(?s:.*?)\*/', '', 'g'), '"[^"]*"|''[^'']*''|`[^`]*`', ' STR ', 'g'), '\b\d+(\.\d+)?\b', ' NUM ', 'g'), '\s+', ' ', 'g'))"""
_TOKENS = f"SELECT file_id, regexp_extract_all({_NORM}, {text(sim.TOKEN)}) AS toks FROM source_files WHERE code IS NOT NULL"


def _tokens(spark, d):
    f = table(spark, d, "source_files").where("code is not null")
    return f.select("file_id", "npm_name", sim.tokens(sim.normalised(F.col("code"))).alias("toks"))


@query(f"SELECT file_id, md5(array_to_string(toks, ' ')) AS digest, CAST(len(toks) AS INT) AS n FROM ({_TOKENS})")
def code_tokens(spark, d):
    return _tokens(spark, d).select("file_id", F.md5(F.array_join("toks", " ")).alias("digest"), F.size("toks").alias("n"))


_WORDS = "[" + ", ".join(text(k) for k in sim.KEYWORDS) + "]"
_RENAMED = f"""WITH t AS ({_TOKENS}), e AS (SELECT file_id, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS i FROM t),
    p AS (SELECT *, lag(tok) OVER (PARTITION BY file_id ORDER BY i) AS prev, regexp_matches(tok, '^[A-Za-z_$]') AND NOT list_contains({_WORDS}, tok) AS ident FROM e),
    c AS (SELECT *, CASE WHEN ident AND prev = 'function' THEN 'FUNC_' WHEN ident THEN 'VAR_' END AS kind FROM p),
    o AS (SELECT file_id, kind, tok, min(i) AS i FROM c WHERE kind IS NOT NULL GROUP BY file_id, kind, tok),
    f AS (SELECT file_id, kind, tok, row_number() OVER (PARTITION BY file_id, kind ORDER BY i) AS no FROM o),
    r AS (SELECT c.file_id, i, coalesce(c.kind || no, c.tok) AS x FROM c LEFT JOIN f ON c.file_id = f.file_id AND c.kind = f.kind AND c.tok = f.tok),
    a AS (SELECT file_id, list(x ORDER BY i) AS xs FROM r GROUP BY file_id)"""


@query(f"{_RENAMED} SELECT file_id, md5(array_to_string(xs, ' ')) AS digest FROM a")
def identifier_renumber(spark, d):
    t = sim.with_renumbered(_tokens(spark, d).where(F.size("toks") > 0), "toks", "xs")
    return t.select("file_id", F.md5(F.array_join("xs", " ")).alias("digest"))


_SHINGLES = f"{_RENAMED}, s AS (SELECT DISTINCT file_id, array_to_string(xs[i:i + 4], ' ') AS sh FROM (SELECT file_id, xs, unnest(range(1, len(xs) - 3)) AS i FROM a))"


@query(f"{_SHINGLES} SELECT file_id, count(*) AS shingles FROM s GROUP BY file_id")
def shingle_counts(spark, d):
    t = sim.with_renumbered(_tokens(spark, d), "toks", "xs")
    return t.select("file_id", F.size(sim.shingles(F.col("xs"))).cast("bigint").alias("shingles")).where("shingles > 0")


# crc32 from its polynomial, and the family of 80 hashes over it; fixed values: polynomial, factors and prime.
_CRC = """crc_t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda r, x: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS tab),
    crc_s AS (SELECT sh, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(sh) + 1), lambda i: CAST(ascii(sh[i]) AS BIGINT))), lambda r, x: xor(r >> 8, tab[(xor(r, x) & 255) + 1])), 4294967295) AS crc FROM (SELECT DISTINCT sh FROM s), crc_t),"""
_SIGNED = "b AS (SELECT s.*, crc FROM s JOIN crc_s ON s.sh = crc_s.sh), m AS (SELECT file_id, [" + ", ".join(f"min(({1103515245 + 12345 * i} * crc + {12345 + 67890 * i}) % 2147483647)" for i in range(80)) + "] AS sig FROM b GROUP BY file_id)"


def _signatures(table_name: str) -> str:
    return _SHINGLES.replace("FROM source_files", f"FROM {table_name}") + ", " + _CRC + " " + _SIGNED


@query(_signatures("source_files") + " SELECT file_id, array_to_string(sig, ',') AS signature FROM m")
def minhash_signature(spark, d):
    """All 80 hashes of every file."""
    s = sim.signatures(table(spark, d, "source_files"), ["file_id"])
    return s.select("file_id", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


_BANDED = """, pp AS (SELECT min(file_id) AS rep, sig FROM m GROUP BY sig), q AS (SELECT rep, sig, unnest(range(20)) AS band FROM pp), k AS (SELECT rep, band, array_to_string(sig[band * 4 + 1:band * 4 + 4], ',') AS key FROM q),
    z AS (SELECT DISTINCT x.rep AS rep_a, y.rep AS rep_b FROM k x JOIN k y ON x.band = y.band AND x.key = y.key AND x.rep < y.rep),
    v AS (SELECT rep_a, rep_b, round(len(list_filter(range(1, 81), lambda i: a.sig[i] = b.sig[i])) / 80.0, 4) AS similarity FROM z JOIN pp a ON a.rep = rep_a JOIN pp b ON b.rep = rep_b)"""


def _signed(spark, d, name="server_files", package="server_name"):
    return checkpoint(sim.signatures(table(spark, d, name), ["file_id", package]))


_SNIPPETS = "(SELECT finding_id AS file_id, code_snippet AS code FROM scan_findings)"


@query(_signatures(_SNIPPETS) + _BANDED + " SELECT rep_a, rep_b, CAST(similarity AS DOUBLE) AS similarity FROM v WHERE similarity >= 0.9")
def minhash_pairs(spark, d):
    """Similar signatures between classes of equal ones; 80 hashes in 20 bands."""
    return _snippet_pairs(spark, d, 0.9)


@query(_signatures(_SNIPPETS) + _BANDED + " SELECT rep_a, rep_b, CAST(similarity AS DOUBLE) AS similarity FROM v WHERE similarity >= 0.5")
def minhash_pairs_loose(spark, d):
    """The same down to a half, where pairs meet by chance of a band."""
    return _snippet_pairs(spark, d, 0.5)


def _snippet_pairs(spark, d, least):
    snippets = table(spark, d, "scan_findings").select(F.col("finding_id").alias("file_id"), F.col("code_snippet").alias("code"))
    return sim.similar_signatures(checkpoint(sim.signatures(snippets, ["file_id"])), "file_id", least)[1]


@query(_signatures("server_files") + _BANDED + " SELECT file_id, rep FROM m JOIN pp ON m.sig = pp.sig")
def minhash_classes(spark, d):
    return sim.similar_signatures(_signed(spark, d), "file_id")[0]


@query(
    _signatures("server_files")
    + _BANDED
    + """, ff AS (SELECT m.file_id, rep, server_name FROM m JOIN pp ON m.sig = pp.sig JOIN server_files USING (file_id)), l AS (SELECT rep_a, rep_b, similarity FROM v WHERE similarity >= 0.9 UNION ALL SELECT rep_b, rep_a, similarity FROM v WHERE similarity >= 0.9 UNION ALL SELECT rep, rep, 1.0 FROM pp),
    g AS (SELECT a.server_name AS pkg_a, b.server_name AS pkg_b, similarity FROM l JOIN ff a ON a.rep = rep_a JOIN ff b ON b.rep = rep_b WHERE a.server_name < b.server_name)
    SELECT pkg_a, pkg_b, CAST(round(avg(similarity), 4) AS DOUBLE) AS avg_sim, count(*) AS num_file_pairs FROM g GROUP BY pkg_a, pkg_b HAVING round(avg(similarity), 4) >= 0.5"""
)
def similar_packages(spark, d):
    s = _signed(spark, d)
    members, links = sim.similar_signatures(s, "file_id")
    return sim.top_pairs(sim.package_pairs(members, links, s, "file_id", "server_name"), 0.5)
