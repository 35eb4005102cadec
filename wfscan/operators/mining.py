"""Forum mining: cleaned texts, weighted security patterns, TF-IDF terms, trends."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wfscan.functions.text import clean_html, contains_any, useful_tokens
from wfscan.session import checkpoint

# Label, weight and pattern of the security topics; words that mark a tool-protocol topic.
SECURITY = (
    ("Code Exec / Eval", 5, r"\beval\(|new\s+function\(|setTimeout\(\s*['\"].+\)"),
    ("ENV / FS Exposure", 4, r"\bprocess\.env\b|\.env|fs\.(read|write|append|mkd)ir|permission denied"),
    ("SSRF / Outbound", 4, r"\bssrf\b|unvalidated url|open redirect|http request node"),
    ("Secrets Leak", 5, r"(api[_-]?key|secret|token|bearer)\s*(=|:)\s*[\w-]{12,}|hardcoded\s+(secret|credential)"),
    ("OAuth Misconfig", 3, r"\boauth(1|2)?\b|refresh token|invalid client|redirect uri|callback url"),
    ("TLS / Certificates", 3, r"\bssl\b|tls|self[- ]signed|certificate verify failed|insecure"),
    ("Proxy / Corp Net", 2, r"\bproxy\b|http_proxy|https_proxy|no_proxy"),
    ("Binary / Upload", 3, r"\bbinary\b|multipart|file upload|content[- ]type"),
    ("HTTP/Webhook", 3, r"{base}\.httpRequest|webhook node|trigger node"),
    ("Supply Chain", 4, r"\b(remote script|untrusted dependency|http import|load script)\b"),
    ("MCP Security", 6, r"\bmcp.*?(security|vulnerability|risk|threat|exploit|attack|breach|leak)"),
    ("MCP Privilege", 6, r"\bmcp.*?(privilege|permission|access|authorization|unauthorized|escalation)"),
    ("MCP API Abuse", 5, r"\bmcp.*?(api|network|system|file|memory).*?(abuse|misuse|unauthorized|unrestricted)"),
    ("MCP Data Tampering", 5, r"\bmcp.*?(tamper|modify|alter|manipulate|corrupt|inject)"),
    ("MCP Misinformation", 4, r"\bmcp.*?(misinformation|disinformation|fake|false|manipulate.*?data)"),
    ("MCP Instability", 3, r"\bmcp.*?(unstable|crash|error|fail|bug|issue|problem|broken)"),
    ("MCP Node Issue", 4, r"\b{platform}.*?mcp.*?(node|integration|connector|plugin)"),
)
TOOL_WORDS = ["mcp", "model context protocol", "modelcontextprotocol", "tool server"]


# What the platform and its basic package are called; parameters with the values of the tables at hand.
PLATFORM, BASE_PACKAGE = "flow", "flow-base"


def security_patterns(platform: str = PLATFORM, base_package: str = BASE_PACKAGE) -> list[tuple[str, int, str]]:
    """The table of topics with the platform's names put in; dashes of a package may be spaces."""
    base = "[- ]".join(map(re.escape, re.split("[- ]", base_package)))
    return [(label, w, rx.replace("{base}", base).replace("{platform}", re.escape(platform))) for label, w, rx in SECURITY]


def security_hits(text: Column, platform: str = PLATFORM, base_package: str = BASE_PACKAGE) -> Column:
    """array<struct<label,weight>>: the topics a text touches, in the order of the table."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + rx), F.struct(F.lit(label).alias("label"), F.lit(w).alias("weight"))) for label, w, rx in security_patterns(platform, base_package)]))


def scored(topics: DataFrame, key: list[str], title: str, text: str) -> DataFrame:
    """key, is_tool_related, sec_hits, sec_score."""
    t = F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    h = topics.select(*key, contains_any(t, TOOL_WORDS).alias("is_tool_related"), security_hits(t).alias("_h"))
    return h.select(*key, "is_tool_related", F.array_join(F.transform("_h", lambda x: x["label"]), "|").alias("sec_hits"), F.aggregate("_h", F.lit(0), lambda a, x: a + x["weight"]).alias("sec_score"))


def category_counts(scores: DataFrame) -> DataFrame:
    """(category, topics, tool_topics)."""
    x = scores.where("sec_hits <> ''").select("is_tool_related", F.explode(F.split("sec_hits", r"\|")).alias("category"))
    return x.groupBy("category").agg(F.count("*").alias("topics"), F.count_if("is_tool_related").alias("tool_topics"))


def ngrams(toks: Column, most: int = 3) -> Column:
    n = F.size(toks)
    none = F.array().cast("array<string>")

    def of(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(toks, i, k), " "))).otherwise(none)

    return F.flatten(F.array(*[of(k) for k in range(1, most + 1)]))


BROADCAST_TERMS = 500_000


def tfidf_terms(docs: DataFrame, key: str, toks: str, most: int = 30, min_df: int = 2, max_df: float = 0.6, upto: int = 3) -> DataFrame:
    """(term, df, score): terms by the sum of their length-normalised weights; rare and ubiquitous terms go before normalising.

    Counts are grouped before anything is joined; the documents' number is one row. The table of terms that remain is counted, and
    broadcast while it is small, so that the terms of documents aren't moved by term, where a common one is a hot key.
    """
    tf = docs.select(key, F.explode(ngrams(F.col(toks), upto)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    total = docs.agg(F.count("*").alias("total"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(total)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("total")))
    df = checkpoint(df)
    w = tf.join(F.broadcast(df) if df.count() <= BROADCAST_TERMS else df, "term").withColumn("w", F.col("tf") * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    g = w.join(norm, key).groupBy("term", "df").agg(F.sum(F.col("w") / F.col("norm")).alias("s"))
    return g.select("term", "df", F.round("s", 4).alias("score")).orderBy(F.desc("score"), "term").limit(most)


def trend(events: DataFrame, platform: str, ts: Column, grain: str = "MONTH") -> DataFrame:
    return events.where(ts.isNotNull()).groupBy(F.col(platform).alias("platform"), F.date_trunc(grain, ts).alias("period")).agg(F.count("*").alias("n"))


def cleaned(topics: DataFrame, key: list[str], text: str) -> DataFrame:
    return topics.select(*key, clean_html(F.col(text)).alias("clean")).withColumn("tokens", useful_tokens(F.col("clean")))
