"""Forum topics: cleaning, scores, trends, terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from wfscan.functions.text import STOP_WORDS
from wfscan.operators import mining
from wfscan.plans.registry import query, text, values
from wfscan.session import table

_LIST = "[" + ", ".join(text(w) for w in STOP_WORDS) + "]"
_CLEAN = r"""SELECT row_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(doc_text, ''), '<[^>]+>', ' ', 'g'), '(https?://|www\.)\S+', ' ', 'g'), '[0-9A-Za-z_.-]+@[0-9A-Za-z_.-]+\.[0-9A-Za-z_]+', ' ', 'g'), '[^0-9A-Za-z\x{4e00}-\x{9fff}_-]+', ' ', 'g'), '\s+', ' ', 'g'))) AS clean FROM topics_full"""
_TOKENS = f"SELECT row_id, list_filter(string_split(clean, ' '), lambda x: length(x) > 1 AND NOT regexp_matches(x, '^[0-9]+$') AND NOT list_contains({_LIST}, x)) AS toks FROM ({_CLEAN})"


def _topics(spark, d):
    return mining.cleaned(table(spark, d, "topics_full"), ["row_id"], "doc_text")


@query(_CLEAN)
def html_clean(spark, d):
    return _topics(spark, d).select("row_id", "clean")


@query(f"SELECT row_id, array_to_string(toks, ' ') AS words, CAST(len(toks) AS INT) AS n FROM ({_TOKENS})")
def stopword_tokens(spark, d):
    return _topics(spark, d).select("row_id", F.array_join("tokens", " ").alias("words"), F.size("tokens").alias("n"))


_GRAM = "list_transform(range(1, len(toks) - {k} + 2), lambda i: array_to_string(toks[i:i + {k} - 1], ' '))"


@query(
    f"""WITH t AS ({_TOKENS}), e AS (SELECT row_id, unnest(list_concat(list_concat({_GRAM.format(k=1)}, {_GRAM.format(k=2)}), {_GRAM.format(k=3)})) AS term FROM t),
    tf AS (SELECT row_id, term, count(*) AS tf FROM e GROUP BY ALL), n AS (SELECT count(*) AS total FROM t),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), k AS (SELECT term, df, total FROM df, n WHERE df >= 2 AND df <= 0.6 * total),
    w AS (SELECT row_id, term, df, tf * (ln((1 + total) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tf JOIN k USING (term)), m AS (SELECT row_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY row_id)
    SELECT term, df, round(sum(w / norm), 4) AS score FROM w JOIN m USING (row_id) GROUP BY term, df ORDER BY score DESC, term LIMIT 30"""
)
def tfidf_top_terms(spark, d):
    return mining.tfidf_terms(_topics(spark, d), "row_id", "tokens")


# The topics once more, as SQL sees them; fixed values.
_TOPICS = [
    ("Code Exec / Eval", 5, r"\beval\(|new\s+function\(|setTimeout\(\s*['\"].+\)"), ("ENV / FS Exposure", 4, r"\bprocess\.env\b|\.env|fs\.(read|write|append|mkd)ir|permission denied"), ("SSRF / Outbound", 4, r"\bssrf\b|unvalidated url|open redirect|http request node"),
    ("Secrets Leak", 5, r"(api[_-]?key|secret|token|bearer)\s*(=|:)\s*[\w-]{12,}|hardcoded\s+(secret|credential)"), ("OAuth Misconfig", 3, r"\boauth(1|2)?\b|refresh token|invalid client|redirect uri|callback url"), ("TLS / Certificates", 3, r"\bssl\b|tls|self[- ]signed|certificate verify failed|insecure"),
    ("Proxy / Corp Net", 2, r"\bproxy\b|http_proxy|https_proxy|no_proxy"), ("Binary / Upload", 3, r"\bbinary\b|multipart|file upload|content[- ]type"), ("HTTP/Webhook", 3, r"flow[- ]base\.httpRequest|webhook node|trigger node"), ("Supply Chain", 4, r"\b(remote script|untrusted dependency|http import|load script)\b"),
    ("MCP Security", 6, r"\bmcp.*?(security|vulnerability|risk|threat|exploit|attack|breach|leak)"), ("MCP Privilege", 6, r"\bmcp.*?(privilege|permission|access|authorization|unauthorized|escalation)"), ("MCP API Abuse", 5, r"\bmcp.*?(api|network|system|file|memory).*?(abuse|misuse|unauthorized|unrestricted)"),
    ("MCP Data Tampering", 5, r"\bmcp.*?(tamper|modify|alter|manipulate|corrupt|inject)"), ("MCP Misinformation", 4, r"\bmcp.*?(misinformation|disinformation|fake|false|manipulate.*?data)"), ("MCP Instability", 3, r"\bmcp.*?(unstable|crash|error|fail|bug|issue|problem|broken)"), ("MCP Node Issue", 4, r"\bflow.*?mcp.*?(node|integration|connector|plugin)"),
]
_SEC = values([(i, label, w, "(?i)" + rx) for i, (label, w, rx) in enumerate(_TOPICS)], "ord, label, weight, rx")
_BOTH = "coalesce(title, '') || ' ' || coalesce(doc_text, '')"
_TOOL = " OR ".join(f"contains(lower(t), {text(w)})" for w in ("mcp", "model context protocol", "modelcontextprotocol", "tool server"))
_SCORED = f"""WITH s AS (SELECT row_id, {_BOTH} AS t FROM topics_full), h AS (SELECT row_id, string_agg(label, '|' ORDER BY ord) AS hits, CAST(sum(weight) AS INT) AS score FROM s JOIN {_SEC} k ON regexp_matches(t, rx) GROUP BY row_id),
    z AS (SELECT s.row_id, ({_TOOL}) AS is_tool_related, coalesce(hits, '') AS sec_hits, coalesce(score, 0) AS sec_score FROM s LEFT JOIN h USING (row_id))"""


def _scored(spark, d):
    return mining.scored(table(spark, d, "topics_full"), ["row_id"], "title", "doc_text")


@query(f"{_SCORED} SELECT * FROM z")
def security_scores(spark, d):
    return _scored(spark, d)


@query(f"{_SCORED} SELECT category, count(*) AS topics, count(*) FILTER (WHERE is_tool_related) AS tool_topics FROM (SELECT is_tool_related, unnest(string_split(sec_hits, '|')) AS category FROM z WHERE sec_hits <> '') GROUP BY category")
def security_categories(spark, d):
    return mining.category_counts(_scored(spark, d))


@query(f"{_SCORED} SELECT row_id FROM z WHERE is_tool_related")
def tool_topics(spark, d):
    return _scored(spark, d).where("is_tool_related").select("row_id")


@query("SELECT event_type AS platform, date_trunc('month', ts) AS period, count(*) AS n FROM events GROUP BY ALL")
def monthly_trend(spark, d):
    return mining.trend(table(spark, d, "events"), "event_type", F.col("ts"))


@query("SELECT source AS platform, CAST(date_trunc('day', created_at) AS TIMESTAMP) AS period, count(*) AS n FROM documents WHERE created_at IS NOT NULL GROUP BY ALL")
def daily_trend(spark, d):
    return mining.trend(table(spark, d, "documents"), "source", F.col("created_at"), "DAY")
