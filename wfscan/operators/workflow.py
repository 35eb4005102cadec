"""Workflow templates: nodes, prompts, packages, connections. Documents are VARIANT; nothing is inferred from data."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wfscan.functions.names import is_community, package_of_type
from wfscan.functions.text import contains_any, non_blank
from wfscan.operators.findings import percent
from wfscan.session import shared_table, ship_package

# Names of the platform's own packages; parameters with the values of the tables at hand.
OFFICIAL = ["flow-base.", "@flow/"]
SCOPE = "@flow/"
# Nodes that hold prompts or reach a model, by the package they belong to.
CHAIN_NODES = [
    "agent", "openAi", "anthropic", "chainLlm", "informationExtractor", "agentTool", "googleGemini", "googleGeminiTool", "chainRetrievalQa", "outputParserAutofixing", "outputParserStructured", "guardrails",
    "lmChatOpenAi", "lmChatAnthropic", "lmChatGoogleGemini", "lmChatAzureOpenAi", "lmChatGroq", "lmChatMistralCloud", "lmChatOpenRouter", "lmChatXAiGrok", "chat", "chatTrigger", "chainSummarization", "textClassifier",
]
BASE_NODES = ["openAi", "openai", "anthropic"]


def model_types(chain_package: str = "langchain", base_package: str = "base") -> list[str]:
    """What the type of a model node contains: a node of one of the two packages, whose names end as given."""
    return [f"{chain_package}.{n}" for n in CHAIN_NODES] + [f"{base_package}.{n}" for n in BASE_NODES]


MODEL_TYPES = model_types()
# Nodes that retrieve, store or cut up documents, by the package they belong to.
CHAIN_RETRIEVAL = ["chainRetrievalQa", "retrievalQa", "documentLoader", "documentLoaderText", "documentLoaderPdf", "documentLoaderCsv", "textSplitter", "memoryBufferWindow", "memoryBuffer", "retriever", "vectorStore"]
BASE_RETRIEVAL = ["pinecone", "weaviate", "chroma", "qdrant", "milvus", "vectorStore", "openAiEmbeddings", "embedding"]


def retrieval_types(chain_package: str = "langchain", base_package: str = "base") -> list[str]:
    """What the type of a retrieval node contains."""
    return [f"{chain_package}.{n}" for n in CHAIN_RETRIEVAL] + [f"{base_package}.{n}" for n in BASE_RETRIEVAL]


RETRIEVAL_TYPES = retrieval_types()
# Phrases that tell that a template needs its own host.
DISCLAIMERS = ["self-hosted only", "self-hosted", "self hosted only", "self hosted", "not available in cloud", "cloud not supported", "requires self-hosting", "self-hosting required"]


def disclaimers(platform: str | None = None) -> list[str]:
    """The phrases, and the one that names the platform's own cloud."""
    return DISCLAIMERS + ([f"not available in {platform.lower()} cloud"] if platform else [])


# Markers of tunnels in addresses.
TUNNELS = ["ngrok", "localtunnel", "rshare.io", "localhost.run", "localtest.me", "serveo", "bore.pub", "tunnel"]
UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def document(body: Column) -> Column:
    return F.try_parse_json(F.regexp_replace(F.trim(body), "^\\x{FEFF}", ""))


def _first_list(v: str, paths: tuple[str, ...]) -> Column:
    lists = [F.expr(f"try_variant_get({v}, '{p}', 'array<variant>')") for p in paths]
    return F.get(F.filter(F.array(*lists), lambda a: F.coalesce(F.size(a), F.lit(0)) > 0), F.lit(0))


def nodes(templates: DataFrame, keep: list[str], body: str = "body") -> DataFrame:
    """keep, node_no, node_type, node_name, node: a row per node, whichever of the three nestings the document has."""
    d = templates.select(*keep, document(F.col(body)).alias("_d")).where("_d is not null")
    n = d.select(*keep, F.posexplode(_first_list("_d", ("$.workflow.workflow.nodes", "$.workflow.nodes", "$.nodes"))).alias("node_no", "node"))
    text = lambda k: F.expr(f"try_variant_get(node, '$.{k}', 'string')")
    n = n.where(F.expr("node is not null and not is_variant_null(node) and try_variant_get(node, '$', 'map<string,variant>') is not null"))
    return n.select(*keep, "node_no", F.trim(non_blank(text("type"), text("name"))).alias("node_type"), text("name").alias("node_name"), "node")


def template_meta(templates: DataFrame, keep: list[str], body: str = "body") -> DataFrame:
    """keep, template_id, title, description, views, created: fields under any of the names they come with."""
    d = templates.select(*keep, document(F.col(body)).alias("_d")).where("_d is not null")
    pick = lambda *names: non_blank(*[F.expr(f"try_variant_get(_d, '$.{p}{n}', 'string')") for p in ("workflow.", "") for n in names])
    return d.select(*keep, pick("id", "_id", "templateId").alias("meta_id"), pick("name", "title", "slug").alias("title"), pick("description").alias("description"), pick("views", "totalViews").try_cast("bigint").alias("views"), pick("createdAt", "created_at").alias("created"))


def with_packages(node_rows: DataFrame) -> DataFrame:
    return node_rows.withColumns({"package": package_of_type(F.col("node_type")), "community": is_community(F.col("node_type"), OFFICIAL, SCOPE)})


def type_contains(words: list[str], column: str = "node_type") -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(F.col(column), F.lit(w)) for w in words]), F.lit(False))


def prompts(node_rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, node_no, field, content: every prompt text of a node, messages in both forms."""
    g = lambda p: F.expr(f"try_variant_get(node, '$.parameters.{p}', 'string')")
    single = [F.struct(F.lit(p).alias("field"), g(p).alias("content")) for p in ("text", "prompt", "systemMessage", "options.systemMessage", "options.text", "options.prompt")]
    lists = F.coalesce(*[F.expr(f"try_variant_get(node, '$.parameters.{p}', 'array<variant>')") for p in ("messages.values", "messages")], F.expr("cast(array() as array<variant>)"))
    message = F.transform(lists, lambda m, i: F.struct(F.concat(F.lit("messages["), i, F.lit("].content")).alias("field"), F.call_function("try_variant_get", m, F.lit("$.content"), F.lit("string")).alias("content")))
    found = F.filter(F.concat(F.array(*single), message), lambda x: F.trim(x["content"]) != "")
    return node_rows.select(*keep, "node_no", "node_type", F.explode(found).alias("p")).select(*keep, "node_no", "node_type", "p.field", "p.content")


def risk_rollup(node_rows: DataFrame, risk: DataFrame, key: str) -> DataFrame:
    """(key, nodes, risky_nodes, high_nodes, packages, risky_packages, has_high): risk of a template from that of its packages."""
    n = with_packages(node_rows).join(risk.select("package", "risk_level"), "package", "left")
    return n.groupBy(key).agg(
        F.count("*").alias("nodes"), F.count_if(F.col("risk_level").isNotNull()).alias("risky_nodes"), F.count_if(F.col("risk_level") == "high").alias("high_nodes"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("community"), F.col("package")))), "|").alias("packages"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("risk_level").isNotNull(), F.col("package")))), "|").alias("risky_packages"),
        F.coalesce(F.bool_or(F.col("risk_level") == "high"), F.lit(False)).alias("has_high"),
    )


def package_risk(findings: DataFrame, errors: int = 1) -> DataFrame:
    """(package, risk_level, score): level of a package from its findings."""
    g = findings.groupBy(F.col("npm_name").alias("package")).agg(F.count_if(F.lower("severity") == "error").alias("errors"), F.count("*").alias("score"))
    return g.select("package", F.when(F.col("errors") >= errors * 10, "high").when(F.col("errors") >= errors, "medium").otherwise("low").alias("risk_level"), "score")


def prefix_hits(node_rows: DataFrame, packages: DataFrame, key: str) -> DataFrame:
    """(package, key, hits, types): nodes whose type begins with a listed package and a dot; packages hold no dot, so it is an equi-join."""
    j = node_rows.withColumn("package", package_of_type(F.col("node_type"))).where(F.contains("node_type", F.lit("."))).join(packages.select("package").distinct(), "package")
    return j.groupBy("package", key).agg(F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_set("node_type")), "|").alias("types"))


def package_occurrences(hits: DataFrame, key: str, most: int = 10) -> DataFrame:
    """(package, occurrences, templates, examples): per package, with the first templates as examples."""
    return hits.groupBy("package").agg(F.sum("hits").alias("occurrences"), F.count_distinct(key).alias("templates"), F.array_join(F.slice(F.array_sort(F.collect_set(F.col(key))), 1, most), "|").alias("examples"))


def agent_stats(node_rows: DataFrame, key: str) -> DataFrame:
    """(key, agents, models, tools, multi_agent): how many nodes of each kind a template has."""
    t = F.lower("node_type")
    return node_rows.groupBy(key).agg(
        F.count_if(F.endswith("node_type", F.lit(".agent"))).alias("agents"), F.count_if(type_contains(MODEL_TYPES)).alias("models"), F.count_if(type_contains(RETRIEVAL_TYPES)).alias("retrieval"),
        F.count_if(t.rlike("tool|mcp")).alias("tools"), (F.count_if(F.endswith("node_type", F.lit(".agent"))) > 1).alias("multi_agent"),
    )


def disclaimer_rates(templates: DataFrame, node_rows: DataFrame, key: str, platform: str | None = None) -> DataFrame:
    """One row: templates with community nodes, and which part of them says that it needs its own host."""
    notes = F.expr("try_variant_get(node, '$.parameters.content', 'string')")
    c = with_packages(node_rows).groupBy(key).agg(F.bool_or("community").alias("community"), F.coalesce(F.bool_or(contains_any(F.when(F.lower("node_type").contains("stickynote"), notes), disclaimers(platform))), F.lit(False)).alias("noted"))
    m = template_meta(templates, [key]).select(key, F.coalesce(contains_any(F.col("description"), disclaimers(platform)), F.lit(False)).alias("described"))
    g = c.where("community").join(m, key).agg(F.count("*").alias("templates"), F.count_if(F.col("noted") | F.col("described")).alias("with_disclaimer"))
    return g.withColumn("rate", percent(F.col("with_disclaimer"), F.col("templates"), 1))


def connections(node_rows: DataFrame, keep: list[str], official_hosts: list[str], brand: str) -> DataFrame:
    """keep, node_no, url and its traits: external, tunnel, exposed, look-alike; whether it authenticates and verifies."""
    p = lambda k: F.expr(f"try_variant_get(node, '$.parameters.{k}', 'string')")
    raw = F.trim(non_blank(p("endpointUrl"), p("url"), p("serverUrl"), p("endpoint")))
    url = F.when(~F.startswith(raw, F.lit("=")), raw)
    low = F.lower("url")
    headers = F.expr("try_variant_get(node, '$.parameters.headerParameters.parameters', 'array<variant>')")
    named = F.exists(headers, lambda h: F.lower(F.call_function("try_variant_get", h, F.lit("$.name"), F.lit("string"))).rlike("auth|bearer|token|api") & (F.call_function("try_variant_get", h, F.lit("$.value"), F.lit("string")) != ""))
    local = low.rlike("localhost|127\\.0\\.0\\.1")
    host = F.expr("try_parse_url(url, 'AUTHORITY')")
    port = F.regexp_extract(low, r":(\d+)", 1).try_cast("int")
    return node_rows.withColumns({"url": url, "auth": F.coalesce(non_blank(p("authentication"), p("authType"), p("auth")).isNotNull() | F.coalesce(named, F.lit(False)), F.lit(False)), "verified": p("verifySSL").isNotNull() | p("ssl").isNotNull() | p("tls").isNotNull()}).select(
        *keep, "node_no", "url", "auth", "verified",
        F.coalesce(~low.rlike(r"localhost|127\.0\.0\.1|0\.0\.0\.0"), F.lit(False)).alias("external"),
        F.coalesce(contains_any(F.col("url"), TUNNELS), F.lit(False)).alias("tunnel"),
        F.coalesce(local & (F.startswith(low, F.lit("http://")) | ~F.coalesce(port, F.lit(80)).isin(80, 443, 8080)), F.lit(False)).alias("exposed"),
        F.coalesce(F.contains(F.lower(host), F.lit(brand)) & ~host.isin(*official_hosts) & F.contains(host, F.lit(".")), F.lit(False)).alias("lookalike"),
    )


def connection_summary(rows: DataFrame, key: str) -> DataFrame:
    t = rows.where("url is not null").groupBy(key).agg(*[F.bool_or(c).alias(c) for c in ("external", "tunnel", "exposed", "lookalike")], F.bool_or(~F.col("auth")).alias("no_auth"), F.bool_or(~F.col("verified")).alias("no_verification"))
    return t.agg(F.count("*").alias("templates"), *[F.count_if(c).alias(c) for c in ("external", "tunnel", "exposed", "lookalike", "no_auth", "no_verification")])


def reused_ids(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(uuid, uses, templates): identifiers that occur more than once."""
    u = texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(UUID), F.lit(0))).alias("u"))
    return u.groupBy(F.lower("u").alias("uuid")).agg(F.count("*").alias("uses"), F.count_distinct(key).alias("templates")).where("uses > 1")


def partition_of(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(part, n): keys in both, only in the first, only in the second."""
    j = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    return j.groupBy(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "only_first").otherwise("only_second").alias("part")).agg(F.count("*").alias("n"))


LISTED_CHARS, HELD_CHARS = 64_000_000, 16_000_000  # characters of listed names that are broadcast at a time; of texts that pass the blocks together


def contained_ids(ids: DataFrame, id_col: str, texts: DataFrame, key: str, text: str, block: int = 100_000) -> DataFrame:
    """(key, ids): the listed identifiers that occur in a text, also inside longer words.

    Each block of identifiers is one automaton, and a task passes a bounded part of its texts through one block after another, so there is
    neither a nested loop nor a shuffle of texts, and texts are read once. All identifiers together are broadcast up to LISTED_CHARS; of
    more, each round is written before the next, so neither the driver nor an executor holds more.
    """
    spark = texts.sparkSession
    ship_package(spark)
    listed = ids.select(F.col(id_col).cast("string").alias("i")).where("trim(i) <> ''").distinct()
    out, before = None, None
    for blocks in _blocks(listed, block):
        if out is not None:
            out = shared_table(out)
            before.destroy()
        held = before = spark.sparkContext.broadcast(blocks)  # bounded by LISTED_CHARS

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            made: dict[int, object] = {}

            def automaton(n: int):
                if n not in made:
                    if len(made) >= 8:
                        made.clear()
                    a = made[n] = ahocorasick.Automaton()
                    for w in held.value[n]:
                        a.add_word(w, w)
                    a.make_automaton()
                return made[n]

            def found(part: list[tuple[str, str]]) -> pa.RecordBatch:
                rows = [(k, w) for n in range(len(held.value)) if held.value[n] for k, t in part for w in {w for _, w in automaton(n).iter(t)}]
                return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.string())], ["k", "i"])

            part, chars = [], 0
            for b in batches:
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if t:
                        part.append((k, t))
                        chars += len(t)
                    if chars >= HELD_CHARS:
                        yield found(part)
                        part, chars = [], 0
            if part:
                yield found(part)

        one = texts.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInArrow(run, "k string, i string")
        out = one if out is None else out.unionByName(one)
    return out.distinct().groupBy(F.col("k").alias(key)).agg(F.array_join(F.array_sort(F.collect_list("i")), "|").alias("ids"))


def _blocks(listed: DataFrame, size: int) -> Iterator[list[list[str]]]:
    """The names in blocks, and the blocks in rounds of LISTED_CHARS, streamed through the driver a round at a time."""
    blocks, held, chars = [], [], 0
    for r in listed.toLocalIterator():
        if chars + len(r[0]) > LISTED_CHARS and chars:
            yield [*blocks, held]
            blocks, held, chars = [], [], 0
        held.append(r[0])
        chars += len(r[0])
        if len(held) == size:
            blocks.append(held)
            held = []
    yield [*blocks, held]
