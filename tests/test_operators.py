import io
import itertools
import json
import tarfile
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wfscan import sinks, streaming
from wfscan.functions import names, text, versions
from wfscan.operators import audit, chains, lexing, package_scan, registry, server_scan, similarity, workflow
from wfscan.sources import readers


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in cols.items())) if cols else spark.range(1)
    return df.select(expr).first()[0]


@pytest.mark.parametrize(
    ("code", "spans"),
    [
        ("a // b\nc", [(2, 6)]),
        ("/* x */ y /* z", [(0, 7)]),
        ("'// no' // yes", [(8, 14)]),
        ('"a\\"// no" /* c */', [(11, 18)]),
        ("`t ${ /* none */ x } // text` // c", [(30, 34)]),
        ("`${'}'}` // c", [(9, 13)]),
        ("'line\nbreak // still text", []),
        ("", []),
        (None, []),
    ],
)
def test_comment_spans(code, spans):
    assert lexing.comment_spans(code) == spans


def test_quotes_and_blocks():
    t = "description: 'see http://x', url: http://y"
    assert lexing.inside_quotes(t, t.index("http://x")) and not lexing.inside_quotes(t, t.index("http://y"))
    assert lexing.block_end("name: 'a', o: { x: 1 } } rest", 0) == 22
    assert lexing.block_end("n" * 3000, 0) == 800


def test_package_rules_find_what_they_are_for(spark):
    code = "\n".join(
        [
            "import fs from 'fs';", "// eval(commented)", "eval(x); new Function('y');", "const e = process.env.KEY;", "setTimeout('code', 1);", "el.innerHTML = a;",
            "description: 'see http://host.example', // " + "x" * 700, "fetch('http://10.0.0.1/a');", "console.log('the password', pw);", "{ name: 'apiKey', type: 'string' }", "{ name: 'token', typeOptions: { password: true } }", "yaml.load(z); new RegExp(q); import(mod);",
        ]
    )
    df = spark.createDataFrame([(1, "p", "f.ts", code, 9), (2, "p", "g.ts", None, 9), (3, "p", "h.ts", "", 9)], "file_id bigint, npm_name string, file string, code string, pos int").drop("pos")
    hits = package_scan.find_hits(df)
    got = sorted((r.rule, r.match_lines[0]) for r in hits.collect())
    assert ("EVAL_DYNAMIC", 2) not in got and ("HTTP_PROTO", 7) not in got
    assert {("FS_CHILD_IMPORT", 1), ("EVAL_DYNAMIC", 3), ("PROCESS_ENV", 4), ("EVAL_DYNAMIC", 5), ("HTML_UNSANITIZED", 6), ("HTTP_PROTO", 8), ("SSRF_HOST", 8), ("LOG_SENSITIVE", 9), ("INPUT_SECRET_UNMASKED", 10), ("DESERIALIZE", 12), ("DYNAMIC_REGEX", 12), ("DYNAMIC_IMPORT", 12)} <= set(got)
    assert ("INPUT_SECRET_UNMASKED", 11) not in got
    e = package_scan.labelled(package_scan.enriched(package_scan.distinct_findings(hits, ["pos"])))
    assert e.where("rule = 'SSRF_HOST'").select("class_id", "rule_category", "confidence").first() == ("N4", "NET_RISK", 2)
    assert package_scan.find_hits(df.limit(0)).count() == 0


def test_scans_are_linear_in_hits_and_carry_no_text(spark):
    import time

    code = "\n".join(["eval(x); fetch(u);"] * 10_000)
    df = spark.createDataFrame([(1, "s", "a.js", code)], "file_id int, server_name string, file string, code string")
    began = time.time()
    hits = package_scan.find_hits(df.drop("server_name"))
    assert hits.where("rule = 'EVAL_DYNAMIC'").count() == 10_000 and "code" not in hits.columns
    assert server_scan.scan_servers(df.drop("file_id")).count() == 20_000
    assert time.time() - began < 30
    last = hits.where("rule = 'EXT_HTTP_CALL'").orderBy(F.desc("pos")).first()
    assert (last.match_lines, last.line_start, last.line_end, last.code_snippet.count("\n")) == ([10_000, 10_000], 9_997, 10_000, 3)


def test_findings_end_where_their_span_ends(spark):
    code = "{ name: 'token',\n  type: 'string'\n}\nconsole.log('x', api_key)\n"
    df = spark.createDataFrame([("a.ts", code, 7, "x")], "file string, code string, pos_ int, rule_ string")
    got = {r.rule: r for r in package_scan.find_hits(df).collect()}
    assert got["INPUT_SECRET_UNMASKED"].match_lines == [1, 3] and got["INPUT_SECRET_UNMASKED"].matched_text == "token"
    assert got["LOG_SENSITIVE"].match_lines == [4, 5] and got["LOG_SENSITIVE"].pos_ == 7
    plain = package_scan.find_hits(df.select(F.lit("a.html").alias("file"), F.lit("// eval(x)").alias("code")))
    assert plain.count() == 1  # only scripts have comments


def test_imports_and_dependencies(spark):
    code = "import a from 'ngrok';\nconst b = require('@sentry/node/x');\nimport('axios?x')\nimport 'eslint-http';"
    df = spark.createDataFrame([(1, code)], "file_id int, code string")
    assert sorted(r.module for r in package_scan.imports(df).collect()) == ["@sentry/node", "axios", "eslint-http", "ngrok"]
    found = {(r.module, r.rule) for r in package_scan.import_findings(df).collect()}
    assert found == {("ngrok", "PROXY_TUNNEL"), ("@sentry/node", "EXFIL_SDK_CALL")}
    m = spark.createDataFrame([("p", json.dumps({"dependencies": {"undici": "^1"}, "devDependencies": {"jest": "2"}})), ("q", "{"), ("r", json.dumps({"license": "MIT"}))], "npm_name string, code string")
    assert {(r.module, r.dep_kind, r.is_network_suspect) for r in package_scan.dependencies(m).collect()} == {("undici", "dependencies", True), ("jest", "devDependencies", False)}
    p = spark.createDataFrame([("p",), ("q",), ("r",), ("s",)], "npm_name string")
    assert {tuple(r) for r in package_scan.manifest_findings(p, m).collect()} == {("p", "LICENSE", "warn"), ("q", "PKG_JSON_INVALID", "error"), ("s", "PKG_JSON_MISSING", "warn")}


def test_server_scan_context(spark):
    code = "x = os.environ['A']\nrequests.post(u, x)\n# eval(no)\nvalidate(x)\neval(x)\n"
    df = spark.createDataFrame([("s", "a.py", code), ("s", "b.py", None)], "server_name string, file string, code string")
    got = {(r.rule, r.line): (r.severity, r.chain_confidence) for r in server_scan.scan_servers(df).collect()}
    assert got == {("secret_env_source", 1): ("low", "weak"), ("outbound_http", 2): ("low", "weak"), ("dynamic_code", 5): ("low", "weak")}
    assert server_scan.scan_totals(server_scan.scan_servers(df)).where("findings = 0").count() > 0


def test_scalar_functions(spark):
    assert one(spark, names.https_repository(F.col("u")), u="git+ssh://git@host.example/a/b.git") == "https://host.example/a/b"
    assert one(spark, names.module_base(F.col("u")), u="node:fs/promises?x") == "fs"
    assert one(spark, names.safe_file_name(F.col("u")), u="@a/b c") == "_a_b_c"
    assert one(spark, versions.compare(F.col("a"), F.col("b")), a="v1.10.0", b="1.9.9-beta") == "npm_newer"
    assert one(spark, versions.compare(F.col("a"), F.col("b")), a="x", b="y") == "unparsable"
    assert one(spark, versions.compare(F.col("a"), F.col("b")), a="", b="1") == "missing_npm_version"
    assert one(spark, text.clean_html(F.col("h")), h="<p>Hi &amp; <code>x</code> a@b.cd http://z me</p>") == "hi amp me"
    assert one(spark, text.line_of(F.col("t"), F.lit(4)), t="a\nb\nc") == 3
    assert [tuple(x) for x in one(spark, text.all_matches(F.col("t"), r"\d+"), t="12 𝒳 3")] == [(0, "12"), (5, "3")]
    assert one(spark, audit.list_of(F.col("t")), t='["a,b", "c"]') == ["a,b", "c"] and one(spark, audit.list_of(F.col("t")), t="a | b;c") == ["a", "b", "c"]
    assert one(spark, audit.judgment(F.col("t")), t=" Likely_Non_Compliant ") == "confirmed_non_compliant"
    assert one(spark, audit.fenced_json(F.col("t"), "a int"), t="```json\n{\"a\": 3}\n```").a == 3
    assert dict(one(spark, chains.star_counts(F.col("t"), "N"), t="N1=3; M2=1; N1 = 2")) == {1: 5}
    assert one(spark, audit.model_texts(F.col("t")), t='{"x": [{"text": "a"}, {"messages": [{"prompt": "b"}]}]}') == '[text] a\n[messages] [{"prompt": "b"}]\n[prompt] b'


def test_rare_bands_suffice(spark, monkeypatch):
    """A band that all signatures have: looked up by its rarest bands each still meets every partner."""
    import random

    rng = random.Random(4)
    monkeypatch.setattr(similarity, "HOT_BAND", 3)
    rows = []
    for i in range(60):
        s = list(rng.choice(rows)[1]) if rows and rng.random() < 0.7 else [1] * 40 + [rng.randrange(10**6) for _ in range(40)]
        for _ in range(rng.randrange(6)):
            s[rng.randrange(80)] = rng.randrange(10**6)
        rows.append((i, s))
    assert similarity.looked_up(0.9) == 9 and similarity.looked_up(0.3) == 20
    got = {(r.rep_a, r.rep_b) for r in similarity.similar_signatures(spark.createDataFrame(rows, "file_id int, signature array<bigint>"), "file_id")[1].collect()}
    rep = {}
    for i, s in rows:
        rep.setdefault(tuple(s), i)
    want = {(i, j) for s, i in rep.items() for t, j in rep.items() if i < j and sum(a == b for a, b in zip(s, t, strict=True)) >= 72}
    assert got == want and len(want) > 20


def test_minhash_pairs_equal_brute_force(spark):
    base = "function f(a) { return a + b * c; } const x = f(1); if (x > 2) { g(x); h(x, y); } "
    codes = [base * 3, base * 3, base.replace("g(x)", "g(x, 1)") * 3, base * 3 + "while (q) { q--; }", "let z = 1;", "", None, "class A { m() { return this.p(); } }" * 4]
    df = spark.createDataFrame([(i, f"p{i % 3}", c, "n") for i, c in enumerate(codes)], "file_id int, npm_name string, code string, signature string").drop("signature")
    s = similarity.signatures(df, ["file_id", "npm_name"])
    members, links = similarity.similar_signatures(s, "file_id", 0.5)
    rep = {r.file_id: r.rep for r in members.collect()}
    sig = {r.file_id: r.signature for r in s.collect()}
    bands = lambda x: {(b, tuple(x[b * 4 : b * 4 + 4])) for b in range(20)}
    expected = {}
    for a, b in itertools.combinations(sorted(set(rep.values())), 2):
        sim = round(sum(p == q for p, q in zip(sig[a], sig[b], strict=True)) / 80, 4)
        if sim >= 0.5 and bands(sig[a]) & bands(sig[b]):
            expected[a, b] = sim
    assert {(r.rep_a, r.rep_b): r.similarity for r in links.collect()} == expected and expected
    assert similarity.package_pairs(members, links, df, "file_id", "npm_name").count() > 0


def test_registry_rules(spark):
    df = spark.createDataFrame([(1, " A/x", True, "2"), (2, "a/X", False, "9"), (3, "a/x", True, "2"), (4, "", None, None), (5, "", None, None)], "record_id int, full_name string, is_latest boolean, updated_at string")
    assert {r.record_id for r in registry.latest_per_key(df, F.col("full_name"), "is_latest", "updated_at", "record_id").collect()} == {3, 4, 5}
    a, b = df.where("record_id < 3"), df.where("record_id > 1")
    assert {(r.record_id, r.change) for r in registry.snapshot_difference(a, b, "record_id").collect()} == {(1, "deleted"), (3, "new"), (4, "new"), (5, "new")}


def test_contained_ids(spark):
    ids = spark.createDataFrame([("ab",), ("abc",), ("zz",), (" ",)], "i string")
    t = spark.createDataFrame([(1, "xabcx"), (2, "q"), (3, None)], "k int, t string")
    assert [tuple(r) for r in workflow.contained_ids(ids, "i", t, "k", "t").collect()] == [("1", "ab|abc")]
    assert workflow.contained_ids(ids.limit(0), "i", t, "k", "t").count() == 0


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿name,repository\n x ,nan\n,\n", "utf-8")
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "a.csv"), ["name", "repository"]).collect()] == [("x", None), (None, None)]
    with pytest.raises(ValueError):
        readers.csv(spark, str(tmp_path / "a.csv"), ["other"])
    assert [r.name for r in readers.ids(spark, str(tmp_path / "a.csv"), "name").collect()] == ["x"]
    (tmp_path / "l.txt").write_text("# no\n\nB\nb\n a \n")
    assert sorted(r.name for r in readers.lines(spark, str(tmp_path / "l.txt")).collect()) == ["B", "a"]
    (tmp_path / "n.txt").write_text("- ID 12: x\n7\nother 3\n")
    assert sorted(r.id for r in readers.listed_numbers(spark, str(tmp_path / "n.txt")).collect()) == ["12", "7"]
    j = tmp_path / "j"
    j.mkdir()
    (j / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    (j / "b.json").write_text('{"items": [{"id": 3}]}')
    (j / "c.jsonl").write_text('{"id": 4}\nbroken\n{"id": 5}\n')
    (j / "d.json").write_text("{broken")
    assert sorted(r[0] for r in readers.json_documents(spark, str(j)).select(F.expr("try_variant_get(doc, '$.id', 'int')")).collect()) == [1, 2, 3, 4, 5]
    assert readers.unreadable(spark, str(j)).count() == 1
    assert sorted(r.id for r in readers.json_lines(spark, str(j / "c.jsonl"), "id int").where("id is not null").collect()) == [4, 5]
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("top/x.js", "1")
        f.writestr("top/d/y.js", "2")
        f.writestr("../evil.js", "3")
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        i = tarfile.TarInfo("package/p.json")
        i.size = 2
        f.addfile(i, io.BytesIO(b"{}"))
    arch = tmp_path / "arch"
    arch.mkdir()
    (arch / "a.zip").write_bytes(z.getvalue())
    (arch / "b.tgz").write_bytes(t.getvalue())
    (arch / "c.bin").write_bytes(b"none")
    assert sorted((r.path, r.code) for r in readers.archives(spark, str(arch)).collect()) == [("d/y.js", "2"), ("p.json", "{}"), ("x.js", "1")]
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "page-00000.json").write_text('{"objects": [{"a": 1}, {"a": 2}]}')
    (pages / "page-00001.json").write_text('[{"a": 3}]')
    assert sorted((r.page, json.loads(r.record)["a"]) for r in readers.paged(spark, str(pages), 3).collect()) == [(0, 1), (0, 2), (1, 3)]
    df = spark.createDataFrame([(1, ["a", "b"], "x|y")], "k int, l array<string>, s string")
    sinks.csv(df, str(tmp_path / "o.csv"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "o.csv"), header=True).collect()] == [("1", "a|b", "x|y")]
    assert df.select(sinks.markdown_rows("k", "s")).first()[0] == "| 1 | x\\|y |"
    assert df.select(sinks.fixed_width(("k", 3), ("s", 4))).first()[0] == "1  x|y "
    p = str(tmp_path / "done")
    assert sinks.resumable(df, p, ["k"]) == 1 and sinks.resumable(df.unionByName(df.withColumn("k", F.lit(2))), p, ["k"]) == 1
    assert spark.read.parquet(p).count() == 2
    sinks.replaced(df, p, p + ".bak")
    assert spark.read.parquet(p).count() == 1 and spark.read.parquet(p + ".bak").count() == 2


def test_stream_with_late_rows(spark, tmp_path):
    schema = "id int, ts timestamp, kind string"
    src = str(tmp_path / "in")
    for n, rows in enumerate([[(1, "2025-01-01 10:00:00", "a"), (1, "2025-01-01 10:00:00", "a"), (2, "2025-01-05 10:00:00", "b")], [(3, "2025-01-01 09:00:00", "late"), (2, "2025-01-05 10:00:00", "b")]]):
        spark.createDataFrame(rows, "id int, ts string, kind string").select("id", F.to_timestamp("ts").alias("ts"), "kind").coalesce(1).write.mode("append").parquet(src)
        s = streaming.without_repeats(streaming.files(spark, src, spark.read.parquet(src).schema), ["id"], "ts", "1 day")
        streaming.to_table(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert n >= 0
    assert sorted(r.id for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_scorer_plug(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    out = audit.score_with(df, lambda b: pd.DataFrame({"id": b["id"], "n": b["t"].fillna("").str.len()}), "id int, n int")
    assert sorted(map(tuple, out.collect())) == [(1, 1), (2, 0)]


def test_answers_are_asked_again():
    said = iter([readers.Answer(503), readers.Answer(429, headers={"Retry-After": "7"}), readers.Answer(200, {"a": 1})])
    slept = []
    assert readers.asked(lambda: next(said), sleep=slept.append, jitter=lambda: 1.0).body == {"a": 1} and slept == [1.0, 7.0]
    for status, tries in ((404, 1), (500, 3)):
        calls = []
        with pytest.raises(OSError, match=f"status {status} after {tries} tries"):
            readers.asked(lambda calls=calls, status=status: calls.append(1) or readers.Answer(status), tries=3, sleep=lambda s: None)
        assert len(calls) == tries


def test_paging_stops_where_the_service_does():
    data = [{"n": i} for i in range(23)]
    offset = lambda k: readers.Answer(200, {"objects": data[k : k + 10], "total": 23})
    assert [k for k, _ in readers.pages(offset, readers.by_offset(10))] == [0, 10, 20]
    assert sum(len(r) for _, r in readers.pages(offset, readers.by_offset(10), limit=12)) == 12
    numbered = lambda k: readers.Answer(200, {"workflows": data[(k - 1) * 10 : k * 10]})
    assert [len(r) for _, r in readers.pages(numbered, readers.by_page())] == [10, 10, 3]
    cursors = {None: "b", "b": "c", "c": "c"}
    by_cursor = lambda k: readers.Answer(200, {"servers": [k], "metadata": {"next": cursors[k]}})
    assert [k for k, _ in readers.pages(by_cursor, readers.by_cursor("metadata", "next"))] == [None, "b", "c"]
    endless = lambda k: readers.Answer(200, {"servers": [1], "metadata": {"next": (k or 0) + 1}})
    assert len(list(readers.pages(endless, readers.by_cursor("metadata", "next", most_pages=50)))) == 50
    assert list(readers.pages(lambda k: readers.Answer(200, []), readers.by_page())) == []


def test_recorded_services_as_a_table(spark, tmp_path):
    for q, pages in {"a": {"first": {"servers": [1, 2], "next": "x"}, "x": {"servers": [3]}}, "b": {"first": {"servers": []}}}.items():
        (tmp_path / q).mkdir()
        for k, body in pages.items():
            (tmp_path / q / f"{k}.json").write_text(json.dumps(body))
    root = str(tmp_path)
    df = readers.service(spark, ["a", "b", "none"], lambda q: readers.recorded(f"{root}/{q}"), readers.by_cursor("next"))
    assert sorted(map(tuple, df.collect())) == [("a", 0, "1"), ("a", 0, "2"), ("a", 1, "3")]


def test_report_with_header_and_counters(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "ä", "x"), (3, "c", "y")], "n int, name string, note string")
    path = str(tmp_path / "report.json")
    for _ in range(2):
        counts = sinks.json_report(df, path, {"made": "today"}, {"noted": lambda r: r.note is not None}, order=["n"])
    assert counts == {"total": 3, "noted": 2}
    assert json.loads((tmp_path / "report.json").read_text(encoding="utf-8")) == {"made": "today", "packages": [{"n": 1, "name": "ä", "note": "x"}, {"n": 2, "name": "b", "note": None}, {"n": 3, "name": "c", "note": "y"}], "total": 3, "noted": 2}
    assert sinks.json_report(df.limit(0), path, {}, {}) == {"total": 0} and json.loads((tmp_path / "report.json").read_text()) == {"packages": [], "total": 0}
    assert list(sinks.batches(list(range(7)), 3)) == [[0, 1, 2], [3, 4, 5], [6]]


def test_tables_normalised_in_place_keep_a_copy(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, " a ")], "n int, s string").write.parquet(path)
    sinks.normalised_in_place(spark.read.parquet(path), path, lambda d: d.withColumn("s", F.trim("s")))
    assert spark.read.parquet(path).first().s == "a" and spark.read.parquet(path + ".bak").first().s == " a "


def test_similarity_in_stages(spark, tmp_path, capsys):
    from wfscan import __main__ as cli

    base = "function f(a) { return a + b * c; } const x = f(1); if (x > 2) { g(x); h(x, y); } " * 3
    spark.createDataFrame([(1, "p", base), (2, "q", base), (3, "r", "let z = 1;")], "file_id bigint, npm_name string, code string").write.parquet(str(tmp_path / "files"))
    cli.main(["similarity", "all", str(tmp_path / "files"), str(tmp_path / "out")])
    assert [(r.pkg_a, r.pkg_b, r.num_file_pairs) for r in spark.read.json(str(tmp_path / "out/packages")).collect()] == [("p", "q", 1)]
    cli.main(["list"])
    assert "package_rule_hits" in capsys.readouterr().out


def test_names_of_the_platform_are_parameters():
    from wfscan.operators import mining

    assert len(workflow.model_types()) == 27 and workflow.model_types("@x/nodes-langchain", "nodes-base")[0] == "@x/nodes-langchain.agent"
    assert len(workflow.retrieval_types()) == 19 and "not available in acme cloud" in workflow.disclaimers("Acme") and len(workflow.disclaimers()) == 8
    assert dict((k, rx) for k, _, rx in mining.security_patterns("acme", "acme-nodes-base"))["HTTP/Webhook"].startswith(r"acme[- ]nodes[- ]base\.httpRequest")
    assert len(mining.security_patterns()) == 17


def test_a_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from wfscan.session import shared_root

    at = lambda master, named: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: named), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: named)))
    assert shared_root(at("spark://x:7077", "/shared/")) == "/shared" and shared_root(at("local[4]", None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(at("spark://x:7077", None))


def test_contained_ids_in_rounds(spark, monkeypatch):
    ids = spark.createDataFrame([(f"id{i:03d}",) for i in range(40)] + [("  ",), (None,)], "name string")
    texts = spark.createDataFrame([(i, f"see id{i:03d} and id{(i + 7) % 40:03d}x") for i in range(40)] + [(99, None), (98, "")], "k int, t string")
    want = {str(i): "|".join(sorted({f"id{i:03d}", f"id{(i + 7) % 40:03d}"})) for i in range(40)}
    for limit in (10**6, 60):
        monkeypatch.setattr(workflow, "LISTED_CHARS", limit)
        got = workflow.contained_ids(ids, "name", texts, "k", "t", block=3)
        assert {r.k: r.ids for r in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
