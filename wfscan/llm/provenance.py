"""Problem 6: source files that nobody wrote by hand for the repository they lie in.

Header and layout rules see generated, minified, bundled and data files in one pass over the content; headers stand anywhere in the
leading comment block. The same pass hashes each file
without its white space and leading comments. Merkle hashes then grow bottom-up over the directory trees, one grouped sum a level:
a directory's hash is a sum over its children's (name, hash), so a directory with any number of files is combined on the map side
and never collected. Files and subtrees that occur under two unrelated owners are vendored. After the content pass only ids, paths
and hashes move.

Results: null and empty contents have no content class but may be vendored by their path; a null path has no directory; repeated
rows are judged alike; null server names count as one owner. Two parameters say from which size on sameness is evidence of copying
rather than chance: `chars` for a single file, `tree_chars` for a subtree of two files or more; with 1 all shared content counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wfscan.llm.common import map_arrow
from wfscan.session import checkpoint

MIN_CHARS, MIN_TREE_CHARS = 80, 400
LONG_LINE = 240
# What generators write at the head of a file, in several languages.
GENERATED = re.compile(
    r"(?i)@generated\b|<auto-?generated|\bcode generated by\b|\bauto-?generated\b(?! (?:ids?|names?|keys?)\b)|\bautomatically generated\b|\bgenerated (?:automatically )?(?:by|from|with)\b.*(?:\bedit|\bmodif|\bv?\d+\.\d+|\.\w{2,8}\b)"
    r"|\bproduced by\b.*\b(?:compiler|generator|codegen)\b|\bbuilt from\b.*(?:manual edits|do not edit|overwritten)|\bdo not (?:edit|modify)\b|\bmanual edits are overwritten\b|\bchanges will be (?:lost|overwritten)\b"
    r"|g[ée]n[ée]r[ée] automatiquement|automatisch (?:erzeugt|generiert)|nicht (?:bearbeiten|[äa]ndern)|ne pas modifier|generado autom[áa]ticamente|no (?:editar|modificar)|gerado automaticamente|n[ãa]o (?:editar|modificar)"
    r"|自动生成|請勿修改|请勿修改|自動生成|編集しないで|сгенерирован автоматически|автоматически сгенерирован|не редактировать"
)
GENERATED_PATH = re.compile(r"(?i)(?:^|/)__generated__/|(?:_pb2(?:_grpc)?\.pyi?|[._](?:generated|gen|g)\.\w+|\.pb(?:\.\w+)?\.\w+|\.designer\.\w+)$")
VENDORED_PATH = re.compile(r"(?i)/(?:node_modules|bower_components|vendors?|vendored|third[_-]?party|3rd-?party|thirdparty|site-packages|dist-packages|\.yarn/cache|\.venv|\.pnpm|externals?/[\w.@-]+-\d+(?:\.\d+)+)/")
MINIFIED_PATH = re.compile(r"(?i)[.-]min\.(?:js|mjs|cjs|css)$|\.bundle\.js$|\.[0-9a-f]{8,20}\.(?:js|css)$")
LIBRARY_HEADER = re.compile(r"(?i)^\W{0,6}([\w@./-]+?) v?\d+\.\d+[\w.-]*\s+(?:\(c\)|©|copyright)\s*\d{4}\b.*(?:contributors|authors|licen[cs]e|\bMIT\b|\bBSD\b|apache)")
SOURCE_MAP = re.compile(r"(?m)^//[#@] sourceMappingURL=\S+\s*\Z")
_COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|<!--|--|\"\"\"|'''|;)")
_BLOCKS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
_OPENS = re.compile(r"\s*(?:<\?php\b\s*)?[rRuU]?(/\*|<!--|\"\"\"|''')")
_PRAGMA = re.compile(r"(?i)^\s*(?:<[?!]|@charset\b|\{-#|%|([\"'])use [\w ]+\1\s*;?\s*$)")
_IMPORT = re.compile(r"^\s*(?:import\b|from\s+\S+\s+import\b|(?:const|let|var)\b.*\brequire\(|require\b|use\s+[\w:\\]+|using\s+[\w.]+|package\b|export\b.*\bfrom\b)")
_HEAD = re.compile(r"\A(?:\s*(?://[^\n]*|#[^\n]*|/\*.*?\*/)\s*?(?:\n|\Z))+", re.S)
_LITERAL = re.compile(r"\"(?:\\.|[^\"\\\s])*\"|'(?:\\.|[^'\\\s])*'|[\d.,:;\[\](){}=\s+-]+")
_WORD = re.compile(r"[^\W\d_]{2,}")


def head_lines(code: str, imports: bool = False) -> Iterator[str]:
    """The leading comment block, however long: the lines up to the first that is neither blank, comment, shebang nor pragma (nor import)."""
    at, ends, closes = len(code) - len(code.lstrip("\ufeff")), "", ""
    while at < len(code):
        n = code.find("\n", at)
        line, at = (code[at:n], n + 1) if n >= 0 else (code[at:], len(code))
        if closes:  # within an import over several lines
            closes = closes if closes not in line else ""
            continue
        rest, comment = line, bool(ends)
        while ends or (m := _OPENS.match(rest)):
            if not ends:
                ends, rest, comment = _BLOCKS[m[1]], rest[m.end() :], True
            _, mark, rest = rest.partition(ends)
            if not mark:
                break
            ends = ""
        if imports and not ends and _IMPORT.match(rest):
            closes = next((z for a, z in ("{}", "()") if rest.count(a) > rest.count(z)), "")
            rest = ""
        ended = bool(rest.strip()) and not _COMMENT.match(rest) and not _PRAGMA.match(rest)
        if comment or not ended:
            yield line
        if ended:
            return


def content_class(code: str, path: str) -> str | None:
    """generated, minified or data, by the rules for header and layout; null for what looks written by hand."""
    lines = code.split("\n", 12)[:12]
    for line in lines:
        if _COMMENT.match(line) and GENERATED.search(line):
            return "generated"
    if any(GENERATED.search(line) for line in head_lines(code)) or GENERATED_PATH.search(path):
        return "generated"
    if not code.strip():
        return None
    n = len(code)
    # minified: nearly all of the text stands in long lines with hardly any white space
    if MINIFIED_PATH.search(path):
        return "minified"
    if n >= 200:
        lines = code.split("\n")
        if n / len(lines) > 90:
            long = [x for x in lines if len(x) > LONG_LINE]
            dense = sum(map(len, long))
            if dense > 0.7 * n and _letters(code) >= 0.1 * n and sum(x.count(" ") for x in long) < 0.12 * dense:
                return "minified"
        if SOURCE_MAP.search(code) and n / len(lines) > 120:
            return "minified"
        if _letters(code) < 0.1 * n:
            return "data"
    return None


def _letters(code: str) -> int:
    """Letters outside of numbers and of strings without white space: what a program has and a table hasn't."""
    return sum(map(len, _WORD.findall(_LITERAL.sub(" ", code))))


def content_hash(code: str) -> tuple[int | None, int]:
    """Hash and length of the content without leading comments, byte-order mark and white space."""
    text = code.lstrip("﻿")
    body = _HEAD.sub("", text, count=1)
    plain = "".join((body if body.strip() else text).split())
    return (xxhash.xxh3_64_intdigest(plain.encode("utf-8", "replace")) - (1 << 63) if plain else None), len(plain)


FACTS = "file_id bigint, owner string, server string, root string, path string, hash bigint, chars bigint, found string"


def file_facts(df: DataFrame) -> DataFrame:
    """One small row per file: owner, server, clean path, content hash and what the content alone shows."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for i, server, root, name, code in zip(*(c.to_pylist() for c in b.columns), strict=True):
            root = re.sub(r"/(?:\./|/)*", "/", f"{root or ''}/".replace("\\", "/"))
            name = re.sub(r"/(?:\./|/)+", "/", (name or "").replace("\\", "/")).removeprefix("./").lstrip("/")
            path = root + name
            server, code = (server or "").strip(), code or ""
            found = content_class(code, path)
            if found is None:
                tops = chain(code.lstrip("﻿").split("\n", 3)[:3], head_lines(code, imports=True))
                head = next((m for x in tops if (m := LIBRARY_HEADER.match(x.strip()))), None)
                if VENDORED_PATH.search(path) or head and head[1].lower() not in server.lower():
                    found = "vendored"
            out.append((i, server.split("/")[0].lower(), server.lower(), root, name, *content_hash(code), found))
        cols = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file_id", "owner", "server", "root", "path", "hash", "chars", "found"])

    return map_arrow(df.select(F.col("file_id").cast("bigint").alias("file_id"), "server_name", "code_path", "file", "code"), kernel, FACTS)


def merkle_directories(facts: DataFrame) -> DataFrame:
    """(owner, server, root, dir, hash, files, chars): the Merkle hash of each directory below a scan root, from the deepest level up.

    Every level is checkpointed: a row per directory, so the plan stays short however deep the trees are.
    """
    depth = F.size(F.split("path", "/"))
    files = facts.where("hash is not null").select("owner", "server", "root", "path", "hash", F.lit(1).cast("bigint").alias("files"), "chars", depth.alias("depth"))
    deepest = files.agg(F.max("depth")).first()[0] or 0  # one number
    done, below = None, None
    for level in range(deepest, 0, -1):
        nodes = files.where(F.col("depth") == level).drop("depth")
        if below is not None:
            nodes = nodes.unionByName(below)
        child = F.xxhash64(F.element_at(F.split("path", "/"), -1), "hash")
        parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
        below = checkpoint(
            nodes.groupBy("owner", "server", "root", parent.alias("path")).agg(
                F.xxhash64(F.bit_xor(child), F.sum(F.shiftrightunsigned(child, 20)), F.count("*")).alias("hash"), F.sum("files").alias("files"), F.sum("chars").alias("chars")
            )
        )
        done = below if done is None else done.unionByName(below)
    if done is None:
        return facts.sparkSession.createDataFrame([], "owner string, server string, root string, dir string, hash bigint, files bigint, chars bigint")
    return done.withColumnRenamed("path", "dir")


def _shared(rows: DataFrame) -> DataFrame:
    """Hashes that stand under two owners; minimum and maximum instead of a set keep the state small."""
    return rows.groupBy("hash", "chars").agg(F.min("owner").alias("a"), F.max("owner").alias("z")).where("a <> z").select("hash", "chars")


def classify(df: DataFrame, chars: int = MIN_CHARS, tree_chars: int = MIN_TREE_CHARS) -> DataFrame:
    """(file_id, found): generated, minified, data or vendored for each file that isn't hand-written source."""
    facts = checkpoint(file_facts(df))
    shared_files = _shared(facts.where(F.col("chars") >= chars))  # a row per content, so a hot content is split on the other side alone
    by_file = facts.where(F.col("found").isNull()).join(shared_files, ["hash", "chars"], "left_semi").select("file_id", F.lit("vendored").alias("found"))
    trees = merkle_directories(facts).where((F.col("files") >= 2) & (F.col("chars") >= tree_chars))
    shared_trees = trees.join(_shared(trees), ["hash", "chars"], "left_semi").select("server", "root", "dir").distinct()
    parts = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.array_join(F.slice("p", 1, i), "/"))
    inside = facts.where(F.col("found").isNull()).select("file_id", "server", "root", F.split("path", "/").alias("p")).select("file_id", "server", "root", F.explode(parts).alias("dir"))
    by_tree = inside.join(shared_trees, ["server", "root", "dir"], "left_semi").select("file_id", F.lit("vendored").alias("found"))
    own = facts.where(F.col("found").isNotNull()).select("file_id", "found")
    return own.unionByName(by_file).unionByName(by_tree).distinct()
