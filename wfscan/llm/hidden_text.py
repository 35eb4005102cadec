"""Problem 1: natural language inside source code - comments and string literals, their languages and their share of a file.

A lexer that knows the comment and string forms of each kind of file yields spans; wrapped line comments are one span. What is left
of a span without marks, tags, placeholders and identifiers must have `words` words, or `chars` characters in a script without spaces
(both parameters; the cases of p1_found are defined by four and eight). Its language is the one whose model compresses it best:
prediction by partial matching, a context tree per language with the longest known context first and escapes to shorter ones.
Languages of other scripts aren't asked. A span above MAX_BITS a character under every model is undetermined and gives no case.

The models are trained on labelled rows of a documents table, a bounded sample whose bounds are parameters: at most SAMPLE_ROWS rows a
language, SAMPLE_TEXT characters of each, SAMPLE_CHARS in all; rows are taken by the hash of their id. Labels in any notation count by
their first two letters; rows whose script contradicts the label are left out. All files are scanned whole, map-only.

Results: null and empty texts give nothing; a text without delimiters is itself a span, since only the inside may have been kept.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wfscan.llm.common import cached, map_arrow

MIN_WORDS, MIN_CHARS = 4, 8
ORDER = 4
SAMPLE_ROWS, SAMPLE_TEXT, SAMPLE_CHARS = 120, 2000, 60_000
MAX_BITS, MAX_BITS_WIDE = 4.5, 9.0  # the second for scripts of thousands of signs

_STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
_MARKUP = r"<!--.*?(?:-->|\Z)"
_TRIPLE = r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''"
_C_LIKE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|" + _MARKUP + "|" + _STRING, re.S)
_HASH = re.compile(r"#[^\n]*|" + _TRIPLE + "|" + _STRING, re.S)
_ANY = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|(?<![^\s;{}])#[^\n]*|(?<![^\s;])--(?=[ \t]+[^\W\d_])[^\n]*|" + _MARKUP + "|" + _TRIPLE + "|" + _STRING, re.S)
# Comment forms of other languages, and the files that have them.
_FORMS = (
    (_HASH, (".py", ".pyi", ".rb", ".sh", ".bash", ".zsh", ".env", ".local", ".yml", ".yaml", ".conf", ".cfg", ".toml", ".properties", ".r", ".pl", ".tf", ".ps1", ".jl", ".ex", ".exs", ".mk", "dockerfile", "makefile", "gemfile", "rakefile", ".gitignore", ".dockerignore")),
    (re.compile(r"--\[\[.*?(?:\]\]|\Z)|\{-.*?(?:-\}|\Z)|/\*.*?(?:\*/|\Z)|--[^\n]*|" + _STRING, re.S), (".sql", ".lua", ".hs", ".elm", ".ads", ".adb", ".vhd", ".vhdl", ".applescript")),
    (re.compile(r"[;#][^\n]*|" + _STRING, re.S), (".ini", ".inf", ".reg")),
    (re.compile(r";[^\n]*|\"(?:[^\"\\]|\\.)*\"", re.S), (".lisp", ".lsp", ".cl", ".el", ".clj", ".cljs", ".scm", ".rkt", ".asm")),
    (re.compile(r"%[^\n]*|\"(?:[^\"\\\n]|\\.)*\"", re.S), (".tex", ".sty", ".erl", ".hrl")),
    (re.compile(r"\(\*.*?(?:\*\)|\Z)|//[^\n]*|" + _STRING, re.S), (".ml", ".mli", ".fs", ".fsx", ".pas", ".sml")),
    (re.compile(r"(?im)^[ \t]*(?:rem\b|::)[^\n]*|\"[^\"\n]*\""), (".bat", ".cmd")),
    (re.compile(r"<!--.*?(?:-->|\Z)|" + _STRING, re.S), (".html", ".htm", ".xml", ".svg", ".xhtml", ".md", ".markdown")),
)
_BLOCKS = (("/*", "*/"), ("<!--", "-->"), ("--[[", "]]"), ("{-", "-}"), ("(*", "*)"))
_LINE_MARK = re.compile(r"\s*(?:rem\b|::|//+|#+|--+|;+|%+)", re.I)
_ESCAPE = re.compile(r"\\u\{([0-9a-fA-F]{1,6})\}|\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\([nrtbfv0'\"`\\/])")
_TAGS = re.compile(r"\$?\{[^{}]*\}|%[sdif]|<[^<>]{1,80}>|&#?\w{1,8};|@(?:param|returns?|type|throws|see|link|typedef|property)[^\n]*|:(?:param|returns?|type|rtype|raises)[^\n]*|https?://\S+|(?<!\w)\w{1,64}@[\w.]+")
_MARGIN = re.compile(r"(?m)^[ \t]*(?:\*+|//+|#+)[ \t]?")
_SQL = re.compile(r"(?is)^\W*(?:select\b.*\bfrom\b|insert\s+into\b|update\b.*\bset\b|delete\s+from\b|create\s+(?:table|index|view)\b|alter\s+table\b|with\b.*\bas\s*\()")
_WORD = re.compile(r"^[\"'“”„«»‘’(\[¿¡*_-]*([^\W\d_]+(?:['’·-][^\W\d_]+)*)[.,;:!?…)\]\"'“”»’*_。、！？।-]*$")
_CAMEL = re.compile(r"[a-z][A-Z]|^[A-Z]{2,}[a-z]|[A-Za-z]\d")
_CODE_LINE = re.compile(r"[;{}]\s*(?://.*|#.*)?$|^\s*[\w$.\[\]]+\s*(?:\(.*\)|[-+*/|&?]{0,3}=\s*\S.*)\s*(?://.*|#.*)?$")
_UNSPACED = re.compile(r"[぀-ヿ㐀-䶿一-鿿ｦ-ﾟ฀-๿຀-໿က-႟ក-៿]")
_IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_$./-])(?:[A-Za-z0-9_$./-]*(?:[a-z][A-Z]|\d)[A-Za-z0-9_$./-]*|[A-Za-z]+(?:[_.][A-Za-z]+)+)")
# Unicode blocks by script.
_SCRIPTS = {"kana": r"[぀-ヿｦ-ﾟ]", "han": r"[㐀-䶿一-鿿]", "cyrillic": r"[Ѐ-ӿ]", "deva": r"[ऀ-ॿ]", "thai": r"[฀-๿]", "hangul": r"[가-힯]", "arabic": r"[؀-ۿ]", "greek": r"[Ͱ-Ͽ]", "hebrew": r"[֐-׿]", "latin": r"[A-Za-zÀ-ɏ]"}
_SCRIPT_RX = {k: re.compile(v) for k, v in _SCRIPTS.items()}
_NON_LATIN = re.compile(r"[^\x00-\u036f\u1e00-\u2bff]")


def script_of(text: str) -> str:
    """The script of most letters; any kana makes Japanese, and letters of another script beat Latin from a quarter on."""
    if not _NON_LATIN.search(text):
        return "latin"
    n = {k: len(rx.findall(text)) for k, rx in _SCRIPT_RX.items()}
    latin = n.pop("latin")
    best = max(n, key=n.get)
    if n["kana"] and n["kana"] + n["han"] >= max(n.values()):
        best = "kana"
    return best if n[best] * 3 + (n["han"] if best == "kana" else 0) > latin else "latin"


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2] or m[3]
    if code:
        v = int(code, 16)
        return chr(v) if v < 0x110000 and not 0xD800 <= v < 0xE000 else " "
    return {"n": "\n", "r": " ", "t": " ", "b": " ", "f": " ", "v": " ", "0": " "}.get(m[4], m[4])


def lexer_of(name: str | None) -> re.Pattern:
    """The comment and string forms of a file by its name; those of scripts where the name tells nothing, all common ones without a name."""
    if not name:
        return _ANY
    low = name.lower()
    return next((rx for rx, ends in _FORMS if low.endswith(ends)), _C_LIKE)


def spans(text: str, name: str | None, chars: int = MIN_CHARS) -> list[tuple[int, int, str]]:
    """(start, end, inside) of each comment and string literal; line comments on successive lines are joined."""
    out: list[tuple[int, int, str]] = []
    joined, run = -1, []
    for m in lexer_of(name).finditer(text):
        a, b = m.span()
        t = m[0]
        block = next(((x, y) for x, y in _BLOCKS if t.startswith(x)), None)
        if block:
            inside = t[len(block[0]) : -len(block[1])] if t.endswith(block[1]) and len(t) >= len(block[0]) + len(block[1]) else t[len(block[0]) :]
        elif t[0] not in "\"'`":
            mark = t[:2]
            body = t.lstrip("/#! \t") if mark[0] == "#" else t[2:] if mark == "//" else t[_LINE_MARK.match(t).end() :]
            if _CODE_LINE.search(body):
                continue
            if run and not text[joined:a].strip() and text.count("\n", joined, a) <= 1 and not text[text.rfind("\n", 0, a) + 1 : a].strip():
                run[2] += "\n" + body
                run[1] = joined = b
            else:
                if run:
                    out.append(tuple(run))
                run, joined = [a, b, body], b
            continue
        elif t[:3] in ('"""', "'''") and len(t) >= 6:
            inside = t[3:-3]
        else:
            inside = t[1:-1]
        if len(inside) >= chars and (" " in inside or not inside.isascii() or "\\u" in inside):
            out.append((a, b, inside))
    if run:
        out.append(tuple(run))
    return out


def natural_text(inside: str, words: int = MIN_WORDS, chars: int = MIN_CHARS) -> str | None:
    """The span as plain text, or null if it is too short or not made of words."""
    if len(inside) < chars:
        return None
    t = _ESCAPE.sub(_unescape, inside) if "\\" in inside else inside
    t = _TAGS.sub(" ", _MARGIN.sub("", t)).strip()
    if len(t) < chars or _SQL.match(t):
        return None
    unspaced = len(_UNSPACED.findall(t)) if not t.isascii() else 0
    if unspaced >= chars:
        return t
    tokens = t.split()
    found = [m[1] for x in tokens if (m := _WORD.match(x)) and not _CAMEL.search(m[1])]
    real = [w for w in found if len(w) > 1 or w.lower() in "aieoyàéвскуяио"]
    if len(found) < words or len(real) < 0.5 * len(tokens):
        return None
    return t


class ContextTree:
    """Symbol counts by context of up to ORDER characters, for one language."""

    def __init__(self) -> None:
        self.seen: dict[str, dict[str, int]] = defaultdict(dict)
        self.total: Counter = Counter()

    def train(self, text: str) -> None:
        t = " " * ORDER + text
        for i in range(ORDER, len(t)):
            c = t[i]
            for k in range(ORDER + 1):
                ctx = t[i - k : i]
                d = self.seen[ctx]
                d[c] = d.get(c, 0) + 1
                self.total[ctx] += 1

    def bits(self, gram: str) -> float:
        """Code length of the last character after the others: escape method C down to the first context that knows it."""
        c, cost = gram[-1], 0.0
        for k in range(len(gram) - 1, -1, -1):
            d = self.seen.get(gram[len(gram) - 1 - k : -1])
            if d is None:
                continue
            n, kinds = self.total[gram[len(gram) - 1 - k : -1]], len(d)
            if c in d:
                return cost - math.log2(d[c] / (n + kinds))
            cost -= math.log2(kinds / (n + kinds))
        return cost + 10.0  # a character that no training text has


def plain(text: str) -> str:
    """What the models see: lower case, single spaces, one sign for numbers and identifiers."""
    return " ".join(_IDENTIFIER.sub("#", unicodedata.normalize("NFC", text)).lower().split())


class LanguageModels:
    MEMO = 300_000

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        self.trees = {}
        self.scripts: dict[str, list[int]] = defaultdict(list)
        for n, lang in enumerate(self.languages):
            tree = self.trees[lang] = ContextTree()
            for t in texts[lang]:
                tree.train(plain(t))
            self.scripts[script_of(" ".join(texts[lang]))].append(n)
        self.reset()

    def reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.matrix = np.zeros((1024, len(self.languages)))

    def row(self, gram: str) -> int:
        """The row of the matrix with the bits of the gram's last character under every model."""
        k = self.memo[gram] = len(self.memo)
        if k == len(self.matrix):
            self.matrix = np.vstack([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[k] = [self.trees[lang].bits(gram) for lang in self.languages]
        return k

    def identify(self, text: str) -> tuple[str | None, float]:
        """The language and its bits a character; null if every model of the script finds the text too strange."""
        script = script_of(text)
        among = self.scripts.get(script) or (self.scripts.get("han", []) + self.scripts.get("kana", []) if script in ("han", "kana") else [])
        if not among:
            return None, float("inf")
        t = " " * ORDER + plain(text)
        n = len(t) - ORDER
        if n <= 0:
            return None, float("inf")
        if len(self.memo) > self.MEMO:
            self.reset()
        memo, at = self.memo, []
        for i in range(n):
            gram = t[i : i + ORDER + 1]
            k = memo.get(gram)
            at.append(self.row(gram) if k is None else k)
        cost = self.matrix[at].sum(axis=0) / n
        best = min(among, key=lambda j: cost[j])
        most = MAX_BITS_WIDE if script in ("han", "kana", "hangul") else MAX_BITS
        return (self.languages[best] if cost[best] <= most else None), float(cost[best])


def training_texts(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, text: int = SAMPLE_TEXT) -> dict[str, list[str]]:
    """The bounded sample of labelled rows by language: at most `rows` texts of a language, `text` characters of each and `chars` in all.

    Labels are two letters, so there are at most 676 of them, and what is collected is bounded by that times `chars`.
    """
    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    w = Window.partitionBy("l").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = (
        docs.where(F.length("text") >= 40)
        .select("doc_id", lang.alias("l"), F.substring("text", 1, text).alias("t"))
        .where(F.col("l").rlike("^[a-z]{2}$") & ~F.col("l").isin("un", "xx", "zx"))
        .withColumn("n", F.row_number().over(w))
        .where(F.col("n") <= rows)
        .withColumn("before", F.sum(F.length("t")).over(Window.partitionBy("l").orderBy("n")) - F.length("t"))
        .where(F.col("before") < chars)
    )
    out: dict[str, list[str]] = defaultdict(list)
    for r in sample.select("l", "t").collect():
        out[r.l].append(r.t)
    # a label's script is that of most of its rows; paragraphs in another script or a lone wrong label teach nothing
    clean = {}
    for lang_, texts in out.items():
        script = Counter(map(script_of, texts)).most_common(1)[0][0]
        kept = [p for t in texts for p in re.split(r"\n\s*\n", t) if script_of(p) == script and len(p) >= 20]
        if sum(map(len, kept)) >= 400:
            clean[lang_] = kept
    return _without_wrong_labels(clean)


def _without_wrong_labels(texts: dict[str, list[str]]) -> dict[str, list[str]]:
    """Paragraphs that another language's model, trained on the dirty labels, codes shorter are dropped."""
    first = LanguageModels(texts)
    return {lang: [p for p in ps if first.identify(p)[0] in (lang, None)] or ps for lang, ps in texts.items()}


def _models(docs: DataFrame) -> tuple[str, object]:
    trained = LanguageModels(training_texts(docs))
    return f"ppm:{uuid.uuid4()}", docs.sparkSession.sparkContext.broadcast(trained)  # bounded by SAMPLE_CHARS a language


SPANS = "row_id bigint, span_start bigint, span_len bigint, lang string, text string, n_chars bigint"


def find_text(df: DataFrame, id_col: str, text_col: str, name_col: str | None, models: tuple[str, object], words: int = MIN_WORDS, chars: int = MIN_CHARS) -> DataFrame:
    """(row_id, span_start, span_len, lang, text, n_chars): each span that is natural language; lang is null if undetermined."""
    key, held = models
    name = F.col(name_col) if name_col else F.lit(None).cast("string")

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        m: LanguageModels = cached(key, lambda: held.value)
        out: list[tuple] = []
        known: dict[str, str | None] = {}
        for i, text, file in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if not text:
                continue
            found = False
            for a, z, inside in spans(text, file, chars):
                t = natural_text(inside, words, chars)
                if t is None:
                    continue
                found = True
                if t not in known:
                    known[t] = m.identify(t)[0]
                out.append((i, a, z - a, known[t], t, len(text)))
            if not found and file is None and (t := natural_text(text, words, chars)) is not None:
                out.append((i, 0, len(text), m.identify(t)[0], t, len(text)))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["row_id", "span_start", "span_len", "lang", "text", "n_chars"])

    return map_arrow(df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("text"), name.alias("name")), kernel, SPANS)


def text_languages(files: DataFrame, findings: DataFrame, docs: DataFrame) -> DataFrame:
    """(origin, row_id, lang): the languages that occur in each file and in each finding."""
    return texts(files, findings, docs).where("lang is not null").select("origin", "row_id", "lang").distinct()


def texts(files: DataFrame, findings: DataFrame, docs: DataFrame, words: int = MIN_WORDS, chars: int = MIN_CHARS) -> DataFrame:
    """(origin, row_id, span_start, span_len, lang, text, n_chars): each text in a file or a finding, with its language."""
    models = _models(docs)
    a = find_text(files, "file_id", "code", "file_path", models, words, chars).select(F.lit("file").alias("origin"), "*")
    return a.unionByName(find_text(findings, "finding_id", "matched_text", None, models, words, chars).select(F.lit("finding").alias("origin"), "*"))


def _shares(found: DataFrame, *key: str) -> DataFrame:
    g = found.groupBy(*key, F.coalesce("lang", F.lit("und")).alias("lang")).agg(F.count("*").alias("n_spans"), F.sum("span_len").alias("chars"), F.max("n_chars").alias("n"))
    return g.select(*key, "lang", "n_spans", "chars", (F.col("chars") / F.col("n")).alias("share"))


def file_shares(files: DataFrame, docs: DataFrame, words: int = MIN_WORDS, chars: int = MIN_CHARS) -> DataFrame:
    """(row_id, lang, n_spans, chars, share): the part of each file's characters that each language takes; 'und' is undetermined."""
    return _shares(find_text(files, "file_id", "code", "file_path", _models(docs), words, chars), "row_id")


def text_shares(files: DataFrame, findings: DataFrame, docs: DataFrame, words: int = 2, chars: int = 4) -> DataFrame:
    """(origin, row_id, lang, n_spans, chars, share) of files and findings; short remarks count: two words, or four characters without spaces."""
    return _shares(texts(files, findings, docs, words, chars), "origin", "row_id")
