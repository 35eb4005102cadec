"""Text expressions that stay inside code generation: all matches with offsets, lines, snippets, windows, cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# English and domain stop-words of the topic miner.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "if", "in", "on", "at", "to", "for", "from", "of", "by", "with", "as", "is", "are", "was", "were", "be",
    "been", "being", "do", "does", "did", "doing", "have", "has", "had", "this", "that", "these", "those", "it", "its", "they", "them", "their",
    "you", "your", "i", "we", "our", "can", "could", "should", "would", "may", "might", "must", "will", "shall", "about", "into", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other",
    "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "e.g", "eg", "etc", "via", "per", "node", "workflow",
    "workflows", "issue", "help", "thanks", "hi", "hello", "please", "http", "https", "www", "com", "json", "api", "error", "errors", "problem",
    "question",
]


def all_matches(text: Column, pattern: str) -> Column:
    """array<struct<pos,match>>: every match with its 0-based offset; the pattern must not match the empty string.

    Built from the matches and the pieces between them, both native: start i is what pieces up to i and matches before i add up to.
    """
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    p = F.split(text, pattern, -1)
    start = lambda i: F.aggregate(F.slice(p, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(m, 1, i), F.lit(0), lambda a, x: a + F.length(x))
    return F.transform(m, lambda x, i: F.struct(start(i).alias("pos"), x.alias("match")))


def line_of(text: Column, pos: Column) -> Column:
    """1-based line of a 0-based offset: line feeds before it, plus one."""
    head = F.substring(text, F.lit(1), pos)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def lines_around(text: Column, line: Column, before: int, after: int) -> Column:
    """The lines from `before` above to `after` below a line, clamped to the text, as one string."""
    lines = F.split(text, "\n", -1)
    first = F.greatest(F.lit(1), line - before)
    last = F.least(F.size(lines), line + after)
    return F.array_join(F.slice(lines, first, F.greatest(F.lit(0), last - first + 1)), "\n")


def is_comment_line(line: Column) -> Column:
    return line.rlike(r"^\s*(//|#|\*|/\*)")


def any_match(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def contains_any(text: Column, words: list[str]) -> Column:
    """Case-insensitive substring test against a fixed list."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in words])


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")


def truncated(text: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def clean_html(raw: Column) -> Column:
    """Readable lower-case words of an HTML text: code blocks, tags, addresses and punctuation removed, entities decoded last."""
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?is)<(script|style|pre|code)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"(https?://|www\.)\S+", " ")
    t = F.regexp_replace(t, r"[0-9A-Za-z_.-]+@[0-9A-Za-z_.-]+\.[0-9A-Za-z_]+", " ")
    t = F.regexp_replace(t, r"[^0-9A-Za-z一-鿿_-]+", " ")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def useful_tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Tokens of two characters or more that are neither numbers nor stop-words."""
    words = F.array(*[F.lit(w) for w in (stop or STOP_WORDS)])
    return F.filter(F.split(text, " "), lambda x: (F.length(x) > 1) & ~x.rlike("^[0-9]+$") & ~F.array_contains(words, x))


def non_blank(*columns: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])
