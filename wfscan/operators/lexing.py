"""Positions that no regular expression finds safely: comment spans, brace blocks and quote context, as Arrow functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STOPS = {
    "code": re.compile(r"//[^\n]*|/\*|['\"`]"),
    "'": re.compile(r"\\.|'", re.S),
    '"': re.compile(r'\\.|"', re.S),
    "`": re.compile(r"\\.|`|\$\{", re.S),
    "expr": re.compile(r"'(?:\\.|[^'\\])*(?:'|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)|//[^\n]*|/\*.*?(?:\*/|\Z)|\}", re.S),
}


def comment_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the comments of a script.

    Strings may run over lines; a block comment without an end has no span; inside a template's expression comments have none either,
    and the first closing brace ends it.
    """
    spans: list[tuple[int, int]] = []
    if not text:
        return spans
    mode, at = "code", 0
    while m := _STOPS[mode].search(text, at):
        found, at = m[0], m.end()
        if mode == "code":
            if found[:2] == "//":
                spans.append(m.span())
            elif found == "/*":
                end = text.find("*/", at)
                if end < 0:
                    break
                at = end + 2
                spans.append((m.start(), at))
            else:
                mode = found
        elif mode == "expr":
            mode = "`" if found == "}" else mode
        elif found == mode:
            mode = "code"
        elif found == "${":
            mode = "expr"
    return spans


_SPANS = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))


@F.pandas_udf(_SPANS)
def comment_spans_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"s": a, "e": b} for a, b in comment_spans(t)])


def block_end(text: str, start: int, most: int = 2000, fallback: int = 800) -> int:
    """Where the brace block around a field ends: at the brace that closes it, else after a fixed length."""
    window = text[start : start + most]
    depth = 0
    for m in re.finditer(r"[{}]", window):
        depth += 1 if m[0] == "{" else -1
        if m[0] == "}" and depth <= 0 and m.start() > 0:
            return start + m.end()
    return start + min(len(window), fallback)


@F.pandas_udf(T.ArrayType(T.StringType()))
def blocks_at(text: pd.Series, at: pd.Series) -> pd.Series:
    """For each position of an array the text from there to the end of its brace block."""
    return pd.Series([None if t is None or p is None else [t[int(i) : block_end(t, int(i))] for i in p] for t, p in zip(text, at, strict=True)])


def inside_quotes(text: str, at: int, reach: int = 300) -> bool:
    """Whether the position lies in quotes: the nearest quote before it, within reach, closes after it."""
    left = max(0, at - reach)
    window = text[left : at + reach]
    opened = max(window.rfind('"', 0, at - left), window.rfind("'", 0, at - left))
    if opened < 0:
        return False
    closed = window.find(window[opened], opened + 1)
    return closed >= 0 and opened < at - left < closed


def ui_text_positions(pattern: str):
    """A function telling for each position of an array whether it is interface text: an interface key nearby, and quotes around it."""
    keys = re.compile(pattern, re.I)

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def f(text: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or p is None else [bool(keys.search(t[max(0, int(i) - 300) : int(i) + 300])) and inside_quotes(t, int(i)) for i in p] for t, p in zip(text, at, strict=True)])

    return f


def in_spans(pos: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["s"] <= pos) & (pos < s["e"]))
