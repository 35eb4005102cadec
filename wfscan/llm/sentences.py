"""Problem 10: sentences of texts in any language and script.

Blank lines end a unit always; a heading or list item is a unit with its marker. In the rest every character is either inside or a
boundary. Only characters after an end mark and its closing signs, and in scripts without end marks the spaces, can be boundaries at
all; for all others the tag 'inside' is fixed, so the chain of tags is decoded over those candidates alone. A linear-chain model
scores each tag by features of the candidate (mark, word before, what follows, open quotes and brackets) and each pair of
neighbouring tags; Viterbi decoding finds the best chain of a segment.

Weights are learned by the averaged perceptron from a bounded sample of the corpus, for each script apart: SAMPLE_ROWS documents by the
hash of their id, SAMPLE_CHARS characters of each. They are learned from the tags that are certain: block ends, marks inside words and
numbers, abbreviations, marks before plain continuations, and so on; uncertain candidates teach nothing. For scripts without end marks
the model is trained on text stripped of punctuation: block ends are certain sentence ends there, and what stands before them is what
the tagger learns to see before spaces. The words that begin blocks in lower case, and the ends of blocks in scripts without end marks,
are counted over all documents; what counts as common is a share of them, so it is the same at every size.

Map-only but for these counts and the sample. Results: null, empty and blank texts have no sentence; repeated documents give their rows again; offsets
and lengths are in Unicode code points.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wfscan.llm.common import cached, map_arrow
from wfscan.session import checkpoint

SAMPLE_ROWS, SAMPLE_CHARS, ROUNDS, MARGIN = 400, 3000, 8, 3.0
STARTER_SHARE, END_SHARE = 0.001, 0.01  # of documents that a word begins a block in, and of a script's blocks that have an end

_BLANK = re.compile(r"\r?\n[^\S\n]*(?:\r?\n[^\S\n]*)+|[\u2029\f]+")
_MARKER = re.compile(r"[^\S\n]*(?:#{1,6}[^\S\n]+|[-*+•‣▪◦·–—][^\S\n]+|\(?\d{1,3}[.)][^\S\n]+|[a-zA-Z]\)[^\S\n]+|[①-⑳])")
_HEADING = re.compile(r"[^\S\n]*#{1,6}[^\S\n]+")
_OPEN, _CLOSE = "“«「『(（[【„‹〈《", "”»」』)）]】”›〉》"
_PAIR = dict(zip(_OPEN, _CLOSE, strict=True)) | {"„": "“”"}
_OPENERS = {c: [o for o, ends in _PAIR.items() if c in ends] for c in {*_CLOSE, "“"}} | {'"': ['"']}  # what each closing sign may close
_ENCLOSING = re.compile(r"[“”«»「」『』()（）\[\]【】„‹›〈〉《》\"]")
_MARKS = re.compile(r"(?:\.{2,}|…+|[.!?。！？．｡।॥؟۔።‼⁇⁈⁉])+[!?！？.。…]*(?:[ \u00a0\u202f]+[!?]+(?![\w¿¡]))?")
_CLOSERS = re.compile(r"(?:[”\"』」)）\]】»’›〉》*_]|[^\S\n]»)*")
_UNSPACED = "฀-๿຀-໿က-႟ក-៿"
_GAP = re.compile(rf"(?<=[{_UNSPACED}])\s+(?=\S)|(?<=\S)\s+(?=[{_UNSPACED}])")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿ｦ-ﾟ가-힯]")
_WORD_BACK = re.compile(r"[^\s“”«»「」『』()（）\[\]\"„…]*")  # of the text before a mark, reversed
_WORD_AFTER = re.compile(r"[\s“«「『(（\[„\"'‘¿¡—–-]*([^\W\d_]+|\d+|\S)?")
# Abbreviations that don't end a sentence, ones that may, and names of months, in the languages at hand.
ABBREVIATIONS = set(
    [
    "mr", "mrs", "ms", "dr", "prof", "st", "jr", "sr", "sra", "srta", "vs", "no", "nos", "nr", "fig", "figs", "sec", "secs", "ch", "chap", "vol",
    "vols", "pp", "ed", "eds", "approx", "ca", "cca", "dept", "est", "ext", "gen", "gov", "hon", "rep", "rev", "sen", "sgt", "capt", "col", "lt",
    "cmdr", "maj", "mt", "e.g", "i.e", "eg", "ie", "cf", "viz", "al", "resp", "incl", "excl", "max", "min", "avg", "temp", "tel", "jan", "feb",
    "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec", "mon", "tue", "wed", "thu", "fri", "sat", "sun", "z.b", "d.h", "u.a",
    "o.ä", "bzw", "evtl", "ggf", "hr", "hrn", "fr", "frl", "str", "abs", "art", "bsp", "dipl", "ing", "inkl", "exkl", "jh", "mio", "mrd", "nachm",
    "vorm", "sog", "usf", "vgl", "zzgl", "zz", "abt", "allg", "env", "p.ex", "c.-à-d", "av", "bd", "mme", "mlle", "mm", "apr", "déc", "janv", "févr",
    "juil", "p.ej", "ej", "ee.uu", "núm", "pág", "págs", "aprox", "dña", "ud", "uds", "vd", "vds", "exmo", "ilmo", "tfno", "depto", "ex", "av",
    "dra", "sras", "т.е", "т.к", "т.д", "т.п", "г-н", "г-на", "г-жа", "др", "проф", "ул", "рис", "см", "напр", "тыс", "млн", "млрд", "руб", "гг",
    "вв", "стр", "डॉ", "श्री", "प्रो",
]
)
MAY_END = set([
    "etc", "usw", "inc", "ltd", "co", "corp", "llc", "plc", "gmbh", "a.m", "p.m", "am", "pm", "u.s", "u.k", "ph.d", "b.c", "a.d", "и", "т.д", "т.п",
    "др",
])
MONTHS = set(
    [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "januar", "jänner",
    "februar", "märz", "mai", "juni", "juli", "oktober", "dezember", "janvier", "février", "mars", "avril", "juin", "juillet", "août", "septembre",
    "octobre", "novembre", "décembre", "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre",
    "noviembre", "diciembre", "janeiro", "fevereiro", "março", "maio", "junho", "julho", "setembro", "outubro", "novembro", "dezembro", "января",
    "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря",
]
)
CONTINUES = set([
    "and", "or", "but", "then", "nor", "so", "yet", "because", "und", "oder", "aber", "dann", "et", "ou", "mais", "puis", "donc", "y", "o", "pero",
    "luego", "e", "mas", "então", "depois", "и", "или", "но", "а", "затем", "to", "with", "für", "mit", "avec", "con", "com",
])


def blocks(text: str):
    """(start, end) of the stretches between blank lines."""
    at = 0
    for m in _BLANK.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def segments(text: str):
    """(start, end, whole): list items and headings as wholes, other text as stretches to be tagged."""
    for a, z in blocks(text):
        start, line = a, a
        whole = False
        while line < z:
            end = text.find("\n", line, z)
            end = z if end < 0 else end + 1
            if _MARKER.match(text, line, end):
                if line > start:
                    yield start, line, whole
                start, whole = line, True
                if _HEADING.match(text, line, end):
                    yield line, end, True
                    start, whole = end, False
            elif whole and (m := _MARKS.search(text, start, line)) and not text[m.end() : line].strip(" \t\r\n”\"»」』)）]】’*_") and _last_mark_ends(text, start, line):
                yield start, line, True
                start, whole = line, False
            line = end
        if start < z:
            yield start, z, whole


def _last_mark_ends(text: str, a: int, b: int) -> bool:
    return bool(re.search(r"[.!?。！？…।॥؟][”\"»」』)）\]】’*_]*\s*$", text[a:b]))


class Candidate:
    """A place where a sentence may end: what is seen there (`facts`, of few values each), the words around it, and the tag if it is sure."""

    __slots__ = ("at", "facts", "word", "next", "gap", "sure")

    def __init__(self, at: int, facts: tuple, word: str, next_: str, gap: list[str] | None, sure: int | None):
        self.at, self.facts, self.word, self.next, self.gap, self.sure = at, facts, word, next_, gap, sure

    @property
    def features(self) -> list[str]:
        return self.gap if self.gap is not None else [*facts_features(self.facts), self.word, self.next]


def facts_features(facts: tuple) -> list[str]:
    kind, what, space, inner, closed, leads, abbr, may, digit, begins, month, go = facts
    return [
        f"k={kind}", f"k={kind}|n={what}", f"k={kind}|n={what}|s={space}", f"s={space}",
        f"in={inner}", f"closed={closed}|lead={leads}|n={what}", f"abbr={abbr}|k={kind}|n={what}", f"may={may}|k={kind}|n={what}", f"digit={digit}|n={what}|k={kind}",
        f"begins={begins}|k={kind}|n={what}", f"begins={begins}|abbr={abbr}|may={may}|n={what}", f"month={month}", f"go={go}|k={kind}",
    ]


class Enclosures:
    """Matching pairs of quotes and brackets of a segment; openers without a partner count for nothing."""

    def __init__(self, s: str):
        stack: list[tuple[str, int]] = []
        open_: dict[str, list[int]] = defaultdict(list)  # for each opening sign where it stands in the stack
        pairs: list[tuple[int, int]] = []
        for m in _ENCLOSING.finditer(s):
            c, i = m[0], m.start()
            k = -1
            if c == '"' or c in _CLOSE or c == "“" and stack and stack[-1][0] == "„":
                k = max((open_[o][-1] for o in _OPENERS.get(c, ()) if open_[o]), default=-1)
            if k >= 0:
                pairs.append((stack[k][1], i))
                for o, _ in stack[k:]:
                    open_[o].pop()
                del stack[k:]
            elif c == '"' or c in _OPEN:
                open_[c].append(len(stack))
                stack.append((c, i))
        pairs.sort()
        self.opened = [a for a, _ in pairs]
        self.furthest = list(accumulate((b for _, b in pairs), max))
        self.by_close = {b: a for a, b in pairs}
        self.closed = sorted(self.by_close)

    def around(self, at: int, until: int) -> bool:
        """Whether some pair opens before `at` and closes at `until` or later."""
        k = bisect_left(self.opened, at)
        return k > 0 and self.furthest[k - 1] >= until

    def closing(self, a: int, b: int) -> list[int]:
        """Where the pairs open that close from a to before b."""
        return [self.by_close[c] for c in self.closed[bisect_left(self.closed, a) : bisect_left(self.closed, b)]]


def candidates(s: str, starters: frozenset[str] = frozenset(), learn: bool = True) -> list[Candidate]:
    """Where a sentence of the segment may end, with features and, to learn from, the tag where it is certain.

    `starters` are words in lower case that blocks of the sample begin with: names of tools and the like.
    """
    out: list[Candidate] = []
    pairs = Enclosures(s)
    end = len(s.rstrip())
    cased = s != s.lower()
    for m in _MARKS.finditer(s):
        marks = m[0]
        close = _CLOSERS.match(s, m.end())
        at = close.end()
        # closing signs belong to the sentence only if they close something that is open; a straight quote may open the next one
        while at > m.end() and s[at - 1] == '"' and at - 1 not in pairs.by_close:
            at -= 1
        if s[at : at + 1] == "“" and at in pairs.by_close:
            at += 1
        word = _WORD_BACK.match(s[max(0, m.start() - 40) : m.start()][::-1])[0][::-1].strip("'’*_¿¡-").lower()
        after = _WORD_AFTER.match(s, at)
        nxt = after[1] or ""
        gap = s[at : at + 1]
        last = at >= end
        inner = pairs.around(m.start(), at)
        closed = pairs.closing(m.end(), at)
        leads = bool(closed) and not _lead(s, min(closed))
        begins = what_begins(s, at, nxt, starters, cased)
        kind = "dots" if marks[0] == "…" or marks[:2] == ".." else "stop" if set(marks) <= {"."} else "danda" if marks[0] in "।॥" else "wide" if marks[0] in "。！？．｡" else "mark"
        what = "end" if last else "upper" if nxt[:1].isupper() else "lower" if nxt[:1].islower() else "digit" if nxt[:1].isdigit() else "cjk" if _CJK.match(nxt or " ") else "letter" if nxt[:1].isalpha() else "other"
        space = "end" if last else "none" if gap and not gap.isspace() else "line" if "\n" in s[at : at + 2] else "space"
        abbr = word in ABBREVIATIONS or word.replace(" ", "") in ABBREVIATIONS or len(word) == 1 and word.isalpha() and not _CJK.match(word) or bool(re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", word)) and word not in MAY_END
        unit = len(word) == 1 and bool(re.search(r"\d\s?\w$", s[max(0, m.start() - 6) : m.start()]) or re.search(r"\bт\.\s?[дп]$", s[max(0, m.start() - 6) : m.start()]))
        may = word in MAY_END or unit
        facts = (kind, what, space, inner, bool(closed), leads, abbr, may, word[-1:].isdigit(), begins, word.isdigit() and nxt.lower() in MONTHS, nxt.lower() in CONTINUES)
        sure = _sure(kind, word, abbr, may, nxt, what, space, inner, closed, leads, s, m.start(), at, begins) if learn else None
        out.append(Candidate(at, facts, f"w={word[-12:]}|k={kind}" if len(word) <= 12 else "w=long", f"next={nxt.lower()[:10]}|k={kind}" if what == "lower" else "next=other", None, sure))
    if not s.isascii() and re.search(rf"[{_UNSPACED}]", s):
        known = {c.at for c in out}
        for m in _GAP.finditer(s):
            at = m.start()
            if at in known or pairs.around(at, at):
                continue
            left, right = s[max(0, at - 5) : at], s[m.end() : m.end() + 4]
            bare = re.sub(r"[^\wั-๎]+", "", left)
            f = ["gap", *(f"l{k}={bare[-k:]}" for k in range(1, 6)), *(f"r{k}={right[:k]}" for k in range(1, 4))]
            out.append(Candidate(at, (), "", "", f, None))
        out.sort(key=lambda c: c.at)
    return out


def _lead(s: str, opened: int) -> bool:
    """Whether words of the same sentence stand before the opening sign."""
    left = re.sub(r"[\s“«「『(（\[„\"¿¡*_>]+$", "", s[max(0, opened - 400) : opened])
    return bool(left) and not re.search(r"[.!?。！？…।॥؟][”\"»」』)）\]】’*_]*$", left)


def _sure(kind, word, abbr, may, nxt, what, space, inner, closed, leads, s, at, after_at, begins) -> int | None:
    """1 for a certain boundary, 0 for a certain inside, null where only the model can tell."""
    if space == "end":
        return 1
    if inner:
        return 0
    if closed and not leads:  # closes what was opened within the sentence
        return 0 if what in ("lower", "cjk", "letter", "digit", "other") else 1
    if space == "none":
        if kind in ("wide", "danda") or kind == "dots" and what == "cjk":
            return 1
        if closed:
            return 1
        token = re.search(r"\S*$", s[max(0, at - 200) : at])[0]
        if kind == "mark" and what in ("lower", "upper", "cjk", "letter") and not re.search(r"[=&@]|::", token) and not re.match(r"\S*=", s[after_at : after_at + 60]):
            return 1
        return 1 if kind == "dots" and what == "upper" else 0
    if kind in ("wide", "danda", "mark"):
        return 1
    if kind == "dots":
        return 0 if what == "lower" and (nxt.lower() in CONTINUES or not begins) else 1
    if abbr and not may:
        return 0
    if may:
        return 1 if what in ("upper", "other", "cjk") or what == "lower" and begins else 0 if what in ("lower", "digit") else None
    if word.isdigit():
        return 0 if nxt.lower() in MONTHS else 1 if what in ("upper", "cjk", "letter") else None
    if what == "lower":
        return 1 if begins else 0
    return 1 if what in ("upper", "cjk", "letter", "other") else None


def what_begins(s: str, at: int, word: str, starters: frozenset[str], cased: bool) -> bool:
    """Whether a word in lower case may begin a sentence: a name of a tool, or any word where nothing is written in upper case."""
    if not word[:1].islower():
        return True
    return not cased or word in starters or bool(re.match(r"\s*[\w]+(?:[-/@:][\w]+)+", s[at : at + 60]))


class Tagger:
    """Weights of a two-tag linear chain: boundary features, and pairs of neighbouring tags by how far they are apart."""

    def __init__(self) -> None:
        self.w: dict[str, float] = defaultdict(float)
        self.starters: frozenset[str] = frozenset()
        self.memo: dict[tuple, float] = {}  # what facts score together; cleared whenever weights change

    def scores(self, cands: list[Candidate]) -> list[float]:
        w, memo, out = self.w, self.memo, []
        for c in cands:
            if c.gap is not None:
                out.append(sum(w[f] for f in c.gap if f in w))
                continue
            if c.facts not in memo:
                memo[c.facts] = sum(w[f] for f in facts_features(c.facts) if f in w)
            out.append(memo[c.facts] + w.get(c.word, 0.0) + w.get(c.next, 0.0))
        return out

    def decode(self, cands: list[Candidate]) -> list[int]:
        if not cands:
            return []
        score = self.scores(cands)
        w = self.w
        best = (0.0, score[0])
        back: list[tuple[int, int]] = []
        for k in range(1, len(cands)):
            near = "t=near" if cands[k].at - cands[k - 1].at < 4 else "t=far"
            both, one = w.get(near + "|11", 0.0), w.get(near + "|01", 0.0)
            inside = 1 if best[1] > best[0] else 0
            into = 1 if best[1] + both > best[0] + one else 0
            back.append((inside, into))
            best = (max(best), max(best[1] + both, best[0] + one) + score[k])
        tag = 1 if best[1] > best[0] else 0
        tags = [tag]
        for inside, into in reversed(back):
            tag = into if tag else inside
            tags.append(tag)
        tags.reverse()
        return tags

    def train(self, chains: list[list[Candidate]], rounds: int = ROUNDS) -> None:
        """The averaged structured perceptron over the certain tags, with a margin: a tag that is right by too little is learned too."""
        total: dict[str, float] = defaultdict(float)
        step = 1
        rng = np.random.default_rng(7)
        for _ in range(rounds):
            for i in rng.permutation(len(chains)):
                chain = chains[i]
                tags, score = self.decode(chain), self.scores(chain)
                for k, (c, t) in enumerate(zip(chain, tags, strict=True)):
                    if c.sure is not None and (c.sure != t or (score[k] if c.sure else -score[k]) < MARGIN):
                        d = 1.0 if c.sure else -1.0
                        self.memo.clear()
                        for f in c.features:
                            self.w[f] += d
                            total[f] += d * step
                        if k and chain[k - 1].sure is not None:
                            near = "t=near" if c.at - chain[k - 1].at < 4 else "t=far"
                            f = f"{near}|{chain[k - 1].sure}1"
                            self.w[f] += d
                            total[f] += d * step
                step += 1
        self.w = {f: v - total[f] / step for f, v in self.w.items() if v - total[f] / step}
        self.memo.clear()


def gap_chains(texts: list[str], common: frozenset[str] | None = None) -> list[list[Candidate]]:
    """Training chains for scripts without end marks: blocks stripped of punctuation, whose ends show what ends a sentence."""
    found = [text[a:z] for text in texts for a, z, whole in segments(text) if not whole and re.search(rf"[{_UNSPACED}]", text[a:z])]
    if common is None:
        ends = Counter(re.sub(r"[^\w\sั-๎]+", "", s).rstrip()[-3:] for s in found)
        common = frozenset(e for e, n in ends.items() if n >= 3 and n >= END_SHARE * len(found))
    chains = []
    for s in found:
        chain = [c for c in candidates(re.sub(r"[^\w\sั-๎]+", "", s)) if c.gap is not None]
        for c in chain:
            tail = next((f[3:] for f in c.features if f.startswith("l3=")), "")
            c.sure = 1 if tail in common else 0
        if chain:
            chains.append(chain)
    return chains


def train(texts: list[str], starters: frozenset[str] | None = None, common: frozenset[str] | None = None) -> Tagger:
    """A tagger from texts; what begins and ends blocks in the whole corpus is given, or else counted in the texts."""
    tagger = Tagger()
    if starters is None:
        first: Counter = Counter(m[0] for text in texts for a, z, whole in segments(text) if not whole and (m := re.match(r"\s*([a-z]+)(?=\s)", text[a:z])) and any(c.isupper() for c in text[a:z]))
        starters = frozenset(w.strip() for w, n in first.items() if n >= 2)
    tagger.starters = starters
    chains = [c for text in texts for a, z, whole in segments(text) if not whole and (c := candidates(text[a:z], tagger.starters))]
    tagger.train(chains + gap_chains(texts, common))
    return tagger


def sentences(text: str | None, tagger: Tagger) -> list[tuple[int, int]]:
    """(start, length) of each sentence."""
    out: list[tuple[int, int]] = []

    def add(a: int, z: int) -> None:
        piece = text[a:z]
        left = len(piece) - len(piece.lstrip())
        n = len(piece.strip())
        if n:
            out.append((a + left, n))

    if not text:
        return out
    for a, z, whole in segments(text):
        if whole:
            add(a, z)
            continue
        s = text[a:z]
        chain = candidates(s, tagger.starters, learn=False)
        at = 0
        for c, tag in zip(chain, tagger.decode(chain), strict=True):
            if tag and c.at > at:
                add(a + at, a + c.at)
                at = c.at
        add(a + at, z)
    return out


# Scripts that are sampled apart, as Unicode blocks; what has none of them is Latin.
_STRATA = (("thai", "฀-๿"), ("lao", "຀-໿"), ("myanmar", "က-႟"), ("khmer", "ក-៿"), ("kana", "぀-ヿ"), ("hangul", "가-힣"), ("han", "㐀-鿿"), ("deva", "ऀ-ॿ"), ("arabic", "؀-ۿ"), ("hebrew", "֐-׿"), ("cyrillic", "Ѐ-ӿ"), ("greek", "Ͱ-Ͽ"))


def _stratum(text: Column) -> Column:
    """The script of the first letter that is neither Latin nor a sign."""
    c = F.ascii(F.regexp_extract(text, "[\\u0370-\\u1aff\\u3040-\\ud7a3]", 0))
    return F.coalesce(*[F.when(c.between(ord(block[0]), ord(block[-1])), F.lit(name)) for name, block in _STRATA], F.lit("latin"))


def sample_texts(docs: DataFrame, id_col: str, text_col: str, rows: int = SAMPLE_ROWS) -> list[str]:
    """The bounded training sample: of each script the texts with the smallest hashes of their ids."""
    t = F.col(text_col)
    s = docs.where(t.isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i"), _stratum(t).alias("s"), F.substring(t, 1, SAMPLE_CHARS).alias("t"))
    ranked = s.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy("h", "i", "t"))).where(F.col("n") <= rows)
    return [r.t for r in ranked.orderBy("s", "n").select("t").collect()]  # at most a text per script and rank


_FIRST_WORD = re.compile(r"\s*([a-z]+)\s")
_BARE = re.compile(r"[^\w\sั-๎]+")
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_WITHOUT_MARKS = [(name, re.compile(f"[{block}]")) for name, block in _STRATA[:4]]


def corpus_edges(docs: DataFrame, text_col: str) -> tuple[frozenset[str], frozenset[str]]:
    """(words in lower case that begin blocks, ends of blocks in scripts without end marks) that are common in all documents.

    Counted in one pass, a batch at a time before anything moves. Both are shares, so what is collected is bounded by their inverse
    whatever the size of the corpus.
    """

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter = Counter()
        for t in b.column(0).to_pylist():
            if t is None:
                continue
            seen["", ""] += 1  # documents
            for block in _BLANK.split(t):
                if (m := _FIRST_WORD.match(block)) and not block.islower():
                    seen["", m[1]] += 1
                if not block.isascii() and _ANY_UNSPACED.search(block):
                    script = next(name for name, rx in _WITHOUT_MARKS if rx.search(block))
                    seen[script, ""] += 1
                    seen[script, _BARE.sub("", block).rstrip()[-3:]] += 1
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["script", "edge", "n"])

    counts = checkpoint(map_arrow(docs.select(F.col(text_col).alias("t")), kernel, "script string, edge string, n bigint").groupBy("script", "edge").agg(F.sum("n").alias("n")))
    sizes = counts.where("edge = ''").select("script", F.col("n").alias("of"))  # a row per script
    least = F.when(F.col("script") == "", F.greatest(F.lit(2.0), STARTER_SHARE * F.col("of"))).otherwise(F.greatest(F.lit(3.0), END_SHARE * F.col("of")))
    common = counts.where("edge <> ''").join(F.broadcast(sizes), "script").where(F.col("n") >= least).select("script", "edge").collect()
    return frozenset(r.edge for r in common if not r.script), frozenset(r.edge for r in common if r.script)


def split_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sent_start, sent_len): one row per sentence."""
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(train(sample_texts(df, id_col, text_col), *corpus_edges(df, text_col)))  # weights of a bounded sample
    key = f"sentences:{uuid.uuid4()}"

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        tagger: Tagger = cached(key, lambda: held.value)
        ids, starts, sizes = [], [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for a, n in sentences(text, tagger):
                ids.append(i)
                starts.append(a)
                sizes.append(n)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, starts, sizes)], ["doc_id", "sent_start", "sent_len"])

    return map_arrow(df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), kernel, "doc_id bigint, sent_start bigint, sent_len bigint")
