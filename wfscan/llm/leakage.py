"""Problem 9: passages of held-out test items inside a training corpus.

One Aho-Corasick automaton holds every run of WINDOW consecutive words of every item, normalised to letters and digits without
spacing, so that case, punctuation, spacing and invisible characters don't matter. In scripts without spaces each letter is a unit
that counts as 1 / LETTERS of a word, so a window begins at every letter. Each text is normalised and scanned once. Hits of an item
that follow one another in the text and in the item form a stretch; a few changed words only leave short holes in it. The item has
leaked if the longest stretch spans at least `share` of it and at least `dense` of the stretch is hit. Positions are mapped back to
the original text only for what has leaked.

Items of the same normalised text are one item of the automaton. A window that more than HOT items have in common asks only those of
them that it could leak by itself; the others are asked once one of their own windows is met, and then get the common ones as well. So
items with a common opening cost no more than their number, and nothing is lost.

Documents aren't shuffled and are read once: a kernel holds a bounded part of its texts, normalised, and passes it through the blocks
of items one after another. All items together are broadcast up to ROUND_CHARS; of more, each round is written before the next.

Results: null, empty and blank texts leak nothing; a repeated document gives a row each time; repeated item ids are joined into one.
Items of fewer than MIN_WORDS words leak only as a whole, between word boundaries; of fewer than `whole` words never, being phrases.
LETTERS letters of Han and kana count as a word there, and twice as many of Thai and the like.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wfscan.llm.common import cached
from wfscan.session import shared_table, ship_package, spread

WINDOW, MIN_WORDS, MIN_WHOLE = 4, 6, 5
HOT = 32  # items that a window may have before it is split
LETTERS = 2  # letters of a script without spaces that count as one word
MIN_SHARE, MIN_DENSE = 0.5, 0.5
GAP, DRIFT = 60, 40  # letters that one hole may span, and by which the item's and the text's side of it may differ
GAP_UNSPACED, DRIFT_UNSPACED = 24, 16  # the same number of words in letters of scripts without spaces
BLOCK_ITEMS, BLOCK_CHARS, ROUND_CHARS = 20_000, 1_000_000, 64_000_000  # items in one automaton; characters in it and in all of a round
HELD_CHARS = 16_000_000  # characters of texts that a kernel passes through the blocks at a time
_DROP = re.compile(r"[\W_]+")
# Thai, Lao, Tibetan, Myanmar, Khmer, Tai scripts, kana, Han
_UNSPACED = re.compile(r"[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uaa60-\uaadf\uf900-\ufaff\U0001b000-\U0001b16f\U00020000-\U000323af]")
_ALPHABETIC = re.compile(r"[\u0e00-\u1aaf\uaa60-\uaadf]")  # of these, those whose letters are sounds
_UNIT = re.compile(rf"{_UNSPACED.pattern}|(?:(?!{_UNSPACED.pattern}).)+", re.S)
SCHEMA = "doc_id bigint, item_id bigint, share double, doc_start bigint, doc_end bigint"


def normalise(text: str) -> str:
    return _DROP.sub("", text.lower() if text.isascii() else unicodedata.normalize("NFKD", text).casefold())


def offsets(text: str) -> list[int]:
    """For each character of normalise(text) the position in text it comes from."""
    out: list[int] = []
    for i, c in enumerate(text):
        out += [i] * len(normalise(c))
    return out


class LeakIndex:
    """The automaton of a block of items, and what turns its hits into leaks."""

    def __init__(self, items: list[tuple[int, str]], share: float = MIN_SHARE, dense: float = MIN_DENSE, whole: int = MIN_WHOLE):
        self.share, self.dense = share, dense
        same: dict[str, list[int]] = defaultdict(list)
        texts: dict[str, str] = {}
        for item, text in items:
            plain = normalise(text or "")
            same[plain].append(item)
            texts.setdefault(plain, text or "")
        self.ids: list[list[int]] = []
        self.length: list[int] = []
        self.reach: list[tuple[int, int]] = []
        self.entire: dict[str, int] = {}  # short items, by their whole normalised text
        windows: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for plain, ids in same.items():
            words = [u for w in map(normalise, texts[plain].split()) for u in _UNIT.findall(w)]
            at, weight, letters, size = [0], [0], 0, 0.0  # weight and size: in 1 / LETTERS of a word
            for w in words:
                single = bool(_UNSPACED.match(w))
                letters += single
                size += 0.5 if single and _ALPHABETIC.match(w) else 1 if single else LETTERS
                at.append(at[-1] + len(w))
                weight.append(weight[-1] + (1 if single else LETTERS))
            if not words or size < whole * LETTERS:
                continue
            k = len(self.ids)
            self.ids.append(ids)
            self.length.append(at[-1])
            self.reach.append((GAP_UNSPACED, DRIFT_UNSPACED) if 2 * letters > at[-1] else (GAP, DRIFT))
            if size < MIN_WORDS * LETTERS:
                self.entire[plain] = k
                continue
            end = 0
            for i in range(len(words)):
                while end < len(words) and weight[end] - weight[i] < WINDOW * LETTERS:
                    end += 1
                if weight[end] - weight[i] < WINDOW * LETTERS:
                    break
                windows["".join(words[i:end])].append((k, at[i]))
        hot = {w: where for w, where in windows.items() if len({k for k, _ in where}) > HOT}
        common: dict[int, list[tuple[int, int]]] = defaultdict(list)  # item: stretches of its hot windows
        for w, where in hot.items():
            for k, i in where:
                common[k].append((i, i + len(w)))
        alone = {k for k, parts in common.items() if _union(parts) >= share * dense * self.length[k]}
        self.later: dict[int, list[tuple[str, int]]] = defaultdict(list)  # item: hot windows that are looked up when it is met
        for w, where in hot.items():
            windows[w] = [x for x in where if x[0] in alone]
            for k, i in where:
                if k not in alone:
                    self.later[k].append((w, i))
        self.automaton = ahocorasick.Automaton()
        for w in {**windows, **self.entire}:
            self.automaton.add_word(w, (w, tuple(windows.get(w, ())), w in hot, self.entire.get(w)))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def find(self, text: str | None, plain: str | None = None) -> list[tuple[int, float, int, int]]:
        """(item, share, start, end) of each item that leaked into the text."""
        if not text or self.empty:
            return []
        plain = normalise(text) if plain is None else plain
        hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        met: dict[str, list[int]] = defaultdict(list)  # hot windows: where they stand in the text
        entire: list[tuple[int, int, int]] = []
        for end, (w, where, is_hot, short) in self.automaton.iter(plain):
            start = end - len(w) + 1
            for k, at in where:
                hits[k].append((start, at, len(w)))
            if is_hot:
                met[w].append(start)
            if short is not None:
                entire.append((short, start, end + 1))
        for k in hits if met else ():
            for w, at in self.later.get(k, ()):
                hits[k] += [(start, at, len(w)) for start in met.get(w, ())]
        out, back = [], None
        for k, found in hits.items():
            best = self._stretch(found, self.length[k], *self.reach[k])
            if best and best[0] >= self.share:
                back = back or offsets(text)
                out += [(item, best[0], back[best[1]], back[best[2] - 1] + 1) for item in self.ids[k]]
        seen: set[int] = set()
        for k, a, z in entire:
            back = back or offsets(text)
            # a whole word on both sides: what stands next to it in the text is no letter, or one of a script without spaces
            left, right = text[back[a] - 1] if back[a] else " ", text[back[z - 1] + 1 : back[z - 1] + 2] or " "
            if k not in seen and (not left.isalnum() or _UNSPACED.match(left)) and (not right.isalnum() or _UNSPACED.match(right)):
                seen.add(k)
                out += [(item, 1.0, back[a], back[z - 1] + 1) for item in self.ids[k]]
        return out

    def _stretch(self, found: list[tuple[int, int, int]], length: int, most: int, drift: int) -> tuple[float, int, int] | None:
        if max(at + n for _, at, n in found) - min(at for _, at, _ in found) < self.share * length:
            return None
        best = None
        open_: list[list[int]] = []  # text start, text end, item start, item end, letters covered
        for pos, at, n in sorted(found):
            for s in open_:
                gap, step = pos - s[1], at - s[3]
                if gap <= most and step <= most and abs(gap - step) <= drift and at + n > s[3]:
                    s[4] += min(n, at + n - s[3])
                    s[1], s[3] = max(s[1], pos + n), at + n
                    break
            else:
                open_.append([pos, pos + n, at, at + n, n])
        for a, b, c, d, covered in open_:
            if covered >= self.dense * (d - c) and (best is None or d - c > best[0] * length):
                best = ((d - c) / length, a, b)
        return best


def _union(parts: list[tuple[int, int]]) -> int:
    """Letters that overlapping stretches cover together."""
    total, end = 0, -1
    for a, b in sorted(parts):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def item_rounds(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[list[tuple[int, str]]]]:
    """The items in blocks of bounded size, and the blocks in rounds of bounded size, streamed through the driver a round at a time."""
    blocks, block, chars, total = [], [], 0, 0
    for r in items.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).toLocalIterator():
        size = len(r[1]) + 5 * len(_UNSPACED.findall(r[1]))  # these have a window a letter
        if block and (len(block) >= BLOCK_ITEMS or chars + size > BLOCK_CHARS):
            blocks.append(block)
            block, chars = [], 0
        if blocks and total + size > ROUND_CHARS:
            yield blocks + ([block] if block else [])
            blocks, block, chars, total = [], [], 0, 0
        block.append((r[0], r[1]))
        chars += size
        total += size
    yield blocks + [block]


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = MIN_SHARE, dense: float = MIN_DENSE, whole: int = MIN_WHOLE) -> DataFrame:
    """(doc_id, item_id, share, doc_start, doc_end): each document with the items that leaked into it, by at least `share` of them."""
    spark = docs.sparkSession
    ship_package(spark)
    source = spread(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(doc_text).cast("string").alias("text")))
    merged = items.where(F.col(item_id).isNotNull()).groupBy(F.col(item_id).alias("i")).agg(F.concat_ws(" ", F.sort_array(F.collect_set(item_text))).alias("t"))
    result, before = None, None
    for blocks in item_rounds(merged, "i", "t"):
        if result is not None:  # another round comes, so what the last one found is written and its items are let go
            result = shared_table(result)
            before.destroy()
        held = before = spark.sparkContext.broadcast(blocks)  # bounded by ROUND_CHARS
        key = f"leak:{uuid.uuid4()}"

        def run(batches: Iterator[pa.RecordBatch], held=held, key=key) -> Iterator[pa.RecordBatch]:
            for ids, texts in _parts(batches):
                plain = [normalise(t) if t else "" for t in texts]
                rows: list[tuple] = []
                for n in range(len(held.value)):
                    index: LeakIndex = cached(f"{key}:{n}", lambda n=n: LeakIndex(held.value[n], share, dense, whole))
                    rows += [(d, *hit) for d, t, p in zip(ids, texts, plain, strict=True) if p for hit in index.find(t, p)]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "share", "doc_start", "doc_end"])

        part = source.mapInArrow(run, SCHEMA)
        result = part if result is None else result.unionByName(part)
    return result


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts of batches, in parts of about HELD_CHARS characters."""
    ids, texts, chars = [], [], 0
    for b in batches:
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(d)
            texts.append(t)
            chars += len(t or "")
            if chars >= HELD_CHARS:
                yield ids, texts
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts
