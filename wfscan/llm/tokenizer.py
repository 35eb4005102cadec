"""Problem 8: encode every text with a public byte-level BPE vocabulary through a finite-state transducer.

The merges are not applied pair by pair. Reading a pre-token byte by byte, the last token of each prefix is determined by the
last tokens of shorter prefixes: it is the only vocabulary entry that ends here and may follow the last token of what precedes it.
A state holds the bytes that are read but not decided, and those last tokens. A boundary is decided as soon as every way in which
an unfinished token could straddle the present position passes through it; since no token is longer than the longest entry, the
lookahead is bounded. States are created on first use (lazy determinisation) and shared by all texts of a worker.

Results: null and empty texts give an empty list; text that looks like a special token is ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wfscan.llm.common import cached, map_arrow

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenisation pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_STATES = 200_000
MAX_WORDS = 300_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Transducer:
    """A lazily determinised transducer from bytes to token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.prefixes = {b[:k] for b in ranks for k in range(1, len(b))}
        self.longest = max(map(len, ranks), default=1)
        self.words: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN).findall
        self.pair_ok = lru_cache(1 << 18)(self._pair_ok)
        self._reset()

    def _reset(self) -> None:
        # a state: (last committed token or -1, undecided bytes); its row: next state and emission by byte, then the final emission
        self.ids: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.keys: list[tuple[int, bytes]] = [(-1, b"")]
        self.last: list[tuple[int, ...]] = [(-1,)]
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.finals: list[tuple[int, ...] | None] = [()]

    def merge(self, data: bytes) -> list[bytes]:
        """The vocabulary's own definition, used on two tokens at a time to learn whether one may follow the other."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)]
            rank, i = min(ranked)
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _pair_ok(self, a: int, b: int) -> bool:
        x, y = self.bytes_of[a], self.bytes_of[b]
        return self.merge(x + y) == [x, y]

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        prev, pending = self.keys[state]
        last = self.last[state]
        text = pending + bytes((byte,))
        n = len(text)
        # last[k]: last token of the text up to undecided position k; position 0 is the committed boundary
        token = -1
        for k in range(max(0, n - self.longest), n):
            t = self.ranks.get(text[k:])
            if t is not None and last[k] != -2 and (last[k] == -1 or self.pair_ok(last[k], t)) and (n - k == 1 or self.merge(text[k:]) == [text[k:]]):
                token = t
                break
        grown = (*last, token if token >= 0 else -2)
        # the positions from which a token that is still unfinished may start, and the present one
        live = [n] + [k for k in range(max(0, n - self.longest), n) if grown[k] != -2 and text[k:] in self.prefixes]

        def chain(k: int) -> list[int]:
            ends = [k]
            while k > 0:
                k -= len(self.bytes_of[grown[k]])
                ends.append(k)
            return ends

        common = set(chain(live[0])) if grown[n] != -2 else None
        for k in live[1:]:
            common = set(chain(k)) if common is None else common & set(chain(k))
        cut = max(common) if common else 0
        emitted: list[int] = []
        k = cut
        while k > 0:
            emitted.append(grown[k])
            k -= len(self.bytes_of[grown[k]])
        emitted.reverse()
        key = (emitted[-1] if emitted else prev, text[cut:])
        rest = (emitted[-1] if emitted else last[0], *grown[cut + 1 :])
        new = self.ids.get(key)
        if new is None:
            new = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.last.append(rest)
            self.moves.append({})
            self.finals.append(None)
        self.moves[state][byte] = (new, tuple(emitted))
        return new, tuple(emitted)

    def _final(self, state: int) -> tuple[int, ...]:
        out, k, last = [], len(self.keys[state][1]), self.last[state]
        while k > 0:
            out.append(last[k])
            k -= len(self.bytes_of[last[k]])
        self.finals[state] = result = tuple(reversed(out))
        return result

    def run(self, data: bytes) -> tuple[int, ...]:
        if len(self.keys) > MAX_STATES:
            self._reset()
        state, out, moves = 0, [], self.moves
        for byte in data:
            move = moves[state].get(byte) or self._step(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        final = self.finals[state]
        out += self._final(state) if final is None else final
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words, out = self.words, []
        for w in self.split(text):
            ids = words.get(w)
            if ids is None:
                if len(words) >= MAX_WORDS:
                    words.clear()
                ids = words[w] = self.run(w.encode("utf-8", "replace"))
            out += ids
        return out


class Utf8Machine:
    """An incremental UTF-8 decoder: feeds on token bytes and gives out text as soon as a character is complete."""

    def __init__(self) -> None:
        self.need, self.held, self.low, self.high = 0, bytearray(), 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.held.append(b)
                    self.need -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.need:
                        out.append(self.held.decode())
                        self.held.clear()
                    continue
                out.append("�")
                self.need, self.low, self.high = 0, 0x80, 0xBF
                self.held.clear()
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.need = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                self.low = 0xA0 if b == 0xE0 else 0x90 if b == 0xF0 else 0x80
                self.high = 0x9F if b == 0xED else 0x8F if b == 0xF4 else 0xBF
                self.held.append(b)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        left, self.need = bool(self.need), 0
        self.held.clear()
        return "�" if left else ""


def decode_stream(ids: Iterable[int], bytes_of: dict[int, bytes]) -> Iterator[str]:
    machine = Utf8Machine()
    for i in ids:
        if piece := machine.feed(bytes_of[i]):
            yield piece
    if piece := machine.close():
        yield piece


def _vocabulary(spark: SparkSession, path: str) -> tuple[str, object]:
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("vocabulary file larger than 64 MB")
    return f"bpe:{path}:{len(data)}", spark.sparkContext.broadcast(data)  # a fixed file of about 1 MB


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_RANKS) -> DataFrame:
    """One row per input row: its id and the token ids of its text. Map-only; other columns are pruned at the scan."""
    key, data = _vocabulary(df.sparkSession, path)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        t: Transducer = cached(key, lambda: Transducer(parse_ranks(data.value)))
        rows = [t.encode(x) for x in b.column(1).to_pylist()]
        sizes = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r) for r in rows], out=sizes[1:])
        flat = np.fromiter((i for r in rows for i in r), np.int32, int(sizes[-1]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], ["doc_id", "ids"])

    return map_arrow(df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")), kernel, "doc_id bigint, ids array<int>")


def decode_corpus(df: DataFrame, path: str = DEFAULT_RANKS) -> DataFrame:
    """The inverse: (doc_id, ids) to (doc_id, text); null ids give null."""
    key, data = _vocabulary(df.sparkSession, path)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        t: Transducer = cached(key, lambda: Transducer(parse_ranks(data.value)))
        texts = [None if ids is None else "".join(decode_stream(ids, t.bytes_of)) for ids in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(df.select("doc_id", "ids"), kernel, "doc_id bigint, text string")
