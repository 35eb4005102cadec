"""Problem 3: rows whose texts share most of their word sequences, by an exact set-similarity join.

A text is the set of its distinct SHINGLE-word sequences; two are near duplicates if their Jaccard similarity is at least a threshold.
Tokens are ordered rarest first; a set is indexed under its prefix only, the tokens one of which any partner must share. The lists of
the index are cut into blocks of equal set size, ordered by the token's position: from a probing set and a block follow the overlap
that is needed and with it the last position that can still reach it, so whole blocks and the tails of blocks are skipped without
being read. A parity sketch gives a lower bound of the difference of two sets and drops more pairs before their sets are compared.

Answers are shared by relation of sets. Rows with the same set form a class, and one row of it is joined. Of sets that differ in few
tokens (at most FAMILY of their union; they meet by the smallest hashes of their tokens) one leads and the others follow: only leaders
are indexed and joined, with a threshold that is looser by as much as followers may be away, which the triangle inequality of the
Jaccard distance makes exact. A follower's answers come from its leader's: the overlap of leader and partner, less the tokens that the
follower lacks or plus those it adds, bounds the follower's overlap on both sides, and what these bounds don't decide is compared set
by set. Which rows follow changes the work and never the result.

Rows of one text, word for word, in more than EXPAND copies are written as pairs with the first of them, which gives their membership,
and only the first is paired with other texts; links between different texts are all there.

Lists of tokens that occur more than CELL times are split into cells of bounded size that together hold all pairs of the list; a list
isn't split if its token comes up less than three times in each batch of tokens counted. Tables that are broadcast are counted first,
and joined by shuffle beyond BROADCAST_ROWS. These sizes choose plans and change no row.

Results: null, empty and texts of fewer than SHINGLE words form no pair; repeated ids are one row; order of pairs is a < b.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wfscan.llm.common import map_arrow
from wfscan.session import checkpoint, shared_table

EXPAND = 256  # copies of one text that are still written as pairs of all of them
FAMILY, MINIMA = 0.05, 3  # how far a follower may be from its leader; token hashes by which they meet
CELL, BROADCAST_ROWS, MAX_COMMON = 20_000, 1_000_000, 50_000
COUNTED = 4_000_000  # tokens that are counted at a time
BITS = 40
_MASK = (1 << BITS) - 1
_WORD = re.compile(r"[^\W_]+")
SETS = "id bigint, s1 bigint, s2 bigint, t1 bigint, t2 bigint, family bigint, n int, tokens binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def token_sets(texts: list[str | None], shingle: int, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, token) of all distinct shingles of a batch, sorted by both; the words' hashes and where each row's words end."""
    words: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            found = _WORD.findall(t.lower())
            sizes[i] = len(found)
            try:
                words += [known[w] for w in found]
            except KeyError:
                if len(known) > 2_000_000:
                    known.clear()
                for w in found:
                    if w not in known:
                        known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
                words += [known[w] for w in found]
    w = np.array(words, np.uint64)
    if len(w) < shingle:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), w, np.cumsum(sizes)
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(texts)), sizes)
    m = len(w) - shingle + 1
    h = np.zeros(m, np.uint64)
    for k in range(shingle):
        h = _mix(h + w[k : k + m])
    ok = np.arange(m) + shingle <= ends[row[:m]]
    key = np.unique((row[:m][ok].astype(np.uint64) << np.uint64(BITS)) | (h[ok] >> np.uint64(64 - BITS)))
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64(_MASK)).astype(np.int64), w, ends


def pack(tokens: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8])


def unpack(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // (BITS // 8), 8), np.uint8)
    out[:, : BITS // 8] = data.reshape(-1, BITS // 8)
    return out.view("<u8").reshape(-1).astype(np.int64)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a batch of packed sets and where each set begins."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if len(column) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return unpack(data), (at - at[0]) // (BITS // 8)


def _halves(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def family_keys(row: np.ndarray, tok: np.ndarray, count: int) -> np.ndarray:
    """For each of `count` rows a hash of its MINIMA tokens with the smallest hashes: likely the same for sets of few differences."""
    h = _mix(tok.astype(np.uint64) + np.uint64(1))
    o = np.lexsort((h, row))
    r = row[o]
    first = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    place = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
    keep = place < MINIMA
    out = np.zeros(count, np.uint64)
    np.add.at(out, r[keep], _mix(h[o][keep] + place[keep].astype(np.uint64)))
    return out.view(np.int64)


def build_sets(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """One row per text with at least one shingle: 128-bit hashes of its set and of its words, family key, size and sorted tokens."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[str, int] = _KNOWN
        row, tok, words, ends = token_sets(b.column(1).to_pylist(), shingle, known)
        rows, starts = np.unique(row, return_index=True)
        at = np.append(starts, len(tok))
        packed = pack(tok).reshape(-1)
        offsets = (at * (BITS // 8)).astype(np.int64)
        data, spoken = packed.tobytes(), words.tobytes()
        begins = np.r_[0, ends[:-1]] if len(ends) else ends
        of_set = np.array([_halves(data[offsets[i] : offsets[i + 1]]) for i in range(len(rows))], np.int64).reshape(-1, 2)
        of_text = np.array([_halves(spoken[8 * begins[r] : 8 * ends[r]]) for r in rows.tolist()], np.int64).reshape(-1, 2)
        keys = family_keys(np.searchsorted(rows, row), tok, len(rows))
        sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())
        cols = [b.column(0).take(pa.array(rows)), *(pa.array(np.ascontiguousarray(c)) for c in (of_set[:, 0], of_set[:, 1], of_text[:, 0], of_text[:, 1], keys)), pa.array(np.diff(at).astype(np.int32)), sets]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SETS.split(", ")])

    return map_arrow(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), kernel, SETS)


_KNOWN: dict[str, int] = {}


def seen_tokens(sets: DataFrame) -> DataFrame:
    """(token, seen) of the tokens that come up at least three times among COUNTED successive ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            t, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= 3
            return pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(c[keep].astype(np.int64))], ["token", "seen"])

        for b in batches:
            tok, _ = _binary(b.column(0))
            held.append(tok)
            size += len(tok)
            if size >= COUNTED:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return sets.select("tokens").mapInArrow(run, "token bigint, seen bigint").groupBy("token").agg(F.sum("seen").alias("seen"))


def needed(na, nb, t: float):
    """The overlap that two sets of these sizes must have."""
    return np.ceil(t / (1 + t) * (na + nb) - 1e-9).astype(np.int64)


ENTRIES = "token bigint, id bigint, n int, pos int, k1 bigint, k2 bigint, slack int"


def index_entries(sets: DataFrame, threshold: float, slack: float = 0.0) -> DataFrame:
    """(token, cell, part, id, n, pos, k1, k2, slack): the prefix of each set, rarest tokens first, with its sketch.

    `slack` is by how much a partner's leading may loosen the threshold; a set's own column says whether it leads itself.
    """
    seen = checkpoint(seen_tokens(sets))
    rows = seen.orderBy(F.desc("seen"), "token").limit(MAX_COMMON).collect()  # only the order of tokens depends on these
    order = sorted((r.token, r.seen) for r in rows)
    held = sets.sparkSession.sparkContext.broadcast((np.array([t for t, _ in order], np.int64), np.array([c for _, c in order], np.int64)))

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        common, counts = held.value
        tok, at = _binary(b.column(1))
        ids, leads = b.column(0).to_numpy(), b.column(2).to_numpy()
        sizes = np.diff(at)
        row = np.repeat(np.arange(len(ids)), sizes)
        freq = np.zeros(len(tok), np.int64)
        if len(common):
            j = np.minimum(np.searchsorted(common, tok), len(common) - 1)
            hit = common[j] == tok
            freq[hit] = counts[j[hit]]
        o = np.lexsort((tok, freq, row))
        pos = np.arange(len(tok)) - at[row]
        n = sizes[row]
        least = threshold - slack * (1 + leads[row])
        keep = pos < n - np.ceil(least * n - 1e-9).astype(np.int64) + 1
        t, r, n, p = tok[o][keep], row[keep], n[keep], pos[keep]
        sketch = np.zeros((len(ids), 2), np.uint64)
        bit = (_mix(tok.astype(np.uint64)) >> np.uint64(57)).astype(np.int64)
        np.bitwise_xor.at(sketch, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        s = sketch.view(np.int64)
        cols = [t, ids[r], n.astype(np.int32), p.astype(np.int32), s[r, 0], s[r, 1], leads[r].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [c.split()[0] for c in ENTRIES.split(", ")])

    entries = map_arrow(sets.select("id", "tokens", "slack"), kernel, ENTRIES)
    hot = seen.where(F.col("seen") > CELL)
    count = hot.count()
    if not count:
        return entries.select("token", F.lit(0).cast("bigint").alias("cell"), F.lit(0).alias("part"), "id", "n", "pos", "k1", "k2", "slack")
    # a hot list in k parts: each entry goes to the k cells that pair its part with another one
    k = F.ceil(F.col("seen") / CELL).cast("int")
    j = entries.join(_bounded(hot, count), "token", "left").withColumn("part", F.when(F.col("seen").isNotNull(), F.pmod(F.xxhash64("id"), k).cast("int")).otherwise(0))
    low, high = (lambda o: F.least("part", o).cast("bigint")), (lambda o: F.greatest("part", o).cast("bigint"))
    cells = F.when(F.col("seen").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(F.sequence(F.lit(0), k - 1), lambda o: F.shiftleft(k.cast("bigint"), 40).bitwiseOR(F.shiftleft(low(o), 20)).bitwiseOR(high(o))))
    return j.select("token", F.explode(cells).alias("cell"), "part", "id", "n", "pos", "k1", "k2", "slack")


def block_skip_pairs(token, cell, part, ids, n, pos, k1, k2, leads, threshold: float, slack: float = 0.0, at_once: int = 2_000_000):
    """Candidate pairs from lists sorted by (token, cell, n, pos); arrays of whole lists."""
    size = len(token)
    if size < 2:
        return
    exact, threshold = threshold, threshold - 2 * slack * bool(leads.max())  # blocks are skipped by the loosest threshold, pairs by their own
    new_list = np.r_[True, (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])]
    new_block = new_list | np.r_[True, n[1:] != n[:-1]]
    block = np.cumsum(new_block) - 1
    start = np.flatnonzero(new_block)
    block_list = (np.cumsum(new_list) - 1)[start]
    block_n = n[start].astype(np.int64)
    place = block.astype(np.int64) * (1 << 24) + pos
    live = np.arange(size)
    step = 0
    while len(live):
        target = block[live] + step
        ok = target < len(start)
        live, target = live[ok], target[ok]
        na, nb = n[live].astype(np.int64), block_n[target]
        # blocks of a list come by size: past the largest partner, or where even the probe's rest is too short, nothing more can match
        alpha = needed(na, nb, threshold)
        ok = (block_list[target] == block_list[block[live]]) & (na >= threshold * nb - 1e-9) & (na - pos[live] >= alpha)
        live, target, alpha, nb = live[ok], target[ok], alpha[ok], nb[ok]
        if not len(live):
            return
        first = np.maximum(start[target], live + 1) if step == 0 else start[target]
        last = np.searchsorted(place, target.astype(np.int64) * (1 << 24) + (nb - alpha), side="right")
        count = np.maximum(last - first, 0)
        ends = np.cumsum(count)
        cut = 0
        while cut < len(live):
            stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + at_once, side="right")))
            c = count[cut:stop]
            total = int(c.sum())
            if total:
                a = np.repeat(live[cut:stop], c)
                b = np.arange(total) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[cut:stop], c)
                own = np.repeat(alpha[cut:stop], c) if threshold == exact else needed(n[a].astype(np.int64), n[b], exact - slack * (leads[a] + leads[b]))
                room = n[a].astype(np.int64) + n[b] - 2 * own
                differ = np.bitwise_count((k1[a] ^ k1[b]).view(np.uint64)).astype(np.int64) + np.bitwise_count((k2[a] ^ k2[b]).view(np.uint64))
                good = differ <= room
                good &= np.minimum(n[a] - pos[a], n[b] - pos[b]) >= own
                hot = cell[a] != 0
                if hot.any():
                    pa_, pb = part[a].astype(np.int64), part[b].astype(np.int64)
                    here = ((np.minimum(pa_, pb) << 20) | np.maximum(pa_, pb)) == (cell[a] & ((1 << 40) - 1))
                    good &= ~hot | here
                yield np.minimum(ids[a[good]], ids[b[good]]), np.maximum(ids[a[good]], ids[b[good]])
            cut = stop
        step += 1


def _whole_lists(batches: Iterator[pa.RecordBatch], least: int = 1_000_000) -> Iterator[list[np.ndarray]]:
    """The columns of sorted entries in parts of about `least` rows that end where a list ends."""
    held: list[list[np.ndarray]] = []
    size = 0
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        size += b.num_rows
        if size >= least:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            token, cell = cols[0], cols[1]
            last = int(np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])])[-1])
            if last:
                yield [c[:last] for c in cols]
                cols = [c[last:] for c in cols]
            held, size = [cols], len(cols[0])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def candidate_pairs(entries: DataFrame, threshold: float, slack: float = 0.0) -> DataFrame:
    """(a, b): distinct pairs of sets that the index can't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_lists(batches):
            held, size = [], 0
            for p in chain(block_skip_pairs(*cols, threshold, slack), [None]):
                if p is not None:
                    held.append(np.stack(p, 1))
                    size += len(p[0])
                if held and (p is None or size > 1_000_000):
                    pairs = np.unique(np.concatenate(held), axis=0)
                    held, size = [], 0
                    for i in range(0, len(pairs), 100_000):
                        some = pairs[i : i + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(some[:, 0])), pa.array(np.ascontiguousarray(some[:, 1]))], ["a", "b"])

    lists = entries.repartition("token", "cell").sortWithinPartitions("token", "cell", "n", "pos")
    return lists.mapInArrow(run, "a bigint, b bigint").distinct()


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast what is known to be small; the plan without the hint joins by shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


OVERLAPS = "a bigint, b bigint, o int, na int, nb int"


def overlaps(pairs: DataFrame, sets: DataFrame, threshold: float, slack: float = 0.0) -> DataFrame:
    """(a, b, o, na, nb): candidates whose sets overlap by as much as they must; only sets that occur in one are moved."""
    pairs = checkpoint(pairs)
    n = pairs.count()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    mine = sets.join(_bounded(wanted, 2 * n), "id", "left_semi").select("id", "tokens", "slack")
    side = lambda x: mine.select(F.col("id").alias(x), F.col("tokens").alias(f"t{x}"), F.col("slack").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        a_tok, a_at = _binary(b.column(2))
        b_tok, b_at = _binary(b.column(3))
        row_a = np.repeat(np.arange(b.num_rows), np.diff(a_at)) << BITS
        row_b = np.repeat(np.arange(b.num_rows), np.diff(b_at)) << BITS
        common = np.intersect1d(row_a | a_tok, row_b | b_tok, assume_unique=True) >> BITS
        o, na, nb = np.bincount(common, minlength=b.num_rows), np.diff(a_at), np.diff(b_at)
        least = threshold - slack * (b.column(4).to_numpy() + b.column(5).to_numpy())
        keep = pa.array(o >= needed(na, nb, least))
        return pa.RecordBatch.from_arrays([x.filter(keep) for x in (b.column(0), b.column(1), *(pa.array(x.astype(np.int32)) for x in (o, na, nb)))], ["a", "b", "o", "na", "nb"])

    return map_arrow(both.select("a", "b", "ta", "tb", "sa", "sb"), kernel, OVERLAPS)


def followers_of(firsts: DataFrame) -> DataFrame:
    """(id, leader, n, plus, minus): sets that differ from the one that leads their family in few tokens, and in how many.

    A family is led by its smallest id; a set that turns out farther from it stays on its own.
    """
    families = checkpoint(firsts.groupBy("family").agg(F.min("id").alias("leader"), F.count("*").alias("m")).where("m > 1").select("family", "leader"))
    count = families.count()
    leaders = firsts.join(_bounded(families.select(F.col("leader").alias("id")), count), "id", "left_semi").select(F.col("id").alias("leader"), F.col("tokens").alias("led"))
    pairs = firsts.join(_bounded(families, count), "family").where("id <> leader").select("id", "tokens", "leader").join(leaders, "leader")

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        tok, at = _binary(b.column(2))
        led, led_at = _binary(b.column(3))
        mine = np.repeat(np.arange(b.num_rows), np.diff(at)) << BITS | tok
        theirs = np.repeat(np.arange(b.num_rows), np.diff(led_at)) << BITS | led
        both = np.bincount(np.intersect1d(mine, theirs, assume_unique=True) >> BITS, minlength=b.num_rows)
        n, m = np.diff(at), np.diff(led_at)
        plus, minus = n - both, m - both
        near = pa.array(plus + minus <= FAMILY * (n + minus))
        return pa.RecordBatch.from_arrays([x.filter(near) for x in (b.column(0), b.column(1), *(pa.array(x.astype(np.int32)) for x in (n, plus, minus)))], ["id", "leader", "n", "plus", "minus"])

    return map_arrow(pairs.select("id", "leader", "tokens", "led"), kernel, "id bigint, leader bigint, n int, plus int, minus int")


def set_links(sets: DataFrame, dropped: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of different sets at least `threshold` alike. Leaders are joined; their answers are carried on to followers.

    `dropped` (id) are the rows that others of the same set stand for.
    """
    firsts = sets.join(_bounded(dropped, dropped.count()), "id", "left_anti")
    followers = checkpoint(followers_of(firsts))
    count = followers.count()
    if not count:
        base = firsts.withColumn("slack", F.lit(0))
        return overlaps(candidate_pairs(index_entries(base, threshold), threshold), base, threshold).select("a", "b")
    # one small table says of each row whether it is left out or leads
    roles = dropped.select("id", F.lit(None).cast("int").alias("slack")).unionByName(followers.select("id", F.lit(None).cast("int").alias("slack"))).unionByName(followers.select(F.col("leader").alias("id"), F.lit(1).alias("slack")).distinct())
    roles = checkpoint(roles.withColumn("known", F.lit(True)))
    base = sets.join(_bounded(roles, roles.count()), "id", "left").where("known is null or slack is not null").withColumn("slack", F.coalesce("slack", F.lit(0))).drop("known")
    found = checkpoint(overlaps(candidate_pairs(index_entries(base, threshold, FAMILY), threshold, FAMILY), base, threshold, FAMILY))
    # members of a family: the leader itself without a difference, and its followers
    led = base.where("slack = 1").select(F.col("id").alias("leader"), "id", "n", F.lit(0).alias("plus"), F.lit(0).alias("minus")).unionByName(followers.select("leader", "id", "n", "plus", "minus"))
    side = lambda x: led.select(F.col("leader").alias(x), F.col("id").alias(f"i{x}"), F.col("n").alias(f"m{x}"), F.col("plus").alias(f"p{x}"), F.col("minus").alias(f"d{x}"))
    across = found.join(side("a"), "a", "left").join(side("b"), "b", "left")
    across = across.select("o", *[F.coalesce(c, d).alias(c) for c, d in (("ia", "a"), ("ma", "na"), ("ib", "b"), ("mb", "nb"))], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pa", "da", "pb", "db")])
    own = led.where("id = leader").select(F.col("leader").alias("b"), F.col("n").alias("o"))
    within = own.join(side("b"), "b").join(side("b").select("b", *[F.col(f"{c}b").alias(f"{c}a") for c in "impd"]), "b").where("ia < ib").select("o", "ia", "ma", "ib", "mb", "pa", "da", "pb", "db")
    every = across.unionByName(within)
    ratio = threshold / (1 + threshold)
    need = F.ceil(F.lit(ratio) * (F.col("ma") + F.col("mb")) - 1e-9)
    sure = F.col("o") - F.col("da") - F.col("db") >= need
    open_ = F.least(F.col("o") + F.col("pa") + F.col("pb"), "ma", "mb") >= need
    pair = (F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    told = checkpoint(every.where(open_).select(*pair, sure.alias("sure")))
    compared = overlaps(told.where("not sure").select("a", "b"), sets.withColumn("slack", F.lit(0)), threshold)
    return told.where("sure").select("a", "b").unionByName(compared.select("a", "b"))


def similar_classes(df: DataFrame, id_col: str, text_col: str, threshold: float, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rep, id, m) of rows in classes of two or more equal sets; (a, b) between the first rows of classes; (first, id) of copies of
    texts with more than EXPAND of them, without the first."""
    sets = shared_table(build_sets(df, id_col, text_col, shingle))
    if sets.groupBy("id").count().where("count > 1").limit(1).count():  # of several texts under one id the one with the smallest hash
        whole = F.struct(*[c for c in sets.columns if c != "id"])
        sets = shared_table(sets.groupBy("id").agg(F.min_by(whole, F.struct("s1", "s2", "t1", "t2")).alias("x")).select("id", "x.*"))
    classes = sets.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("m")).where("m > 1")
    members = checkpoint(sets.select("id", "s1", "s2", "n", "t1", "t2").distinct().join(classes, ["s1", "s2", "n"]).select("rep", "id", "m", "t1", "t2"))
    many = members.where(F.col("m") > EXPAND).groupBy("t1", "t2").agg(F.min("id").alias("first"), F.count("*").alias("c")).where(F.col("c") > EXPAND).select("t1", "t2", "first")
    copies = checkpoint(members.where(F.col("m") > EXPAND).join(many, ["t1", "t2"]).where("id <> first").select("first", "id"))
    links = set_links(sets.select("id", "n", "family", "tokens"), members.where("id <> rep").select("id"), threshold)
    return members.select("rep", "id", "m"), checkpoint(links), copies


def near_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """(id_a, id_b): pairs of rows at least `threshold` alike; copies of one text beyond EXPAND by their first row."""
    members, links, copies = similar_classes(df, id_col, text_col, threshold, shingle)
    single = members.join(_bounded(copies.select("id"), copies.count()), "id", "left_anti")
    x, y = single.select("rep", F.col("id").alias("id_a")), single.select("rep", F.col("id").alias("id_b"))
    within = x.join(y, "rep").where("id_a < id_b").select("id_a", "id_b")
    across = (
        links.join(single.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a", "left")
        .join(single.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b", "left")
        .select(F.coalesce("ia", "a").alias("p"), F.coalesce("ib", "b").alias("q"))
        .select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))
    )
    return within.unionByName(across).unionByName(copies.select(F.col("first").alias("id_a"), F.col("id").alias("id_b")))


def connected(links: DataFrame, limit: int = 200) -> DataFrame:
    """(id, label): the smallest id of each connected part; labels jump, so long chains take few rounds."""
    edges = checkpoint(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    labels = checkpoint(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")))
    for _ in range(limit):
        near = edges.join(labels.select(F.col("x").alias("y"), F.col("label").alias("l")), "y").groupBy("x").agg(F.min("l").alias("l"))
        step = labels.join(near, "x").select("x", F.least("label", "l").alias("label"))
        jump = step.join(step.select(F.col("x").alias("label"), F.col("label").alias("l2")), "label", "left").select("x", F.least("label", F.coalesce("l2", "label")).alias("label"))
        new = checkpoint(jump)
        changed = new.join(labels.withColumnRenamed("label", "was"), "x").where("label <> was").limit(1).count()
        labels = new
        if not changed:
            break
    else:
        raise RuntimeError(f"labels still change after {limit} rounds")
    return labels.select(F.col("x").alias("id"), "label")


def near_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """(id, class_id, group_id, n_links): one row per row that has a near duplicate; links are those between classes."""
    members, links, _ = similar_classes(df, id_col, text_col, threshold, shingle)
    parts = connected(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    reps = members.select("rep").distinct().unionByName(degree.select("rep")).distinct()
    rows = reps.join(members.select("rep", "id"), "rep", "left").select("rep", F.coalesce("id", "rep").alias("id"))
    return (
        rows.join(parts.select(F.col("id").alias("rep"), "label"), "rep", "left")
        .join(degree, "rep", "left")
        .select("id", F.col("rep").alias("class_id"), F.coalesce("label", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
