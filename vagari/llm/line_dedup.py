"""Line dedup by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity over the whole
corpus; two sets that are similar enough share a word in the first few of this
order (prefix filter), so an inverted index over prefix words finds all
candidates. Length, position and a 128-bit parity signature (of which each word
flips a bit) rule most of them out; the Jaccard similarity of whole sets decides. Where a prefix word is frequent, the
index is over triples of prefix words instead, from a prefix longer by two.
Words and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import buckets
from .common import Scratch, free, stored, whole_texts
from .kernels import LANES, LOWERED, U, chunks, mixed, span_hashes, trim, words

POSTING = np.dtype([("key", "<u4"), ("sid", "<u8"), ("sig", "<u8"), ("sig2", "<u8"), ("doc", "<i8"), ("line", "<i4"), ("n", "<i4"), ("pos", "<i4")])
LINES = "sid long, doc long, row long, line int, of int, words int"
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class LineParams:
    """Lines with Jaccard similarity of at least num/den are alike. A word is frequent from 'frequent' lines on, or from 64 times the mean bucket. nearest: candidates kept for a line and prefix word, the nearest by signature; all others follow if none of these is alike. window: entries of a prefix word that are compared with each entry at once. block_bytes: entries that a task holds and compares at once. code_bits: 2 to this power is the number of word counts, a byte each, that every worker holds; about one in ten distinct words keeps rarity apart."""

    num: int = 4
    den: int = 5
    frequent: int = 2000
    nearest: int = 1
    window: int = 4096
    code_bits: int = buckets.CODE_BITS
    flush_bytes: int = 8 << 20
    block_bytes: int = 16 << 20


@dataclass
class Lines:
    """Lines of a chunk as sorted sets. first: where each line's words begin; tokens: words by rarity within the line."""

    doc: np.ndarray
    number: np.ndarray
    first: np.ndarray
    n: np.ndarray
    tokens: np.ndarray
    codes: np.ndarray
    sid: np.ndarray


def line_sets(buf: np.ndarray, offs: np.ndarray, table: np.ndarray | None) -> Lines:
    low = LOWERED[buf]
    starts, ends, doc = words(low, offs)
    h = span_hashes(low, starts, ends)
    breaks = np.flatnonzero(buf == 10)
    seen = np.searchsorted(breaks, starts)
    line = seen + doc
    code = table[buckets.bucket(h, len(table).bit_length() - 1)] if table is not None else np.zeros(len(h), np.uint8)
    change = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
    index = np.repeat(np.arange(len(change)), np.diff(np.append(change, len(line))))
    packed = (index.astype(U) << U(48)) | (code.astype(U) << U(40)) | (h >> U(24))
    order = np.argsort(packed)
    tie = packed[order][1:] == packed[order][:-1]
    if len(change) >= 1 << 16 or (h[order][1:][tie] != h[order][:-1][tie]).any():
        order = np.lexsort((h, code, index))
    h, code, index = h[order], code[order], index[order]
    new = np.ones(len(h), bool)
    new[1:] = (index[1:] != index[:-1]) | (h[1:] != h[:-1])
    h, code, index = h[new], code[new], index[new]
    first = np.searchsorted(index, np.arange(len(change)))
    n = np.diff(np.append(first, len(h)))
    sums = np.add.reduceat(mixed(h ^ LANES[5]), first) if len(first) else np.zeros(0, U)
    at = change
    number = seen[at] - np.searchsorted(breaks, offs[doc[at]])
    return Lines(doc[at], number, first, n, h, code, mixed(sums + n.astype(U) * LANES[6]))


def needed(n: np.ndarray, p: LineParams) -> np.ndarray:
    """Least overlap of a set of n words with any set alike."""
    return -(-p.num * n // p.den)


def postings(ls: Lines, docs: np.ndarray, hot: int, p: LineParams) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a chunk's distinct sets that could have a different set alike: the lower half of each key, which deals it out, and the entry with the upper half."""
    order = np.lexsort((ls.number, docs[ls.doc]))  # a set's place is that of its least (doc, line), whatever the order of rows
    once = order[np.unique(ls.sid[order], return_index=True)[1]]
    pick = np.zeros(len(ls.sid), bool)
    pick[once] = True
    pick &= ls.n * p.den >= p.num * (ls.n + 1)
    prefix = np.where(pick, ls.n - needed(ls.n, p) + 1, 0)
    of = np.repeat(np.arange(len(ls.n)), ls.n)
    pos = np.arange(len(ls.tokens)) - ls.first[of]
    cold = ls.codes < hot
    few = needed(ls.n, p)[of] < 3  # two of these may be alike with fewer than three words in common
    take = np.flatnonzero((pos < prefix[of]) & (cold | few) & (ls.codes != 1))
    lines, keys, at = [of[take]], [mixed(ls.tokens[take] ^ LANES[4])], [pos[take]]
    warm = np.flatnonzero((pos < prefix[of] + 2) & (prefix[of] > 0) & ~cold)
    if len(warm):
        cuts = np.flatnonzero(np.diff(of[warm])) + 1
        for group in np.split(warm, cuts):
            if len(group) >= 3:
                a, b, c = np.array(list(combinations(group.tolist(), 3))).T
                lines.append(of[a])
                keys.append(mixed(ls.tokens[a] * LANES[1] + ls.tokens[b] * LANES[2] + ls.tokens[c] * LANES[3]))
                at.append(pos[c] - 2)  # as if it were the first word in common
    lines = np.concatenate(lines)
    bit, upper = U(1) << ((ls.tokens >> U(57)) & U(63)), ls.tokens >> U(63) > 0
    signature, signature2 = (np.bitwise_xor.reduceat(np.where(upper == half, bit, U(0)), ls.first) if len(ls.first) else np.zeros(0, U) for half in (False, True))
    keys = np.concatenate(keys)
    out = np.empty(len(lines), POSTING)
    out["key"], out["sid"], out["sig"], out["sig2"] = keys >> U(32), ls.sid[lines], signature[lines], signature2[lines]
    out["doc"], out["line"], out["n"], out["pos"] = docs[ls.doc[lines]], ls.number[lines], ls.n[lines], np.concatenate(at)
    return keys & U(0xFFFFFFFF), out


def _distinct(entries: np.ndarray) -> np.ndarray:
    """Entries by key and length, each set once per key, at its first line."""
    upper = entries["key"].astype(U) << U(32)
    e = entries[np.argsort(upper | (entries["sid"] >> U(32)))]
    again = (e["key"][1:] == e["key"][:-1]) & (e["sid"][1:] >> U(32) == e["sid"][:-1] >> U(32))
    if again.any():  # a set from several tasks
        part = np.concatenate(([False], again)) | np.concatenate((again, [False]))
        own = e[part]
        own = own[np.lexsort((own["line"], own["doc"], own["sid"], own["key"]))]
        new = np.ones(len(own), bool)
        new[1:] = (own["key"][1:] != own["key"][:-1]) | (own["sid"][1:] != own["sid"][:-1])
        e = np.concatenate([e[~part], own[new]])
    return e[np.argsort((e["key"].astype(U) << U(32)) | e["n"].astype(U), kind="stable")]


class _Compare:
    """Filters on pairs of entries by their places."""

    def __init__(self, e: np.ndarray, p: LineParams):
        self.key, self.sid, self.sig, self.sig2, self.doc, self.line = (e[c].copy() for c in ("key", "sid", "sig", "sig2", "doc", "line"))
        self.n, self.left, self.p = e["n"].astype(np.int64), (e["n"] - e["pos"]).astype(np.int64), p

    def sized(self, short: np.ndarray, long: np.ndarray) -> np.ndarray:
        return (self.key[long] == self.key[short]) & (self.n[long] * self.p.num <= self.n[short] * self.p.den)

    def alike(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether places and signatures allow the threshold, and in how many bits the signatures differ."""
        p, both = self.p, self.n[i] + self.n[j]
        apart = np.bitwise_count(self.sig[i] ^ self.sig[j]).astype(np.int64) + np.bitwise_count(self.sig2[i] ^ self.sig2[j])
        return ((both - apart) * (p.num + p.den) >= 2 * p.num * both) & (np.minimum(self.left[i], self.left[j]) * (p.num + p.den) >= p.num * both), apart

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        doc, line, sid = self.doc, self.line, self.sid
        return (doc[a] > doc[b]) | ((doc[a] == doc[b]) & ((line[a] > line[b]) | ((line[a] == line[b]) & (sid[a] > sid[b]))))


def nearest(e: np.ndarray, p: LineParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier, more, spare) for entries e of _distinct, as places in e: for each later entry p.nearest earlier ones with signatures as near as any.

    more: entries that have others which aren't given; spare: these others, and
    the entries that have them. Entries of a key are in the order of length. All
    are compared with the next one, then with the next but one, and so on; an
    entry drops out when its key ends or lengths differ too much, which stays so.
    Where that takes more than p.window steps, all entries of the key count as
    more and spare. What is kept meanwhile is bounded by the number of entries.
    """
    c, active, d = _Compare(e, p), np.arange(len(e)), 0
    more, spare, reach = np.zeros(len(e), bool), np.zeros(len(e), bool), np.full(len(e), 1 << 30)
    none = [np.zeros(0, np.int64)] * 3
    kept, fresh, size = none, [], 0

    def leave(x: np.ndarray, y: np.ndarray) -> None:
        more[x] = spare[x] = spare[y] = True

    def cut(parts: list) -> list[np.ndarray]:
        x, y, apart = (np.concatenate(v) for v in zip(*parts, strict=True))
        order = np.argsort((x << 20) | np.minimum(apart, (1 << 20) - 1), kind="stable")
        x, y, apart = x[order], y[order], apart[order]
        nth = np.arange(len(x)) - np.searchsorted(x, x)
        leave(x[nth >= p.nearest], y[nth >= p.nearest])
        full = nth == p.nearest - 1
        reach[x[full]] = apart[full]
        return [v[nth < p.nearest] for v in (x, y, apart)]

    while True:
        d += 1
        active = active[: np.searchsorted(active, len(e) - d)]
        active = active[c.sized(active, active + d)]
        if not len(active):
            break
        j = active + d
        if d > p.window:
            whole = np.isin(c.key, np.unique(c.key[active]))
            more, spare = more | whole, spare | whole
            break
        yes, apart = c.alike(active, j)
        if yes.any():
            a, b, apart = active[yes], j[yes], apart[yes]
            later = c.after(a, b)
            x, y = np.where(later, a, b), np.where(later, b, a)
            near = apart < reach[x]
            leave(x[~near], y[~near])
            fresh.append((x[near], y[near], apart[near]))
            size += int(near.sum())
            if size > 1 << 15:
                kept, fresh, size = cut([kept, *fresh]), [], 0
    x, y, _ = cut([kept, *fresh])
    return x, y, more, spare


def every(e: np.ndarray, wanted: np.ndarray, p: LineParams, ordered: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(wanted, other) as places in e, of _distinct: all other entries, or all earlier ones, that the filters allow."""
    c = _Compare(e, p)
    ends = np.searchsorted(c.key, c.key, "right")
    starts = np.searchsorted(c.key, c.key)
    for i in np.flatnonzero(wanted):
        j = np.arange(starts[i], ends[i])
        j = j[(c.n[j] * p.den >= c.n[i] * p.num) & (c.n[j] * p.num <= c.n[i] * p.den) & (j != i)]
        i = np.full(len(j), i)
        j = j[c.alike(i, j)[0] & (c.after(i, j) if ordered else True)]
        if len(j):
            yield i[: len(j)], j


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return whole_texts(docs).select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text"))


def _lines(rows: DataFrame, bits: int) -> DataFrame:
    """In one pass over the texts: the sets of all lines with words (of: how many of them a text has; words: their size), and the words' counts (rows with a part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = buckets.Counter(bits)
        for batch in batches:
            for lo, _, buf, offs in chunks(batch.column(2)):
                ls = line_sets(buf, offs, None)
                own.add(ls.tokens)
                of = pa.array(lo + ls.doc)
                none = pa.nulls(len(ls.sid), pa.int32())
                data = pa.nulls(len(ls.sid), pa.binary())
                yield pa.RecordBatch.from_arrays([_signed(ls.sid), batch.column(0).take(of), batch.column(1).take(of), pa.array(ls.number.astype(np.int32)), pa.array(np.bincount(ls.doc)[ls.doc].astype(np.int32) if len(ls.doc) else np.zeros(0, np.int32)), pa.array(ls.n.astype(np.int32)), none, data, data], names=names)
        for part in own.parts():
            gap = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*gap, *part.columns], names=names)

    names = ["sid", "doc", "row", "line", "of", "words", "part", "at", "n"]
    return rows.mapInArrow(run, f"{LINES}, {buckets.PARTS_SCHEMA}")


def _bucket_count(lines: DataFrame, p: LineParams) -> int:
    """Buckets that entries are dealt to, so that one holds half of p.block_bytes on average, however many there are."""
    words = F.col("words")
    entries = lines.agg(F.sum(words - F.ceil(words * p.num / p.den) + 1)).first()[0] or 0
    least = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 4 * max(least, -(-entries * POSTING.itemsize // (2 * p.block_bytes)))


def _candidates(rows: DataFrame, table, hot: int, fan: int, p: LineParams) -> DataFrame:
    """x, y, more: a later set and an earlier one; or list: the entries, by key, of pairs that aren't given.

    A task holds up to p.block_bytes of entries of one of the 'fan' buckets. Where
    there are more, the entries of its commonest keys leave in blocks (those of
    all keys, if none is common): each block is compared in itself, is listed
    whole, with all of its sets as having more, and is part of a whole: first
    places are known in the block only, so its pairs may be the wrong way round.
    """

    def dealt(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        to, e = (np.concatenate(c) for c in zip(*found, strict=True))
        to = (to % U(fan)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.concatenate(([0], np.cumsum(np.bincount(to, minlength=fan))))
        used = np.flatnonzero(np.diff(cuts))
        yield pa.RecordBatch.from_pydict({"to": pa.array(used, pa.int32()), "entries": pa.array([e[order[cuts[i] : cuts[i + 1]]].tobytes() for i in used], pa.binary())})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            docs = batch.column(0).fill_null(LAST).to_numpy()
            for lo, _, buf, offs in chunks(batch.column(1)):
                to, e = postings(line_sets(buf, offs, table.value), docs[lo:], hot, p)
                found.append((to, e))
                held += e.nbytes
                if held > p.flush_bytes:
                    yield from dealt(found)
                    found, held = [], 0
        if found:
            yield from dealt(found)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, block = None, [], 0, 0
        common = np.zeros(0, np.uint32)  # keys whose entries leave in blocks
        every_key = False

        def rows(x: pa.Array, y: pa.Array, more: pa.Array, data: pa.Array) -> pa.RecordBatch:
            n = len(x)
            return pa.RecordBatch.from_arrays([x, y, more, pa.array(np.full(n, now, np.int32)), pa.array(np.full(n, block, np.int32)), data], names=names)

        def out(e: np.ndarray, part: bool) -> Iterator[pa.RecordBatch]:
            if not len(e):
                return
            e = _distinct(e)
            x, y, more, spare = nearest(e, p)
            if part:
                more[:] = spare[:] = True
            yield rows(_signed(e["sid"][x]), _signed(e["sid"][y]), pa.array(more[x]), pa.nulls(len(x), pa.binary()))
            # An entry with more but without one of its own stands alone in its row.
            lone, lists = np.setdiff1d(np.flatnonzero(more), x), e[spare]
            yield rows(_signed(e["sid"][lone]), pa.nulls(len(lone), pa.int64()), pa.array(np.ones(len(lone), bool)), pa.nulls(len(lone), pa.binary()))
            if len(lists):
                yield rows(pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([part]), pa.array([lists.tobytes()], pa.binary()))

        def full() -> Iterator[pa.RecordBatch]:
            """Let common keys leave; the others stay."""
            nonlocal held, size, block, common, every_key
            e = np.concatenate(held)
            keys, counts = np.unique(e["key"], return_counts=True)
            common = np.union1d(common, keys[counts * POSTING.itemsize > p.block_bytes // 8])
            leave = np.isin(e["key"], common)
            every_key = every_key or not leave.any()
            if every_key:
                leave[:] = True
            yield from out(e[leave], True)
            held, block = [e[~leave]], block + 1
            size = held[0].nbytes

        def last() -> Iterator[pa.RecordBatch]:
            e = np.concatenate(held)
            leave = np.ones(len(e), bool) if every_key else np.isin(e["key"], common)
            yield from out(e[leave], True)
            yield from out(e[~leave], False)

        for batch in batches:
            for to, entries in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(entries.as_buffer(), POSTING)
                if to != now:
                    if held:
                        yield from last()
                    now, held, size, block, common, every_key = to, [], 0, 0, common[:0], False
                elif size + data.nbytes > p.block_bytes:
                    yield from full()
                held.append(data)
                size += data.nbytes
        if held:
            yield from last()
        trim()

    names = ["x", "y", "more", "to", "block", "list"]
    spread = rows.select("doc", "text").mapInArrow(index, "to int, entries binary").repartitionById(fan // 4, F.expr("cast(to div 4 as int)")).sortWithinPartitions("to")
    return spread.mapInArrow(meet, "x long, y long, more boolean, to int, block int, list binary")


def _listed(lists: DataFrame) -> DataFrame:
    """sid: the sets in the lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield pa.RecordBatch.from_arrays([_signed(np.unique(np.frombuffer(data.as_buffer(), POSTING)["sid"]))], names=["sid"])

    return lists.mapInArrow(run, "sid long").distinct()


def _others(lists: DataFrame, wanted, p: LineParams) -> DataFrame:
    """x, y: all candidates in the lists of the sets with a flag; in parts of a list, which meet two by two, whatever their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1), strict=True):
                e = np.frombuffer(one.as_buffer(), POSTING)
                if two.is_valid:
                    e = _distinct(np.concatenate([e, np.frombuffer(two.as_buffer(), POSTING)]))
                for x, y in every(e, wanted.value.has(e["sid"]), p, not two.is_valid):
                    yield pa.RecordBatch.from_arrays([_signed(e["sid"][x]), _signed(e["sid"][y])], names=["x", "y"])

    whole = lists.filter("NOT part").select("list", F.lit(None).cast("binary").alias("other"))
    parts = lists.filter("part").select("to", "block", "list")
    other = parts.select("to", F.col("block").alias("block2"), F.col("list").alias("other"))
    met = parts.join(other, "to").filter("block < block2").select("list", "other")
    return whole.unionByName(met).mapInArrow(run, "x long, y long").distinct()


def _ordered(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """Of the pairs those whose x has its first line after that of y."""
    side = lambda c: first.select(F.col("sid").alias(c), F.struct("first.doc", "first.line", "sid").alias(f"{c}_at"))
    return pairs.join(side("x"), "x").join(side("y"), "y").filter("x_at > y_at").drop("x_at", "y_at")


def _tokens(rows: DataFrame, places: DataFrame, share) -> DataFrame:
    """sid, tokens of the sets in places (sid, row), each read where it first stands; other texts aren't taken apart."""
    need, where = share(buckets.flags(places, "sid")), share(buckets.flags(places, "row"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = where.value.has(batch.column(0).to_numpy().view(U))
            for _, _, buf, offs in chunks(batch.column(1).filter(pa.array(hit))):
                ls = line_sets(buf, offs, None)
                _, once = np.unique(ls.sid, return_index=True)
                once = once[need.value.has(ls.sid[once])]
                sets = [ls.tokens[ls.first[i] : ls.first[i] + ls.n[i]].tobytes() for i in once]
                yield pa.RecordBatch.from_arrays([_signed(ls.sid[once]), pa.array(sets, pa.binary())], names=["sid", "tokens"])

    return rows.select("row", "text").mapInArrow(fetch, "sid long, tokens binary").dropDuplicates(["sid"])


def _alike(pairs: DataFrame, sets: DataFrame, p: LineParams) -> DataFrame:
    """Later sets (x) of the pairs whose whole sets are alike."""
    both = pairs.join(sets.select(F.col("sid").alias("x"), F.col("tokens").alias("a")), "x").join(sets.select(F.col("sid").alias("y"), F.col("tokens").alias("b")), "y").select("x", "a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                u, v = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
                s = np.sort(np.concatenate([u, v]))
                common = int((s[1:] == s[:-1]).sum())
                yes[i] = common * (p.num + p.den) >= p.num * (len(u) + len(v))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(yes))], names=["x"])

    return both.mapInArrow(verify, "x long").distinct()


def removed_lines(docs: DataFrame, p: LineParams = LineParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, row, removed, left): for documents that lose lines, the numbers (from 0) of those lines, and how many lines with words stay.

    Lines are in the order of (key, line number); a null key comes last. A line
    goes if any earlier line is alike, whether that one stays or not. Lines
    without words always stay. Rows equal in key and text are one document: each
    loses the same lines. Texts are read three times: for counts and sets, for
    the index, and for the sets of candidates only.
    """
    spark = docs.sparkSession
    rows = _rows(docs, key, text)
    with Scratch(spark) as scratch:
        store, share = scratch.store, scratch.share
        told = store(_lines(rows, p.code_bits), "line-sets")
        lines = told.filter("part IS NULL").select("sid", "doc", "row", "line", "of", "words")
        rarity = buckets.table(told.filter("part IS NOT NULL").select("part", "at", "n"), p.code_bits)
        hot = int(buckets.code_of(np.array([max(p.frequent, math.ceil(64 * buckets.mean_count(rarity)))]))[0])
        place = F.struct(F.coalesce("doc", F.lit(LAST)).alias("doc"), "line", "row")
        first = store(lines.groupBy("sid").agg(F.min(place).alias("first"), F.count("*").alias("times")), "line-first")
        found = store(_candidates(rows, share(rarity), hot, _bucket_count(lines, p), p), "line-candidates")
        lists = found.filter("list IS NOT NULL").select("to", "block", F.col("more").alias("part"), "list")
        split = not lists.filter("part").isEmpty()
        # The likeliest earlier set first; the others only for lines that it doesn't decide.
        best = W.Window.partitionBy("x").orderBy(F.desc("shared"), "y")
        pairs = found.filter("y IS NOT NULL").groupBy("x", "y").agg(F.count("*").alias("shared"))
        pairs = _ordered(pairs, first) if split else pairs
        pairs = store(pairs.withColumn("nth", F.row_number().over(best)).drop("shared"), "line-pairs")
        more = found.filter("x IS NOT NULL AND more").select("x")
        sids = pairs.select(F.col("x").alias("sid")).union(pairs.select("y")).union(_listed(lists.select("list"))).distinct()
        places = store(first.join(sids, "sid", "left_semi").select("sid", "first.row"), "line-places")
        sets = store(_tokens(rows, places, share), "line-tokens")
        near = store(_alike(pairs.filter("nth = 1").select("x", "y"), sets, p), "line-alike")
        later = pairs.filter("nth > 1").select("x", "y").join(near, "x", "left_anti")
        near = store(near.union(_alike(later, sets, p)).distinct(), "line-alike")
        open_ = store(more.distinct().join(near, "x", "left_anti"), "line-open")
        if not open_.isEmpty():
            rest = _others(lists, share(buckets.flags(open_, "x")), p).join(open_, "x", "left_semi").join(pairs.select("x", "y"), ["x", "y"], "left_anti")
            rest = _ordered(rest, first) if split else rest
            near = store(near.union(_alike(rest, sets, p)).distinct(), "line-alike")
        # Only sets that occur again or have an earlier one alike lose lines.
        losing = first.join(near.select(F.col("x").alias("sid"), F.lit(True).alias("near")), "sid", "left").filter("times > 1 OR near")
        judged = lines.join(losing, "sid").filter(F.coalesce("near", F.lit(False)) | (place != F.col("first")))
        gone = judged.groupBy("doc", "row").agg(F.sort_array(F.collect_set("line")).alias("removed"), F.max("of").alias("of"))
        return stored(gone.select("doc", "row", "removed", (F.col("of") - F.size("removed")).alias("left")), "line-removed")


def _line_count(text: str) -> Column:
    count = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    return F.when(F.col(text).isNull(), 0).otherwise(count).cast("int")


def _judged(docs: DataFrame, p: LineParams, key: str, text: str, kept: list) -> tuple[DataFrame, Column, Column]:
    """The kept columns of docs beside its removed lines and the number of those left (null: none removed), under names that docs doesn't use."""
    own, row, gone, doc, lost, left = free(docs, "_key", "_hash", "_row", "_doc", "_removed", "_left")
    removed = removed_lines(docs, p, key, text).select(F.col("doc").alias(doc), F.col("row").alias(gone), F.col("removed").alias(lost), F.col("left").alias(left))
    rows = docs.select(*kept, F.col(key).cast("long").alias(own), F.xxhash64(F.col(key), F.col(text)).alias(row))
    return rows.join(removed, (F.col(row) == F.col(gone)) & F.col(own).eqNullSafe(F.col(doc)), "left").drop(own, row, gone, doc), F.col(lost), F.col(left)


def line_report(docs: DataFrame, p: LineParams = LineParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_lines and removed (empty: none) of every row; the decisions of removed_lines, without moving texts."""
    (count,) = free(docs, "_count")
    joined, lost, _ = _judged(docs, p, key, text, [F.col(key), _line_count(text).alias(count)])
    return joined.select(key, F.col(count).alias("n_lines"), F.coalesce(lost, F.array().cast("array<int>")).alias("removed"))


def dedup_lines(docs: DataFrame, p: LineParams = LineParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text without the lines that removed_lines names, and the columns n_lines, removed and n_left, the lines with words that stay (both null: none removed).

    Every row stays, with all its columns (own columns of these names are
    replaced); a text that loses all its lines is empty. Null text stays null
    with 0 lines. Lines end at U+000A only.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "removed", "n_left")]
    joined, lost, stay = _judged(docs, p, key, text, kept)
    lines = F.split(F.col(text), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
    clean = F.when(lost.isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return joined.select(*[clean.alias(c) if c == text else F.col(c) for c in kept], _line_count(text).alias("n_lines"), lost.alias("removed"), stay.alias("n_left"))
