"""MinHash near-dedup with bottom-k sketches of one hash function.

Documents with equal shingle sets are one class. A class keeps its k least
shingle hashes. Inverted lists of these give the overlaps: of a sketch, its
rarest values are listed, so many that two sketches of classes that are alike
share a listed value (prefix filter on the overlap of sketches). Classes that
share one with a class of like size are suspects; the others have no duplicate.

Suspects are listed again by the rarest of all their shingles, as many as the
threshold on whole sets asks for, with an odd sketch: 512 bits, of which each
shingle flips one, so that two sets differ in at least as many shingles as their
odd sketches in bits. Pairs that differ too much for the threshold end there. A list isn't expanded into its pairs. First
each class is compared with the first of its list (and of its range of sizes);
that joins groups of copies. After that only pairs of a list whose components
still differ and whose common values begin early enough are compared, so no link
between components is lost. The sketch of
a pair's union estimates its similarity and drops pairs far below the threshold;
the Jaccard similarity of whole sets decides about the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import buckets
from .common import Scratch, stored, whole_texts
from .graph import components
from .kernels import LANES, U, mixed, shingle_sets


ODD = [f"o{i}" for i in range(8)]


@dataclass(frozen=True)
class MinHashParams:
    """Sets are alike with Jaccard similarity of at least num/den. miss: chance that a pair alike fails the filters on its sketches."""

    words: int = 5
    num: int = 85
    den: int = 100
    k: int = 64
    miss: float = 1e-9
    first: int = 2

    @property
    def least(self) -> int:
        """Of the union's k least values, how many are common to a pair alike but for the chance 'miss'."""
        p, total = self.num / self.den, 0.0
        for c in range(self.k + 1):
            total += math.comb(self.k, c) * p**c * (1 - p) ** (self.k - c)
            if total > self.miss:
                return c
        return self.k


def _longs(a) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def sketches(docs: DataFrame, p: MinHashParams, key: str, text: str) -> DataFrame:
    """id, n (distinct shingles), two 64-bit marks of the whole set, and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, kept = [], [], [], []
            for s in shingle_sets(batch.column(1), p.words):
                n.append(len(s))
                a.append(mixed(s ^ LANES[5]).sum(dtype=U))
                b.append(np.bitwise_xor.reduce(mixed(s ^ LANES[6])) if len(s) else U(0))
                kept.append(s[: p.k].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), _longs(np.array(a, U)), _longs(np.array(b, U)), pa.array(kept, pa.binary())], names=["id", "n", "m1", "m2", "sketch"])

    return whole_texts(docs).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, m1 long, m2 long, sketch binary")


def _odd_sketch(s: np.ndarray) -> np.ndarray:
    flips = np.bincount((mixed(s) >> U(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def postings(sets: DataFrame, column: str, p: MinHashParams, whole: bool, share) -> DataFrame:
    """value, rep, n: the listed values of each class, from its sketch or its whole set; for whole sets also its place among the set's values by rarity and the odd sketch. Values that surely occur once are left out."""

    def values(batch: pa.RecordBatch) -> np.ndarray:
        # Hashes of a sketch are small numbers; mixed again they spread over the buckets.
        return mixed(np.frombuffer(b"".join(batch.column(0).to_pylist()), U))

    rarity, repeated = map(share, buckets.rarity_and_repeats(sets.select(column), values))
    odd = ["pos", *ODD] if whole else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, ns = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out, of, at, flips = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros((batch.num_rows, len(ODD)), np.int64)
            for i, data in enumerate(batch.column(2)):
                s = np.frombuffer(data.as_buffer(), U)
                n = int(ns[i])
                least = -(-p.num * n // p.den)
                if not whole and n * p.den > p.num * p.k:
                    least = min(least, p.least)
                h = mixed(s)
                listed = np.lexsort((s, rarity.value[buckets.bucket(h)], again := repeated.value.has(h)))[: len(s) - least + 1]
                place = np.flatnonzero(again[listed])
                listed = listed[place]
                out.append(s[listed])
                at.append(place)
                of.append(np.full(len(listed), i))
                if whole and len(listed):
                    flips[i] = _odd_sketch(s)
            of = np.concatenate(of)
            yield pa.RecordBatch.from_arrays([_longs(np.concatenate(out)), pa.array(reps[of]), pa.array(ns[of]), *([pa.array(np.concatenate(at)), *(pa.array(flips[of, i]) for i in range(len(ODD)))] if whole else [])], names=["value", "rep", "n", *odd])

    return sets.select("rep", "n", column).mapInArrow(run, ", ".join(f"{c} long" for c in ("value", "rep", "n", *odd)))


def suspects(listed: DataFrame, p: MinHashParams) -> DataFrame:
    """Classes that share a listed value with another class in a range of sizes."""
    keyed = _ranged(listed, p)
    shared = keyed.groupBy("value", "range").agg(F.count("*").alias("c")).filter("c > 1").select("value", "range")
    return keyed.join(shared, ["value", "range"], "left_semi").select("rep").distinct()


def whole_sets(docs: DataFrame, chosen: DataFrame, p: MinHashParams, key: str, text: str, share) -> DataFrame:
    """rep, n, set of the chosen keys. Texts are read where they are; only chosen rows become sets and move."""
    need = share(buckets.flags(chosen.select(F.xxhash64("rep").alias("h")), "h"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = need.value.has(batch.column(1).to_numpy().view(U))
            part = batch.filter(pa.array(hit))
            held, size, lo = [], 0, 0
            for s in shingle_sets(part.column(2), p.words) if part.num_rows else ():
                held.append(s)
                size += s.nbytes
                if size > 4 << 20 or lo + len(held) == part.num_rows:
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, len(held)), pa.array(map(len, held), pa.int64()), pa.array([x.tobytes() for x in held], pa.binary())], names=["rep", "n", "s"])
                    lo, held, size = lo + len(held), [], 0

    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(key).cast("long")).alias("h"), F.col(text).alias("text")).filter(F.col("id").isNotNull())
    return rows.mapInArrow(fetch, "rep long, n long, s binary")


def estimated(pairs: DataFrame, classes: DataFrame, p: MinHashParams) -> DataFrame:
    """x, y, estimate, near: near unless the sketches rule the pair out."""
    side = lambda c, s: classes.select(F.col("rep").alias(c), F.col("sketch").alias(s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            est, near = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                u, v = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
                s = np.sort(np.concatenate([u, v]))
                twice = s[1:] == s[:-1]
                size = len(s) - int(twice.sum())
                if size <= p.k:  # both sketches are whole sets
                    est[i] = (len(s) - size) / max(size, 1)
                    near[i] = (len(s) - size) * p.den >= p.num * size
                else:
                    rank = np.cumsum(np.concatenate(([True], ~twice)))  # of each value among the union's
                    common = int((twice & (rank[1:] <= p.k)).sum())
                    est[i], near[i] = common / p.k, common >= p.least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(est), pa.array(near)], names=["x", "y", "estimate", "near"])

    both = pairs.select("x", "y").join(side("x", "a"), "x").join(side("y", "b"), "y").select("x", "y", "a", "b")
    return both.mapInArrow(run, "x long, y long, estimate double, near boolean")


def verified(pairs: DataFrame, sets: DataFrame, p: MinHashParams) -> DataFrame:
    """Of pairs x, y those whose whole sets are alike."""
    side = lambda c, name: sets.select(F.col("rep").alias(c), F.col("s").alias(name))
    both = pairs.select("x", "y").join(side("x", "a"), "x").join(side("y", "b"), "y").select("x", "y", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                s = np.sort(np.concatenate([np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)]))
                common = int((s[1:] == s[:-1]).sum())
                yes[i] = common * p.den >= p.num * (len(s) - common)
            yield batch.select([0, 1]).filter(pa.array(yes))

    return both.mapInArrow(run, "x long, y long").distinct()


def _likely(p: MinHashParams):
    """Whether a posting and another (m and q0.. for n and o0..) can be alike by their sizes and odd sketches."""
    apart = F.lit(0)
    for i, o in enumerate(ODD):
        apart = apart + F.bit_count(F.col(o).bitwiseXOR(F.col(f"q{i}")))
    both = F.col("n") + F.col("m")
    sized = (F.least("n", "m") * p.den) >= (F.greatest("n", "m") * p.num)
    return sized & (apart * (p.den + p.num) <= both * (p.den - p.num))


def _ranged(listed: DataFrame, p: MinHashParams) -> DataFrame:
    """Each posting in two ranges of sizes, shifted by half a range: a range is a little over twice as wide as sizes alike lie apart, so these share one."""
    step = F.log(F.col("n")) / (2.001 * math.log(p.den / p.num))
    ranges = F.array(F.floor(step) * 2, F.floor(step + 0.5) * 2 + 1)
    return listed.withColumn("range", F.explode(ranges))


def _stars(listed: DataFrame, p: MinHashParams) -> DataFrame:
    """Each class with the first of its list in its range of sizes."""
    keyed = _ranged(listed, p)
    first = keyed.groupBy("value", "range").agg(F.min(F.struct("rep", "n", *ODD)).alias("f"), F.count("*").alias("c")).filter("c > 1")
    first = first.select("value", "range", F.col("f.rep").alias("y"), F.col("f.n").alias("m"), *(F.col(f"f.{o}").alias(f"q{i}") for i, o in enumerate(ODD)))
    return keyed.join(first, ["value", "range"]).filter((F.col("rep") != F.col("y")) & _likely(p)).select(F.col("rep").alias("x"), "y").distinct()


def _room(n, pos, other, p: MinHashParams):
    """Whether a class of n values whose first common value is at pos can be alike to one of 'other' values: what follows is all that can be common."""
    return (n - pos) * (p.num + p.den) >= (n + other) * p.num


def _across(listed: DataFrame, roots: DataFrame, p: MinHashParams, store) -> DataFrame:
    """Pairs of a list, in a range of sizes, whose components differ and whose sizes, places and odd sketches allow the threshold.

    In a pair alike the shorter class has its first common value so early that it
    leaves room for one of its own size. So only such postings are joined with
    the list: where many documents share a template below the threshold, their
    rarer values come first, none of them is early, and the list gives no pair.
    """
    own = listed.join(roots.select(F.col("a").alias("rep"), F.col("b").alias("root")), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    split = own.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("value")
    own = store(_ranged(own.join(split, "value", "left_semi"), p), "near-open")
    early = own.filter(_room(F.col("n"), F.col("pos"), F.col("n"), p))
    other = own.select("value", "range", F.col("rep").alias("y"), F.col("n").alias("m"), F.col("pos").alias("pos2"), F.col("root").alias("root2"), *(F.col(o).alias(f"q{i}") for i, o in enumerate(ODD)))
    fits = (F.col("root") != F.col("root2")) & (F.col("n") <= F.col("m")) & _room(F.col("n"), F.col("pos"), F.col("m"), p) & _room(F.col("m"), F.col("pos2"), F.col("n"), p)
    return early.join(other, ["value", "range"]).filter(fits & _likely(p)).select(F.greatest("rep", "y").alias("x"), F.least("rep", "y").alias("y")).distinct()


def near_duplicates(docs: DataFrame, p: MinHashParams = MinHashParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_shingles, component_id, kept.

    Words are runs of anything but U+0020 and U+0009-000D, A-Z in lower case; a
    text of fewer than p.words words has its whole sequence as one shingle, a
    null or empty text none. Sets are linked if their Jaccard similarity is at
    least num/den. component_id is the least key reachable by links, its own
    included; kept: key equals it. Texts without words link with nothing. Rows
    with a null key link with nothing, have component_id null and are kept. Rows
    that repeat a key are one node.
    """
    with Scratch(docs.sparkSession) as scratch:
        store, share = scratch.store, scratch.share
        rows = store(sketches(docs, p, key, text), "sketches")
        sets = rows.filter("n > 0 AND id IS NOT NULL")
        classes = store(sets.groupBy("m1", "m2", "n").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch")), "near-classes")
        doubtful = store(suspects(store(postings(classes, "sketch", p, False, share), "near-lists"), p), "near-suspects")
        whole = store(whole_sets(docs, doubtful, p, key, text, share), "near-sets")
        listed = store(postings(whole, "s", p, True, share), "near-lists")
        tried = store(estimated(_stars(listed, p), classes, p), "near-stars")
        best = W.Window.partitionBy("x").orderBy(F.desc("estimate"), "y")
        chosen = store(tried.filter("near").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= p.first).select("x", "y"), "near-chosen")
        links = store(verified(chosen, whole, p), "near-links")
        roots = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")), store)
        done = tried.filter("NOT near").select("x", "y").union(chosen)
        rest = _across(listed, roots, p, store).join(done, ["x", "y"], "left_anti")
        rest = store(estimated(rest, classes, p).filter("near").select("x", "y"), "near-rest")
        more = store(verified(rest, whole, p), "near-links")
        if not more.isEmpty():
            roots = components(links.union(more).select(F.col("x").alias("a"), F.col("y").alias("b")), store)
        found = classes.select("m1", "m2", "n", "rep").join(roots.select(F.col("a").alias("rep"), F.col("b").alias("root")), "rep", "left")
        found = found.select("m1", "m2", "n", F.coalesce("root", "rep").alias("root"))
        linked = sets.select("id", "n", "m1", "m2").join(found, ["m1", "m2", "n"]).select("id", "n", "root")
        alone = rows.filter("NOT (n > 0 AND id IS NOT NULL)").select("id", "n", F.col("id").alias("root"))
        out = stored(linked.unionByName(alone), "near-duplicates")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.col("id").eqNullSafe(F.col("root")).alias("kept"))
