"""Cross-tokenizer alignment through a dictionary of groups.

A text's tokens of two vocabularies are cut where tokens of both end; what lies
between two such places is a group, its A ids and its B ids. Every pair of an A
and a B token of a group is a link. Texts hold few different groups, so links
are never listed by document: a block of documents interns its groups and sends
each once with the number of its documents that hold it. The corpus-wide
dictionary sums these up, each distinct group is expanded to its links once,
and what links are worth comes back to the blocks by the group's key.

A pair that a document holds in several different groups would count once for
each: blocks also send, by pair, how often that is too many.

Blocks rest on units, cut at a space after a character that isn't white space:
there a piece of the byte-level vocabulary always begins, and no piece of the
other one has a space behind another character. A worker aligns each unit once;
units are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, odd_space
from .common import Scratch, stored, whole_texts
from .kernels import SPACES, U, chunks, edges, span_hashes

BLOCK_BYTES = 2 << 20
KEEP = 1 << 18  # units that a worker remembers
DOC, GROUP, EXTRA = 0, 1, 2
FACTS = "kind int, block long, key long, n_a long, n_b long, n_groups long, n_links long, sha string, seq binary, gid int, ids string, docs long, a int, b int"
_ARROW = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("key", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("sha", pa.string()), ("seq", pa.binary()), ("gid", pa.int32()), ("ids", pa.string()), ("docs", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
_open: dict[tuple[str, str], "Aligner"] = {}


def aligner(a_path: str, b_path: str) -> "Aligner":
    """One per Python worker and pair of files."""
    if (a_path, b_path) not in _open:
        _open[a_path, b_path] = Aligner(a_path, b_path)
    return _open[a_path, b_path]


def common_cuts(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """How many A and B tokens end at or before each place where tokens of both end, from their sizes in bytes."""
    out, i, j, at, bt = [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at <= bt and i < len(a):
            at, i = at + a[i], i + 1
        else:
            bt, j = bt + b[j], j + 1
        if at == bt:
            out.append((i, j))
    return out


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        self.a = encoder(a_path, added=False)
        back = {chr(c): i for i, c in enumerate(self.a.byte_chars)}
        self.a_bytes = [bytes(back.get(c, 0) for c in self.a.tok.id_to_token(i) or "") for i in range(self.a.tok.get_vocab_size())]
        self.b = SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size())):
            raise ValueError("the vocabulary has pieces with a space behind another character: texts can't be cut at spaces")
        self.space = self.b.piece_to_id("▁")
        self._forget()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b"\xff"  # equals no text
        return piece.replace("▁", " ").encode()

    def _forget(self) -> None:
        self.keys, self.units = np.zeros(0, U), np.zeros((5, 0), np.int64)  # start and size in the pool, A ids, B ids, whether the bytes agree
        self.pool = np.zeros(0, np.int64)
        self.numbers: dict[str, int] = {}
        self.ids: list[str] = []
        self.links: list[int] = []
        self.pairs: list[list[int]] = []  # distinct pairs of a group, a * 2^32 + b

    def _group(self, a: list[int], b: list[int]) -> int:
        name = f"{','.join(map(str, a))}|{','.join(map(str, b))}"
        if name not in self.numbers:
            self.numbers[name] = len(self.ids)
            self.ids.append(name)
            self.links.append(len(a) * len(b))
            self.pairs.append([x << 32 | y for x in set(a) for y in set(b)])
        return self.numbers[name]

    def _learn(self, keys: np.ndarray, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        raw = buf.tobytes()
        texts = [raw[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)]
        ends = np.cumsum(e - s)
        ids, counts = self.a.encode_chunk(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], ends)))
        upto = np.cumsum(counts)
        ids = ids.tolist()
        rest = self.b.encode([t[1:].decode() for t in texts], num_threads=1)
        found, rows = [], np.zeros((5, len(texts)), np.int64)
        at = len(self.pool)
        for i, (text, b) in enumerate(zip(texts, rest, strict=True)):
            a, b = ids[upto[i] - counts[i] : upto[i]], b if len(text) > 1 else [self.space]
            pa_, pb = [self.a_bytes[x] for x in a], [self.b_bytes[x] for x in b]
            agree = b"".join(pa_) == text and b"".join(pb) == text
            groups = []
            if agree:
                u = v = 0
                for x, y in common_cuts([len(t) for t in pa_], [len(t) for t in pb]):
                    groups.append(self._group(a[u:x], b[v:y]))
                    u, v = x, y
            rows[:, i] = at + len(found), len(groups), len(a), len(b), agree
            found += groups
        self.pool = np.concatenate([self.pool, np.array(found, np.int64)])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.units = np.insert(self.keys, place, keys), np.insert(self.units, place, rows, axis=1)

    def align(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(groups of all texts one after another, how many each text has, A ids, B ids of each); a text whose bytes the ids don't give back, and an empty one, has none."""
        docs, n = len(offs) - 1, len(buf)
        zero = np.zeros(docs, np.int64)
        if not n:
            return zero[:0], zero, zero, zero
        white = SPACES[buf]
        odd = odd_space(buf)
        white[odd + np.where(buf[odd] == 0xC2, 1, 2)] = True  # the last byte of the character
        cut = edges(offs, n)[:-1]
        cut[1:] |= (buf[1:] == 0x20) & ~white[:-1]
        s = np.flatnonzero(cut)
        e = np.append(s[1:], n)
        keys, where, back = np.unique(span_hashes(buf, s, e), return_index=True, return_inverse=True)
        if len(self.keys) > KEEP:
            self._forget()
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(place, len(self.keys) - 1)] != keys
        if new.any():
            self._learn(keys[new], buf, s[where[new]], e[where[new]])
            place = np.searchsorted(self.keys, keys)
        start, size, a, b, agree = self.units[:, place][:, back]
        of = np.searchsorted(offs, s, "right") - 1
        good = np.bincount(of, minlength=docs) == np.bincount(of, agree, docs)
        size = np.where(good[of], size, 0)
        ends = np.cumsum(size)
        seq = self.pool[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]
        total = lambda x: np.where(good, np.bincount(of, x, docs), 0).astype(np.int64)
        return seq, total(size), total(a), total(b)


def _rows(kind: int, block: int, n: int, **columns) -> pa.RecordBatch:
    given = {"kind": np.full(n, kind, np.int32), "block": np.full(n, block, np.int64), **columns}
    return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def _block(al: Aligner, block: int, keys: pa.Array, buf: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Facts of a block: its documents, its groups, and pairs that documents hold in several groups."""
    docs = len(keys)
    seq, size, n_a, n_b = al.align(buf, offs)
    used, local = np.unique(seq, return_inverse=True)
    names = [al.ids[g] for g in used.tolist()]
    links = np.array([al.links[g] for g in used.tolist()], np.int64)
    upto = np.concatenate(([0], np.cumsum(size)))
    of = np.repeat(np.arange(docs), size)
    n_links = np.bincount(of, links[local], docs).astype(np.int64) if len(seq) else np.zeros(docs, np.int64)
    kind = np.uint16 if len(used) <= 1 << 16 else np.uint32
    local_ids = local.astype(kind)
    shas, seqs = [], []
    for lo, hi in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        own = local_ids[lo:hi]
        shas.append(sha256(";".join([names[g] for g in own.tolist()]).encode()).hexdigest() if hi > lo else "")
        seqs.append(own.tobytes())
    yield _rows(DOC, block, docs, key=keys, n_a=n_a, n_b=n_b, n_groups=size, n_links=n_links, sha=shas, seq=seqs)
    if not len(seq):
        return

    held = np.unique(of * len(used) + local)
    doc, group = held // len(used), held % len(used)
    yield _rows(GROUP, block, len(used), gid=np.arange(len(used)), ids=names, docs=np.bincount(group, minlength=len(used)))

    counts = np.array([len(al.pairs[g]) for g in used.tolist()], np.int64)
    pairs, pair_no = np.unique(np.array([p for g in used.tolist() for p in al.pairs[g]], np.int64), return_inverse=True)
    start = np.cumsum(counts) - counts
    several = np.bincount(pair_no)[pair_no] > 1  # only pairs of several groups can be held twice
    worth = np.add.reduceat(several, start) > 0
    doc, group = doc[worth[group]], group[worth[group]]
    n = counts[group]
    ends = np.cumsum(n)
    if len(n):
        which = pair_no[np.repeat(start[group] - (ends - n), n) + np.arange(ends[-1])]
        both, times = np.unique(np.repeat(doc, n) * len(pairs) + which, return_counts=True)
        extra = np.bincount(both % len(pairs), times - 1, len(pairs)).astype(np.int64)
        hit = np.flatnonzero(extra)
        if len(hit):
            yield _rows(EXTRA, block, len(hit), docs=extra[hit], a=pairs[hit] >> 32, b=pairs[hit] & 0xFFFFFFFF)


def _facts(docs: DataFrame, a_path: str, b_path: str, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        al, number = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_string())
            spaced = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
            for lo, hi, buf, offs in chunks(spaced, BLOCK_BYTES):
                yield from _block(al, number, batch.column(0).slice(lo, hi - lo), buf, offs)
                number += 1

    return whole_texts(docs).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, FACTS)


def _back(docs: pa.Table, values: pa.Table) -> pa.Table:
    """A block's documents with the sums of their groups' values."""
    many = values.num_rows
    best, count = np.zeros(many, np.int64), np.zeros(many, np.int64)
    gid = values.column("gid").to_numpy()
    best[gid], count[gid] = values.column("n_best").to_numpy(), values.column("count_sum").to_numpy()
    kind = np.uint16 if many <= 1 << 16 else np.uint32
    local = [np.frombuffer(s, kind) for s in docs.column("seq").to_pylist()]
    out = docs.drop_columns(["block", "seq"])
    for name, value in (("n_best", best), ("count_sum", count)):
        out = out.append_column(name, pa.array([int(value[x].sum()) for x in local], pa.int64()))
    return out


def _split(part: int):
    return F.split(F.substring_index("ids", "|", 1 if part == 0 else -1), ",")


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A's texts are space and text, B's the text (B adds the space). Null and empty
    texts, and texts that the ids of A or B don't give back byte by byte, have no
    tokens: zeros and ''. A link's count is the number of rows with that pair of
    ids linked; repeated keys and rows are documents of their own.

    A block is about 2 MB of consecutive texts, or one longer text; what comes
    back to it is as large as its own dictionary. Only the highest count by A id
    is broadcast: at most one row for each id of A's vocabulary.
    """
    with Scratch(docs.sparkSession) as scratch:
        facts = scratch.store(_facts(docs, a_path, b_path, key, text), "alignments")
        entries = facts.filter(F.col("kind") == GROUP).select("block", "gid", "ids", "docs")
        groups = entries.groupBy("ids").agg(F.sum("docs").alias("docs"))
        links = groups.select("ids", "docs", F.explode(_split(0)).alias("a")).select("ids", "docs", "a", F.explode(_split(1)).alias("b"))
        links = links.groupBy("ids", "docs", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")).agg(F.count("*").alias("times"))
        links = scratch.store(links, "group-links")

        extra = facts.filter(F.col("kind") == EXTRA).select("a", "b", (-F.col("docs")).alias("docs"))
        pairs = scratch.store(links.select("a", "b", "docs").unionByName(extra).groupBy("a", "b").agg(F.sum("docs").alias("n")), "token-pairs")
        most = pairs.groupBy("a").agg(F.max("n").alias("most"))
        pairs = pairs.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))

        values = links.join(pairs, ["a", "b"]).groupBy("ids").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        values = entries.join(values, "ids").select(F.col("block").alias("of"), "gid", "n_best", "count_sum")
        rows = facts.filter(F.col("kind") == DOC).select("block", "key", "n_a", "n_b", "n_groups", "n_links", "sha", "seq")
        out = rows.groupBy("block").cogroup(values.groupBy("of")).applyInArrow(_back, "key long, n_a long, n_b long, n_groups long, n_links long, sha string, n_best long, count_sum long")
        out = stored(out, "alignment")
    return out.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("sha").alias("groups_sha256"))
