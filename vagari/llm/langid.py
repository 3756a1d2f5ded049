"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter with its two neighbours
(a letter, or the break before or after a word) binds to a trigram vector: the
product of the three vectors, rotated by their position. A text's profile is
the sum of its trigram vectors; a language's prototype is the sum of its texts'
unit profiles. The prototype with the highest cosine names a text's language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_texts
from .kernels import chunks

DENSE = 1 << 22
BLOCK = 2048


@dataclass(frozen=True)
class LangParams:
    """per_language: about so many labelled texts of each language are learned from, chosen by hash; all where there are fewer. Every language that a learned row names has a prototype; texts are compared with 'at_once' of these at a time."""

    dims: int = 1024
    per_language: int = 2000
    folds: int = 5
    seed: int = 7
    at_once: int = 1000
    chunk_bytes: int = 1 << 19


_letters: list[np.ndarray] = []
_signs: list[np.ndarray] = []
_vectors: dict[tuple[int, int, int], np.ndarray] = {}


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def signs() -> np.ndarray:
    if not _signs:
        _signs.append(np.fromiter((category(chr(i))[0] in "PS" for i in range(0x110000)), bool, 0x110000))
    return _signs[0]


def character_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and signs of each text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return tuple(np.bincount(of[table[points]], minlength=len(texts)).astype(np.int64) for table in (letters(), signs()))


def letter_vector(code: int, dims: int, seed: int) -> np.ndarray:
    """The vector of a code point; 0 is the break between words."""
    key = (code, dims, seed)
    if key not in _vectors:
        if len(_vectors) > 4096:
            _vectors.clear()
        _vectors[key] = (np.random.default_rng([seed, code]).integers(0, 2, dims, np.int8) * 2 - 1).astype(np.int8)
    return _vectors[key]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, codes, text, trigram): code points in use, each trigram as three indices into these, and text and trigram of each occurrence, in the order of text."""
    low = [t.lower() for t in texts]
    points = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    text_of = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    is_letter = letters()[points]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first break after a letter
    keep[0] = True
    points, text_of, is_letter = np.where(is_letter, points, 0)[keep], text_of[keep], is_letter[keep]
    symbols, index = np.unique(points, return_inverse=True) if len(points) < 4096 else _compact(points)
    mid = np.flatnonzero(is_letter)
    k = len(symbols)
    brk = int(np.searchsorted(symbols, 0)) if k and symbols[0] == 0 else 0
    left = np.where(mid > 0, index[mid - 1], brk)
    code = (left * k + index[mid]) * k + index[np.minimum(mid + 1, len(index) - 1)]
    if k**3 <= DENSE:
        used = np.flatnonzero(np.bincount(code, minlength=1))
        col = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.int64)
        col[used] = np.arange(len(used))
        col = col[code] if len(code) else code
    else:
        used, col = np.unique(code, return_inverse=True)
    codes = np.stack([used // (k * k), used // k % k, used % k]) if len(used) else np.zeros((3, 0), np.int64)
    return symbols, codes, text_of[mid], col


def _compact(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    symbols = np.flatnonzero(np.bincount(points))
    index = np.zeros(int(symbols[-1]) + 1, np.int64)
    index[symbols] = np.arange(len(symbols))
    return symbols, index[points]


def profiles(texts: list[str], p: LangParams) -> np.ndarray:
    """Unit profile of each text; a text without letters has zeros. Memory is bounded by BLOCK vectors of p.dims, whatever the script."""
    symbols, codes, of, trigram = trigrams(texts)
    out, n = np.zeros((len(texts), p.dims), np.float32), codes.shape[1]
    if n:
        own = np.stack([letter_vector(int(c), p.dims, p.seed) for c in symbols])
        first, second, third = np.roll(own, 2, axis=1), np.roll(own, 1, axis=1), own
        bound = lambda at: (first[codes[0, at]] * second[codes[1, at]] * third[codes[2, at]]).astype(np.float32)
        pair = of * n + trigram
        if len(texts) * n <= DENSE:
            counts = np.bincount(pair, minlength=len(texts) * n).reshape(len(texts), n)
            for lo in range(0, n, BLOCK):
                out += counts[:, lo : lo + BLOCK].astype(np.float32) @ bound(np.arange(lo, min(lo + BLOCK, n)))
        else:  # texts that share few trigrams
            pair, count = np.unique(pair, return_counts=True)
            for lo in range(0, len(pair), BLOCK):
                own, times = pair[lo : lo + BLOCK], count[lo : lo + BLOCK, None].astype(np.float32)
                starts = np.flatnonzero(np.diff(own // n, prepend=-1))
                out[own[starts] // n] += np.add.reduceat(bound(own % n) * times, starts, axis=0)
    size = np.linalg.norm(out.astype(np.float64), axis=1, keepdims=True)
    return (out / np.where(size > 0, size, 1)).astype(np.float32)


def _texts(column: pa.Array, limit: int) -> Iterator[tuple[int, int, list[str]]]:
    for lo, hi, _, _ in chunks(column, limit):
        yield lo, hi, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


def fold(key: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


def learn(docs: DataFrame, p: LangParams, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototype of each language, from rows with text, lang and key outside fold 0.

    The driver gets a count and a vector of p.dims numbers for each language, no
    rows: the classifier's size. Null keys
    are never learned from. Languages none of whose sampled texts has a letter
    get no prototype.
    """
    rows = whole_texts(docs).select(F.col(key).alias(key), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(key, p.folds) != 0))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return {}
    scale = 1 << 30
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("learn")), F.lit(scale))
    shares = docs.sparkSession.createDataFrame([(r.lang, min(scale, -(-scale * p.per_language // r["count"]))) for r in counts], "lang string, share long")
    sample = rows.join(F.broadcast(shares), "lang").filter(draw < F.col("share")).select("lang", "text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, hi, texts in _texts(batch.column(1), p.chunk_bytes):
                for name, vector in zip(langs[lo:hi], profiles(texts, p), strict=True):
                    sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    parts = sample.mapInArrow(add, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    # Sums of integers don't depend on the order in which parts arrive.
    total = parts.groupBy("lang", "i").agg(F.sum(F.round(F.col("x") * (1 << 20)).cast("long")).alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect():
        v = np.array([x.x for x in r.v], np.float64)
        if np.linalg.norm(v):
            out[r.lang] = v / np.linalg.norm(v)
    return dict(sorted(out.items()))


def nearest(own: np.ndarray, matrix: np.ndarray, at_once: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the column with the highest product, the first among equals, and the product."""
    best, high = np.zeros(len(own), np.int64), np.full(len(own), -np.inf, np.float32)
    for lo in range(0, matrix.shape[1], at_once):
        cos = own @ matrix[:, lo : lo + at_once]
        at = cos.argmax(axis=1)
        top = cos[np.arange(len(own)), at]
        better = top > high
        best[better], high[better] = lo + at[better], top[better]
    return best, high


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], p: LangParams, text: str = "text", counts: bool = False) -> DataFrame:
    """docs with lang_pred and score, which replace columns of these names; with 'counts' also n_letters and n_signs, how many letters and punctuation marks or symbols a text has.

    score is the cosine with the winning prototype, at least 0; equal cosines go
    to the first language by name. Null text and text without a letter, and every
    text if nothing was learned: 'und' with score 0. Only the text is read.
    """
    names = list(prototypes)
    matrix = docs.sparkSession.sparkContext.broadcast(np.stack([prototypes[n] for n in names]).T.astype(np.float32)) if names else None
    added = ["lang_pred", "score", *(["n_letters", "n_signs"] if counts else [])]
    kept = [c for c in docs.columns if c not in added]
    source = whole_texts(docs.select(*kept))
    at = kept.index(text)
    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *(T.StructField(c, T.LongType()) for c in added[2:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in _texts(batch.column(at), p.chunk_bytes):
                pred, score = ["und"] * len(texts), np.zeros(len(texts))
                if names:
                    own = profiles(texts, p)
                    best, high = nearest(own, matrix.value, p.at_once)
                    for i in np.flatnonzero(np.abs(own).sum(axis=1) > 0):
                        pred[i], score[i] = names[best[i]], min(1.0, max(0.0, float(high[i])))
                part = batch.slice(lo, hi - lo)
                more = [pa.array(c) for c in character_counts(texts)] if counts else []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score), *more], names=[*kept, *added])

    return source.mapInArrow(run, schema)


def accepted(least: float = 0.12, letters: int = 40, share: float = 0.8) -> Column:
    """Of the rows of identify with counts those with a language: not 'und', and, where there are letters enough to tell, not unlike all languages and not dressed in signs.

    The first asks for a cosine of at least 'least', the second for letters to be
    at least 'share' of letters and signs (punctuation and symbols): running text
    has fewer signs, whatever its language; digits count for neither.
    """
    written = F.col("n_letters") >= share * (F.col("n_letters") + F.col("n_signs"))
    return (F.col("lang_pred") != "und") & (((F.col("score") >= least) & written) | (F.col("n_letters") < letters))


def predict(docs: DataFrame, p: LangParams = LangParams(), key: str = "doc_id") -> DataFrame:
    """key, held_out, lang_pred, score: learned outside fold 0, predicted for every row. A null key is not held out."""
    model = learn(docs, p, key)
    rows = docs.select(F.col(key), F.coalesce(fold(key, p.folds) == 0, F.lit(False)).alias("held_out"), F.col("text"))
    return identify(rows, model, p).drop("text")
