"""Main text of web pages by a recurrent block labeller.

A page's blocks are a sequence. Each is read as a vector of its tag path
(hashed names of elements, classes and ids), of its hashed words, and of a few
numbers (length, links, signs, place). A bidirectional LSTM in numpy runs over
the whole page, so each block is judged by what stands before and after it.

It is trained on pages drawn from labelled layouts (`layouts`), which doesn't
depend on the table: about half a minute on the driver, once per Spark session
and parameters. The weights, of fixed size, go to the tasks; pages are labelled
where they are read, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_texts
from .html_blocks import BUCKETS, Paths, page_blocks
from .kernels import LOWERED, span_hashes, words
from .layouts import MAIN, REST, Layouts

NUMBERS = 11
SLICE = 4096  # blocks whose words are counted at a time
KEEP = 1 << 16  # paths that a worker remembers
PAGES = 256


@dataclass(frozen=True)
class ExtractParams:
    """pages, epochs, batch, rate, seed: of the training; unread: share of blocks whose words are hidden in it, so that paths and places are learned as well. A block is main text from 'threshold' on."""

    pages: int = 2500
    epochs: int = 8
    batch: int = 64
    seed: int = 11
    word_buckets: int = 512
    embed: int = 40
    hidden: int = 32
    rate: float = 8e-3
    unread: float = 0.4
    threshold: float = 0.5


class Sequences:
    """Blocks of many pages, and the order in which a recurrent layer reads them: at step t the t-th block of each page that has so many, longest pages first."""

    def __init__(self, sizes: np.ndarray):
        ends = np.cumsum(sizes)
        order = np.argsort(-sizes, kind="stable")
        self.starts, self.ends = (ends - sizes)[order], ends[order]
        self.n = int(ends[-1]) if len(sizes) else 0
        steps = int(sizes.max()) if len(sizes) else 0
        self.alive = np.searchsorted(-sizes[order], -np.arange(steps), "left")  # pages with more than t blocks

    def rows(self, t: int, backward: bool) -> np.ndarray:
        k = self.alive[t]
        return self.ends[:k] - 1 - t if backward else self.starts[:k] + t


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction. Weights: w (inputs by 4 hidden), u (hidden by 4 hidden), b; gates in the order input, forget, output, candidate."""

    def __init__(self, w: np.ndarray, u: np.ndarray, b: np.ndarray, backward: bool):
        self.w, self.u, self.b, self.backward, self.h = w, u, b, backward, u.shape[0]

    def forward(self, x: np.ndarray, seq: Sequences, keep: bool = False) -> np.ndarray:
        n, h = seq.n, self.h
        into, out = x @ self.w + self.b, np.zeros((n, h), x.dtype)
        state, cell = (np.zeros((len(seq.starts), h), x.dtype) for _ in range(2))
        self.trace = []
        for t in range(len(seq.alive)):
            rows = seq.rows(t, self.backward)
            k = len(rows)
            before, cell_before = state[:k], cell[:k]
            z = into[rows] + before @ self.u
            gates, cand = sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            now = gates[:, h : 2 * h] * cell_before + gates[:, :h] * cand
            bent = np.tanh(now)
            if keep:
                self.trace.append((rows, gates, cand, bent, before.copy(), cell_before.copy()))
            cell[:k] = now
            state[:k] = out[rows] = gates[:, 2 * h :] * bent
        return out

    def backprop(self, x: np.ndarray, d_out: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        h = self.h
        d_into, d_u = np.zeros((len(x), 4 * h), x.dtype), np.zeros_like(self.u)
        most = len(self.trace[0][0])
        d_state, d_cell = (np.zeros((most, h), x.dtype) for _ in range(2))
        for rows, gates, cand, bent, before, cell_before in reversed(self.trace):
            k = len(rows)
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            dh = d_state[:k] + d_out[rows]
            dc = d_cell[:k] + dh * o * (1 - bent * bent)
            dz = np.concatenate([dc * cand * i * (1 - i), dc * cell_before * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - cand * cand)], axis=1)
            d_into[rows] = dz
            d_u += before.T @ dz
            d_state[:k] = dz @ self.u.T
            d_cell[:k] = dc * f
        return d_into @ self.w.T, [x.T @ d_into, d_u, d_into.sum(axis=0)]


class Labeller:
    """Weights by name: paths, words, numbers and bias make a block's vector; two LSTMs and the vector make its label."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.p = weights
        self.lstms = [Lstm(weights[f"w{d}"], weights[f"u{d}"], weights[f"b{d}"], d == 1) for d in (0, 1)]

    @classmethod
    def fresh(cls, p: ExtractParams) -> "Labeller":
        r = np.random.default_rng(p.seed)
        draw = lambda *shape, by: (r.standard_normal(shape) / by**0.5).astype(np.float32)
        out = {"paths": draw(BUCKETS, p.embed, by=16), "words": draw(p.word_buckets, p.embed, by=16), "numbers": draw(NUMBERS, p.embed, by=NUMBERS), "bias": np.zeros(p.embed, np.float32)}
        for d in (0, 1):
            bias = np.zeros(4 * p.hidden, np.float32)
            bias[p.hidden : 2 * p.hidden] = 1
            out |= {f"w{d}": draw(p.embed, 4 * p.hidden, by=p.embed), f"u{d}": draw(p.hidden, 4 * p.hidden, by=p.hidden), f"b{d}": bias}
        width = 2 * p.hidden + p.embed
        return cls(out | {"out": draw(width, by=width), "level": np.zeros(1, np.float32)})

    def vectors(self, b: "Blocks") -> np.ndarray:
        """Input of the recurrent layers."""
        used, of = np.unique(b.states, return_inverse=True)
        path = np.stack([self.p["paths"][list(b.features[s])].sum(axis=0) if b.features[s] else np.zeros_like(self.p["bias"]) for s in used.tolist()])
        x = path[of] + b.numbers @ self.p["numbers"] + self.p["bias"]
        for lo in range(0, len(x), SLICE):
            x[lo : lo + SLICE] += b.word_counts(lo, min(lo + SLICE, len(x))) @ self.p["words"]
        return np.tanh(x)

    def scores(self, b: "Blocks") -> np.ndarray:
        """Chance of each block to be main text."""
        if not len(b.states):
            return np.zeros(0)
        x, seq = self.vectors(b), Sequences(b.sizes)
        wide = np.concatenate([*(m.forward(x, seq) for m in self.lstms), x], axis=1)
        return sigmoid(wide @ self.p["out"] + self.p["level"])

    def step(self, b: "Blocks", labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy."""
        x, seq = self.vectors(b), Sequences(b.sizes)
        wide = np.concatenate([*(m.forward(x, seq, keep=True) for m in self.lstms), x], axis=1)
        d = ((sigmoid(wide @ self.p["out"] + self.p["level"]) - labels) / len(labels)).astype(np.float32)
        g = {"out": wide.T @ d, "level": d.sum(keepdims=True)}
        d_wide, h = d[:, None] * self.p["out"], self.lstms[0].h
        dx = d_wide[:, 2 * h :].copy()
        for k, m in enumerate(self.lstms):
            dxk, (g[f"w{k}"], g[f"u{k}"], g[f"b{k}"]) = m.backprop(x, d_wide[:, k * h : (k + 1) * h])
            dx += dxk
        dx *= 1 - x * x
        g |= {"numbers": b.numbers.T @ dx, "bias": dx.sum(axis=0), "words": b.word_counts(0, len(x)).T @ dx, "paths": np.zeros_like(self.p["paths"])}
        used, of = np.unique(b.states, return_inverse=True)
        order = np.argsort(of, kind="stable")
        by_state = np.add.reduceat(dx[order], np.searchsorted(of[order], np.arange(len(used))))
        for s, own in zip(used.tolist(), by_state, strict=True):
            g["paths"][list(b.features[s])] += own
        return g


class Blocks:
    """Blocks of pages as a labeller reads them."""

    def __init__(self, pages: list[list[tuple[int, str, int]]], features: list[tuple[int, ...]], word_buckets: int):
        self.features, self.word_buckets = features, word_buckets
        self.sizes = np.array([len(p) for p in pages], np.int64)
        rows = [b for p in pages for b in p]
        self.states = np.array([b[0] for b in rows], np.int64)
        texts = [b[1].encode("utf-8", "surrogatepass") for b in rows]
        self.offs = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        self.buf = LOWERED[np.frombuffer(b"".join(texts), np.uint8)]
        self.read = np.ones(len(rows), bool)  # whose words are read
        self.numbers = self._numbers(rows) if rows else np.zeros((0, NUMBERS), np.float32)

    def _numbers(self, rows: list[tuple[int, str, int]]) -> np.ndarray:
        chars, links = np.array([len(b[1]) for b in rows]), np.array([b[2] for b in rows])
        size = np.diff(self.offs)
        share = lambda hit: np.add.reduceat(hit, self.offs[:-1]) / size
        n_words = np.add.reduceat(self.buf == 0x20, self.offs[:-1]) + 1
        last = self.buf[self.offs[1:] - 1]
        total = np.repeat(self.sizes, self.sizes)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        return np.stack([
            np.log1p(chars) / 6, np.log1p(n_words) / 4, chars > 200, links / chars, links == chars, links > 0,
            10 * share(np.isin(self.buf, list(b".,;:!?"))), np.isin(last, list(b".!?:")), 5 * share((self.buf >= 48) & (self.buf < 58)),
            place / np.maximum(total - 1, 1), np.log1p(np.minimum(total, 200)) / 5,
        ], axis=1).astype(np.float32)

    def word_counts(self, lo: int, hi: int) -> np.ndarray:
        """Root of how often the words of each hash stand in blocks lo..hi-1, as unit rows."""
        a, b = self.offs[lo], self.offs[hi]
        s, e, of = words(self.buf[a:b], self.offs[lo : hi + 1] - a)
        place = (span_hashes(self.buf[a:b], s, e) % np.uint64(self.word_buckets)).astype(np.int64)
        out = np.sqrt(np.bincount(of * self.word_buckets + place, minlength=(hi - lo) * self.word_buckets)).reshape(hi - lo, -1).astype(np.float32)
        return out * (self.read[lo:hi, None] / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6))


def labelled(pages: list[str], paths: Paths) -> tuple[list[list[tuple[int, str, int]]], np.ndarray]:
    """Blocks of marked pages without the marks, and which are main text."""
    out, labels = [], []
    for page in pages:
        own = []
        for state, text, links in page_blocks(page, paths):
            main = MAIN in text
            clean = " ".join(text.replace(MAIN, "").replace(REST, "").split())
            if clean:
                own.append((state, clean, min(links, len(clean))))
                labels.append(main)
        out.append(own)
    return out, np.array(labels, np.float32)


_trained: dict[ExtractParams, Labeller] = {}


def trained(p: ExtractParams = ExtractParams()) -> Labeller:
    """The labeller of these parameters: Adam over the drawn pages, the rate falling to nothing."""
    if p in _trained:
        return _trained[p]
    draw, paths = Layouts(p.seed), Paths()
    pages, labels = labelled([draw.page() for _ in range(p.pages)], paths)
    ends = np.cumsum([len(x) for x in pages])
    model, r = Labeller.fresh(p), np.random.default_rng(p.seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    steps, t = p.epochs * -(-p.pages // p.batch), 0
    for _ in range(p.epochs):
        order = r.permutation(p.pages)
        for lo in range(0, p.pages, p.batch):
            own = order[lo : lo + p.batch]
            own = own[[bool(pages[i]) for i in own]]
            b = Blocks([pages[i] for i in own], paths.features, p.word_buckets)
            b.read = r.random(len(b.states)) >= p.unread
            g = model.step(b, np.concatenate([labels[ends[i] - len(pages[i]) : ends[i]] for i in own]))
            t += 1
            rate = p.rate * min(1.0, t / 50) * (1 - t / (steps + 1))
            size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k, x in g.items():
                x = x * min(1.0, 1 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * x
                second[k] = 0.99 * second[k] + 0.01 * x * x
                model.p[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    _trained[p] = model
    return model


_here: list[Paths] = []


def main_blocks(model: Labeller, pages: list[str], p: ExtractParams) -> list[list[str]]:
    """Main blocks of each page, in page order."""
    if not _here or len(_here[0].features) > KEEP:
        _here[:] = [Paths()]
    blocks = [list(page_blocks(x, _here[0])) for x in pages]
    main = model.scores(Blocks(blocks, _here[0].features, p.word_buckets)) >= p.threshold
    out, at = [], 0
    for own in blocks:
        out.append([b[1] for b, yes in zip(own, main[at : at + len(own)].tolist(), strict=True) if yes])
        at += len(own)
    return out


def main_text(pages: DataFrame, p: ExtractParams = ExtractParams(), key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: key, url, text, n_chars.

    text has the blocks labelled as main text, white space within each made one
    space, joined by line ends; it is empty for null and empty pages and those
    without a main block. n_chars is its number of code points. Any string is a
    page. Scripts, styles, templates, title and form fields have no blocks.
    Repeated keys and rows each give a row; other columns aren't read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained(p).p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, PAGES):
                part = batch.slice(lo, PAGES)
                texts = ["\n".join(b) for b in main_blocks(model, [h or "" for h in part.column(2).to_pylist()], p)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[key, url, "text", "n_chars"])

    rows = whole_texts(pages).select(F.col(key).cast("long").alias(key), F.col(url).cast("string").alias(url), F.col(html).alias(html))
    return rows.mapInArrow(run, f"`{key}` long, `{url}` string, text string, n_chars long")
