"""Embedding near-dedup: int8 tile products with error bounds, full precision where they can't decide.

A unit vector x is written as s * c + e with int8 codes c and a scale s of its
own, and |e| is kept. So |x.y - s s' c.c'| is at most |q||e'| + |e||q'| + |e||e'|
with q = s * c, and a pair whose product of codes lies further below the
threshold than that can't be linked. The others are computed in double
precision. Equal vectors are one class with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import Scratch, stored
from .graph import components, local_roots
from .vectors import matrix

TILE_SCHEMA = "tile int, dims int, n int, ids binary, weight binary, x binary"
TILE_BYTES = 4 << 20
ROUNDING = 1e-6  # far above the float32 and float64 rounding of the bounds themselves
EXACT = 1024  # so many products of int8 codes have an exact sum in float32
TASKS = 4  # times the cores, the most tasks that cells are dealt to


@dataclass(frozen=True)
class EmbeddingParams:
    threshold: float = 0.95
    tile_rows: int = 8192
    block_rows: int = 1024
    pairs: int = 1 << 16
    stripe_tiles: int = 8


def usable(column: str) -> Column:
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, |s * c|, |e|) of unit rows."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that their largest component is near 1: squares neither overflow nor vanish, and no digit changes."""
    _, e = np.frexp(np.abs(x).max(axis=1))
    half = -e // 2  # in two steps, as 2 to the power -e may itself be too large
    return np.ldexp(np.ldexp(x, half[:, None]), (-e - half)[:, None])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of rows of codes, which are float32."""
    if a.shape[1] <= EXACT:
        return a @ b.T
    out = np.zeros((len(a), len(b)))
    for lo in range(0, a.shape[1], EXACT):
        out += a[:, lo : lo + EXACT] @ b[:, lo : lo + EXACT].T
    return out


def linked(x: np.ndarray, y: np.ndarray, p: EmbeddingParams, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (rows of x, rows of y) with cosine >= threshold; each pair once if x is y.

    The largest errors of a block rule most pairs out at once, those of the two
    vectors most of the others; what is left is computed in double precision.
    """
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (cx, sx, qx, ex), (cy, sy, qy, ey) = quantise(x / nx[:, None]), quantise(y / ny[:, None])
    fx, fy = cx.astype(np.float32), cy.astype(np.float32)
    step, rounding = p.block_rows, ROUNDING * (1 + x.shape[1] / 1000)
    for i in range(0, len(x), step):
        for j in range(i if same else 0, len(y), step):
            a, b = slice(i, i + step), slice(j, j + step)
            slack = qx[a].max() * ey[b].max() + ex[a].max() * qy[b].max() + ex[a].max() * ey[b].max() + rounding
            product = products(fx[a], fy[b])
            product *= sy[b].astype(product.dtype)
            r, c = np.nonzero(product >= ((p.threshold - slack) / sx[a]).astype(product.dtype)[:, None])
            code = product[r, c]
            r, c = r + i, c + j
            own = code * sx[r] + qx[r] * ey[c] + ex[r] * qy[c] + ex[r] * ey[c] + rounding >= p.threshold
            r, c = r[own], c[own]
            if same and i == j:
                r, c = r[r < c], c[r < c]
            for lo in range(0, len(r), p.pairs):
                u, v = r[lo : lo + p.pairs], c[lo : lo + p.pairs]
                cosine = np.einsum("ij,ij->i", x[u], y[v]) / (nx[u] * ny[v])
                yes = cosine >= p.threshold
                if yes.any():
                    yield u[yes], v[yes]


def _tiles(classes: DataFrame, p: EmbeddingParams, store) -> DataFrame:
    parts = max(1, -(-classes.count() // p.tile_rows))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 12, {}
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == size)))
                held.setdefault(int(size), []).append((part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2))[0]))
        for size, parts in held.items():
            ids, weight, x = (np.concatenate(c) for c in zip(*parts, strict=True))
            step = max(1, min(p.tile_rows, max(256, TILE_BYTES // (8 * size))))
            x = scaled(x)
            for lo in range(0, len(ids), step):
                own = slice(lo, lo + step)
                row = {"tile": number, "dims": size, "n": len(ids[own]), "ids": ids[own].tobytes(), "weight": weight[own].tobytes(), "x": x[own].tobytes()}
                number += 1
                yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([("tile", pa.int32()), ("dims", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("weight", pa.binary()), ("x", pa.binary())])
    return store(classes.select("id", "weight", "v").repartition(parts).mapInArrow(build, TILE_SCHEMA), "tiles")


def _cells(tiles: DataFrame, p: EmbeddingParams, store) -> DataFrame:
    """Each tile (cell, side, and its columns) in the cells of a triangular grid in which its products are made; a task takes a run of cells.

    The tiles of one length stand in stripes. A cell joins two stripes, so a tile
    goes to as many cells as there are stripes, and a pair of tiles meets in one.
    """
    spark = tiles.sparkSession
    heads = tiles.select("tile", "dims").withColumn("nth", F.row_number().over(W.Window.partitionBy("dims").orderBy("tile")) - 1)
    enough = math.isqrt(2 * spark.sparkContext.defaultParallelism) + 1
    stripes = F.least(F.count("*").over(W.Window.partitionBy("dims")), F.greatest(F.lit(enough), F.ceil(F.count("*").over(W.Window.partitionBy("dims")) / p.stripe_tiles))).cast("int")
    heads = heads.withColumn("stripes", stripes).withColumn("stripe", (F.col("nth") % F.col("stripes")).cast("int"))
    placed = heads.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)))
    placed = placed.select("tile", F.struct("dims", F.least("stripe", "other").alias("a"), F.greatest("stripe", "other").alias("b")).alias("cell"), (F.col("stripe") > F.col("other")).cast("int").alias("side"))
    placed = store(placed, "vector-stripes")
    cells = store(placed.select("cell").distinct().withColumn("task", F.row_number().over(W.Window.orderBy("cell")) - 1), "vector-cells")
    n = max(1, cells.count())
    many = min(n, TASKS * spark.sparkContext.defaultParallelism)
    out = placed.join(cells, "cell").join(tiles, "tile").select("task", "cell", "side", "tile", "dims", "n", "ids", "weight", "x")
    return out.repartitionById(many, F.expr(f"cast(task * {many}L div {n} as int)")).sortWithinPartitions("cell", "side", "tile")


def _links(tiles: DataFrame, p: EmbeddingParams, store) -> DataFrame:
    """(a, n, b): n rows linked to class a found in one product of tiles, and a node b of a's component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                cell = tuple(r["cell"].values())
                if cell != now:
                    now, held = cell, []
                diagonal, side = cell[1] == cell[2], r["side"]
                r = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["weight"], np.int64), np.frombuffer(r["x"]).reshape(r["n"], r["dims"])
                if diagonal:
                    yield product(r, r, True)
                if diagonal or side:
                    for other in held:
                        yield product(other, r, False)
                if not side:  # the first stripe's tiles wait, the second's pass by
                    held.append(r)

    def product(one: tuple, two: tuple, same: bool) -> pa.RecordBatch:
        (ids, weight, x), (ids2, weight2, y) = one, two
        shift = 0 if same else len(ids)
        every = ids if same else np.concatenate([ids, ids2])
        count, root = np.zeros(len(every), np.int64), np.arange(len(every))
        found = []
        for u, v in linked(x, y, p, same):
            np.add.at(count, u, weight2[v])
            np.add.at(count, v + shift, weight[u])
            found.append(np.stack([u, v + shift]))
            if sum(f.shape[1] for f in found) > 1 << 20:  # keep only what joins components
                root = _joined(root, found)
                found = []
        root = _joined(root, found)
        hit = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(every[hit]), pa.array(count[hit]), pa.array(every[root[hit]])], names=["a", "n", "b"])

    return _cells(tiles, p, store).mapInArrow(run, "a long, n long, b long")


def _joined(root: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    if not found:
        return root
    own = np.flatnonzero(root != np.arange(len(root)))
    a, b = np.concatenate([*found, np.stack([own, root[own]])], axis=1)
    return local_roots(len(root), a, b)


def near_duplicates(vectors: DataFrame, p: EmbeddingParams = EmbeddingParams(), key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per input row: key, n_links, component_id, kept.

    n_links: other rows with cosine >= p.threshold; component_id: the least key
    reachable by links, its own included; kept: key equals component_id. Rows
    that are null, zero, or hold null or non-finite components, and rows without
    a key, link with nothing and are kept. Vectors of different length aren't
    compared. Rows that repeat a key are one node. Links are counted, not
    listed: a product of two tiles returns at most a row per vector in them.
    All pairs of tiles are multiplied, so work grows with the square of the
    number of distinct vectors; a task holds p.stripe_tiles tiles and one more.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    part = F.col("id").isNotNull() & usable("v")
    with Scratch(vectors.sparkSession) as scratch:
        classes = scratch.store(rows.filter(part).groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "vector-classes")
        links = scratch.store(_links(_tiles(classes, p, scratch.store), p, scratch.store), "vector-links")
        counts = links.groupBy("a").agg(F.sum("n").alias("n"))
        least = components(links.select("a", "b"), scratch.store)
        known = classes.join(counts.withColumnRenamed("a", "id"), "id", "left").join(least.select(F.col("a").alias("id"), F.col("b").alias("least")), "id", "left")
        known = known.select("v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
        out = rows.filter(part).join(known, "v").select("id", "n_links", "component_id")
        alone = rows.filter(~part).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        out = stored(out.unionByName(alone), "vector-duplicates")
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
