"""Caption mixtures: sampling, splits, choices and fallbacks that any rerun repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import scoring as sc
from ..functions import text as tx
from ..params import CaptionParams
from .ordering import numbered


def present(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def sample(rows: DataFrame, key: str, count: int, seed: str) -> DataFrame:
    """W10, W15, W18: 'count' rows by the order of a seeded hash. Spark keeps the top rows of each partition only."""
    return rows.withColumn("_draw", sc.hash_draw(F.lit(seed), F.col(key).cast("string"))).orderBy("_draw", key).limit(count).drop("_draw")


def shuffled(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """Rows with 'place', their number (from 0) in the order of a seeded hash: the whole table is the shuffle buffer."""
    return numbered(rows.withColumn("_draw", sc.hash_draw(F.lit(seed), F.col(key).cast("string"))), ["_draw", key], "place").drop("_draw")


def truncated(rows: DataFrame, key: str, size: float, seed: str) -> DataFrame:
    """A share of the rows (below 1) or a number of rows, shuffled. A row knows its place, so no task gathers them."""
    count = int(size * rows.count()) if size < 1 else int(size)
    return shuffled(rows, key, seed).filter(F.col("place") < count).drop("place")


def with_split(rows: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """W12: 'validation' where the seeded hash is below the share, else 'train'. No shuffle; the share is met in expectation."""
    u = sc.hash_unit(F.lit(seed), F.lit("split"), F.col(key).cast("string"))
    return rows.withColumn("split", F.when(u < share, "validation").otherwise("train"))


def chosen_kind(key: Column, p: CaptionParams) -> Column:
    """Optimized, spatial or general by weight."""
    u = sc.hash_unit(F.lit(p.seed), F.lit("kind"), key.cast("string")) * 100
    return F.when(u < p.expanded_percent, "optimized").when(u < p.expanded_percent + p.spatial_percent, "spatial").otherwise("general")


def expanded(rows: DataFrame, key: str, source: Column, p: CaptionParams) -> DataFrame:
    """Two rows for each: the optimized caption, and by a coin the spatial or the general one (the original caption for one source)."""
    general = F.when(source == p.original_source, "original_caption").otherwise("coca_caption")
    coin = sc.hash_draw(F.lit(p.seed), F.lit("coin"), F.col(key).cast("string")) % 2
    kinds = F.array(F.lit("second_optimize_caption"), F.when(coin == 0, "spatial_caption").otherwise(general))
    return rows.select("*", F.posexplode(kinds).alias("copy", "_preferred_caption"))


def caption(kind: Column, optimized: Column, spatial: Column, general: Column, original: Column, source: Column, p: CaptionParams) -> Column:
    """Optimized falls back to spatial, that to general; one source's general caption is the original if there is one; nothing gives ''."""
    plain = F.when(source == p.original_source, F.coalesce(present(original), present(general))).otherwise(present(general))
    mid = F.coalesce(present(spatial), plain)
    return F.coalesce(F.when(kind == "optimized", F.coalesce(present(optimized), mid)).when(kind == "spatial", mid).otherwise(plain), F.lit(""))


def one_of(captions: Column, draw: Column, train: bool = True) -> Column:
    """Of a list of captions one by 'draw' in training, else the first; an empty list gives null."""
    at = (draw % F.size(captions)).cast("int") if train else F.lit(0)
    return F.when(F.size(captions) > 0, F.get(captions, at))


def training_caption(preferred: Column, kind: Column, optimized: Column, spatial: Column, general: Column, original: Column, source: Column, draw: Column, p: CaptionParams) -> Column:
    """The caption that a sample is trained with.

    The column that the row prefers counts, else that of its kind. An empty
    optimized caption leads to the spatial one, an empty spatial one to the
    general column; one source's general caption is the original one if there is
    one, and where the original ones are the general column an empty one leads
    back. Short spatial captions are one sentence by 'draw'. Nothing gives ''.
    """
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    name = F.coalesce(present(preferred), F.when(kind == "optimized", "second_optimize_caption").when(kind == "spatial", "spatial_caption").otherwise(p.general))
    # Each step is a condition on the first name, not a new name in terms of the last: that would double the expression.
    from_optimized, to_general = name == "second_optimize_caption", F.lit(p.general)
    to_spatial = (name == "spatial_caption") | (from_optimized & ~full(optimized))
    emptied = to_spatial & ~full(spatial)
    to_coca = (name == "coca_caption") | (emptied & (to_general == "coca_caption"))
    to_original = (name == "original_caption") | (emptied & (to_general == "original_caption")) | (to_coca & F.coalesce(source == p.original_source, F.lit(False)) & full(original))
    told = tx.picked_sentence(spatial, draw) if p.spatial == "short" else spatial
    text = F.when(from_optimized & full(optimized), optimized).when(to_spatial & full(spatial), told)
    if p.general == "original_caption":
        text = text.when(to_original & full(original), original).when(to_coca | to_original, general)
    else:
        text = text.when(to_original, original).when(to_coca, general)
    return F.coalesce(text, F.lit(""))


def round_robin(rows: DataFrame, order: list, workers: int) -> DataFrame:
    """Worker i % n in the given order."""
    return numbered(rows, order, "_nth").withColumn("worker", (F.col("_nth") % workers).cast("int")).drop("_nth")


def keep_newest(rows: DataFrame, key: str, step: str, limit: int) -> DataFrame:
    """What goes before another checkpoint is saved: all but the newest limit - 1."""
    newest = F.row_number().over(W.Window.partitionBy(key).orderBy(F.desc(step)))
    return rows.withColumn("delete", newest > limit - 1)
