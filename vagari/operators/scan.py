"""Prefix scans of affine maps: running averages and other recurrences x <- a x + b without a window over a whole key.

Composing two maps gives a map, so a run of steps folds to one, runs of runs
fold again, and so on: a tree. Going back down, each run learns the map of all
that stands before it and finishes on its own. A task holds a run of at most
'run' steps of one key; there are as many rounds as the tree is high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 256


def _struct(**columns: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for n, c in columns.items()))


def _then(first: Column, second: Column) -> Column:
    """The map of first and then second."""
    return _struct(a=first["a"] * second["a"], b=second["a"] * first["b"] + second["b"])


def _identity() -> Column:
    return F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))


def _before(maps: DataFrame, key: list[str], run: int) -> DataFrame:
    """key, _at and the map (_m) of all maps of the key at smaller _at."""
    top = maps.agg(F.max("_at")).first()[0] or 0
    own = maps.groupBy(*key, F.expr(f"_at div {run}").alias("_up")).agg(F.sort_array(F.collect_list(F.struct("_at", "_m"))).alias("_run"))
    empty = F.array().cast("array<struct<_at:bigint,_m:struct<a:double,b:double>>>")
    zero = F.struct(_identity().alias("m"), empty.alias("out"))
    step = lambda acc, x: F.struct(_then(acc["m"], x["_m"]).alias("m"), F.array_append(acc["out"], F.struct(x["_at"].alias("_at"), acc["m"].alias("_m"))).alias("out"))
    folded = own.select(*key, "_up", F.aggregate("_run", zero, step).alias("_f"))
    inner = folded.select(*key, "_up", F.explode("_f.out").alias("_x")).select(*key, "_up", "_x.*")
    if top < run:
        return inner.drop("_up")
    outer = _before(folded.select(*key, F.col("_up").alias("_at"), F.col("_f.m").alias("_m")), key, run)
    outer = outer.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col("_at").alias("_of"), F.col("_m").alias("_o"))
    same = F.col("_up") == F.col("_of")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return inner.join(outer, same).select(*key, "_at", _then(F.col("_o"), F.col("_m")).alias("_m"))


def affine_scan(rows: DataFrame, key: list[str], step: str, a: Column, b: Column, start: Column | float = 0.0, name: str = "value", run: int = RUN) -> DataFrame:
    """key, step and the value after each step: x <- a x + b in the order of step, from 'start' on.

    step is a whole number, unique within its key, as operators.ordering.numbered
    gives it; it may have gaps. A null a or b makes that value and all later ones
    of its key null. start may depend on the key's columns. An empty table has no
    values. The result differs from a sequential one by rounding only.
    """
    at = F.expr(f"`{step}` div {run}")
    maps = rows.select(*key, F.col(step).cast("long").alias("_step"), _struct(a=a, b=b).alias("_m"), at.alias("_at"))
    runs = maps.groupBy(*key, "_at").agg(F.sort_array(F.collect_list(F.struct("_step", "_m"))).alias("_run"))
    whole = F.aggregate("_run", _identity(), lambda acc, x: _then(acc, x["_m"]))
    before = _before(runs.select(*key, "_at", whole.alias("_m")), key, run)
    before = before.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col("_at").alias("_of"), F.col("_m").alias("_o"))
    same = F.col("_at") == F.col("_of")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    start = F.lit(start).cast("double") if not isinstance(start, Column) else start.cast("double")
    met = runs.join(before, same).select(*key, "_run", (F.col("_o.a") * start + F.col("_o.b")).alias("_x"))
    zero = F.struct(F.col("_x").alias("x"), F.array().cast("array<struct<_step:bigint,_v:double>>").alias("out"))

    def one(acc: Column, x: Column) -> Column:
        value = x["_m"]["a"] * acc["x"] + x["_m"]["b"]
        return F.struct(value.alias("x"), F.array_append(acc["out"], F.struct(x["_step"].alias("_step"), value.alias("_v"))).alias("out"))

    done = met.select(*key, F.explode(F.aggregate("_run", zero, one)["out"]).alias("_y"))
    return done.select(*key, F.col("_y._step").alias(step), F.col("_y._v").alias(name))
