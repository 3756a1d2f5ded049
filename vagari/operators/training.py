"""What a training loop computes beside the model: running averages of weights, clipped gradients, gathered losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered
from .scan import affine_scan

# The largest decay of the running average, and what keeps a zero norm from being divided by.
MAX_DECAY, NORM_FLOOR = 0.9999, 1e-6


def decay(step: Column, most: float = MAX_DECAY) -> Column:
    """How much of the average stays at the n-th optimiser step: nothing at the first, then n / (n + 9), at most 'most'."""
    n = step.cast("double")
    return F.when(step <= 1, F.lit(0.0)).otherwise(F.least(F.lit(most), n / (n + 9)))


def clip_scale(squares: Column, most: float) -> Column:
    """What a gradient is multiplied with so that its norm is at most 'most'; squares is the sum over all parameters."""
    return F.least(F.lit(1.0), F.lit(most) / (F.sqrt(squares) + NORM_FLOOR))


def steps(rows: DataFrame, parameter: str, order: str, name: str = "step") -> DataFrame:
    """rows with their step, from 0 for each parameter, in a total order within it; no window over a parameter."""
    placed = numbered(rows, [parameter, order], "_nth")
    first = placed.groupBy(F.col(parameter).alias("_p")).agg(F.min("_nth").alias("_first"))
    met = placed.join(first, F.col(parameter).eqNullSafe(F.col("_p")))
    return met.withColumn(name, F.col("_nth") - F.col("_first")).drop("_p", "_first", "_nth")


def weight_averages(rows: DataFrame, parameter: str, order: str, vector: str, most: float = MAX_DECAY) -> DataFrame:
    """Parameter, step, i, value: the running average of each component of a parameter after each step.

    A parameter's first vector is what it starts with (step 0); each later one is
    its weights after an optimiser step, of which the average takes over 1 - decay.
    Null vectors are no step; a null component makes this component's average
    null from there on. Vectors of a parameter may differ in length: a component
    that is missing at a step has no value there and goes on as if that step had
    not been.
    """
    named = steps(rows.filter(F.col(vector).isNotNull()).select(parameter, order, vector), parameter, order)
    parts = named.select(parameter, "step", F.posexplode(vector).alias("i", "x"))
    keep = decay(F.col("step"), most)
    a, b = F.when(F.col("step") == 0, F.lit(0.0)).otherwise(keep), F.when(F.col("step") == 0, F.col("x").cast("double")).otherwise((1 - keep) * F.col("x").cast("double"))
    return affine_scan(parts, [parameter, "i"], "step", a, b)


def final_weights(averages: DataFrame, parameter: str) -> DataFrame:
    """Parameter, weights: the averages that a checkpoint holds, those after the last step of each component, in the order of i."""
    last = averages.groupBy(parameter, "i").agg(F.max_by(F.struct("value"), "step").alias("v"))
    return last.groupBy(parameter).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v.value"))), lambda x: x["value"]).alias("weights"))


def gathered_loss(rows: DataFrame, micro: str, loss: str, accumulate: int = 1) -> DataFrame:
    """Step, loss: the mean over devices of each micro step's loss, of which a step sums 'accumulate', each divided by that number. Null losses don't count; a micro step without any adds nothing."""
    each = rows.groupBy(micro).agg(F.avg(loss).alias("_mean"))
    return each.groupBy(F.expr(f"`{micro}` div {accumulate}").alias("step")).agg((F.sum("_mean") / accumulate).alias("loss"))
