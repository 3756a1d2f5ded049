"""Training runs: checks of their settings, and their rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scoring as sc

# What an hpu can't have, and what only an hpu can have.
NOT_ON_HPU = ["enable_xformers_memory_efficient_attention", "allow_tf32", "gradient_checkpointing", "push_to_hub"]


def problems(of: dict[str, Column]) -> Column:
    """Names of the rules that a run's settings break, in order; a run may start if there are none. Missing settings count as unset."""
    given = lambda c: of[c].isNotNull() if c in of else F.lit(False)
    true = lambda c: F.coalesce(of[c], F.lit(False)) if c in of else F.lit(False)
    hpu = F.coalesce(of["device"] == "hpu", F.lit(False))
    rules = [
        F.when(F.coalesce(of["report_to"] == "wandb", F.lit(False)) & given("hub_token"), "wandb with hub_token"),
        *(F.when(hpu & true(c), f"{c} on hpu") for c in NOT_ON_HPU),
        F.when(~hpu & given("gaudi_config_name"), "gaudi_config_name without hpu"),
        F.when(~hpu & (F.coalesce(of["throughput_warmup_steps"], F.lit(0)) != 0), "throughput_warmup_steps without hpu"),
    ]
    return F.array_compact(F.array(*rules))


def speed(steps: Column, batch: Column, seconds: Column) -> Column:
    """The metrics row of a run; no duration, no rate."""
    return F.struct(sc.rounded(F.try_divide(steps * batch, seconds), 4).alias("train_samples_per_second"), seconds.alias("train_runtime"))

