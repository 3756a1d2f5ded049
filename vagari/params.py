"""Parameters of the pipelines, passed to plans as literals."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DetectionParams:
    score_threshold: float = 0.36
    unscored_bonus: float = 0.1
    fusion_iou: float = 0.5
    skip_score: float = 0.0001
    detectors: int = 3
    duplicate_iou: float = 0.85


@dataclass(frozen=True)
class ContactParams:
    iou: float = 0.0
    pixels: float = 5.0
    grazing_px: float = 10.0
    near_px: float = 50.0


@dataclass(frozen=True)
class ScoreParams:
    alpha: float = 0.6
    scale: float = 15.0
    pass_threshold: float = 10.0


@dataclass(frozen=True)
class CaptionParams:
    """preferred: the column that training prefers; original_source: the source whose general caption is the original one; general: the column of general captions; spatial: 'full', or 'short' for one sentence of a spatial caption."""

    preferred: str = "optimized"
    original_source: str = "src0"
    expanded_percent: int = 50
    spatial_percent: int = 25
    general: str = "coca_caption"
    spatial: str = "full"
    seed: str = "42"


@dataclass(frozen=True)
class SampleParams:
    count: int = 10
    seed: str = "42"


@dataclass(frozen=True)
class TrainParams:
    batch: int = 16
    devices: int = 2
    accumulate: int = 1
    epochs: int = 1
    snr_gamma: float = 5.0


@dataclass(frozen=True)
class PromptParams:
    """Templates of the prompts, with %s where a value goes: the defaults are our own wording, a user of other models passes theirs."""

    yes_no: str = "<s>[INST] Answer yes or no for each line: does it name a thing that can be seen and boxed?\n%s\n[/INST]</s>"
    simplify: str = "Rewrite the description below in one short sentence. Keep every relation of place, but make exact distances vague.\nDescription: %s\nAnswer:"
    direction: str = "Objects:\n%s\nSay where each object lies relative to the others."
    distance: str = "Objects:\n%s\nSay how far apart the objects look, in everyday words."
    contact: str = "Objects:\n%s\nSay which objects touch each other."
    confidence: str = "Objects:\n%s\nSay how sure you are of each statement."
    synthesis: str = "Direction: %s\nDistance: %s\nContact: %s\nConfidence: %s\nCombine these into one description."
    levels: tuple[str, ...] = ("%s touching %s", "%s very close to %s", "%s some way from %s")


def effective(given: Column, *configs) -> Column:
    """A map of all settings of the configurations, 'Class.name' to text: what a row gives, else the default. Null and missing settings are not given; others than these are left out."""
    defaults = {f"{type(c).__name__}.{k}": str(x) for c in configs for k, x in asdict(c).items()}
    known = F.create_map(*(F.lit(x) for pair in defaults.items() for x in pair))
    own = F.map_filter(F.coalesce(given, F.create_map().cast("map<string,string>")), lambda k, _: k.isin(list(defaults)))
    return F.map_zip_with(known, own, lambda _, default, value: F.coalesce(value, default))
