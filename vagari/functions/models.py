"""Model inference behind an interface, with stand-ins that need no weights.

A model sees iterators of pandas frames, so that it loads once per Python
worker. The stand-ins are deterministic rules. They make plans and tests run;
they are no working inference.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Inferencer(Protocol):
    output: str  # DDL type of the column that the model adds

    def predict(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


class Stub:
    """Applies rule() to each row of one column; a row that fails has its error and an empty output."""

    column, output = "caption", "array<string>"

    def rule(self, value):
        raise NotImplementedError

    def predict(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, errors = [], []
            for value in frame[self.column]:
                try:
                    out.append(self.rule(value))
                    errors.append(None)
                except Exception as e:  # one bad row doesn't end the job; the row tells
                    out.append([])
                    errors.append(str(e))
            yield frame.assign(output=out, error=errors)


class StubTagger(Stub):
    """Every word of a caption is a noun."""

    def rule(self, value):
        return (value or "").split()


class StubVerifier(Stub):
    """A phrase of one to three words is an object."""

    output = "array<string>"

    def rule(self, value):
        return [value] if value and len(value.split()) <= 3 else []


class StubDetector(Stub):
    """A box for each word, in a row."""

    output = "array<struct<label:string,score:double,x1:double,y1:double,x2:double,y2:double>>"

    def rule(self, value):
        return [{"label": w, "score": 0.5, "x1": 10.0 * i, "y1": 0.0, "x2": 10.0 * i + 8, "y2": 8.0} for i, w in enumerate((value or "").split())]


class StubWriter(Stub):
    """The first sentence of the prompt."""

    output = "array<string>"

    def rule(self, value):
        return [(value or "").split(".")[0]]


# What an error's text must contain for another attempt; the second list in any letter case.
WORTH_ANOTHER = ["device-side assert", "CUDA error", "probability", "Inf"]
WORTH_ANOTHER_ANY_CASE = ["nan"]


def with_fallback(attempts: list, reloads: bool = True):
    """The result of the first attempt that succeeds, and its name.

    attempts: (name, call) in the order sample, greedy, reload, cpu. An error of the first that has no
    known cause is raised; those of the others lead on. Without 'reloads' (no
    GPU) the third is left out. All failed: RuntimeError.
    """
    first, *others = attempts
    try:
        return first[1](), first[0]
    except Exception as e:
        if not (any(x in str(e) for x in WORTH_ANOTHER) or any(x in str(e).lower() for x in WORTH_ANOTHER_ANY_CASE)):
            raise
    last = None
    for name, call in others:
        if name == "reload" and not reloads:
            continue
        try:
            return call(), name
        except Exception as e:  # the next attempt is another way to the same answer
            last = e
    raise RuntimeError(f"all attempts failed: {last}")


class Laddered(Stub):
    """A stand-in whose attempts fail by the row's words, to show the order of attempts: the output is the attempt's name and its answer."""

    column, output = "phrase", "array<string>"

    def rule(self, value):
        words = (value or "").lower().split()

        def attempt(*failing):
            def call():
                for word, text in failing:
                    if word in words:
                        raise RuntimeError(text)
                return words[-1] if words else ""

            return call

        left, stack, tall = ("left", "NaN logits"), ("stack", "CUDA error"), ("tall", "CUDA error")
        ways = [("sample", attempt(("to", "no such file"), left, stack, tall)), ("greedy", attempt(stack, tall)), ("reload", attempt(tall)), ("cpu", attempt(("brass", "out of memory")))]
        answer, name = with_fallback(ways)
        return [name, answer]


def with_model(df: DataFrame, model: Inferencer) -> DataFrame:
    """df with output and error."""
    kind = T._parse_datatype_string(f"output {model.output}, error string")
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in ("output", "error")), *kind.fields])
    return df.drop("output", "error").mapInPandas(model.predict, schema)
