"""Batch scoring and the user-function surface."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


class Translator:
    """The four steps around a model; override what differs.

    ``prepare`` runs once per task (load the model there), ``process_input``
    turns a pandas batch into model input, ``predict`` scores it and
    ``process_output`` turns the result into columns.
    """

    def prepare(self) -> None: ...

    def process_input(self, batch: pd.DataFrame):
        return batch

    def predict(self, inputs):
        raise NotImplementedError

    def process_output(self, batch: pd.DataFrame, outputs) -> pd.DataFrame:
        return batch.assign(prediction=outputs)


def batch_predict(df: DataFrame, translator: Translator, schema: str, batch_size: int | None = None) -> DataFrame:
    """Preprocess, score and postprocess Arrow batches; works on streams too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        translator.prepare()
        for pdf in batches:
            step = batch_size or max(len(pdf), 1)
            for start in range(0, len(pdf), step):
                part = pdf.iloc[start : start + step]
                out = translator.process_output(part, translator.predict(translator.process_input(part)))
                if len(out) != len(part):
                    raise ValueError("a translator must answer every row")
                yield out

    return df.mapInPandas(run, schema)


class Accumulator:
    """A mergeable evaluator: init / update / merge / finish over JSON-able states."""

    def init(self) -> dict:
        raise NotImplementedError

    def update(self, state: dict, batch: pd.DataFrame) -> dict:
        raise NotImplementedError

    def merge(self, a: dict, b: dict) -> dict:
        raise NotImplementedError

    def finish(self, state: dict) -> float:
        raise NotImplementedError


def accumulate(df: DataFrame, group: Sequence[str], accumulator: Accumulator, out: str = "value") -> DataFrame:
    """Run an accumulator per group with partial states per task.

    Only states are shuffled, at most one per group and task, so the group's
    rows are never brought together.
    """
    group = list(group)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in group)

    def partial(batches):
        states: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(group, dropna=False, sort=False):
                states[key] = accumulator.update(states.get(key, accumulator.init()), part)
        rows = [(*key, json.dumps(state)) for key, state in states.items()]
        if rows:
            yield pd.DataFrame(rows, columns=[*group, "_state"])

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        state = accumulator.init()
        for text in pdf["_state"]:
            state = accumulator.merge(state, json.loads(text))
        return pdf.iloc[:1][group].assign(**{out: accumulator.finish(state)})

    parts = df.mapInPandas(partial, f"{fields}, _state string")
    return parts.groupBy(*group).applyInPandas(combine, f"{fields}, `{out}` double")


def transform_with(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """User transforms, each DataFrame to DataFrame, in order."""
    for step in steps:
        df = df.transform(step)
    return df


def unbatch_udtf():
    """A table function: one JSON-free batch row (ids, values) to its records."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="pos int, value double")
    class Unbatch:
        def eval(self, values):
            for i, v in enumerate(values or []):
                yield i, float(v)

    return Unbatch


