"""What an operator is, for code that takes one as a parameter: names, protocols, chains of closures, model sessions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


@runtime_checkable
class Algorithm(Protocol):
    """Anything with a name."""

    name: str


@runtime_checkable
class CloudFilter(Algorithm, Protocol):
    def filter(self, points: DataFrame) -> DataFrame: ...


@runtime_checkable
class FeatureEstimator(Algorithm, Protocol):
    def estimate(self, points: DataFrame) -> DataFrame: ...


@runtime_checkable
class Neighbourhood(Algorithm, Protocol):
    def pairs(self, queries: DataFrame, points: DataFrame) -> DataFrame: ...


@runtime_checkable
class Segmenter(Algorithm, Protocol):
    def segment(self, points: DataFrame) -> DataFrame: ...


@runtime_checkable
class Registration(Algorithm, Protocol):
    def align(self, source: DataFrame, target: DataFrame) -> tuple[np.ndarray, float]: ...


@runtime_checkable
class ScanMatcher(Algorithm, Protocol):
    def match(self, before: DataFrame, after: DataFrame) -> tuple[np.ndarray, float]: ...


@runtime_checkable
class GraphOperator(Algorithm, Protocol):
    def apply(self, inputs: Sequence[DataFrame]) -> list[DataFrame]: ...


_METHODS = ("filter", "estimate", "segment")


@dataclass(frozen=True)
class Closure:
    """A function from clouds to clouds as a graph operator of one input and one output; also a filter."""

    name: str
    work: Callable[[DataFrame], DataFrame]

    def filter(self, points: DataFrame) -> DataFrame:
        return self.work(points)

    def apply(self, inputs: Sequence[DataFrame]) -> list[DataFrame]:
        if len(inputs) != 1:
            raise ValueError(f"{self.name} takes one input")
        return [self.work(inputs[0])]


@dataclass(frozen=True)
class Chain:
    """Filters, estimators and segmenters one after the other: one plan, nothing computed between them."""

    steps: tuple
    name: str = "chain"

    def filter(self, points: DataFrame) -> DataFrame:
        for s in self.steps:
            work = next((getattr(s, m) for m in _METHODS if hasattr(s, m)), None)
            if work is None:
                raise TypeError(f"{s!r} is no operator on clouds")
            points = work(points)
        return points


@runtime_checkable
class Backend(Protocol):
    """Runs a model on batches: rows by features in, rows by outputs out."""

    def load(self) -> Callable[[np.ndarray], np.ndarray]: ...


@dataclass(frozen=True)
class MatrixBackend:
    """Layers (weights, bias) with the given activation between them; sent to workers with the plan."""

    layers: tuple
    activation: str = "relu"

    def load(self):
        act = {"relu": lambda x: np.maximum(x, 0), "tanh": np.tanh, "none": lambda x: x}[self.activation]

        def run(x):
            for k, (w, b) in enumerate(self.layers):
                x = x @ np.asarray(w) + np.asarray(b)
                x = act(x) if k + 1 < len(self.layers) else x
            return x

        return run


@dataclass(frozen=True)
class MockBackend:
    """The same outputs for every row, whatever goes in."""

    outputs: tuple

    def load(self):
        return lambda x: np.tile(np.asarray(self.outputs, float), (len(x), 1))


@dataclass(frozen=True)
class Session:
    """A model with sizes that are checked: a row of another size raises. Loaded once a task, run batch by batch."""

    backend: Backend
    inputs: int
    outputs: int
    batch: int = 4096
    name: str = field(default="session")

    def infer(self, df: DataFrame, column: str, to: str = "output") -> DataFrame:
        """Adds an array column; null rows give null."""
        at = df.columns.index(column)
        schema = df.withColumn(to, F.lit(None).cast("array<double>")).schema

        def run(batches):
            model = self.backend.load()
            for b in batches:
                for s in range(0, b.num_rows, self.batch):
                    part = b.slice(s, self.batch)
                    x = part.column(at)
                    there = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
                    rows = x.take(pa.array(there))
                    if set(np.diff(rows.offsets.to_numpy()).tolist()) - {self.inputs}:
                        raise ValueError(f"{self.name}: rows of {self.inputs} numbers are needed")
                    y = model(np.asarray(rows.flatten(), float).reshape(-1, self.inputs)) if len(there) else np.zeros((0, self.outputs))
                    if y.shape != (len(there), self.outputs):
                        raise ValueError(f"{self.name}: the model gave {y.shape}")
                    out: list = [None] * part.num_rows
                    for k, v in zip(there.tolist(), y.tolist()):
                        out[k] = v
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(pa.float64()))], names=[*part.schema.names, to])

        return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class EntityEmbedder:
    """Embeds entities by a session over a feature column; embeddings are of length one, a zero one stays."""

    session: Session
    name: str = "embedder"

    def estimate(self, entities: DataFrame, column: str = "features") -> DataFrame:
        out = self.session.infer(entities, column, "embedding")
        size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
        return out.withColumn("embedding", F.when(size > 0, F.transform("embedding", lambda x: x / size)).otherwise(F.col("embedding")))
