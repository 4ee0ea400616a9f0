"""A net of sigmoid layers over weighted points: gradients by tasks, limited-memory BFGS steps by the driver.

The library's net takes no weights, so equal points would have to enter one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Points that make a task worth its start, and as many as one should hold at most.
TASK_POINTS, MOST_POINTS = 20_000, 500_000
#: Pairs of steps that are kept, relative gain over so many steps below which it ends, smallest step.
MEMORY, GAIN, LEAST_STEP = 10, 1e-6, 1e-10


def layer_functions(layers: list[int]) -> tuple[Callable, Callable]:
    """``outputs(weights, x)``, the values of each layer, and ``sums(weights, x, label, weight)``, log loss and its gradient, summed up."""

    def split(w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(layers, layers[1:]):
            out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def outputs(w: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """Sigmoid of each hidden layer; the last has the logarithms of the classes' probabilities."""
        values, own = [x], split(w)
        for k, (m, b) in enumerate(own):
            z = values[-1] @ m + b
            if k + 1 < len(own):
                values.append(0.5 * (1.0 + np.tanh(0.5 * z)))
            else:
                z = z - z.max(axis=1, keepdims=True)
                values.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return values

    def sums(w: np.ndarray, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
        values, own = outputs(w, x), split(w)
        rows, label = np.arange(len(x)), label.astype(np.int64)
        loss = -float((values[-1][rows, label] * weight).sum())
        delta = np.exp(values[-1])
        delta[rows, label] -= 1.0
        delta *= weight[:, None]
        parts: list[np.ndarray] = []
        for k in range(len(own) - 1, -1, -1):
            parts[:0] = [(values[k].T @ delta).ravel(), delta.sum(axis=0)]
            if k:
                delta = (delta @ own[k][0].T) * values[k] * (1.0 - values[k])
        return np.concatenate([[loss], *parts])

    return outputs, sums


@dataclass(frozen=True)
class Net:
    """Weights over points that are shifted by ``mean`` and divided by ``deviation``."""

    layers: list[int]
    weights: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray

    def success(self, features: list[Column]) -> Column:
        """Probability of class 1."""
        outputs, _ = layer_functions(self.layers)
        weights, mean, deviation = self.weights, self.mean, self.deviation

        @F.pandas_udf("double")
        def probability(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            return pd.Series(np.exp(outputs(weights, (np.vstack(x.to_numpy()) - mean) / deviation)[-1][:, 1]))

        return probability(F.array(*features))


def minimise(value_of: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int) -> np.ndarray:
    """Limited-memory BFGS with backtracking. ``value_of`` gives value and gradient."""
    value, slope = value_of(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    values = [value]
    for _ in range(steps):
        d, backward = -slope, []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            backward.append(a)
            d = d - a * y
        if past:
            d = d * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(backward)):
            d = d + s * (a - (y @ d) / (s @ y))
        step = 1.0 if past else min(1.0, 1.0 / max(float(np.linalg.norm(slope)), 1e-12))
        while True:
            found, found_slope = value_of(w + step * d)
            if found <= value + 1e-4 * step * (d @ slope):
                break
            step /= 2
            if step < LEAST_STEP:
                return w
        s, y = step * d, found_slope - slope
        if s @ y > 1e-12 * (y @ y):
            past = [*past, (s, y)][-MEMORY:]
        w, value, slope = w + s, found, found_slope
        values.append(value)
        if len(values) > MEMORY and values[-MEMORY - 1] - value <= GAIN * abs(value):
            break
    return w


def tasks_for(n: int, cores: int) -> int:
    """Tasks of a step over ``n`` points: every step starts them anew, so no more than cores, unless they would hold too much."""
    return max(1, min(cores, -(-n // TASK_POINTS)), -(-n // MOST_POINTS))


def fit(points: DataFrame, features: list[str], layers: list[int], mean: np.ndarray, deviation: np.ndarray, seed: int, steps: int) -> Net:
    """Train on ``features``, ``label`` and ``weight`` of all points. Tasks keep them as blocks; a step sends one gradient from each task."""
    rng = np.random.default_rng(seed)
    _, sums = layer_functions(layers)
    start = np.concatenate([
        np.concatenate([rng.uniform(-1, 1, a * b) * np.sqrt(6.0 / (a + b)), np.zeros(b)]) for a, b in zip(layers, layers[1:])
    ])
    width = len(features)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            x = (np.column_stack(columns[:width]) - mean) / deviation
            parts = [np.ascontiguousarray(p, dtype=np.float64).tobytes() for p in (x, *columns[width:])]
            yield pa.RecordBatch.from_arrays([pa.array([p], type=pa.binary()) for p in parts], names=["x", "label", "weight"])

    n, total = points.agg(F.count("*"), F.sum("weight")).first()
    total = total or 1.0
    rows = points.select(*features, F.col("label").cast("double"), F.col("weight").cast("double")).coalesce(tasks_for(n, points.sparkSession.sparkContext.defaultParallelism))
    blocks = rows.mapInArrow(block, "x binary, label binary, weight binary").persist()
    try:

        def value_of(w: np.ndarray) -> tuple[float, np.ndarray]:
            def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = np.zeros(len(w) + 1)
                for batch in batches:
                    for x, label, weight in zip(*[c.to_pylist() for c in batch.columns]):
                        out += sums(w, np.frombuffer(x).reshape(-1, width), np.frombuffer(label), np.frombuffer(weight))
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], type=pa.binary())], names=["sums"])

            parts = [np.frombuffer(r["sums"]) for r in blocks.mapInArrow(gradient, "sums binary").collect()]
            found = np.sum(parts, axis=0) / total if parts else np.zeros(len(w) + 1)
            return float(found[0]), found[1:]

        return Net(layers, minimise(value_of, start, steps), mean, deviation)
    finally:
        blocks.unpersist()
