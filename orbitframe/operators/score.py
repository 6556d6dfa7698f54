"""Batched scoring with multilayer perceptrons: weights are broadcast, rows travel as Arrow batches and are read as matrices, never as Python lists.

A network is a list of layers (w, and optionally b, gain, shift, project): linear, and all but the last with layer norm and ReLU. A layer whose width
stays, or that has a projection for its input, adds its input. With `hyper` it also adds the mean of what all layers before it have added."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Layers = list[dict[str, np.ndarray]]
EPS = 1e-5


def _skip(x: np.ndarray, layer: dict[str, np.ndarray]) -> np.ndarray | None:
    if "project" in layer:
        return x @ layer["project"]
    return x if layer["w"].shape[0] == layer["w"].shape[1] else None


def forward(x: np.ndarray, layers: Layers, hyper: bool = False, tape: list | None = None) -> np.ndarray:
    """The network's answers; a tape gets what the way back needs of each layer."""
    earlier, n = None, 0
    for k, layer in enumerate(layers):
        y = x @ layer["w"] + layer.get("b", 0)
        if k < len(layers) - 1:
            scale = np.sqrt(y.var(axis=1, keepdims=True) + EPS)
            normal = (y - y.mean(axis=1, keepdims=True)) / scale
            z = normal * layer.get("gain", 1) + layer.get("shift", 0)
            if tape is not None:
                tape.append((normal, scale, z > 0))
            y = np.maximum(z, 0)
            if (skip := _skip(x, layer)) is not None:
                y = y + skip
                if hyper:
                    y = y + earlier / n if n else y
                    earlier, n = skip if earlier is None else earlier + skip, n + 1
        x = y
    return x


def gradient(x: np.ndarray, layers: Layers, hyper: bool = False, weights: np.ndarray | None = None) -> np.ndarray:
    """Of the weighted sum of the answers (their mean by default) by each feature: one pass forward and one back."""
    tape: list = []
    n = forward(x, layers, hyper, tape).shape[1]
    weights = np.full(n, 1 / n) if weights is None else weights
    g = np.tile(layers[-1]["w"] @ weights, (len(x), 1))
    # how many inputs have been added before each layer, and what later layers pass back to all of them
    added, count = [], 0
    for layer in layers[:-1]:
        added.append(count)
        count += "project" in layer or layer["w"].shape[0] == layer["w"].shape[1]
    shared = 0.0
    for k in range(len(layers) - 2, -1, -1):
        layer, (normal, scale, on) = layers[k], tape[k]
        d = g * on * layer.get("gain", 1)
        d = (d - d.mean(axis=1, keepdims=True) - normal * (d * normal).mean(axis=1, keepdims=True)) / scale
        back = d @ layer["w"].T
        if "project" in layer or layer["w"].shape[0] == layer["w"].shape[1]:
            own = g + shared
            back = back + (own @ layer["project"].T if "project" in layer else own)
            if hyper and added[k]:
                shared = shared + g / added[k]
        g = back
    return g


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows without nulls, as a matrix; which rows they are) of a column of lists of one length."""
    there = column.is_valid()
    flat = column.filter(there).flatten() if column.null_count else column.flatten()
    valid = there.to_numpy(zero_copy_only=False)
    n = int(valid.sum())
    width = len(flat) // n if n else 0
    if len(flat) != n * width:
        raise ValueError("feature lists differ in length")
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(n, width)
    if flat.null_count:
        whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(n, width).any(axis=1)
        values, valid = values[whole], valid.copy()
        valid[np.flatnonzero(valid)[~whole]] = False
    return values, valid


def _scattered(answers: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Answers of the valid rows as a column, doubles or lists of them; null elsewhere."""
    mask = None if valid.all() else ~valid
    if answers.ndim == 1:
        out = np.zeros(len(valid))
        out[valid] = answers
        return pa.array(out, mask=mask)
    at = np.concatenate(([0], np.cumsum(valid * answers.shape[1]))).astype("i4")
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(answers, float).ravel()), mask=None if mask is None else pa.array(mask))


def answers(df: DataFrame, features: str, names: dict[str, T.DataType], answer: Callable[..., dict[str, np.ndarray]], model, extra: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """df with the columns `names` that answer(x, model, *extra) gives for the matrix of features (and vectors of extra columns); null if any feature
    is null. Columns of `drop` do not come back."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a model's size
    extra, kept = extra or [], [f for f in df.schema.fields if f.name not in (drop or [])]

    def run(batches):
        for batch in batches:
            x, valid = matrix(batch[features])
            more = [batch[c].to_numpy(zero_copy_only=False)[valid] for c in extra]
            found = answer(x, shared.value, *more) if len(x) else {}
            none = pa.nulls(batch.num_rows)
            new = [_scattered(found[k], valid) if k in found else none.cast(pa.list_(pa.float64()) if isinstance(t, T.ArrayType) else pa.float64()) for k, t in names.items()]
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in kept), *new], names=[*(f.name for f in kept), *names])

    return df.mapInArrow(run, T.StructType([*kept, *(T.StructField(k, t) for k, t in names.items())]))


ARRAY, DOUBLE = T.ArrayType(T.DoubleType()), T.DoubleType()


def score(df: DataFrame, features: str, layers: Layers, out: str = "quantiles", hyper: bool = False) -> DataFrame:
    """df with the network's answer to an array column; null if any feature is null."""
    return answers(df, features, {out: ARRAY}, lambda x, m: {out: forward(x, m, hyper)}, layers)


def heads(x: np.ndarray, trunk: Layers, tails: dict[str, Layers]) -> dict[str, np.ndarray]:
    """Answers of several targets that share a trunk."""
    shared = forward(x, trunk) if trunk else x
    return {name: forward(shared, layers) for name, layers in tails.items()}


def score_heads(df: DataFrame, features: str, trunk: Layers, tails: dict[str, Layers]) -> DataFrame:
    """df with an array column for each target; null if any feature is null."""
    return answers(df, features, dict.fromkeys(tails, ARRAY), lambda x, m: heads(x, *m), (trunk, tails))


def score_gradient(df: DataFrame, features: str, layers: Layers, out: str = "gradient", hyper: bool = False) -> DataFrame:
    """df with the gradient of the mean answer by each feature; null if any feature is null."""
    return answers(df, features, {out: ARRAY}, lambda x, m: {out: gradient(x, m, hyper)}, layers)


def transfer(layers: Layers, channels: dict[int, int], features: int) -> Layers:
    """A model for another sensor: the weights of its feature i are those of feature channels[i]; features without a counterpart weigh nothing."""
    first = np.zeros((features, layers[0]["w"].shape[1]))
    for i, k in channels.items():
        first[i] = layers[0]["w"][k]
    return [layers[0] | {"w": first}, *layers[1:]]


def finalise(scored: DataFrame, valid, columns: list[str], key: str, source: DataFrame) -> DataFrame:
    """The source's rows with the scored columns, null where a row is not valid or was not scored."""
    from pyspark.sql import functions as F

    kept = scored.select(key, *(F.when(valid, F.col(c)).alias(c) for c in columns))
    return source.join(kept, key, "left")
