"""Encoders: vectors to a few logits. Layers are (weights, bias, relu); batch normalisation is folded into them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.vectors import dot, doubles, l2_normalize, literal


class Encoder(Protocol):
    """What an encoder of the caller's own must do: give the frame a column `logits` (array<double>)."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Layer:
    weights: tuple[tuple[float, ...], ...]
    bias: tuple[float, ...] | None = None
    relu: bool = False


def fold_batch_norm(layer: Layer, gamma: Sequence[float], beta: Sequence[float], mean: Sequence[float], var: Sequence[float], eps: float = 1e-5) -> Layer:
    """The layer followed by batch normalisation, as one layer."""
    bias = layer.bias or (0.0,) * len(layer.weights)
    scale = [g / (v + eps) ** 0.5 for g, v in zip(gamma, var)]
    weights = tuple(tuple(w * s for w in row) for row, s in zip(layer.weights, scale))
    return Layer(weights, tuple((b - m) * s + t for b, m, s, t in zip(bias, mean, scale, beta)), layer.relu)


def _applied(v: Column, layer: Layer) -> Column:
    bias = layer.bias or (None,) * len(layer.weights)
    out = []
    for row, b in zip(layer.weights, bias):
        x = dot(v, literal(row))
        x = x if b is None else x + F.lit(float(b))
        out.append(F.greatest(x, F.lit(0.0)) if layer.relu else x)
    return F.array(*out)


def encode(df: DataFrame, layers: Sequence[Layer], vector: str = "embedding", out: str = "logits", cosine: bool = False) -> DataFrame:
    """The frame with logits, as column expressions. Each layer is a column of its own, so no layer is computed twice."""
    x = doubles(F.col(vector))
    for k, layer in enumerate(layers):
        df = df.withColumn(f"_{out}{k}", _applied(x, layer))
        x = F.col(f"_{out}{k}")
    return df.withColumn(out, l2_normalize(x) if cosine else x).drop(*(f"_{out}{k}" for k in range(len(layers))))


def encode_arrow(df: DataFrame, layers: Sequence[Layer], key: str = "vec_id", vector: str = "embedding", cosine: bool = False, rows: int = 4096) -> DataFrame:
    """key and logits by matrix products over Arrow batches; for bulk encoding, where folds in expressions are slow."""
    weights = [(np.array(x.weights), None if x.bias is None else np.array(x.bias), x.relu) for x in layers]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), rows):
                part = pdf.iloc[at : at + rows]
                x = np.stack(part[vector].to_numpy()).astype(np.float64)
                for w, b, relu in weights:
                    x = x @ w.T if b is None else x @ w.T + b
                    x = np.maximum(x, 0) if relu else x
                if cosine:
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({key: part[key], "logits": list(x)})

    return df.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(run, f"{key} bigint, logits array<double>")


def arrow_encoder(layers: Sequence[Layer], vector: str = "embedding") -> Encoder:
    """The layers as an encoder for wide networks: matrix products over Arrow batches, all columns kept. Rows without a vector go."""
    weights = [(np.array(x.weights), None if x.bias is None else np.array(x.bias), x.relu) for x in layers]

    def run(df: DataFrame) -> DataFrame:
        at = df.columns.index(vector)

        def batches(found):
            import pyarrow as pa

            for batch in found:
                n = batch.num_rows
                x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, weights[0][0].shape[1]))
                for w, b, relu in weights:
                    x = x @ w.T if b is None else x @ w.T + b
                    x = np.maximum(x, 0) if relu else x
                logits = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, logits], [*batch.schema.names, "logits"])

        schema = T.StructType([*df.schema.fields, T.StructField("logits", T.ArrayType(T.DoubleType()))])
        return df.where(F.col(vector).isNotNull()).mapInArrow(batches, schema)

    return run


def first_rows(df: DataFrame, ratio: float, key: str = "vec_id") -> DataFrame:
    """Rows of the first share of ids, one at least; ids are dense from 0."""
    n = df.agg((F.max(key) + 1).alias("n"))
    return df.join(F.broadcast(n), F.col(key) < F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(ratio)))).drop("n")


def selective_similarity_loss(pairs: DataFrame, tau: float, gamma: float, d_low: int, d_high: int) -> DataFrame:
    """The training loss over pairs with columns s_in and s_emb (Euclidean distances before and after): the mean squared gap to the scaled
    distance over pairs that are near before, or came too near after. loss, kept."""
    scale = gamma * (d_low / d_high) ** 0.5
    keep = (F.col("s_in") < F.lit(tau)) | (F.col("s_emb") < F.lit(tau * scale))
    gap = F.col("s_emb") - F.lit(scale) * F.col("s_in")
    return pairs.agg(
        (F.coalesce(F.sum(F.when(keep, gap * gap)), F.lit(0.0)) / F.greatest(F.sum(F.when(keep, 1).otherwise(0)), F.lit(1))).alias("loss"),
        F.coalesce(F.sum(F.when(keep, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("kept"),
    )


def selective_similarity_loss_cosine(pairs: DataFrame, near: float = 0.5, near_after: float = 0.7, gamma: float = 0.9) -> DataFrame:
    """The loss for cosine over pairs with the similarities s_in (of normalised inputs) and s_emb (of encodings as they are): the mean squared
    gap (1 - s_emb) - gamma (1 - s_in) over pairs that are similar before, or became too similar after. loss, kept."""
    keep = (F.col("s_in") > F.lit(near)) | (F.col("s_emb") > F.lit(near_after))
    gap = (F.lit(1.0) - F.col("s_emb")) - F.lit(gamma) * (F.lit(1.0) - F.col("s_in"))
    n = F.coalesce(F.sum(F.when(keep, 1).otherwise(0)), F.lit(0))
    return pairs.agg((F.coalesce(F.sum(F.when(keep, gap * gap)), F.lit(0.0)) / F.greatest(n, F.lit(1))).alias("loss"), n.cast("bigint").alias("kept"))


def train(vectors: np.ndarray, d_low: int, hidden: int = 32, tau: float = 1.3, gamma: float = 0.6, epochs: int = 30, batch: int = 256, rate: float = 2e-3, keep: int = 5, seed: int = 42) -> list[tuple[float, list[Layer]]]:
    """Fit a two-layer encoder with the selective similarity loss on a bounded sample (the caller's array) by Adam; the `keep` checkpoints
    of smallest validation loss, best first. The last tenth of the rows validates."""
    rng = np.random.default_rng(seed)
    n, d = vectors.shape
    cut = max(1, n - max(1, n // 10))
    fit, val = vectors[:cut].astype(np.float64), vectors[cut:].astype(np.float64)
    p = [rng.normal(0, (2 / d) ** 0.5, (hidden, d)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (d_low, hidden)), np.zeros(d_low)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    scale = gamma * (d_low / d) ** 0.5

    def distances(x: np.ndarray) -> np.ndarray:
        sq = (x * x).sum(axis=1)
        return np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 1e-12))

    def loss(x: np.ndarray, grad: bool):
        if len(x) < 2:  # no pair
            return 0.0, None
        h0 = x @ p[0].T + p[1]
        h = np.maximum(h0, 0)
        z = h @ p[2].T + p[3]
        s_in, s = distances(x), distances(z)
        mask = ((s_in < tau) | (s < tau * scale)) & ~np.eye(len(x), dtype=bool)
        gap, total = np.where(mask, s - scale * s_in, 0), max(mask.sum(), 1)
        value = float((gap * gap).sum() / total)
        if not grad:
            return value, None
        g = 2 * gap / total / s
        g = g + g.T
        dz = g.sum(axis=1)[:, None] * z - g @ z
        dh = (dz @ p[2]) * (h0 > 0)
        return value, [dh.T @ x, dh.sum(axis=0), dz.T @ h, dz.sum(axis=0)]

    best, step = [], 0
    for _ in range(epochs):
        order = rng.permutation(cut)
        for at in range(0, cut, batch):
            _, g = loss(fit[order[at : at + batch]], True)
            if g is None:
                continue
            step += 1
            for k in range(4):
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        value = loss(val if len(val) > 1 else fit[:batch], False)[0]
        as_rows = lambda a: tuple(map(tuple, a.tolist()))
        best.append((value, [Layer(as_rows(p[0]), tuple(p[1].tolist()), True), Layer(as_rows(p[2]), tuple(p[3].tolist()))]))
        best = sorted(best, key=lambda b: b[0])[:keep]
    return best
