"""Texts to unit vectors by a model of the caller's, in batches of like length."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of texts, padded to one length, and a mask of what is no padding, to a vector for each token: (n, length) twice to (n, length, width).
Model = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Texts that a model gets at once, and rows among which texts of like length are looked for.
BATCH, SORTED = 32, 4096


def pooled(states: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """Unit vectors from token vectors: their mean where they are no padding, or the first."""
    if how == "first":
        out = states[:, 0]
    else:
        weight = mask[:, :, None].astype(float)
        out = (states * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def batched(tokens: Sequence[Sequence[int]], model: Model, how: str = "mean", size: int = BATCH) -> tuple[np.ndarray, int]:
    """A row for each text, in their order, and how many tokens of padding the model was given. Texts go to it by length, shortest first."""
    order = sorted(range(len(tokens)), key=lambda i: (len(tokens[i]), i))
    out, padding = None, 0
    for at in range(0, len(order), size):
        own = order[at : at + size]
        length = max(1, len(tokens[own[-1]]))
        ids, mask = np.zeros((len(own), length), np.int64), np.zeros((len(own), length), bool)
        for row, i in enumerate(own):
            ids[row, : len(tokens[i])], mask[row, : len(tokens[i])] = tokens[i], True
        padding += int((~mask).sum())
        vectors = pooled(model(ids, mask), mask, how)
        out = np.zeros((len(order), vectors.shape[1])) if out is None else out
        out[own] = vectors
    return (np.zeros((0, 0)) if out is None else out), padding


def embedded(rows: DataFrame, key: str, load: Callable[[], tuple[Callable[[str], Sequence[int]], Model]], how: str = "mean", batch: int = BATCH, alone: bool = False) -> DataFrame:
    """key, embedding of every text (key, text): `load` gives the tokeniser and the model, once for each task.

    With `alone` the model gets one text at a time, as models do whose numbers
    depend on what stands beside a text. Null texts have no embedding.
    """
    kind = dict(rows.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, model = load()
        for part in parts:
            for at in range(0, len(part), SORTED):
                own = part.iloc[at : at + SORTED]
                vectors, _ = batched([cut(t) for t in own["text"]], model, how, 1 if alone else batch)
                yield pd.DataFrame({key: own[key].to_numpy(), "embedding": list(vectors.astype(np.float32))})

    return rows.where(F.col("text").isNotNull()).select(key, "text").mapInPandas(run, f"{key} {kind}, embedding array<float>")
