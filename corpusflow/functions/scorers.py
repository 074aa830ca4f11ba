"""Slots for models: pair scorers and embedders as Arrow-batched functions, with defaults that need no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import ColumnLike, col, tokens


def token_overlap(query: ColumnLike, text: ColumnLike) -> Column:
    """The share of the query's distinct tokens that the text has; 0 for an empty query."""
    q, t = F.array_distinct(tokens(query)), tokens(text)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def pair_scorer(make: Callable[[], Callable[[list[str], list[str]], list[float]]], batch: int = 32):
    """A column function (query, text) -> double; ``make`` loads the model once per task, a failed pair gives null."""

    @F.pandas_udf("double")
    def score(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, t in frames:
            out: list[float] = []
            for i in range(0, len(q), batch):
                out += model(q[i : i + batch].fillna("").tolist(), t[i : i + batch].fillna("").tolist())
            yield pd.Series(out, dtype=float)

    return score


def hashed_words(size: int) -> Callable[[list[str]], np.ndarray]:
    """An embedder without a model: signed counts of word hashes."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for row, text in zip(out, texts):
            for w in text.lower().split():
                h = crc32(w.encode())
                row[h % size] += 1 if h >> 31 else -1
        return out

    return run


def embedder(make: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: hashed_words(64), prefix: str = "passage: ", batch: int = 64):
    """A column function text -> array<float> of unit length, the prefix put before each text."""

    @F.pandas_udf("array<float>")
    def embed(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in frames:
            parts = []
            for i in range(0, len(s), batch):
                m = np.asarray(model([prefix + (t or "") for t in s[i : i + batch]]), np.float32)
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                parts += list(m / np.where(norm > 0, norm, 1))
            yield pd.Series(parts)

    return embed


def score_query(question: ColumnLike, answer: ColumnLike, head: int = 300) -> Column:
    """What a candidate is scored against: the question and the answer's first ``head`` characters."""
    return F.concat_ws(" ", col(question), F.substring(col(answer), 1, head))
