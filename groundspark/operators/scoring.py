"""Scores of pairs of texts by a model: any function of a list of (query, passage), loaded once a worker.

A worker's pairs are ordered by length and handed over in micro-batches, so that pairs padded to the longest of their
batch waste little; a pair is cut to ``most`` tokens, the passage first. The default is the overlap score.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PAIR_TOKENS, MICRO_BATCH = 512, 32
Model = Callable[[list[tuple[str, str]]], "np.ndarray"]

_loaded: dict[str, Model] = {}


def _model(load: Callable[[], Model]) -> Model:
    name = f"{load.__module__}.{load.__qualname__}"
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def _tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def overlap() -> Model:
    """The share of the query's distinct tokens that the passage has."""

    def score(pairs: list[tuple[str, str]]) -> np.ndarray:
        out = []
        for q, p in pairs:
            asked = set(_tokens(q))
            out.append(round(len(asked & set(_tokens(p))) / len(asked), 6) if asked else 0.0)
        return np.array(out)

    return score


def cut(query: str | None, passage: str | None, most: int) -> tuple[str, str, int]:
    """Both texts within ``most`` tokens, and how many they have. The query stays as long as it fits."""
    spans = lambda t: [m.end() for m in re.finditer(r"\S+", t or "")]
    q, p = spans(query), spans(passage)
    n = min(len(q), most)
    m = min(len(p), most - n)
    return (query or "")[: q[n - 1] if n else 0], (passage or "")[: p[m - 1] if m else 0], n + m


def pair_score(load: Callable[[], Model] = overlap, batch: int = MICRO_BATCH, most: int = PAIR_TOKENS) -> Callable[[Column, Column], Column]:
    """An expression of two texts: their score by the model that ``load`` returns. Nulls are empty texts."""

    def score(parts):
        model = _model(load)
        for queries, passages in parts:
            pairs = [cut(q, p, most) for q, p in zip(queries, passages, strict=True)]
            order = np.argsort([n for _, _, n in pairs], kind="stable")
            out = np.empty(len(pairs))
            for at in range(0, len(pairs), batch):
                own = order[at : at + batch]
                out[own] = model([pairs[k][:2] for k in own])
            yield pd.Series(out)

    score.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")
