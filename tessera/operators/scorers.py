"""Scorers of other libraries as iterator pandas UDFs: one model per worker, and a declared way out where a model can't be had."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a worker has loaded, by scorer.
_models: dict[str, Any] = {}


@dataclass(frozen=True)
class Scorer:
    """load: makes the model, once in a worker; an ImportError or OSError of it means that the worker can't have it. score: model and
    columns (rows without nulls) to numbers. fallback: the scorer to use then; none: the error stands."""

    name: str
    load: Callable[[], Any]
    score: Callable[..., pd.Series]
    fallback: Scorer | None = None


def _ready(scorer: Scorer) -> tuple[Scorer, Any]:
    """The first of a scorer and its fallbacks that can be loaded, and its model."""
    while True:
        if scorer.name not in _models:
            try:
                _models[scorer.name] = scorer.load()
            except (ImportError, OSError):
                if scorer.fallback is None:
                    raise
                scorer = scorer.fallback
                continue
        return scorer, _models[scorer.name]


def scored(scorer: Scorer, *inputs: Column) -> Column:
    """score and scorer (struct) of the inputs: a null input or a result that is no finite number gives a null score; scorer is the one that ran."""

    @F.pandas_udf("score double, scorer string")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        chosen, model = _ready(scorer)
        for columns in batches:
            there = pd.concat([c.notna() for c in columns], axis=1).all(axis=1)
            score = pd.Series(float("nan"), index=columns[0].index)
            if there.any():
                score[there] = chosen.score(model, *(c[there] for c in columns)).astype(float)
            yield pd.DataFrame({"score": score.where(score.abs() < float("inf")), "scorer": chosen.name})

    return run(*inputs)
