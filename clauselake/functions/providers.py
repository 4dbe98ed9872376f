"""Calls of outside text models from a DataFrame: a list of providers tried in order, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from clauselake.operators.align import json_repaired


class Busy(Exception):
    """A provider that cannot answer now (rate, size or availability): the next one is asked."""


def answered(prompt: Column, providers: Sequence[Callable[[str], str]], batch: int = 20) -> Column:
    """struct(answer, provider, error) of each prompt. Only ``Busy`` moves on to the next provider; another error ends the row, not the job.

    Providers are called with one prompt; they are pickled to the workers. Prompts of a batch that are equal are asked once."""

    @F.pandas_udf("answer string, provider int, error string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            known: dict[str, tuple] = {}
            out = []
            for start in range(0, len(s), batch):
                for p in s.iloc[start : start + batch]:
                    if p is None:
                        out.append((None, None, None))
                        continue
                    if p not in known:
                        known[p] = _one(p, providers)
                    out.append(known[p])
            yield pd.DataFrame(out, columns=["answer", "provider", "error"]).astype({"provider": "Int32"})

    return ask(prompt)


def structured(prompt: Column, providers: Sequence[Callable[[str], str]], schema: str) -> Column:
    """Answers that should be JSON, read by a schema after repair (fences, stray quotes, missing ends); null where nothing can be read."""
    return F.from_json(json_repaired(answered(prompt, providers)["answer"]), schema)


def _one(prompt: str, providers: Sequence[Callable[[str], str]]) -> tuple:
    error = "no provider"
    for i, call in enumerate(providers):
        try:
            return call(prompt), i, None
        except Busy as e:
            error = str(e) or "busy"
        except Exception as e:
            return None, i, f"{type(e).__name__}: {e}"
    return None, None, error
