"""Second opinions from a model behind a callable: scoring with retries, and pairwise comparison."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, ExitStack

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import balanced_object, cleaned_json, parse_answer, parse_explanation
from ..functions.vectors import clamp
from ..tables import ship


def ask(df: DataFrame, prompt: str, generate: Callable[[str], str] | None = None, good: Callable[[str], bool] = lambda _: True, attempts: int = 3, backoff: float = 1.0, session: Callable[[], AbstractContextManager[Callable[[str], str]]] | None = None) -> DataFrame:
    """df with answer: generate(prompt), again up to `attempts` times while it raises or is not good, waiting in between.

    One call at a time in each task; after the last attempt the last answer, or null, stays.  A model that must be
    loaded comes as a session: a context manager that gives generate, entered once a task, when its first row
    comes, and left when its rows end or fail, so that what it loaded is given back.
    """
    if (generate is None) == (session is None):
        raise ValueError("either generate or session is needed")
    ship(df.sparkSession)
    at = df.columns.index(prompt)

    def once(generate: Callable[[str], str], text: str | None) -> str | None:
        answer = None
        for k in range(attempts if text is not None else 0):
            if k:
                time.sleep(backoff * 2 ** (k - 1))
            try:
                answer = generate(text)
                if good(answer):
                    break
            except Exception:
                continue
        return answer

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ExitStack() as held:
            call = generate
            for pdf in batches:
                if call is None and len(pdf):
                    call = held.enter_context(session())
                yield pdf.assign(answer=[once(call, x) for x in pdf.iloc[:, at]])

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", answer string")


def scored(df: DataFrame, answer: str = "answer") -> DataFrame:
    """df with the parsed answer; a null one is a parse error."""
    return df.withColumn("stage3", parse_answer(F.coalesce(F.col(answer), F.lit(""))))


def explained(df: DataFrame, answer: str = "answer") -> DataFrame:
    """df with the parsed explanation; a null answer is a parse error."""
    return df.withColumn("explained", parse_explanation(F.coalesce(F.col(answer), F.lit(""))))


def picked(df: DataFrame, answer: str = "answer") -> DataFrame:
    """df with winner (A or B, any case) and confidence of a comparison; unreadable: A with confidence 0."""
    data = F.try_parse_json(cleaned_json(balanced_object(F.coalesce(F.col(answer), F.lit("")))))
    winner = F.upper(F.trim(F.try_variant_get(data, "$.winner", "string")))
    ok = F.coalesce(winner.isin("A", "B"), F.lit(False))
    return df.withColumn("winner", F.when(ok, winner).otherwise("A")).withColumn("confidence", F.when(ok, clamp(F.coalesce(F.try_variant_get(data, "$.confidence", "double"), F.lit(0.0)))).otherwise(0.0))
