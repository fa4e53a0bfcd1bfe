"""Stages of a user's own model: vectors and metrics for rows, batch by batch.

A model takes a pandas DataFrame and gives one with as many rows. Where it fails on a batch,
its rows go through one by one, so one bad row costs no other; what fails alone gets an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows that a model takes at a time.
BATCH = 64


def batched(model: Callable[[pd.DataFrame], pd.DataFrame], added: str, batch: int = BATCH) -> Callable[[DataFrame], DataFrame]:
    """A stage that adds the model's columns (a DDL text) and error, null where the model gave a result."""
    names = T.StructType.fromDDL(added).names

    def stage(rows: DataFrame) -> DataFrame:
        kept = [f for f in rows.schema.fields if f.name not in (*names, "error")]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), added, "error string"])

        def of(part: pd.DataFrame) -> pd.DataFrame:
            own = part[[f.name for f in kept]].reset_index(drop=True)
            try:
                found = model(part.reset_index(drop=True))
                if len(found) != len(part):
                    raise ValueError(f"the model gave {len(found)} rows for {len(part)}")
                return own.assign(**{n: found[n].to_numpy() for n in names}, error=None)
            except Exception as e:  # noqa: BLE001 - whatever a model raises is an error of its rows
                if len(part) > 1:
                    return pd.concat([of(part.iloc[i : i + 1]) for i in range(len(part))], ignore_index=True)
                return own.assign(**{n: None for n in names}, error=f"{type(e).__name__}: {e}")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows_ in batches:
                for at in range(0, len(rows_), batch):
                    yield of(rows_.iloc[at : at + batch])

        return rows.mapInPandas(run, schema)

    return stage
