"""Whole-group batches for vectorised work on sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from corpusloom.arrowmap import give_back


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Regroup batches sorted by ``key`` so that no group spans two of them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[key].to_numpy()
        if held and keys[0] == held[-1][key].iloc[-1] and keys[-1] == keys[0]:
            held.append(batch)
            continue
        cut = int(np.argmax(keys == keys[-1]))
        if cut:
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = [batch.iloc[cut:]]
        elif held:
            yield pd.concat(held, ignore_index=True)
            held = [batch]
        else:
            held = [batch]
    if held:
        yield pd.concat(held, ignore_index=True)


def map_groups(df: DataFrame, key: str, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``work`` to frames that hold many complete groups of ``key`` each.

    One shuffle by ``key`` and a sort; far cheaper than one Python call a group when
    groups are small. Callers bound the size of a group before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, key):
            out = work(frame)
            if len(out):
                yield out
        give_back()

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(parts, key).sortWithinPartitions(key).mapInPandas(run, schema)


def spans(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], edge]), np.concatenate([edge, [len(keys)]])
