"""A hash-chained log checked while it streams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with maps needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FAULTS = "chain string, place long, problem string"


class _Links(StatefulProcessor):
    """Of each chain the place that comes next, the entry stored before it, and rows that came too early."""

    def __init__(self, first: int, patience: int):
        self.first, self.patience = first, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "next long, entry string")
        self.early = handle.getMapState("early", "place long", "value string, entry string, previous string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.head.get() if self.head.exists() else (self.first, None)
        at, entry = int(held[0]), held[1]
        waiting = {int(k[0]): tuple(v) for k, v in self.early.iterator()} if self.early.exists() else {}
        stored, faults = set(waiting), []
        for frame in rows:
            for place, *row in frame[["place", "value", "entry", "previous"]].itertuples(index=False):
                row = tuple(None if pd.isna(x) else x for x in row)
                if place < at or place in waiting:
                    faults.append((int(place), "repeated"))
                else:
                    waiting[int(place)] = row
        while waiting:
            if at not in waiting:
                if len(waiting) <= self.patience:
                    break
                faults += [(p, "missing") for p in range(at, min(waiting))]
                at = min(waiting)
            value, own, previous = waiting.pop(at)
            if own != hashlib.sha256(f"{at}:{value}".encode() if value is not None else f"{at}".encode()).hexdigest():
                faults.append((at, "changed"))
            if previous != entry:
                faults.append((at, "unlinked"))
            at, entry = at + 1, own
        self.head.update((at, entry))
        for place in stored - set(waiting):
            self.early.removeKey((place,))
        for place in set(waiting) - stored:
            self.early.updateValue((place,), waiting[place])
        if faults:
            yield pd.DataFrame({"chain": [str(key[0])] * len(faults), "place": [p for p, _ in faults], "problem": [w for _, w in faults]})

    def close(self) -> None:
        pass


def faults(log: DataFrame, chain: str, place: str, value: str, first: int = 1, patience: int = 1000) -> DataFrame:
    """``chain, place, problem`` of a streaming log of ``chain_log``: entries changed, unlinked, repeated or missing, as soon as that is known.

    Rows may come in any order: those that are early wait. A place counts as missing once more than ``patience`` later ones wait for it, so a chain holds
    that many rows at most; the row behind it then doesn't follow what is stored before. The batch check of the same log finds the same
    changed and unlinked rows. The session needs the state store ``STORE``.
    """
    rows = log.select(F.col(chain).cast("string").alias("chain"), F.col(place).cast("long").alias("place"), F.col(value).cast("string").alias("value"), F.col("entry_sha256").alias("entry"), F.col("previous_sha256").alias("previous"))
    return rows.groupBy("chain").transformWithStateInPandas(_Links(first, patience), FAULTS, "append", "none")
