"""Replay of histories whose steps depend on earlier outcomes, in bounded memory.

Rows are dealt by key and sorted within their partition, and stream through a small state per key; nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame


def replayed(df: DataFrame, keys: list[str], order: list[str], state: Callable[[], object], schema: str) -> DataFrame:
    """Each key's rows, in order, through ``state()``: an object with step(row) -> rows and close(key) -> rows, rows being tuples
    of ``schema``."""

    def run(batches: Iterator):
        import pandas as pd

        names = [c.strip().split()[0] for c in schema.split(",")]
        now, machine = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != now:
                    if machine is not None:
                        out += machine.close(now)
                    now, machine = key, state()
                out += machine.step(row)
            yield pd.DataFrame(out, columns=names)
        if machine is not None:
            yield pd.DataFrame(machine.close(now), columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
