"""Interval operators on Structured Streaming: the batch operators, where their plans are stateless or keyed by a window.

An overlap join against a static table hashes the cells of both, so it runs on a stream as it is. Islands need
all rows of a sequence; over a stream they are kept per sequence as arbitrary state, merged as batches arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.intervals import overlap_join

ISLANDS = "chrom string, start long, end long, n long"


def stream_overlap_join(stream: DataFrame, table: DataFrame, keys: tuple[str, ...] = ("chrom",), start: str = "start", end: str = "end") -> DataFrame:
    """Rows of a stream with the rows of a static table that they overlap."""
    return overlap_join(stream, table, list(keys), start, end)


def merge_into(islands: list[tuple[int, int, int]], ranges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Islands (start, end, n), in order, after they have absorbed ranges, by one sorted sweep; touching ones stay apart."""
    out: list[tuple[int, int, int]] = []
    for start, end, n in sorted([*islands, *((a, b, 1) for a, b in ranges)], key=lambda x: (x[0], -x[1])):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] + n)
        else:
            out.append((start, end, n))
    return out


def stream_islands(stream: DataFrame) -> DataFrame:
    """Islands of a stream of (chrom, start, end): after each batch, those that the batch made or changed (update mode).

    The state of a sequence is its list of islands; partition long sequences by region to bound it.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        islands = list(zip(*state.get)) if state.exists else []
        before = set(islands)
        for pdf in frames:
            islands = merge_into(islands, list(zip(pdf["start"].tolist(), pdf["end"].tolist())))
        state.update(tuple(list(c) for c in zip(*islands)))
        new = [i for i in islands if i not in before]
        yield pd.DataFrame({"chrom": [key[0]] * len(new), "start": [i[0] for i in new], "end": [i[1] for i in new], "n": [i[2] for i in new]})

    rows = stream.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    return rows.groupBy("chrom").applyInPandasWithState(update, ISLANDS, "starts array<long>, ends array<long>, ns array<long>", "update", GroupStateTimeout.NoTimeout)
