"""Next events on a stream: each node remembers its last event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAIRS = "node long, a long, b long, gap long, same boolean"
STATE = "event_id long, end long, src long, dst long"


def node_pairs(events: DataFrame) -> DataFrame:
    """``node, a, b, gap, same`` of a stream of events: pairs that follow each other at a node, as soon as the second comes.

    Events must come in order of their ids from batch to batch; within a batch
    they are put in order. ``same`` tells that both are on the same two nodes.
    The state of a node is one event.
    """
    rows = events.filter("src <> dst").select(F.explode(F.array("src", "dst")).alias("node"), "event_id", "start", "end", "src", "dst")

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        for e in pd.concat(list(frames)).sort_values("event_id").itertuples():
            if last is not None:
                out.append((key[0], last[0], e.event_id, e.start - last[1], {last[2], last[3]} == {e.src, e.dst}))
            last = (int(e.event_id), int(e.end), int(e.src), int(e.dst))
        state.update(last)
        yield pd.DataFrame(out, columns=["node", "a", "b", "gap", "same"])

    return rows.groupBy("node").applyInPandasWithState(follow, PAIRS, STATE, "append", GroupStateTimeout.NoTimeout)


def settled(pairs: DataFrame, tw: int) -> DataFrame:
    """``a, b, gap`` within ``tw`` from node pairs that have been gathered: the next events of :mod:`chronomotif.operators.adjacency`."""
    grouped = pairs.groupBy("a", "b").agg(F.countDistinct("node").alias("n"), F.first("same").alias("same"), F.first("gap").alias("gap"))
    return grouped.filter(((F.col("n") == 2) | ~F.col("same")) & F.col("gap").between(0, tw)).select("a", "b", "gap")
