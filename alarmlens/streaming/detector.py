"""The detector on a stream of samples: one state for each segment, which is that of the batch detector."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from alarmlens.operators.bocpd import Segment, Tables

FOUND = "channel string, segment long, onset long, confirm long, confidence double"


def onsets(samples: DataFrame, params: DataFrame, idle: str | None = "1 day") -> DataFrame:
    """A row for each segment (channel, segment, t, value) of a stream, when its first onset is confirmed.

    params (channel, r, q) is a static table. Samples of a segment must come in order of t from one micro-batch to the next;
    inside one they are put in order. A segment's state is dropped when no sample of it came for idle (processing time); a
    sample after that begins it anew. Without idle, states stay. Null values count for missing samples.
    """
    rows = samples.where("value IS NOT NULL").join(F.broadcast(params.select("channel", "r", "q")), "channel")
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(batches)).sort_values("t")
        if state.exists:
            segment = pickle.loads(state.get[0])
            segment.lengths.tables = Tables(True)
        else:
            segment = Segment(float(batch["r"].iloc[0]), float(batch["q"].iloc[0]), Tables(True), whole=False)
        known = segment.found
        for value in batch["value"]:
            segment.step(float(value))
        if segment.found and not known:
            onset, confirm, confidence, _ = segment.found
            yield pd.DataFrame([(*key, onset, confirm, confidence)], columns=["channel", "segment", "onset", "confirm", "confidence"])
        segment.lengths.tables = None  # it follows from the run lengths
        state.update((pickle.dumps(segment),))
        if idle:
            state.setTimeoutDuration(milliseconds)

    keyed = rows.select("channel", "segment", "t", "value", "r", "q").groupBy("channel", "segment")
    return keyed.applyInPandasWithState(step, FOUND, "segment binary", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
