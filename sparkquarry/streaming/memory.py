"""Session memory as streaming state: the last turns of every session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Settings

OUT = "session_id string, turn int, query string, response string, back int"
STATE = "turns array<int>, queries array<string>, responses array<string>"


def session_memory(turns: DataFrame, settings: Settings, idle_ms: int | None = None) -> DataFrame:
    """A stream of (session_id, turn, query, response, back): after each micro-batch the last turns of the sessions it touched.

    A turn that comes again replaces itself; late turns take their place by number. State
    is bounded by ``memory_turns`` a session; a session idle for ``idle_ms`` milliseconds is
    forgotten, without it sessions are kept. Looking for idle sessions keeps a stream
    running, so such a one needs another trigger than ``availableNow``.
    """
    keep = settings.memory_turns

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows: dict[int, tuple] = {}
        if state.exists:
            rows = {t: (q, r) for t, q, r in zip(*state.get)}
        for pdf in batches:
            for t, q, r in zip(pdf["turn"], pdf["query"], pdf["response"]):
                rows[int(t)] = (q, r)
            rows = {t: rows[t] for t in sorted(rows)[-keep:]}
        order = sorted(rows)
        state.update((order, [rows[t][0] for t in order], [rows[t][1] for t in order]))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"session_id": key[0], "turn": order, "query": [rows[t][0] for t in order], "response": [rows[t][1] for t in order], "back": range(len(order), 0, -1)})

    return turns.groupBy("session_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
