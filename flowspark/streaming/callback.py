"""Callbacks in streams: tokens that wait for an answer, with timers in event time.

Registrations and answers are one stream, keyed by (trace, token).  The state of a key
is the registration that waits; its timer fires when the watermark passes the
deadline.  Outcomes are those of `operators.choreography.callbacks`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "trace string, token string, event_id bigint, ts bigint, outcome string, answer_id bigint, settled_ts bigint, argument string"


def callback_stream(events: DataFrame, timeout_ms: int, time: str = "time", lateness: str = "0 seconds") -> DataFrame:
    """Outcomes of registrations, as they are settled.

    `events` has trace, token, event_id, argument, `time` (a timestamp) and kind: 0
    registers, 1 answers.  A null token registers nothing and answers nothing.
    """
    rows = events.withWatermark(time, lateness).where("token IS NOT NULL")
    rows = rows.select(F.col("trace").cast("string").alias("trace"), "token", "event_id", "argument", "kind", F.unix_millis(time).alias("ts"), time)

    def handle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waits = json.loads(state.get[0]) if state.exists else None
        out: list[tuple] = []

        def settle(outcome: str, answer: int | None, at: int) -> None:
            out.append((*key, waits["event_id"], waits["ts"], outcome, answer, at, waits["argument"]))

        if state.hasTimedOut:
            settle("timeout", None, waits["ts"] + timeout_ms)
            waits = None
        else:
            for event_id, argument, kind, ts in pd.concat(list(batches)).sort_values(["ts", "kind", "event_id"], kind="stable")[["event_id", "argument", "kind", "ts"]].itertuples(index=False, name=None):
                if waits is not None and (ts > waits["ts"] + timeout_ms or kind == 0):  # too late, or registered again
                    settle("timeout", None, waits["ts"] + timeout_ms)
                    waits = None
                if kind == 0:
                    waits = {"event_id": int(event_id), "ts": int(ts), "argument": None if argument is None or argument != argument else argument}
                elif waits is not None:
                    settle("callback", int(event_id), int(ts))
                    waits = None
        if waits is None:
            state.remove()
        else:
            state.update((json.dumps(waits),))
            state.setTimeoutTimestamp(max(waits["ts"] + timeout_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            frame = pd.DataFrame(out, columns=["trace", "token", "event_id", "ts", "outcome", "answer_id", "settled_ts", "argument"])
            yield frame.astype({"answer_id": "Int64"})

    return rows.groupBy("trace", "token").applyInPandasWithState(handle, SCHEMA, "waits string", "append", GroupStateTimeout.EventTimeTimeout)
