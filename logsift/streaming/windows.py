"""K3: count windows of each key on a stream, the open window kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logsift import constants as C

_STATE = "emitted bigint, orders array<bigint>, messages array<string>, alerts array<int>"


def stream_count_windows(
    events: DataFrame, key: str, order: str, size: int = C.WINDOW_SIZE,
    *, message: str = "message", alert: str = "is_alert", timeout_ms: int | None = None,
) -> DataFrame:
    """Windows of ``size`` consecutive events per key: key, window_number, is_anomaly, text.

    Lines of one key are taken in ``order`` (bigint) within each micro-batch and must not
    arrive earlier in a later one. State never exceeds ``size - 1`` events per key. With
    ``timeout_ms`` an idle key's incomplete window is emitted, otherwise it stays open.
    """
    out = f"{key} string, window_number bigint, is_anomaly int, events int, text string"

    def emit(name, number, rows):
        return {key: name, "window_number": number, "is_anomaly": int(max(r[2] for r in rows)),
                "events": len(rows), "text": "\n".join(r[1] for r in rows)}

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        emitted, held = 0, []
        if state.exists:
            emitted, orders, messages, alerts = state.get
            held = list(zip(orders, messages, alerts))
        if state.hasTimedOut:
            state.remove()
            if held:
                yield pd.DataFrame([emit(keys[0], emitted, held)])
            return
        fresh = pd.concat(list(batches))
        fresh = fresh.sort_values([order, message, alert])
        rows = held + list(fresh[[order, message, alert]].itertuples(index=False, name=None))
        full = len(rows) // size
        done = [emit(keys[0], emitted + w, rows[w * size : (w + 1) * size]) for w in range(full)]
        rows, emitted = rows[full * size :], emitted + full
        orders, messages, alerts = ([r[i] for r in rows] for i in range(3))
        state.update((emitted, [int(o) for o in orders], messages, [int(a) for a in alerts]))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        if done:
            yield pd.DataFrame(done)

    kind = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return (
        events.select(F.col(key).cast("string").alias(key), F.col(order).cast("bigint").alias(order),
                      message, F.col(alert).cast("int").alias(alert))
        .groupBy(key)
        .applyInPandasWithState(step, out, _STATE, "append", kind)
    )
