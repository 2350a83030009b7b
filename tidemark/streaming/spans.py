"""Structured Streaming twins: sessions of intervals and runs of a label, with watermarks for late rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(rows: DataFrame, gap_seconds: int, late: str = "1 day") -> DataFrame:
    """Rows (key, at: timestamp, seconds) joined while less than ``gap_seconds`` lie between an end and the next start.

    Works on streams and on tables.  On a stream a session is complete once the watermark passes its end; rows later
    than ``late`` are dropped.
    """
    length = F.concat((F.col("seconds") + gap_seconds).cast("long").cast("string"), F.lit(" seconds"))
    grouped = rows.withWatermark("at", late).groupBy("key", F.session_window("at", length).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "seconds")


def label_changes(rows: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Of rows (key, i, label), those whose label differs from the key's last one, the first included; null is a label.

    The state is one label and place.  With ``idle_ms`` a key that is idle for so long is forgotten and starts anew; that
    needs a trigger that keeps running, as a query with such timeouts never runs out of batches.
    Rows of a batch are taken in order of i; rows at or before the last place seen are late and dropped.
    """

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = not state.exists
        label, at = (None, -(2**62)) if new else state.get
        out = []
        for r in pd.concat(list(parts)).sort_values("i", kind="stable").itertuples(index=False):
            if r.i <= at:
                continue
            now = None if pd.isna(r.label) else r.label
            if new or now != label:
                out.append((key[0], r.i, now))
            label, at, new = now, r.i, False
        state.update((label, at))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["key", "i", "label"])

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("key").applyInPandasWithState(step, "key string, i long, label string", "label string, at long", "append", timeout)
