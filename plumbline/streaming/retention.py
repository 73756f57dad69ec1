"""Feeds that show a key once in a while instead of once for ever, with state that is forgotten."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import runs
from .feeds import RUN_OPERATIONS

_AT = "shown_at"
_MICROS = 1000
#: State rows over which the keys are dealt by a hash, and with them the rows of a micro-batch.
BUCKETS = 128


class _Shown(StatefulProcessor):
    """Keeps when the keys of a bucket were shown last, until the watermark is past the time in which a key stays silent.

    A call to the state costs about as much for one key as for many, so the keys of a bucket share a state
    row and a timer.  The row is written anew with each micro-batch that has rows for the bucket.
    """

    def __init__(self, key: T.StructType, retention_ms: int):
        self.key, self.retention_ms = key, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        state = T.StructType().add("keys", T.ArrayType(self.key)).add("last_ms", T.ArrayType(T.LongType()))
        self.last = handle.getValueState("last", state.add("timer_ms", T.LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        keys, last, timer = self._held()
        before = dict(zip(keys, last))
        # By place: the columns may come under other names.
        frames = list(rows)
        parts = [np.concatenate([f.iloc[:, i].to_numpy(dtype=object) for f in frames]) for i in range(1, len(self.key) + 1)]
        at = np.concatenate([f.iloc[:, -1].to_numpy(dtype=np.int64) for f in frames])
        codes, known = pd.factorize(pd.MultiIndex.from_arrays(parts)) if len(parts) > 1 else pd.factorize(parts[0])
        order = np.lexsort((at, codes))
        cuts = np.searchsorted(codes[order], np.arange(len(known) + 1)).tolist()
        times, step, shown = at[order], self.retention_ms * _MICROS, []
        for value, low, high in zip(known, cuts[:-1], cuts[1:]):
            value = tuple(value) if len(parts) > 1 else (value,)
            own, place = times[low:high], 0
            if value in before:
                place = int(np.searchsorted(own, before[value] * _MICROS + step))
            while place < len(own):
                shown.append((*value, int(own[place])))
                # Down to the millisecond, as timers are; a whole one is what the rule then goes by.
                before[value] = int(own[place]) // _MICROS
                place = int(np.searchsorted(own, shown[-1][-1] + step))
        self._keep(before, timer)
        yield self._rows(shown)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Only here, after the rows of the micro-batch: those may be older than the watermark that it has reached.
        now = timerValues.getCurrentWatermarkInMs()
        keys, last, _ = self._held()
        self._keep({k: t for k, t in zip(keys, last) if t + self.retention_ms > now}, None)
        yield self._rows([])

    def _held(self) -> tuple[list[tuple], list[int], int | None]:
        """Keys, when they were shown last, and the timer that is set."""
        if not self.last.exists():
            return [], [], None
        keys, last, timer = self.last.get()
        return [tuple(k) for k in keys], last, timer

    def _keep(self, last: dict[tuple, int], timer: int | None) -> None:
        """One timer: when the first of the keys may be forgotten."""
        due = min(last.values()) + self.retention_ms if last else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.last.clear()
            return
        self.last.update((list(last), list(last.values()), due))
        if timer != due:
            self.handle.registerTimer(due)

    def _rows(self, shown: list[tuple]) -> pd.DataFrame:
        columns = list(zip(*shown)) if shown else [()] * (len(self.key) + 1)
        keys = {f.name: pd.Series(v, dtype=object) for f, v in zip(self.key.fields, columns)}
        return pd.DataFrame(keys | {"_us": pd.Series(columns[-1], dtype="int64")})

    def close(self) -> None:
        pass


def shown_again(changes: DataFrame, key: Sequence[str], at: str, retention_minutes: int, late: str = "0 seconds") -> DataFrame:
    """(key, shown_at): a row when a key appears that was not shown in the ``retention_minutes`` before.  Output mode: append.

    The rule goes by event time and looks at milliseconds: however a feed that is in order is cut into micro-batches, the same
    rows are shown.  Rows later than ``late`` are dropped.  State is a time for each key, dropped once the watermark
    is past the time in which the key stays silent; no key is kept for ever.  Keys are dealt over ``BUCKETS`` state rows.  Rows with a null key column or time
    are not shown.  Times without a zone are read in the session's, which has to be UTC.
    """
    key = list(key)
    known = changes.where(F.col(at).isNotNull()).dropna(subset=key)
    timed = known.select(*key, F.date_trunc("millisecond", F.col(at).cast("timestamp")).alias("_at")).withWatermark("_at", late)
    schema = T.StructType([timed.schema[c] for c in key])
    bucket = F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int").alias("_bucket")
    found = timed.select(bucket, *key, "_at", F.unix_micros("_at").alias("_at_us")).groupBy("_bucket").transformWithStateInPandas(
        _Shown(schema, retention_minutes * 60_000), T.StructType([*schema.fields]).add("_us", T.LongType()), "append", "EventTime"
    )
    return found.select(*key, F.timestamp_micros("_us").cast("timestamp_ntz").alias(_AT))


def pending_again(changes: DataFrame, at: str, retention_minutes: int, late: str = "0 seconds") -> DataFrame:
    """Runs to start as in ``feeds.pending_runs``, where a run that is submitted again after its retention shows again."""
    wanted = changes.where(F.col("operation").isin(*RUN_OPERATIONS) & (F.col("status") == "pending"))
    return shown_again(runs.for_daemon(wanted), ["run_id"], at, retention_minutes, late)


def answers_again(changes: DataFrame, at: str, retention_minutes: int, late: str = "0 seconds") -> DataFrame:
    """Inserted answers as in ``feeds.new_answers``, with the same retention for each run and question."""
    return shown_again(changes.where(F.col("operation") == "insert"), ["run_id", "question_id"], at, retention_minutes, late)
