"""Rows put together from the lines of a log while it is written: custom state per log.

A row is a head line and the lines up to the next head. Lines may come in any order and more than once, over any number
of batches; what isn't whole yet waits in the state, and the last row waits for a timer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import QueryProgressEvent, StreamingQueryListener

from signalspark.sources.probes import METRICS

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HEAD, _TIME, _METRIC = re.compile(r"^frame:"), re.compile(r"pts_time:\s*([-\d.]+)"), re.compile(r"\.([A-Z]+)=(.+)$")


def _number(text: str | None) -> float | None:
    try:
        return float(text) if text is not None else None
    except ValueError:
        return None


def measured(lines: list[str]) -> list[float | None]:
    """The time and the metrics of a row's lines, the head first; of a metric named twice the greater value."""
    at = _TIME.search(lines[0])
    found: dict[str, float] = {}
    for name, text in (m.groups() for m in map(_METRIC.search, lines) if m):
        value = _number(text)
        if value is not None:
            found[name] = max(value, found.get(name, value))
    return [_number(at[1]) if at else None, *(found.get(m) for m in METRICS)]


class _Assembler(StatefulProcessor):
    """State of a log: lines that wait, by number; the number of the line that the next row begins with; rows so far."""

    def __init__(self, keys: list[str], first: int, idle_ms: int):
        self.keys, self.first, self.idle_ms = keys, first, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "line_no long", "line string")
        self.place = handle.getValueState("place", "next long, frame long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        begin, frame = self.place.get() if self.place.exists() else (self.first, 0)
        newest = 0
        for part in rows:
            if part.empty:  # a call without rows for this log
                continue
            newest = max(newest, int(part["came_at"].max()))
            for number, line in zip(part["line_no"].tolist(), part["line"].tolist(), strict=True):
                if number >= begin:  # else its row has gone out already
                    self.waiting.updateValue((number,), (line or "",))
        pending = {k[0]: v[0] for k, v in self.waiting.iterator()} if self.waiting.exists() else {}
        end = begin
        while end in pending:
            end += 1
        out, begin_next, frame = self._rows(key, [(i, pending[i]) for i in range(begin, end)], frame, last=False)
        for i in range(begin, begin_next):
            self.waiting.removeKey((i,))
        self.place.update((max(begin, begin_next), frame))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        begin, frame = self.place.get() if self.place.exists() else (self.first, 0)
        pending = sorted((k[0], v[0]) for k, v in self.waiting.iterator()) if self.waiting.exists() else []
        out, _, frame = self._rows(key, pending, frame, last=True)
        self.waiting.clear()
        self.place.update((pending[-1][0] + 1 if pending else begin, frame))
        yield out

    def _rows(self, key, lines: list[tuple[int, str]], frame: int, last: bool) -> tuple[pd.DataFrame, int, int]:
        """The rows that are whole (all of them, if these are the last lines), where the rest begins, and the rows so far."""
        heads = [k for k, (_, line) in enumerate(lines) if _HEAD.match(line)]
        cuts = [*heads, len(lines)] if last else heads
        rows = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            rows.append([*key, frame, *measured([line for _, line in lines[a:b]])])
            frame += 1
        if last or not lines:
            rest = lines[-1][0] + 1 if lines else -1
        else:  # what comes before the first head belongs to no row
            rest = lines[heads[-1]][0] if heads else lines[-1][0] + 1
        return pd.DataFrame(rows, columns=[*self.keys, "frame", "t", *METRICS]), rest, frame


def frame_rows(lines: DataFrame, keys: list[str], time: str, *, first: int = 0, late: str = "1 minute", idle: str = "10 minutes") -> DataFrame:
    """(keys, frame, t, 13 metrics) of a stream of (keys, line_no, line, time): the rows of probes.frame_log, in any order of
    arrival, each once.

    Lines of a log are numbered from `first`; a line that came before is left out. A row goes out when the next head and
    all lines before it are there. When the watermark, `late` behind the newest line, has passed a log's newest line by
    `idle`, what waits goes out as it is, missing lines or not, and leaves the state; two numbers of a log remain. Uses
    RocksDB for the state, which this sets in the session.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    kinds = [T.StructField(k, lines.schema[k].dataType) for k in keys]
    out = T.StructType([*kinds, T.StructField("frame", T.LongType()), T.StructField("t", T.DoubleType()), *(T.StructField(m, T.DoubleType()) for m in METRICS)])
    marked = lines.withWatermark(time, late).select(*keys, F.col("line_no").cast("long").alias("line_no"), "line", time, F.unix_millis(time).alias("came_at"))
    wait = max(1, int(pd.Timedelta(idle).total_seconds() * 1000))
    return marked.groupBy(*keys).transformWithStateInPandas(_Assembler(keys, first, wait), out, "append", "eventTime")


class Progress(StreamingQueryListener):
    """Calls `report` with (query id, batch, rows in, rows of state) every `every` rows that have come in, and after each
    batch that crosses that number."""

    def __init__(self, report, every: int = 30):
        self.report, self.every, self.rows = report, every, {}

    def onQueryStarted(self, event) -> None:
        self.rows[event.id] = 0

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        before = self.rows.get(p.id, 0)
        self.rows[p.id] = before + p.numInputRows
        if self.rows[p.id] // self.every > before // self.every:
            self.report(str(p.id), p.batchId, self.rows[p.id], sum(s.numRowsTotal for s in p.stateOperators))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.rows.pop(event.id, None)
