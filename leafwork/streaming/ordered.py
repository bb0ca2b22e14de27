"""Events of a key in order of time, with state that Spark keeps."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_LONG = T.LongType()
_LAST = T.StructType([T.StructField("value", T.StringType()), T.StructField("at", _LONG), T.StructField("seq", _LONG)])
_COUNT = T.StructType([T.StructField("rows", _LONG)])
_BUCKET = T.StructType([T.StructField("bucket", _LONG)])
_FILL = T.StructType([T.StructField("chunks", _LONG), T.StructField("earliest", _LONG)])
_CHUNK = T.StructType([T.StructField("bucket", _LONG), T.StructField("number", _LONG)])
FEW = 1000  # events of a key that wait in one list
_FRAME = 10_000  # events passed on at a time


class Changes(StatefulProcessor):
    """Pass on the events whose ``compared`` value differs from the event before.

    Events wait until the watermark has passed them; then they are taken in order of
    ``at`` (microseconds) and ``seq``. One timer per key is set at a time, for the earliest
    event waiting. An event that is older than one passed on already is late: dropped.

    The first events of a key wait in a list. A key with more than ``FEW`` keeps them by
    buckets of ``width`` microseconds instead, in chunks as they came; ripe buckets are read
    one after the other, so no task holds more of a key than a bucket and a frame.
    """

    def __init__(self, columns: list[str], schema: T.StructType, compared: str, width: int) -> None:
        self._columns, self._schema, self._width = columns, schema, width
        self._value, self._at, self._seq = (columns.index(c) for c in (compared, "at", "seq"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._few = handle.getListState("few", self._schema)
        self._count = handle.getValueState("count", _COUNT)
        self._buckets = handle.getMapState("buckets", _BUCKET, _FILL)
        chunk = T.StructType([T.StructField("events", T.ArrayType(self._schema))])
        self._chunks = handle.getMapState("chunks", _CHUNK, chunk)
        self._last = handle.getValueState("last", _LAST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            came = [self._plain(r) for r in part[self._columns].itertuples(index=False, name=None)]
            if not came:
                continue
            least = min(r[self._at] for r in came)
            earliest = least if earliest is None else min(earliest, least)
            held = self._count.get()
            held = held[0] if held else 0
            if held >= 0 and held + len(came) <= FEW:
                self._few.appendList(came)
                self._count.update((held + len(came),))
            else:
                if held >= 0:  # from now on by buckets
                    came += self._listed()
                    self._count.update((-1,))
                self._keep(came)
        if earliest is not None:
            self._set_timer(earliest)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        last = self._last.get()
        state = [last[0], (last[1], last[2])] if last else [None, None]
        held = self._count.get()
        left: list[int] = []
        if held and held[0] >= 0:
            ripe, rest = self._parted(self._listed(), now)
            if rest:
                self._few.put(rest)
            self._count.update((len(rest),))
            left = [r[self._at] for r in rest]
            yield from self._changed(ripe, state)
        else:
            for bucket in sorted(b for (b,) in self._buckets.keys() if b * self._width // 1000 <= now):
                ripe, rest = self._parted(self._taken(bucket), now)
                yield from self._changed(ripe, state)
                if rest:
                    self._keep(rest)
            left = [earliest for _, earliest in self._buckets.values()]
            if not left:
                self._count.update((0,))
        if state[1] is not None:
            self._last.update((state[0], *state[1]))
        if left:
            # The timer that fired is still listed, but gone afterwards.
            self._handle.registerTimer(min(left) // 1000 - 1)

    def close(self) -> None:
        pass

    def _listed(self) -> list[tuple]:
        found = [self._plain(r) for r in self._few.get()] if self._few.exists() else []
        self._few.clear()
        return found

    def _keep(self, events: list[tuple]) -> None:
        """Add events to their buckets, a chunk for each bucket they meet."""
        of = lambda r: r[self._at] // self._width
        for bucket, part in groupby(sorted(events, key=of), key=of):
            chunk = list(part)
            least = min(r[self._at] for r in chunk)
            fill = self._buckets.getValue((bucket,)) if self._buckets.containsKey((bucket,)) else (0, least)
            self._chunks.updateValue((bucket, fill[0]), (chunk,))
            self._buckets.updateValue((bucket,), (fill[0] + 1, min(fill[1], least)))

    def _taken(self, bucket: int) -> list[tuple]:
        """The events of a bucket, which is removed."""
        chunks, _ = self._buckets.getValue((bucket,))
        events = []
        for number in range(chunks):
            events += [self._plain(r) for r in self._chunks.getValue((bucket, number))[0]]
            self._chunks.removeKey((bucket, number))
        self._buckets.removeKey((bucket,))
        return events

    def _parted(self, events: list[tuple], now: int) -> tuple[list[tuple], list[tuple]]:
        ripe = [r for r in events if r[self._at] // 1000 <= now]
        return sorted(ripe, key=self._place), [r for r in events if r[self._at] // 1000 > now]

    def _changed(self, ripe: list[tuple], state: list) -> Iterator[pd.DataFrame]:
        """Ordered events that change the value; ``state`` is the last value and its place."""
        out = []
        for row in ripe:
            if state[1] is not None and self._place(row) <= state[1]:
                continue
            if state[1] is None or row[self._value] != state[0]:
                out.append(row)
            state[:] = row[self._value], self._place(row)
        for k in range(0, len(out), _FRAME):
            yield pd.DataFrame(out[k : k + _FRAME], columns=self._columns)

    def _set_timer(self, micros: int) -> None:
        # A timer fires once the watermark is beyond it.
        wanted, given = micros // 1000 - 1, list(self._handle.listTimers())
        if not given or min(given) > wanted:
            for timer in given:
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(wanted)

    def _place(self, row: tuple) -> tuple[int, int]:
        return row[self._at], row[self._seq]

    def _plain(self, row: tuple) -> tuple:
        """Plain numbers, as Spark's state takes them."""
        return tuple(int(v) if k in (self._at, self._seq) else v for k, v in enumerate(row))
