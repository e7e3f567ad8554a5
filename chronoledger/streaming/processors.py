"""Keyed state as transformWithState processors: pending invocations, cumulative
counters, first sightings with a grace period, invocation windows, and what is open.

The rows that a key has in one micro-batch are sorted together, so they are held
together: the stream's trigger limits (files or offsets a batch) bound them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class PairInvocations(StatefulProcessor):
    """Ends take the start pending in their session: rows (session_id, seq,
    is_start) to (session_id, seq, paired_with)."""

    SCHEMA = "session_id string, seq long, paired_with long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getValueState("pending", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values("seq")
        start = self.pending.get()[0] if self.pending.exists() else None
        out = []
        for r in every.itertuples():
            if r.is_start:
                start, paired = r.seq, None
            else:
                start, paired = None, start
            out.append((key[0], r.seq, paired))
        if start is None:
            self.pending.clear()
        else:
            self.pending.update((int(start),))
        frame = pd.DataFrame(out, columns=["session_id", "seq", "paired_with"])
        frame["paired_with"] = frame["paired_with"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


class CounterDeltas(StatefulProcessor):
    """Increases of a cumulative counter with resets: rows (key, seq, value) to
    (key, seq, delta, reset); repeated values give nothing."""

    SCHEMA = "key string, seq long, delta double, reset boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if r.value == last:
                continue
            reset = last is not None and r.value < last
            out.append((key[0], r.seq, r.value if reset else r.value - (last or 0.0), reset))
            last = r.value
        if last is not None:
            self.last.update((float(last),))
        yield pd.DataFrame(out, columns=["key", "seq", "delta", "reset"])

    def close(self) -> None:
        pass


class GraceSightings(StatefulProcessor):
    """Subjects that stay absent: rows (subject, at, absent) to (subject,
    first_seen, at), once, when a subject is absent `grace` seconds or more after
    it was first seen so.  A row that says it is there forgets the sighting."""

    SCHEMA = "subject string, first_seen double, at double"

    def __init__(self, grace: float):
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "first double, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        first, told = self.seen.get() if self.seen.exists() else (None, False)
        out = []
        for r in pd.concat(list(rows)).sort_values("at").itertuples():
            if not r.absent:
                first, told = None, False
                continue
            first = r.at if first is None else first
            if not told and r.at - first >= self.grace:
                out.append((key[0], float(first), float(r.at)))
                told = True
        if first is None:
            self.seen.clear()
        else:
            self.seen.update((float(first), bool(told)))
        yield pd.DataFrame(out, columns=["subject", "first_seen", "at"])

    def close(self) -> None:
        pass


class KeepWindows(StatefulProcessor):
    """The newest windows of each session: rows (session_id, invocation_id,
    started_at, ended_at), starts without an end, to the windows that changed.
    An end closes its invocation's window; beyond `keep` the oldest go."""

    SCHEMA = "session_id string, invocation_id string, started_at double, ended_at double"

    def __init__(self, keep: int = 32):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getListState("windows", "invocation_id string, started_at double, ended_at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        none = lambda x: None if x is None or pd.isna(x) else float(x)
        held = {w[0]: (w[1], none(w[2])) for w in self.windows.get()}
        before = dict(held)
        for r in pd.concat(list(rows)).itertuples():
            start, end = held.get(r.invocation_id, (none(r.started_at), None))
            held[r.invocation_id] = (none(r.started_at) if start is None else start, none(r.ended_at) if end is None else end)
        newest = sorted(held.items(), key=lambda w: (w[1][0] is not None, w[1][0] or 0.0, w[0]))[-self.keep :]
        self.windows.put([(name, start, end) for name, (start, end) in newest])
        out = [(key[0], name, *w) for name, w in newest if before.get(name) != w]
        yield pd.DataFrame(out, columns=["session_id", "invocation_id", "started_at", "ended_at"]).astype({"started_at": "float64", "ended_at": "float64"})

    def close(self) -> None:
        pass


class OpenSubjects(StatefulProcessor):
    """Sessions or runs that are open: rows (subject, at, open) to (subject,
    opened_at, closed_at) when one closes.  What is open again and again opened
    at its first time; a close of what is not open is passed over."""

    SCHEMA = "subject string, opened_at double, closed_at double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.since = handle.getValueState("since", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        since = self.since.get()[0] if self.since.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("at").itertuples():
            if r.open:
                since = r.at if since is None else since
            elif since is not None:
                out.append((key[0], float(since), float(r.at)))
                since = None
        if since is None:
            self.since.clear()
        else:
            self.since.update((float(since),))
        yield pd.DataFrame(out, columns=["subject", "opened_at", "closed_at"])

    def close(self) -> None:
        pass


def run_stateful(stream: DataFrame, key: str, processor: StatefulProcessor) -> DataFrame:
    """`processor` over `stream` keyed by `key`; needs the RocksDB state store."""
    return stream.groupBy(key).transformWithStateInPandas(processor, outputStructType=processor.SCHEMA, outputMode="Append", timeMode="None")
