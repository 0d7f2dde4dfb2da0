"""Windows on an index watermark: late frames repair what was already solved instead of being dropped.

A window is ready when its view has seen a window ``lateness`` indexes later. Frames of a window that was already
emitted, up to ``horizon`` indexes back, emit it again with the next revision; frames beyond it are dropped. Event-time
watermarks drop late rows, so this is keyed state of its own; solving stays a stateless step behind it.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

@dataclass
class WindowBook:
    """What one view of a shard remembers: its highest index, and of each window the emitters' values, the last revision
    and the highest index when it was last solved. A window stays open to repairs until ``horizon`` indexes after that."""

    lateness: int
    horizon: int
    top: int = -1
    held: dict[int, dict[str, float]] = field(default_factory=dict)
    revision: dict[int, int] = field(default_factory=dict)
    solved: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        #: Windows that aren't solved yet and windows that are, each with the index at which something is due.
        self.waiting = [w for w in self.held if w not in self.revision]
        self.closing = [(at + self.horizon, w) for w, at in self.solved.items()]
        heapq.heapify(self.waiting)
        heapq.heapify(self.closing)

    def add(self, rows: Iterable[tuple[int, str, float]]) -> list[tuple[int, int, int, float]]:
        """(window, revision, emitters, total) of every window that these arrivals complete or repair, in order."""
        out: list[tuple[int, int, int, float]] = []
        for w, emitter, value in rows:
            if w not in self.held:
                if self.top - w > self.horizon:  # never seen, or closed
                    continue
                self.held[w] = {}
                heapq.heappush(self.waiting, w)
            window = self.held[w]
            if emitter in window:  # a repeated delivery changes nothing
                continue
            window[emitter] = value
            self.top = max(self.top, w)
            due = [w] if w in self.revision else []
            while self.waiting and self.top - self.waiting[0] >= self.lateness:
                due.append(heapq.heappop(self.waiting))
            for k in sorted(due):
                self.revision[k] = self.revision.get(k, -1) + 1
                self.solved[k] = self.top
                heapq.heappush(self.closing, (self.top + self.horizon, k))
                out.append((k, self.revision[k], len(self.held[k]), float(sum(self.held[k].values()))))
            while self.closing and self.closing[0][0] < self.top:
                _, k = heapq.heappop(self.closing)
                if k in self.solved and self.solved[k] + self.horizon < self.top:  # not solved again since
                    del self.held[k], self.revision[k], self.solved[k]
        return out

    def state(self) -> tuple[int, list[int], list[list[str]], list[list[float]], list[int], list[int]]:
        ws = sorted(self.held)
        return self.top, ws, [list(self.held[w]) for w in ws], [list(self.held[w].values()) for w in ws], [self.revision.get(w, -1) for w in ws], [self.solved.get(w, -1) for w in ws]

    @classmethod
    def of(cls, lateness: int, horizon: int, state: tuple | None) -> WindowBook:
        if state is None:
            return cls(lateness, horizon)
        top, ws, names, values, revisions, solved = state
        return cls(
            lateness, horizon, top, {w: dict(zip(n, v, strict=True)) for w, n, v in zip(ws, names, values, strict=True)},
            {w: r for w, r in zip(ws, revisions, strict=True) if r >= 0}, {w: at for w, at, r in zip(ws, solved, revisions, strict=True) if r >= 0},
        )


def _keys(frames: DataFrame) -> list[str]:
    """A shard's views are apart where the frames say their shard."""
    return [c for c in ("shard", "view") if c in frames.columns]


def _schema(frames: DataFrame, rest: str) -> str:
    kinds = dict(frames.dtypes)
    return ", ".join([*(f"{c} {kinds[c]}" for c in _keys(frames)), rest])


_REVISED = "w long, revision int, coverage int, total double"


def revised_windows(frames: DataFrame, *, lateness: int = 1, horizon: int = 6, idle: str | None = None) -> DataFrame:
    """(shard, view, w, revision, coverage, total) of a stream of (shard, view, w, emitter, value); the shard may be left
    out; ``update`` mode. The sink keeps the highest revision of each window. ``idle`` drops a view's state after a
    silence of processing time."""
    keys = _keys(frames)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        book = WindowBook.of(lateness, horizon, state.get if state.exists else None)
        rows = [(int(w), e, float(v)) for pdf in batches for w, e, v in zip(pdf["w"], pdf["emitter"], pdf["value"], strict=True)]
        out = book.add(rows)
        state.update(book.state())
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame([(*key, *o) for o in out], columns=[*keys, "w", "revision", "coverage", "total"])

    kept = "top long, ws array<long>, names array<array<string>>, vals array<array<double>>, revisions array<int>, solved array<long>"
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return frames.groupBy(*keys).applyInPandasWithState(run, _schema(frames, _REVISED), kept, "update", timeout)


def replayed(frames: DataFrame, *, lateness: int = 1, horizon: int = 6) -> DataFrame:
    """The same over a finished log in order of ``arrival``: a batch form to test streams against."""
    keys = _keys(frames)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("arrival")
        out = WindowBook(lateness, horizon).add([(int(w), e, float(v)) for w, e, v in zip(pdf["w"], pdf["emitter"], pdf["value"], strict=True)])
        return pd.DataFrame([(*key, *o) for o in out], columns=[*keys, "w", "revision", "coverage", "total"])

    return frames.groupBy(*keys).applyInPandas(run, _schema(frames, _REVISED))


@dataclass
class Ownership:
    """Which emitters claim each series of a view, until they release it or fall silent."""

    ttl: int
    owners: dict[int, dict[str, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.expiring = [(seen, series, e) for series, claims in self.owners.items() for e, seen in claims.items()]
        heapq.heapify(self.expiring)

    def add(self, rows: Iterable[tuple[int, str, int, bool]]) -> list[tuple[int, int]]:
        """Rows are (window, emitter, series, released). (series, window) of each series that its last owner left."""
        out = []

        def left(series: int, emitter: str, w: int) -> None:
            del self.owners[series][emitter]
            if not self.owners[series]:
                del self.owners[series]
                out.append((series, w))

        for w, emitter, series, released in rows:
            if released:
                if emitter in self.owners.get(series, ()):
                    left(series, emitter, w)
            else:
                self.owners.setdefault(series, {})[emitter] = w
                heapq.heappush(self.expiring, (w, series, emitter))
            while self.expiring and w - self.expiring[0][0] >= self.ttl:
                seen, s, e = heapq.heappop(self.expiring)
                if self.owners.get(s, {}).get(e) == seen:  # not claimed again since
                    left(s, e, w)
        return out


def absences(claims: DataFrame, *, ttl: int = 9, idle: str | None = None) -> DataFrame:
    """(shard, view, series, w) when a series of a stream (shard, view, w, emitter, series, released) has no owner left;
    the shard may be left out."""
    keys = _keys(claims)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ids, names, seen = state.get if state.exists else ([], [], [])
        book = Ownership(ttl, {i: dict(zip(n, s, strict=True)) for i, n, s in zip(ids, names, seen, strict=True)})
        rows = [r for pdf in batches for r in pdf[["w", "emitter", "series", "released"]].itertuples(index=False, name=None)]
        out = book.add(rows)
        ids = sorted(book.owners)
        state.update((ids, [list(book.owners[i]) for i in ids], [[int(x) for x in book.owners[i].values()] for i in ids]))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame([(*key, *o) for o in out], columns=[*keys, "series", "w"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return claims.groupBy(*keys).applyInPandasWithState(run, _schema(claims, "series long, w long"), "ids array<long>, names array<array<string>>, seen array<array<long>>", "append", timeout)


def fan_in(*streams: DataFrame) -> DataFrame:
    """One stream of several sources of the same columns."""
    return functools.reduce(DataFrame.unionByName, streams)
