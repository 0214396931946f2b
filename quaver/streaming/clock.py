"""The playhead as a stream: timers in state emit a song's beats as its clock passes them.

The clock is the stream's event time (its watermark), so a table of events replays exactly as it ran. A song's
state is its playhead (playing or not, from where, since when, how fast), its length and its sorted
beats by number; one timer waits for the next beat or for the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quaver.streaming.taps import keep_state

#: Fixed value: playing ends so long before a song's length.
END_MS = 10
OUTPUT = "song_id long, what string, beat_idx long, t long, at long"


class Playhead:
    """The rules of the clock: a playhead (playing, place in ms, since when, speed, next beat) moved to any
    moment. ``beat(i)`` is the time of the i-th of n beats, ``first(t)`` the number of the first at or after t."""

    def __init__(self, beat, first, duration: int, state: tuple):
        self.beat, self.first, self.duration = beat, first, duration
        self.playing, self.place, self.since, self.speed, self.next = state

    @property
    def state(self) -> tuple:
        return self.playing, self.place, self.since, self.speed, self.next

    def due(self) -> int | None:
        """When the next beat or the end comes, in whole milliseconds of the clock; None while it stands."""
        if not self.playing:
            return None
        t, end = self.beat(self.next), self.duration - END_MS
        return math.ceil(self.since + (min(t if t is not None else end, end) - self.place) / self.speed)

    def until(self, now: int) -> Iterator[tuple]:
        """(what, beat_idx, t, at) of the beats, or the end, that come by ``now``."""
        while (at := self.due()) is not None and at <= now:
            t = self.beat(self.next)
            if t is None or t >= self.duration - END_MS:
                self.playing, self.place, self.since = False, float(self.duration), at
                yield "end", None, self.duration, at
            else:
                yield "beat", self.next, t, at
                self.next += 1

    def act(self, action: str, now: int, place: float | None, speed: float | None) -> None:
        """play (from a place, if one is given), pause or seek; anything else changes nothing."""
        if action not in ("play", "pause", "seek"):
            return
        here = min(self.place + (now - self.since) * self.speed, self.duration) if self.playing else self.place
        here = min(max(place, 0.0), float(self.duration)) if place is not None and action != "pause" else here
        self.playing = action == "play" or (action == "seek" and self.playing)
        self.speed = speed if speed else self.speed
        if action != "pause" and place is not None or action == "play":
            self.next = self.first(here)
        self.place, self.since = here, now


class Clock(StatefulProcessor):
    """Beats as map state by number, the playhead as value state, one timer a song."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beats = handle.getMapState("beats", "beat_idx long", "t long")
        self.song = handle.getValueState("song", "duration long, n_beats long")
        self.head = handle.getValueState("head", "playing boolean, place double, since long, speed double, next long")

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        r = initialState
        if r.beat_idx is not None:
            self.beats.updateValue((r.beat_idx,), (r.t,))
        if not self.song.exists():
            self.song.update((r.duration, r.n_beats))

    def playhead(self) -> Playhead:
        duration, n = self.song.get() if self.song.exists() else (0, 0)
        beat = lambda i: self.beats.getValue((i,))[0] if i < n else None

        def first(t: float) -> int:
            low, high = 0, n
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if beat(mid) < t else (low, mid)
            return low

        return Playhead(beat, first, duration, self.head.get() if self.head.exists() else (False, 0.0, 0, 1.0, 0))

    def kept(self, key: Any, head: Playhead, found: list[tuple]) -> Iterator[Row]:
        self.head.update(head.state)
        for x in list(self.handle.listTimers()):
            self.handle.deleteTimer(x)
        if (at := head.due()) is not None:
            self.handle.registerTimer(at)
        for what, i, t, at in found:
            yield Row(song_id=key[0], what=what, beat_idx=i, t=t, at=at)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        head, found = self.playhead(), []
        for r in sorted(rows, key=lambda r: (r.ms, r.ordinal)):
            found += head.until(r.ms)
            head.act(r.action, r.ms, r.place, r.speed)
        yield from self.kept(key, head, found)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        head = self.playhead()
        yield from self.kept(key, head, list(head.until(timerValues.getCurrentWatermarkInMs())))

    def close(self) -> None:
        pass


def timed(beats: DataFrame, songs: DataFrame) -> DataFrame:
    """song_id, beat_idx, t, duration, n_beats: a song's set beats (song_id, t, ordinal) by their time, with its
    duration from songs (song_id, duration in ms). A song without beats is one row without a beat."""
    set_ = beats.where("t is not null").select("song_id", F.col("t").cast("long").alias("t"), "ordinal")
    order = Window.partitionBy("song_id").orderBy("t", "ordinal")
    numbered = set_.select("song_id", (F.row_number().over(order) - 1).cast("long").alias("beat_idx"), "t")
    return songs.select("song_id", F.col("duration").cast("long").alias("duration")).join(numbered, "song_id", "left").withColumn("n_beats", F.count("beat_idx").over(Window.partitionBy("song_id")))


def clock_stream(events: DataFrame, beats: DataFrame, songs: DataFrame, late: str = "0 seconds") -> DataFrame:
    """song_id, what (beat or end), beat_idx, t, at: each beat when the playhead passes it, in whole
    milliseconds of the clock, and the end of a song 10 ms before its duration.

    events: song_id, ordinal, at (timestamp), action (play, pause, seek; others, as ``tick``, only let the clock go
    on), place (double, ms; where play and seek begin, null: where it stands) and speed (double, null: as
    before). beats and songs as ``timed`` takes them. The clock is the watermark of ``at``, less ``late``.
    """
    keep_state(events.sparkSession)
    rows = events.withWatermark("at", late).select("song_id", "ordinal", "at", F.unix_millis("at").alias("ms"), "action", "place", "speed")
    return rows.groupBy("song_id").transformWithState(Clock(), OUTPUT, "append", "EventTime", timed(beats, songs).groupBy("song_id"))
