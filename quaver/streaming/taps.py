"""Tap-to-time as a stream with state: each key press times, or clears, the beat under its song's cursor.

A song's state is what its words are and which of their beats are set (a map by word, from a table at
first), the words of its beats and the beats that wait for a time (maps by beat) and its cursor. A
press reads and writes the few entries beside the cursor; a song is never loaded whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Kinds of words that stand between others, and the time a last line's end has after its beat.
SEPARATORS, TAIL_MS = ("space", "newline"), 500
OUTPUT = "song_id long, ordinal long, what string, word_idx long, syl_idx int, beat_idx long, t long"
WORD = "kind string, first_beat long, times array<long>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """State with maps and timers needs the store that is made for it."""
    spark.conf.set(PROVIDER, ROCKS)


def song_words(words: DataFrame) -> DataFrame:
    """song_id, word_idx, kind, first_beat, times, n_words, n_beats of words (song_id, word_idx from 0, kind,
    times: array of times of their syllables, null where unset). Syllables of sung words are beats, numbered
    along the song; first_beat is null for other words."""
    song = Window.partitionBy("song_id")
    n = F.when(F.col("kind") == "sung", F.size("times")).otherwise(0).cast("long")
    before = F.coalesce(F.sum(n).over(song.orderBy("word_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return words.select(
        "song_id",
        F.col("word_idx").cast("long").alias("word_idx"),
        "kind",
        F.when(F.col("kind") == "sung", before).alias("first_beat"),
        F.col("times").cast("array<bigint>").alias("times"),
        F.count(F.lit(1)).over(song).alias("n_words"),
        F.sum(n).over(song).alias("n_beats"),
    )


class Lines:
    """The rules of a press on any store of words: ``word(i)`` gives (kind, first_beat, times) or None,
    ``put(i, word)`` keeps it, ``owner(beat)`` is the word of a beat; n_words and n_beats are the song's."""

    def __init__(self, word, put, owner, n_words: int, n_beats: int):
        self.word, self.put, self.owner, self.n_words, self.n_beats = word, put, owner, n_words, n_beats

    def press(self, action: str, t: float | None, beat: int | None, cursor: int) -> tuple[int, list[tuple]]:
        """The cursor after an action (tap, clear, go) and the changes (what, word_idx, syl_idx, beat_idx, t):
        a beat's or a separator's time, or a beat that waits for one.

        A tap on a beat that is set, and a clear on one that isn't, only move the cursor; it stays
        within the song's beats.
        """
        if action == "go":
            return (beat if beat is not None and 0 <= beat < self.n_beats else cursor), []
        if not 0 <= cursor < self.n_beats:
            return cursor, []
        on = min(cursor + 1, self.n_beats - 1) if action == "tap" else max(cursor - 1, 0)
        at = self.owner(cursor)
        kind, first, times = self.word(at)
        syl = cursor - first
        if (times[syl] is not None) == (action == "tap"):
            return on, []
        now = math.floor(t + 0.5) if action == "tap" else None
        self.put(at, (kind, first, [*times[:syl], now, *times[syl + 1 :]]))
        return on, [("beat", at, syl, cursor, now), *self.beside(at)]

    def beside(self, at: int) -> Iterator[tuple]:
        """What a changed beat of word ``at`` means for the separators on both sides of that word."""
        for sep, left, right in ((at - 1, at - 2, at), (at + 1, at, at + 2)):
            mark = self.word(sep) if 0 <= sep < self.n_words else None
            if mark is None or mark[0] not in SEPARATORS or left < 0:
                continue
            one = self.word(left)
            if sep > at and mark[0] == "newline" and right >= self.n_words:
                if one[2][-1] is not None:
                    yield self.timed(sep, mark, one[2][-1] + TAIL_MS)
                continue
            other = self.word(right) if right < self.n_words else None
            if other is None or one[0] in SEPARATORS or other[0] in SEPARATORS:
                continue
            a, b = one[2][-1], other[2][0]
            if a is not None and b is not None:
                yield self.timed(sep, mark, (a + b) // 2)
            elif b is not None and sep < at and one[0] == "sung":
                yield "pending", left, len(one[2]) - 1, one[1] + len(one[2]) - 1, None
            elif a is not None and sep > at and other[0] == "sung":
                yield "pending", right, 0, other[1], None

    def timed(self, sep: int, mark: tuple, t: int) -> tuple:
        self.put(sep, (mark[0], mark[1], [t]))
        return "separator", sep, 0, None, t


class Taps(StatefulProcessor):
    """A song's words, beats and pending beats as map state, its cursor as value state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.words = handle.getMapState("words", "word_idx long", WORD)
        self.beats = handle.getMapState("beats", "beat_idx long", "word_idx long")
        self.pending = handle.getMapState("pending", "beat_idx long", "ordinal long")
        self.at = handle.getValueState("at", "cursor long, n_words long, n_beats long")

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        r = initialState
        self.words.updateValue((r.word_idx,), (r.kind, r.first_beat, list(r.times)))
        if r.first_beat is not None:
            for k in range(len(r.times)):
                self.beats.updateValue((r.first_beat + k,), (r.word_idx,))
        if not self.at.exists():
            self.at.update((0, r.n_words, r.n_beats))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        cursor, n_words, n_beats = self.at.get() if self.at.exists() else (0, 0, 0)
        word = lambda i: tuple(x) if (x := self.words.getValue((i,))) is not None else None
        lines = Lines(word, lambda i, w: self.words.updateValue((i,), w), lambda b: self.beats.getValue((b,))[0], n_words, n_beats)
        # A micro-batch's presses, by their time: there is no lateness.
        for r in sorted(rows, key=lambda r: (r.t, r.ordinal)):
            cursor, changed = lines.press(r.action, r.t + r.compensation, r.beat, cursor)
            for what, w, s, b, t in changed:
                if what == "pending":
                    if self.pending.containsKey((b,)):
                        continue
                    self.pending.updateValue((b,), (r.ordinal,))
                yield Row(song_id=key[0], ordinal=r.ordinal, what=what, word_idx=w, syl_idx=s, beat_idx=b, t=t)
        self.at.update((cursor, n_words, n_beats))

    def close(self) -> None:
        pass


def tap_stream(taps: DataFrame, words: DataFrame) -> DataFrame:
    """song_id, ordinal, what, word_idx, syl_idx, beat_idx, t: what a stream of presses changes.

    taps: song_id, ordinal, t (double, milliseconds of the playhead), compensation double, action (tap, clear or go), beat
    (long, where go leads; null otherwise). words: a table as ``song_words`` takes it, the state
    from which the stream starts. ``what`` is beat (t null: cleared), separator (its new time) or
    pending (a beat that now waits for a time; given once). Presses of a song without words change
    nothing. Presses by which a beat keeps its time are no rows.
    """
    keep_state(taps.sparkSession)
    start = song_words(words).groupBy("song_id")
    rows = taps.select("song_id", "ordinal", F.col("t").cast("double").alias("t"), F.col("compensation").cast("double").alias("compensation"), "action", F.col("beat").cast("long").alias("beat"))
    return rows.groupBy("song_id").transformWithState(Taps(), OUTPUT, "append", "None", start)


def words_of_beats(beats: DataFrame, kind: Column, t: Column, order: list[str]) -> DataFrame:
    """song_id, word_idx, kind, times of rows that are words of one syllable each, in an order."""
    idx = F.row_number().over(Window.partitionBy("song_id").orderBy(*order)) - 1
    return beats.select("song_id", idx.cast("long").alias("word_idx"), kind.alias("kind"), F.array(t.cast("long")).alias("times"))
