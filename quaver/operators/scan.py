"""Rules that go along a song with a small state: sorted rows by song, in Arrow batches.

Each task has the rows of its songs in order and keeps one state, whatever a song's length; nothing
is gathered and no array is copied.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import pandas_udf


def scanned(rows: DataFrame, order: list[str], columns: list[str], step: Callable[[Any, tuple], tuple[Any, list[tuple]]], close: Callable[[Any], list[tuple]], schema: str) -> DataFrame:
    """What ``step`` gives for each row of rows, song by song in the given order.

    step(state, row) returns the next state, None at a song's first row, and any number of result
    rows; close(state) the last ones of a song. A row is (song_id, *columns); so are result rows by
    ``schema``. Songs without an id are one song.
    """
    own = rows.select("song_id", *columns, *[c for c in order if c not in ("song_id", *columns)])
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        song, state = object(), None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(1 + len(columns))), strict=True):
                if row[0] != song:
                    out += close(state) if state is not None else []
                    song, state = row[0], None
                state, found = step(state, row)
                out += found
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in close(state)], schema=arrow)

    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    arrow = pa.schema([(x.split()[0], types[x.split()[1]]) for x in schema.split(",")])
    return own.repartition("song_id").sortWithinPartitions("song_id", *order).mapInArrow(run, schema)


def repaired(t: np.ndarray, first: np.ndarray, last: int | None) -> np.ndarray:
    """Times in which none is before the last one: an earlier one is the last plus 1. ``first`` tells where
    a song begins; ``last`` is the last time of the song that the first rows belong to, if they go on with one.

    Only where a time is before the one above it anything changes, and from there until the times have
    caught up; the rest is left as it is.
    """
    out = t.copy()
    drops = np.flatnonzero((t[1:] < t[:-1]) & ~first[1:]) + 1
    if last is not None and len(t) and not first[0] and t[0] < last:
        drops = np.append(0, drops)
    done = 0
    for i in drops.tolist():
        if i < done:
            continue
        now = int(out[i - 1]) if i else last
        while i < len(t) and t[i] < now and not (first[i] and i):
            now += 1
            out[i] = now
            i += 1
        done = i
    return out


def monotone(rows: DataFrame, order: list[str], t: str, schema: str) -> DataFrame:
    """song_id, ordinal, t and its ``repaired`` time of rows, song by song in the given order; the state is the last time."""
    own = rows.select("song_id", "ordinal", t, *[c for c in order if c not in ("song_id", "ordinal", t)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        song, last = object(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            songs, times = batch.column(0), batch.column(2).to_numpy()
            # Songs without an id are one song, apart from song 0.
            none = songs.is_null().to_numpy(zero_copy_only=False)
            names = songs.fill_null(0).to_numpy()
            first = np.ones(len(times), bool)
            first[1:] = (names[1:] != names[:-1]) | (none[1:] != none[:-1])
            first[0] = songs[0].as_py() != song
            out = repaired(times, first, last)
            song, last = songs[-1].as_py(), int(out[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out)], ["song_id", "ordinal", t, "repaired"])

    return own.repartition("song_id").sortWithinPartitions("song_id", *order).mapInArrow(run, schema)


def tenth(x: float) -> float:
    return math.floor(x * 10 + 0.5) / 10


def segmenter(split: float, join: float):
    """step and close for tempo segments: the state is the open segment (first, start, n, total), the
    segment before it, which may still take it in, and the number of that."""

    def merged(song: Any, open_: tuple, kept: tuple | None, nth: int) -> tuple[tuple, int, list[tuple]]:
        _, start, n, total = open_
        bpm, ms = tenth(total / n), math.floor(start * 1000 + 0.5)
        if kept is None:
            return (bpm, ms), nth, []
        if abs(bpm - kept[0]) < join:
            return (tenth((kept[0] + bpm) / 2), kept[1]), nth, []
        return (bpm, ms), nth + 1, [(song, nth, *kept)]

    def step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        song, t, tempo = row
        fresh = (tenth(tempo), t, 1, tempo)
        if state is None:
            return (song, fresh, None, 0), []
        _, open_, kept, nth = state
        if abs(fresh[0] - open_[0]) <= split:
            return (song, (open_[0], open_[1], open_[2] + 1, open_[3] + tempo), kept, nth), []
        kept, nth, out = merged(song, open_, kept, nth)
        return (song, fresh, kept, nth), out

    def close(state: tuple) -> list[tuple]:
        song, open_, kept, nth = state
        kept, nth, out = merged(song, open_, kept, nth)
        return [*out, (song, nth, *kept)]

    return step, close


def along(kind: str, step: Callable[[Any, float], tuple[Any, list]], values: Column, *more: Column) -> Column:  # at most one more
    """An array of ``kind``: what step(state, value, *more) gives along an array; linear in its length."""

    def run(arrays: pd.Series, *rest: pd.Series) -> pd.Series:
        out = []
        for k, own in enumerate(arrays):
            state, found = None, []
            for x in () if own is None else own:
                state, some = step(state, x, *(r.iloc[k] for r in rest))
                found += some
            out.append(found if own is not None else None)
        return pd.Series(out)

    def one(arrays: pd.Series) -> pd.Series:
        return run(arrays)

    def two(arrays: pd.Series, other: pd.Series) -> pd.Series:
        return run(arrays, other)

    return pandas_udf(two if more else one, f"array<{kind}>")(values, *more)
