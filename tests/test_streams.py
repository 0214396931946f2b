"""Streams with state against plain replays, over several micro-batches and a restart."""

import math
import random

import pytest

from quaver.streaming.clock import clock_stream
from quaver.streaming.taps import tap_stream

TAPS = "song_id long, ordinal long, t double, compensation double, action string, beat long"
EVENTS = "song_id long, ordinal long, at timestamp, action string, place double, speed double"


@pytest.fixture()
def store(spark):
    """The session's state store afterwards as before."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    yield
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_in_parts(spark, make, schema, parts, folder, restart):
    """Rows of a stream whose input comes a file at a time, stopped once before file ``restart``."""
    given = str(folder / "in")
    for k, rows in enumerate(parts):
        if k in (0, restart):
            own = parts[:restart] if k == 0 else parts[restart:]
            for own_rows in own:
                spark.createDataFrame(own_rows, schema).coalesce(1).write.mode("append").parquet(given)
            stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(given))
            q = stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start()
            assert q.awaitTermination(300)
    return [tuple(r) for r in spark.read.parquet(str(folder / "out")).collect()]


# --- taps -----------------------------------------------------------------------------------------


def plain_taps(words, taps):
    """The editor's rules on whole lists: words (kind, times)."""
    words = [(k, list(t)) for k, t in words]
    refs = [(w, s) for w, (k, t) in enumerate(words) if k == "sung" for s in range(len(t))]
    sep = lambda w: words[w][0] in ("space", "newline")
    cursor, pending, out = 0, set(), []

    def infer(ordinal, w):
        todo = []
        if w > 0 and sep(w - 1) and w >= 2 and not sep(w - 2):
            a, b = words[w - 2][1][-1], words[w][1][0]
            if a is not None and b is not None:
                words[w - 1][1][0] = (a + b) // 2
                out.append((ordinal, "separator", w - 1, 0, None, (a + b) // 2))
            elif b is not None:
                todo += [i for i, r in enumerate(refs) if r == (w - 2, len(words[w - 2][1]) - 1)]
        if w + 1 < len(words) and sep(w + 1):
            a = words[w][1][-1]
            if words[w + 1][0] == "newline" and w + 2 >= len(words):
                if a is not None:
                    words[w + 1][1][0] = a + 500
                    out.append((ordinal, "separator", w + 1, 0, None, a + 500))
            elif w + 2 < len(words) and not sep(w + 2):
                b = words[w + 2][1][0]
                if a is not None and b is not None:
                    words[w + 1][1][0] = (a + b) // 2
                    out.append((ordinal, "separator", w + 1, 0, None, (a + b) // 2))
                elif a is not None:
                    todo += [i for i, r in enumerate(refs) if r == (w + 2, 0)]
        for i in todo:
            if i not in pending:
                pending.add(i)
                out.append((ordinal, "pending", *refs[i], i, None))

    for ordinal, t, comp, action, beat in taps:
        if action == "go":
            cursor = beat if beat is not None and 0 <= beat < len(refs) else cursor
            continue
        if not refs:
            continue
        w, s = refs[cursor]
        was, is_set = cursor, words[w][1][s] is not None
        cursor = min(cursor + 1, len(refs) - 1) if action == "tap" else max(cursor - 1, 0)
        if is_set != (action == "tap"):
            words[w][1][s] = math.floor(t + comp + 0.5) if action == "tap" else None
            out.append((ordinal, "beat", w, s, was, words[w][1][s]))
            infer(ordinal, w)
    return out


def lyric(r):
    kinds = [r.choice(["sung", "sung", "space", "newline", "punctuation"]) for _ in range(r.randrange(1, 14))]
    return [(k, [r.choice([None, None, 50 * i + j]) if k in ("sung", "punctuation") else None for j in range(r.choice([1, 1, 2, 3]) if k == "sung" else 1)]) for i, k in enumerate(kinds)]


def test_taps_equal_a_replay_across_batches_and_a_restart(spark, tmp_path, store):
    r = random.Random(3)
    songs = {k: lyric(r) for k in range(1, 9)} | {9: [("space", [None])], 10: [("sung", [None]), ("newline", [None])]}
    taps = [(r.choice([*songs, 77]), i, 10.0 * i + r.random(), r.choice([0.0, -3.5, 2.0]), r.choice(["tap", "tap", "tap", "clear", "clear", "go"]), None) for i in range(320)]
    taps = [(*x[:5], r.randrange(-2, 12)) if x[4] == "go" else x for x in taps]
    words = spark.createDataFrame([(k, i, kind, t) for k, own in songs.items() for i, (kind, t) in enumerate(own)], "song_id long, word_idx long, kind string, times array<long>")
    parts = [r.sample(taps[k : k + 80], 80) for k in range(0, 320, 80)]
    got = run_in_parts(spark, lambda s: tap_stream(s, words), TAPS, parts, tmp_path, 2)
    want = [(k, *row) for k, own in songs.items() for row in plain_taps(own, [x[1:] for x in taps if x[0] == k])]
    assert len(want) > 60 and {x[2] for x in want} == {"beat", "separator", "pending"}
    assert sorted(got, key=repr) == sorted(want, key=repr)


# --- the clock ----------------------------------------------------------------------------------


def plain_clock(beats, duration, events, until):
    """Beats that a playhead passes, its place worked out anew between each two events."""
    beats = sorted(beats)
    out, playing, place, since, speed, nxt = [], False, 0.0, 0, 1.0, 0

    def play_to(now):
        nonlocal playing, place, since, nxt
        while playing:
            stop = duration - 10
            t = beats[nxt] if nxt < len(beats) and beats[nxt] < stop else None
            at = math.ceil(since + ((t if t is not None else stop) - place) / speed)
            if at > now:
                return
            if t is None:
                out.append(("end", None, duration, at))
                playing, place, since = False, float(duration), at
            else:
                out.append(("beat", nxt, t, at))
                nxt += 1

    for now, action, where, fast in events:
        play_to(now)
        here = min(place + (now - since) * speed, duration) if playing else place
        if where is not None and action in ("play", "seek"):
            here = min(max(where, 0.0), float(duration))
        if action == "tick":
            continue
        playing = action == "play" or (action == "seek" and playing)
        speed = fast or speed
        if action == "play" or (where is not None and action == "seek"):
            nxt = sum(b < here for b in beats)
        place, since = here, now
    play_to(until)
    return out


def test_clock_equals_a_replay(spark, tmp_path, store):
    import datetime

    r = random.Random(5)
    songs = {k: (sorted(r.randrange(0, 3000) for _ in range(r.randrange(0, 12))), r.choice([5, 900, 3000])) for k in range(1, 7)}
    start = 1_700_000_000_000
    events, now = [], start
    for i in range(90):
        now += r.randrange(1, 120)
        action = r.choice(["play", "play", "pause", "seek", "tick"])
        events.append((r.choice([*songs]), i, now, action, r.choice([None, float(r.randrange(-50, 3500))]) if action not in ("pause", "tick") else None, r.choice([None, 0.5, 1.0, 0.3])))
    # A song without words ticks on, so that the clock passes all that plays.
    last = now + 60_000
    ticks = [(99, 1000 + i, t, "play", None, None) for i, t in enumerate((last, last + 5_000, last + 10_000))]
    at = lambda ms: datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC)
    rows = [(k, i, at(ms), a, p, s) for k, i, ms, a, p, s in events]
    parts = [rows[:30], rows[30:60], rows[60:], *[[(k, i, at(ms), a, p, s)] for k, i, ms, a, p, s in ticks]]
    beats = spark.createDataFrame([(k, t, i) for k, (own, _) in songs.items() for i, t in enumerate(own)], "song_id long, t long, ordinal long")
    lengths = spark.createDataFrame([(k, d) for k, (_, d) in songs.items()], "song_id long, duration long")
    got = run_in_parts(spark, lambda s: clock_stream(s, beats, lengths), EVENTS, parts, tmp_path, 2)
    want = [(k, *x) for k, (own, d) in songs.items() for x in plain_clock(own, d, [e[2:] for e in events if e[0] == k], last)]
    assert {x[1] for x in want} == {"beat", "end"} and len(want) > 20
    assert sorted((x for x in got if x[0] != 99), key=repr) == sorted(want, key=repr)
