"""Repair of times, batch by batch, against the plain rule."""

import random

import numpy as np

from quaver.operators import scan, timeline


def plain(times):
    out, last = [], None
    for t in times:
        last = last + 1 if last is not None and t < last else t
        out.append(last)
    return out


def test_repair_in_batches():
    r = random.Random(2)
    for _ in range(500):
        songs = [[r.randrange(12) for _ in range(r.randrange(1, 15))] for _ in range(r.randrange(1, 5))]
        t = np.array([x for own in songs for x in own])
        first = np.array([k == 0 for own in songs for k in range(len(own))])
        want, got, last, i = [x for own in songs for x in plain(own)], [], None, 0
        while i < len(t):
            j = min(len(t), i + r.randrange(1, 9))
            own = scan.repaired(t[i:j], first[i:j], last)
            got += own.tolist()
            last, i = int(own[-1]), j
        assert got == want


def test_monotone(spark):
    r = random.Random(3)
    rows = [(r.choice([None, 0, 1, 2]), i, r.choice([None, *range(30)])) for i in range(600)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = timeline.monotone(spark.createDataFrame(rows, "song_id long, ordinal long, t long").repartition(3), "t", ["ordinal"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for s in (None, 0, 1, 2):
        own = [(o, t) for k, o, t in rows if k == s and t is not None]
        want |= {(s, o): x for (o, _), x in zip(own, plain([t for _, t in own]), strict=True)}
    assert {(x.song_id, x.ordinal): x.repaired for x in out} == want
