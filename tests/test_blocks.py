"""Signals in blocks against plain numpy, at any block length, and exact order statistics."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver.operators import blocks, rank, tempo


def signals(spark, songs):
    return spark.createDataFrame([(k, [float(v) for v in x] if x is not None else None) for k, x in songs.items()], "song_id long, samples array<double>")


def noise(seed, n):
    r = np.random.default_rng(seed)
    return np.round(r.normal(size=n) * np.repeat(r.random(n // 50 + 1), 50)[:n], 6)


SONGS = {1: noise(1, 1000), 2: noise(2, 37), 3: np.zeros(0), 4: None, 5: np.zeros(64), 6: noise(6, 641)}


def plain_rms(x, frame, hop):
    n = max(1, (len(x) - frame) // hop + 1)
    parts = [x[f * hop : f * hop + frame] for f in range(n)]
    return [float(np.sqrt(np.mean(p * p))) if len(p) else 0.0 for p in parts]


def plain_gated(x, percent, frame, hop):
    rms = np.array(plain_rms(x, frame, hop))
    shut = np.percentile(rms, percent)
    out, last = x.copy(), 0.0
    for f, r in enumerate(rms / max(shut, 1e-9)):
        goal = 0.0 if r <= 1 else min(1.0, (r - 1) / 0.5)
        last += (goal - last) * (0.6 if goal > last else 0.08)
        out[f * hop : f * hop + frame] *= last
    return out


def plain_flux(x, frame, hop):
    n = max(1, (len(x) - frame) // hop + 1)
    x = np.pad(x, (0, max(0, (n - 1) * hop + frame - len(x))))
    shape = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)
    level = [np.abs(np.fft.rfft(x[f * hop : f * hop + frame] * shape)) for f in range(n)]
    return [0.0, *(float(np.maximum(b - a, 0).sum()) for a, b in zip(level, level[1:], strict=False))]


@pytest.mark.parametrize("size", [1, 7, 64, 5000])
def test_blocks_of_any_length_equal_whole_signals(spark, size):
    own = blocks.blocked(signals(spark, SONGS), size).repartition(3)
    whole = {k: np.asarray(x if x is not None else []) for k, x in SONGS.items()}
    assert own.groupBy("song_id").agg(F.sum(F.size("samples")).alias("n")).where("n is null").count() == 0
    got = {(r.song_id, r.bucket): r.peak for r in blocks.peaks(own, 10).collect()}
    for k, x in whole.items():
        step = len(x) // 10
        raw = [max(np.abs(x[b * step : (b + 1) * step]), default=0.0) for b in range(10)]
        assert [got[k, b] for b in range(10)] == [v / max(raw) if max(raw) else 0.0 for v in raw]
    for frame, hop in ((16, 8), (20, 7), (8, 12)):
        rms = {(r.song_id, r.frame): r.rms for r in blocks.frame_rms(own, frame, hop).collect()}
        assert rms.keys() == {(k, f) for k, x in whole.items() for f in range(len(plain_rms(x, frame, hop)))}
        assert all(math.isclose(rms[k, f], v, abs_tol=1e-12) for k, x in whole.items() for f, v in enumerate(plain_rms(x, frame, hop)))
    cleaned = {(r.song_id, r.first): r.samples for r in blocks.gated(own, 20.0, 16, 8).collect()}
    for k, x in whole.items():
        parts = [cleaned[k, f] for f in sorted(f for s, f in cleaned if s == k)]
        assert np.allclose([v for p in parts for v in p], plain_gated(x, 20.0, 16, 8), atol=1e-12)
    assert blocks.gated(own, 0.0, 16, 8).agg(F.sum(F.size("samples"))).first()[0] == sum(map(len, whole.values()))


@pytest.mark.parametrize(("size", "together"), [(5, 1), (64, 3), (5000, 64)])
def test_flux_of_frames_across_blocks(spark, size, together):
    own = blocks.blocked(signals(spark, SONGS), size)
    got = {(r.song_id, r.frame): r.flux for r in blocks.spectral_flux(own, 32, 8, together).collect()}
    want = {(k, f): v for k, x in SONGS.items() if x is not None and len(x) for f, v in enumerate(plain_flux(x, 32, 8))}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-9) for k, v in want.items())


def clicks(rate, times, seconds):
    x = np.zeros(int(rate * seconds))
    for t in times:
        at = int(t * rate)
        x[at : at + 40] += np.hanning(40)[: len(x) - at] * np.where(np.arange(40)[: len(x) - at] % 2, -1, 1)
    return x


def test_planted_clicks_and_their_tempo(spark):
    """120 beats a minute, then 160: onsets within a hop, one tempo segment each."""
    rate, hop = 4000, 64
    times = [*np.arange(0.5, 30, 60 / 120), *np.arange(30.1, 60, 60 / 160)]
    own = blocks.blocked(signals(spark, {1: clicks(rate, times, 60), 2: np.zeros(rate * 20)}), 10_000)
    flux = blocks.spectral_flux(own, 256, hop)
    found = blocks.onsets(flux, rate, hop, wait=3).orderBy("ordinal").collect()
    assert [r.ordinal for r in found] == list(range(len(times)))
    assert all(r.song_id == 1 and -1000 * 256 / rate <= r.t - 1000 * t <= 1000 * hop / rate for r, t in zip(found, times, strict=True))
    curve = blocks.tempo_curve(flux, rate, hop)
    assert curve.where("song_id = 2").isEmpty()
    rows = {r.t_s: r.tempo for r in curve.collect()}
    assert all(abs(v - 120) < 2 for t, v in rows.items() if t < 20) and all(abs(v - 160) < 3 for t, v in rows.items() if 32 < t < 54)
    segments = [r.bpm for r in tempo.segments(curve).orderBy("seg_idx").collect()]
    assert abs(segments[0] - 120) < 2 and abs(segments[-1] - 160) < 4


def test_a_long_signal_in_blocks(spark):
    """A song of 3 million samples that no row holds."""
    n, size = 3_000_000, 1 << 16
    starts = spark.range(-(-n // size)).select(F.lit(1).cast("long").alias("song_id"), (F.col("id") * size).alias("first"), F.lit(n).cast("long").alias("total"))
    own = starts.withColumn("samples", F.transform(F.sequence(F.col("first"), F.least(F.col("first") + size, F.lit(n)) - 1), lambda i: F.sin(i / 50.0) * F.when(i % 400_000 < 100_000, 0.1).otherwise(1.0)))
    x = np.sin(np.arange(n) / 50.0) * np.where(np.arange(n) % 400_000 < 100_000, 0.1, 1.0)
    out = blocks.gated(own, 20.0, 512, 256, few=1000)
    assert math.isclose(out.select(F.explode("samples").alias("x")).agg(F.sum(F.abs("x"))).first()[0], np.abs(plain_gated(x, 20.0, 512, 256)).sum(), rel_tol=1e-9)
    assert out.agg(F.max(F.size("samples"))).first()[0] == size


@pytest.mark.parametrize(("few", "bins"), [(100_000, 4096), (20, 16), (1, 2)])
def test_order_statistics(spark, few, bins):
    r = random.Random(few)
    groups = {"a": [r.gauss(0, 1) for _ in range(500)], "b": [1.5] * 300, "c": [3.0], None: [r.choice([1.0, 2.0, 5.0]) for _ in range(99)], "d": [1e300, -1e300, 0.0, 1e-300] * 30}
    rows = [(k, v) for k, own in groups.items() for v in own] + [("a", None), ("a", float("nan")), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {(x.k, x.rank): x.v for x in rank.nth(df, ["k"], "v", lambda n: [F.lit(0), F.floor(n / 2), n - 1, n], few, bins).collect()}
    assert got == {(k, i): sorted(own)[i] for k, own in groups.items() for i in {0, len(own) // 2, len(own) - 1}}
    assert {x.k: x.v for x in rank.medians(df, ["k"], "v", few=few, bins=bins).collect()} == {k: sorted(own)[len(own) // 2] for k, own in groups.items()}
    share = {x.k: x.v for x in rank.percentiles(df, ["k"], "v", 35.0, few=few, bins=bins).collect()}
    assert share.keys() == groups.keys() and all(math.isclose(share[k], np.percentile(own, 35.0), rel_tol=1e-12, abs_tol=1e-300) for k, own in groups.items())


def test_a_hot_song_of_ticks(spark):
    """Half a million distances of one song, narrowed in rounds: no plan gathers or numbers them."""
    ticks = spark.range(500_001).select(F.lit(1).cast("long").alias("song_id"), F.col("id").alias("ordinal"), (F.col("id") * 400 + F.col("id") * 7919 % 113).alias("t"))
    found = tempo.bpm_of_ticks(ticks).first()
    t = np.sort(np.arange(500_001) * 400 + np.arange(500_001) * 7919 % 113)
    assert (found.n, found.bpm_median) == (500_001, math.floor(60000 / np.sort(np.diff(t))[250_000] + 0.5))
