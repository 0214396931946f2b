"""Signals in array columns: peaks, frame energy, a noise gate and sums of stems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.functions.arrays import let
from quaver.operators.scan import along


def _whole(x: Column) -> Column:
    return F.floor(x).cast("int")


def peaks(samples: Column, width: int) -> Column:
    """``width`` values: the greatest magnitude of each bucket of floor(n / width) samples, over the
    greatest of all buckets. The rest of the samples is left out; silence stays 0, and so do
    buckets beyond the samples if there are fewer samples than buckets."""
    step = _whole(F.size(samples) / width)
    bucket = lambda i: F.coalesce(F.array_max(F.transform(F.slice(samples, i * step + 1, step), lambda x: F.abs(x).cast("double"))), F.lit(0.0))
    raw = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), bucket)
    scaled = lambda p: F.transform(p["raw"], lambda x: F.when(p["most"] > 0, x / p["most"]).otherwise(0.0))
    return let(raw, lambda r: let(F.struct(r.alias("raw"), F.array_max(r).alias("most")), scaled))


def frame_count(samples: Column, frame: int, hop: int) -> Column:
    return F.greatest(F.lit(1), _whole((F.size(samples) - frame) / hop) + 1)


def frame_rms(samples: Column, frame: int, hop: int) -> Column:
    """The root mean square of each frame; 0 for an empty one."""

    def rms(f: Column) -> Column:
        part = F.slice(samples, f * hop + 1, frame)
        total = F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        return F.when(F.size(part) == 0, 0.0).otherwise(F.sqrt(total / F.size(part)))

    return F.transform(F.sequence(F.lit(0), frame_count(samples, frame, hop) - 1), rms)


def linear_percentile(values: Column, percent: Column) -> Column:
    """The percentile of an array, between neighbours by their distance."""
    v = F.array_sort(values)
    at = (F.size(v) - 1) * percent / 100.0
    low = F.floor(at).cast("int")
    below, above = F.get(v, low), F.get(v, F.least(low + 1, F.size(v) - 1))
    return below + (above - below) * (at - low)


def gate_levels(rms: Column, threshold: Column, attack: float = 0.6, release: float = 0.08) -> Column:
    """Smoothed gain of each frame: shut at the threshold, open at one and a half times it."""
    def step(last: float | None, x: float, shut: float) -> tuple[float, list[float]]:
        r, prev = x / max(shut, 1e-9), last or 0.0
        goal = 0.0 if r <= 1 else min(1.0, (r - 1) / 0.5)
        now = prev + (goal - prev) * (attack if goal > prev else release)
        return now, [now]

    return along("double", step, rms, threshold)


def gated(signals: DataFrame, percent: float, frame: int, hop: int, samples: str = "samples") -> DataFrame:
    """signals with ``cleaned``: quiet frames turned down. A sample in two frames gets both gains.

    A percent of 0 or less, or an empty signal, changes nothing; 40 is the most.
    """
    n = F.size(samples)
    rows = signals.withColumn("rms_", frame_rms(F.col(samples), frame, hop))
    rows = rows.withColumn("thr_", linear_percentile(F.col("rms_"), F.lit(min(max(percent, 0.0), 40.0))))
    rows = rows.withColumn("gain_", gate_levels(F.col("rms_"), F.col("thr_")))

    def scaled(x: Column, i: Column) -> Column:
        first = F.greatest(F.lit(0), F.ceil((i - frame + 1) / hop).cast("int"))
        last = F.least(F.size("gain_") - 1, _whole(i / hop))
        own = F.when(last >= first, F.slice("gain_", first + 1, last - first + 1)).otherwise(F.array().cast("array<double>"))
        return F.aggregate(own, x.cast("double"), lambda a, g: a * g)

    plain = F.transform(samples, lambda x: x.cast("double"))
    out = F.when((F.lit(percent) <= 0) | (n == 0), plain).otherwise(F.transform(samples, scaled))
    return rows.withColumn("cleaned", out).drop("rms_", "thr_", "gain_")


def mixed(stems: DataFrame, keys: list[str], samples: str = "samples") -> DataFrame:
    """keys and the sum of their stems, sample by sample; shorter stems count as silence.

    Stems are exploded, so that the sum is a partial aggregation however many stems a key has.
    """
    rows = stems.select(*keys, F.posexplode(samples).alias("i", "x"))
    total = rows.groupBy(*keys, "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])
    return total.groupBy(*keys).agg(ordered.alias("mix"))


def zigzag(values: Column, first: int, count: int) -> Column:
    """A visible slice of peaks as a path: odd places are drawn downwards."""
    return F.transform(F.slice(values, first + 1, count), lambda x, i: F.when(i % 2 == 0, x).otherwise(F.lit(0.0) - x))
