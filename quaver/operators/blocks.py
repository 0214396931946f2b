"""Signals of any length as rows of blocks: song_id, first, total, samples.

``first`` is the number of the song's samples before the block, ``total`` of all of them; blocks may have any
size. Whatever looks at samples gives partial results for each block that merge by a grouping (peaks,
energies), or takes rows of frames that blocks hand their samples to, so that frames across two blocks
are whole. No task holds more of a signal than some blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quaver.functions.timecode import half_up
from quaver.operators.rank import percentiles
from quaver.operators.scan import scanned

#: Samples of a block, and frames that are transformed together.
BLOCK, TOGETHER = 1 << 16, 64


def blocked(signals: DataFrame, size: int = BLOCK, samples: str = "samples") -> DataFrame:
    """Blocks of signals in array columns (song_id, samples); an empty or null one is a block without samples."""
    own = signals.select("song_id", F.coalesce(F.col(samples), F.array().cast(signals.schema[samples].dataType)).alias("whole_"))
    own = own.withColumn("total", F.size("whole_").cast("long"))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(size).cast("long")))
    return own.select("song_id", first.alias("first"), "total", "whole_").select("song_id", "first", "total", F.slice("whole_", F.col("first").cast("int") + 1, size).alias("samples"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Blocks of rows (song_id, samples) that lie in an order, where their places aren't known yet."""
    song = Window.partitionBy("song_id")
    n = F.coalesce(F.size("samples"), F.lit(0)).cast("long")
    before = F.sum(n).over(song.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("song_id", F.coalesce(before, F.lit(0)).alias("first"), F.sum(n).over(song).alias("total"), "samples")


def peaks(blocks: DataFrame, width: int) -> DataFrame:
    """song_id, bucket, peak: ``width`` buckets of floor(total / width) samples, the greatest magnitude of
    each over the greatest of all. Samples beyond them are left out; silence is 0, and so are all
    buckets of a song that has fewer samples than buckets."""
    step = F.floor(F.col("total") / width)
    least, last = F.floor(F.col("first") / step), F.floor((F.col("first") + F.size("samples") - 1) / step)
    own = blocks.where((step > 0) & (F.size("samples") > 0)).withColumn("step_", step)
    own = own.withColumn("from_", least.cast("int")).withColumn("to_", F.least(last, F.lit(width - 1)).cast("int")).where("from_ <= to_")

    def most(bucket: Column) -> Column:
        start = F.greatest(bucket * F.col("step_") - F.col("first"), F.lit(0))
        stop = F.least((bucket + 1) * F.col("step_") - F.col("first"), F.size("samples").cast("long"))
        part = F.slice("samples", (start + 1).cast("int"), (stop - start).cast("int"))
        return F.struct(bucket.alias("bucket"), F.array_max(F.transform(part, lambda x: F.abs(x).cast("double"))).alias("most"))

    parts = own.select("song_id", F.explode(F.transform(F.sequence("from_", "to_"), most)).alias("p")).select("song_id", "p.*")
    found = parts.groupBy("song_id", "bucket").agg(F.max("most").alias("most"))
    every = blocks.select("song_id").distinct().select("song_id", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("bucket"))
    merged = every.withColumn("most", F.lit(None).cast("double")).unionByName(found).groupBy("song_id", "bucket").agg(F.coalesce(F.max("most"), F.lit(0.0)).alias("most"))
    top = F.max("most").over(Window.partitionBy("song_id"))
    return merged.select("song_id", "bucket", F.when(top > 0, F.col("most") / top).otherwise(0.0).alias("peak"))


def visible(envelope: DataFrame, first: int, count: int) -> DataFrame:
    """song_id, bucket, y: the buckets of a view as a path; odd places are drawn downwards."""
    at = F.col("bucket") - first
    return envelope.where((at >= 0) & (at < count)).select("song_id", "bucket", F.when(at % 2 == 0, F.col("peak")).otherwise(F.lit(0.0) - F.col("peak")).alias("y"))


def n_frames(total: Column, frame: int, hop: int) -> Column:
    return F.greatest(F.lit(1), F.floor((total - frame) / hop) + 1).cast("long")


def _touched(frame: int, hop: int) -> tuple[Column, Column]:
    """The first and last frame that a block has samples of."""
    least = F.greatest(F.lit(0), F.ceil((F.col("first") - frame + 1) / hop)).cast("long")
    last = F.least(n_frames(F.col("total"), frame, hop) - 1, F.floor((F.col("first") + F.greatest(F.size("samples"), F.lit(1)) - 1) / hop)).cast("long")
    return least, last


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        yield np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)


def frame_rms(blocks: DataFrame, frame: int, hop: int) -> DataFrame:
    """song_id, frame, rms: the root mean square of each frame; 0 for an empty song's only one."""
    least, last = _touched(frame, hop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, power, n = [], [], [], []
            firsts, froms, tos = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for k, own in enumerate(_arrays(batch.column(4))):
                squares = own * own
                for f in range(froms[k], tos[k] + 1):
                    part = squares[max(f * hop - firsts[k], 0) : max(f * hop + frame - firsts[k], 0)]
                    row.append(k)
                    at.append(f)
                    power.append(float(part.sum()))
                    n.append(len(part))
            songs = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([songs, pa.array(at, pa.int64()), pa.array(power, pa.float64()), pa.array(n, pa.int64())], ["song_id", "frame", "power", "n"])

    own = blocks.select("song_id", "first", least.alias("from_"), last.alias("to_"), F.transform("samples", lambda x: x.cast("double")).alias("samples"))
    schema = blocks.select("song_id").schema.add("frame", "long").add("power", "double").add("n", "long")
    parts = own.mapInArrow(run, schema).groupBy("song_id", "frame").agg(F.sum("power").alias("power"), F.sum("n").alias("n"))
    return parts.select("song_id", "frame", F.when(F.col("n") == 0, 0.0).otherwise(F.sqrt(F.col("power") / F.col("n"))).alias("rms"))


def gate_gains(rms: DataFrame, percent: float, attack: float = 0.6, release: float = 0.08, **bounds: int) -> DataFrame:
    """song_id, frame, gain: shut at the percentile of the song's frames, open at one and a half times it,
    smoothed along the frames. The last gain is all that passes from frame to frame."""
    shut = percentiles(rms, ["song_id"], "rms", min(max(percent, 0.0), 40.0), **bounds).withColumnRenamed("rms", "shut")

    def step(last: float | None, row: tuple) -> tuple[float, list[tuple]]:
        song, frame, x, least = row
        r, before = x / max(least, 1e-9), last or 0.0
        goal = 0.0 if r <= 1 else min(1.0, (r - 1) / 0.5)
        now = before + (goal - before) * (attack if goal > before else release)
        return now, [(song, frame, now)]

    rows = rms.join(shut.withColumnRenamed("song_id", "key_"), F.col("song_id").eqNullSafe(F.col("key_"))).drop("key_")
    return scanned(rows, ["frame"], ["frame", "rms", "shut"], step, lambda _: [], "song_id long,frame long,gain double")


def gated(blocks: DataFrame, percent: float, frame: int, hop: int, **bounds: int) -> DataFrame:
    """blocks with quiet frames turned down; a sample in two frames gets both gains. A percent of 0 or less
    changes nothing, 40 is the most."""
    plain = blocks.withColumn("samples", F.transform("samples", lambda x: x.cast("double")))
    if percent <= 0:
        return plain
    gains = gate_gains(frame_rms(blocks, frame, hop), percent, **bounds)
    least, last = _touched(frame, hop)
    need = blocks.where(F.size("samples") > 0).select("song_id", "first", F.explode(F.sequence(least, last)).alias("frame"))
    # At most a block's length / hop gains, and those of the frames that reach into it.
    each = need.join(gains, ["song_id", "frame"]).groupBy("song_id", "first").agg(F.array_sort(F.collect_list(F.struct("frame", "gain"))).alias("gains_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            firsts, frames, gain = batch.column(1).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()
            for k, own in enumerate(_arrays(batch.column(3))):
                own = own.copy()
                for f, g in zip(frames[k] or (), gain[k] or (), strict=True):
                    own[max(f * hop - firsts[k], 0) : max(f * hop + frame - firsts[k], 0)] *= g
                out.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.float64()))], ["song_id", "first", "total", "samples"])

    rows = plain.select("song_id", "first", "total", "samples").join(each, ["song_id", "first"], "left")
    rows = rows.select("song_id", "first", "total", "samples", F.col("gains_.frame").alias("at"), F.col("gains_.gain").alias("gain"))
    return rows.mapInArrow(run, blocks.select("song_id", "first", "total").schema.add("samples", ArrayType(DoubleType())))


def framed(blocks: DataFrame, frame: int, hop: int, together: int = TOGETHER) -> DataFrame:
    """song_id, at, to, samples: rows of up to ``together`` whole frames, number ``at`` to ``to``, and the
    frame before them, whose samples blocks hand over; as many as their frames need, however long the song is."""
    frames = n_frames(F.col("total"), frame, hop)
    reach = F.lit(together * hop)
    # Row g begins a hop before its first frame and ends with its last one.
    least = F.greatest(F.lit(0), F.ceil((F.col("first") - (together - 1) * hop - frame + 1) / reach)).cast("long")
    last = F.least(F.floor((frames - 1) / together), F.floor((F.col("first") + F.size("samples") - 1 + hop) / reach)).cast("long")
    own = blocks.where(F.size("samples") > 0).withColumn("frames_", frames).withColumn("from_", least).withColumn("to_", last).where("from_ <= to_")
    rows = own.select("song_id", "first", "frames_", "samples", F.explode(F.sequence("from_", "to_")).alias("g"))
    begin = F.greatest(F.col("g") * reach - hop, F.lit(0))
    end = F.col("g") * reach + (together - 1) * hop + frame
    start = F.greatest(begin - F.col("first"), F.lit(0))
    stop = F.least(end - F.col("first"), F.size("samples").cast("long"))
    rows = rows.withColumn("start_", start).withColumn("n_", stop - start).where("n_ > 0")
    part = F.struct((F.col("first") + F.col("start_")).alias("first"), F.slice("samples", (F.col("start_") + 1).cast("int"), F.col("n_").cast("int")).alias("x"))
    whole = rows.groupBy("song_id", "g").agg(F.array_sort(F.collect_list(part)).alias("parts_"), F.max("frames_").alias("frames_"))
    at = F.col("g") * together
    samples = F.flatten(F.transform("parts_", lambda p: F.transform(p["x"], lambda x: x.cast("double"))))
    return whole.select("song_id", at.alias("at"), (F.least(at + together, F.col("frames_")) - 1).alias("to"), samples.alias("samples"))


def spectral_flux(blocks: DataFrame, frame: int = 2048, hop: int = 512, together: int = TOGETHER) -> DataFrame:
    """song_id, frame, flux: how much the magnitudes of a frame's spectrum (under a Hann window) have grown
    since the frame before, summed over its frequencies; 0 for the first one. A song of fewer samples
    than a frame has one frame."""
    shape = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, flux = [], [], []
            froms, tos = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for k, own in enumerate(_arrays(batch.column(3))):
                before = int(froms[k] > 0)
                n = tos[k] - froms[k] + 1 + before
                own = np.pad(own, (0, max(0, (n - 1) * hop + frame - len(own))))
                whole = np.lib.stride_tricks.sliding_window_view(own, frame)[: (n - 1) * hop + 1 : hop]
                level = np.abs(np.fft.rfft(whole * shape, axis=1))
                grown = np.maximum(np.diff(level, axis=0), 0).sum(axis=1)
                found = grown if before else np.concatenate([[0.0], grown])
                row += [k] * len(found)
                at += range(froms[k], tos[k] + 1)
                flux += found.tolist()
            songs = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([songs, pa.array(at, pa.int64()), pa.array(flux, pa.float64())], ["song_id", "frame", "flux"])

    schema = blocks.select("song_id").schema.add("frame", "long").add("flux", "double")
    return framed(blocks, frame, hop, together).mapInArrow(run, schema)


def onsets(flux: DataFrame, rate: float, hop: int = 512, delta: float = 0.5, wait: int = 6, near: int = 3, around: int = 10) -> DataFrame:
    """song_id, ordinal, frame, t (milliseconds) of a song's onsets: frames whose flux, over the greatest of the song, is the
    greatest within ``near`` frames and ``delta`` above the mean within ``around``; one that comes within
    ``wait`` frames of the last onset is left out. ``rate`` is the number of samples a second."""
    song = Window.partitionBy("song_id")
    order = song.orderBy("frame")
    x = F.col("flux") / F.max("flux").over(song)
    rows = flux.withColumn("x_", F.when(F.max("flux").over(song) > 0, x).otherwise(0.0))
    top, mean = F.max("x_").over(order.rowsBetween(-near, near)), F.avg("x_").over(order.rowsBetween(-around, around))
    rows = rows.withColumn("top_", top).withColumn("mean_", mean).where("x_ > 0 and x_ = top_").where(F.col("x_") >= F.col("mean_") + delta)

    def step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        nth, last = state or (0, None)
        if last is not None and row[1] - last <= wait:
            return (nth, last), []
        return (nth + 1, row[1]), [(row[0], nth, row[1])]

    found = scanned(rows, ["frame"], ["frame"], step, lambda _: [], "song_id long,ordinal long,frame long")
    return found.withColumn("t", half_up(F.col("frame") * F.lit(hop * 1000.0 / rate)))


def tempo_curve(flux: DataFrame, rate: float, hop: int = 512, seconds: float = 8.0, step: float = 2.0, slowest: float = 40.0, fastest: float = 240.0, usual: float = 120.0) -> DataFrame:
    """song_id, ordinal, t_s, tempo of each window of ``seconds``, one every ``step``: the beat distance at which the window's
    flux agrees best with itself (autocorrelation, weighed by how far from ``usual`` it is in octaves),
    between whole frames by a parabola. Windows without any change of flux have no tempo. For ``tempo.segments``."""
    per = rate / hop
    size, move = max(2, round(seconds * per)), max(1, round(step * per))
    reach = -(-size // move)
    # A frame is in the windows that begin at most a window before it; a song's last windows are cut short, and
    # those that would begin at or after its start but hold less than half a window drop.
    at = F.floor(F.col("frame") / move)
    rows = flux.select("song_id", "frame", "flux", F.explode(F.sequence(F.greatest(at - reach + 1, F.lit(0)), at)).alias("ordinal"))
    rows = rows.where(F.col("frame") < F.col("ordinal") * move + size)
    whole = rows.groupBy("song_id", "ordinal").agg(F.array_sort(F.collect_list(F.struct("frame", "flux"))).alias("w"))
    whole = whole.where((F.col("ordinal") == 0) | (F.size("w") * 2 >= size)).select("song_id", "ordinal", F.col("w.flux").alias("x"))
    low, high = max(1, int(np.floor(60 * per / fastest))), int(np.ceil(60 * per / slowest))
    lags = np.arange(low, high + 1)
    weight = np.exp(-0.5 * np.log2(60 * per / lags / usual) ** 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in _arrays(batch.column(2)):
                own = np.convolve(own - own.mean(), (0.25, 0.5, 0.25), "same")  # a beat falls between two frames
                n = 1 << (2 * len(own)).bit_length()
                power = np.fft.rfft(own, n)
                same = np.fft.irfft(power * np.conj(power), n)[: high + 2]
                same = np.pad(same, (0, max(0, high + 2 - len(same))))
                if same[0] <= 0:
                    out.append(None)
                    continue
                best = int(lags[np.argmax(same[lags] * weight)])
                a, b, c = same[best - 1 : best + 2]
                bend = a - 2 * b + c
                shift = float(np.clip(0.5 * (a - c) / bend, -0.5, 0.5)) if bend < 0 else 0.0
                out.append(60 * per / (best + shift))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["song_id", "ordinal", "tempo"])

    schema = flux.select("song_id").schema.add("ordinal", "long").add("tempo", "double")
    found = whole.mapInArrow(run, schema).where("tempo is not null")
    return found.select("song_id", "ordinal", (F.col("ordinal") * F.lit(move / per)).alias("t_s"), "tempo")
