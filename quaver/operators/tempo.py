"""Tempo: beats per minute from ticks, segments, change detection, grid and ruler lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.functions.timecode import half_up
from quaver.operators.rank import medians
from quaver.operators.scan import along, scanned, segmenter


def in_ticks():
    return Window.partitionBy("song_id").orderBy("t", "ordinal")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def with_medians(groups: DataFrame, gaps: DataFrame, by: list[str], gap: str) -> DataFrame:
    """groups with ``median``, the upper median of each group's distances, null where it has none."""
    found = medians(gaps, by, gap).select(*[F.col(c).alias(f"{c}_key_") for c in by], F.col(gap).alias("median"))
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_key_")) for c in by])
    return groups.join(found, on, "left").drop(*[f"{c}_key_" for c in by])


def bpm_of_ticks(ticks: DataFrame) -> DataFrame:
    """Per song: bpm by the upper median of tick distances, and by their mean; 0 for one tick.

    ticks has song_id, ordinal, t in milliseconds. Both are within 20 and 300. Distances are neither gathered
    nor sorted, however many a song has (``rank``).
    """
    gaps = ticks.withColumn("gap", F.col("t") - F.lag("t").over(in_ticks()))
    out = with_medians(gaps.groupBy("song_id").agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean")), gaps, ["song_id"], "gap")
    rate = lambda c: F.when(F.col("n") < 2, 0.0).otherwise(clamp(F.when(F.col(c) > 0, half_up(F.lit(60000.0) / F.col(c)).cast("double")).otherwise(300.0), 20.0, 300.0))
    return out.select("song_id", "n", rate("median").alias("bpm_median"), rate("mean").alias("bpm_mean"))


def tenth(x: Column) -> Column:
    return half_up(x * 10) / 10


def segments(curve: DataFrame, split: float = 5.0, join: float = 5.0) -> DataFrame:
    """Tempo segments of each song: song_id, seg_idx, bpm, start_ms.

    A segment ends where the tempo differs from its first by more than ``split``; its bpm is the
    mean to a tenth. Then neighbours closer than ``join`` become one, with the mean of both. curve
    has song_id, ordinal, t_s (seconds), tempo; points without one of both drop. One pass over each
    song's sorted points, with two segments as its state.
    """
    own = curve.where(F.col("t_s").isNotNull() & F.col("tempo").isNotNull()).withColumn("t_s", F.col("t_s").cast("double")).withColumn("tempo", F.col("tempo").cast("double"))
    return scanned(own, ["ordinal", "t_s", "tempo"], ["t_s", "tempo"], *segmenter(split, join), "song_id long,seg_idx int,bpm double,start_ms long")


def with_changes(ticks: DataFrame, window: int = 8, threshold: float = 0.15, of_intervals: bool = True) -> DataFrame:
    """ticks with i (from 0), before and after (the means of the last and the next ``window`` values) and changes: whether
    they differ by more than ``threshold`` of the former. Values are tick distances, or tick times with
    ``of_intervals`` off."""
    value = (F.col("t") - F.lag("t").over(in_ticks())) if of_intervals else F.col("t")
    rows = ticks.withColumn("v", value.cast("double")).withColumn("i", F.row_number().over(in_ticks()) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("song_id")))
    before, after = F.avg("v").over(in_ticks().rowsBetween(-window, -1)), F.avg("v").over(in_ticks().rowsBetween(0, window - 1))
    rows = rows.withColumn("before", before).withColumn("after", after)
    far = F.abs(F.col("after") - F.col("before")) > threshold * F.col("before")
    return rows.withColumn("changes", F.coalesce((F.col("i") >= window) & (F.col("i") < F.col("n") - window) & far, F.lit(False))).drop("v", "n")


def changes(ticks: DataFrame, window: int = 8, threshold: float = 0.15, of_intervals: bool = True) -> DataFrame:
    """Ticks at which the mean of the next ``window`` values differs from that of the last by more
    than ``threshold`` of it; see ``with_changes``."""
    return with_changes(ticks, window, threshold, of_intervals).where("changes").select("song_id", "ordinal", "t", "i", "before", "after")


def change_segments(ticks: DataFrame, window: int = 8, threshold: float = 0.15) -> DataFrame:
    """Tempo segments of ticks (song_id, ordinal, t in milliseconds): song_id, seg_idx, bpm, start_ms.

    A segment begins at each tick that ``changes`` (of tick times) finds; its bpm is by the upper median
    of its own distances, within 20 and 300, its start rounded, the first one's 0. Segments of one
    tick drop. Fewer than two windows of ticks are one segment by the mean distance; a single tick
    has no bpm.
    """
    rows = with_changes(ticks, window, threshold, of_intervals=False)
    rows = rows.withColumn("part_", F.sum(F.col("changes").cast("int")).over(in_ticks()))
    inside = Window.partitionBy("song_id", "part_").orderBy("t", "ordinal")
    rows = rows.withColumn("gap_", (F.col("t") - F.lag("t").over(inside)).cast("double"))
    parts = rows.groupBy("song_id", "part_").agg(F.count(F.lit(1)).alias("n"), F.avg("gap_").alias("mean"), F.min("t").alias("t"))
    parts = with_medians(parts, rows, ["song_id", "part_"], "gap_")
    whole = Window.partitionBy("song_id")
    parts = parts.withColumn("few_", F.sum("n").over(whole) < 2 * window)
    gap = F.when(F.col("few_"), F.col("mean")).otherwise(F.col("median"))
    rate = F.when(gap > 0, clamp(half_up(F.lit(60000.0) / gap).cast("double"), 20.0, 300.0)).when(gap.isNotNull(), 300.0)
    start = F.when(F.col("part_") == 0, 0).otherwise(half_up(F.col("t").cast("double"))).cast("bigint")
    parts = parts.where(F.col("few_") | (F.col("n") > 1))
    order = Window.partitionBy("song_id").orderBy("part_")
    return parts.select("song_id", (F.row_number().over(order) - 1).alias("seg_idx"), rate.alias("bpm"), start.alias("start_ms"))


def grid_lines(tempo: DataFrame, view_end: Column, denominator: int = 4) -> DataFrame:
    """song_id, seg_idx, line, t of the grid lines of each tempo row up to the next one's start.

    tempo has song_id, ordinal, start_ms, bpm; rows with a bpm of 0 or less have no lines.
    """
    order = Window.partitionBy("song_id").orderBy("start_ms", "ordinal")
    rows = tempo.withColumn("seg_idx", F.row_number().over(order) - 1).withColumn("stop", F.coalesce(F.lead("start_ms").over(order), view_end))
    rows = rows.where((F.col("bpm") > 0) & (F.col("stop") > F.col("start_ms")))
    step = F.lit(60000.0) / F.col("bpm") / denominator
    count = F.ceil((F.col("stop") - F.col("start_ms")) / step).cast("int")
    rows = rows.select("song_id", "seg_idx", "start_ms", step.alias("step"), F.explode(F.sequence(F.lit(0), count - 1)).alias("line"))
    return rows.select("song_id", "seg_idx", "line", half_up(F.col("start_ms") + F.col("line") * F.col("step")).alias("t"))


def spaced(positions: Column, gap: float) -> Column:
    """Ascending positions (whole numbers) less those nearer than ``gap`` to the last one kept."""
    return along("bigint", lambda last, x: (x, [x]) if last is None or x - last >= gap else (last, []), positions)


def ruler_step(pixels_per_second: Column) -> Column:
    """Seconds between ruler marks for a scale of the view."""
    p = pixels_per_second
    return F.when(p >= 100, 1).when(p >= 50, 2).when(p >= 20, 5).when(p >= 10, 10).otherwise(30)


def ruler(views: DataFrame, width: int = 800) -> DataFrame:
    """views (start_ms, visible_ms) with the seconds of their ruler marks as an array."""
    step = ruler_step(F.lit(float(width)) / (F.col("visible_ms") / 1000.0)).cast("bigint")
    first = F.ceil(F.col("start_ms") / 1000.0 / step).cast("bigint") * step
    last = F.floor((F.col("start_ms") + F.col("visible_ms")) / 1000.0).cast("bigint")
    marks = F.when(first <= last, F.sequence(first, last, step)).otherwise(F.array().cast("array<bigint>"))
    return views.withColumn("step", step).withColumn("marks", marks)
