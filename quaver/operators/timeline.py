"""Beat timelines: numbering, intervals, gap filling, repair and checks, all by song."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.functions import word as W
from quaver.functions.timecode import half_up
from quaver.operators.lookup import asof_tempo
from quaver.operators import scan

PAST = (Window.unboundedPreceding, -1)
FUTURE = (1, Window.unboundedFollowing)


def by_song(*order):
    return Window.partitionBy("song_id").orderBy(*order)


def numbered_beats(syllables: DataFrame, order: list[str], sung: Column | None = None) -> DataFrame:
    """The sung rows with beat_idx from 0 in their song's order; all rows if ``sung`` is None."""
    own = syllables if sung is None else syllables.where(sung)
    return own.withColumn("beat_idx", (F.row_number().over(by_song(*order)) - 1).cast("int"))


def grid_step(bpm: Column, denominator: int) -> Column:
    return F.lit(60000.0) / bpm / F.lit(float(denominator))


def on_grid(t: Column, start: Column, bpm: Column, denominator: int = 16) -> Column:
    """t on the nearest grid line of its tempo row, not before 0; t itself without a tempo."""
    step = grid_step(bpm, denominator)
    snapped = start + half_up((t - start) / step) * step
    return F.when(start.isNull() | bpm.isNull() | (bpm <= 0), t.cast("double")).otherwise(F.greatest(snapped, F.lit(0.0)))


def snapped(points: DataFrame, tempo: DataFrame, denominator: int = 16, fallback: bool = False) -> DataFrame:
    """points with their tempo row and the snapped time, a whole number of milliseconds."""
    out = asof_tempo(points, tempo, fallback)
    return out.withColumn("snapped", half_up(on_grid(F.col("t"), F.col("start_ms"), F.col("bpm"), denominator)).cast("bigint"))


def intervals(beats: DataFrame, t: str, duration: Column, ordinal: str = "ordinal") -> DataFrame:
    """beats with ``end``: the next beat's time, the duration for the last."""
    return beats.withColumn("end", F.coalesce(F.lead(t).over(by_song(t, ordinal)), duration))


def beat_timeline(beats: DataFrame, tempo: DataFrame, denominator: int = 8) -> DataFrame:
    """Beats numbered by time, snapped to their tempo's grid, each ending at the next one."""
    own = numbered_beats(beats, ["t", "ordinal"])
    whole = Window.partitionBy("song_id")
    out = snapped(own, tempo, denominator).withColumn("duration", F.max("t").over(whole))
    out = intervals(out, "snapped", F.col("duration"))
    return out.select("song_id", "ordinal", "beat_idx", "t", "bpm", "snapped", "end")


def fill_punctuation(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ``filled``: t, for punctuation the time of the next set word that is none."""
    sung_t = F.when((F.col("kind") == "sung") & F.col("t").isNotNull(), F.col("t"))
    following = F.first(sung_t, ignorenulls=True).over(by_song(*order).rowsBetween(*FUTURE))
    return rows.withColumn("filled", F.when(F.col("kind") == "punctuation", F.coalesce(following, F.col("t"))).otherwise(F.col("t")))


def infer_separators(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ``inferred``: t, for separators the floor of the middle between their neighbours.

    Both neighbours must be sung and set; a newline at the very end is half a second after a set
    neighbour; any other separator keeps its time.
    """
    w = by_song(*order)
    separator = F.col("kind").isin("space", "newline")
    edge = lambda f: F.when(~f("kind").over(w).isin("space", "newline"), f("t").over(w))
    left, right = edge(F.lag), edge(F.lead)
    middle = F.floor((left + right) / 2).cast("bigint")
    last = F.lead("kind").over(w).isNull() & (F.col("kind") == "newline")
    return rows.withColumn("inferred", F.when(separator, F.coalesce(F.when(last, left + 500), middle, F.col("t"))).otherwise(F.col("t")))


def pending_beats(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ``pending_left`` and ``pending_right``: the places (ordinal) of beats that wait for a time
    once a sung row is set, because a separator between both can't be timed without them."""
    w = by_song(*order)
    separator = lambda c: c.isin("space", "newline")

    def waits(f) -> Column:
        across = separator(f("kind", 1).over(w)) & ~separator(f("kind", 2).over(w))
        return F.when(~separator(F.col("kind")) & F.col("t").isNotNull() & across & f("t", 2).over(w).isNull(), f("ordinal", 2).over(w))

    return rows.withColumn("pending_left", waits(F.lag)).withColumn("pending_right", waits(F.lead))


def cards(words: DataFrame) -> DataFrame:
    """song_id, line, item, word_idx, syl_idx, label, time_text, is_set of words (song_id, word_idx, word):
    the syllables of each line in order, a separator as one item; unset times show as 0:00.000."""
    newline = (F.col("word.reading") == "\n").cast("int")
    before = Window.partitionBy("song_id").orderBy("word_idx").rowsBetween(*PAST)
    rows = words.withColumn("line", F.coalesce(F.sum(newline).over(before), F.lit(0)).cast("int"))
    separator = F.col("word.reading").isin(" ", "\n")
    own = F.when(separator, F.slice("word.syllables", 1, 1)).otherwise(F.col("word.syllables"))
    rows = rows.select("song_id", "line", "word_idx", separator.alias("sep_"), F.posexplode(own).alias("syl_idx", "s"))
    label = F.when(F.col("sep_"), F.when(F.col("s.reading") == "\n", W.NEWLINE_GLYPH).otherwise("…")).otherwise(F.col("s.reading"))
    item = F.row_number().over(Window.partitionBy("song_id", "line").orderBy("word_idx", "syl_idx")) - 1
    return rows.select("song_id", "line", item.alias("item"), "word_idx", "syl_idx", label.alias("label"), W.card_time(F.col("s.t")).alias("time_text"), F.col("s.t").isNotNull().alias("is_set"))


def clamped(rows: DataFrame, target: str, order: list[str]) -> DataFrame:
    """rows with ``clamped``: the target kept a millisecond from the set beats on both sides."""
    w = by_song(*order)
    low = F.coalesce(F.last("t", ignorenulls=True).over(w.rowsBetween(*PAST)), F.lit(0).cast("bigint"))
    high = F.coalesce(F.first("t", ignorenulls=True).over(w.rowsBetween(*FUTURE)), F.lit(2**53 - 1))
    return rows.withColumn("clamped", F.when(F.col("t").isNotNull(), F.greatest(low + 1, F.least(high - 1, F.col(target)))))


def dragged(rows: DataFrame, tempo: DataFrame, target: str, order: list[str], denominator: int = 4) -> DataFrame:
    """rows (song_id, ordinal, t and more) with ``clamped``: the target on the tempo's grid, then kept a
    millisecond from the set beats on both sides."""
    at = rows.select("song_id", "ordinal", F.col(target).alias("t"), F.struct(*rows.columns).alias("own_"))
    out = snapped(at, tempo, denominator).select("own_.*", F.col("snapped").alias("snapped_"))
    return clamped(out, "snapped_", order).drop("snapped_")


def monotone(rows: DataFrame, t: str, order: list[str]) -> DataFrame:
    """rows (song_id, ordinal, t) with ``repaired`` times, in which none is before the last: an earlier
    one is the last plus 1. One pass over each song's sorted rows with the last time as its state."""
    own = rows.where(F.col(t).isNotNull()).withColumn(t, F.col(t).cast("bigint"))
    own = own.withColumn("song_id", F.col("song_id").cast("bigint")).withColumn("ordinal", F.col("ordinal").cast("bigint"))
    return scan.monotone(own, [*order, t, "ordinal"], t, f"song_id long,ordinal long,{t} long,repaired long")


def dropped(rows: DataFrame, tempo: DataFrame, target: str, duration: Column, order: list[str], denominator: int = 4) -> DataFrame:
    """rows (song_id, ordinal, kind, t and more) after a beat was dropped at ``target`` (null where none
    was): within 0 and the duration, on the grid, a whole number; then punctuation is filled again
    in ``filled``."""
    at = F.greatest(F.least(F.col(target), duration), F.lit(0))
    moved = rows.where(F.col(target).isNotNull()).select("song_id", "ordinal", at.alias("t"))
    new = snapped(moved, tempo, denominator).select("song_id", "ordinal", F.col("snapped").alias("new_"))
    out = rows.join(new, ["song_id", "ordinal"], "left").withColumn("t", F.coalesce("new_", "t")).drop("new_")
    return fill_punctuation(out, order)


def statistics(rows: DataFrame, tempo: DataFrame) -> DataFrame:
    """Per song: syllables, sung ones, set ones, sung ones without a time, and tempo segments."""
    sung = F.col("kind") == "sung"
    own = rows.groupBy("song_id").agg(F.count(F.lit(1)).alias("n_syllables"), F.count_if(sung).alias("n_sung"), F.count("t").alias("n_set"), F.count_if(sung & F.col("t").isNull()).alias("n_unset"))
    parts = tempo.groupBy("song_id").agg(F.count(F.lit(1)).alias("n_segments"))
    return own.join(parts, "song_id", "left").withColumn("n_segments", F.coalesce("n_segments", F.lit(0).cast("bigint")))


def audit(beats: DataFrame, order: list[str]) -> DataFrame:
    """Per song: beats, set and unset ones, whether all are set, and whether set times rise."""
    before = F.max("t").over(by_song(*order).rowsBetween(*PAST))
    rises = F.coalesce(F.col("t") > before, F.lit(True))
    return beats.withColumn("rises", rises).groupBy("song_id").agg(
        F.count(F.lit(1)).alias("n_beats"),
        F.count("t").alias("n_set"),
        F.count_if(F.col("t").isNull()).alias("n_unset"),
        F.bool_and(F.col("t").isNotNull()).alias("fully_timed"),
        F.bool_and("rises").alias("rising"),
    )


def visible(spans: DataFrame, start: Column, end: Column) -> DataFrame:
    """Intervals that overlap a viewport."""
    return spans.where((F.col("t") < end) & (F.col("end") > start))


def char_times(words: DataFrame) -> DataFrame:
    """song_id, char_idx, t: times of characters, spread evenly over each aligned word.

    words has song_id, word_idx, word, start, end (seconds); characters are numbered over the
    joined words less the leading blank, times have three decimals, the first of equals wins.
    """
    n = F.length("word")
    before = Window.partitionBy("song_id").orderBy("word_idx").rowsBetween(*PAST)
    spans = words.where(n > 0).withColumn("first", F.coalesce(F.sum(n).over(before), F.lit(0)))
    rows = spans.select("song_id", "word_idx", (F.col("first") - 1).alias("first"), "start", "end", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("j"))
    t = F.bround(F.col("start") + (F.col("end") - F.col("start")) * (F.col("j") / F.col("n")), 3)
    return rows.select("song_id", (F.col("first") + F.col("j")).alias("char_idx"), t.alias("t")).where("char_idx >= 0")


# --- the cursor and what waits ------------------------------------------------------------------


def next_beat(at: Column, n: Column) -> Column:
    """The beat after ``at`` of n beats; the last one stays. Without beats nothing moves."""
    return F.when(n > 0, F.least(at + 1, n - 1)).otherwise(at)


def previous_beat(at: Column) -> Column:
    return F.when(at > 0, at - 1).otherwise(at)


def beat_at(at: Column, to: Column, n: Column) -> Column:
    """The beat ``to`` if there is one, else where the cursor is."""
    return F.when((to >= 0) & (to < n), to).otherwise(at)


def pending_with(pending: Column, more: Column) -> Column:
    """Beats (arrays of numbers) that wait for a time, with more of them, each once, ascending."""
    return F.array_sort(F.array_union(pending, more))


def pending_without(pending: Column, done: Column) -> Column:
    """Beats that still wait when some don't any more."""
    return F.array_except(pending, done)


def unset_beats(rows: DataFrame) -> DataFrame:
    """The sung rows (kind, t) that have no time yet."""
    return rows.where((F.col("kind") == "sung") & F.col("t").isNull())


def highlighted(rows: DataFrame, by: list[str], playhead: Column) -> DataFrame:
    """by, fully, partly: whether all, or some but not all, of a word's beats (t) are set and behind the playhead."""
    lit = F.count_if(F.coalesce(F.col("t") <= playhead, F.lit(False)))
    own = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_"), lit.alias("lit_"))
    return own.select(*by, (F.col("n_") == F.col("lit_")).alias("fully"), ((F.col("lit_") > 0) & (F.col("lit_") < F.col("n_"))).alias("partly"))
