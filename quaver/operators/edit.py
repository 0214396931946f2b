"""Edits of word and tempo tables: every edit is a new DataFrame, numbered anew where places move.

Edits come as DataFrames keyed by (song_id, word_idx), so one edit or a million is the same plan. Where the rule of an
edit is an expression of the word and its place, ``functions.song`` does it in a song's array, without a join or exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.functions import song
from quaver.functions import text as T
from quaver.functions import timecode as C
from quaver.functions import word as W
from quaver.functions.timecode import BLANK, half_up, shifted
from quaver.operators.words import reindexed

KEY = ["song_id", "word_idx"]


def marked(words: DataFrame, which: DataFrame | Column) -> DataFrame:
    """words with ``hit_``: whether a row is named in which, or meets a condition, which needs no join."""
    if isinstance(which, Column):
        return words.withColumn("hit_", F.coalesce(which, F.lit(False)))
    return words.join(which.select(*KEY).distinct().withColumn("hit_", F.lit(True)), KEY, "left").withColumn("hit_", F.coalesce("hit_", F.lit(False)))


def removed(words: DataFrame, which: DataFrame | Column) -> DataFrame:
    """words without those that which names or describes."""
    return reindexed(marked(words, which).where("not hit_").drop("hit_"), ["word_idx"])


def inserted(words: DataFrame, new: DataFrame, after: bool = False) -> DataFrame:
    """words with the rows of new before (or after) the place that their word_idx names; several at
    one place keep the order of their column nth. A place beyond the end appends."""
    old = words.withColumn("side_", F.lit(1)).withColumn("nth_", F.lit(0))
    more = new.withColumn("side_", F.lit(2 if after else 0)).withColumn("nth_", F.col("nth")).drop("nth")
    return reindexed(old.unionByName(more), ["word_idx", "side_", "nth_"]).drop("side_", "nth_")


def replaced(words: DataFrame, new: DataFrame) -> DataFrame:
    """Each word named in new gives way to new's rows for it, in the order of nth."""
    kept = words.join(new.select(*KEY).distinct(), KEY, "left_anti").withColumn("nth", F.lit(0))
    return reindexed(kept.unionByName(new), ["word_idx", "nth"]).drop("nth")


def retexted(words: DataFrame, edits: DataFrame) -> DataFrame:
    """Batch text edits (song_id, word_idx, text): white space goes, empty ones change nothing, an
    edited word's time is unset."""
    clean = edits.select(*KEY, F.regexp_replace("text", BLANK, "").alias("new_")).where("new_ <> ''")
    out = words.join(clean, KEY, "left")
    out = out.withColumn("t", F.when(F.col("new_").isNull(), F.col("t"))).withColumn("reading", F.coalesce("new_", "reading"))
    return out.withColumn("kind", T.kind(F.col("reading"))).drop("new_")


def finished_text(text: Column) -> Column:
    """What an edited text becomes: a newline word, a space word, or itself without white space."""
    return F.when(text.contains("\n"), "\n").when(T.is_blank(text), " ").otherwise(F.regexp_replace(text, BLANK, ""))


def split_characters(words: DataFrame, which: DataFrame | Column) -> DataFrame:
    """Each word that which names or describes as its characters; the first keeps the time."""
    parts = F.when(F.col("hit_"), F.split("reading", "")).otherwise(F.array("reading"))
    rows = marked(words, which).select("*", F.posexplode(parts).alias("nth", "char"))
    rows = rows.withColumn("t", F.when(F.col("nth") == 0, F.col("t"))).withColumn("reading", F.col("char")).withColumn("kind", T.kind(F.col("reading")))
    return reindexed(rows, ["word_idx", "nth"]).select(*words.columns)


def split_in_two(words: DataFrame, at: DataFrame) -> DataFrame:
    """Each named word (song_id, word_idx, left) as left and the rest; a left that isn't a true
    beginning splits at the middle, the longer half first."""
    rows = words.join(at.select(*KEY, "left"), KEY)
    n = F.length("reading")
    fits = F.col("left").isNotNull() & (F.length("left") > 0) & (F.length("left") < n) & F.col("reading").startswith(F.col("left"))
    cut = F.when(fits, F.length("left")).otherwise(F.ceil(n / 2).cast("int"))
    rows = rows.where(n > 1).select(*words.columns, F.posexplode(F.array(F.substring("reading", F.lit(1), cut), F.substring("reading", cut + 1, n))).alias("nth", "part"))
    rows = rows.withColumn("t", F.when(F.col("nth") == 0, F.col("t"))).withColumn("reading", F.col("part")).drop("part")
    return replaced(words, rows.withColumn("kind", T.kind(F.col("reading"))))


def merged_selection(words: DataFrame, which: DataFrame) -> DataFrame:
    """words (song_id, word_idx, word) with each song's selected words (which: song_id, word_idx) as
    one, by ``functions.word.merged``. A selection of fewer than two words, or one with a gap, changes
    nothing. One grouping of the selected words; places after them move up, without a window."""
    chosen = words.select(*KEY, "word").join(which.select(*KEY).distinct(), KEY, "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("word_idx", "word")))
    spans = chosen.groupBy("song_id").agg(F.min("word_idx").alias("low_"), F.max("word_idx").alias("high_"), F.count(F.lit(1)).alias("n_"), parts.alias("parts_"))
    spans = spans.where("n_ > 1 and high_ - low_ + 1 = n_").select("song_id", "low_", "high_", W.merged(F.transform("parts_", lambda x: x["word"])).alias("one_"))
    out = words.join(spans, "song_id", "left").where("low_ is null or word_idx <= low_ or word_idx > high_")
    at = F.col("word_idx")
    place = F.when(at > F.col("high_"), at - (F.col("high_") - F.col("low_"))).otherwise(at)
    return out.withColumn("word", F.when(at == F.col("low_"), F.col("one_")).otherwise(F.col("word"))).withColumn("word_idx", place.cast("int")).drop("low_", "high_", "one_")


def converted(words: DataFrame, which: DataFrame | Column, to: str = " ") -> DataFrame:
    """The named words as unset separators: spaces or newlines."""
    out = marked(words, which)
    out = out.withColumn("t", F.when(~F.col("hit_"), F.col("t"))).withColumn("reading", F.when(F.col("hit_"), to).otherwise(F.col("reading")))
    return out.withColumn("kind", T.kind(F.col("reading"))).drop("hit_")


def key_deleted(words: DataFrame, which: DataFrame | Column) -> DataFrame:
    """words less those named, but newlines stay: the delete key doesn't join lines."""
    rows = marked(words, which).where(~F.col("hit_") | (F.col("reading") == "\n"))
    return reindexed(rows.drop("hit_"), ["word_idx"])


def tabbed(words: DataFrame, edits: DataFrame) -> DataFrame:
    """Text edits (song_id, word_idx, text) finished with the tab key: a space word after each."""
    done = retexted(words, edits)
    spaces = edits.select(*KEY).distinct().select(*KEY, F.lit(" ").alias("reading"), F.lit("space").alias("kind"), F.lit(None).cast(words.schema["t"].dataType).alias("t"), F.lit(1).alias("nth"))
    return inserted(done, spaces, after=True)


def segmented(words: DataFrame, units: DataFrame, with_ruby: bool) -> DataFrame:
    """words (song_id, word_idx, word) with those that units (song_id, word_idx, nth, surface, readings)
    take apart replaced by a word for each unit, unset. Without ruby a single unit changes nothing;
    separators never change. Readings that differ from the surface become ruby."""
    count = units.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1" if not with_ruby else "n_ > 0")
    sung = words.where(~T.is_separator(F.col("word.reading"))).select(*KEY)
    rows = units.join(count, KEY, "left_semi").join(sung, KEY, "left_semi")
    new = rows.select(*KEY, song.unit_word(F.col("surface"), F.col("readings"), with_ruby).alias("word"), "nth")
    return replaced(words, new)


def shifted_times(words: DataFrame, shifts: DataFrame) -> DataFrame:
    """Times moved by the shifts (song_id, word_idx, by); set ones stay at 0 or later."""
    out = words.join(shifts.select(*KEY, "by"), KEY, "left")
    return out.withColumn("t", F.when(F.col("by").isNull(), F.col("t")).otherwise(shifted(F.col("t"), F.col("by")))).drop("by")


def retimed(syllables: DataFrame, starts: DataFrame) -> DataFrame:
    """Words moved to a new start (song_id, word_idx, start): all set syllables by the same amount."""
    w = Window.partitionBy("song_id", "word_idx").orderBy("syl_idx")
    first = F.first("t").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = syllables.join(starts.select(*KEY, "start"), KEY, "left").withColumn("first_", first)
    return out.withColumn("t", F.when(F.col("start").isNull() | F.col("first_").isNull(), F.col("t")).otherwise(shifted(F.col("t"), F.col("start") - F.col("first_")))).drop("start", "first_")


def pasted(words: DataFrame, which: DataFrame, before: bool = False) -> DataFrame:
    """The named words once more, unset, after the last of them (or before the first)."""
    own = words.join(which.select(*KEY).distinct(), KEY, "left_semi")
    place = own.groupBy("song_id").agg((F.min if before else F.max)("word_idx").alias("at"))
    copies = own.join(place, "song_id").withColumn("nth", F.col("word_idx")).withColumn("word_idx", F.col("at")).drop("at")
    return inserted(words, copies.withColumn("t", F.lit(None).cast(words.schema["t"].dataType)), after=not before)


def edited_readings(old: Column, new: Column) -> Column:
    """Syllables after a ruby edit: the new readings in place of the old, times kept where there
    were any, blank readings dropped; the old ones if none is left."""
    fresh = F.filter(F.transform(new, lambda x: F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", "")), lambda x: x != "")
    rows = F.transform(fresh, lambda r, i: F.struct(r.alias("reading"), F.get(old, i)["t"].alias("t")))
    return F.when(F.size(fresh) > 0, rows).otherwise(old)


def metadata(current: Column, entries: Column) -> Column:
    """Metadata after an edit: keys trimmed and lower-case, blank ones dropped, the last of equals."""
    clean = F.transform(F.map_entries(entries), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), F.trim(e["value"]).alias("value")))
    clean = F.filter(clean, lambda e: e["key"] != "")
    last = F.aggregate(clean, F.map_from_entries(F.slice(clean, 1, 0)), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))
    return F.map_concat(F.map_filter(current, lambda k, _: ~F.map_contains_key(last, k)), last)


def tempo_edited(tempo: DataFrame, edits: DataFrame, duration: float | None = None) -> DataFrame:
    """Tempo rows after edits (song_id, ordinal, action, bpm, start_ms): delete, bpm, move or add.

    Moved starts are rounded and not before 0 (nor after ``duration``), rates have a decimal; the rows
    are numbered by start.
    """
    e = edits.select("song_id", "ordinal", "action", F.col("bpm").alias("new_bpm"), F.col("start_ms").alias("new_start"))
    changed = tempo.join(e.where("action <> 'add'"), ["song_id", "ordinal"], "left").where("action is null or action <> 'delete'")
    rate = F.when(F.col("action") == "bpm", F.greatest(half_up(F.col("new_bpm") * 10) / 10, F.lit(0.0))).otherwise(F.col("bpm"))
    wanted = F.col("new_start") if duration is None else F.least("new_start", F.lit(float(duration)))
    start = F.when(F.col("action") == "move", F.greatest(half_up(wanted), F.lit(0)).cast("double")).otherwise(F.col("start_ms").cast("double"))
    changed = changed.select("song_id", "ordinal", rate.alias("bpm"), start.alias("start_ms"))
    added = e.where("action = 'add'").select("song_id", "ordinal", F.col("new_bpm").alias("bpm"), F.col("new_start").cast("double").alias("start_ms"))
    order = Window.partitionBy("song_id").orderBy("start_ms", "ordinal")
    return changed.unionByName(added).withColumn("seg_idx", (F.row_number().over(order) - 1).cast("int"))


#: The keys that the metadata editor always lists, in its order.
DEFAULT_KEYS = ("title", "artist", "album", "timer", "lyricist", "offset")


def metadata_entries(current: Column) -> Column:
    """Rows (key, value) of the metadata editor: the default keys first, empty where unset, then others."""
    known = [F.struct(F.lit(k).alias("key"), F.coalesce(F.try_element_at(current, F.lit(k)), F.lit("")).alias("value")) for k in DEFAULT_KEYS]
    return F.concat(F.array(*known), F.filter(F.map_entries(current), lambda e: ~e["key"].isin(*DEFAULT_KEYS)))


def with_metadata(current: Column, key: Column, value: Column) -> Column:
    """Metadata with one key set."""
    return F.map_concat(F.map_filter(current, lambda k, _: k != key), F.create_map(key, value))


def tempo_form(kind: Column, raw: Column) -> Column:
    """The number that a tempo form takes, null if it refuses: a rate (``bpm``, ``new``) of 0 or more, by
    the leading number of the text, or a start (``time``), which needs a digit and isn't negative."""
    bare = C.trimmed(raw)
    rate = F.regexp_extract(bare, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    start = C.parse_time(bare)
    return F.when(kind == "time", F.when((start >= 0) & C.has_digit(bare), half_up(start).cast("double"))).otherwise(F.when(rate >= 0, rate))
