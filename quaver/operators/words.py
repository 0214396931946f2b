"""Word tables: import of plain text, lines, statistics and export.

A word table has song_id, word_idx, reading and kind; rows have no other order than word_idx.
All windows are by song_id, so one exchange serves whatever follows by song.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaver.functions import text as T


def in_song():
    return Window.partitionBy("song_id").orderBy("word_idx")


def word_table(songs: DataFrame, words: str = "words") -> DataFrame:
    """One row for each word of songs (song_id and an array of readings)."""
    out = songs.select("song_id", F.posexplode(words).alias("word_idx", "reading"))
    return out.withColumn("kind", T.kind(F.col("reading")))


def from_text(songs: DataFrame, text: str = "text") -> DataFrame:
    """The word table of plain texts, each ending in a newline word."""
    return word_table(songs.select("song_id", T.closed(T.tokens(F.col(text))).alias("words")))


def statistics(songs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of words, spaces, newlines, lines and distinct words; arrays only, no exchange."""
    words = songs.select("song_id", T.tokens(F.col(text)).alias("w"))
    count = lambda c: F.size(F.filter("w", c)).cast("bigint")
    other = F.filter("w", lambda x: ~T.is_separator(x))
    newlines = count(lambda x: x == "\n")
    open_line = F.when(F.element_at(F.concat(F.array(F.lit("\n")), "w"), -1) == "\n", 0).otherwise(1)
    return words.select(
        "song_id",
        F.size(other).cast("bigint").alias("n_words"),
        count(lambda x: x == " ").alias("n_spaces"),
        newlines.alias("n_newlines"),
        (newlines + open_line).alias("n_lines"),
        F.size(F.array_distinct(other)).cast("bigint").alias("n_distinct"),
    )


def word_at(words: DataFrame, places: DataFrame) -> DataFrame:
    """places (song_id, word_idx) with the words there; a place that a song doesn't have gets nulls."""
    return places.join(words, ["song_id", "word_idx"], "left")


def lines(words: DataFrame) -> DataFrame:
    """song_id, line, start, end (exclusive) and text of each line; a newline word ends one."""
    newline = (F.col("reading") == "\n").cast("int")
    before = in_song().rowsBetween(Window.unboundedPreceding, -1)
    numbered = words.withColumn("line", F.coalesce(F.sum(newline).over(before), F.lit(0)).cast("int"))
    own = F.filter(F.array_sort(F.collect_list(F.struct("word_idx", "reading"))), lambda x: x["reading"] != "\n")
    return numbered.groupBy("song_id", "line").agg(
        F.min("word_idx").alias("start"),
        F.coalesce(F.min(F.when(F.col("reading") == "\n", F.col("word_idx"))), F.max("word_idx") + 1).alias("end"),
        F.array_join(F.transform(own, lambda x: x["reading"]), "").alias("text"),
    )


def line_table(songs: DataFrame, text: str = "text") -> DataFrame:
    """song_id, line, start, end (exclusive) and text of each line of plain texts, as ``lines`` of their word table:
    cut out of each text's array of words, no exchange."""
    rows = songs.select("song_id", T.closed(T.tokens(F.col(text))).alias("w_"))
    ends = F.filter(F.sequence(F.lit(0), F.size("w_") - 1), lambda i: F.get("w_", i) == "\n")
    rows = rows.select("song_id", "w_", ends.alias("ends_"))
    start = lambda k: F.when(k == 0, 0).otherwise(F.get("ends_", k - 1) + 1)
    cut = F.transform("ends_", lambda e, k: F.struct(k.alias("line"), start(k).alias("start"), e.alias("end"), F.array_join(F.slice("w_", start(k) + 1, e - start(k)), "").alias("text")))
    return rows.select("song_id", F.explode(cut).alias("l")).select("song_id", "l.*")


def to_text(words: DataFrame) -> DataFrame:
    """song_id and the readings of its words, joined in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "reading"))), lambda x: x["reading"])
    return words.groupBy("song_id").agg(F.array_join(ordered, "").alias("text"))


def reading_prompt(words: DataFrame) -> DataFrame:
    """The sung readings of each song, in order, without separators."""
    return to_text(words.where(~T.is_separator(F.col("reading"))))


def reindexed(words: DataFrame, order: list) -> DataFrame:
    """words numbered anew from 0 in the given order within their song."""
    w = Window.partitionBy("song_id").orderBy(*order)
    return words.withColumn("word_idx", (F.row_number().over(w) - 1).cast("int"))
