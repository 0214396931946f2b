"""LRC in arrays against LRC in tables."""

import random

from pyspark.sql import functions as F

from quaver.plans import registry
from quaver.sources import lyrics

TEXTS = [
    None, "", "x", "[00:01.00]", "[ti:T]\n[00:01.00]ab cd\n[00:05.00]ef\n", "[00:01.00][00:05.00]x\np[00:01.00]q\r\n", "[00:09.00]late\n[00:02.00]a  b\tc[00:03.00]d[:]gone\n[00:02.00]same",
    "[1:2]a [x] b[ c\n[k:v]no time\n[123:00.50]long　line ,.  z", "[00:01.00]   \n[00:00.00]a\n\n",
]


def test_lrc_in_arrays_equals_tables(spark):
    rng = random.Random(8)
    some = ["".join(rng.choice(["[00:0%d.00]" % rng.randint(0, 9), "[10:00.5]", "[ti:x]", "[", "]", " ", "  ", "\n", "\n", "a", "bc", "恋", "\t", "　", " ", "[:]"]) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    songs = spark.createDataFrame([(k, x) for k, x in enumerate([*TEXTS, *some])], "song_id long, text string").cache()
    lines = lyrics.lrc_lines(lyrics.lrc_items(songs))
    spread = lyrics.spread(lines)
    own = songs.select("song_id", lyrics.lrc_timed(F.col("text")).alias("timed")).cache()
    words = own.select("song_id", lyrics.lrc_words(F.col("timed")).alias("w")).cache()
    listed = lambda df, *columns: sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    flat = own.select("song_id", F.explode("timed").alias("x")).select("song_id", "x.*")
    assert listed(flat, "song_id", "line", "item", "t", "text") == listed(lines, "song_id", "line", "item", "t", "text")
    flat = words.select("song_id", F.posexplode("w").alias("word_idx", "x")).select("song_id", "word_idx", "x.*")
    assert listed(flat, "song_id", "word_idx", "reading", "t") == listed(spread, "song_id", "word_idx", "reading", "t")
    again = words.select("song_id", lyrics.lrc_body(F.col("w")).alias("l")).where(F.size("l") > 0).select("song_id", F.array_join("l", "").alias("text"))
    assert listed(again, "song_id", "text") == listed(lyrics.to_lrc(spread), "song_id", "text")
    # Unset times, an unclosed last line and lines of spaces.
    rows = [(1, k, r, t) for k, (r, t) in enumerate([(" ", 5), ("a", None), ("\n", 9), ("\n", 10), (" ", 3), ("\n", 4), ("b", 20), ("c", None), ("\n", None), ("open", 7)])]
    table = spark.createDataFrame(rows, "song_id long, word_idx int, reading string, t long")
    array = table.groupBy("song_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "reading", "t"))), lambda x: F.struct(x["reading"].alias("reading"), x["t"].alias("t"))).alias("w"))
    assert array.select(F.array_join(lyrics.lrc_body(F.col("w")), "").alias("text")).first().text == lyrics.to_lrc(table).first().text


def test_lrc_roundtrip_moves_no_words(spark):
    plan = registry.QUERIES["lrc_roundtrip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Sort", "Window", "Aggregate", "hashpartitioning", "Filter ("))
