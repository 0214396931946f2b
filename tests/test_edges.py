"""Results at the edges of what the given tables have: long texts, long paths, small numbers."""

import base64
import random

from pyspark.sql import functions as F

from quaver.functions import word as W
from quaver.operators import lookup
from quaver.plans import registry
from quaver.sources import files, lyrics


def test_data_urls_are_one_line(spark):
    content = bytes(range(200))
    own = spark.createDataFrame([("a.mp3", bytearray(content)), ("a.txt", bytearray(content))], "path string, content binary")
    got = [r.u for r in own.select(files.data_url(F.col("path"), F.col("content")).alias("u")).collect()]
    assert got == ["data:audio/mpeg;base64," + base64.b64encode(content).decode(), None]


def test_samples_that_round_to_zero_keep_their_sign(spark, tmp_path):
    own = [(1, [0.5] * 10 + [-0.00001, -0.00001, 0.00001, 0.25, -0.0] + [0.5] * 49, 0)]
    spark.createDataFrame(own, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    path = registry.QUERIES["peak_path"](spark, str(tmp_path)).first().path
    assert list(map(str, path[:5])) == ["-0.0", "0.0", "0.0", "-0.25", "-0.0"]


def test_stamps_of_a_hundred_minutes_are_read(spark):
    songs = spark.createDataFrame([(1, "[99:59:50]a[100:00:00]b[12345:00:25]\n@Ruby1=b,x[100:00:01]y")], "song_id long, text string")
    got = [(r.reading, r.t) for r in lyrics.stamped_words(songs).orderBy("word_idx").collect()]
    assert got == [("a", 5_999_500), ("b", 6_000_000), ("\n", 740_700_250)]
    assert [(r.texts, r.offsets_ms) for r in lyrics.ruby_rules(songs).collect()] == [(["x", "y"], [0, 6_000_010])]


def test_written_stamps_are_read_again(spark):
    times = [250, 5_999_990, 6_000_000, 600_000_000, 9_000_000_000_000_000]
    rows = [(1, k, x) for k, x in enumerate(times)]
    own = spark.createDataFrame(rows, "song_id long, word_idx int, t long").withColumn("word", W.word(F.when(F.col("word_idx") == 4, "\n").otherwise(F.concat(F.lit("w"), "word_idx")), F.col("t")))
    back = lyrics.stamped_lyrics(lyrics.to_stamped(own)).orderBy("word_idx")
    assert [(r.word.reading, r.word.syllables[0].t) for r in back.collect()] == [("w0", 250), ("w1", 5_999_990), ("w2", 6_000_000), ("w3", 600_000_000), ("\n", times[-1])]


def test_owners_of_characters_without_a_join(spark):
    rng = random.Random(3)
    readings = {(s, k): "x" * rng.choice([0, 1, 1, 2, 5]) for s in range(6) for k in range(40)}
    times = {(s, c): rng.choice([None, c * 7]) for s in range(1, 8) for c in range(90) if rng.random() < 0.4}
    words = spark.createDataFrame([(s, k, x) for (s, k), x in readings.items()], "song_id long, word_idx int, reading string")
    chars = spark.createDataFrame([(s, c, t) for (s, c), t in times.items()], "song_id long, char_idx long, t long")
    want, first = set(), {}
    for (s, k), x in readings.items():
        low = first.get(s, 0)
        first[s] = low + len(x)
        own = [c for c in range(low, low + len(x)) if (s, c) in times]
        if own:
            want.add((s, k, times[s, own[0]]))
    out = lookup.owner_of_chars(words, chars)
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
