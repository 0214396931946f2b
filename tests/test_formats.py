"""Lyric files through their data source, and segmentation against exhaustive search."""

import random

import pytest
from pyspark.sql import functions as F

from quaver.functions import word as W
from quaver.operators import edit, segment
from quaver.sources import formats

TEXTS = {
    "txt": {1: "a b\nc é\n", 2: "x\n"},
    "lrc": {1: "[ti:T]\n[00:01.00]ab cd\n[00:05.00]ef\n", 2: "[00:02.50]x\n"},
    "nico": {1: "[00:01:00]恋[00:01:50]が[00:02:00]\n\n@Title=T\n@Ruby1=恋,こ[00:00:20]い\n", 2: "[00:01:00]a[00:02:00]\n\n"},
    "json": {1: '{"metadata":{"title":"T"},"words":[{"reading":"a","syllables":[{"reading":"a","time":5.0,"isSet":true}],"withRuby":false,"isReadingAutoGenerated":true}]}'},
}


@pytest.mark.parametrize("kind", TEXTS)
def test_files_are_read_and_written_again(spark, tmp_path, kind):
    for k, text in TEXTS[kind].items():
        (tmp_path / f"{k}.{kind}").write_text(text, encoding="utf-8")
    (tmp_path / "notes.md").write_text("x")
    (tmp_path / f"cover.{kind}").write_text("x")
    words, metadata = formats.read(spark, str(tmp_path), kind)
    assert words.columns == ["song_id", "word_idx", "word"] and words.schema["word"].dataType.simpleString() == W.WORD
    out = tmp_path / "out"
    formats.write(words, metadata, str(out), kind)
    assert {p.name: p.read_text(encoding="utf-8") for p in out.iterdir()} == {f"{k}.{kind}": t for k, t in TEXTS[kind].items()}
    again = formats.read(spark, str(out), kind)[0]
    assert sorted(map(str, again.collect())) == sorted(map(str, words.collect()))


def test_partitions_and_commits(spark, tmp_path):
    formats.register(spark)
    folder = tmp_path / "files"
    rows = spark.range(20).selectExpr("concat(id, '.txt') name", "repeat('x', 100) text").repartition(4)
    rows.write.format("lyric_files").mode("append").save(str(folder))
    look = lambda: spark.read.format("lyric_files").option("together", 250).load(str(folder))
    assert look().count() == 20 and look().rdd.getNumPartitions() == 10
    rows.limit(3).write.format("lyric_files").mode("overwrite").save(str(folder))
    assert look().count() == 3 and {p.name[0] for p in folder.iterdir()} <= set("0123456789")
    # A task that fails, or two rows of one name: what was there stays, no draft is left.
    bad = spark.range(8).selectExpr("concat('n', id) name", "if(id = 5, raise_error('broken'), 'y') text").repartition(4)
    for broken in (bad, rows.union(rows), rows.withColumn("name", F.lit("../up"))):
        with pytest.raises(Exception, match="broken|one file|no file name"):
            broken.write.format("lyric_files").mode("append").save(str(folder))
        assert look().count() == 3 and len(list(folder.iterdir())) == 3
    assert spark.read.format("lyric_files").option("suffix", ".lrc").load(str(folder)).collect() == []


# --- segmentation -------------------------------------------------------------------------------


def every_path(text, words, unknown):
    if not text:
        yield 0, 0, (), ()
        return
    options = {}
    for surface, reading, cost in words:
        if surface and text.startswith(surface) and (surface not in options or (cost, reading is None, reading or "") < options[surface][:3]):
            options[surface] = (cost, reading is None, reading or "")
    tries = [(s, None if x[1] else x[2], x[0]) for s, x in options.items()] + [(text[0], None, unknown)]
    for s, reading, cost in tries:
        for c, n, ends, path in every_path(text[len(s) :], words, unknown):
            yield cost + c, n + 1, (-len(s), *ends), ((s, reading), *path)


def test_cheapest_paths(spark):
    r = random.Random(7)
    words = [("".join(r.choice("abc") for _ in range(r.randrange(1, 4))), r.choice([None, "x", "y"]), r.randrange(1, 8)) for _ in range(25)]
    texts = ["".join(r.choice("abcd") for _ in range(r.randrange(0, 9))) for _ in range(80)]
    lexicon = spark.createDataFrame([*words, ("", "q", 0), (None, "q", 0)], "surface string, reading string, cost int")
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, text string").repartition(3)
    got = {x.i: x.t for x in df.select("i", segment.segmenter(lexicon, 5)(F.col("text")).alias("t")).collect()}
    assert got[len(texts)] is None
    for i, text in enumerate(texts):
        paths = list(every_path(text, words, 5))
        best = min(paths, key=lambda p: (p[0], p[1], p[2]))
        found = [(x.surface, x.reading) for x in got[i]]
        assert "".join(s for s, _ in found) == text
        assert [s for s, _ in found] == [s for s, _ in best[3]]


def test_a_sentence_becomes_units(spark, monkeypatch):
    lexicon = spark.createDataFrame([("食べ物", "タベモノ", 10), ("食べ", "タベ", 8), ("物", "ブツ", 8), ("は", "ワ", 1), ("きょう", "キョウ", 5)], "surface string, reading string, cost int")
    own = spark.createDataFrame([(1, 0, "きょうは食べ物"), (1, 1, " ")], "song_id long, word_idx int, reading string").select("song_id", "word_idx", W.word(F.col("reading")).alias("word"))
    out = edit.segmented(own, segment.analysed(own, lexicon), True).orderBy("word_idx").collect()
    assert [(x.word.reading, [s.reading for s in x.word.syllables]) for x in out] == [("きょ", ["きょ"]), ("う", ["う"]), ("は", ["わ"]), ("食", ["た"]), ("べ", ["べ"]), ("物", ["も", "の"]), (" ", [" "])]
    monkeypatch.setattr(segment, "MOST_WORDS", 3)
    with pytest.raises(ValueError, match="isn't sent"):
        segment.segmenter(lexicon)


def test_a_worker_holds_few_tokens(spark):
    """Batches of many long texts: results go in parts of TOGETHER characters, nulls and empty texts among them."""
    import pyarrow as pa

    own = pa.array(["a" * 100, None, "", "b" * segment.TOGETHER, "c", None, "d" * (2 * segment.TOGETHER), "", "e"])
    cut = list(segment.parts(own))
    assert pa.concat_arrays(cut) == own and [len(x) for x in cut] == [3, 1, 2, 1, 2]
    assert list(segment.parts(own.slice(0, 0))) == []
    lexicon = spark.createDataFrame([("ab", "x", 1)], "surface string, reading string, cost int")
    rows = [(k, None if k % 7 == 0 else "abz" * (k * 300)) for k in range(40)]
    df = spark.createDataFrame(rows, "i long, text string").coalesce(1).select("i", segment.segmenter(lexicon)(F.col("text")).alias("t"))
    for r in df.collect():
        assert r.t == (None if rows[r.i][1] is None else [("ab", "x"), ("z", None)] * (r.i * 300))
