"""Edits of a song's array against the same edits of a table of words."""

import random

import pytest
from pyspark.sql import functions as F

from quaver.functions import song
from quaver.functions import word as W
from quaver.operators import edit, words
from quaver.plans import registry

RULES = ("split", "retext", "tab", "paste", "paste_before")


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    some = ["", " ", "\n", "a", "a b", "ab  \n cd", " "] + ["".join(rng.choice("ab é恋は,. \n\t　 ") for _ in range(rng.randint(1, 80))) for _ in range(60)]
    return spark.createDataFrame([(k, x) for k, x in enumerate([*some, None])], "song_id long, text string").cache()


def rows_of(df, *columns):
    return sorted((r.song_id, r.word_idx, *(r[c] for c in columns)) for r in df.collect())


@pytest.mark.parametrize("rule", RULES)
def test_array_edits_equal_table_edits(texts, rule):
    t = lambda i: F.when(i % 3 != 2, i.cast("bigint") * 100)
    table = words.from_text(texts).withColumn("t", t(F.col("word_idx")))
    own = texts.select("song_id", song.words(F.col("text"), t).alias("w"))
    at = F.col("word_idx")
    new = lambda i: F.when(i % 4 == 1, F.concat(F.lit(" e "), i.cast("string"))).when(i % 4 == 2, " \t").when(i % 8 == 3, "　x")
    edits = table.where(new(at).isNotNull()).select("song_id", "word_idx", new(at).alias("text"))
    half = lambda i: F.when(i % 2 == 0, "a").when(i % 3 == 0, "ab")
    chosen = lambda i: (i % 7).isin(2, 5)
    by_table, by_array = {
        "split": lambda: (edit.split_in_two(table, table.where(at % 5 != 0).select("song_id", "word_idx", half(at).alias("left"))), song.split_in_two(F.col("w"), lambda _, i: i % 5 != 0, lambda _, i: half(i))),
        "retext": lambda: (edit.retexted(table, edits), song.retexted(F.col("w"), lambda _, i: new(i))),
        "tab": lambda: (edit.tabbed(table, edits), song.tabbed(F.col("w"), lambda _, i: new(i))),
        "paste": lambda: (edit.pasted(table, table.where(chosen(at))), song.pasted(F.col("w"), lambda _, i: chosen(i))),
        "paste_before": lambda: (edit.pasted(table, table.where(chosen(at)), before=True), song.pasted(F.col("w"), lambda _, i: chosen(i), before=True)),
    }[rule]()
    got = own.select("song_id", F.posexplode(by_array).alias("word_idx", "x")).select("song_id", "word_idx", "x.reading", F.col("x.t").alias("t"))
    assert [tuple(map(str, r)) for r in rows_of(got, "reading", "t")] == [tuple(map(str, r)) for r in rows_of(by_table, "reading", "t")]


@pytest.mark.parametrize("with_ruby", [True, False])
def test_array_words_with_syllables_equal_table_words(texts, with_ruby):
    make = lambda r, i: W.with_syllables(r, F.array(W.syllable(r, F.when(i % 3 != 2, i.cast("bigint")))), i % 5 == 0, i % 5 != 0)
    table = words.from_text(texts).select("song_id", "word_idx", make(F.col("reading"), F.col("word_idx")).alias("word"))
    own = texts.select("song_id", F.transform(song.words(F.col("text"), lambda i: i.cast("bigint")), lambda x, i: make(x["reading"], i)).alias("w"))
    unit = lambda s, *r: F.struct(F.lit(s).alias("surface"), F.array(*map(F.lit, r)).cast("array<string>").alias("readings"))
    units = lambda i: F.when(i % 4 == 1, F.array(unit("恋", "こ", "い"), unit("は"))).when(i % 4 == 2, F.array(unit("x", "y"))).when(i % 4 == 3, F.array(unit("z", "z"), unit("z")).cast("array<struct<surface:string,readings:array<string>>>"))
    taken = table.select("song_id", "word_idx", F.posexplode(units(F.col("word_idx"))).alias("nth", "u")).select("song_id", "word_idx", "nth", "u.*")
    chosen = lambda s, i: F.when(s % 3 == 0, i.between(1, 4)).when(s % 3 == 1, i.isin(0, 2)).otherwise(i == 1)
    pairs = [
        (edit.segmented(table, taken, with_ruby), song.segmented(F.col("w"), lambda _, i: units(i), with_ruby)),
        (edit.merged_selection(table, table.where(chosen(F.col("song_id"), F.col("word_idx")))), song.merged(F.col("w"), lambda _, i: chosen(F.col("song_id"), i))),
    ]
    for by_table, by_array in pairs:
        got = own.select("song_id", F.posexplode(by_array).alias("word_idx", "word"))
        assert [tuple(map(str, r)) for r in rows_of(got, "word")] == [tuple(map(str, r)) for r in rows_of(by_table, "word")]


@pytest.mark.parametrize("name", ["words_segmented", "words_split", "words_pasted", "texts_edited", "words_tabbed", "words_merged"])
def test_edits_by_rule_move_no_words(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Join", "Sort", "Window", "Aggregate", "hashpartitioning", "Generate"))
