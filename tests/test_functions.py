"""Column functions against worked-out values."""

import pytest
from pyspark.sql import functions as F

from quaver.functions import text as T
from quaver.functions import timecode as C
from quaver.functions.units import units


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_parse_time(spark):
    pairs = {"": 0, "[01:02.5]": 62500, "01:02:345": 62345, "1:2,34": 62340, "12.3456": 12345, "[-0:01.5]": -1500, "5": 5, "250ms": 250, "-0:01.5": -1500, "+500": 500, "abc": 0, "01:02:03:04": 0, "9" * 30: 0}
    assert column(spark, pairs, C.parse_time) == list(pairs.values())
    assert column(spark, ["abc", "7", None], C.parse_time_strict) == [None, 7, None]


def test_format_time(spark):
    assert column(spark, [62345, -1500, 3723004, 6_000_000], C.format_time, "long") == ["[01:02.345]", "[-0:01.500]", "[62:03.004]", "[100:00.000]"]
    assert column(spark, [62345], lambda c: C.format_time(c, centiseconds=True), "long") == ["[01:02.34]"]
    assert column(spark, [62345], lambda c: C.format_time(c, ":", brackets=False), "long") == ["01:02:345"]
    assert column(spark, [125.9], C.format_seconds, "double") == ["2:05"]
    assert column(spark, [-2.5, 2.5], C.half_up, "double") == [-2, 3]


def test_tokens(spark):
    texts = ["Hello World\nfoo", "a \n b", "", None, " ", "x　y"]
    assert column(spark, texts, T.tokens) == [["Hello", " ", "World", "\n", "foo"], ["a", "\n", "b"], [], [], [" "], ["x", " ", "y"]]
    assert column(spark, texts[:3], lambda c: T.closed(T.tokens(c))) == [["Hello", " ", "World", "\n", "foo", "\n"], ["a", "\n", "b", "\n"], ["\n"]]


@pytest.mark.parametrize("wins, out", [(False, ["x", " ", "y", "\n"]), (True, ["x", "\n", "y", "\n"])])
def test_collapse(spark, wins, out):
    rows = spark.createDataFrame([(["x", "\n", " ", "y"],), (["x", " ", "\n", "y"],), ([],)], "w array<string>")
    found = [r.k for r in rows.select(T.collapsed(F.col("w"), wins).alias("k")).collect()]
    assert found == [out, ["x", "\n", "y", "\n"], ["\n"]]


def test_kinds_and_kana(spark):
    assert column(spark, [" ", "\n", "、。", "a.", "は"], T.kind) == ["space", "newline", "punctuation", "sung", "sung"]
    assert column(spark, ["ね」", "「a」b"], T.split_punctuation) == [["ね", "」"], ["「", "a", "」", "b"]]
    assert column(spark, ["きゃっとー"], T.morae) == [["きゃ", "っ", "と", "ー"]]
    assert column(spark, ["カラオケab"], T.hiragana) == ["からおけab"]
    assert column(spark, ["恋", "こい", "ヵ"], T.has_kanji) == [True, False, False]
    assert column(spark, ["恋", "こい", "ヵ"], T.is_kana) == [False, True, False]


def test_paths_and_progress(spark):
    assert column(spark, ["/a/b.c/song.mp3", "song", "a\\b.wav"], T.vocal_cache) == ["song-vocal.wav", "song-vocal.wav", "b-vocal.wav"]
    assert column(spark, ["PROGRESS 0.5", "PROGRESS 7", "x", None], T.progress) == [0.5, 1.0, None, None]
    assert column(spark, ["a\t\tb", " a"], T.aligner_text) == [" a  b", " a"]


def test_units():
    from quaver.functions.units import morae

    show = lambda x: [(u["surface"], u["readings"]) for u in x]
    assert show(units("食べ物", "タベモノ")) == [("食", ["た"]), ("べ", []), ("物", ["も", "の"])]
    assert show(units("見る", "x")) == [("見", ["x"])]  # a kana that the reading doesn't hold is left out
    assert units(None, None) == [] and show(units("恋", None)) == [("恋", ["恋"])]
    assert show(units("きょう", "キョウ")) == [("きょ", []), ("う", [])] and show(units("は", "ワ")) == [("は", ["わ"])]
    assert morae("きゃっとー") == ["きゃ", "っ", "と", "ー"]
