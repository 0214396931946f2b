"""Queries on single words, readings, tags and forms: over the tokens of documents and over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.functions import text as T
from quaver.functions import word as W
from quaver.functions.units import ruby_units as units
from quaver.operators import edit, timeline, words
from quaver.plans.common import SQL_BEATS, SQL_TOKENS, kinded, songs, table
from quaver.plans.words import shown
from quaver.sources import files, lyrics

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- single words -------------------------------------------------------------------------------


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song_id, word_idx, word: tokens of one syllable or, every second word of two letters and more, of two with a
    reading of their own; a third of the first syllables and a quarter of the second ones aren't set."""
    own = words.from_text(songs(spark, sf_dir))
    k = F.col("word_idx").cast("bigint")
    one, two = F.when(k % 3 != 2, k * 100), F.when(k % 4 != 1, k * 100 + 50)
    many = ~T.is_separator(F.col("reading")) & (k % 2 == 0) & (F.length("reading") > 1)
    parts = F.array(W.syllable(F.substring("reading", 1, 1), one), W.syllable(F.expr("substring(reading, 2)"), two))
    return own.select("song_id", "word_idx", F.when(many, W.with_syllables(F.col("reading"), parts, True, False)).otherwise(W.word(F.col("reading"), one)).alias("word"))


_SQL_WORDS = (
    SQL_TOKENS
    + """, told AS (
  SELECT *, reading IN (' ', chr(10)) AS sep, reading NOT IN (' ', chr(10)) AND word_idx % 2 = 0 AND length(reading) > 1 AS two,
    CASE WHEN word_idx % 3 <> 2 THEN word_idx::BIGINT * 100 END AS t1, CASE WHEN word_idx % 4 <> 1 THEN word_idx::BIGINT * 100 + 50 END AS t2 FROM words
), own AS (
  SELECT *, CASE WHEN two THEN [{'r': reading[1], 't': t1}, {'r': reading[2:], 't': t2}] ELSE [{'r': reading, 't': t1}] END AS s, two AS ruby, NOT two AS auto FROM told
)"""
)


@query(
    f"""WITH {_SQL_WORDS}, edited AS (
  SELECT song_id, word_idx, word_idx % 13 AS op, ruby, auto, sep, reading, s, CASE word_idx % 13
    WHEN 0 THEN CASE WHEN auto AND NOT sep THEN [{{'r': reading || '2', 't': t1}}] ELSE s END
    WHEN 1 THEN CASE WHEN sep THEN s ELSE list_transform(s, lambda x, i: CASE WHEN i = 2 THEN {{'r': 'k', 't': x.t}} ELSE x END) END
    WHEN 2 THEN list_transform(s, lambda x, i: CASE WHEN i = 1 THEN {{'r': x.r, 't': 7::BIGINT}} ELSE x END)
    WHEN 3 THEN list_transform(s, lambda x, i: CASE WHEN i = 2 THEN {{'r': x.r, 't': NULL::BIGINT}} ELSE x END)
    WHEN 4 THEN list_transform(s, lambda x, i: CASE WHEN i = 1 AND x.t IS NOT NULL THEN {{'r': x.r, 't': greatest(x.t - 1300, 0)}} ELSE x END)
    WHEN 5 THEN list_transform(s, lambda x, i: CASE WHEN i = 1 THEN {{'r': x.r, 't': coalesce(x.t, 0) + 10}} ELSE x END)
    WHEN 6 THEN list_transform(s, lambda x: {{'r': x.r, 't': CASE WHEN x.t IS NOT NULL THEN greatest(x.t - 1100, 0) END}})
    WHEN 7 THEN list_transform(s, lambda x: {{'r': x.r, 't': NULL::BIGINT}})
    WHEN 8 THEN [{{'r': 'p', 't': t1}}, {{'r': 'q', 't': CASE WHEN two THEN t2 END}}, {{'r': 'z', 't': NULL}}]
    WHEN 9 THEN [{{'r': 'p', 't': t1}}]
    WHEN 10 THEN [{{'r': reading, 't': NULL}}] WHEN 11 THEN [{{'r': reading, 't': NULL}}] ELSE s END AS e
  FROM own
)
SELECT song_id, word_idx, reading || CASE WHEN op = 0 AND NOT sep THEN '2' ELSE '' END || '|' || array_to_string(list_transform(e, lambda x: x.r || '@' || coalesce(x.t::VARCHAR, '')), ',') || '|'
  || CASE WHEN op IN (8, 9) OR (op = 1 AND NOT sep) OR (op NOT IN (10, 11) AND ruby) THEN 'r' ELSE '' END || '|'
  || CASE WHEN op IN (10, 11) OR (NOT (op IN (8, 9) OR (op = 1 AND NOT sep)) AND auto) THEN 'a' ELSE '' END AS word FROM edited"""
)
def word_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edit of a single word, each on one word in thirteen."""
    w, n, s = F.col("word"), lambda x: F.lit(x).cast("bigint"), F.lit
    text = F.concat(w["reading"], s("2"))
    edits = [
        W.retexted(w, text), W.reread(w, s(1), s("k")), W.timed(w, s(0), n(7)), W.timed(w, s(1), None), W.syllable_shifted(w, s(0), n(-1300)), W.syllable_shifted(w, s(0), n(10), True), W.word_shifted(w, n(-1100)),
        W.word_reset(w), W.ruby_saved(w, F.array(s("p"), s("q"), s("z"))), W.ruby_saved(w, F.array(s("p"))), W.ruby_reset(w), W.with_syllables(w["reading"], F.slice(w["syllables"], 1, 0), True, False),
    ]
    out = w
    for k, edited in enumerate(edits):
        out = F.when(F.col("word_idx") % 13 == k, edited).otherwise(out)
    return _words(spark, sf_dir).select("song_id", "word_idx", out.alias("word")).select("song_id", "word_idx", shown(F.col("word")).alias("word"))


@query(
    f"""WITH {_SQL_WORDS} SELECT song_id, word_idx, t1 AS start_t, len(s)::INT AS n_syllables, t1 IS NOT NULL AND (NOT two OR t2 IS NOT NULL) AS fully_set, t1 IS NULL AND (NOT two OR t2 IS NULL) AS fully_unset,
  CASE reading WHEN ' ' THEN '␣' WHEN chr(10) THEN '¶' ELSE reading END AS glyph, CASE WHEN two THEN reading ELSE '' END AS caption, coalesce(t1, 0) AS seek FROM own"""
)
def word_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    return _words(spark, sf_dir).select(
        "song_id", "word_idx", W.start_time(w).alias("start_t"), W.n_syllables(w).alias("n_syllables"), W.fully_set(w).alias("fully_set"), W.fully_unset(w).alias("fully_unset"), W.glyph(w["reading"]).alias("glyph"),
        W.caption(w).alias("caption"), W.seek_target(W.start_time(w)).alias("seek"),
    )


@query(
    f"""WITH {SQL_TOKENS} SELECT song_id, word_idx, CASE word_idx % 4 WHEN 0 THEN CASE WHEN word_idx % 8 = 0 THEN chr(10) ELSE ' ' END ELSE CASE WHEN reading IN (' ', chr(10)) THEN reading ELSE reading || 's' END END AS reading FROM words"""
)
def texts_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a finished text edit makes of a word: a newline, a blank, or the text without its blanks."""
    own = words.from_text(songs(spark, sf_dir)).select("song_id", "word_idx", W.word(F.col("reading")).alias("word"))
    k = F.col("word_idx")
    typed = F.when(k % 8 == 0, " \n ").when(k % 4 == 0, "　").otherwise(F.when(T.is_separator(F.col("word.reading")), F.col("word.reading")).otherwise(F.concat(F.lit(" "), "word.reading", F.lit("　s "))))
    return own.select("song_id", "word_idx", edit.finished_text(typed).alias("reading"))


# --- scripts and readings -----------------------------------------------------------------------

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SCRIPT = "あ恋ラーヶカ食べ月出きゃょュいこちう茶物思見るタゲん"
_MIXED = "あ恋恋恋き茶茶茶む物物物見見す見月月月出ゃ出出思思思"
_SAID = {"恋": "コイ", "茶": "チョ", "物": "モノ", "見": "ミ", "月": "ツ", "出": "デ", "思": "オモ"}


@query(
    rf"""WITH {SQL_TOKENS}, s AS (SELECT song_id, word_idx, translate(lower(reading), '{_LETTERS}', '{_SCRIPT}') AS s FROM words WHERE reading NOT IN (' ', chr(10)))
SELECT song_id, word_idx, regexp_matches(s, '[\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}]') AS kanji, regexp_matches(s, '^[\x{{3040}}-\x{{30f4}}\x{{30f7}}-\x{{30ff}}]+$') AS kana FROM s"""
)
def scripts_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents, their letters put for kana, small kana, the long mark and kanji."""
    own = words.from_text(songs(spark, sf_dir)).where(~T.is_separator(F.col("reading")))
    s = F.translate(F.lower("reading"), _LETTERS, _SCRIPT)
    return own.select("song_id", "word_idx", T.has_kanji(s).alias("kanji"), T.is_kana(s).alias("kana"))


@query(
    rf"""WITH {SQL_TOKENS}, s AS (
  SELECT translate(regexp_replace(lower(reading), '[^a-z]', '', 'g'), '{_LETTERS}', '{_MIXED}') AS surface, count(*) AS n FROM words WHERE reading NOT IN (' ', chr(10)) GROUP BY ALL
), parts AS (
  SELECT surface, n, CASE WHEN regexp_matches(surface, '[^あきむすゃ]') THEN regexp_extract_all(surface, '[^あきむすゃ]+|.') ELSE regexp_extract_all(surface, '.ゃ*') END AS p FROM s WHERE surface <> ''
), said AS (
  SELECT surface, n, p, list_transform(p, lambda x: CASE WHEN regexp_matches(x, '[^あきむすゃ]') THEN regexp_extract_all({"".join("replace(" for _ in _SAID)}x{"".join(f", '{k}', '{''.join(chr(ord(c) - 0x60) for c in v)}')" for k, v in _SAID.items())}, '.ょ*') ELSE [] END) AS r FROM parts
)
SELECT surface, n, array_to_string(list_transform(p, lambda x, i: x || '=' || array_to_string(r[i], ',')), '|') AS units FROM said"""
)
def ruby_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of words with a katakana reading: letters of documents' words put for kana and kanji."""
    own = words.from_text(songs(spark, sf_dir)).where(~T.is_separator(F.col("reading")))
    rows = own.select(F.translate(F.regexp_replace(F.lower("reading"), "[^a-z]", ""), _LETTERS, _MIXED).alias("surface")).where("surface <> ''").groupBy("surface").agg(F.count(F.lit(1)).alias("n"))
    said = F.col("surface")
    for kanji, reading in _SAID.items():
        said = F.replace(said, F.lit(kanji), F.lit(reading))
    kana = F.translate(said, "あきむすゃ", "アキムスャ")
    rows = rows.select("surface", "n", units(F.col("surface"), kana).alias("u"))
    return rows.select("surface", "n", F.array_join(F.transform("u", lambda x: F.concat(x["surface"], F.lit("="), F.array_join(x["readings"], ","))), "|").alias("units"))


# --- stamped texts ------------------------------------------------------------------------------

_FIRST = r"(\p{L}+)"
_SQL_FIRST = r"SELECT doc_id AS song_id, coalesce(nullif(regexp_extract(coalesce(text, ''), '(\p{L}+)', 1), ''), 'w') AS w, doc_id % 50 AS m, (doc_id // 50) % 60 AS s, coalesce(nullif(trim(lang), ''), 'x') AS lang FROM documents"


def _firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song_id, w (the text's first word), m and s (of the id), lang."""
    word = F.regexp_extract(F.coalesce("text", F.lit("")), _FIRST, 1)
    lang = F.trim(F.coalesce("lang", F.lit("")))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("song_id"), F.when(word == "", "w").otherwise(word).alias("w"), (F.col("doc_id") % 50).alias("m"), (F.floor(F.col("doc_id") / 50) % 60).alias("s"), F.when(lang == "", "x").otherwise(lang).alias("lang")
    )


def _stamp(m, s, cs: str):
    return F.concat(F.lit("["), F.lpad(m.cast("string"), 2, "0"), F.lit(":"), F.lpad(s.cast("string"), 2, "0"), F.lit(f":{cs}]"))


_SQL_STAMP = "'[' || lpad({m}::VARCHAR, 2, '0') || ':' || lpad(s::VARCHAR, 2, '0') || ':{cs}]'"


@query(
    f"""WITH f AS ({_SQL_FIRST}) SELECT song_id, {_SQL_STAMP.format(m="m", cs="05")} || w || {_SQL_STAMP.format(m="m", cs="50")} || 'が' || {_SQL_STAMP.format(m="(m + 1)", cs="00")} || w || {_SQL_STAMP.format(m="(m + 2)", cs="00")}
  || chr(10) || chr(10) || '@Title=T' || song_id || chr(10) || '@SilenceMsec=' || m + 1 || chr(10) || '@mood=' || lang || chr(10) || '@Ruby1=' || w || ',y[00:00:20]z' || chr(10) AS text FROM f"""
)
def stamped_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of each document's first word, title and language that is read and written again comes out the same."""
    c = F.col
    text = F.concat(
        _stamp(c("m"), c("s"), "05"), c("w"), _stamp(c("m"), c("s"), "50"), F.lit("が"), _stamp(c("m") + 1, c("s"), "00"), c("w"), _stamp(c("m") + 2, c("s"), "00"), F.lit("\n\n@Title=T"), c("song_id").cast("string"),
        F.lit("\n@SilenceMsec="), (c("m") + 1).cast("string"), F.lit("\n@mood="), c("lang"), F.lit("\n@Ruby1="), c("w"), F.lit(",y[00:00:20]z\n"),
    )
    rows = _firsts(spark, sf_dir).select("song_id", text.alias("text"))
    return lyrics.to_stamped(lyrics.stamped_lyrics(rows), lyrics.stamped_metadata(rows)).select("song_id", "text")


@query(
    f"""WITH f AS ({_SQL_FIRST}) SELECT song_id, (m + 1)::INT AS idx, w AS base, 0::BIGINT AS valid_from, NULL::BIGINT AS valid_to, 'y|z' AS texts, '0|200' AS offsets FROM f
UNION ALL SELECT song_id, 100, w || 'b', (m * 60 + s) * 1000 + 50, (m * 60 + s) * 1000 + 60990, 'x', '0' FROM f
UNION ALL SELECT song_id, 101, lang, 0, (m * 60 + s) * 1000 + 500, 'y|z|w', '0|0|' || s * 1000 + 100 FROM f"""
)
def ruby_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    lines = F.concat_ws(
        "\n", F.concat(F.lit("@Ruby"), (c("m") + 1).cast("string"), F.lit("="), c("w"), F.lit(",y[00:00:20]z")), F.concat(F.lit("@Ruby100= "), c("w"), F.lit("b , x ,"), _stamp(c("m"), c("s"), "05"), F.lit(","), _stamp(c("m") + 1, c("s"), "99")),
        F.lit("@ruby3=q,q"), F.concat(F.lit("@Ruby101="), c("lang"), F.lit(",y[0:0:0]z"), _stamp(F.lit(0), c("s"), "10"), F.lit("w,,"), _stamp(c("m"), c("s"), "50")), F.lit("@Ruby11=,x"), F.lit("@Ruby12=d"),
    )
    out = lyrics.ruby_rules(_firsts(spark, sf_dir).select("song_id", lines.alias("text")))
    return out.select("song_id", "idx", "base", "valid_from", "valid_to", F.array_join("texts", "|").alias("texts"), F.array_join(F.transform("offsets_ms", lambda x: x.cast("string")), "|").alias("offsets"))


# --- forms, fills, sound ------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT event_id, event_id % 8 AS k, floor(value * 10)::BIGINT AS v, event_id % 60 AS s FROM events)
SELECT event_id, CASE k WHEN 0 THEN v / 10.0 WHEN 3 THEN v WHEN 4 THEN v * 60000 + s * 1000 + 500 WHEN 7 THEN v END::DOUBLE AS value FROM e"""
)
def tempo_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v, two = F.col("event_id") % 8, F.floor(F.col("value") * 10), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0")
    digits, s = v.cast("string"), F.lit
    tenths = F.concat(F.floor(v / 10).cast("string"), s("."), (v % 10).cast("string"))
    kind = F.when(k < 3, "bpm").when(k == 3, "new").otherwise("time")
    raw = F.when(k == 0, F.concat(s(" "), tenths, s("x"))).when(k == 1, F.concat(s("-1"), digits)).when(k == 2, F.concat(s("x"), digits)).when(k == 4, F.concat(digits, s(":"), two, s(".5"))).when(k == 5, "abc").when(k == 6, F.concat(s("-"), digits, s(":01"))).otherwise(digits)
    return table(spark, sf_dir, "events").select("event_id", edit.tempo_form(kind, raw).alias("value"))


@query(
    f"""WITH {SQL_BEATS}, own AS (
  SELECT song_id, ordinal, place, t, CASE WHEN lead(ordinal) OVER w IS NULL AND song_id % 3 > 0 OR kind = 'space' AND ordinal % 2 = 0 THEN 'newline' ELSE kind END AS kind FROM kinded WINDOW w AS (PARTITION BY song_id ORDER BY place, ordinal)
), n AS (
  SELECT *, lag(kind) OVER w AS lk, lead(kind) OVER w AS rk, lag(t) OVER w AS lt, lead(t) OVER w AS rt FROM own WINDOW w AS (PARTITION BY song_id ORDER BY place, ordinal)
), sep AS (SELECT *, kind IN ('space', 'newline') AS s, lk NOT IN ('space', 'newline') AND lt IS NOT NULL AS l, rk NOT IN ('space', 'newline') AND rt IS NOT NULL AS r FROM n)
SELECT song_id, ordinal, CASE WHEN NOT s THEN t WHEN rk IS NULL AND kind = 'newline' AND l THEN lt + 500 WHEN l AND r THEN (lt + rt) // 2 ELSE t END AS inferred FROM sep"""
)
def infer_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs with newlines among their separators, two of three with one at the end."""
    from pyspark.sql import Window

    last = F.lead("ordinal").over(Window.partitionBy("song_id").orderBy("at", "ordinal")).isNull()
    kind = F.when((last & (F.col("song_id") % 3 > 0)) | ((F.col("kind") == "space") & (F.col("ordinal") % 2 == 0)), "newline").otherwise(F.col("kind"))
    return timeline.infer_separators(kinded(spark, sf_dir).withColumn("kind", kind), ["at", "ordinal"]).select("song_id", "ordinal", "inferred")


@query(
    """SELECT vec_id AS song_id, 0::INT AS channel, unnest(range(len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings
UNION ALL SELECT vec_id, 1, unnest(range(len(embedding)))::INT, unnest(list_reverse(embedding))::DOUBLE FROM embeddings WHERE vec_id % 2 = 0"""
)
def wav_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of one or two channels, written as interleaved WAV files and read back in blocks."""
    own = F.col("embedding").cast("array<double>")
    channels = F.when(F.col("vec_id") % 2 == 0, F.array(own, F.reverse(own))).otherwise(F.array(own))
    sound = files.write_wav(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("song_id"), channels.alias("samples")), 16_000)
    rows = files.wav_blocks(sound, 24).select("song_id", "channel", "first", F.posexplode("samples").alias("k", "x"))
    return rows.select("song_id", "channel", (F.col("first") + F.col("k")).cast("int").alias("i"), "x")


# --- segmentation -------------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT doc_id AS song_id, regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g') AS s FROM documents)
SELECT song_id, length(s)::INT AS n_chars, md5(s) AS joined_md5 FROM s"""
)
def text_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's letters without a blank between them, taken apart by a lexicon of its table's 20,000 most frequent
    words; the parts make the text again. Which parts they are is held against exhaustive search in the tests."""
    from quaver.operators.segment import segmenter

    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("song_id"), F.lower(F.coalesce("text", F.lit(""))).alias("s"))
    found = own.select(F.explode(F.regexp_extract_all("s", F.lit("[a-z]{2,}"), F.lit(0))).alias("surface")).groupBy("surface").agg(F.count(F.lit(1)).alias("n"))
    lexicon = found.orderBy(F.desc("n"), "surface").limit(20_000)
    tokens = segmenter(lexicon.select("surface", F.lit(None).cast("string").alias("reading"), (F.lit(1000) - F.least("n", F.lit(900))).alias("cost")))
    rows = own.repartition(spark.sparkContext.defaultParallelism).select("song_id", tokens(F.regexp_replace("s", "[^a-z]", "")).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: x["surface"]), "")
    return rows.select("song_id", F.length(joined).alias("n_chars"), F.md5(joined).alias("joined_md5"))
