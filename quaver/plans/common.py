"""How the driver tables stand in for songs; shared by the named queries.

A document is a lyric text. A user's events are a song's beats: ``signup`` rows are tempo rows
(60 + whole value beats a minute), ``view`` rows punctuation, ``error`` rows separators, others
sung; an embedding is a signal of 64 samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.functions.timecode import epoch_ms


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts dealt by song before they are taken apart: the windows and groupings by song that
    follow need no exchange of the many rows, and a table of one file is worked on everywhere."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("song_id"), "text").repartition(n, "song_id")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for work on a row at a time: nothing is dealt by song. A table of fewer splits than cores, as one small
    file, is spread over them; a large one stays where it is read."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("song_id"), "text")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("song_id"), F.col("event_id").alias("ordinal"), epoch_ms(F.col("ts")).alias("t"), "event_type", "value")


def tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = beats(spark, sf_dir).where("event_type = 'signup'")
    return e.select("song_id", "ordinal", F.col("t").alias("start_ms"), (F.lit(60) + F.floor("value")).cast("double").alias("bpm"))


def kinded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats with a kind; a sung beat whose value is under 20 is unset."""
    kind = F.when(F.col("event_type") == "view", "punctuation").when(F.col("event_type") == "error", "space").otherwise("sung")
    unset = (F.col("event_type") == "click") & (F.col("value") < 20)
    return beats(spark, sf_dir).select("song_id", "ordinal", F.col("t").alias("at"), kind.alias("kind"), F.when(~unset, F.col("t")).alias("t"))


#: The same as common table expressions.
SQL_BEATS = """beats AS (
  SELECT user_id AS song_id, event_id AS ordinal, epoch_us(ts) // 1000 AS t, event_type, value FROM events
), tempo AS (
  SELECT song_id, ordinal, t AS start_ms, (60 + floor(value))::DOUBLE AS bpm FROM beats WHERE event_type = 'signup'
), kinded AS (
  SELECT song_id, ordinal, t AS place,
    CASE event_type WHEN 'view' THEN 'punctuation' WHEN 'error' THEN 'space' ELSE 'sung' END AS kind,
    CASE WHEN NOT (event_type = 'click' AND value < 20) THEN t END AS t
  FROM beats
)"""
BLANK_SQL = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
SQL_TOKENS = rf"""runs AS (
  SELECT doc_id AS song_id, regexp_extract_all(coalesce(text, ''), '[ \t\n\r\x{{3000}}]+|[^ \t\n\r\x{{3000}}]+') AS r FROM documents
), tokens AS (
  SELECT song_id, list_transform(r, lambda x: CASE
    WHEN regexp_replace(x, '^{BLANK_SQL}+|{BLANK_SQL}+$', '', 'g') <> '' THEN regexp_replace(x, '^{BLANK_SQL}+|{BLANK_SQL}+$', '', 'g')
    WHEN contains(x, chr(10)) THEN chr(10) ELSE ' ' END) AS w FROM runs
), closed AS (
  SELECT song_id, CASE WHEN len(w) > 0 AND w[len(w)] = chr(10) THEN w ELSE list_append(w, chr(10)) END AS w FROM tokens
), words AS (
  SELECT song_id, unnest(range(len(w)))::INT AS word_idx, unnest(w) AS reading FROM closed
)"""
