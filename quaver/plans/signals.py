"""Queries on signals in blocks (a label's embeddings, by vec_id, are one song, 64 samples a block) and on taps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.operators import blocks, rank, tempo, timeline
from quaver.plans.common import SQL_BEATS, kinded, table
from quaver.streaming import taps

QUERIES: dict = {}
SQL: dict[str, str] = {}

FRAME, HOP = 16, 8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("song_id"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    return blocks.placed(rows, ["vec_id"])


_SQL_SAMPLES = """pcm AS (
  SELECT label::BIGINT AS song_id, vec_id, embedding, sum(len(embedding)) OVER (PARTITION BY label ORDER BY vec_id) - len(embedding) AS first FROM embeddings
), x AS (SELECT song_id, first, first + unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM pcm
), total AS (SELECT song_id, count(*) AS n FROM x GROUP BY song_id)"""
_SQL_FRAMES = (
    _SQL_SAMPLES
    + f""", frames AS (SELECT song_id, unnest(range(greatest(1, (n - {FRAME}) // {HOP} + 1))) AS frame FROM total
), inside AS (
  SELECT f.song_id, f.frame, k, x.first, x.i, x.x FROM (SELECT *, unnest(range({FRAME})) AS k FROM frames) f JOIN x ON x.song_id = f.song_id AND x.i = f.frame * {HOP} + k
), rms AS (SELECT song_id, frame, sqrt(avg(x * x)) AS rms FROM inside GROUP BY ALL)"""
)
_SQL_FLUX = (
    _SQL_FRAMES
    + f""", waves AS (
  SELECT song_id, frame, q, x * (0.5 - 0.5 * cos(2 * pi() * k / {FRAME})) AS y, 2 * pi() * q * k / {FRAME} AS a FROM inside, (SELECT unnest(range({FRAME // 2 + 1})) AS q)
), level AS (SELECT song_id, frame, q, sqrt(pow(sum(y * cos(a)), 2) + pow(sum(y * sin(a)), 2)) AS m FROM waves GROUP BY ALL
), grown AS (SELECT *, greatest(m - lag(m) OVER (PARTITION BY song_id, q ORDER BY frame), 0) AS g FROM level
), flux AS (SELECT song_id, frame, coalesce(sum(g), 0) AS flux FROM grown GROUP BY ALL)"""
)


@query(f"WITH {_SQL_FLUX} SELECT song_id, frame, round(flux, 6) AS flux FROM flux")
def spectral_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.spectral_flux(_blocks(spark, sf_dir), FRAME, HOP).select("song_id", "frame", F.round("flux", 6).alias("flux"))


@query(
    f"""WITH RECURSIVE {_SQL_FLUX}, scaled AS (SELECT song_id, frame, flux / max(flux) OVER (PARTITION BY song_id) AS x FROM flux
), told AS (
  SELECT *, max(x) OVER (PARTITION BY song_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top, avg(x) OVER (PARTITION BY song_id ORDER BY frame ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS mean FROM scaled
), likely AS (SELECT song_id, frame FROM told WHERE x > 0 AND x = top AND x >= mean + 0.2
), walk AS (
  SELECT song_id, 0::BIGINT AS ordinal, min(frame) AS frame FROM likely GROUP BY song_id
  UNION ALL
  SELECT w.song_id, w.ordinal + 1, (SELECT min(l.frame) FROM likely l WHERE l.song_id = w.song_id AND l.frame > w.frame + 6) FROM walk w WHERE w.frame IS NOT NULL
) SELECT song_id, ordinal, frame, floor(frame * 80.0 + 0.5)::BIGINT AS t FROM walk WHERE frame IS NOT NULL"""
)
def onset_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At 100 samples a second."""
    return blocks.onsets(blocks.spectral_flux(_blocks(spark, sf_dir), FRAME, HOP), 100, HOP, delta=0.2)


def sample_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From samples to tempo segments, at 100 samples a second; held against plain code and planted clicks."""
    flux = blocks.spectral_flux(_blocks(spark, sf_dir), FRAME, HOP)
    return tempo.segments(blocks.tempo_curve(flux, 100, HOP, seconds=20.0, step=5.0))


QUERIES["sample_tempo"] = sample_tempo


@query(
    f"""WITH {_SQL_SAMPLES}, b AS (SELECT song_id, (i // (n // 50))::INT AS bucket, max(abs(x)) AS m FROM x JOIN total USING (song_id) WHERE i // (n // 50) < 50 GROUP BY ALL)
SELECT song_id, bucket, round(m / max(m) OVER (PARTITION BY song_id), 9) AS peak FROM b"""
)
def block_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.peaks(_blocks(spark, sf_dir), 50).select("song_id", "bucket", F.round("peak", 9).alias("peak"))


@query(
    f"""WITH {_SQL_SAMPLES}, b AS (SELECT song_id, (i // (n // 50))::INT AS bucket, max(abs(x)) AS m FROM x JOIN total USING (song_id) WHERE i // (n // 50) < 50 GROUP BY ALL),
p AS (SELECT song_id, bucket, m / max(m) OVER (PARTITION BY song_id) AS peak FROM b)
SELECT song_id, bucket, round(CASE WHEN bucket % 2 = 0 THEN peak ELSE -peak END, 9) AS y FROM p WHERE bucket >= 10 AND bucket < 30"""
)
def block_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.visible(blocks.peaks(_blocks(spark, sf_dir), 50), 10, 20).select("song_id", "bucket", F.round("y", 9).alias("y"))


@query(f"WITH {_SQL_FRAMES} SELECT song_id, round(quantile_cont(rms, 0.2), 9) AS threshold, count(*) AS n_frames FROM rms GROUP BY song_id")
def block_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ranges narrowed from 100 values on, so that every song takes the rounds."""
    rms = blocks.frame_rms(_blocks(spark, sf_dir), FRAME, HOP)
    found = rank.percentiles(rms, ["song_id"], "rms", 20.0, few=100)
    return found.join(rms.groupBy("song_id").agg(F.count(F.lit(1)).alias("n_frames")), "song_id").select("song_id", F.round("rms", 9).alias("threshold"), "n_frames")


@query(
    f"""WITH RECURSIVE {_SQL_FRAMES}, shut AS (SELECT song_id, quantile_cont(rms, 0.2) AS thr FROM rms GROUP BY song_id), goal AS (
  SELECT song_id, frame, CASE WHEN rms / greatest(thr, 1e-9) <= 1 THEN 0.0 ELSE least(1.0, (rms / greatest(thr, 1e-9) - 1) / 0.5) END::DOUBLE AS g FROM rms JOIN shut USING (song_id)
), walk AS (
  SELECT song_id, frame, g * CASE WHEN g > 0 THEN 0.6 ELSE 0.08 END::DOUBLE AS p FROM goal WHERE frame = 0
  UNION ALL SELECT o.song_id, o.frame, w.p + (o.g - w.p) * CASE WHEN o.g > w.p THEN 0.6 ELSE 0.08 END::DOUBLE FROM walk w JOIN goal o ON o.song_id = w.song_id AND o.frame = w.frame + 1
), gained AS (SELECT song_id, i, product(p) AS p FROM inside JOIN walk USING (song_id, frame) GROUP BY ALL)
SELECT song_id, first, count(*) AS n, round(sum(x * coalesce(p, 1)), 6) AS total, round(max(abs(x * coalesce(p, 1))), 6) AS loudest FROM x LEFT JOIN gained USING (song_id, i) GROUP BY song_id, first"""
)
def block_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks.gated(_blocks(spark, sf_dir), 20.0, FRAME, HOP)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    loudest = F.array_max(F.transform("samples", lambda x: F.abs(x)))
    return rows.select("song_id", "first", F.size("samples").cast("long").alias("n"), F.round(total, 6).alias("total"), F.round(loudest, 6).alias("loudest"))


# --- taps ----------------------------------------------------------------------------------------


@query(
    f"""WITH {SQL_BEATS}, words AS (
  SELECT song_id, row_number() OVER w - 1 AS word_idx, kind, place, lag(kind) OVER w AS k1, lag(kind, 2) OVER w AS k2, lead(kind) OVER w AS r1, lead(kind, 2) OVER w AS r2
  FROM kinded WINDOW w AS (PARTITION BY song_id ORDER BY place, ordinal)
), sung AS (
  SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY word_idx) - 1 AS beat_idx, floor(place // 1000000 + 2.5 + 0.5)::BIGINT AS t FROM words WHERE kind = 'sung'
), timed AS (SELECT *, lag(t) OVER (PARTITION BY song_id ORDER BY word_idx) AS before FROM sung)
SELECT song_id, beat_idx AS ordinal, 'beat' AS what, word_idx, 0::INT AS syl_idx, beat_idx, t FROM timed
UNION ALL SELECT song_id, beat_idx, 'separator', word_idx - 1, 0, NULL, (before + t) // 2 FROM timed WHERE k1 = 'space' AND k2 = 'sung'
UNION ALL SELECT song_id, beat_idx, 'pending', word_idx + 2, 0, beat_idx + 1, NULL FROM timed WHERE r1 = 'space' AND r2 = 'sung'"""
)
def tap_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs without times, tapped through: the tap stream over a table."""
    rows = kinded(spark, sf_dir)
    words = taps.words_of_beats(rows, F.col("kind"), F.lit(None), ["at", "ordinal"])
    beat = timeline.numbered_beats(rows, ["at", "ordinal"], F.col("kind") == "sung")
    presses = beat.select("song_id", F.col("beat_idx").cast("long").alias("ordinal"), F.floor(F.col("at") / 1_000_000).cast("double").alias("t"), F.lit(2.5).alias("compensation"), F.lit("tap").alias("action"), F.lit(None).cast("long").alias("beat"))
    return taps.tap_stream(presses, words)
