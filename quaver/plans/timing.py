"""Queries on timing: beats, tempo, gaps, repair, signals, alignment, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaver.functions import timecode as C
from quaver.functions import viewport
from quaver.operators import edit, history, lookup, signal, timeline
from quaver.operators import tempo as rates
from quaver.plans.common import SQL_BEATS, beats, kinded, table, tempo

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beats(spark, sf_dir).select("song_id", "ordinal", "t")


_SQL_ASOF = (
    SQL_BEATS
    + """, latest AS (
  SELECT b.song_id, b.ordinal, b.t, arg_max(p.start_ms, (p.start_ms, p.ordinal)) AS start_ms, arg_max(p.bpm, (p.start_ms, p.ordinal)) AS bpm
  FROM beats b LEFT JOIN tempo p ON p.song_id = b.song_id AND p.start_ms <= b.t GROUP BY b.song_id, b.ordinal, b.t
)"""
)


def _snap_sql(denominator: int) -> str:
    return f"""CASE WHEN start_ms IS NULL OR bpm <= 0 THEN t ELSE floor(greatest(start_ms + floor((t - start_ms) / (60000.0::DOUBLE / bpm / {denominator}) + 0.5) * (60000.0::DOUBLE / bpm / {denominator}), 0) + 0.5) END::BIGINT"""


@query(
    f"""WITH {_SQL_ASOF}, snapped AS (SELECT *, {_snap_sql(8)} AS snapped FROM latest)
SELECT song_id, ordinal, (row_number() OVER (PARTITION BY song_id ORDER BY t, ordinal) - 1)::INT AS beat_idx, t, bpm, snapped,
  coalesce(lead(snapped) OVER (PARTITION BY song_id ORDER BY snapped, ordinal), max(t) OVER (PARTITION BY song_id)) AS "end" FROM snapped"""
)
def beat_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.beat_timeline(_points(spark, sf_dir), tempo(spark, sf_dir))


@query(
    f"""WITH {_SQL_ASOF}, firsts AS (SELECT song_id, arg_min(bpm, (start_ms, ordinal)) AS first_bpm FROM tempo GROUP BY song_id)
SELECT a.song_id, a.ordinal, a.t, a.start_ms::DOUBLE AS start_ms, a.bpm, coalesce(a.bpm, f.first_bpm) AS bpm_or_first FROM latest a LEFT JOIN firsts f USING (song_id)"""
)
def tempo_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.asof_tempo(_points(spark, sf_dir), tempo(spark, sf_dir), both=True)


@query(
    f"""WITH {SQL_BEATS} SELECT b.song_id, b.ordinal, b.t, max(p.start_ms) FILTER (p.start_ms < b.t)::DOUBLE AS prev_start, min(p.start_ms) FILTER (p.start_ms > b.t)::DOUBLE AS next_start
FROM beats b LEFT JOIN tempo p USING (song_id) GROUP BY ALL"""
)
def tempo_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.neighbours(_points(spark, sf_dir), tempo(spark, sf_dir))


@query(
    f"""WITH {SQL_BEATS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY start_ms, ordinal) - 1 AS i FROM tempo)
SELECT b.song_id, b.ordinal, b.t, arg_min(n.i, (abs(n.start_ms - b.t), n.i))::INT AS seg_idx FROM beats b LEFT JOIN numbered n USING (song_id) GROUP BY b.song_id, b.ordinal, b.t"""
)
def tempo_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.nearest(_points(spark, sf_dir), tempo(spark, sf_dir))


@query(f"WITH {_SQL_ASOF} SELECT ordinal, {_snap_sql(4)} AS s4, {_snap_sql(16)} AS s16, {_snap_sql(32)} AS s32 FROM latest")
def snap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookup.asof_tempo(_points(spark, sf_dir), tempo(spark, sf_dir))
    grid = lambda d: C.half_up(timeline.on_grid(F.col("t"), F.col("start_ms"), F.col("bpm"), d)).cast("bigint").alias(f"s{d}")
    return rows.select("ordinal", grid(4), grid(16), grid(32))


@query(
    f"""WITH {SQL_BEATS} SELECT song_id, ordinal, CASE WHEN kind = 'punctuation' THEN coalesce(first_value(CASE WHEN kind = 'sung' THEN t END IGNORE NULLS)
  OVER (PARTITION BY song_id ORDER BY place, ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), t) ELSE t END AS filled FROM kinded"""
)
def fill_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.fill_punctuation(kinded(spark, sf_dir), ["at", "ordinal"]).select("song_id", "ordinal", "filled")


@query(
    f"""WITH {SQL_BEATS}, n AS (
  SELECT *, lag(kind) OVER w AS lk, lead(kind) OVER w AS rk, lag(t) OVER w AS lt, lead(t) OVER w AS rt FROM kinded WINDOW w AS (PARTITION BY song_id ORDER BY place, ordinal)
) SELECT song_id, ordinal, CASE WHEN kind <> 'space' THEN t WHEN lk <> 'space' AND rk <> 'space' AND lt IS NOT NULL AND rt IS NOT NULL THEN (lt + rt) // 2 ELSE t END AS inferred FROM n"""
)
def infer_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.infer_separators(kinded(spark, sf_dir), ["at", "ordinal"]).select("song_id", "ordinal", "inferred")


@query(
    f"""WITH {SQL_BEATS}, n AS (
  SELECT *, place + (ordinal % 7 - 3) * 40000000 AS target, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY song_id ORDER BY place, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low,
    coalesce(first_value(t IGNORE NULLS) OVER (PARTITION BY song_id ORDER BY place, ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 9007199254740991) AS high FROM kinded
) SELECT song_id, ordinal, CASE WHEN t IS NOT NULL THEN greatest(low + 1, least(high - 1, target)) END AS clamped FROM n"""
)
def clamp_drag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kinded(spark, sf_dir).withColumn("target", F.col("at") + (F.col("ordinal") % 7 - 3) * 40_000_000)
    return timeline.clamped(rows, "target", ["at", "ordinal"]).select("song_id", "ordinal", "clamped")


@query(
    f"""WITH {SQL_BEATS}, jittered AS (SELECT song_id, ordinal, t // 1000000 + ordinal % 5 * 40 AS x FROM beats), lists AS (
  SELECT song_id, list(x ORDER BY ordinal) AS xs, list(ordinal ORDER BY ordinal) AS os FROM jittered GROUP BY song_id
), folded AS (
  SELECT song_id, os, xs, list_reduce(list_transform(xs, lambda x: [x]), lambda a, b: list_append(a, CASE WHEN b[1] < a[len(a)] THEN a[len(a)] + 1 ELSE b[1] END)) AS ys FROM lists
) SELECT song_id, unnest(os) AS ordinal, unnest(xs) AS x, unnest(ys) AS repaired FROM folded"""
)
def monotone_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = beats(spark, sf_dir).select("song_id", "ordinal", (F.floor(F.col("t") / 1_000_000) + F.col("ordinal") % 5 * 40).alias("x"))
    return timeline.monotone(rows, "x", ["ordinal"])


@query(
    f"""WITH {SQL_BEATS}, n AS (
  SELECT *, coalesce(t > max(t) OVER (PARTITION BY song_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS rises FROM kinded WHERE kind = 'sung'
) SELECT song_id, count(*) AS n_beats, count(t) AS n_set, count(*) FILTER (t IS NULL) AS n_unset, bool_and(t IS NOT NULL) AS fully_timed, bool_and(rises) AS rising FROM n GROUP BY song_id"""
)
def timing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.audit(kinded(spark, sf_dir).where("kind = 'sung'"), ["ordinal"])


@query(
    f"""WITH {SQL_BEATS}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY song_id ORDER BY t, ordinal) AS gap FROM beats), a AS (
  SELECT song_id, count(*) AS n, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS l, avg(gap) AS m FROM g GROUP BY song_id
), b AS (SELECT song_id, n, CASE WHEN n > 1 THEN l[len(l) // 2 + 1] END AS d, m FROM a)
SELECT song_id, n, CASE WHEN n < 2 THEN 0.0 WHEN d > 0 THEN least(greatest(floor(60000.0 / d + 0.5), 20), 300) ELSE 300.0 END::DOUBLE AS bpm_median,
  CASE WHEN n < 2 THEN 0.0 WHEN m > 0 THEN least(greatest(floor(60000.0 / m + 0.5), 20), 300) ELSE 300.0 END::DOUBLE AS bpm_mean FROM b"""
)
def bpm_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.bpm_of_ticks(_points(spark, sf_dir))


_SQL_CURVE = SQL_BEATS + ", curve AS (SELECT song_id, ordinal, row_number() OVER (PARTITION BY song_id ORDER BY ordinal) - 1 AS i, 60 + value / 4 AS tempo FROM beats)"


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("song_id").orderBy("ordinal")) - 1
    return beats(spark, sf_dir).select("song_id", "ordinal", i.cast("double").alias("t_s"), (F.lit(60) + F.col("value") / 4).alias("tempo"))


@query(
    rf"""WITH RECURSIVE {_SQL_CURVE}, walk AS (
  SELECT song_id, i, floor(tempo * 10 + 0.5) / 10 AS first, i AS start, 1 AS n, tempo AS total FROM curve WHERE i = 0
  UNION ALL
  SELECT c.song_id, c.i, CASE WHEN abs(floor(c.tempo * 10 + 0.5) / 10 - w.first) > 5 THEN floor(c.tempo * 10 + 0.5) / 10 ELSE w.first END,
    CASE WHEN abs(floor(c.tempo * 10 + 0.5) / 10 - w.first) > 5 THEN c.i ELSE w.start END,
    CASE WHEN abs(floor(c.tempo * 10 + 0.5) / 10 - w.first) > 5 THEN 1 ELSE w.n + 1 END,
    CASE WHEN abs(floor(c.tempo * 10 + 0.5) / 10 - w.first) > 5 THEN c.tempo ELSE w.total + c.tempo END
  FROM walk w JOIN curve c ON c.song_id = w.song_id AND c.i = w.i + 1
), plain AS (
  SELECT song_id, start, arg_max(floor(total / n * 10 + 0.5) / 10, i) AS bpm, row_number() OVER (PARTITION BY song_id ORDER BY start) AS k FROM walk GROUP BY song_id, start
), joined AS (
  SELECT song_id, k, k AS lead, bpm, start FROM plain WHERE k = 1
  UNION ALL
  SELECT p.song_id, p.k, CASE WHEN abs(p.bpm - j.bpm) < 5 THEN j.lead ELSE p.k END, CASE WHEN abs(p.bpm - j.bpm) < 5 THEN floor((j.bpm + p.bpm) / 2 * 10 + 0.5) / 10 ELSE p.bpm END,
    CASE WHEN abs(p.bpm - j.bpm) < 5 THEN j.start ELSE p.start END
  FROM joined j JOIN plain p ON p.song_id = j.song_id AND p.k = j.k + 1
), last AS (SELECT song_id, lead, arg_max(bpm, k) AS bpm, any_value(start) AS start FROM joined GROUP BY song_id, lead)
SELECT song_id, (row_number() OVER (PARTITION BY song_id ORDER BY lead) - 1)::INT AS seg_idx, bpm, (start * 1000)::BIGINT AS start_ms FROM last"""
)
def tempo_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.segments(_curve(spark, sf_dir))


@query(
    f"""WITH {SQL_BEATS}, v AS (
  SELECT *, (t - lag(t) OVER w)::DOUBLE AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY song_id) AS n FROM beats WINDOW w AS (PARTITION BY song_id ORDER BY t, ordinal)
), m AS (
  SELECT *, avg(v) OVER (PARTITION BY song_id ORDER BY t, ordinal ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS before, avg(v) OVER (PARTITION BY song_id ORDER BY t, ordinal ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS after FROM v
) SELECT song_id, ordinal, i, round(before, 3) AS before, round(after, 3) AS after FROM m WHERE i >= 8 AND i < n - 8 AND abs(after - before) > 0.15 * before"""
)
def tempo_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rates.changes(_points(spark, sf_dir))
    return rows.select("song_id", "ordinal", F.col("i").cast("bigint").alias("i"), F.round("before", 3).alias("before"), F.round("after", 3).alias("after"))


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 ELSE 2 END::INT AS n, CASE WHEN event_id % 3 <> 2 THEN 0.0 END::DOUBLE AS first_bpm,
  CASE WHEN event_id % 3 <> 2 THEN 0 END::BIGINT AS first_start, CASE WHEN event_id % 3 <> 2 THEN floor(value * 10 + 0.5) / 10 END AS last_bpm, CASE WHEN event_id % 3 <> 2 THEN floor(value * 10 + 0.5) END::BIGINT AS last_start FROM events"""
)
def timing_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaver.sources.lyrics import timing_segments

    seg = lambda b, s: F.concat(F.lit('{"bpm":'), b, F.lit(',"start":'), s, F.lit("}"))
    v = F.col("value").cast("string")
    doc = F.concat(F.lit('{"audioFilePath":"a.mp3","bpmSegments":['), seg(v, (F.col("value") * 10).cast("string")), F.lit(","), seg(F.lit("-3"), F.lit("-7.5")), F.lit("]}"))
    rows = table(spark, sf_dir, "events").select("event_id", timing_segments(F.when(F.col("event_id") % 3 == 2, "{").otherwise(doc)).alias("s"))
    at = lambda k, c: F.get("s", k)[c]
    return rows.select("event_id", F.size("s").alias("n"), at(0, "bpm").alias("first_bpm"), at(0, "start").alias("first_start"), at(1, "bpm").alias("last_bpm"), at(1, "start").alias("last_start"))


# --- signals -----------------------------------------------------------------------------------


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples to four decimals; one that is rounded to zero keeps its sign, as in SQL."""
    signed = lambda x, r: F.when((r == 0) & x.cast("string").startswith("-"), -r).otherwise(r)
    rounded = lambda x: signed(x, F.round(x.cast("double"), 4))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label"), F.transform("embedding", rounded).alias("samples"))


_SQL_PCM = "pcm AS (SELECT vec_id, label, list_transform(embedding, lambda x: round(x::DOUBLE, 4)) AS x FROM embeddings)"


@query(
    f"""WITH {_SQL_PCM}, b AS (SELECT vec_id, [list_max(list_transform(x[i * 6 + 1:i * 6 + 6], lambda v: abs(v))) FOR i IN range(10)] AS b FROM pcm)
SELECT vec_id, list_transform(b, lambda v: round(v / list_max(b), 9)) AS peaks FROM b"""
)
def peak_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("vec_id", F.transform(signal.peaks(F.col("samples"), 10), lambda x: F.round(x, 9)).alias("peaks"))


@query(
    f"""WITH {_SQL_PCM}, f AS (SELECT vec_id, unnest(range(7)) AS f, x FROM pcm), r AS (
  SELECT vec_id, f, sqrt(list_sum(list_transform(x[f * 8 + 1:f * 8 + 16], lambda v: v * v)) / 16) AS rms FROM f
) SELECT vec_id, round(max(rms), 6) AS loudest, round(quantile_cont(rms, 0.2), 6) AS threshold, count(*) AS n_frames FROM r GROUP BY vec_id"""
)
def rms_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir).select("vec_id", signal.frame_rms(F.col("samples"), 16, 8).alias("r"))
    return rows.select("vec_id", F.round(F.array_max("r"), 6).alias("loudest"), F.round(signal.linear_percentile(F.col("r"), F.lit(20.0)), 6).alias("threshold"), F.size("r").cast("bigint").alias("n_frames"))


@query(
    f"""WITH RECURSIVE {_SQL_PCM}, f AS (SELECT vec_id, unnest(range(7)) AS f, x FROM pcm), r AS (
  SELECT vec_id, f, sqrt(list_sum(list_transform(x[f * 8 + 1:f * 8 + 16], lambda v: v * v)) / 16) AS rms FROM f
), t AS (SELECT vec_id, quantile_cont(rms, 0.2) AS thr FROM r GROUP BY vec_id), goal AS (
  SELECT vec_id, f, CASE WHEN rms / greatest(thr, 1e-9) <= 1 THEN 0.0 ELSE least(1.0, (rms / greatest(thr, 1e-9) - 1) / 0.5) END AS g FROM r JOIN t USING (vec_id)
), walk AS (
  SELECT vec_id, f, g * (CASE WHEN g > 0 THEN 0.6 ELSE 0.08 END)::DOUBLE AS p FROM goal WHERE f = 0
  UNION ALL SELECT o.vec_id, o.f, w.p + (o.g - w.p) * (CASE WHEN o.g > w.p THEN 0.6 ELSE 0.08 END)::DOUBLE FROM walk w JOIN goal o ON o.vec_id = w.vec_id AND o.f = w.f + 1
), s AS (SELECT vec_id, unnest(range(64)) AS i, unnest(x) AS x FROM pcm)
SELECT vec_id, round(sum(x * (SELECT product(p) FROM walk w WHERE w.vec_id = s.vec_id AND w.f * 8 <= s.i AND s.i < w.f * 8 + 16)), 6) AS total,
  round(max(abs(x * (SELECT product(p) FROM walk w WHERE w.vec_id = s.vec_id AND w.f * 8 <= s.i AND s.i < w.f * 8 + 16))), 6) AS loudest FROM s GROUP BY vec_id"""
)
def noise_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal.gated(_signals(spark, sf_dir), 20.0, 16, 8)
    total = F.aggregate("cleaned", F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.round(total, 6).alias("total"), F.round(F.array_max(F.transform("cleaned", lambda x: F.abs(x))), 6).alias("loudest"))


@query(
    f"""WITH {_SQL_PCM}, s AS (SELECT label, unnest(range(64)) AS i, unnest(x) AS x FROM pcm), m AS (SELECT label, i, sum(x) AS x FROM s GROUP BY label, i)
SELECT label, list(round(x, 6) ORDER BY i) AS mix FROM m GROUP BY label"""
)
def stem_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal.mixed(_signals(spark, sf_dir), ["label"])
    return rows.select("label", F.transform("mix", lambda x: F.round(x, 6)).alias("mix"))


@query(f"WITH {_SQL_PCM} SELECT vec_id, [CASE WHEN i % 2 = 0 THEN x[11 + i] ELSE 0.0 - x[11 + i] END FOR i IN range(20)] AS path FROM pcm")
def peak_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("vec_id", signal.zigzag(F.col("samples"), 10, 20).alias("path"))


# --- grids and views ----------------------------------------------------------------------------


@query(
    f"""WITH {SQL_BEATS}, s AS (
  SELECT song_id, ordinal, start_ms // 100000 AS start_ms, bpm, row_number() OVER w - 1 AS seg_idx, coalesce(lead(start_ms // 100000) OVER w, start_ms // 100000 + 5000) AS stop FROM tempo WINDOW w AS (PARTITION BY song_id ORDER BY start_ms // 100000, ordinal)
), l AS (SELECT song_id, seg_idx, start_ms, 60000.0::DOUBLE / bpm / 4 AS step, unnest(range(ceil((stop - start_ms) / (60000.0::DOUBLE / bpm / 4))::BIGINT)) AS line FROM s WHERE bpm > 0 AND stop > start_ms)
SELECT song_id, count(*) AS n_lines, sum(floor(start_ms + line * step + 0.5))::BIGINT AS t_sum, max(line) AS max_line FROM l GROUP BY song_id"""
)
def grid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tempo(spark, sf_dir).withColumn("start_ms", F.floor(F.col("start_ms") / 100_000))
    lines = rates.grid_lines(rows, F.col("start_ms") + 5000)
    return lines.groupBy("song_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("t").alias("t_sum"), F.max(F.col("line").cast("bigint")).alias("max_line"))


@query(
    """WITH v AS (SELECT event_id, event_id % 977 * 100 AS start_ms, 1000 + floor(value)::BIGINT * 997 AS vis FROM events), s AS (
  SELECT *, CASE WHEN 800.0 / (vis / 1000.0) >= 100 THEN 1 WHEN 800.0 / (vis / 1000.0) >= 50 THEN 2 WHEN 800.0 / (vis / 1000.0) >= 20 THEN 5 WHEN 800.0 / (vis / 1000.0) >= 10 THEN 10 ELSE 30 END AS step FROM v
) SELECT event_id, step::BIGINT AS step, list_transform(range(ceil(start_ms / 1000.0 / step)::BIGINT, floor((start_ms + vis) / 1000.0 / step)::BIGINT + 1), lambda k: k * step) AS marks FROM s"""
)
def ruler_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 977 * 100).alias("start_ms"), (F.lit(1000) + F.floor("value") * 997).alias("visible_ms"))
    return rates.ruler(views).select("event_id", "step", "marks")


@query(
    f"""WITH {SQL_BEATS}, e AS (SELECT song_id, ordinal, t, coalesce(lead(t) OVER (PARTITION BY song_id ORDER BY t, ordinal), max(t) OVER (PARTITION BY song_id)) AS "end", min(t) OVER (PARTITION BY song_id) AS s FROM beats)
SELECT song_id, ordinal, t, "end", (t <= s + 50000000) AS played FROM e WHERE t < s + 90000000 AND "end" > s + 10000000"""
)
def labels_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = Window.partitionBy("song_id")
    rows = _points(spark, sf_dir).withColumn("duration", F.max("t").over(whole)).withColumn("s", F.min("t").over(whole))
    rows = timeline.intervals(rows, "t", F.col("duration"))
    seen = timeline.visible(rows, F.col("s") + 10_000_000, F.col("s") + 90_000_000)
    return seen.select("song_id", "ordinal", "t", "end", (F.col("t") <= F.col("s") + 50_000_000).alias("played"))


@query(
    """SELECT event_id, floor(value)::BIGINT // 60 || ':' || lpad((floor(value)::BIGINT % 60)::VARCHAR, 2, '0') AS clock, least(greatest(value * 3 - 50, 0), 200) AS seek,
  least(greatest(floor(value / 20 * 10 + 0.5) / 10, 0.1), 1.0)::DOUBLE AS speed, value / 4 / 800 AS nudge,
  CASE WHEN event_id % 4 = 3 THEN 0 ELSE floor(value)::BIGINT * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END END AS compensation FROM events"""
)
def player_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", C.format_seconds(v).alias("clock"), rates.clamp(v * 3 - 50, 0.0, 200.0).alias("seek"), viewport.playing_speed(v / 20).alias("speed"), (v / 4 / 800).alias("nudge"),
        viewport.compensation(F.concat(F.when(F.col("event_id") % 4 == 3, "x").when(F.col("event_id") % 2 == 0, " ").otherwise("-"), F.floor(v).cast("string"), F.lit(".7"))).alias("compensation"),
    )


# --- alignment ----------------------------------------------------------------------------------

_SQL_TURNS = """turns AS (
  SELECT conv_id AS song_id, turn, w AS word, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, i) - 1 AS word_idx
  FROM (SELECT conv_id, turn, role, unnest(range(len(l))) AS i, ' ' || unnest(l) AS w FROM (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS l FROM conversations))
), timed AS (SELECT *, word_idx * 0.5 AS s, word_idx * 0.5 + 0.4 AS e FROM turns)"""


def _turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.filter(F.split("text", " "), lambda x: x != "")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("song_id"), "turn", "role", F.posexplode(own).alias("i", "w"))
    idx = F.row_number().over(Window.partitionBy("song_id").orderBy("turn", "role", "i")) - 1
    return rows.select("song_id", idx.alias("word_idx"), F.concat(F.lit(" "), "w").alias("word"))


@query(
    f"""WITH {_SQL_TURNS}, p AS (SELECT *, coalesce(sum(length(word)) OVER (PARTITION BY song_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS f FROM timed)
SELECT song_id, count(*) AS n_chars, max(c) AS last_char, round(sum(t), 1) AS t_sum FROM (
  SELECT song_id, f + j AS c, s + (e - s) * (j / n::DOUBLE) AS t FROM (SELECT song_id, f, s, e, length(word) AS n, unnest(range(length(word))) AS j FROM p)) WHERE c >= 0 GROUP BY song_id"""
)
def char_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turn_words(spark, sf_dir).withColumn("start", F.col("word_idx") * F.lit(0.5)).withColumn("end", F.col("word_idx") * F.lit(0.5) + 0.4)
    out = timeline.char_times(rows.withColumn("start", F.col("start").cast("double")).withColumn("end", F.col("end").cast("double")))
    return out.groupBy("song_id").agg(F.count(F.lit(1)).alias("n_chars"), F.max("char_idx").alias("last_char"), F.round(F.sum("t"), 1).alias("t_sum"))


@query(
    f"""WITH {_SQL_TURNS}, p AS (SELECT song_id, word_idx, length(word) AS n, coalesce(sum(length(word)) OVER (PARTITION BY song_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM turns),
c AS (SELECT song_id, word_idx, f + unnest(range(n)) AS c FROM p)
SELECT song_id, word_idx, min(c)::BIGINT * 10 AS t FROM c WHERE c % 3 = 0 GROUP BY song_id, word_idx"""
)
def char_to_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _turn_words(spark, sf_dir).select("song_id", F.col("word_idx").cast("bigint").alias("word_idx"), F.col("word").alias("reading"))
    total = words.groupBy("song_id").agg(F.sum(F.length("reading")).alias("n"))
    # Every third character, numbered in two steps, so that no array is as long as a song.
    some = total.where("n > 0").select("song_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(3 << 12).cast("bigint"))).alias("low"))
    chars = some.select("song_id", F.explode(F.sequence("low", F.least(F.col("low") + (3 << 12), F.col("n")) - 1, F.lit(3).cast("bigint"))).alias("char_idx"))
    return lookup.owner_of_chars(words, chars.withColumn("t", F.col("char_idx") * 10))


@query(
    f"""WITH {SQL_BEATS}, r AS (SELECT * FROM (VALUES (1, 'click', 0::BIGINT, NULL::BIGINT), (2, 'view', 1704100000000, 1705000000000), (3, 'view', 1704500000000, NULL), (4, 'error', 0, 1704900000000)) v(idx, base, f, u))
SELECT b.ordinal, arg_min(r.base, r.idx) || min(r.idx) AS texts, count(r.idx) > 0 AS found FROM beats b LEFT JOIN r ON b.event_type = r.base AND r.f <= b.t AND (r.u IS NULL OR b.t < r.u) GROUP BY b.ordinal"""
)
def ruby_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(1, "click", 0, None), (2, "view", 1704100000000, 1705000000000), (3, "view", 1704500000000, None), (4, "error", 0, 1704900000000)]
    side = spark.createDataFrame(rules, "idx int, base string, valid_from long, valid_to long")
    side = side.withColumn("texts", F.array(F.concat("base", F.col("idx").cast("string")))).withColumn("offsets_ms", F.array(F.lit(0)))
    words = beats(spark, sf_dir).select("song_id", "ordinal", F.col("event_type").alias("reading"), "t")
    out = lookup.ruby_for(words, side)
    return out.select("ordinal", F.get("texts", 0).alias("texts"), F.col("texts").isNotNull().alias("found"))


@query(
    f"""WITH {SQL_BEATS}, w AS (SELECT song_id, ordinal % 40 AS word_idx, count(*) AS n FROM beats GROUP BY ALL), b AS (
  SELECT song_id, ordinal % 40 AS word_idx, row_number() OVER (PARTITION BY song_id ORDER BY ordinal % 40, ordinal) - 1 AS beat_idx FROM beats WHERE event_type = 'click')
SELECT w.song_id, w.word_idx, min(b.beat_idx)::INT AS beat_idx FROM w LEFT JOIN b ON b.song_id = w.song_id AND b.word_idx >= w.word_idx GROUP BY ALL"""
)
def first_beat_of_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = beats(spark, sf_dir).withColumn("word_idx", F.col("ordinal") % 40)
    own = timeline.numbered_beats(rows, ["word_idx", "ordinal"], F.col("event_type") == "click")
    return lookup.first_beat(rows.select("song_id", "word_idx").distinct(), own)


@query(
    """SELECT a.c_custkey, b.c_custkey AS cached FROM customer a JOIN customer b ON a.c_custkey % 50 = b.c_custkey % 50 AND a.c_nationkey = b.c_nationkey
WHERE abs(a.c_acctbal / 1000 - b.c_acctbal / 1000) < 0.25 AND a.c_custkey <> b.c_custkey"""
)
def stem_cache_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat((F.col("c_custkey") % 50).cast("string"), F.lit("-"), F.col("c_nationkey").cast("string")).alias("stem")
    rows = table(spark, sf_dir, "customer").select("c_custkey", stem, (F.col("c_acctbal") / 1000).alias("duration"))
    return lookup.cached_stems(rows, rows).where("a.c_custkey <> c.c_custkey").select(F.col("a.c_custkey").alias("c_custkey"), F.col("c.c_custkey").alias("cached"))


# --- editing by time, history ------------------------------------------------------------------


@query(
    f"""WITH {SQL_BEATS}, e AS (SELECT song_id, ordinal, CASE ordinal % 4 WHEN 1 THEN 99.9 ELSE bpm END AS bpm, CASE ordinal % 4 WHEN 2 THEN greatest(start_ms - 1000000, 0) ELSE start_ms END::DOUBLE AS start_ms FROM tempo WHERE ordinal % 4 <> 3
  UNION ALL SELECT song_id, ordinal, 77.0, start_ms + 10.5 FROM tempo WHERE ordinal % 4 = 0)
SELECT song_id, ordinal, bpm::DOUBLE AS bpm, start_ms, (row_number() OVER (PARTITION BY song_id ORDER BY start_ms, ordinal) - 1)::INT AS seg_idx FROM e"""
)
def tempo_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tempo(spark, sf_dir)
    k = F.col("ordinal") % 4
    action = F.when(k == 0, "add").when(k == 1, "bpm").when(k == 2, "move").otherwise("delete")
    bpm = F.when(k == 0, 77.0).otherwise(99.94)
    start = F.when(k == 0, F.col("start_ms") + 10.5).otherwise(F.col("start_ms") - 1_000_000)
    return edit.tempo_edited(rows, rows.select("song_id", "ordinal", action.alias("action"), bpm.alias("bpm"), start.alias("start_ms")))


@query(
    f"""WITH {SQL_BEATS}, s AS (SELECT song_id, ordinal // 3 AS word_idx, ordinal % 3 AS syl_idx, t FROM beats), f AS (SELECT *, first_value(t) OVER (PARTITION BY song_id, word_idx ORDER BY syl_idx) AS f FROM s)
SELECT song_id, word_idx, syl_idx::BIGINT AS syl_idx, CASE WHEN word_idx % 2 = 0 THEN greatest(t + (1000000 - f), 0) ELSE t END AS t FROM f"""
)
def words_retimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = beats(spark, sf_dir).select("song_id", F.floor(F.col("ordinal") / 3).alias("word_idx"), (F.col("ordinal") % 3).alias("syl_idx"), "t")
    starts = rows.where("word_idx % 2 = 0").select("song_id", "word_idx", F.lit(1_000_000).cast("bigint").alias("start")).distinct()
    return edit.retimed(rows, starts)


_SQL_VERSIONS = """old AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 5 <> 1),
new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 6 <> 1)"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    return rows.where("k % 5 <> 1"), rows.where("k % 6 <> 1").withColumn("s", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("s")))


@query(
    f"""WITH {_SQL_VERSIONS} SELECT coalesce(old.k, new.k) AS k, CASE WHEN old.k IS NULL THEN 'insert' WHEN new.k IS NULL THEN 'delete' ELSE 'update' END AS change, old.s AS old_s, new.s AS new_s
FROM old FULL JOIN new ON old.k = new.k WHERE old.k IS NULL OR new.k IS NULL OR old.s IS DISTINCT FROM new.s OR old.p IS DISTINCT FROM new.p"""
)
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = history.changes(*_versions(spark, sf_dir), ["k"])
    return log.select("k", "change", F.col("before.s").alias("old_s"), F.col("after.s").alias("new_s"))


@query(f"WITH {_SQL_VERSIONS} SELECT 'undo' AS way, k, s, p FROM old UNION ALL SELECT 'redo', k, s, p FROM new")
def undo_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    log = history.changes(old, new, ["k"])
    back, forth = history.undone(new, log, ["k"]), history.redone(old, log, ["k"])
    return back.select(F.lit("undo").alias("way"), "k", "s", "p").union(forth.select(F.lit("redo"), "k", "s", "p"))


@query(
    """WITH f AS (SELECT o_custkey AS user_id, 'f' || (o_orderkey % 20) AS path, max((o_orderdate, o_orderkey)) AS l FROM orders GROUP BY ALL)
SELECT user_id, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY l DESC)::INT AS rank FROM f) WHERE rank <= 5"""
)
def recent_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("f"), (F.col("o_orderkey") % 20).cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), path.alias("path"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("ordinal"))
    return history.recent(rows).select("user_id", "path", "rank")


@query(
    f"WITH {SQL_BEATS} SELECT song_id, ordinal, rank FROM (SELECT song_id, ordinal, row_number() OVER (PARTITION BY song_id ORDER BY t DESC, ordinal DESC)::INT AS rank FROM beats) WHERE rank <= 200"
)
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.newest(_points(spark, sf_dir), ["song_id"], [F.desc("t"), F.desc("ordinal")], 200).select("song_id", "ordinal", "rank")


@query(
    f"""WITH {SQL_BEATS} SELECT song_id, list_sort(list_distinct(list(ordinal) FILTER (event_type IN ('click', 'view')))) AS pending,
  len(list(ordinal) FILTER (event_type = 'click'))::INT AS n_left FROM beats GROUP BY song_id"""
)
def pending_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c: F.collect_list(F.when(c, F.col("ordinal")))
    kind = F.col("event_type")
    rows = beats(spark, sf_dir).groupBy("song_id").agg(pick(kind.isin("click", "view")).alias("a"), pick(kind == "view").alias("b"))
    return rows.select("song_id", timeline.pending_with(F.col("a"), F.col("b")).alias("pending"), F.size(timeline.pending_without(F.col("a"), F.col("b"))).alias("n_left"))


@query(
    f"""WITH {SQL_BEATS}, n AS (SELECT song_id, count(*) AS n FROM beats GROUP BY song_id)
SELECT b.ordinal, least(b.ordinal % 90 + 1, n.n - 1) AS next_beat, greatest(b.ordinal % 90 - 1, 0) AS prev_beat,
  CASE WHEN b.ordinal % 200 - 20 >= 0 AND b.ordinal % 200 - 20 < n.n THEN b.ordinal % 200 - 20 ELSE b.ordinal % 90 END AS go_beat FROM beats b JOIN n USING (song_id)"""
)
def cursor_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, at = F.col("n"), F.col("ordinal") % 90
    rows = beats(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("song_id")))
    return rows.select("ordinal", timeline.next_beat(at, n).alias("next_beat"), timeline.previous_beat(at).alias("prev_beat"), timeline.beat_at(at, F.col("ordinal") % 200 - 20, n).alias("go_beat"))


@query(
    f"""WITH {SQL_BEATS}, w AS (SELECT song_id, ordinal // 4 AS word_idx, count(*) AS n, count(t) FILTER (t <= 1704500000000) AS lit FROM kinded GROUP BY ALL)
SELECT song_id, word_idx, n = lit AS fully, lit > 0 AND lit < n AS partly FROM w"""
)
def highlight_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kinded(spark, sf_dir).withColumn("word_idx", F.floor(F.col("ordinal") / 4))
    return timeline.highlighted(rows, ["song_id", "word_idx"], F.lit(1704500000000))


@query(
    f"""WITH {_SQL_ASOF}, s AS (SELECT a.song_id, a.ordinal, least(greatest(a.t + (a.ordinal % 9 - 4) * 1000, 0), 1704900000000) AS t, p.start_ms, p.bpm FROM latest a
  LEFT JOIN LATERAL (SELECT start_ms, bpm FROM tempo WHERE tempo.song_id = a.song_id AND start_ms <= least(greatest(a.t + (a.ordinal % 9 - 4) * 1000, 0), 1704900000000) ORDER BY start_ms DESC, tempo.ordinal DESC LIMIT 1) p ON TRUE)
SELECT song_id, ordinal, {_snap_sql(4)} AS dropped FROM s"""
)
def drag_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.least(F.greatest(F.col("t") + (F.col("ordinal") % 9 - 4) * 1000, F.lit(0)), F.lit(1704900000000))
    rows = _points(spark, sf_dir).withColumn("t", moved)
    return timeline.snapped(rows, tempo(spark, sf_dir), 4).select("song_id", "ordinal", F.col("snapped").alias("dropped"))


@query(
    f"""WITH {SQL_BEATS}, p AS (SELECT song_id, list_sort(list(t // 10000000)) AS l FROM beats GROUP BY song_id)
SELECT song_id, list_reduce(list_transform(l, lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[len(a)] >= 4 THEN list_append(a, b[1]) ELSE a END) AS kept FROM p"""
)
def spaced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = beats(spark, sf_dir).groupBy("song_id").agg(F.array_sort(F.collect_list(F.floor(F.col("t") / 10_000_000))).alias("l"))
    return rows.select("song_id", rates.spaced(F.col("l"), 4).alias("kept"))
