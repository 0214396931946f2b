"""Queries on versions: saved projects, changes of sequences, stacks of steps, tables at a step, rules in numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.operators import history, lookup
from quaver.operators.lineage import cut, shared_folder
from quaver.plans.common import SQL_BEATS, beats, table
from quaver.sources import lyrics, projects

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    """WITH d AS (SELECT doc_id AS song_id, doc_id % 3 = 0 AS again, 'T ' || left(coalesce(text, ''), 30) AS title, 'w' || length(coalesce(text, '')) AS word FROM documents)
SELECT song_id, CASE WHEN again THEN 'new ' || song_id ELSE title END AS title, CASE WHEN again THEN '2' ELSE '1' END AS version, CASE WHEN again THEN 't2' ELSE 't1' END AS updated, 't1' AS created, word, title AS first_title FROM d"""
)
def project_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of all documents are saved; a third of the songs, as they were opened, are changed and saved over
    themselves; then the folder is opened, now and as it was first."""
    folder = f"{shared_folder(spark).rstrip('/')}/projects-{uuid.uuid4().hex}"
    text = F.coalesce("text", F.lit(""))
    word = F.struct(F.concat(F.lit("w"), F.length(text).cast("string")).alias("reading"), F.array().cast("array<struct<reading:string,time:double,isSet:boolean>>").alias("syllables"), F.lit(False).alias("withRuby"), F.lit(True).alias("isReadingAutoGenerated"))
    doc = F.to_json(F.struct(F.create_map(F.lit("title"), F.concat(F.lit("T "), F.substring(text, 1, 30))).alias("metadata"), F.array(word).alias("words")))
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("song_id"), none.alias("project"), doc.alias("lyrics"), none.alias("timing"))
    projects.save(rows, folder, "1", "t1")
    opened = projects.saved(spark, folder).where("song_id % 3 = 0").withColumn("doc", lyrics.from_json(F.col("lyrics")))
    changed = F.map_concat(F.map_filter("doc.metadata", lambda k, _: k != "title"), F.create_map(F.lit("title"), F.concat(F.lit("new "), F.col("song_id").cast("string"))))
    projects.save(opened.withColumn("lyrics", lyrics.to_json(F.col("doc.words"), changed)), folder, "2", "t2")
    first = projects.open_projects(spark, folder, number=1).select("song_id", F.col("metadata")["title"].alias("first_title"))
    now = projects.open_projects(spark, folder).select("song_id", F.col("metadata")["title"].alias("title"), "project.version", F.col("project.updatedAt").alias("updated"), F.col("project.createdAt").alias("created"), F.get("words", 0)["reading"].alias("word"))
    return now.join(first, "song_id")


_SQL_EDITED = r"""d AS (SELECT doc_id AS song_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS old FROM documents
), cut AS (SELECT *, CASE WHEN len(old) = 0 THEN [] ELSE list_concat(old[1:song_id % len(old)], old[song_id % len(old) + 2:]) END AS rest FROM d
), edited AS (SELECT *, song_id * 7 % (len(rest) + 1) AS place, list_concat(rest[1:song_id * 7 % (len(rest) + 1)], list_concat(['zzz9'], rest[song_id * 7 % (len(rest) + 1) + 1:])) AS new FROM cut)"""


@query(
    f"""WITH {_SQL_EDITED} SELECT song_id, CASE WHEN len(old) > 0 THEN 1 ELSE 0 END::BIGINT AS deleted, 1::BIGINT AS inserted, place::INT AS inserted_at,
  md5(array_to_string(old, ' ')) AS old_md5, md5(array_to_string(new, ' ')) AS new_md5 FROM edited"""
)
def word_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word of each document is deleted and another inserted: two rows of a log, by which each version gives the other."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("song_id"), words.alias("old"))
    at = F.when(F.size("old") == 0, 0).otherwise((F.col("song_id") % F.size("old")).cast("int"))
    rows = rows.withColumn("rest", F.concat(F.slice("old", F.lit(1), at), F.expr("slice(old, if(size(old) = 0, 1, int(song_id % size(old)) + 2), size(old))")))
    put = (F.col("song_id") * 7 % (F.size("rest") + 1)).cast("int")
    rows = rows.withColumn("new", F.array_insert("rest", put + 1, F.lit("zzz9"))).select("song_id", "old", "new")
    log = cut(history.word_changes(rows))
    back = history.words_undone(rows.select("song_id", F.col("new").alias("words")), log).select("song_id", F.md5(F.array_join("words", " ")).alias("old_md5"))
    forth = history.words_redone(rows.select("song_id", F.col("old").alias("words")), log).select("song_id", F.md5(F.array_join("words", " ")).alias("new_md5"))
    inserted = F.col("op") == "insert"
    told = log.groupBy("song_id").agg(F.count_if(~inserted).alias("deleted"), F.count_if(inserted).alias("inserted"), F.max(F.when(inserted, F.col("new_idx"))).alias("inserted_at"))
    return told.join(back, "song_id").join(forth, "song_id")


@query(
    f"""WITH RECURSIVE {SQL_BEATS}, acts AS (
  SELECT song_id, ordinal, row_number() OVER (PARTITION BY song_id ORDER BY ordinal) AS i, CASE event_type WHEN 'signup' THEN 'undo' WHEN 'error' THEN 'redo' ELSE 'record' END AS action FROM beats
), walk AS (
  SELECT song_id, 0::BIGINT AS i, NULL::BIGINT AS ordinal, NULL::BIGINT AS now, []::BIGINT[] AS u, []::BIGINT[] AS r FROM acts GROUP BY song_id
  UNION ALL
  SELECT a.song_id, a.i, a.ordinal,
    CASE WHEN a.action = 'record' THEN a.ordinal WHEN a.action = 'undo' AND len(u) > 0 THEN u[len(u)] WHEN a.action = 'redo' AND len(r) > 0 THEN r[len(r)] ELSE now END,
    CASE WHEN a.action = 'record' AND now IS NOT NULL THEN list_append(u, now)[-5:] WHEN a.action = 'undo' AND len(u) > 0 THEN u[1:len(u) - 1] WHEN a.action = 'redo' AND len(r) > 0 THEN list_append(u, now) ELSE u END,
    CASE WHEN a.action = 'record' THEN [] WHEN a.action = 'undo' AND len(u) > 0 THEN list_append(r, now) WHEN a.action = 'redo' AND len(r) > 0 THEN r[1:len(r) - 1] ELSE r END
  FROM walk w JOIN acts a ON a.song_id = w.song_id AND a.i = w.i + 1
) SELECT song_id, ordinal, now AS version, len(u)::INT AS n_undo, len(r)::INT AS n_redo, len(u) > 0 AS can_undo, len(r) > 0 AS can_redo FROM walk WHERE i > 0"""
)
def history_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records, undos and redos of a stack of five steps."""
    kind = F.col("event_type")
    acts = beats(spark, sf_dir).select("song_id", "ordinal", F.when(kind == "signup", "undo").when(kind == "error", "redo").otherwise("record").alias("action"))
    return history.stack(acts, 5).withColumn("can_undo", F.col("n_undo") > 0).withColumn("can_redo", F.col("n_redo") > 0)


@query(
    """SELECT 0 AS step, o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 5 <> 1
UNION ALL SELECT 1, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END, o_totalprice FROM orders WHERE o_orderkey % 6 <> 1"""
)
def table_at_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of a table; the first two from the last one and the log of changes."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    first, second = rows.where("k % 5 <> 1"), rows.where("k % 6 <> 1").withColumn("s", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("s")))
    last = second.where("k % 4 <> 0").withColumn("p", F.when(F.col("k") % 9 == 0, F.col("p") + 1).otherwise(F.col("p"))).withColumn("s", F.when(F.col("k") % 7 == 0, "Y").otherwise(F.col("s")))
    log = cut(history.changes(first, second, ["k"]).withColumn("step", F.lit(1)).unionByName(history.changes(second, last, ["k"]).withColumn("step", F.lit(2))))
    at = lambda n: history.at_step(last, log, ["k"], n).withColumn("step", F.lit(n))
    return at(0).unionByName(at(1))


@query(
    f"""WITH {SQL_BEATS}, rules AS (SELECT ordinal AS idx, event_type AS base, t AS f, t + (ordinal % 50 + 1) * 60000 AS u FROM beats WHERE ordinal % 3 = 0)
SELECT b.ordinal, arg_min(r.base, r.idx) || min(r.idx) AS texts FROM beats b LEFT JOIN rules r ON b.event_type = r.base AND r.f <= b.t AND b.t < r.u GROUP BY b.ordinal"""
)
def ruby_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the events as rules of five base texts, for all events as words."""
    own = beats(spark, sf_dir)
    k = F.col("ordinal")
    rules = own.where(k % 3 == 0).select(k.alias("idx"), F.col("event_type").alias("base"), F.col("t").alias("valid_from"), (F.col("t") + (k % 50 + 1) * 60_000).alias("valid_to"), F.array(F.concat("event_type", k.cast("string"))).alias("texts"), F.array(F.lit(0).cast("bigint")).alias("offsets_ms"))
    out = lookup.ruby_for(own.select("song_id", "ordinal", F.col("event_type").alias("reading"), "t"), rules)
    return out.select("ordinal", F.get("texts", 0).alias("texts"))
