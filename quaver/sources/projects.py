"""Projects as tables: saving, opening, snapshots, and the results of the external models."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaver.functions.timecode import trimmed
from quaver.sources import lyrics as L

PROJECT = "version string, createdAt string, updatedAt string, userPassword string"
SAVED = "song_id long, project string, lyrics string, timing string"
RESULT = "ok boolean, error string, vocals string, instru string, charTimes map<string,double>, segments array<struct<start:double,end:double,text:string>>"


def stamped(projects: DataFrame, version: str, now: str, password: str | None = None) -> DataFrame:
    """projects (song_id, project, lyrics, timing; JSON texts) as they are saved: the version and the time
    of the change are new, the time of making stays, a given password replaces the old one."""
    old = F.coalesce(F.from_json("project", PROJECT), F.struct(*[F.lit(None).cast("string").alias(c) for c in ("version", "createdAt", "updatedAt", "userPassword")]))
    secret = F.lit(password) if password else old["userPassword"]
    new = F.struct(F.lit(version).alias("version"), F.coalesce(old["createdAt"], F.lit(now)).alias("createdAt"), F.lit(now).alias("updatedAt"), secret.alias("userPassword"))
    return projects.withColumn("project", F.to_json(new))


class _Store:
    """The manifests of a folder: ``manifests/N.json`` names the parts, oldest first, that the folder consists of
    since its N-th commit. A manifest appears whole or not at all, and none is ever replaced."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark.sparkContext._jvm, folder.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def numbers(self) -> list[int]:
        place = self.path("manifests")
        if not self.fs.exists(place):
            return []
        names = [x.getPath().getName() for x in self.fs.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def parts(self, number: int) -> list[str]:
        if not number:
            return []
        stream = self.fs.open(self.path(f"manifests/{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["parts"]
        finally:
            stream.close()

    def create(self, number: int, parts: list[str]) -> bool:
        """Makes the number-th manifest; False if another writer has made it."""
        draft = self.path(f"manifests/.{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(json.dumps({"parts": parts}).encode())
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(self.path(f"manifests/{number}.json")), options)
        except Exception as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExistsException" not in str(e):
                raise
            return False
        return True

    def commit(self, change) -> int:
        """The number of the new manifest: change(parts) of the newest one, whoever else commits meanwhile."""
        while True:
            last = (self.numbers() or [0])[-1]
            if self.create(last + 1, change(self.parts(last))):
                return last + 1


def save(projects: DataFrame, folder: str, version: str, now: str, password: str | None = None, replace: bool = False) -> int:
    """Writes projects into a folder, which needn't exist, and returns the number of this commit.

    Songs that aren't among them stay as they were; with ``replace`` they go. The rows may come from the folder
    itself: files are only ever added, and count once a manifest names them, so a save that fails or is
    killed changes nothing. Of two savers at a time both count, the later one for songs of both.
    To save as another is to name another folder.
    """
    spark = projects.sparkSession
    part = uuid.uuid4().hex
    stamped(projects, version, now, password).select("song_id", "project", "lyrics", "timing").write.parquet(f"{folder.rstrip('/')}/parts/{part}")
    return _Store(spark, folder).commit(lambda parts: [part] if replace else [*parts, part])


def saved(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """song_id, project, lyrics, timing (JSON texts) of a folder's projects, now or since its commit ``number``: each
    song's rows of the last part that has it."""
    store = _Store(spark, folder)
    known = store.numbers()
    if not known or (number is not None and number not in known):
        raise FileNotFoundError(f"no such project version in {folder}")
    return _rows(spark, folder, store.parts(known[-1] if number is None else number))


def _rows(spark: SparkSession, folder: str, parts: list[str]) -> DataFrame:
    each = [spark.read.schema(SAVED).parquet(f"{folder.rstrip('/')}/parts/{p}").withColumn("part_", F.lit(k)) for k, p in enumerate(parts)]
    if len(each) < 2:
        return each[0].drop("part_") if each else spark.createDataFrame([], SAVED)
    rows = reduce(DataFrame.unionByName, each)
    # Which part has a song last is told by two narrow columns.
    last = rows.groupBy("song_id").agg(F.max("part_").alias("last_")).withColumnRenamed("song_id", "key_")
    return rows.join(last, F.col("song_id").eqNullSafe(F.col("key_")) & (F.col("part_") == F.col("last_")), "left_semi").drop("part_")


def compact(spark: SparkSession, folder: str) -> int:
    """One part in place of all, for folders of many saves; what is saved meanwhile stays, and so do older versions."""
    store = _Store(spark, folder)
    parts = store.parts((store.numbers() or [0])[-1])
    whole = uuid.uuid4().hex
    _rows(spark, folder, parts).write.parquet(f"{folder.rstrip('/')}/parts/{whole}")
    return store.commit(lambda now: [whole, *(p for p in now if p not in parts)])


def open_projects(spark: SparkSession, folder: str, password: str | None = None, number: int | None = None) -> DataFrame:
    """song_id, project, words, metadata, timing, error of saved projects, now or since a commit. One whose
    password isn't the given one has the error ``bad_password`` and nothing else."""
    rows = saved(spark, folder, number).withColumn("info", F.from_json("project", PROJECT))
    locked = F.coalesce(F.col("info.userPassword"), F.lit("")) != F.lit(password or "")
    bad = F.coalesce(F.col("info.userPassword"), F.lit("")).isNotNull() & (F.col("info.userPassword") != "") & locked
    bad = F.coalesce(bad, F.lit(False))
    own = rows.withColumn("doc", L.from_json(F.col("lyrics"))).withColumn("state", L.timing_state(F.col("timing")))
    show = lambda c, name: F.when(~bad, c).alias(name)
    return own.select("song_id", show(F.col("info"), "project"), show(F.col("doc.words"), "words"), show(F.col("doc.metadata"), "metadata"), show(F.col("state"), "timing"), F.when(bad, "bad_password").alias("error"))


def snapshots(versions: DataFrame) -> DataFrame:
    """song_id, version, lyrics, timing of states (song_id, version, words, metadata, state): JSON texts
    that ``restored`` reads back."""
    return versions.select("song_id", "version", L.to_json(F.col("words"), F.col("metadata")).alias("lyrics"), L.timing_json(F.col("state")).alias("timing"))


def restored(current: DataFrame, log: DataFrame, at: DataFrame) -> DataFrame:
    """current (song_id, cursor, words, metadata, state) with what the snapshot log holds for the versions
    named in at (song_id, version); the cursor stays where it is. Songs not named don't change."""
    own = log.join(at.select("song_id", "version").distinct(), ["song_id", "version"], "left_semi")
    one = own.withColumn("nth_", F.row_number().over(Window.partitionBy("song_id").orderBy(F.desc("version")))).where("nth_ = 1")
    back = one.select("song_id", L.from_json(F.col("lyrics")).alias("doc_"), L.timing_state(F.col("timing")).alias("state_"))
    out = current.join(back, "song_id", "left")
    pick = lambda new, old: F.when(F.col("doc_").isNotNull(), F.col(new)).otherwise(F.col(old)).alias(old)
    return out.select("song_id", "cursor", pick("doc_.words", "words"), pick("doc_.metadata", "metadata"), pick("state_", "state"))


def outcome(stdout: Column, stderr: Column, code: Column) -> Column:
    """What a run of a model came to: a struct of ok, error and the result. A code other than 0 fails
    with what it wrote to stderr, an envelope that isn't ok with its error, a text that isn't JSON
    with a parse error."""
    found = F.from_json(stdout, RESULT, {"mode": "PERMISSIVE"})
    bare = trimmed(F.coalesce(stderr, F.lit("")))
    failed = F.when(code != 0, F.when(bare != "", bare).otherwise(F.concat(F.lit("exit "), code.cast("string"))))
    parsed = F.coalesce(stdout.rlike(r"(?s)^\s*\{.*\}\s*$"), F.lit(False))
    error = F.coalesce(failed, F.when(~parsed, "not JSON"), F.when(~F.coalesce(found["ok"], F.lit(False)), F.coalesce(found["error"], F.lit("failed"))))
    return F.struct(error.isNull().alias("ok"), error.alias("error"), F.when(error.isNull(), found).alias("result"))


def split_outcomes(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs (stdout, stderr, code and more) that came to a result, with it, and those that didn't, with
    their error."""
    rest = [c for c in runs.columns if c not in ("stdout", "stderr", "code")]
    own = runs.withColumn("out_", outcome(F.col("stdout"), F.col("stderr"), F.col("code")))
    return own.where("out_.ok").select(*rest, "out_.result.*"), own.where("not out_.ok").select(*rest, F.col("out_.error").alias("error"))
