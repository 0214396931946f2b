"""Lyric files by format: a data source for whole text files, and words read from and written to them.

``lyric_files`` reads a folder in partitions of some MB of files, a row (name, text) for each file, and writes
such rows as files. A task writes drafts that nothing reads; they get their names when the whole write
commits, and go if it doesn't, so that a failed or repeated task leaves no file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quaver.functions import word as W
from quaver.operators import words as T
from quaver.sources import lyrics as L

#: Formats and the extensions of their files.
EXTENSIONS = {"txt": "txt", "lrc": "lrc", "nico": "nico", "json": "json"}
#: Bytes of files that are read together.
TOGETHER = 16 << 20
DRAFTS = "_drafts"


def _place(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


@dataclass
class Files(InputPartition):
    names: list[str]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.together = int(options.get("together", TOGETHER))

    def partitions(self) -> list[Files]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = _place(self.path)
        found = sorted((x.base_name, x.size) for x in fs.get_file_info(FileSelector(root)) if x.type == FileType.File)
        found = [x for x in found if x[0].endswith(self.suffix) and x[0][0] not in "._"]
        parts, size = [Files([])], 0
        for name, n in found:
            if size and size + n > self.together:
                parts.append(Files([]))
                size = 0
            parts[-1].names.append(name)
            size += n
        return parts

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, root = _place(self.path)
        for name in partition.names:
            with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                yield name, f.read().decode("utf-8", "replace")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    """Drafts by task; names by commit."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        fs, root = _place(self.path)
        drafts = f"{root}/{DRAFTS}-{self.job}"
        fs.create_dir(drafts, recursive=True)
        files = []
        for row in iterator:
            name = row["name"]
            if not name or "/" in name or name[0] in "._":
                raise ValueError(f"no file name: {name!r}")
            draft = f"{drafts}/{uuid.uuid4().hex}"
            with fs.open_output_stream(draft, compression=None) as f:
                f.write((row["text"] or "").encode())
            files.append((draft, name))
        return Written(files)

    def commit(self, messages: list) -> None:
        from pyarrow.fs import FileSelector, FileType

        fs, root = _place(self.path)
        files = [x for m in messages if m is not None for x in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows name one file")
        for draft, name in files:
            fs.move(draft, f"{root}/{name}")
        if self.overwrite:
            fs.create_dir(root, recursive=True)
            for x in fs.get_file_info(FileSelector(root)):
                if x.type == FileType.File and x.base_name not in set(names):
                    fs.delete_file(x.path)
        self._clean(fs, root)

    def abort(self, messages: list) -> None:
        self._clean(*_place(self.path))

    def _clean(self, fs, root: str) -> None:
        from pyarrow.fs import FileType

        drafts = f"{root}/{DRAFTS}-{self.job}"
        if fs.get_file_info(drafts).type == FileType.Directory:
            fs.delete_dir(drafts)


class LyricFiles(DataSource):
    """``spark.read.format("lyric_files")``: options path, suffix (only names that end so), together (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "lyric_files"

    def schema(self) -> str:
        return "name string, text string"

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LyricFiles)


def words_of(songs: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(song_id, word_idx, word) and (song_id, metadata) of texts (song_id, text) of a format; word as in
    ``functions.word``. Plain text has no metadata; songs without any may lack a row."""
    none = F.create_map().cast("map<string,string>")
    if kind == "txt":
        own = T.from_text(songs).select("song_id", F.col("word_idx").cast("int").alias("word_idx"), W.word(F.col("reading")).alias("word"))
        return own, songs.select("song_id", none.alias("metadata"))
    if kind == "lrc":
        items = L.lrc_items(songs)
        own = L.spread(L.lrc_lines(items))
        return own.select("song_id", F.col("word_idx").cast("int").alias("word_idx"), W.word(F.col("reading"), F.col("t")).alias("word")), L.lrc_metadata(items)
    if kind == "nico":
        own = L.stamped_lyrics(songs)
        return own.select("song_id", F.col("word_idx").cast("int").alias("word_idx"), "word"), L.stamped_metadata(songs)
    if kind == "json":
        docs = songs.select("song_id", L.from_json(F.col("text")).alias("d"))
        parts = docs.select("song_id", F.posexplode("d.words").alias("word_idx", "w"))
        syllables = F.transform("w.syllables", lambda s: W.syllable(s["reading"], F.when(s["isSet"], s["time"])))
        return parts.select("song_id", "word_idx", W.with_syllables(F.col("w.reading"), syllables, F.col("w.withRuby"), F.col("w.isReadingAutoGenerated")).alias("word")), docs.select("song_id", "d.metadata")
    raise ValueError(f"no such format: {kind}")


def texts_of(words: DataFrame, metadata: DataFrame, kind: str) -> DataFrame:
    """(song_id, text) of words and metadata as ``words_of`` gives them."""
    flat = words.select("song_id", "word_idx", F.col("word.reading").alias("reading"), W.start_time(F.col("word")).alias("t"))
    if kind == "txt":
        return T.to_text(flat)
    if kind == "lrc":
        return L.to_lrc(flat, metadata)
    if kind == "nico":
        return L.to_stamped(words, metadata)
    if kind == "json":
        syllable = lambda s: F.struct(s["reading"].alias("reading"), F.coalesce(s["t"], F.lit(0)).cast("double").alias("time"), s["t"].isNotNull().alias("isSet"))
        word = F.struct(F.col("word.reading").alias("reading"), F.transform("word.syllables", syllable).alias("syllables"), F.col("word.with_ruby").alias("withRuby"), F.col("word.auto").alias("isReadingAutoGenerated"))
        rows = words.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", word.alias("word")))).alias("w"))
        rows = metadata.select("song_id", "metadata").join(rows, "song_id", "full_outer")
        own = F.coalesce(F.transform("w", lambda x: x["word"]), F.array().cast(L.S.ArrayType(L.WORD)))
        return rows.select("song_id", L.to_json(own, F.coalesce("metadata", F.create_map().cast("map<string,string>"))).alias("text"))
    raise ValueError(f"no such format: {kind}")


def read(spark: SparkSession, folder: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Words and metadata of a folder's files of a format; song_id is the number in a file's name (``7.lrc``);
    files with other names aren't songs."""
    register(spark)
    files = spark.read.format("lyric_files").option("suffix", f".{EXTENSIONS[kind]}").load(folder)
    number = F.regexp_extract("name", r"^(-?\d+)\.[^.]+$", 1).try_cast("bigint")
    return words_of(files.select(number.alias("song_id"), "text").where("song_id is not null"), kind)


def write(words: DataFrame, metadata: DataFrame, folder: str, kind: str, mode: str = "append") -> None:
    """A file for each song, named by its number; ``overwrite`` removes a folder's other files."""
    register(words.sparkSession)
    rows = texts_of(words, metadata, kind).where("song_id is not null")
    rows.select(F.concat(F.col("song_id").cast("string"), F.lit(f".{EXTENSIONS[kind]}")).alias("name"), "text").write.format("lyric_files").mode(mode).save(folder)
