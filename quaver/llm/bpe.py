"""Operator 9, byte-pair encoding and decoding through a transducer lexicon of frequent words."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm.common import cut, light, prepare, shared_dir
from quaver.llm.lexicon import compile_lexicon
from quaver.llm.wordbpe import WordBpe, encoder

#: Words in the lexicon and the bytes of the longest: no more than 4 MB come to the driver. Longer words
#: are merged like rare ones.
LEXICON_WORDS, LEXICON_BYTES = 65_536, 64
#: Distinct words that a task tallies before it sends what it has.
TALLY_WORDS = 400_000


def word_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(word binary, n long): how often each word of the tokenizer's split occurs in all texts.

    Null and empty texts have no words; an empty table gives no rows.
    """
    prepare(docs.sparkSession)

    @light
    def tallies(batches):
        tally: dict[bytes, int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(tally.keys(), pa.binary()), pa.array(tally.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            encoder(tokenizer).count(batch.column(0), tally)
            if len(tally) > TALLY_WORDS:
                yield out()
                tally.clear()
        yield out()

    return docs.select(text).mapInArrow(tallies, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, text: str = "text", size: int = LEXICON_WORDS) -> str:
    """Compiles the most frequent words of all texts, those above the count that at most ``size``
    words reach; adds the file to the Spark application from the shared folder and returns its
    name for SparkFiles."""
    spark = docs.sparkSession
    counts = cut(word_counts(docs, tokenizer, text).where((F.col("n") > 1) & (F.octet_length("word") <= LEXICON_BYTES)))
    # Counts of counts, of three digits above 1000, so that few rows tell where to cut.
    unit = F.pow(10, F.greatest(F.floor(F.log10("n")) - 2, F.lit(0))).cast("long")
    steps = counts.groupBy((F.floor(F.col("n") / unit) * unit).alias("least")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("least")).collect()
    total, least = 0, None
    for r in steps:
        total += r.words
        if total > size:
            break
        least = r.least
    top = counts.where(F.col("n") >= least).select("word").collect() if least else []
    words = sorted(bytes(r.word) for r in top)
    whole, _ = compile_lexicon(dict(zip(words, WordBpe(tokenizer).merge(words), strict=True)))
    return share_file(spark, whole, f"lexicon-{uuid.uuid4().hex}.bin")


def share_file(spark: SparkSession, whole: bytes, name: str) -> str:
    from pyarrow.fs import FileSystem

    uri = f"{shared_dir(spark).rstrip('/')}/{name}"
    fs, path = FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as f:
        f.write(whole)
    spark.sparkContext.addFile(uri)
    return name


def encode(docs: DataFrame, tokenizer: str, lexicon: str | None = None, text: str = "text") -> DataFrame:
    """docs with ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (UTF-8 binary).

    Ids equal the tokenizers library's without special tokens added, truncation or padding; the
    decoded text its decode(ids, skip_special_tokens=False). A null or empty text has no ids and
    decodes to an empty text. Columns named ids or decoded in docs are replaced; others stay.
    ``lexicon`` is a name from ``build_lexicon``; without one every word is merged.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("ids", "decoded")
    schema = docs.select("*").schema.add("ids", "binary").add("decoded", "binary")
    at = docs.columns.index(text)

    @light
    def run(batches):
        for batch in batches:
            coder = encoder(tokenizer, SparkFiles.get(lexicon) if lexicon else None)
            ids, decoded = [], []
            for _, found, bounds in coder.encode(batch.column(at)):
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = found[a:b].astype("<u4")
                    ids.append(own.tobytes())
                    decoded.append(coder.decode(own))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], [*batch.schema.names, "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer: str, lexicon: str | None = None, text: str = "text") -> DataFrame:
    """The columns of docs but the text, with n_tokens, ids_sha256 and decoded_sha256 of ``encode``.

    Only digests leave the task, whatever the texts' lengths. Empty tables give no rows.
    """
    prepare(docs.sparkSession)
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), "n_tokens", "ids_sha256", "decoded_sha256")]
    docs = docs.select(*rest, text)
    schema = docs.select(*rest).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    @light
    def run(batches):
        for batch in batches:
            coder = encoder(tokenizer, SparkFiles.get(lexicon) if lexicon else None)
            n, one, two = [], [], []
            for _, found, bounds in coder.encode(batch.column(len(rest))):
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = found[a:b].astype("<u4")
                    n.append(b - a)
                    one.append(hashlib.sha256(own.tobytes()).hexdigest())
                    two.append(hashlib.sha256(coder.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], schema.names)

    return docs.mapInArrow(run, schema)


def decode_ids(whole: bytes, tokenizer: str) -> str:
    """Text of ids that ``encode`` gave."""
    return encoder(tokenizer).decode(np.frombuffer(whole, "<u4")).decode()
