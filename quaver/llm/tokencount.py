"""Operator 12, token counts through a cache of digests.

A stored count belongs to the digest of a text's normalised content and to the digest of what made it: the
tokenizer's file, the library, its version and the normalisation. Texts are known by their digests
alone; those without a stored count are encoded, one text for each digest, their counts are appended to
the cache, and every row gets its count from there.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quaver.llm.common import cut, fresh, light, prepare, small

LIMIT = 2048
STORED = "content binary, n_tokens long"
#: Texts of a batch that a library is given at once.
AT_ONCE = 64
#: Digests that a task remembers, so that rows which repeat a key and a text are encoded once.
REMEMBERED = 200_000


def spec_of(tokenizer: str) -> dict:
    if not tokenizer.endswith(".json"):
        return {}
    with open(tokenizer, encoding="utf-8") as f:
        return json.load(f)


def folds_blanks(spec: dict) -> bool:
    """Whether runs of white space are one blank to this tokenizer whatever they are, so that texts which
    differ in them only have the same tokens."""
    found = spec.get("normalizer") or {}
    steps = found.get("normalizers", [found])
    loose = any(x["lstrip"] or x["rstrip"] or x["single_word"] or " " in x["content"] for x in spec.get("added_tokens", []))
    return not loose and any(x.get("type") == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in steps)


def words_of(spec: dict) -> bool:
    """Whether ``wordbpe`` encodes for this tokenizer file."""
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    return folds_blanks(spec) and bool(spec["model"].get("end_of_word_suffix")) and split.get("behavior") == "Removed"


def version_of(tokenizer: str) -> str:
    """Digest of all that a count depends on besides the content."""
    library = "tokenizers" if tokenizer.endswith(".json") else "sentencepiece"
    with open(tokenizer, "rb") as f:
        own = hashlib.sha256(f.read()).hexdigest()
    said = f"{own} {library} {importlib.metadata.version(library)} {folds_blanks(spec_of(tokenizer))}"
    return hashlib.sha256(said.encode()).hexdigest()


def content(text: Column, tokenizer: str) -> Column:
    """The text as it is counted: runs of ASCII white space as one blank if the tokenizer does so
    itself, else unchanged; empty if null."""
    own = F.coalesce(text, F.lit(""))
    return F.regexp_replace(own, r"[\x20\x09-\x0D]+", " ") if folds_blanks(spec_of(tokenizer)) else own


_counters: dict = {}


def counter(tokenizer: str):
    """This worker's function from an Arrow column of texts to their numbers of tokens."""
    if tokenizer not in _counters:
        _counters.clear()
        _counters[tokenizer] = _counter(tokenizer)
    return _counters[tokenizer]


def _counter(tokenizer: str):
    if not tokenizer.endswith(".json"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        many = lambda texts: map(len, pieces.encode(texts, num_threads=1))
    elif words_of(spec_of(tokenizer)):
        from quaver.llm.wordbpe import encoder

        return lambda texts: [n for _, _, at in encoder(tokenizer).encode(texts) for n in (at[1:] - at[:-1]).tolist()]
    else:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(tokenizer)
        library.no_truncation()
        library.no_padding()
        many = lambda texts: (len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False))
    return lambda texts: [n for i in range(0, len(texts), AT_ONCE) for n in many(texts.slice(i, AT_ONCE).to_pylist())]


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """content (binary digest), n_tokens: what the cache holds for a version, each digest once however
    often an append was repeated."""
    try:
        found = spark.read.schema(STORED).parquet(f"{cache.rstrip('/')}/version={version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)
    return found.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def encoded(texts: DataFrame, tokenizer: str) -> DataFrame:
    """content, n_tokens of the rows of texts (content: the digest; text); a digest that a task meets
    again isn't encoded again."""

    @light
    def run(batches):
        known: set[bytes] = set()
        for batch in batches:
            names = batch.column(0).to_pylist()
            rows = [i for i, x in enumerate(names) if x not in known and not known.add(x)]
            own = batch.column(1).take(pa.array(rows, pa.int64()))
            n = counter(tokenizer)(own) if rows else []
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in rows], pa.binary()), pa.array(n, pa.int64())], ["content", "n_tokens"])
            if len(known) > REMEMBERED:
                known.clear()

    return texts.select("content", "text").mapInArrow(run, STORED)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The columns of docs but the text, with n_bytes long (of the text in UTF-8), n_tokens long and
    over_limit boolean (more than ``limit`` tokens).

    ``tokenizer`` is a file of the tokenizers library (.json) or of sentencepiece (.model); counts are
    theirs without special tokens added, truncation or padding, special strings in a text as the
    library takes them. ``cache`` names a folder that executors share; it needn't exist, and holds
    a folder for each version. Texts whose digest it has aren't encoded, others once for each digest, and
    their counts are appended before rows are returned. An append that a failed job leaves half done
    isn't read, one that is repeated changes nothing.

    A null or empty text has no bytes and the tokens of an empty one; rows may repeat a key or have none;
    an empty table gives no rows. Columns of docs that have the names above are replaced, others stay.
    """
    prepare(docs.sparkSession)
    spark, version = docs.sparkSession, version_of(tokenizer)
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), "n_bytes", "n_tokens", "over_limit")]
    name = fresh(docs, "content_")
    whole = content(F.col(text), tokenizer)
    digest = F.unhex(F.sha2(whole, 256))
    # Rows without their texts; what follows joins these, and reads the texts of misses once more.
    rows = cut(docs.select(*[F.col(f"`{c}`") for c in rest], digest.alias(name), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")))
    wanted = rows.groupBy(F.col(name).alias("content")).agg(F.min(key).alias("holder"))
    misses = cut(wanted.join(stored(spark, cache, version), "content", "left_anti"))
    if not misses.isEmpty():
        texts = docs.select(F.col(key).alias("own"), digest.alias("name"), whole.alias("text"))
        held = F.col("own").eqNullSafe(F.col("holder")) & (F.col("name") == F.col("content"))
        first = texts.join(small(misses, 64), held, "left_semi").select(F.col("name").alias("content"), "text")
        encoded(first, tokenizer).write.mode("append").parquet(f"{cache.rstrip('/')}/version={version}")
    counts = stored(spark, cache, version).join(wanted.select("content"), "content", "left_semi")
    out = rows.join(small(cut(counts), 64), F.col(name) == F.col("content"))
    return out.select(*[F.col(f"`{c}`") for c in rest], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
