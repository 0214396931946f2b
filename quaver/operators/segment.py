"""Segmentation by a lexicon: the cheapest way through the lattice of the words that a sentence can be made of.

A lexicon (surface, reading, cost) becomes an automaton over shared beginnings that each worker makes once
from a broadcast of counted size. A sentence is walked backwards: from each character on, every word of the
lexicon that fits, and the character alone as an unknown word, is tried before the cheapest rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from quaver.functions.units import UNITS, units

#: A lexicon of more words or characters isn't broadcast.
MOST_WORDS, MOST_CHARS = 1_000_000, 16_000_000
#: Characters of texts that a worker takes apart at a time.
TOGETHER = 1 << 18
#: Bytes of a batch that is sent to a worker, where the session has Spark's default of 64 MB.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: What a character costs that no word of the lexicon covers.
UNKNOWN = 10_000
TOKENS = "array<struct<surface:string,reading:string>>"


class Automaton:
    """Words by shared beginnings: a state for each beginning, an edge for each next character."""

    def __init__(self, words: list[tuple[str, str | None, int]]):
        self.edges: dict[tuple[int, str], int] = {}
        self.ends: dict[int, tuple[int, str | None]] = {}
        n = 0
        for surface, reading, cost in sorted(words, key=lambda w: (w[0], w[2], w[1] is None, w[1] or "")):
            state = 0
            for c in surface:
                if (to := self.edges.get((state, c))) is None:
                    n += 1
                    to = self.edges[state, c] = n
                state = to
            if surface and state not in self.ends:  # the cheapest of equal surfaces
                self.ends[state] = (cost, reading)

    def from_place(self, text: str, i: int):
        """(end, cost, reading) of each word that begins at i."""
        state = 0
        for j in range(i, len(text)):
            if (state := self.edges.get((state, text[j]), -1)) < 0:
                return
            if state in self.ends:
                yield j + 1, *self.ends[state]

    def cheapest(self, text: str, unknown: int) -> list[tuple[str, str | None]]:
        """Surfaces and readings of the cheapest path; of equal ones that of fewer words, then that whose
        first words are longer."""
        n = len(text)
        best: list[tuple] = [(0, 0)] * (n + 1)
        step: list[tuple] = [()] * n
        for i in range(n - 1, -1, -1):
            options = [*self.from_place(text, i), (i + 1, unknown, None)]
            found = min(((cost + best[j][0], 1 + best[j][1], -j, r is None, r or "") for j, cost, r in options))
            best[i] = found[:2]
            step[i] = (-found[2], None if found[3] else found[4])
        out, i = [], 0
        while i < n:
            j, reading = step[i]
            out.append((text[i:j], reading))
            i = j
        return out


_made: dict = {}


def collected(lexicon: DataFrame) -> list[tuple]:
    """The lexicon's rows, if they are few enough to be sent everywhere."""
    own = lexicon.where("surface is not null and surface <> '' and cost is not null").select("surface", "reading", F.col("cost").cast("long"))
    size = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("surface") + F.coalesce(F.length("reading"), F.lit(0))), F.lit(0)).alias("chars")).first()
    if size.n > MOST_WORDS or size.chars > MOST_CHARS:
        raise ValueError(f"a lexicon of {size.n} words and {size.chars} characters isn't sent to workers")
    return [tuple(r) for r in own.collect()]


def segmenter(lexicon: DataFrame, unknown: int = UNKNOWN):
    """A function from a text Column to its tokens (array of surface and reading, the latter null where the
    lexicon has none), for a lexicon of surface, reading, cost (whole numbers). A null text has none."""
    spark = lexicon.sparkSession
    if spark.conf.get(BATCH) == f"{64 << 20}b":
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")
    sent, name = spark.sparkContext.broadcast(collected(lexicon)), uuid.uuid4().hex

    def automaton() -> Automaton:
        if name not in _made:
            _made.clear()
            _made[name] = Automaton(sent.value)
        return _made[name]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = automaton()
        for texts in batches:
            for part in parts(texts):
                yield tokens_array(None if t is None else own.cheapest(t, unknown) for t in part.to_pylist())

    return lambda text: arrow_udf(run, TOKENS)(text)


def parts(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, as many together as have TOGETHER characters, one at least: so a worker holds few texts' tokens."""
    first, chars = 0, 0
    for k, n in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        if k > first and chars + n > TOGETHER:
            yield texts.slice(first, k - first)
            first, chars = k, 0
        chars += n
    if first < len(texts):
        yield texts.slice(first)


def tokens_array(rows: Iterable[list[tuple[str, str | None]] | None]) -> pa.Array:
    """Tokens of texts, column by column."""
    surfaces: list[str] = []
    readings: list[str | None] = []
    offsets: list[int | None] = []
    for row in rows:
        offsets.append(None if row is None else len(surfaces))
        for surface, reading in row or ():
            surfaces.append(surface)
            readings.append(reading)
    own = pa.StructArray.from_arrays([pa.array(surfaces, pa.string()), pa.array(readings, pa.string())], ["surface", "reading"])
    return pa.ListArray.from_arrays(pa.array([*offsets, len(surfaces)], pa.int32()), own)


def token_units(tokens: Column) -> Column:
    """Reading units (surface, readings) of a sentence's tokens, one after another."""

    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([[] if r is None else [u for t in r for u in units(t["surface"], t["reading"])] for r in rows], dtype=pd.ArrowDtype(pa.list_(pa.struct([("surface", pa.string()), ("readings", pa.list_(pa.string()))]))))

    return pandas_udf(run, UNITS)(tokens)


def analysed(words: DataFrame, lexicon: DataFrame, unknown: int = UNKNOWN) -> DataFrame:
    """song_id, word_idx, nth, surface, readings: the units of words (song_id, word_idx, word), as
    ``edit.segmented`` takes them."""
    tokens = segmenter(lexicon, unknown)
    own = words.select("song_id", "word_idx", tokens(F.col("word.reading")).alias("tokens"))
    return own.select("song_id", "word_idx", F.posexplode(token_units(F.col("tokens"))).alias("nth", "u")).select("song_id", "word_idx", "nth", "u.*")
