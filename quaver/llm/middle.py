"""Operator 11, fill-in-middle: cut ranks found by counting boundaries in overlapping chunks.

A token is a run of ASCII white space with the run of other characters after it, or white space that
ends the text. So a token begins at the first character, and wherever white space follows anything else:
a predicate on two adjacent characters. A text is taken in chunks that begin one character early, so
that each such pair lies in one chunk; the pairs of every chunk are counted by themselves, prefix sums
over the counts tell the number of tokens and which chunk holds each of the two cut ranks, and only
those chunks are looked at again for the cuts' places. All of it is of one row: nothing is shuffled, and
the rows of a table are worked on wherever they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import fresh

BLANK = r"\x20\x09-\x0D"
#: Two adjacent characters between which a token ends and another begins.
BOUNDARY = rf"[^{BLANK}][{BLANK}]"
TOKEN = rf"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+"
#: Characters of a chunk, and the chunks of a text that has more than so many of them: finding a chunk's
#: place in a string takes a pass over it, so that their number, and not their length, is bounded.
CHUNK, CHUNKS = 2048, 32
#: The marks of the two forms.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the digest of ``seed:key``; a null key is an empty one."""
    own = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(own, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def chunk(text: Column, begin: Column, span: Column) -> Column:
    """``span`` characters from ``begin`` (from 0), and the one before them if there is one."""
    return F.substring(text, begin, span + (begin > 0).cast("int"))


def bounds(text: Column, span: Column, chars: Column) -> Column:
    """array<struct<begin, span, own, before>>: how many tokens begin in each chunk, but for the text's
    first one, and how many in all chunks before it."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(chars - 1, F.lit(0)), span), lambda b: F.struct(b.alias("begin"), F.regexp_count(chunk(text, b, span), F.lit(BOUNDARY)).alias("own")))
    nothing = F.lit(0).cast("long")
    return F.transform(
        pieces,
        lambda c, i: F.struct(
            c["begin"].alias("begin"),
            c["own"].cast("long").alias("own"),
            F.aggregate(F.slice(pieces, F.lit(1), i), nothing, lambda sum_, x: sum_ + x["own"]).alias("before"),
        ),
    )


def place(text: Column, chunks: Column, span: Column, chars: Column, n: Column, rank: Column) -> Column:
    """Characters of the first ``rank`` of n tokens; only the chunk where the next one begins is read."""
    owner = F.get(F.filter(chunks, lambda c: (c["before"] < rank) & (rank <= c["before"] + c["own"])), F.lit(0))
    tokens = F.regexp_extract_all(chunk(text, owner["begin"], span), F.lit(TOKEN), F.lit(0))
    inside = F.aggregate(F.slice(tokens, F.lit(1), (rank - owner["before"]).cast("int")), F.lit(0).cast("long"), lambda sum_, t: sum_ + F.length(t))
    return F.when(rank == 0, F.lit(0).cast("long")).when(rank == n, chars.cast("long")).otherwise(owner["begin"] - (owner["begin"] > 0).cast("int") + inside)


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with n long (tokens), form (plain, psm or spm), prefix_chars and middle_chars long (null if
    plain) and output: of ``rate`` per cent of the texts, told by the digest of ``seed:key``, a random run
    of tokens comes last, behind marks; ``spm`` per cent of these have the suffix first.

    A text that is null or empty is plain, and so is one that holds a mark: its output is the text (empty
    if null). A null key draws as an empty one, rows that repeat a key and text are cut alike, an empty
    table gives no rows. Columns of docs that have the names above are replaced; all others stay.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    whole, chars, span, chunks, own = (fresh(docs, f"{c}_") for c in ("whole", "chars", "span", "chunks", "own"))
    col = F.col
    kept = [col(f"`{c}`") for c in docs.columns]
    h = draws(col(key), seed)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(col(whole), F.lit(mark))
    counted = (
        docs.withColumn(whole, F.coalesce(col(text), F.lit("")))
        .withColumn(chars, F.length(col(whole)))
        .withColumn(span, F.greatest(F.lit(CHUNK), F.ceil(col(chars) / CHUNKS).cast("int")))
        .withColumn(chunks, bounds(col(whole), col(span), col(chars)))
    )
    last = F.element_at(chunks, -1)
    n = F.when(col(chars) == 0, F.lit(0).cast("long")).otherwise(last["before"] + last["own"] + 1)
    form = F.when((col(chars) == 0) | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    # One row of a generator: a filter on what follows isn't carried into the counting, which it would repeat.
    step = lambda df, *c: df.select(*kept, F.explode(F.array(F.struct(*c))).alias(own))
    at = lambda c: col(f"{own}.{c}")
    told = step(counted, col(whole).alias("text"), col(chars).alias("chars"), col(span).alias("span"), col(chunks).alias("chunks"), n.alias("n"), form.alias("form"))
    ranks = [x % (at("n") + 1) for x in h[:2]]
    there = at("form") != "plain"
    found = lambda rank: F.when(there, place(at("text"), at("chunks"), at("span"), at("chars"), at("n"), rank))
    cut = step(told, at("text").alias("text"), at("chars").alias("chars"), at("n").alias("n"), at("form").alias("form"), found(F.least(*ranks)).alias("first"), found(F.greatest(*ranks)).alias("second"))
    first, second, size = (at(c).cast("int") for c in ("first", "second", "chars"))
    prefix = F.substring(at("text"), F.lit(1), first)
    middle = F.substring(at("text"), first + 1, second - first)
    suffix = F.substring(at("text"), second + 1, size - second)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    other = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return cut.select(
        *kept,
        at("n").alias("n"),
        at("form").alias("form"),
        at("first").alias("prefix_chars"),
        (at("second") - at("first")).alias("middle_chars"),
        F.when(at("form") == "psm", psm).when(at("form") == "spm", other).otherwise(at("text")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` gave this output of this form for; no part of a text that was cut
    holds a mark, so the first of each is the operator's."""

    def between(mark: str | None, begin: str) -> Column:
        """From after the first ``begin`` to before the first ``mark``, or to the end."""
        start = F.locate(begin, output) + len(begin)
        return F.substring(output, start, (F.locate(mark, output) if mark else F.length(output) + 1) - start)

    psm = F.concat(between(SUFFIX, PREFIX), between(None, MIDDLE), between(MIDDLE, SUFFIX))
    spm = F.concat(between(MIDDLE, PREFIX), between(None, MIDDLE), between(PREFIX, SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
