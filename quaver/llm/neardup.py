"""Operator 1, near-duplicate documents by Order MinHash and banded alignment.

K-mers are five words, each labelled with its occurrence number, so that none occurs twice in a
text (a text of one to four words is one k-mer). For each of ``TABLES`` orders a text keeps its
``PICK`` smallest k-mers, in text order; texts with equal tuples share a bucket.

1. All members of a bucket are compared with its smallest document.
2. Where that leaves a bucket in parts, its members (and all texts of few k-mers) are joined exactly: of a
   pair, each text must have one of the k-mers that both share among the rarest few of its own, as few as
   the similarity and both lengths allow, and what follows the last shared one of these must be enough. So
   k-mers that a crowd of texts have meet only where they can decide, and no such pair is lost.

A candidate pair is verified by aligning the two k-mer sequences within a band: the longest common
subsequence over the size of the union must reach the similarity. Equal texts are settled
beforehand by their digest.
"""

from __future__ import annotations

from bisect import bisect_left
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.llm.common import beside, components, cut, extended, fresh, light, prepare, small
from quaver.llm.textbuf import grams, joined, mix, slices

KMER, TABLES, PICK, SIMILAR = 5, 24, 4, 0.8
#: Texts of fewer k-mers have too few for the tables; all of them take the second step.
BRIEF = 10
#: Classes of lengths within a similarity's span: a text is looked up among those that have a class's length.
CLASSES = 4
_rng = np.random.Generator(np.random.PCG64(77))
SALT = _rng.integers(1, 2**63, TABLES, dtype=np.uint64)
ODD = _rng.integers(1, 2**63, TABLES, dtype=np.uint64) | np.uint64(1)


def labelled(words, k: int = KMER) -> list[np.ndarray]:
    """The occurrence-labelled k-mers of each document of a slice, in text order."""
    whole = grams(words.hash, k)
    out: list[np.ndarray] = []
    doc = words.doc()
    if len(whole):
        at = np.flatnonzero(doc[: len(whole)] == doc[k - 1 :])
        key, own = whole[at], doc[at]
        by = np.lexsort((key, own))
        same = np.zeros(len(by), bool)
        same[1:] = (key[by][1:] == key[by][:-1]) & (own[by][1:] == own[by][:-1])
        number = np.arange(len(by))
        nth = np.empty(len(by), np.uint64)
        nth[by] = number - np.maximum.accumulate(np.where(same, 0, number))
        key = mix(key + nth * np.uint64(0x9E3779B97F4A7C15), 41)
        ends = np.searchsorted(own, np.arange(words.n + 1))
    for d, n in enumerate(words.count.tolist()):
        if n >= k:
            out.append(key[ends[d] : ends[d + 1]])
        elif n:
            out.append(grams(words.hash[words.at[d] : words.at[d + 1]], n, 40 + n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(kmers: np.ndarray) -> np.ndarray:
    """TABLES keys: the PICK smallest k-mers of each order, hashed in text order."""
    n = len(kmers)
    if n <= PICK:
        tuples = np.broadcast_to(kmers, (TABLES, n))
    else:
        tuples = np.empty((TABLES, PICK), np.uint64)
        for t in range(TABLES):
            at = np.argpartition((kmers ^ SALT[t]) * ODD[t], PICK - 1)[:PICK]
            at.sort()
            tuples[t] = kmers[at]
    key = SALT.copy()
    for j in range(tuples.shape[1]):
        key = mix(joined(key, tuples[:, j], 0), 50)
    return key


def alignment(a: np.ndarray, b: np.ndarray, similar: float = SIMILAR) -> float:
    """|longest common subsequence| / |union| of two labelled k-mer sequences, 0.0 if it is surely
    below ``similar``: an alignment that reaches it stays within the band |i - j| <= total
    unmatched k-mers."""
    total = len(a) + len(b)
    if not len(a) or not len(b) or min(len(a), len(b)) < similar * max(len(a), len(b)):
        return 0.0
    by = np.argsort(b)
    at = np.minimum(np.searchsorted(b[by], a), len(b) - 1)
    hit = np.flatnonzero(b[by[at]] == a)
    to = by[at[hit]]
    band = (1 - similar) / (1 + similar) * total
    near = np.abs(hit - to) <= band + 1e-9
    to = to[near]
    if len(to) < similar * (total - len(to)) - 1e-9:
        return 0.0
    if (np.diff(to) > 0).all():
        best = len(to)
    else:
        tails: list[int] = []
        for j in to.tolist():
            k = bisect_left(tails, j)
            tails[k : k + 1] = [j]
        best = len(tails)
    return best / (total - best)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n (k-mers), keys (array of TABLES) of each row of docs (doc_id, text)."""

    @light
    def run(batches):
        for batch in batches:
            n, keys = [], []
            for words in slices(batch.column(1)):
                for kmers in labelled(words):
                    n.append(len(kmers))
                    keys.append(signature(kmers))
            flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * TABLES, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int32()), lists], ["doc_id", "digest", "n", "keys"])

    own = docs.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    return own.mapInArrow(run, "doc_id long, digest binary, n int, keys array<long>")


def sequences(docs: DataFrame) -> DataFrame:
    """doc_id, which (of the text, to tell rows of one doc_id apart), n, kmers: the labelled k-mers in
    text order."""

    @light
    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                own = [k for words in slices(part.column(2)) for k in labelled(words)]
                n = np.fromiter(map(len, own), np.int32, len(own))
                flat = np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), lists], ["doc_id", "which", "n", "kmers"])

    own = docs.select("doc_id", F.xxhash64("text").alias("which"), "text")
    return own.mapInArrow(run, "doc_id long, which long, n int, kmers array<long>")


def verified(pairs: DataFrame, known: DataFrame, similar: float) -> DataFrame:
    """The distinct rows (a, b) of pairs whose ``sequences`` are similar by ``alignment``."""
    both = beside(pairs, known.select("doc_id", "kmers"), "doc_id").select("a", "b", F.col("left.kmers").alias("x"), F.col("right.kmers").alias("y"))

    @light
    def run(batches):
        for batch in batches:
            ok = []
            for k in range(batch.num_rows):
                one, two = (np.asarray(batch.column(c)[k].values).view(np.uint64) for c in (2, 3))
                ok.append(alignment(one, two, similar) >= similar - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def prefixes(known: DataFrame, similar: float) -> DataFrame:
    """doc_id, n, kmer, at: of each text the k-mers of which it must share one with any text that is
    similar to it: all but ``similar`` * n of them, and one more, the rarest of the table first (at: from 1).
    Of these, those that no other text has are left out; many texts have no others."""
    own = known.select("doc_id", "which", "n", F.explode("kmers").alias("kmer"))
    held = own.groupBy("kmer").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    text = Window.partitionBy("doc_id", "which")
    ranked = own.join(held, "kmer").withColumn("nth", F.row_number().over(text.orderBy("f", "kmer"))).withColumn("alone", F.col("n") - F.count(F.lit(1)).over(text))
    ranked = ranked.select("doc_id", "n", "kmer", (F.col("nth") + F.col("alone")).alias("at"))
    return ranked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * F.lit(similar) - 1e-9) + 1)


#: Columns by which a list of texts is known: a k-mer and the classes of the two lengths.
LIST = ["kmer", "low", "high"]


def _enough(similar: float, n: Column, m: Column) -> Column:
    """K-mers that two texts of n and m share at least if they are similar."""
    return F.lit(similar / (1 + similar)) * (n + m) - 1e-6


def listed(rows: DataFrame, similar: float) -> DataFrame:
    """LIST, doc_id, n, at, under, over: a text's k-mers of ``prefixes`` (doc_id, n, kmer, at) by the length that
    the other text of a pair has, as far as they count for that length; under and over: the text may be the shorter or
    the longer one of that list."""
    step = -log(similar) / CLASSES
    own = rows.withColumn("class", F.floor(F.log("n") / step).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.col("class") - CLASSES - 1, F.col("class") + CLASSES + 1)))
    least = F.greatest(F.exp(F.col("other") * step) * (1 - 1e-9), F.col("n") * similar)
    own = own.where((least <= F.col("n") / similar + 1e-6) & (F.col("at") <= F.col("n") - _enough(similar, F.col("n"), least) + 1))
    return own.select("kmer", F.least("class", "other").alias("low"), F.greatest("class", "other").alias("high"), "doc_id", "n", "at", (F.col("class") <= F.col("other")).alias("under"), (F.col("class") >= F.col("other")).alias("over"))


def in_parts(rows: DataFrame) -> DataFrame:
    """rows (``listed`` and root) of the lists that have texts of two components, with ``most``, the one that has
    most of the list's texts, and ``lead`` and ``end``, its smallest and its greatest text there."""
    parts = rows.groupBy(*LIST, "root").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("lead"), F.max("doc_id").alias("end"))
    lists = parts.groupBy(*LIST).agg(F.max(F.struct("m", "root", "lead", "end")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    return cut(rows.join(small(cut(lists.select(*LIST, F.col("top.root").alias("most"), "top.lead", "top.end")), 48), LIST))


def _meet(one: DataFrame, two: DataFrame, similar: float) -> DataFrame:
    """Rows of a list's texts side by side (_a and _b), where their k-mer can be the rarest that both share."""
    side = lambda df, k: df.select(*LIST, *[F.col(c).alias(f"{c}_{k}") for c in df.columns if c not in LIST])
    both = side(one, "a").join(side(two, "b"), LIST).where("root_a <> root_b and ((under_a and over_b) or (over_a and under_b))")
    both = both.where(F.least("n_a", "n_b") >= F.lit(similar) * F.greatest("n_a", "n_b") - 1e-9)
    first = lambda k: F.col(f"at_{k}") <= F.col(f"n_{k}") - _enough(similar, F.col("n_a"), F.col("n_b")) + 1
    return both.where(first("a") & first("b"))


def lead_pairs(rows: DataFrame, similar: float) -> DataFrame:
    """a, b: the texts of each list of rows (``in_parts``) with two texts of the list's largest component."""
    both = _meet(rows.where("root <> most"), rows.where("doc_id = lead or doc_id = end"), similar)
    return both.select(F.greatest("doc_id_a", "doc_id_b").alias("a"), F.least("doc_id_a", "doc_id_b").alias("b")).distinct()


def rare_pairs(rows: DataFrame, similar: float) -> DataFrame:
    """a, b: all pairs of texts of different components that can be similar; rows as ``in_parts`` gives them.

    Two texts of n and m k-mers share at least similar / (1 + similar) * (n + m) of them, so one of those
    that are at most n (m) less that many, and one, from a text's rarest. In a list, texts of its largest
    component meet the others only. Of a pair, the shared k-mers of the lists and all that come after
    the last of them must be as many as it takes.
    """
    both = _meet(rows.where("root <> most"), rows, similar).where("root_b = most_b or doc_id_a > doc_id_b")
    swap = F.col("doc_id_a") < F.col("doc_id_b")
    side = lambda c, k: F.when(swap, F.col(f"{c}_{'ba'[k]}")).otherwise(F.col(f"{c}_{'ab'[k]}"))
    told = both.groupBy(side("doc_id", 0).alias("a"), side("doc_id", 1).alias("b"), side("n", 0).alias("n"), side("n", 1).alias("m"))
    told = told.agg(F.count(F.lit(1)).alias("shared"), F.max(side("at", 0)).alias("i"), F.max(side("at", 1)).alias("j"))
    return told.where(F.col("shared") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= _enough(similar, F.col("n"), F.col("m"))).select("a", "b").distinct()


def linked(single: DataFrame, texts: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """Components (node, root) of pairs of similar texts, by the two steps that the module describes, and the pairs (a, b) that came last and
    aren't in them; single has doc_id, n, keys."""
    spread = single.select("doc_id", F.posexplode("keys").alias("table", "key"))
    buckets = spread.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where("lead < high")
    met = cut(spread.join(buckets.select("key", "lead", "n"), "key").where("doc_id <> lead"))
    pairs = cut(met.select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).distinct())
    brief = single.where(F.col("n") < BRIEF).select("doc_id")
    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(brief).distinct())
    known = cut(sequences(texts.join(small(ids), "doc_id", "left_semi")))
    good = cut(verified(pairs, known, similar))

    roots = components(good)
    name = lambda df, c, out: df.join(small(roots.select(F.col("node").alias(c), F.col("root").alias(out))), c, "left").withColumn(out, F.coalesce(out, c))
    told = name(name(met.where("n > 2"), "doc_id", "root"), "lead", "own")
    apart = cut(told.groupBy("key").agg(F.max(F.col("root") != F.col("own")).alias("any")).where("any").select("key"))
    open_ = told.join(small(apart, 16), "key", "left_semi").select("doc_id", "lead")
    left = cut(open_.select("doc_id").union(open_.select("lead")).union(brief).distinct())
    rows = cut(listed(prefixes(known.join(small(left), "doc_id", "left_semi"), similar), similar))
    # Most components of a crowd become one by two texts of it; what is left apart is joined exactly.
    first = cut(lead_pairs(in_parts(name(rows, "doc_id", "root")), similar).join(pairs, ["a", "b"], "left_anti"))
    led = cut(verified(first, known, similar))
    roots = extended(roots, led)
    tried = pairs.union(first)
    more = cut(rare_pairs(in_parts(name(rows, "doc_id", "root")), similar).join(tried, ["a", "b"], "left_anti"))
    return roots, cut(verified(more, known, similar))


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id for each row: the smallest doc_id that near-copies lead to.

    A doc_id is one document; rows that repeat it share its class. Rows without a text or with a
    blank one are alone, except that equal texts are always one class; a row without a doc_id has
    no class (null). Columns other than doc_id and text aren't used. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    signed = cut(signatures(texts))
    firsts = signed.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copied = cut(firsts.where("first < last").select("digest", "first"))
    later = cut(
        signed.select("doc_id", "digest").join(small(copied, 64), "digest").where("doc_id > first").select("doc_id", "first").distinct()
    )
    # A doc_id that repeats a text may have others too; they stay, its rows once each.
    copies = signed.join(small(copied, 64), "digest").where("doc_id > first").select("doc_id", "digest").distinct()
    single = signed.join(small(cut(copies), 64), ["doc_id", "digest"], "left_anti").where("n > 0").dropDuplicates(["doc_id", "digest"]).select("doc_id", "n", "keys")
    copied_from = later.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    roots, more = linked(single, texts, similar)
    names = extended(roots, more.union(copied_from))
    out = docs.select("doc_id").join(small(names), F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs without the rows whose class has a smaller doc_id; of rows that repeat a doc_id one, by
    text, stays. Rows without a doc_id stay."""
    classes = near_duplicates(docs, similar).where("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.join(small(cut(classes)), "doc_id", "left_anti").select(*docs.columns)
    twice = cut(kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id"))
    if twice.isEmpty():
        return kept
    nth = fresh(kept, "nth_")
    order = Window.partitionBy("doc_id").orderBy("text", F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    few = kept.join(small(twice), "doc_id", "left_semi").withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
    return kept.join(small(twice), "doc_id", "left_anti").unionByName(few).select(*docs.columns)
