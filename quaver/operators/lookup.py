"""Joins by time and place: as-of, previous and next, nearest, interval, positional."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import count
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType


def asof_tempo(points: DataFrame, tempo: DataFrame, fallback: bool = False, both: bool = False) -> DataFrame:
    """points with start_ms and bpm of the latest tempo row of their song that starts by t.

    One union and one sort by song instead of a join of all pairs. Of equal starts the greatest
    ordinal wins; a bpm of 0 or less gives null. With ``fallback`` points before the first row
    take that one; with ``both`` there is also bpm_or_first, the bpm that ``fallback`` gives. points has song_id,
    ordinal, t; tempo has song_id, ordinal, start_ms, bpm.
    """
    rest = [c for c in points.columns if c not in ("song_id", "ordinal", "t")]
    none = F.lit(None)
    row = F.struct(F.col("start_ms").cast("double").alias("start_ms"), F.col("bpm").cast("double").alias("bpm"))
    left = points.select("song_id", F.col("t").cast("double").alias("at_"), F.lit(1).alias("point_"), "ordinal", F.struct(*rest, "t").alias("own_"), none.cast("struct<start_ms:double,bpm:double>").alias("row_"))
    right = tempo.select("song_id", F.col("start_ms").cast("double").alias("at_"), F.lit(0).alias("point_"), "ordinal", none.cast(left.schema["own_"].dataType).alias("own_"), row.alias("row_"))
    order = Window.partitionBy("song_id").orderBy("at_", "point_", "ordinal")
    found = F.last("row_", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    least = F.coalesce(found, F.first("row_", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    out = left.unionByName(right)
    if both:
        out = out.withColumn("least_", least)
    out = out.withColumn("row_", least if fallback else found).where("point_ = 1")
    bpm = F.col("row_.bpm")
    return out.select("song_id", "ordinal", "own_.*", F.col("row_.start_ms").alias("start_ms"), (bpm if fallback else F.when(bpm > 0, bpm)).alias("bpm"), *([F.col("least_.bpm").alias("bpm_or_first")] if both else []))


def neighbours(points: DataFrame, tempo: DataFrame) -> DataFrame:
    """points with prev_start (the greatest start before t) and next_start (the least after it)."""
    left = points.select("song_id", "ordinal", "t", F.lit(None).cast("double").alias("s"))
    right = tempo.select("song_id", F.lit(None).cast("bigint").alias("ordinal"), F.col("start_ms").alias("t"), F.col("start_ms").cast("double").alias("s"))
    order = Window.partitionBy("song_id").orderBy("t")
    out = left.unionByName(right)
    out = out.withColumn("prev_start", F.max("s").over(order.rangeBetween(Window.unboundedPreceding, -1)))
    out = out.withColumn("next_start", F.min("s").over(order.rangeBetween(1, Window.unboundedFollowing)))
    return out.where("ordinal is not null").drop("s")


def nearest(points: DataFrame, tempo: DataFrame) -> DataFrame:
    """points with seg_idx, the number of the tempo row whose start is nearest, the first of equals.

    The nearest row is the latest start at or before t or the first after it, so two as-of lookups
    and a choice give it. Rows are numbered by (start_ms, ordinal).
    """
    order = Window.partitionBy("song_id").orderBy("start_ms", "ordinal")
    numbered = tempo.withColumn("seg_idx", F.row_number().over(order) - 1)
    firsts = numbered.groupBy("song_id", "start_ms").agg(F.min("seg_idx").alias("seg_idx"))
    left = points.select("song_id", "ordinal", "t", F.lit(1).alias("point"), F.lit(None).cast("struct<s:bigint,i:int>").alias("row"))
    right = firsts.select("song_id", F.lit(None).cast("bigint").alias("ordinal"), F.col("start_ms").alias("t"), F.lit(0).alias("point"), F.struct(F.col("start_ms").cast("bigint").alias("s"), F.col("seg_idx").cast("int").alias("i")).alias("row"))
    by = Window.partitionBy("song_id").orderBy("t", "point")
    before = F.last("row", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("row", ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    out = left.unionByName(right).withColumn("b", before).withColumn("a", after).where("point = 1")
    gap = lambda c: F.abs(F.col(f"{c}.s") - F.col("t"))
    pick = F.when(F.col("a").isNull() | (gap("b") <= gap("a")), F.col("b.i")).otherwise(F.col("a.i"))
    return out.select("song_id", "ordinal", "t", pick.alias("seg_idx"))


#: Parts that the words of a rule's base text are dealt to, where songs have rules of their own and where all share them.
SONG_PARTS, ALL_PARTS = 4, 64


def rule_spans(rules: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, nth, rule: from when on which rule holds for a base text (null: none), by one sweep; of
    spans that begin together the one with the greatest nth counts.

    Of rules that hold at a time that with the lowest idx does: rules are met in the order of their beginnings, and
    a heap has those that hold, lowest idx on top; one that has ended leaves it when it gets there. At
    most two spans a rule. A rule without a beginning, or that ends before it, never holds.
    """
    own = rules.where("valid_from is not null and (valid_to is null or valid_to > valid_from)")
    own = own.select(*keys, "valid_from", "valid_to", "idx", F.struct("idx", "texts", "offsets_ms").alias("rule"))
    schema = own.select(*keys).schema.add("start", "long").add("nth", "long").add("rule", own.schema["rule"].dataType)

    def swept(whole: pa.Table, nth: Iterator[int]) -> pa.Table:
        """The spans of whole base texts, in the order of their beginnings."""
        names = list(zip(*(whole.column(c).to_pylist() for c in keys), strict=True))
        begin, end, idx = (whole.column(c).to_pylist() for c in ("valid_from", "valid_to", "idx"))
        heap: list[tuple] = []
        of, start, rule = [], [], []

        def until(row: int, now: float) -> None:
            """The changes by rules that end up to a moment."""
            while heap and heap[0][1] <= now and heap[0][1] < inf:
                at = heap[0][1]
                while heap and heap[0][1] <= at:
                    heappop(heap)
                of.append(row)
                start.append(at)
                rule.append(heap[0][2] if heap else None)

        for k, name in enumerate(names):
            if k and name != names[k - 1]:
                until(k - 1, inf)
                heap.clear()
            until(k, begin[k])  # a rule that ends just now has ended
            if not heap or idx[k] < heap[0][0]:
                of.append(k)
                start.append(begin[k])
                rule.append(k)
            heappush(heap, (idx[k], end[k] if end[k] is not None else inf, k))
        until(len(names) - 1, inf)
        columns = [whole.column(c).take(pa.array(of, pa.int64())) for c in keys]
        return pa.table([*columns, pa.array(start, pa.int64()), pa.array([next(nth) for _ in of], pa.int64()), whole.column("rule").take(pa.array(rule, pa.int64()))], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, kept, last = count(), [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            i = len(names) - 1
            while i and names[i - 1] == names[-1]:
                i -= 1
            # kept has the rows of one text, the last one so far, which may go on.
            if kept and (i or names[-1] != last):
                yield from swept(pa.Table.from_batches([*kept, batch.slice(0, i)]), nth).to_batches()
                kept = []
            elif i:
                yield from swept(pa.Table.from_batches([batch.slice(0, i)]), nth).to_batches()
            kept.append(batch.slice(i))
            last = names[-1]
        if kept:
            yield from swept(pa.Table.from_batches(kept), nth).to_batches()

    arrow = to_arrow_schema(schema)
    order = own.repartition(*keys).sortWithinPartitions(*keys, "valid_from", "idx")
    return order.mapInArrow(run, schema)


def ruby_for(words: DataFrame, ruby: DataFrame, parts: int | None = None) -> DataFrame:
    """words with texts and offsets_ms of the first ruby rule (by idx) of their reading that is
    valid at t: valid_from <= t < valid_to, an open end being null.

    A sweep over the rules alone makes spans that don't overlap (``rule_spans``), and a word takes the last
    span that begins by its time: one union and one sort, whatever the number of rules. The words of a base text are dealt
    to ``parts`` tasks, each with its spans. Repeated words stay apart.
    """
    song = ["song_id"] if "song_id" in ruby.columns else []
    n = parts or (SONG_PARTS if song else ALL_PARTS)
    spans = rule_spans(ruby.withColumnRenamed("base", "reading"), [*song, "reading"])
    own = words.select(*[F.col(c).alias(f"{c}_word_") for c in words.columns])
    named = own.select(
        *[F.col(f"{c}_word_").alias(c) for c in (*song, "reading")],
        F.col("t_word_").cast("double").alias("at_"), F.pmod(F.xxhash64("t_word_", *([] if song else ["song_id_word_"] if "song_id" in words.columns else [])), F.lit(n)).alias("deal_"),
        F.lit((1 << 63) - 1).alias("order_"), F.struct(*own.columns).alias("own_"), F.lit(None).cast(StructType([StructField("rule", spans.schema["rule"].dataType)])).alias("span_"),
    )
    held = spans.select(
        *song, "reading", F.col("start").cast("double").alias("at_"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("deal_"),
        F.col("nth").alias("order_"), F.lit(None).cast(named.schema["own_"].dataType).alias("own_"), F.struct("rule").alias("span_"),
    )
    group = Window.partitionBy(*song, "reading", "deal_").orderBy("at_", "order_").rowsBetween(Window.unboundedPreceding, 0)
    out = named.unionByName(held).withColumn("span_", F.last("span_", ignorenulls=True).over(group)).where("own_ is not null")
    return out.select(*[F.col(f"own_.{c}_word_").alias(c) for c in words.columns], F.col("span_.rule.texts").alias("texts"), F.col("span_.rule.offsets_ms").alias("offsets_ms"))


def owner_of_chars(words: DataFrame, char_times: DataFrame) -> DataFrame:
    """song_id, word_idx, t: the time of the first timed character of each word's reading.

    Characters are numbered from 0 over the joined readings of a song. words has song_id,
    word_idx, reading; char_times has song_id, char_idx, t. One union and one sort by song, backwards: a word takes the
    last timed character passed, if it is one of its own. Characters without a time are no rows.
    """
    before = Window.partitionBy("song_id").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.length("reading")).over(before), F.lit(0)).cast("bigint")
    spans = words.select("song_id", "word_idx", F.length("reading").cast("bigint").alias("n_"), first.alias("at_")).where("n_ > 0")
    timed = char_times.where("char_idx is not null").select("song_id", F.col("char_idx").cast("bigint").alias("at_"), F.struct(F.col("char_idx").cast("bigint").alias("at"), "t").alias("c_"))
    both = spans.unionByName(timed, allowMissingColumns=True)
    passed = Window.partitionBy("song_id").orderBy(F.desc("at_"), F.col("c_").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("c_", F.last("c_", ignorenulls=True).over(passed)).where("n_ is not null and c_.at < at_ + n_")
    return found.select("song_id", "word_idx", F.col("c_.t").alias("t"))


def cached_stems(audio: DataFrame, cache: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """audio (stem, duration; as ``a``) with the cache rows (as ``c``) of the same stem and nearly the same duration.

    Durations lie in bands as wide as the tolerance, so that a row's matches are in its own band or in one of
    the two beside it: a join by stem and band, as large as the rows and what nearly matches.
    """
    band = F.floor(F.col("duration") / tolerance)
    own = audio.withColumn("band_", F.explode(F.array(band - 1, band, band + 1))).alias("a")
    both = own.join(cache.withColumn("band_", band).alias("c"), (F.col("a.stem") == F.col("c.stem")) & (F.col("a.band_") == F.col("c.band_")))
    return both.where(F.abs(F.col("a.duration") - F.col("c.duration")) < tolerance)


def first_beat(words: DataFrame, beats: DataFrame) -> DataFrame:
    """song_id, word_idx, beat_idx: the first beat at or after each word. A reverse running minimum."""
    own = beats.groupBy("song_id", "word_idx").agg(F.min("beat_idx").alias("b"))
    after = Window.partitionBy("song_id").orderBy("word_idx").rowsBetween(0, Window.unboundedFollowing)
    return words.select("song_id", "word_idx").join(own, ["song_id", "word_idx"], "left").select("song_id", "word_idx", F.min("b").over(after).alias("beat_idx"))
