"""Operator 4, substring dedup: a count-min sketch picks the windows that are then grouped exactly.

A window is ``span`` consecutive words. Every window is represented in the sketch by the smallest
hash among its runs of eight words (its minimiser), which equal windows share; consecutive windows
mostly share it too, so the sketch needs some twenty times fewer counters than windows. The
sketch counts documents for each minimiser; each partition makes its own, and sums of those
overestimate how many documents any window is in: no repeated window is lost. Its counters grow
with the text and are merged by shards of two million, whose tasks hold no more. Windows estimated
repeated go to an exact pass by 128-bit hashes. There each task first settles the windows that
repeat within it, so that at most one row per task is shuffled for any window however common.
Exact copies of a text are settled by the text's digest and take no part in either pass.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaver.llm.common import cut, fresh, light, prepare, small
from quaver.llm.textbuf import buffers, grams, mix, slices, sliding_min
from quaver.llm.wordbpe import ragged

SPAN, CORE = 50, 8
#: Counters of a minimiser, all of them in one block of the sketch; bits that number a block's
#: counters; blocks of a shard, which are merged together.
DEPTH, BLOCK_BITS, SHARD = 4, 15, 64
#: Bytes of text for each counter; some 140 bytes of prose have a new minimiser, so a third is taken.
ROOM = 16
#: Blocks that may be broadcast (a bit for a counter: 32 MB); a larger sketch is joined to the minimisers.
BROADCAST_BLOCKS = 1 << 13
#: Minimisers that a task holds before it counts and sends them.
HELD_KEYS = 200_000
#: Runs of removed windows that may be broadcast in all, of 8 bytes each; more are shuffled.
BROADCAST_RUNS = 2_000_000
#: Windows that a task holds before it settles and sends them: always as many, so that what is
#: settled early doesn't depend on the number of tasks.
HELD = 100_000


def places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each key and DEPTH x len(keys) counters of it."""
    wide = BLOCK_BITS - DEPTH.bit_length() + 1
    own = packed_places(keys)
    rows = [(own >> d * wide & (1 << wide) - 1) + (d << wide) for d in range(DEPTH)]
    return (mix(keys, 20) % np.uint64(blocks)).astype(np.int64), np.stack(rows)


def packed_places(keys: np.ndarray) -> np.ndarray:
    """The counters of each key within their rows, all in one number."""
    return (mix(keys, 21) >> np.uint64(64 - DEPTH * (BLOCK_BITS - DEPTH.bit_length() + 1))).astype(np.int64)


def windows(words, span: int, core: int = CORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the whole windows, their documents, and the minimiser of each."""
    none = np.zeros(0, np.int64)
    if len(words.hash) < span:
        return none, none, np.zeros(0, np.uint64)
    doc = words.doc()
    at = np.flatnonzero(doc[: len(doc) - span + 1] == doc[span - 1 :])
    core = min(core, span)
    least = sliding_min(grams(words.hash, core), span - core + 1)
    return at, doc[at], least[at]


def minimisers(words, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and the minimisers of their windows, each once for a document."""
    _, doc, least = windows(words, span)
    if not len(doc):
        return doc, least
    changes = lambda: np.append(True, (doc[1:] != doc[:-1]) | (least[1:] != least[:-1]))
    new = changes()
    doc, least = doc[new], least[new]
    by = np.lexsort((least, doc))
    doc, least = doc[by], least[by]
    new = changes()
    return doc[new], least[new]


def sketch(docs: DataFrame, span: int, blocks: int) -> DataFrame:
    """block int, bits binary: a bit for each counter that reaches two in the sum of all partitions'
    sketches. Blocks without one are left out."""

    @light
    def own(batches):
        held, n = [], 0
        for batch in batches:
            for words in slices(batch.column(0)):
                _, keys = minimisers(words, span)
                held.append(keys)
                n += len(keys)
                if n > HELD_KEYS:
                    yield counted(held, blocks)
                    held, n = [], 0
        if n:
            yield counted(held, blocks)

    @light
    def merged(batches):
        counts, now = np.zeros(SHARD << BLOCK_BITS, np.uint8), None
        for batch in batches:
            for shard, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != now and now is not None:
                    yield full(now, counts)
                    counts[:] = 0
                now = shard
                cells = np.frombuffer(own.as_buffer(), np.uint32)
                counts[cells >> 1] = np.minimum(counts[cells >> 1] + 1 + (cells & 1), 2)
        if now is not None:
            yield full(now, counts)

    parts = docs.select("text").mapInArrow(own, "shard int, cells binary")
    return parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(merged, "block int, bits binary")


def counted(held: list[np.ndarray], blocks: int):
    """Rows (shard, cells) of a task's minimisers: counters, twice their number, or that and one if
    they reach two."""
    block, rows = places(np.concatenate(held), blocks)
    code, n = np.unique(((block << BLOCK_BITS) + rows).ravel(), return_counts=True)
    shard = code // (SHARD << BLOCK_BITS)
    cells = ((code % (SHARD << BLOCK_BITS)) << 1 | (n > 1)).astype(np.uint32)
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    ends = pa.py_buffer(np.append(first, len(code)).astype(np.int32) * 4)
    own = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(cells)])
    return pa.RecordBatch.from_arrays([pa.array(shard[first], pa.int32()), own], ["shard", "cells"])


def full(shard: int, counts: np.ndarray):
    reached = np.packbits((counts > 1).reshape(SHARD, -1), axis=1)
    some = np.flatnonzero(reached.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(shard * SHARD + some, pa.int32()), pa.array([reached[k].tobytes() for k in some], pa.binary())], ["block", "bits"])


def sparse_runs(docs: DataFrame, span: int, blocks: int, reached: DataFrame) -> DataFrame:
    """doc_id, th, keys: the minimisers of each text all of whose counters reach two, found by a join
    with the sketch."""

    @light
    def run(batches):
        for batch in batches:
            for words in slices(batch.column(2)):
                doc, keys = minimisers(words, span)
                at = pa.array(words.first + doc)
                block, _ = places(keys, blocks)
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(keys.view(np.int64)), pa.array(block, pa.int32()), pa.array(packed_places(keys))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "key", "block", "places"])

    rows = docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, key long, block int, places long")
    wide = BLOCK_BITS - DEPTH.bit_length() + 1
    hit = F.lit(True)
    for d in range(DEPTH):
        cell = F.shiftright("places", d * wide).bitwiseAND(F.lit((1 << wide) - 1)) + F.lit(d << wide)
        byte = F.conv(F.hex(F.substring("bits", (F.shiftright(cell, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit = hit & (F.pmod(byte / F.pow(F.lit(2), F.lit(7) - cell.bitwiseAND(F.lit(7))), F.lit(2)) >= 1)
    return rows.join(reached, "block").where(hit).groupBy("doc_id", "th").agg(F.collect_set("key").alias("keys"))


def repeated_spans(docs: DataFrame, span: int = SPAN, room: int = ROOM, most: int = BROADCAST_BLOCKS) -> DataFrame:
    """doc_id, th, starts, sizes array<int>: runs of first words of the windows to be removed; a
    start of -1 is a whole text.

    docs has doc_id and text. th is xxhash64 of the text, which tells rows with the same doc_id
    apart. Rows without a doc_id have no order and neither lose windows nor make others lose them;
    nor do null texts. The sketch has a counter for each ``room`` bytes of text; one of more than
    ``most`` blocks isn't broadcast but joined.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    digest = F.sha2("text", 256).alias("digest")
    firsts = docs.groupBy(digest).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last_"))
    copied = cut(firsts.where("first < last_").select("digest", "first"))
    later = cut(
        docs.select("doc_id", "th", digest)
        .join(small(copied, 96), "digest")
        .where(F.col("doc_id") > F.col("first"))
        .select("doc_id", "th")
        .distinct()
    )
    single = docs.join(small(later), ["doc_id", "th"], "left_anti")

    size = single.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-size // (room << BLOCK_BITS)))
    reached = cut(sketch(single, span, blocks))
    seen, own = None, single.select("doc_id", "th", "text")
    if blocks <= most:
        bitmap = np.zeros((blocks, 1 << BLOCK_BITS - 3), np.uint8)
        for r in reached.toLocalIterator():
            bitmap[r.block] = np.frombuffer(r.bits, np.uint8)
        seen = spark.sparkContext.broadcast(bitmap.tobytes())  # at most ``most`` blocks of 4 KB
        del bitmap
    else:
        own = own.join(sparse_runs(single, span, blocks, reached), ["doc_id", "th"]).select("doc_id", "th", "text", "keys")

    def passed(words, doc, least, batch):
        """Whether each window's minimiser is estimated repeated."""
        new = np.append(True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]))
        if seen is not None:
            bits = np.frombuffer(seen.value, np.uint8)
            block, rows = places(least[new], blocks)
            cells = (block << BLOCK_BITS) + rows
            few = (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).all(axis=0)
        else:
            few, own = np.zeros(int(new.sum()), bool), doc[new]
            for d in np.unique(own).tolist():
                keys = np.asarray(batch.column(3)[words.first + d].values).view(np.uint64)
                few[own == d] = np.isin(least[new][own == d], keys)
        return few[np.cumsum(new) - 1]

    @light
    def repeated(batches):
        held: list[tuple] = []
        n = 0
        for batch in batches:
            doc_ids = np.asarray(batch.column(0))
            ths = np.asarray(batch.column(1))
            for words in slices(batch.column(2)):
                at, doc, least = windows(words, span)
                if not len(at):
                    continue
                keep = passed(words, doc, least, batch)
                if keep.any():
                    at, doc = at[keep], doc[keep]
                    low, high = grams(words.hash, span, 32)[at], grams(words.other, span, 33)[at]
                    held.append((low, high, doc_ids[words.first + doc], ths[words.first + doc], at - words.at[doc]))
                    n += len(at)
                if n >= HELD:
                    yield from settle(held)
                    held, n = [], 0
        if held:
            yield from settle(held)

    # A window, however common, has a row for each HELD windows of a task at most. Rows that are done
    # pass by in a group of their own.
    rows = own.mapInArrow(repeated, "low long, high long, doc_id long, th long, done boolean, starts array<int>")
    everywhere = Window.partitionBy("low", "high")
    spread = rows.withColumn("least", F.min("doc_id").over(everywhere)).where("done or doc_id > least").select("doc_id", "th", "starts")
    found = spread.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    runs = found.mapInArrow(as_runs, "doc_id long, th long, starts array<int>, sizes array<int>")
    return runs.union(later.select("doc_id", "th", F.array(F.lit(-1)), F.array(F.lit(1))))


@light
def as_runs(batches):
    """Places of each document, in any order, as runs of neighbours."""
    for batch in batches:
        starts, sizes = [], []
        for k in range(batch.num_rows):
            at = np.unique(np.asarray(batch.column(2)[k].values))
            first = np.flatnonzero(np.append(True, np.diff(at) > 1))
            starts.append(at[first])
            sizes.append(np.diff(first, append=len(at)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, pa.list_(pa.int32())) for x in (starts, sizes))], ["doc_id", "th", "starts", "sizes"])


def settle(held: list[tuple]):
    """Rows of a task's windows: for each hash the windows of its smallest document here, which
    wait for the rest of the table, and for each document the windows that others repeat here,
    which are done and get the document's own hash."""
    low, high, doc, th, at = (np.concatenate(x) for x in zip(*held, strict=True))
    by = np.lexsort((at, th, doc, high, low))
    low, high, doc, th, at = (x[by] for x in (low, high, doc, th, at))
    same = np.zeros(len(low), bool)
    same[1:] = (low[1:] == low[:-1]) & (high[1:] == high[:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(low))))
    done = doc > doc[head]
    differ = lambda *cols: np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))
    for kind in (False, True):
        pick = np.flatnonzero(done == kind)
        if not len(pick):
            continue
        if kind:
            pick = pick[np.lexsort((at[pick], th[pick], doc[pick]))]
            first = np.flatnonzero(differ(doc[pick], th[pick]))
        else:
            first = np.flatnonzero(differ(low[pick], high[pick], doc[pick], th[pick]))
        size = np.diff(first, append=len(pick))
        order = np.arange(len(first)) if kind else np.lexsort((at[pick][first], doc[pick][first]))  # by document: the columns that repeat compress
        first, size = first[order], size[order]
        starts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(at[pick][ragged(first, size)], pa.int32()))
        own = [x[pick][first] for x in (low, high, doc, th)]
        if kind:
            own[0], own[1] = mix(own[2].astype(np.uint64), 60), mix(own[2].astype(np.uint64), 61)
        columns = [pa.array(x.view(np.int64), pa.int64()) for x in own]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(first), kind)), starts], ["low", "high", "doc_id", "th", "done", "starts"])


def dedup_substrings(docs: DataFrame, span: int = SPAN, digests: bool = False, room: int = ROOM, most: int = BROADCAST_BLOCKS) -> DataFrame:
    """docs with n_words, n_removed long and, as text, the kept words joined by one blank.

    A word goes if a window of ``span`` words over it also starts in a document with a smaller
    doc_id, by the texts as they came. A null or empty text has no words and becomes empty. Other
    columns stay; columns n_words and n_removed are replaced. With ``digests`` the text is replaced
    by kept_sha256, so that no text leaves the task that cuts it.
    """
    docs = docs.drop("n_words", "n_removed", *(["kept_sha256"] if digests else []))
    th, starts = fresh(docs, "th_"), fresh(docs, "starts_")
    runs = F.arrays_zip("starts", "sizes").alias(starts)
    cuts = cut(repeated_spans(docs, span, room, most)).select(F.col("doc_id").alias(f"{th}id"), F.col("th").alias(th), runs)
    total = cuts.agg(F.sum(F.size(starts)).alias("n")).first().n or 0
    side = small(cuts, 48) if total <= BROADCAST_RUNS else cuts
    joined = docs.join(side, (F.col("doc_id") == F.col(f"{th}id")) & (F.xxhash64("text") == F.col(th)), "left").drop(th, f"{th}id")
    at, cut_at = joined.columns.index("text"), joined.columns.index(starts)
    names = [c for c in joined.columns if c != starts]
    last = "kept_sha256" if digests else "text"
    kept_names = [c for c in names if c != "text"] if digests else names
    schema = docs.select(*kept_names).schema.add("n_words", "long").add("n_removed", "long")
    schema = schema.add(last, "string") if digests else schema

    @light
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            whole, listed = data.tobytes(), batch.column(cut_at)
            n, gone, texts = [], [], []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                words = whole[a:b].split()
                found = listed[k].values
                n.append(len(words))
                if found is not None and len(words) >= span:
                    begin, size = (np.asarray(found.field(c)) for c in (0, 1))
                    if begin[0] < 0:
                        words = []
                    else:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, begin, 1)
                        np.add.at(edge, begin + size - 1 + span, -1)
                        words = [w for w, c in zip(words, np.cumsum(edge).tolist(), strict=False) if not c]
                gone.append(n[-1] - len(words))
                kept = b" ".join(words)
                texts.append(hashlib.sha256(kept).hexdigest() if digests else kept.decode())
            by = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"text": pa.array(texts, pa.string())}
            out = [by[c] for c in kept_names] + [pa.array(n, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(out + ([by["text"]] if digests else []), schema.names)

    return joined.mapInArrow(run, schema)
