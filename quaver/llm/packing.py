"""Operator 5, best-fit packing by patterns: non-negative least squares on the length histogram.

The histogram of piece lengths has at most ``size`` entries however many documents there are, so
the plan is made from it alone: patterns of two to four documents are enumerated over length
classes, their repeat counts fitted by non-negative least squares and rounded down, the last
document of each pattern chosen by best fit, and what is left over packed best-fit decreasing. The
plan is a short table of slots; pieces find theirs by their rank among pieces of equal length,
which is counted over salted parts so that no length gathers in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaver.llm.common import cut, light, prepare, small
from quaver.llm.wordbpe import encoder

SEQUENCE = 4096
END = 1
CLASSES = 64
#: Pieces of one length that are ranked together; a length of more is dealt out.
RANKED = 100_000


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece int, start long, length long, ids_crc32 long (and ids) of each piece of a text.

    A text's ids, then the end id; only longer ones are cut, into pieces of ``size``. A null or
    empty text is the end id alone. Rows that repeat a doc_id are packed each by itself.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    schema = docs.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    schema = schema.add("ids", "binary") if with_ids else schema
    end = np.array([END], "<u4").tobytes()

    @light
    def run(batches):
        for batch in batches:
            row, piece, length, crc, kept = [], [], [], [], []
            for first, found, bounds in encoder(tokenizer).encode(batch.column(1)):
                whole = found.astype("<u4").tobytes()
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), first):
                    own = whole[4 * a : 4 * b] + end
                    for p, at in enumerate(range(0, len(own), 4 * size)):
                        part = own[at : at + 4 * size]
                        row.append(k)
                        piece.append(p)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            kept.append(part)
            pieces = pa.array(piece, pa.int32())
            start = pa.array(np.array(piece, np.int64) * size)
            out = [batch.column(0).take(pa.array(row, pa.int64())), pieces, start, pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(kept, pa.binary())] if with_ids else []), schema.names)

    return docs.mapInArrow(run, schema)


def partitions_of(total: int, parts: int, largest: int | None = None):
    """Non-increasing tuples of ``parts`` positive numbers with a sum of ``total``."""
    largest = total if largest is None else largest
    if parts == 1:
        if 0 < total <= largest:
            yield (total,)
        return
    for x in range(min(largest, total - parts + 1), 0, -1):
        if x * parts < total:
            return
        for rest in partitions_of(total - x, parts - 1, x):
            yield (x, *rest)


def nnls(a: np.ndarray, h: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - h|, by an active set of columns with a sparse result."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (h - a @ x)
        gain[free] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-7 * max(1.0, float(np.abs(h).max())):
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            solved = np.linalg.lstsq(a[:, at], h, rcond=None)[0]
            if len(at) == 0 or solved.min() > 0:
                x[:] = 0
                x[at] = solved
                break
            low = solved <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - solved[low], 1e-300))
            x[at] += step * (solved - x[at])
            free[at[(x[at] <= 1e-12) & low]] = False
            x[~free] = 0
    return x


def plan(histogram: dict[int, int], size: int = SEQUENCE, classes: int = CLASSES) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Templates ((length, copies), ...) and how many sequences follow each.

    Every length of the histogram is used exactly as often as it occurs, and no template exceeds
    ``size``.
    """
    have = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        have[length] += n
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []
    if have[size]:
        done.append((((size, 1),), int(have[size])))
        have[size] = 0
    open_: dict[int, list] = defaultdict(list)  # slack -> templates with it
    width = max(1, size // classes)
    top = size // width
    kind = np.minimum((np.arange(size + 1) + width - 1) // width, top)
    groups = np.bincount(kind, weights=have, minlength=top + 1)[1:]
    if have.sum():
        patterns = [p for k in (2, 3, 4) for p in partitions_of(top, k) if all(groups[c - 1] for c in p)]
        if patterns:
            a = np.zeros((top, len(patterns)))
            for j, p in enumerate(patterns):
                for c in p:
                    a[c - 1, j] += 1
            x = np.floor(nnls(a, groups) + 1e-9).astype(np.int64)
            for j in sorted(np.flatnonzero(x > 0).tolist(), key=lambda j: (patterns[j][0], x[j]), reverse=True):
                _follow(patterns[j], int(x[j]), have, kind, size, open_)
    _best_fit(have, size, open_)
    for found in open_.values():
        done.extend((tuple(t), n) for t, n in found)
    return done


def _follow(pattern: tuple[int, ...], repeats: int, have: np.ndarray, kind: np.ndarray, size: int, open_: dict) -> None:
    """Takes documents for one pattern: all but the last from its classes, the last by best fit."""
    runs: list[tuple[tuple[int, ...], int]] = [((), repeats)]
    for c in pattern[:-1]:
        lengths = [int(v) for v in np.flatnonzero((kind == c) & (have > 0))[::-1]]
        grown = []
        for chosen, n in runs:
            while n and lengths:
                v = lengths[0]
                k = min(n, int(have[v]))
                if k:
                    grown.append(((*chosen, v), k))
                    have[v] -= k
                    n -= k
                if not have[v]:
                    lengths.pop(0)
            for v in chosen if n else ():  # no document left for this slot: back to the rest
                have[v] += n
        runs = grown
    for chosen, n in runs:
        room = size - sum(chosen)
        while n:
            fits = np.flatnonzero(have[1 : room + 1]) + 1
            if not len(fits):
                break
            v = int(fits[-1])
            k = min(n, int(have[v]))
            have[v] -= k
            n -= k
            open_[room - v].append((_packed((*chosen, v)), k))
        if n:
            open_[room].append((_packed(chosen), n))


def _packed(lengths: tuple[int, ...]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for v in lengths:
        if out and out[-1][0] == v:
            out[-1] = (v, out[-1][1] + 1)
        else:
            out.append((v, 1))
    return out


def _best_fit(have: np.ndarray, size: int, open_: dict) -> None:
    """Packs what is left, longest first, each into the open sequence with the least room for it."""
    slacks = sorted(s for s, found in open_.items() if found)
    for v in range(size, 0, -1):
        n = int(have[v])
        have[v] = 0
        while n:
            at = bisect_left(slacks, v)
            if at == len(slacks):
                each = size // v
                for k, count in ((each, n // each), (n % each, 1)):
                    if k and count:
                        _put(open_, slacks, size - k * v, ([(v, k)], count))
                break
            slack = slacks[at]
            template, count = open_[slack].pop()
            each = min(slack // v, -(-n // count))  # as many copies in each as fit and are needed
            if each * count > n:
                each = max(1, n // count)
            used = min(count, n // each)
            if used < count:
                open_[slack].append((template, count - used))
            if not open_[slack]:
                slacks.pop(at)
            _put(open_, slacks, slack - each * v, ([*template, (v, each)], used))
            n -= used * each


def _put(open_: dict, slacks: list[int], slack: int, entry: tuple) -> None:
    if not open_[slack]:
        insort(slacks, slack)
    open_[slack].append(entry)


def slots(templates, spark) -> DataFrame:
    """length, low, high (ranks), copies, first (sequence), base (offset): one row for each template slot."""
    import pandas as pd

    rows, used, sequence = [], defaultdict(int), 0
    for template, n in templates:
        base = 0
        for v, k in template:
            low = used[v]
            used[v] += n * k
            rows.append((v, low, used[v], k, sequence, base))
            base += v * k
        sequence += n
    names = ["length", "low", "high", "copies", "first", "base"]
    return spark.createDataFrame(pd.DataFrame(rows, columns=names, dtype="int64"), ", ".join(f"{c} long" for c in names))


def assign(pieces: DataFrame, size: int = SEQUENCE, ranked: int = RANKED) -> DataFrame:
    """pieces with sequence_id and offset long: no sequence over ``size``, gapless from 0.

    pieces has doc_id, piece, length (1 .. size) and may have more columns. Repeated rows are
    separate pieces; an empty table gives no rows.
    """
    pieces = cut(pieces)
    lengths = cut(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n_")))  # at most ``size`` rows
    histogram = {r.length: r.n_ for r in lengths.collect()}
    parts = lengths.select("length", F.ceil(F.col("n_") / ranked).alias("parts_"))
    salt = F.pmod(F.xxhash64("doc_id", "piece", *[c for c in ("ids_crc32",) if c in pieces.columns]), F.col("parts_")).cast("int")
    pieces = pieces.join(F.broadcast(parts), "length").withColumn("salt_", salt).drop("parts_")
    counts = cut(pieces.groupBy("length", "salt_").agg(F.count(F.lit(1)).alias("n_")))
    before = Window.partitionBy("length").orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("from_"))
    order = Window.partitionBy("length", "salt_").orderBy("doc_id", "piece", *[c for c in ("ids_crc32",) if c in pieces.columns])
    ranked = (
        pieces.withColumn("rank_", F.row_number().over(order) - 1)
        .join(small(starts), ["length", "salt_"])
        .withColumn("rank_", F.col("rank_") + F.col("from_"))
        .drop("from_", "salt_")
    )
    places = slots(plan(histogram, size), pieces.sparkSession)
    here = F.col("rank_") - F.col("low")
    return (
        ranked.join(small(places, 64), "length")
        .where((F.col("rank_") >= F.col("low")) & (F.col("rank_") < F.col("high")))
        .withColumn("sequence_id", F.col("first") + F.floor(here / F.col("copies")))
        .withColumn("offset", F.col("base") + F.pmod(here, F.col("copies")) * F.col("length"))
        .drop("rank_", "low", "high", "copies", "first", "base")
    )


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents with their sequences; see ``token_pieces`` and ``assign``."""
    out = assign(token_pieces(docs, tokenizer, size), size)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """sequence_id, ids: the packed ids themselves, at most ``size`` of them a row."""
    placed = assign(token_pieces(docs, tokenizer, size, with_ids=True), size)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), "").alias("h")).select("sequence_id", F.unhex("h").alias("ids"))
