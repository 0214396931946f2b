"""Operator 2, line dedup by pairwise alignment: shared lines find overlapping documents.

A line, or two that follow each other, pair each holder with the first one and with the one before,
in however many documents they are, so pairs grow with the lines and never with the square of a
group. Each pair is aligned by patience diff over line
hashes, and the common blocks are deleted from the document with the greater doc_id.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaver.llm.common import beside, cut, fresh, light, prepare, small

#: What a line is for this operator: one of fewer characters is no evidence that texts overlap, and goes
#: only within a block that has a longer one. The same at every size of the table.
SOLID = 20
#: The holders of a line in more documents are put in order by ranges; the pairs are the same.
HOT = 2048


def rising(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        tails[k : k + 1] = [v]
        at[k : k + 1] = [i]
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def anchors(a: list[int], b: list[int], low: tuple[int, int], high: tuple[int, int]) -> list[tuple[int, int]]:
    """Solid lines that occur once on both sides, in a longest common order; if there are none,
    the first with the first, second with second occurrence and so on."""
    own, other = (Counter(x[i:j]) for x, i, j in ((a, low[0], high[0]), (b, low[1], high[1])))
    once = {h for h, n in own.items() if n == 1 and h & 1 and other.get(h) == 1}
    if once:
        place = {h: j for j, h in enumerate(b[low[1] : high[1]], low[1]) if h in once}
        found = [(i, place[h]) for i, h in enumerate(a[low[0] : high[0]], low[0]) if h in once]
    else:
        seen: Counter = Counter()
        place = {}
        for j in range(low[1], high[1]):
            if b[j] & 1 and b[j] in own:
                place[b[j], seen[b[j]]] = j
                seen[b[j]] += 1
        seen.clear()
        found = []
        for i in range(low[0], high[0]):
            if a[i] & 1 and (a[i], seen[a[i]]) in place:
                found.append((i, place[a[i], seen[a[i]]]))
                seen[a[i]] += 1
    return [found[k] for k in rising([j for _, j in found])]


def common_blocks(a: list[int], b: list[int]) -> list[int]:
    """Lines of a in the blocks that patience diff aligns with b; a block has a solid line, whose
    hash is odd."""
    pairs: list[tuple[int, int]] = []
    todo = [((0, 0), (len(a), len(b)))]
    while todo:
        (i, j), (m, n) = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            pairs.append((m, n))
        if i < m and j < n and (found := anchors(a, b, (i, j), (m, n))):
            pairs.extend(found)
            bounds = [(i - 1, j - 1), *found, (m, n)]
            todo.extend(((p + 1, q + 1), (r, s)) for (p, q), (r, s) in zip(bounds, bounds[1:], strict=False) if p + 1 < r and q + 1 < s)
    pairs.sort()
    out: list[int] = []
    block: list[int] = []
    last = None
    for i, j in [*pairs, (-9, -9)]:
        if last is not None and (i, j) != (last[0] + 1, last[1] + 1):
            if any(a[k] & 1 for k in block):
                out.extend(block)
            block = []
        block.append(i)
        last = (i, j)
    return out


def hashed_lines(docs: DataFrame, solid: int = SOLID) -> DataFrame:
    """doc_id, th (of the text), lines: a hash of each trimmed line, odd if it has ``solid``
    characters, 0 if it is blank."""
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    odd = lambda x: F.shiftleft(F.shiftright(F.xxhash64(x), 1), 1) + F.when(F.length(x) >= solid, 1).otherwise(0)
    own = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return own.select("doc_id", F.xxhash64("text").alias("th"), F.transform(trimmed, lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(odd(x))).alias("lines"))


def overlapping(lines: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs (doc_id, other) of documents that share a solid line, or two lines, one of them solid,
    that follow each other at once or after blank ones; other is the smaller: each holder with the
    first one and with the one before."""
    two = lambda c: F.filter(F.zip_with(c, F.slice(c, F.lit(2), F.greatest(F.size(c), F.lit(1))), lambda x, y: F.when(x.bitwiseOR(y).bitwiseAND(F.lit(1)) == 1, F.xxhash64(x, y))), lambda x: x.isNotNull())
    evidence = F.concat(F.filter("lines", lambda x: x.bitwiseAND(F.lit(1)) == 1), two(F.col("lines")), two(F.filter("lines", lambda x: x != 0)))
    held = lines.select("doc_id", F.explode(F.array_distinct(evidence)).alias("line")).distinct()
    found = held.groupBy("line").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = cut(found.where("first < last"))
    # Ranges of doc_id of a line that more than ``hot`` documents hold; 0 for others.
    wide = lambda c: F.col(c).cast("double")
    part = F.floor((wide("doc_id") - wide("first")) / (wide("last") - wide("first") + 1) * F.ceil(F.col("n") / hot)).cast("int")
    holders = cut(held.join(small(shared, 56), "line").select("line", "doc_id", "first", "n", F.when(F.col("n") > hot, F.greatest(part, F.lit(0))).otherwise(0).alias("part"), (F.col("n") > hot).alias("hot")))
    star = holders.where("doc_id > first").select("doc_id", F.col("first").alias("other"))
    chain = holders.select("doc_id", F.lag("doc_id").over(Window.partitionBy("line", "part").orderBy("doc_id")).alias("other"))
    ends = holders.where("hot").groupBy("line", "part").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("end"))
    across = ends.select("doc_id", F.lag("end").over(Window.partitionBy("line").orderBy("part")).alias("other"))
    return star.union(chain.union(across).where("other is not null")).distinct()


def dedup_lines(docs: DataFrame, solid: int = SOLID, hot: int = HOT) -> DataFrame:
    """docs with the text less its deleted lines, and n_lines, n_removed long.

    Lines end at a line feed. Blocks are judged on the texts as they came. A null text stays null
    with no lines, a row without a doc_id stays as it is; of rows with the same doc_id none is
    later than another. A text whose lines all go becomes empty. Other columns stay; columns
    n_lines and n_removed are replaced. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed")
    lines = cut(hashed_lines(docs, solid))
    pairs = cut(overlapping(lines, hot).select(F.col("doc_id").alias("a"), F.col("other").alias("b")))
    both = beside(pairs, lines, "doc_id").select("left.doc_id", "left.th", "left.lines", F.col("right.lines").alias("old"))

    @light
    def run(batches):
        for batch in batches:
            out = [common_blocks(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "th", "gone"])

    aligned = both.mapInArrow(run, "doc_id long, th long, gone array<int>")
    spots = aligned.select("doc_id", "th", F.explode("gone").alias("at")).distinct()
    gone = cut(spots.groupBy("doc_id", "th").agg(F.collect_list("at").alias("gone")))

    th, spot = fresh(docs, "th_"), fresh(docs, "gone_")
    total = gone.agg(F.sum(F.size("gone")).alias("n")).first().n or 0
    side = gone.select(F.col("doc_id").alias(f"{th}id"), F.col("th").alias(th), F.col("gone").alias(spot))
    side = small(side, 48) if total < 4_000_000 else side
    joined = docs.join(side, (F.col("doc_id") == F.col(f"{th}id")) & (F.xxhash64("text") == F.col(th)), "left").drop(th, f"{th}id")
    at, spot_at = joined.columns.index("text"), joined.columns.index(spot)
    names = docs.columns
    schema = docs.select("*").schema.add("n_lines", "long").add("n_removed", "long")

    @light
    def cut_out(batches):
        for batch in batches:
            texts, spots_ = batch.column(at), batch.column(spot_at)
            n, removed, kept = [], [], []
            for text, own in zip(texts.to_pylist(), spots_.to_pylist(), strict=True):
                parts = text.split("\n") if text is not None else []
                n.append(len(parts))
                removed.append(len(own or ()))
                if own:
                    mask = np.zeros(len(parts), bool)
                    mask[own] = True
                    text = "\n".join(p for p, x in zip(parts, mask.tolist(), strict=True) if not x)
                kept.append(text)
            by = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"text": pa.array(kept, pa.string())}
            yield pa.RecordBatch.from_arrays([by[c] for c in names] + [pa.array(n, pa.int64()), pa.array(removed, pa.int64())], schema.names)

    return joined.mapInArrow(cut_out, schema)
