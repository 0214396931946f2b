"""Operator 13, how filters interact: survivors of every subset of filters from one CUBE.

Documents are reduced to a row of failure flags, counted by flags and part (a bounded number of cells
for each part), and a CUBE over the flags and the part is taken of the cells. Its grouping-set rows in which
all selected flags are false are the survivors of that subset of filters. A step of an order of
filters leads from one subset to the next, so all that it removes, keeps and loses is told by pairs of
survivors; no order is played out on documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.llm.common import WORD, cut, prepare, small

#: The five filters of ``failures``, in the order of the bits of a subset.
FLAGS = ("A", "B", "C", "D", "E")
#: A text of fewer words fails A; B to D are shares and characters.
LEAST_WORDS = 200
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = r"[#$%&*|]"
#: Orders of more filters would be too many rows.
MOST_FLAGS = 7


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, A to E (booleans: the filter fails), good and toxic (0 or 1) of each row of docs.

    A null text is empty, a null source the part "". E: another row of docs with a smaller doc_id has
    the same text; a row without a doc_id neither fails it nor makes others fail. Labels that repeat a
    doc_id count if any of them says so; documents without one are neither good nor toxic. Empty tables
    give no rows; columns other than doc_id, text and source aren't used.
    """
    prepare(docs.sparkSession)
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n, chars = F.size("words"), F.length("text")
    told = own.select(
        "doc_id",
        "part",
        (n < LEAST_WORDS).alias("A"),
        (F.lit(100) * F.size(F.array_distinct("words")) < F.lit(50) * n).alias("B"),
        (F.lit(100) * (chars - F.length(F.translate("text", CAPITALS, ""))) > F.lit(2) * chars).alias("C"),
        F.col("text").rlike(SIGNS).alias("D"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    # One row for each doc_id: labels never multiply documents.
    says = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    rated = labels.where("doc_id is not null").groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    rows = cut(told.join(rated, "doc_id", "left").fillna(0, ["good", "toxic"]))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copied = small(cut(firsts.where("first < last").select("digest", "first")), 48)
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(copied, "digest", "left").select("doc_id", "part", "A", "B", "C", "D", later.alias("E"), "good", "toxic")


def survivors(flagged: DataFrame, flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """part, subset int, n, good, toxic long: the rows of each part that fail no filter of each subset
    (bit i: flags[i]), zeros included. flagged has part, the flags, good and toxic; a null flag is no
    failure."""
    cells = cut(
        flagged.select("part", *[F.coalesce(f, F.lit(False)).alias(f) for f in flags], "good", "toxic")
        .groupBy("part", *flags)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))
    )
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    subset = sum((F.when(F.grouping(f) == 0, 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0))
    cube = cells.cube("part", *flags).agg(*sums, F.grouping("part").alias("all_parts"), subset.alias("subset"))
    # The flags of a grouping set's row are null where they aren't selected.
    none = ~F.greatest(*[F.coalesce(f, F.lit(False)) for f in flags])
    found = cube.where(none & (F.col("all_parts") == 0)).select("part", "subset", "n", "good", "toxic")
    every = cells.select("part").distinct().withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit((1 << len(flags)) - 1))))
    return every.join(found, ["part", "subset"], "left").fillna(0, ["n", "good", "toxic"])


def interactions(flagged: DataFrame, flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """A row for each part, filter_order and step (from 1): how many rows the step keeps and removes,
    redundant (fail its filter, but were removed before), unique_fails (fail its filter only),
    good_lost, toxic_lost, and shapley: what its filter removes, summed over all orders.

    flagged as for ``survivors``, with at most seven one-letter flags. An empty table gives no rows.
    """
    if len(flags) > MOST_FLAGS:
        raise ValueError(f"more than {MOST_FLAGS} filters")
    spark, bit = flagged.sparkSession, {f: 1 << i for i, f in enumerate(flags)}
    every = (1 << len(flags)) - 1
    steps = []
    for order in permutations(flags):
        before = 0
        for k, f in enumerate(order, 1):
            steps.append(("".join(order), k, f, before, before | bit[f], bit[f], every ^ bit[f]))
            before |= bit[f]
    taken = spark.createDataFrame(steps, "filter_order string, step int, filter string, before int, after int, alone int, others int")
    alive = cut(survivors(flagged, flags))

    def of(subset: str | Column, name: str) -> DataFrame:
        return alive.select("part", F.col("subset").alias(subset), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "good", "toxic")])

    # The table of steps is the same whatever the input: 600 rows for five filters.
    rows = of("before", "b").join(F.broadcast(taken), "before").join(of("after", "a"), ["part", "after"])
    rows = rows.join(of("alone", "f"), ["part", "alone"]).join(of("others", "o"), ["part", "others"])
    ends = alive.groupBy("part").agg(F.sum(F.when(F.col("subset") == 0, F.col("n"))).alias("whole"), F.sum(F.when(F.col("subset") == every, F.col("n"))).alias("last"))
    removed = F.col("b_n") - F.col("a_n")
    return rows.join(ends, "part").select(
        "part",
        "filter_order",
        "step",
        F.col("a_n").alias("kept"),
        removed.alias("removed"),
        (F.col("whole") - F.col("f_n") - removed).alias("redundant"),
        (F.col("o_n") - F.col("last")).alias("unique_fails"),
        (F.col("b_good") - F.col("a_good")).alias("good_lost"),
        (F.col("b_toxic") - F.col("a_toxic")).alias("toxic_lost"),
        F.sum(removed).over(Window.partitionBy("part", "filter")).alias("shapley"),
    )
