"""Exact order statistics of groups of any size, none of which is gathered or sorted whole.

Groups of up to ``FEW`` values are numbered by a window. Of each larger one, the range that holds a wanted
rank is narrowed in rounds: its values are counted by ``BINS`` equal parts of the range (a partial
aggregation, however hot the group), and the part with the rank becomes the next range, from the
least to the greatest value in it, until few values are left or all are equal.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.operators.lineage import cut

FEW, BINS = 100_000, 4096
#: Ranges of large groups are broadcast only up to so many rows (of some 60 bytes); else the join shuffles.
BROADCAST_RANGES = 500_000


def nth(rows: DataFrame, by: list[str], value: str, ranks: Callable[[Column], list[Column]], few: int = FEW, bins: int = BINS) -> DataFrame:
    """by, rank long, value: the values at some ranks (from 0) of each group's sorted values.

    ``ranks`` gives the wanted ranks of a group of n values (a Column); those outside it are left out, equal
    ones are given once. Values that are null or not a number don't count; a group without others has no
    row. A null key is a group like others.
    """
    kind = rows.schema[value].dataType
    own = rows.select(*by, F.col(value).alias("v_")).where("v_ is not null")
    if kind.typeName() in ("double", "float"):
        own = own.where(~F.isnan("v_"))
    sizes = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n_"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_"))
    large = cut(sizes.where(F.col("n_") > few))
    n_large = large.count()
    wanted = lambda n: F.array_distinct(F.transform(F.array(*ranks(n)), lambda x: x.cast("long")))
    asked = Window.partitionBy(*by)
    small = own if not n_large else _with(own, large.select(*by), by, n_large, "left_anti")
    numbered = small.withColumn("rank", (F.row_number().over(asked.orderBy("v_")) - 1).cast("long")).withColumn("n_", F.count(F.lit(1)).over(asked))
    out = numbered.where(F.array_contains(wanted(F.col("n_")), F.col("rank"))).select(*by, "rank", F.col("v_").alias(value))
    if not n_large:
        return out
    spans = large.withColumn("rank", F.explode(wanted(F.col("n_")))).where("rank >= 0 and rank < n_").withColumn("left_", F.col("rank"))
    settled = []
    while True:
        spans = cut(spans)
        settled.append(spans.where(F.col("lo_") == F.col("hi_")).select(*by, "rank", F.col("lo_").alias(value)))
        ready = spans.where((F.col("lo_") < F.col("hi_")) & (F.col("n_") <= few))
        settled.append(_last(own, ready, by, value))
        spans = spans.where((F.col("lo_") < F.col("hi_")) & (F.col("n_") > few))
        left = spans.count()
        if not left:
            return reduce(DataFrame.unionByName, settled, out)
        inside = _with(own, spans.select(*by, "rank", "left_", "lo_", "hi_"), by, left, "inner").where("v_ between lo_ and hi_")
        part = F.least(F.floor((F.col("v_") - F.col("lo_")) / (F.col("hi_") - F.col("lo_")).cast("double") * bins).cast("int"), F.lit(bins - 1))
        counted = inside.groupBy(*by, "rank", "left_", part.alias("part_")).agg(F.count(F.lit(1)).alias("n_"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_"))
        through = counted.withColumn("to_", F.sum("n_").over(Window.partitionBy(*by, "rank").orderBy("part_")))
        held = through.where((F.col("left_") < F.col("to_")) & (F.col("left_") >= F.col("to_") - F.col("n_")))
        spans = held.withColumn("left_", F.col("left_") - F.col("to_") + F.col("n_")).select(*by, "n_", "lo_", "hi_", "rank", "left_")


def _last(own: DataFrame, spans: DataFrame, by: list[str], value: str) -> DataFrame:
    """The values at rank left_ of ranges that hold few values."""
    inside = _with(own, spans.select(*by, "rank", "left_", "lo_", "hi_"), by, 0, "inner").where("v_ between lo_ and hi_")
    order = Window.partitionBy(*by, "rank").orderBy("v_")
    return inside.withColumn("at_", F.row_number().over(order) - 1).where("at_ = left_").select(*by, "rank", F.col("v_").alias(value))


def _with(own: DataFrame, side: DataFrame, by: list[str], n: int, how: str) -> DataFrame:
    """own joined with a side of n counted rows; null keys meet."""
    renamed = side.select(*[F.col(c).alias(f"{c}_key_") for c in by], *[c for c in side.columns if c not in by])
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_key_")) for c in by])
    joined = own.join(F.broadcast(renamed) if n <= BROADCAST_RANGES else renamed, on, how)
    return joined.drop(*[f"{c}_key_" for c in by])


def medians(rows: DataFrame, by: list[str], value: str, **bounds: int) -> DataFrame:
    """by and the upper median of each group's values: the middle one, the upper of two."""
    return nth(rows, by, value, lambda n: [F.floor(n / 2)], **bounds).drop("rank")


def percentiles(rows: DataFrame, by: list[str], value: str, percent: float, **bounds: int) -> DataFrame:
    """by and the percentile of each group's values, between neighbours by their distance."""
    at = lambda n: (n - 1) * F.lit(percent / 100.0)
    found = nth(rows, by, value, lambda n: [F.floor(at(n)), F.floor(at(n)) + 1], **bounds)
    sizes = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n_"))
    if rows.schema[value].dataType.typeName() in ("double", "float"):
        sizes = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by).agg(F.count(F.lit(1)).alias("n_"))
    both = _with(found, sizes, by, BROADCAST_RANGES + 1, "inner")
    low = F.floor(at(F.col("n_")))
    ends = both.groupBy(*by).agg(F.max(F.when(F.col("rank") == low, F.col(value))).alias("below_"), F.max(F.when(F.col("rank") == low + 1, F.col(value))).alias("above_"), F.first(at(F.col("n_")) - low).alias("share_"))
    return ends.select(*by, (F.col("below_") + (F.coalesce("above_", "below_") - F.col("below_")) * F.col("share_")).alias(value))
