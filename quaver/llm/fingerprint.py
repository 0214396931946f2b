"""Operator 10, document fingerprints: every shingle hash below a fixed threshold, all in the JVM.

A shingle is five words (a shorter text is one shingle of all its words). Of the 64-bit hashes of a
text's shingles those in the lowest 1/``scale`` of their range are kept, so the sketch of a union
is the union of sketches below the threshold, and containment can be estimated between documents
of any lengths. The smallest hash is always kept, so that no text with a word has an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.llm.common import WORD, fresh, prepare

SHINGLE = 5
SCALE = 8


def threshold(scale: int = SCALE) -> int:
    """Signed hashes below this are the lowest 1/scale of all."""
    return -(1 << 63) + (1 << 64) // scale


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def shingle_hashes(h: Column, k: int = SHINGLE) -> Column:
    """Hashes of each k consecutive word hashes; of all of them if there are fewer."""
    short = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))
    return F.when(F.size(h) < k, short).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
    )


def sketch(hashes: Column, scale: int = SCALE) -> Column:
    """The distinct hashes below the threshold, sorted; at least the smallest of all."""
    low = F.array_sort(F.array_distinct(F.filter(hashes, lambda x: x < F.lit(threshold(scale)))))
    return F.when(F.size(low) > 0, low).when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(low)


def as_text(sketched: Column) -> Column:
    """Sixteen hex digits for each hash."""
    return F.lower(F.array_join(F.transform(sketched, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of the union's shingles that both have; 1 for two empty sketches."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    return sketch(F.array_union(a, b), scale)


def fingerprints(docs: DataFrame, scale: int = SCALE, text: str = "text", name: str = "sketch") -> DataFrame:
    """docs with the sketch (array<bigint>) of each whole text; a null text is empty, and an empty
    one has an empty sketch. Repeated rows are kept."""
    hashed = fresh(docs, "hashes_")
    return (
        docs.withColumn(hashed, word_hashes(F.coalesce(F.col(text), F.lit(""))))
        .withColumn(hashed, shingle_hashes(F.col(hashed)))
        .withColumn(name, sketch(F.col(hashed), scale))
        .drop(hashed)
    )


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """docs with ``following``, a struct of the other columns of the next greater doc_id's row, the
    first one's for the last; docs has doc_id, text and columns that depend on the text.

    Bucket bounds are doc_ids of the table (approximate quantiles, one small row on the driver), so
    the first document of each bucket is known beforehand and a copy of it ends the bucket before;
    no single partition orders the table. Rows without a doc_id have and are no neighbour.
    Of rows with the same doc_id, texts decide the order.
    """
    spark = docs.sparkSession
    prepare(spark)
    rest = [c for c in docs.columns if c != "doc_id"]
    n = buckets or min(1 << 16, 6 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / n for k in range(1, n)] or [0.5]
    found = docs.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", shares, max(10_000, 20 * n)).alias("bounds")).first()
    bounds = sorted({found.least, *(found.bounds or [])} - {None})
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    last = max(0, len(bounds) - 1)

    def numbers(values):
        return F.array(*[F.lit(v).cast("long") for v in values]) if values else F.array().cast("array<bigint>")

    # Bounds at or below the id, searched in two steps over the square root of their number.
    firsts, table = numbers([g[0] for g in groups]), F.array(*[numbers(g) for g in groups]).cast("array<array<bigint>>")
    group = F.size(F.filter(firsts, lambda b: b <= F.col("doc_id"))) - 1
    inside = F.size(F.filter(F.get(table, F.col("group_")), lambda b: b <= F.col("doc_id"))) - 1
    bound = F.get(F.get(table, F.col("group_")), F.col("inside_"))
    here = F.struct(F.col("bucket_").alias("bucket_"), F.lit(False).alias("ghost_"))
    before = F.struct(F.when(F.col("bucket_") == 0, F.lit(last)).otherwise(F.col("bucket_") - 1).alias("bucket_"), F.lit(True).alias("ghost_"))
    placed = (
        docs.withColumn("group_", group)
        .withColumn("inside_", inside)
        .withColumn("bucket_", F.when(F.col("doc_id").isNotNull(), F.col("group_") * step + F.col("inside_")).otherwise(-1 - F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")))
        .withColumn("at_", F.when(F.col("doc_id") == bound, F.array(here, before)).otherwise(F.array(here)))
        .select("doc_id", *rest, F.explode("at_").alias("at_"))
        .select("doc_id", *rest, "at_.*")
    )
    order = Window.partitionBy("bucket_").orderBy("ghost_", "doc_id", "text")
    following = F.when(F.col("doc_id").isNotNull(), F.lead(F.struct(*rest)).over(order))
    return placed.withColumn("following", following).where("not ghost_").select("doc_id", *rest, "following")


def edited_fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text, its edited text and the likeness of both and of the next text.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next
    document, ascending doc_id (after the last: the first). A null text is empty; a row without a
    doc_id has an empty next text. Repeated rows are each other's neighbours.
    """
    cut_at = (F.length("text") / 2).cast("int")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    other = F.coalesce("following.text", F.lit(""))
    rows = (
        with_next(fingerprints(docs, scale, "text", "own_sketch"))
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - cut_at), F.substring(other, F.lit(1), cut_at)))
    )
    rows = fingerprints(rows, scale, "edited", "edit_sketch")
    own, edit, following = F.col("own_sketch"), F.col("edit_sketch"), F.coalesce("following.own_sketch", F.array().cast("array<bigint>"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"),
        as_text(edit).alias("edited_fingerprint"),
        likeness(own, edit).alias("near_edited"),
        likeness(own, following).alias("near_next"),
        containment(own, edit).alias("kept_in_edited"),
    )
