"""What the operators of this subpackage share: shared folders, sized broadcasts, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Fixed value: glibc's name for the size from which blocks are mapped each by itself.
M_MMAP_THRESHOLD = -3
#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only if it was counted and has at most this many rows ...
BROADCAST_ROWS = 1_000_000
#: ... and (by the caller's bytes a row) at most this many bytes. Larger sides are shuffled.
BROADCAST_BYTES = 48_000_000


#: Bytes of an Arrow batch, where the session has Spark's default of 64 MB: a worker holds a batch, what
#: it makes of it and the answer, the executor both as well, beside its heap.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20

#: Whether shuffle files are removed at the end of an execution.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package, bounds their batches, and names a checkpoint folder
    where none is set (in local mode only)."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH) == f"{64 << 20}b":
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")
    have = sc.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def light(run):
    """run for ``mapInArrow``, in a worker that gives memory back: large arrays as they are freed, the rest
    at the end of a task. Workers live through many stages, and what one stage took at most would
    stay with them through all others."""

    @functools.wraps(run)
    def wrapped(batches):
        from pyarrow import default_memory_pool

        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):  # glibc: no growing threshold, so that arrays of a MB are always returned
            libc.mallopt(M_MMAP_THRESHOLD, 1 << 20)
        yield from run(batches)
        default_memory_pool().release_unused()
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share (Spark's checkpoint folder)."""
    prepare(spark)
    found = spark.sparkContext.getCheckpointDir()
    return found if ":" in found else "file://" + os.path.abspath(found)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What runs inside has its shuffle files removed as it ends, and not only when the driver's memory is tidied.
    For DataFrames that are made inside; what was shuffled would be made again if one of them ran twice."""
    before = spark.conf.get(SWEEP)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEEP, before)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from a reliable checkpoint: nothing upstream is computed again."""
    prepare(df.sparkSession)
    with swept(df.sparkSession):
        return df.select("*").checkpoint()


def counted(df: DataFrame) -> int:
    """The number of rows of df; its shuffle files go."""
    with swept(df.sparkSession):
        return df.count()


def fewer(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """df in no more partitions than its counted rows need: rounds over a small table aren't hundreds of
    tasks each because the table that it came from had as many files."""
    return df.coalesce(max(1, -(-rows // each)))


def small(df: DataFrame, row_bytes: int = 32) -> DataFrame:
    """A broadcast hint if df, which should be cheap to count, is within the bounds above."""
    return F.broadcast(df) if counted(df) <= min(BROADCAST_ROWS, BROADCAST_BYTES // row_bytes) else df


def beside(pairs: DataFrame, side: DataFrame, key: str, each: int = 4096, first: DataFrame | None = None) -> DataFrame:
    """pairs (a, b, ...) with ``left`` and ``right``, structs of the rows of side that a and b name; ``first``, if given, has
    all rows that a names.

    b may be a hot one: its row is repeated, so that at most about ``each`` of its pairs meet one."""
    degree = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("parts_")).where(F.col("parts_") > each)
    degree = cut(degree.select("b", F.ceil(F.col("parts_") / each).cast("int").alias("parts_")))
    first = side if first is None else first
    first = first.select(F.col(key).alias("a"), F.struct(*first.columns).alias("left"))
    if not counted(degree):  # nothing to split
        return pairs.join(first, "a").join(side.select(F.col(key).alias("b"), F.struct(*side.columns).alias("right")), "b")
    degree = small(degree, 16)
    split = pairs.join(degree, "b", "left").withColumn("part_", F.pmod(F.xxhash64("a"), F.coalesce("parts_", F.lit(1))).cast("int")).drop("parts_")
    rows = side.select(F.col(key).alias("b"), F.struct(*side.columns).alias("right")).join(degree, "b", "left")
    rows = rows.withColumn("part_", F.explode(F.sequence(F.lit(0), F.coalesce("parts_", F.lit(1)) - 1))).drop("parts_")
    return split.join(first, "a").join(rows, ["b", "part_"]).drop("part_")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have (case-insensitively)."""
    have = {c.lower() for c in df.columns}
    while stem.lower() in have:
        stem += "_"
    return stem


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the smallest node reached.

    Alternating large-star and small-star rounds, each a minimum by key and a join, so that no
    neighbourhood is ever gathered; rounds are cut by checkpoints and end when nothing changes.
    Nodes without an edge aren't returned. Null ends and self loops are ignored.
    """
    now = cut(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    with swept(edges.sparkSession):
        state = now.agg(F.count(F.lit(1)), total).first()
    now = fewer(now, state[0])
    while state[0]:
        # Large star: each larger neighbour of u moves to u's smallest neighbour (or u itself).
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: each smaller neighbour of u, and u itself, moves to the smallest of them.
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, cut(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        with swept(edges.sparkSession):
            last, state = state, now.agg(F.count(F.lit(1)), total).first()
            now = fewer(now, state[0])
            if state == last and now.join(before, ["u", "v"], "left_anti").isEmpty():
                break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())



def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of what roots (node, root; as ``components`` gives them) stands for and of links (a, b) besides: only the
    links between different roots go through rounds, the nodes of roots are renamed once."""
    name = lambda df, c: df.join(small(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))), c, "left")
    ends = name(name(links.select("a", "b"), "a"), "b")
    ends = cut(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a <> b").distinct())
    if ends.isEmpty():
        return roots
    top = cut(components(ends))
    again = top.select(F.col("node").alias("root"), F.col("root").alias("least"))
    own = roots.join(small(again), "root", "left").select("node", F.coalesce("least", "root").alias("root"))
    new = top.join(small(roots.select("node")), "node", "left_anti").select("node", "root")
    return cut(own.union(new))
