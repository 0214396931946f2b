"""Operator 8, quality by ordinal cumulative-link regression on hashed text.

Ratings are ordered grades. One weight vector w over hashed features is shared by all grades and
ordered thresholds t1 < t2 < ... part them: P(grade <= k) = sigmoid(t_k - w x). The features are
the square roots of the shares of byte trigrams and lower-case words among a text's own, hashed to
``TRIGRAMS`` and ``WORDS`` columns, three figures of its make-up, and the rates of the *marks*: byte six-grams whose
rates differ most between one grade and the next in the sample. What makes a text toxic is a few
words among hundreds, which shares alone don't show.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.llm.common import cut, light, prepare
from quaver.llm.textbuf import Words, buffers

TRIGRAMS, WORDS, MORE = 2048, 2048, 3
WIDTH = TRIGRAMS + WORDS + MORE
#: The bound of the sample of rated rows that the model is fitted on.
SAMPLE = 6000
#: Bytes of a gram, bits of its hash, and the most marks between two grades. A rate is one thousandth
#: for each 1 / FULL of a text's bytes that the gram begins, FULL / GRAM per word; at most 1000.
GRAM, GRAM_BITS, MARKS, FULL = 6, 20, 64, 600
#: Added to the variance of a difference of rates (0 to 1): grams that few texts have aren't marks.
PLAIN = 1e-4
#: The grade of ``ratings_of`` that is worth keeping; toxic documents are below it.
CLEAN = 2
STEPS, RATE, DECAY = 250, 0.05, 2e-5


def runs(texts: pa.Array):
    """Yields (first document, texts, their bytes, offsets) for runs of documents; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    data, offsets = buffers(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 18), "right")) - 1)
        j = min(j, i + 128)  # rows of features are wide
        yield i, texts.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def features(texts: pa.Array, marks: np.ndarray | None = None):
    """Yields (first document, rows x WIDTH float32, and a column for each mark) for runs of documents."""
    for i, own, data, at in runs(texts):
        x = _rows(own, data, at)
        if marks is not None and len(marks):
            place = np.full(1 << GRAM_BITS, -1, np.int32)
            place[marks] = np.arange(len(marks))
            doc, gram, size = grams(own)
            column = place[gram]
            hit = column >= 0
            count = np.bincount(doc[hit] * len(marks) + column[hit], minlength=len(own) * len(marks)).reshape(len(own), len(marks))
            x = np.concatenate([x, (rates(count, size[:, None]) / 1000).astype(np.float32)], axis=1)
        yield i, x


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents and the hashes of all lower-case grams, white space being a blank, and each
    document's bytes."""
    data, offsets = buffers(pc.utf8_lower(texts))
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    data = np.where((data >= 9) & (data <= 13), 32, data[: offsets[-1]]).astype(np.uint64) if len(data) else np.zeros(0, np.uint64)
    n = max(len(data) - GRAM + 1, 0)
    key = np.zeros(n, np.uint64)
    for k in range(GRAM):
        key = key << np.uint64(8) | data[k : k + n]
    key = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)
    doc = np.repeat(np.arange(len(size)), size)
    inside = doc[:n] == doc[len(doc) - n :]
    return doc[:n][inside], key[inside].astype(np.int64), size


def rates(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Thousandths, whole numbers: their sums are the same in any order."""
    return np.minimum(count * FULL * 1000 // np.maximum(size, 1), 1000)


def marks_of(rated: DataFrame) -> np.ndarray:
    """The marks of rated (grade, text): for each grade and the next the grams whose mean rates
    differ most, by the difference over its deviation."""
    sizes = {r.grade: r.n for r in rated.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    levels = sorted(sizes)
    if len(levels) < 2:
        return np.zeros(0, np.int64)

    @light
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            grade = np.array(batch.column(0).to_pylist(), np.int64)
            for first, own, _, _ in runs(batch.column(1)):
                doc, gram, size = grams(own)
                key, count = np.unique(doc << GRAM_BITS | gram, return_counts=True)
                doc, gram = key >> GRAM_BITS, key & (1 << GRAM_BITS) - 1
                rate, of = rates(count, size[doc]), grade[first : first + len(own)][doc]
                for level in np.unique(of).tolist():
                    sums = total.setdefault(level, np.zeros((2, 1 << GRAM_BITS), np.int64))
                    np.add.at(sums[0], gram[of == level], rate[of == level])
                    np.add.at(sums[1], gram[of == level], rate[of == level] ** 2)
        for level, sums in total.items():
            at = np.flatnonzero(sums[0])
            for part in (at[k : k + 50_000] for k in range(0, len(at), 50_000)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), level), pa.int32()), pa.array(part, pa.int32()), pa.array(sums[0][part]), pa.array(sums[1][part])], ["grade", "gram", "s", "ss"])

    parts = [F.sum(F.when(F.col("grade") == g, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k, g in enumerate(levels) for c in ("s", "ss")]
    sums = cut(rated.select("grade", "text").mapInArrow(run, "grade int, gram int, s long, ss long").groupBy("gram").agg(*parts))
    found: set[int] = set()
    for k in range(1, len(levels)):
        n, mean, spread = {}, {}, {}
        for j in (k - 1, k):
            n[j] = sizes[levels[j]]
            mean[j] = F.col(f"s{j}") / F.lit(1e3 * n[j])
            spread[j] = F.col(f"ss{j}") / F.lit(1e6) - mean[j] * mean[j] * F.lit(float(n[j]))
        shared = (spread[k - 1] + spread[k]) / F.lit(float(n[k - 1] + n[k])) * F.lit(1 / n[k - 1] + 1 / n[k])
        apart = F.abs(mean[k] - mean[k - 1]) / F.sqrt(shared + F.lit(PLAIN))
        found |= {r.gram for r in sums.select("gram", apart.alias("apart")).orderBy(F.desc("apart"), "gram").limit(MARKS).collect()}
    return np.array(sorted(found), np.int64)


def _rows(texts: pa.Array, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    out = np.zeros((n, WIDTH), np.float32)
    size = np.diff(at)
    if len(data) > 2:
        doc = np.repeat(np.arange(n), size)
        wide = data.astype(np.uint32)
        tri = ((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761)) >> np.uint32(32 - TRIGRAMS.bit_length() + 1)
        inside = doc[:-2] == doc[2:]
        count = np.bincount(doc[:-2][inside] * TRIGRAMS + tri[inside], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
        out[:, :TRIGRAMS] = np.sqrt(count / np.maximum(size - 2, 1)[:, None])
    lower = Words(*buffers(pc.utf8_lower(texts)))
    if len(lower.hash):
        place = lower.doc()
        count = np.bincount(place * WORDS + (lower.hash % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
        out[:, TRIGRAMS : TRIGRAMS + WORDS] = np.sqrt(count / np.maximum(lower.count, 1)[:, None])
        again = np.zeros(len(place), bool)
        again[1:] = (lower.hash[1:] == lower.hash[:-1]) & (place[1:] == place[:-1])
        out[:, -3] = np.bincount(place, weights=again, minlength=n) / np.maximum(lower.count, 1)
        out[:, -2] = (count > 0).sum(axis=1) / np.minimum(np.maximum(lower.count, 1), WORDS)
        out[:, -1] = np.minimum(np.log1p(lower.count) / 8, 1.5)
    return out


@dataclass
class Ordinal:
    """Weights, rising thresholds and the marks among the features; thresholds is empty if fewer than
    two grades were rated."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray
    marks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k = 1, 2, ... of each row."""
        score = x @ self.weights
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit(x: np.ndarray, grade: np.ndarray, steps: int = STEPS) -> Ordinal:
    """Maximum likelihood with weight decay, by Adam over the whole sample."""
    grades = np.unique(grade)
    w = np.zeros(x.shape[1], np.float32)
    if len(grades) < 2:
        return Ordinal(w, np.zeros(0), grades if len(grades) else np.array([0]))
    k = np.searchsorted(grades, grade)
    below = np.cumsum(np.bincount(k))[:-1] / len(k)
    first = np.log(below / (1 - below))
    raw = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 0.05))])  # thresholds stay ordered
    state = [np.zeros(len(w) + len(raw)) for _ in range(2)]

    def bounds(raw):
        return np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])

    for step in range(1, steps + 1):
        t, score = bounds(raw), (x @ w).astype(np.float64)
        upper = np.append(t, np.inf)[k] - score
        lower = np.insert(t, 0, -np.inf)[k] - score
        with np.errstate(over="ignore"):
            su, sl = 1 / (1 + np.exp(-upper)), 1 / (1 + np.exp(-lower))
        p = np.maximum(su - sl, 1e-9)
        du, dl = su * (1 - su) / p, sl * (1 - sl) / p
        by_score = (dl - du) / len(k)  # gradient of the log likelihood
        by_t = np.array([(du[k == j].sum() - dl[k == j + 1].sum()) / len(k) for j in range(len(t))])
        by_raw = np.concatenate([[by_t.sum()], [by_t[j:].sum() * np.exp(raw[j]) for j in range(1, len(raw))]])
        gradient = np.concatenate([(by_score.astype(np.float32) @ x) - DECAY * w, by_raw])
        for s, g, b in zip(state, (gradient, gradient**2), (0.9, 0.999), strict=True):
            s *= b
            s += (1 - b) * g
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w += move[: len(w)].astype(np.float32)
        raw = raw + move[len(w) :]
    return Ordinal(w, bounds(raw), grades)


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Fits on the ``sample`` rated documents whose doc_id hashes lowest. ratings has doc_id and
    grade; of several grades of a document the lowest counts, null ones don't."""
    prepare(docs.sparkSession)
    rated = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull()).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = F.broadcast(cut(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)))  # at most ``sample`` rows

    # Of the texts of a repeated doc_id one is taken, the same however the rows are spread.
    own = docs.select("doc_id", "text").join(chosen, "doc_id")
    one = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")
    rated = cut(own.groupBy("doc_id").agg(F.first("grade").alias("grade"), one).select("grade", "text"))
    marks = marks_of(rated)

    @light
    def run(batches):
        for batch in batches:
            rows = [r.astype(np.float16).tobytes() for _, x in features(batch.column(1), marks) for r in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["grade", "x"])

    # The order of the rows is that of their hashes, so that sums are the same on any partitioning; they
    # come a partition at a time into the one array that is fitted.
    rows = cut(rated.mapInArrow(run, "grade int, x binary").withColumn("key", F.xxhash64("x")))
    places: dict[tuple, list[int]] = {}
    for k, r in enumerate(sorted(rows.select("grade", "key").collect())):  # at most ``sample``
        places.setdefault((r.grade, r.key), []).append(k)
    n = sum(map(len, places.values()))
    x, grades = np.empty((n, WIDTH + len(marks)), np.float32), np.empty(n, np.int64)
    for r in rows.toLocalIterator():
        k = places[r.grade, r.key].pop()
        x[k], grades[k] = np.frombuffer(r.x, np.float16), r.grade
    model = fit(x, grades)
    model.marks = marks
    return model


def grade_documents(docs: DataFrame, model: Ordinal, least: int = 1) -> DataFrame:
    """docs with expected_grade double, p_tail array<double> (P(grade >= each but the lowest)) and
    keep boolean: P(grade >= ``least``) of at least a half.

    Null and empty texts are graded as empty texts. If fewer than two grades were rated all are
    kept, with that grade and no tails; if no rating reached ``least``, none. Columns of these names are replaced; others stay.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop("expected_grade", "p_tail", "keep")
    shared = spark.sparkContext.broadcast(model)  # WIDTH weights, and those of the marks
    at, names = docs.columns.index("text"), docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("p_tail", T.ArrayType(T.DoubleType())), T.StructField("keep", T.BooleanType())])

    @light
    def run(batches):
        for batch in batches:
            model = shared.value
            tails = np.concatenate([np.zeros((0, len(model.thresholds))), *(model.tails(x) for _, x in features(batch.column(at), model.marks))])
            expected = model.grades[0] + tails @ np.diff(model.grades)
            below = int((model.grades < least).sum()) if len(model.thresholds) else 0
            reach = np.column_stack([np.ones(len(tails)), tails, np.zeros(len(tails))])  # P(grade >= each), then of what no rating reached
            keep = reach[:, below] >= 0.5
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(tails) + 1) * tails.shape[1], pa.int32()), pa.array(tails.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected, pa.float64()), lists, pa.array(keep)], [*names, "expected_grade", "p_tail", "keep"])

    return docs.mapInArrow(run, schema)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades of the labels table: 0 for bad quality, 1 for good but toxic, 2 for good."""
    return labels.select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).cast("int").alias("grade"))
