"""Rules by a sweep, durations in bands, sequence changes and a stack of steps against plain code."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quaver.functions.sequence import common, patched, script
from quaver.operators import history, lookup

RULE = "song_id long, idx int, base string, valid_from long, valid_to long, texts array<string>, offsets_ms array<long>"


def plain_rule(rules, song, reading, t):
    held = [r for r in rules if r[0] == song and r[2] == reading and t is not None and r[3] is not None and r[3] <= t and (r[4] is None or t < r[4])]
    return min(held, key=lambda r: r[1])[5] if held else None


@pytest.mark.parametrize("parts", [1, 3, None])
def test_rules_equal_a_look_at_all(spark, parts):
    r = random.Random(2)
    rules = [(r.randrange(3), i, r.choice("ab"), r.choice([None, 0, *range(20)]), r.choice([None, 0, *range(30)]), [f"x{i}"], [0]) for i in r.sample(range(200), 120)]
    words = [(r.randrange(4), i, r.choice("abc"), r.choice([None, *range(-2, 33)])) for i in range(400)] * 2
    df = spark.createDataFrame(words, "song_id long, word_idx long, reading string, t long").repartition(3)
    out = lookup.ruby_for(df, spark.createDataFrame(rules, RULE), parts)
    assert out.columns == ["song_id", "word_idx", "reading", "t", "texts", "offsets_ms"]
    got = Counter((*x[:4], tuple(x.texts or ())) for x in out.collect())
    assert got == Counter((*w, tuple(plain_rule(rules, w[0], w[2], w[3]) or ())) for w in words)
    shared = [(0, *x[1:]) for x in rules]
    out = lookup.ruby_for(df, spark.createDataFrame(shared, RULE).drop("song_id"), parts)
    assert Counter((*x[:4], tuple(x.texts or ())) for x in out.collect()) == Counter((*w, tuple(plain_rule(shared, 0, w[2], w[3]) or ())) for w in words)
    assert lookup.ruby_for(df, spark.createDataFrame([], RULE)).where("texts is not null").isEmpty()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # base texts that go on in the next batch
    try:
        out = lookup.ruby_for(df, spark.createDataFrame(rules, RULE).coalesce(1), parts)
        assert Counter((*x[:4], tuple(x.texts or ())) for x in out.collect()) == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ten_thousand_rules_of_one_text(spark):
    rules = spark.range(10_000).select(F.lit(1).cast("long").alias("song_id"), F.col("id").cast("int").alias("idx"), F.lit("a").alias("base"), (F.col("id") * 10).alias("valid_from"), (F.col("id") * 10 + 25).alias("valid_to"), F.array(F.col("id").cast("string")).alias("texts"), F.array(F.lit(0)).alias("offsets_ms"))
    words = spark.range(100_000).select(F.lit(1).cast("long").alias("song_id"), F.lit("a").alias("reading"), F.col("id").alias("t"))
    # At t the rules (t - 24) / 10 to t / 10 hold: the first of them counts.
    want = F.greatest(F.floor((F.col("t") - 15) / 10), F.lit(0))
    assert lookup.ruby_for(words, rules).where(F.get("texts", 0) != want.cast("string")).isEmpty()


def test_bands_equal_all_pairs(spark):
    r = random.Random(6)
    rows = [(i, r.choice("ab"), r.choice([None, 0.0, 0.25, 0.5, -0.1, r.random() * 3])) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, stem string, duration double")
    got = Counter(tuple(x) for x in lookup.cached_stems(df, df).select("a.id", "c.id").collect())
    assert got == Counter((a[0], c[0]) for a in rows for c in rows if a[1] == c[1] and None not in (a[2], c[2]) and abs(a[2] - c[2]) < 0.25)


# --- sequences ----------------------------------------------------------------------------------


def distance(a, b):
    """Deletions and insertions of a shortest script, by the whole table of lengths."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return len(a) + len(b) - 2 * row[-1]


def test_scripts_are_shortest_and_go_both_ways():
    r = random.Random(1)
    for _ in range(400):
        a, b = ([r.choice("abcde"[: r.randrange(1, 6)]) for _ in range(r.randrange(0, 40))] for _ in range(2))
        own = script(a, b)
        assert len(own) == distance(a, b)
        assert patched(a, own, False) == b and patched(b, own, True) == a
        both = common(a, b)
        assert all(a[i] == b[j] for i, j in both) and both == sorted(set(both))
    long = [f"w{r.randrange(3000)}" for _ in range(20_000)]
    other = [*long[:5000], "new", *long[5000:12_000], *long[12_003:]]
    assert [(e["op"], e["word"]) for e in script(long, other)] == [*(("delete", w) for w in long[12_000:12_003]), ("insert", "new")]


def test_word_changes(spark):
    r = random.Random(9)
    rows = []
    for k in range(60):
        old = [r.choice("abcdefgh") for _ in range(r.randrange(0, 30))]
        new = list(old)
        for _ in range(r.randrange(0, 4)):
            new.insert(r.randrange(len(new) + 1), "z")
        rows.append((k if k else None, old, [x for x in new if r.random() > 0.1]))
    rows += [(100, None, ["a"]), (101, ["a"], None), (102, [], []), (103, ["é", "", " "], ["", " ", "é"])]
    df = spark.createDataFrame(rows, "song_id long, old array<string>, new array<string>").repartition(3)
    log = history.word_changes(df)
    assert {x.song_id: x["count"] for x in log.groupBy("song_id").count().collect()} == {k: d for k, a, b in rows if (d := distance(a or [], b or []))}
    back = history.words_undone(df.select("song_id", F.col("new").alias("words")), log)
    forth = history.words_redone(df.select("song_id", F.col("old").alias("words")), log)
    assert {x.song_id: x.words or [] for x in back.collect()} == {k: a or [] for k, a, _ in rows}
    assert {x.song_id: x.words or [] for x in forth.collect()} == {k: b or [] for k, _, b in rows}


# --- steps ----------------------------------------------------------------------------------------


class Stack:
    """The plain thing: two lists of (from, to)."""

    def __init__(self, most):
        self.most, self.now, self.undo, self.redo = most, None, [], []

    def do(self, at, action, changed):
        if action == "record":
            if self.now is not None and changed:
                self.undo.append((self.now, at))
            if self.now is None or changed:
                self.now = at
            self.redo = []
            while len(self.undo) > self.most:
                self.undo.pop(0)
        elif action == "undo" and self.undo:
            step = self.undo.pop()
            self.redo.append(step)
            self.now = step[0]
        elif action == "redo" and self.redo:
            step = self.redo.pop()
            self.undo.append(step)
            self.now = step[1]
        elif action == "clear":
            self.now, self.undo, self.redo = None, [], []
        return self.now, len(self.undo), len(self.redo)


@pytest.mark.parametrize("most", [3, 200])
def test_stack_of_steps(spark, most):
    r = random.Random(most)
    acts = [(r.choice([1, 2, 3, None]), i, r.choices(["record", "undo", "redo", "clear"], [8, 5, 4, 0.2])[0], r.random() < 0.8) for i in range(1500)]
    plain = {k: Stack(most) for k in (1, 2, 3, None)}
    want = {(k, i): plain[k].do(i, a, c) for k, i, a, c in acts}
    df = spark.createDataFrame(acts, "song_id long, ordinal long, action string, changed boolean").repartition(3)
    assert {(x.song_id, x.ordinal): tuple(x)[2:] for x in history.stack(df, most).collect()} == want


def test_a_table_at_any_step(spark):
    """Versions by random changes; every one comes back from the last one and the log."""
    r = random.Random(4)
    now, states, logs = {}, [{}], []
    for step in range(1, 9):
        new = {k: v for k, v in now.items() if r.random() > 0.2}
        new |= {r.choice([None, *range(12)]): r.choice("xyz") for _ in range(4)}
        old_df, new_df = (spark.createDataFrame(list(x.items()), "k long, v string") for x in (now, new))
        logs.append(history.changes(old_df.where("k is not null"), new_df.where("k is not null"), ["k"]).withColumn("step", F.lit(step)))
        now = new
        states.append({k: v for k, v in new.items() if k is not None})
    log = logs[0]
    for x in logs[1:]:
        log = log.unionByName(x)
    log = spark.createDataFrame(log.collect(), log.schema)
    current = spark.createDataFrame(list(states[-1].items()), "k long, v string")
    for step, want in enumerate(states):
        assert {x.k: x.v for x in history.at_step(current, log, ["k"], step).collect()} == want
