"""Fill-in-middle, token counts and the filter audit against plain code."""

import hashlib
import itertools
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quaver.llm import middle, tokencount
from quaver.llm.audit import failures, interactions, survivors
from quaver.llm.registry import tokenizer_file

ODDITIES = ["", None, " ", "\t\n", "a", " a", "a ", "  a \x0b b\r\n", "é ü 　x", "😀 😀\n😀", "x\x1fy z", "<P", "a <P> b", "<S>", "x<M>y", "<<S", "a<S <M b", "word"]


# --- operator 11 ---------------------------------------------------------------------------------


def plain_middle(key, text, seed=42, rate=50, spm=80):
    t = text or ""
    w = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(w), "plain", None, None, t
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h4 % 100 < spm:
        return len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("size", "most", "rate", "spm"), [(2048, 32, 50, 80), (1, 10_000, 100, 50), (7, 3, 100, 0), (3, 1, 90, 100)])
def test_middles_equal_plain_code(spark, monkeypatch, size, most, rate, spm):
    """Also with chunks of a few characters, and with few chunks whatever their length."""
    monkeypatch.setattr(middle, "CHUNK", size)
    monkeypatch.setattr(middle, "CHUNKS", most)
    r = random.Random(size)
    made = ["".join(r.choice("ab é\n\t😀<>PSM") for _ in range(r.randrange(60))) for _ in range(150)]
    texts = ODDITIES + made + (["w é " * 40_000, "x" * 9000, " " * 5000 + "x"] if size > 1000 else [])
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = middle.fill_in_middle(df, 42, rate, spm).withColumn("back", middle.restored(F.col("output"), F.col("form")))
    got = Counter((x.doc_id, x.text, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in out.collect())
    assert got == Counter((k, t, *plain_middle(k, t, 42, rate, spm)) for k, t in rows)
    assert out.where("back <> coalesce(text, '')").isEmpty()


def test_middles_of_tables_with_other_columns(spark):
    rows = [(1, "a b c", "x", 5, "f"), (1, "a b c", "x", 5, "f"), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Whole_ string, n int, FORM string")
    out = middle.fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "Whole_", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted((x.doc_id, x.Whole_ or "", x.n) for x in out.collect()) == [(1, "x", 3), (1, "x", 3), (2, "", 0)]
    assert middle.fill_in_middle(df.limit(0)).collect() == []


def test_middles_need_no_exchange(spark):
    plan = middle.fill_in_middle(spark.range(9).selectExpr("id doc_id", "repeat('a b ', 9) text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# --- operator 12 ---------------------------------------------------------------------------------


def plain_counts(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        found = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(found.encode(t or "")) for t in texts]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def cached_rows(spark, cache):
    return spark.read.parquet(cache).count()


SPACED = ["a  b", "a b", "a\n\tb", " a b ", "<|endoftext|> x  <|ENDOFTEXT|>", "<|end\noftext|>", "it's\x0b\x0cits ' s", "Á é\ńx", "x \n y 　", "\x85 a", "1234 5", "ß İ ẞ"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, tmp_path, name):
    """Texts that differ in white space only share a digest where the tokenizer doesn't tell them apart."""
    r = random.Random(4)
    made = ["".join(r.choice("abS 's9é\n\t\x0b 　́<|>") for _ in range(r.randrange(40))) for _ in range(300)]
    texts = ODDITIES + SPACED + made + ["long word " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    cache = str(tmp_path / "c")
    out = tokencount.count_tokens(df, public_tokenizers.path(name), cache, limit=100).collect()
    want = plain_counts(name, texts)
    assert {x.doc_id: (x.n_bytes, x.n_tokens, x.over_limit) for x in out} == {i: (len((t or "").encode()), n, n > 100) for i, (t, n) in enumerate(zip(texts, want, strict=True))}
    folded = {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") if name.startswith("word") else t or "" for t in texts}
    assert cached_rows(spark, cache) == len(folded)


def test_only_misses_are_encoded_and_appended(spark, tmp_path, monkeypatch):
    file, cache = tokenizer_file(), str(tmp_path / "c")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, Content_ int").repartition(2)
    first = [(1, "a b", "", 1), (1, "a b", "", 1), (None, "a b", "", 2), (None, None, "", 3), (3, "", "", 4), (None, "only here", "", 5)]
    out = tokencount.count_tokens(frame(first), file, cache)
    assert out.columns == ["doc_id", "Content_", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((x.Content_, x.n_bytes, x.n_tokens) for x in out.collect()) == [(1, 3, 2), (1, 3, 2), (2, 3, 2), (3, 0, 0), (4, 0, 0), (5, 9, 2)]
    assert cached_rows(spark, cache) == 3
    # A second table: one text is new. Stored counts are taken as they are.
    version = tokencount.version_of(file)
    forged = hashlib.sha256(b"stored only").digest()
    spark.createDataFrame([(forged, 77), (forged, 77)], tokencount.STORED).write.mode("append").parquet(f"{cache}/version={version}")
    second = [(1, "a b", "", 1), (2, "stored  only", "", 2), (3, "new", "", 3)]
    assert sorted((x.Content_, x.n_tokens) for x in tokencount.count_tokens(frame(second), file, cache).collect()) == [(1, 2), (2, 77), (3, 1)]
    assert cached_rows(spark, cache) == 6
    # All is stored now: nothing is encoded or written.
    monkeypatch.setattr(tokencount, "encoded", None)
    assert sorted((x.Content_, x.n_tokens) for x in tokencount.count_tokens(frame(second), file, cache).collect()) == [(1, 2), (2, 77), (3, 1)]
    assert tokencount.count_tokens(frame(first).limit(0), file, str(tmp_path / "d")).collect() == []
    # Another version has counts of its own.
    assert version != tokencount.version_of(public_tokenizers.path("byte_bpe_50k.json"))


def test_counts_with_shuffled_sides(spark, tmp_path, monkeypatch):
    """No broadcast at all: every join is by key, null keys too."""
    monkeypatch.setattr(tokencount, "small", lambda df, *_: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = ["a b", "a  b", None, "c"] * 30
        df = spark.createDataFrame([(i if i % 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
        got = tokencount.count_tokens(df, tokenizer_file(), str(tmp_path / "c")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert Counter((x.doc_id, x.n_tokens) for x in got) == Counter((i if i % 3 else None, n) for i, n in enumerate([2, 2, 0, 1] * 30))


# --- operator 13 ---------------------------------------------------------------------------------


def plain_flags(rows):
    out = []
    least = {}
    for key, text, _ in rows:
        if key is not None:
            least[text or ""] = min(least.get(text or "", key), key)
    for key, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": key is not None and key > least[t],
        }
        out.append({f for f, x in fails.items() if x})
    return out


def plain_audit(rows, labels):
    good, toxic = ({k for k, *x in labels if x[i] == 1} for i in (0, 1))
    parts = {}
    for (key, _, part), fails in zip(rows, plain_flags(rows), strict=True):
        parts.setdefault(part or "", []).append((key, fails))
    out, shapley = {}, Counter()
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                redundant = sum(f in d[1] for d in docs) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def document(r):
    words = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 150, 199, 200, 201, 260]))]
    if r.random() < 0.3:
        words = [r.choice(words[: r.choice([2, 100])]) for _ in words]
    if r.random() < 0.3:
        words = [w.upper() if r.random() < 0.1 else w for w in words]
    return "\n ".join(words) + r.choice(["", "", "|", "$5", "~"])


def audited(df):
    return {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in df.collect()}


def test_audit_equals_every_order_played_out(spark):
    r = random.Random(8)
    base = [document(r) for _ in range(60)]
    rows = [(i, r.choice(base), r.choice(["web", "web", "", None, "book"])) for i in range(150)]
    rows += [(7, base[0], "web"), (7, base[0], "web"), (None, base[0], "web"), (900, "", "web"), (901, None, "one"), (902, "É" * 50, "two"), (903, "A" + "x" * 49, "two"), (904, "AA" + "x" * 97, "two")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 150, 2)] + [(7, 1, 0), (7, 0, 1), (5000, 1, 1)]
    df = spark.createDataFrame([(*x, "extra", 1) for x in rows], "doc_id long, text string, source string, digest string, A int").repartition(4)
    told = spark.createDataFrame([*labels, (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert audited(interactions(failures(df, told))) == plain_audit(rows, labels)


def test_audit_of_tables_without_rows_or_failures(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions(failures(df, labels)).collect() == []
    one = spark.createDataFrame([("p", False, None, 1, 0)], "part string, X boolean, Y boolean, good int, toxic int")
    assert {(x.subset, x.n, x.good) for x in survivors(one, ("X", "Y")).collect()} == {(k, 1, 1) for k in range(4)}
    assert {(x.filter_order, x.step, x.kept, x.removed) for x in interactions(one, ("X", "Y")).collect()} == {("XY", 1, 1, 0), ("XY", 2, 1, 0), ("YX", 1, 1, 0), ("YX", 2, 1, 0)}
    with pytest.raises(ValueError, match="filters"):
        interactions(one, tuple("ABCDEFGH"))
