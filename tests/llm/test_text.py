"""Substring dedup, packing, byte-pair coding and fingerprints against plain code."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaver.llm import fingerprint, packing, substring
from quaver.llm.bpe import build_lexicon, decode_ids, digests, encode
from quaver.llm.lexicon import Lexicon, compile_lexicon, minimal_automaton
from quaver.llm.registry import tokenizer_file
from quaver.llm.textbuf import Words, buffers, grams, sliding_min
from quaver.llm.wordbpe import WordBpe

WORDS = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "ion", "ur", "est")]
ODD = "doc_id long, text string, th string, starts int, SALT_ string, sketch int, ids string"


@pytest.fixture(scope="module")
def tokens():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)


def brute_removed(docs, span):
    words = {i: (t or "").encode().split() for i, t in docs.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - span + 1):
            first.setdefault(tuple(words[i][k : k + span]), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - span + 1) if first[tuple(w[k : k + span])] < i for j in range(k, k + span)}
        out[i] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


@pytest.mark.parametrize(("room", "most"), [(16, 64), (1, 0), (10**9, 64)])
def test_substrings_equal_brute_force(spark, room, most):
    """Also with the sketch joined, and so small that nearly every window is estimated repeated."""
    r = random.Random(1)
    base = [text(r, r.randrange(10, 300)) for _ in range(40)]
    docs = base + [base[2]] * 5 + [f"{text(r, 30)}\n{base[7]}\t{text(r, 5)}" for _ in range(10)] + ["la " * 500, "la " * 300, "", None, "é x"]
    docs = dict(enumerate(docs))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring.dedup_substrings(df, room=room, most=most).collect()}
    assert got == brute_removed(docs, 50)
    sha = {r.doc_id: r.kept_sha256 for r in substring.dedup_substrings(df, digests=True).collect()}
    assert sha == {i: hashlib.sha256(x[2].encode()).hexdigest() for i, x in got.items()}


def test_substring_odd_tables(spark):
    long = "w " * 60
    df = spark.createDataFrame([(1, long, "a", 1, "b", 2, "c"), (None, long, "a", 1, "b", 2, "c"), (2, long, None, None, None, None, None), (2, "x", "a", 1, "b", 2, "c"), (3, None, "a", 1, "b", 2, "c")], ODD)
    out = substring.dedup_substrings(df)
    assert out.columns == [*df.columns, "n_words", "n_removed"]
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in out.collect()) == [("1", 60, 0), ("2", 1, 0), ("2", 60, 60), ("3", 0, 0), ("None", 60, 0)]
    assert substring.dedup_substrings(df.limit(0)).count() == 0


def test_hash_kernels():
    words = Words(*buffers(pa.array(["a b  c\n a", "", None, "b a"])))
    assert words.count.tolist() == [4, 0, 0, 2]
    h = words.hash
    assert h[0] == h[3] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 3
    x = np.arange(200, dtype=np.uint64) % np.uint64(7)
    for k in (3, 50):
        g = grams(x, k)
        assert len(g) == 201 - k and g[0] == g[7] and g[0] != g[1]
    v = np.array([5, 3, 9, 1, 7], np.uint64)
    assert sliding_min(v, 3).tolist() == [3, 1, 1] and sliding_min(v, 9).tolist() == []


def test_ids_equal_the_library(tokens):
    r = random.Random(3)
    coder = WordBpe(tokenizer_file())
    pools = ["abcdrstmlve'' .,!0123éÉßœ\t\n<|>…—İ ½ΣK", "aehlnrst'dingoumv ", "".join(map(chr, range(1, 0x180))), "".join(chr(r.randrange(0x20, 0x3000)) for _ in range(400))]
    texts = ["".join(r.choice(p) for _ in range(r.randrange(60))) for p in pools for _ in range(800)]
    texts += ["", None, "'s 's's 'll'RE don't", "x" * 5000, "ab" * 900, "<|startoftext|><|endoftext|>a", "ΑΣ Σ", "x'", "'s"]
    want = [e.ids for e in tokens.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    got = [ids[a:b].tolist() for _, ids, bounds in coder.encode(pa.array(texts, pa.string())) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == want
    for ids in want[:300]:
        assert coder.decode(np.array(ids, np.uint32)).decode() == tokens.decode(ids, skip_special_tokens=False)


def test_lexicon(tmp_path):
    words = sorted({(a + b + "ing").encode() for a in "abcdef" for b in ("ar", "er", "or", "")})
    whole, sizes = compile_lexicon({w: np.arange(k, k + k % 4) for k, w in enumerate(words)})
    (tmp_path / "lexicon").write_bytes(whole)
    found = Lexicon(str(tmp_path / "lexicon")).lookup([*words, b"ing", b"aring ", b"", b"x", b"ar"])
    assert [x.tolist() for x in found[: len(words)]] == [list(range(k, k + k % 4)) for k in range(len(words))]
    assert found[len(words) :] == [None] * 5
    assert sizes["arcs"] < sum(map(len, words)) / 3  # suffixes are shared
    assert len(minimal_automaton([])[0]) == 1
    (tmp_path / "empty").write_bytes(compile_lexicon({})[0])
    assert Lexicon(str(tmp_path / "empty")).lookup([b"a"]) == [None]


def test_coding_job(spark, tokens):
    texts = ["Hello hello hello world", "", None, "hello <|endoftext|> 日本", "world " * 50]
    df = frame(spark, texts).withColumn("IDS", F.lit("clash"))
    name = build_lexicon(df, tokenizer_file(), size=2)
    want = {i: tokens.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    for r in encode(df, tokenizer_file(), name).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id]
        assert bytes(r.decoded).decode() == tokens.decode(want[r.doc_id], skip_special_tokens=False) == decode_ids(r.ids, tokenizer_file())
    for r in digests(df, tokenizer_file(), name).collect():
        assert r.n_tokens == len(want[r.doc_id]) and r.ids_sha256 == hashlib.sha256(np.array(want[r.doc_id], "<u4").tobytes()).hexdigest()
    assert digests(df.limit(0), tokenizer_file(), build_lexicon(df.limit(0), tokenizer_file())).count() == 0


def check_plan(histogram, size):
    plan = packing.plan(histogram, size)
    used = Counter()
    for template, n in plan:
        assert n > 0 and sum(a * b for a, b in template) <= size
        for v, k in template:
            used[v] += k * n
    assert used == Counter({k: v for k, v in histogram.items() if v})
    return sum(n for _, n in plan)


def test_plans():
    r = random.Random(4)
    assert check_plan({}, 4096) == 0 and check_plan({4096: 3}, 4096) == 3 and check_plan({1: 5000}, 4096) == 2
    assert check_plan({3000: 7, 1096: 7}, 4096) == 7
    for scale in (1, 40, 1000):
        h = Counter(min(4096, max(1, int(r.lognormvariate(6, 1)))) for _ in range(3000))
        h = {k: v * scale for k, v in h.items()}
        assert check_plan(h, 4096) <= 1.01 * -(-sum(k * v for k, v in h.items()) // 4096) + 1


def test_packing(spark, tokens):
    r = random.Random(6)
    texts = [text(r, r.choice([1, 20, 300, 900])) for _ in range(60)] + ["", None, text(r, 9000)] + ["same text"] * 40
    rows = packing.pack(frame(spark, texts).withColumn("length", F.lit("clash")), tokenizer_file()).collect()
    own, places = {}, {}
    for x in rows:
        own.setdefault(x.doc_id, {})[x.piece] = x
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for i, t in enumerate(texts):
        ids = [*tokens.encode(t or "", add_special_tokens=False).ids, 1]
        parts = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        assert [(own[i][p].start, own[i][p].length, own[i][p].ids_crc32) for p in range(len(own[i]))] == [(4096 * p, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for p, x in enumerate(parts)]
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 4096
    whole = {x.sequence_id: len(x.ids) // 4 for x in packing.sequences(frame(spark, texts), tokenizer_file()).collect()}
    assert sorted(whole.values()) == sorted(sum(n for _, n in s) for s in places.values())
    assert packing.pack(frame(spark, ["a"]).limit(0), tokenizer_file()).count() == 0


def test_fingerprints(spark):
    r = random.Random(8)
    docs = [text(r, r.randrange(0, 90)) + r.choice(["", " é日"]) for _ in range(80)] + [None, "", "a b c"]
    docs[5] = docs[4]
    df = frame(spark, docs)
    rows = {x.doc_id: x for x in fingerprint.edited_fingerprints(df).collect()}
    whole = [t or "" for t in docs]
    prints = {}
    for i, t in enumerate(whole):
        half, following = len(t) // 2, whole[(i + 1) % len(whole)]
        changed = t[: len(t) - half] + following[:half]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(t, rows[i].fingerprint) == rows[i].fingerprint
        a, b = ({p[k : k + 16] for k in range(0, len(p), 16)} for p in (rows[i].fingerprint, rows[i].edited_fingerprint))
        assert rows[i].near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert not t.split() or rows[i].fingerprint
    assert rows[4].near_next == 1.0
    for n in (1, 7, 40):  # however the table is cut, each finds its neighbour
        got = {x.doc_id: x.following.text for x in fingerprint.with_next(df.withColumn("text", F.coalesce("text", F.lit(""))), n).collect()}
        assert got == {i: whole[(i + 1) % len(whole)] for i in range(len(whole))}


def test_fingerprint_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b", "a", 1, "b", 2, "c"), (None, "a b", "a", 1, "b", 2, "c"), (1, "a b", None, None, None, None, None)], ODD)
    got = fingerprint.edited_fingerprints(df).collect()
    assert sorted(str(x.doc_id) for x in got) == ["1", "1", "None"] and len({x.fingerprint for x in got}) == 1
    assert fingerprint.fingerprints(df, name="own").columns == [*df.columns, "own"]
    assert fingerprint.edited_fingerprints(df.limit(0)).count() == 0


def test_sketches_merge_and_contain(spark):
    r = random.Random(11)
    parts = [text(r, 4000) for _ in range(2)]
    rows = frame(spark, [*parts, f"{parts[0]} {parts[1]}"])
    s = {x.doc_id: set(x.sketch) for x in fingerprint.fingerprints(rows).collect()}
    assert len((s[0] | s[1]) ^ s[2]) <= 4  # but for the shingles over the seam
    assert len(s[0] & s[2]) / len(s[0]) > 0.99
