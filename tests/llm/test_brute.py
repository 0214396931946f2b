"""Operators against plain Python that shares no code with them, on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quaver.llm import fingerprint, images, langid, neardup, packing, quality, substring
from quaver.llm.bpe import build_lexicon, digests
from quaver.llm.common import cut
from quaver.llm.registry import tokenizer_file
from tests.llm.test_neardup import brute_classes, brute_lines
from tests.llm.test_text import brute_removed, text

SF = "/root/testdata/sf0.001"


# --- words that a polynomial hash takes for one ---------------------------------------------------


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [512, 1024, 2048])
def test_different_words_are_different(spark, n):
    from tokenizers import Tokenizer

    a, b = thue_morse(n)
    rest = " ".join(f"w{k}" for k in range(49))
    docs = {0: a, 1: b, 2: f"{a} {rest}", 3: f"{b} {rest}"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.n_removed for r in substring.dedup_substrings(df).collect()} == dict.fromkeys(docs, 0)
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df.where("doc_id < 2")).collect()} == {0: 0, 1: 1}
    library = Tokenizer.from_file(tokenizer_file())
    ids = {i: np.array(library.encode(t, add_special_tokens=False).ids, "<u4") for i, t in docs.items()}
    for lexicon in (None, build_lexicon(df, tokenizer_file())):
        got = {r.doc_id: r.ids_sha256 for r in digests(df, tokenizer_file(), lexicon).collect()}
        assert got == {i: hashlib.sha256(x.tobytes()).hexdigest() for i, x in ids.items()}
    crc = {r.doc_id: r.ids_crc32 for r in packing.token_pieces(df, tokenizer_file()).collect()}
    assert crc == {i: zlib.crc32(np.append(x, 1).astype("<u4").tobytes()) for i, x in ids.items()}


def test_a_word_with_another_words_key_is_merged_by_itself():
    from quaver.llm.wordbpe import WordBpe

    plain, forced = WordBpe(tokenizer_file()), WordBpe(tokenizer_file())
    texts = pa.array(["alpha beta gamma", "beta alpha incomprehensibilities", "gamma gamma " + "x" * 70])
    want = [ids[a:b].tolist() for _, ids, at in plain.encode(texts) for a, b in zip(at[:-1], at[1:], strict=True)]
    import quaver.llm.wordbpe as module

    real = module.folded
    module.folded = lambda own, size, seed: real(own, size, seed) % np.uint64(2)  # all words share two keys
    try:
        got = [ids[a:b].tolist() for _, ids, at in forced.encode(texts) for a, b in zip(at[:-1], at[1:], strict=True)]
    finally:
        module.folded = real
    assert got == want


# --- operator 3 ----------------------------------------------------------------------------------


def trigrams(t):
    b = t.lower().encode()
    return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32) >> 16 for i in range(len(b) - 2)]


def softmax(logs):
    top = max(logs)
    e = [math.exp(x - top) for x in logs]
    return [x / sum(e) for x in e]


def brute_languages(rows, labelled):
    """(lang, confidence) of each (declared, host, domain, suffix, text), every count taken over the other
    rows by a loop."""
    counts = defaultdict(Counter)
    for lang, t in labelled:
        counts[lang].update(trigrams(t))
    langs = sorted(x for x in counts if counts[x])
    size = {x: sum(counts[x].values()) + 0.5 * 2**16 for x in langs}
    loglik = []
    for *_, t in rows:
        tri = trigrams(t)
        n = max(len(tri), 1)
        loglik.append([sum(math.log((counts[x][g] + 0.5) / size[x]) for g in tri) / (1 + (n - 1) / 60) for x in langs])
    post = [softmax(x) for x in loglik]
    kinds = len({r[0] for r in rows} - {None})
    out = []
    for i, row in enumerate(rows):
        others = [j for j in range(len(rows)) if j != i]
        share = [1 / len(langs)] * len(langs)
        for level in (None, 3, 2, 1):
            if level is not None and row[level] is None:
                continue
            own = [j for j in others if level is None or rows[j][level] == row[level]]
            share = [(sum(post[j][k] for j in own) + 5 * share[k]) / (len(own) + 5) for k in range(len(langs))]
        logs = [loglik[i][k] + math.log(share[k]) for k in range(len(langs))]
        if row[0] is not None:
            told = [j for j in others if rows[j][0] is not None]
            for k in range(len(langs)):
                hit = sum(post[j][k] for j in told if rows[j][0] == row[0])
                logs[k] += math.log((hit + 0.5) / (sum(post[j][k] for j in told) + 0.5 * kinds))
        fused = softmax(logs)
        out.append((langs[fused.index(max(fused))], max(fused)))
    return out


def test_languages_equal_brute_force(spark):
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    r = random.Random(1)
    rows = []
    for k in range(70):
        lang, t = docs[r.randrange(len(docs))]
        said = r.choice([None, lang, lang, "fr", "xx"])
        host = r.choice(["a.x.fr", "b.x.fr", "c.de", "d.co.uk", None])
        body = " ".join(t.split()[: r.choice([0, 1, 2, 3, 6, 12, 200])])
        html = (f'<html lang="{said}">' if said else "<html>") + f"<p>{re.sub('[<>&]', ' ', body)}</p></html>"
        rows.append((k, f"http://{host}/{k}" if host else None, html, said, host, body))
    df = spark.createDataFrame([x[:3] for x in rows], "page_id long, url string, html string").repartition(3)
    got = {x.page_id: x for x in langid.identify_pages(df, spark.createDataFrame(docs, "lang string, text string")).collect()}
    part = lambda h, n: ".".join(h.split(".")[-n:]) if h else None
    shown = lambda html: re.sub(r"(?s)<[^>]*>", " ", html)
    want = brute_languages([(said, host, part(host, 2), part(host, 1), shown(html)) for _, _, html, said, host, _ in rows], docs)
    for k, (lang, confidence) in enumerate(want):
        assert got[k].confidence == pytest.approx(confidence, abs=2e-3), k
        assert got[k].lang == lang or confidence < 0.51
    assert len({x.lang for x in got.values()}) > 2


def test_language_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text")
    long = " ".join(r.text for r in docs.where("lang = 'de'").limit(40).collect()) * 20
    pages = spark.createDataFrame([(1, "http://a.de/", f"<p>{long}</p>", "x", "y"), (1, "http://a.de/", f"<p>{long}</p>", "x", "y"), (None, None, None, None, None)], "page_id long, url string, html string, lang string, LOGLIK string")
    got = langid.identify_pages(pages, docs).collect()
    assert sorted(str(r.page_id) for r in got) == ["1", "1", "None"] and {r.lang for r in got if r.page_id} == {"de"}
    tie = langid.identify_pages(spark.createDataFrame([(1, None, "<p></p>")], "page_id long, url string, html string"), spark.createDataFrame([("b", "xyz"), ("a", "xyz")], "lang string, text string"))
    assert tie.first().lang == "a"  # equal evidence: the first name


# --- operator 6 ----------------------------------------------------------------------------------


def drawn(seed, side=64, grid=8):
    return images.resized(np.random.default_rng(seed).uniform(0, 255, (grid, grid)).astype(np.float32), side, side)


def grey(x):
    return images.write_pgm(np.clip(np.ascontiguousarray(x), 0, 255))


def edits(x, r):
    n = len(x)

    def crop(share):
        m = int(n * share)
        a, b = r.integers(0, n - m + 1, 2)
        return x[a : a + m, b : b + m]

    return {
        "crop 90": crop(0.9), "crop 80": crop(0.8), "crop 70": crop(0.7), "crop 60": crop(0.6), "brighter": x * 0.7 + 30, "noise": x + r.normal(0, 6, x.shape), "turn": np.rot90(x),
        "150 %": images.resized(x, n * 3 // 2, n * 3 // 2), "75 %": images.resized(x, n * 3 // 4, n * 3 // 4), "half": images.resized(x, n // 2, n // 2), "patched": np.where(np.add.outer(np.arange(n), np.arange(n)) < n // 2, 9.0, x),
    }


def test_image_recall_by_edit(spark):
    r = np.random.default_rng(3)
    rows, source = [], {}
    for k in range(40):
        x = images.read_pgm(grey(drawn(k)))
        rows.append((k, bytearray(grey(x))))
        for j, (name, y) in enumerate(edits(x, r).items(), 1):
            rows.append((1000 * j + k, bytearray(grey(y))))
            source[1000 * j + k] = (k, name)
    df = spark.createDataFrame(rows, "id long, image binary").repartition(6)
    got = {x.id: x.class_id for x in images.image_copies(df).collect()}
    hit = defaultdict(list)
    for i, (k, name) in source.items():
        hit[name].append(got[i] == got[k])
    recall = {name: float(np.mean(v)) for name, v in hit.items()}
    print("recall by edit", recall)
    assert all(v >= 0.9 for name, v in recall.items() if name != "half") and recall["half"] >= 0.4
    assert all(got[k] == k for k in range(40))  # nothing joins two pictures


def test_unrelated_images_do_not_match():
    found = [x.tobytes() for x in images.corners_of_all([images.read_pgm(grey(drawn(k, 64, 8 + k % 2))) for k in range(150)])]
    votes = [images.matched(found[i], found[j]) for i in range(150) for j in range(i)]
    assert len(votes) > 10_000 and max(votes) < images.VOTES


def test_links_within_a_large_group_of_edits(spark):
    """All pairs by ``matched`` against what the tables bring together: 60 crops of one picture."""
    r = np.random.default_rng(5)
    x = drawn(7, 96, 12)
    crops = []
    for _ in range(60):
        m = int(96 * r.uniform(0.55, 0.95))
        a, b = r.integers(0, 96 - m + 1, 2)
        crops.append(images.read_pgm(grey(x[a : a + m, b : b + m])))
    rows = [(k, bytearray(grey(c))) for k, c in enumerate(crops)] + [(100 + k, bytearray(grey(drawn(50 + k)))) for k in range(20)]
    got = {y.id: y.class_id for y in images.image_copies(spark.createDataFrame(rows, "id long, image binary")).collect()}
    found = [c.tobytes() for c in images.corners_of_all(crops)]
    root = list(range(60))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(60):
        for j in range(i):
            if images.matched(found[i], found[j]) >= images.VOTES:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    same = sum((got[i] == got[j]) == (find(i) == find(j)) for i in range(60) for j in range(i))
    assert same >= 0.95 * 60 * 59 / 2 and all(got[100 + k] == 100 + k for k in range(20))


def test_large_and_flat_pictures(spark):
    big = images.resized(np.random.default_rng(1).uniform(0, 255, (40, 40)).astype(np.float32), 700, 500)
    rows = [(2, bytearray(grey(big))), (1, bytearray(grey(big[100:600, 50:450]))), (3, bytearray(grey(np.full((64, 64), 7.0)))), (4, bytearray(grey(np.full((64, 64), 8.0)))), (3, bytearray(grey(np.full((64, 64), 7.0)))), (5, bytearray(grey(np.zeros((1, 1)))))]
    got = {r.id: r.class_id for r in images.image_copies(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


# --- operator 8 ----------------------------------------------------------------------------------


def test_ordinal_fit_equals_plain_ascent():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 3)).astype(np.float32)
    grade = np.digitize(x @ np.array([1.5, -1, 0.3]) + r.logistic(size=400), [-1, 1])
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def likelihood(p):
        w, t = p[:3], np.array([-np.inf, p[3], p[4], np.inf])
        s = x @ w
        return np.log(sigmoid(t[grade + 1] - s) - sigmoid(t[grade] - s)).mean() - quality.DECAY / 2 * (w @ w)

    p = np.array([0.0, 0, 0, -1, 1])
    for _ in range(1500):
        slope = np.array([(likelihood(p + d) - likelihood(p - d)) / 2e-5 for d in np.eye(5) * 1e-5])
        p = p + 0.8 * slope
    model = quality.fit(x, grade, 1500)
    got = np.concatenate([model.weights, model.thresholds])
    assert np.abs(got - p).max() < 0.05 and likelihood(got.astype(float)) == pytest.approx(likelihood(p), abs=1e-4)


def plain_score(model, t):
    """The model's score of a text, features counted by dictionaries."""
    b, low = t.encode(), t.lower()
    weight = model.weights.astype(float)
    total = 0.0
    tri = Counter((((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32) >> (32 - 11)) for i in range(len(b) - 2))
    for k, n in tri.items():
        total += weight[k] * math.sqrt(n / max(len(b) - 2, 1))
    from quaver.llm.textbuf import Words, buffers

    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    hashes = {w: int(Words(*buffers(pa.array([w]))).hash[0]) % quality.WORDS for w in set(words)}
    place = Counter(hashes[w] for w in words)
    n = max(len(words), 1)
    for k, c in place.items():
        total += weight[quality.TRIGRAMS + k] * math.sqrt(c / n)
    base = quality.TRIGRAMS + quality.WORDS
    total += weight[base] * sum(x == y for x, y in zip(words, words[1:], strict=False)) / n
    if words:
        total += weight[base + 1] * len(place) / min(n, quality.WORDS) + weight[base + 2] * min(math.log1p(len(words)) / 8, 1.5)
    flat = re.sub(r"[\x09-\x0D]", " ", low).encode()
    grams = Counter((int.from_bytes(flat[i : i + 6], "big") * 0x9E3779B97F4A7C15 % 2**64) >> 44 for i in range(len(flat) - 5))
    for k, mark in enumerate(model.marks.tolist()):
        total += weight[base + 3 + k] * min(grams[mark] * quality.FULL * 1000 // max(len(flat), 1), 1000) / 1000
    return total


def fixture(tmp_path, spark):
    r = random.Random(12)
    good = [text(r, r.randrange(20, 200)) for _ in range(120)]
    docs = good[:60] + [f"{g} vile hateful slur {g}" for g in good[60:80]] + ["zz zz " * r.randrange(5, 40) for _ in range(30)]
    block = "\n".join(text(r, 8) for _ in range(3))
    passage = text(r, 70)
    docs += [f"{text(r, 30)}\n{block}\n{text(r, 30)}" for _ in range(12)] + [f"{text(r, 40)} {passage} {text(r, 40)}" for _ in range(12)]
    docs += [docs[3]] * 3 + [docs[4].replace(docs[4].split()[5], "changed")] + [text(r, 2500)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(docs)]
    labels = [(i, 0 if "zz zz" in t else 1, int("slur" in t)) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return dict(enumerate(docs)), {i: q * (2 - t) for i, q, t in labels}


def test_pipeline_equals_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    docs, grades = fixture(tmp_path, spark)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.train(table, spark.createDataFrame(list(grades.items()), "doc_id long, grade int"))
    level = int(np.searchsorted(model.grades, quality.CLEAN)) - 1
    now = {i: t for i, t in docs.items() if plain_score(model, t) >= model.thresholds[level]}
    assert 60 <= len(now) < len(docs)
    got = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, table, str(tmp_path)).collect()}
    assert got == now
    now = brute_lines(now)
    classes = brute_classes(now)
    now = {i: t for i, t in now.items() if classes[i] == i}
    now = {i: x[2] for i, x in brute_removed(now, 50).items()}
    library = Tokenizer.from_file(tokenizer_file())
    want = set()
    for i, t in now.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want |= {(i, p, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for p, k in enumerate(range(0, len(ids), 4096))}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    ends = defaultdict(list)
    for r in rows:
        ends[r.sequence_id].append((r.offset, r.length))
    for spans in ends.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(spans[-1]) <= 4096
    assert len(ends) <= -(-sum(x[2] for x in want) // 4096) + 1


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    fixture(tmp_path, spark)
    r = random.Random(2)
    long = text(r, 30_000)
    schema = "doc_id long, text string, lang string, source string, n_chars long, th string, KEEP string, n_words int, salt_ int"
    base = text(r, 80)
    rows = [(1, base, "en", "s", 1, "a", "b", 1, 2), (1, base, "en", "s", 1, "a", "b", 1, 2), (2, None, None, None, None, None, None, None, None), (3, "", "en", "s", 0, "a", "b", 1, 2), (4, long, "en", "s", 1, "a", "b", 1, 2), (None, base, "en", "s", 1, "a", "b", 1, 2), (5, base, "en", "t", 1, "a", "b", 1, 2)]
    df = spark.createDataFrame(rows, schema)
    want = {"quality": None, "lines": 7, "near": 5, "substrings": 7}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        found = out.collect()
        assert want[name] in (None, len(found)), (name, len(found))
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    pieces = corpus_pipeline.packing(spark, df, str(tmp_path)).collect()
    assert Counter(str(p.doc_id) for p in pieces if p.piece == 0) == {"1": 2, "2": 1, "3": 1, "4": 1, "5": 1, "None": 1}
    assert corpus_pipeline.packing(spark, df.limit(0), str(tmp_path)).count() == 0


# --- operator 10 ---------------------------------------------------------------------------------


def plain_sketch(t, scale=fingerprint.SCALE, k=5):
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    words = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.findall(r"[^\x20\x09-\x0D]+", t)]

    def chained(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64(v.to_bytes(8, "little"), seed=seed).intdigest()
        return signed(seed)

    hashes = {chained(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {chained(words)} if words else set()
    low = {h for h in hashes if h < -(2**63) + 2**64 // scale}
    return sorted(low or ({min(hashes)} if hashes else set()))


def test_sketches_equal_plain_hashing(spark):
    r = random.Random(8)
    docs = [text(r, n) for n in (0, 1, 3, 4, 5, 6, 40, 300, 20_000)] + [None, " \n", "é 日本 x"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.sketch for x in fingerprint.fingerprints(df).collect()}
    assert got == {i: plain_sketch(t or "") for i, t in enumerate(docs)}


def test_no_bucket_is_cut(spark):
    """A crowd of pictures that share a patch: links that no leader of it has, and the same classes whatever is made at a time."""
    r = np.random.default_rng(11)
    patch = drawn(900, 48, 8)

    def scene(k):
        x = drawn(1000 + k, 96, 12)
        x[24:72, 24:72] = patch
        return x

    made = []
    for k in range(14):
        x = scene(k)
        made += [x, x[: 96 - k % 5, k % 3 :] * 0.9 + r.normal(0, 2, x[: 96 - k % 5, k % 3 :].shape)]
    pictures = [images.read_pgm(grey(x)) for x in made]
    df = spark.createDataFrame([(k, bytearray(grey(x))) for k, x in enumerate(made)], "id long, image binary")
    found = cut(images.described(df))
    corners = images.corners_of_all(pictures)
    want, root = set(), list(range(len(made)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    stands = [images.table_entries(c) for c in corners]
    for a in range(len(made)):
        for b in range(a):
            met = [(s, t) for k, s in zip(*stands[a], strict=True) for m, t in zip(*stands[b], strict=True) if k == m]
            if met and images.agreeing(*(np.array(x)[None] for x in zip(*met, strict=True)), 2)[0]:
                want.add((a, b))
                if images.matched(corners[a].tobytes(), corners[b].tobytes()) >= images.VOTES:
                    i, j = sorted((find(a), find(b)))
                    root[j] = i
    for most in (images.MET, 400):
        assert {(x.a, x.b) for x in images.meeting(found, most=most).collect()} == want
    assert len(want) > 28 * 8  # far more than a leader a bucket brings together
    got = {x.id: x.class_id for x in images.image_copies(df).collect()}
    assert got == {k: find(k) for k in range(len(made))}


def test_agreeing_meetings():
    """One pair at a time and many at a time tell the same; a regular pattern agrees with anything."""
    one = np.zeros(300, images.CORNER)
    r = np.random.default_rng(2)
    one["x"], one["y"], one["size"] = r.uniform(0, 200, 300), r.uniform(0, 200, 300), 2.0 ** (r.integers(0, 9, 300) / 3)
    one["angle"] = r.uniform(-np.pi, np.pi, 300)
    two = one.copy()
    two["x"], two["y"], two["angle"] = 210 - one["y"], one["x"], one["angle"] + np.pi / 2
    s, t, other = images.placed(one), images.placed(two), images.placed(r.permutation(two))
    x, y, size, angle = images.places(s)
    assert np.abs(x - one["x"]).max() < 0.01 and np.abs(y - one["y"]).max() < 0.01 and np.abs(np.cos(angle) - np.cos(one["angle"])).max() < 1e-3
    for n in (2, 3, 8):
        assert images.agreeing(s[None, :n], t[None, :n], n)[0] and images.widely(s[:n], t[:n], n)
        assert not images.agreeing(s[None, :n], t[None, :n], n + 1)[0] and not images.widely(s[:n], t[:n], n + 1)
    for k in range(0, 300, 5):
        assert images.agreeing(s[None, k : k + 5], other[None, k : k + 5], 2)[0] == images.widely(s[k : k + 5], other[k : k + 5], 2)
    assert not images.agreeing(s[None, [0, 0]], t[None, [0, 0]], 2)[0]  # two bands of one corner
    pattern = np.repeat(one[:1], 6)
    keys, at = images.table_entries(pattern)
    assert len(keys) == images.TABLES and (at == -1).all()
    assert images.agreeing(at[None, :1], s[None, :1], 2)[0]
