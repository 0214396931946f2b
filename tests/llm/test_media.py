"""Language, quality, archives, images and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaver.llm import images, langid, quality, warc
from quaver.llm.common import components, cut, extended

SF = "/root/testdata/sf0.001"


def test_components(spark):
    r = random.Random(0)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1), (200, 200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_archives(spark, tmp_path):
    long = "<p>" + "x" * 200
    pages = [(5, "http://a", long, 1), (2, "http://b\nc", long, 1), (9, None, long, None), (3, "u", "short", 1), (4, "u", "short", 1), (6, "u", None, 1), (7, "u", "é" * 60, 1), (8, "u", "é" * 60, 1), (None, "u", long, 1), (9, None, long, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload int")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.archived(df, f"file://{tmp_path}/w").collect()}
    first = {hashlib.sha256(x.encode()).hexdigest(): k for x, k in ((long, 2), ("é" * 60, 7))}
    want = set()
    for page, _, html, _ in pages:
        raw = (html or "").encode()
        sha = hashlib.sha256(raw).hexdigest()
        again = len(raw) >= 100 and page is not None and page > first[sha]
        want.add((page, "revisit" if again else "response", first[sha] if again else None, len(raw), sha))
    assert got == want
    index = warc.write_archives(df, f"file://{tmp_path}/v")
    one = warc.read_records(index.where("page_id = 7")).collect()
    assert [bytes(r.payload).decode() for r in one] == ["é" * 60]
    import gzip

    ids = []
    for file in {r.file for r in index.collect()}:
        whole = gzip.decompress(open(file.removeprefix("file://"), "rb").read())
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        ids += re.findall(rb"WARC-Record-ID: (\S+)", whole)
    assert len(ids) == len(set(ids)) > len(pages)
    assert warc.archived(df.limit(0)).count() == 0


def test_large_archives(spark, tmp_path, monkeypatch):
    """Payloads beyond a byte range, archives that roll over, and many selected at once."""
    monkeypatch.setattr(warc, "ROLL", 300_000)
    r = random.Random(4)
    html = {k: "".join(r.choice("abcdefgh<> ") for _ in range(40_000)) for k in range(30)} | {99: "x" + "".join(map(str, range(1_500_000)))}
    df = spark.createDataFrame(list(html.items()), "page_id long, html string").withColumn("url", F.lit("u")).repartition(2)
    index = warc.write_archives(df, f"file://{tmp_path}/w")
    assert index.select("file").distinct().count() > 2
    got = {x.page_id: bytes(x.payload).decode() for x in warc.read_records(index.where("page_id % 3 = 0")).collect()}
    assert got == {k: v for k, v in html.items() if k % 3 == 0}


def test_ranges():
    assert list(warc.ranges([(0, 10), (10, 5), (10**6, 7)])) == [(0, 15, [0, 1]), (10**6, 10**6 + 7, [2])]
    assert list(warc.ranges([])) == []
    big = [(k * warc.RANGE // 2, warc.RANGE // 2) for k in range(5)]
    assert [own for _, _, own in warc.ranges(big)] == [[0, 1], [2, 3], [4]]


def test_ordinal_fit():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 6)).astype(np.float32)
    score = x @ np.array([2, -1, 0, 0, 0, 0.5]) + r.logistic(size=3000) * 0.3
    grade = np.digitize(score, [-1, 1.5])
    model = quality.fit(x[:2000], grade[:2000])
    tails = model.tails(x[2000:])
    assert (np.diff(model.thresholds) > 0).all() and (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails >= 0.5).sum(axis=1) == grade[2000:]).mean() > 0.85
    alone = quality.fit(x[:5], np.ones(5, int))
    assert alone.tails(x[:5]).shape == (5, 0)


def test_quality_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rated = quality.ratings_of(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    model = quality.train(docs, rated.where("doc_id % 2 = 0"))
    out = quality.grade_documents(docs, model).join(rated.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([r.keep == (r.grade >= 1) for r in out]) > 0.95
    assert np.mean([abs(r.expected_grade - r.grade) < 0.6 for r in out]) > 0.8


def test_toxic_documents_go(spark, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from quaver.llm import registry

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    real = quality.train
    held = lambda docs, ratings: real(docs, ratings.where("doc_id % 2 = 0"))
    monkeypatch.setattr(quality, "train", held)
    monkeypatch.setattr(corpus_pipeline, "train", held)
    kept = {r.doc_id for r in registry.op8_quality_classifier(spark, sf).where("keep").select("doc_id").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    staged = {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf).select("doc_id").collect()}
    rows = labels.where("doc_id % 2 = 1").join(docs.select("doc_id").distinct(), "doc_id").collect()
    toxic, clean = [r.doc_id for r in rows if r.quality and r.toxic], [r.doc_id for r in rows if r.quality and not r.toxic]
    for got in (kept, staged):
        assert np.mean([d in got for d in toxic]) < 0.1
        assert np.mean([d in got for d in clean]) > 0.9


def test_keep_of_grades_that_no_rating_has(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    w = np.zeros(quality.WIDTH, np.float32)
    for grades, want in (([0, 1], False), ([2, 3], True)):
        model = quality.Ordinal(w, np.array([9.0 if want else -9.0]), np.array(grades))
        assert [r.keep for r in quality.grade_documents(df, model, quality.CLEAN).collect()] == [want] * 2


def test_quality_odd_tables(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, None, "x"), (None, "", None)], "doc_id long, text string, KEEP string")
    none = quality.train(df, spark.createDataFrame([], "doc_id long, grade int"))
    out = quality.grade_documents(df, none)
    assert out.columns == ["doc_id", "text", "expected_grade", "p_tail", "keep"] and all(r.keep for r in out.collect())
    some = quality.train(df, spark.createDataFrame([(1, 0), (1, 2), (7, None)], "doc_id long, grade int"))
    assert len(some.thresholds) == 0
    assert quality.grade_documents(df.limit(0), none).count() == 0
    assert next(quality.features(pa.array(["x" * 3_000_000])))[1].shape == (1, quality.WIDTH)


def test_languages(spark):
    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages"))
    rows = langid.identify(pages, docs).collect()
    real = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([real[r.doc_id] == r.lang for r in rows if r.doc_id is not None]) > 0.97
    held = langid.identify_pages(docs.where("doc_id % 2 = 1").select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html")), docs.where("doc_id % 2 = 0"))
    assert np.mean([real[r.page_id] == r.lang for r in held.collect()]) > 0.97


def test_evidence_other_than_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fr = docs.where("lang = 'fr'").first().text
    pages = [(k, f"http://h.x.fr/{k}", f'<html lang="fr"><p>{fr}</p>') for k in range(30)] + [(99, "http://h.x.fr/z", '<html lang="fr"></html>'), (98, None, None), (97, "not a url", "<p></p>"), (99, "http://h.x.fr/z", '<html lang="fr"></html>')]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.identify_pages(df, docs).collect()}
    assert got[99].lang == "fr" and got[99].confidence > 0.9 and len(got) == 33
    empty = langid.identify_pages(df, docs.limit(0)).collect()
    assert len(empty) == 34 and all(r.lang is None for r in empty)
    assert langid.identify_pages(df.limit(0), docs).count() == 0


def test_no_language_is_left_out(spark):
    r = random.Random(3)
    letters = [a + b for a in "bcdfghjklm" for b in "aeiouyw"]
    said = lambda k: " ".join("".join(r.choice(letters[k : k + 1] + ["q" + letters[k][0]]) for _ in range(4)) for _ in range(30))
    rows = [(f"l{k:02}", said(k)) for k in range(70) for _ in range(3 if k < 66 else 1)]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    pages = spark.createDataFrame([(k, None, said(k)) for k in range(70)], "page_id long, url string, html string")
    got = {x.page_id: x for x in langid.identify_pages(pages, labelled).collect()}
    assert [got[k].text_lang for k in range(70)] == [f"l{k:02}" for k in range(70)]
    assert all(got[k].lang == f"l{k:02}" for k in range(66, 70))


def drawn(seed):
    r = np.random.default_rng(seed)
    return images.resized(r.uniform(0, 255, (9, 9)), 72, 72)


def test_image_copies(spark):
    whole = [drawn(k) for k in range(12)]
    pgm = lambda x: bytearray(images.write_pgm(np.clip(x, 0, 255)))
    rows = [(k, pgm(x)) for k, x in enumerate(whole)]
    rows += [(20, pgm(whole[0])), (21, pgm(whole[1][6:66, 4:70])), (22, pgm(whole[2] * 0.7 + 30)), (23, pgm(np.rot90(whole[3]))), (24, pgm(images.resized(whole[4], 54, 54))), (25, None), (26, bytearray(b"no image")), (27, bytearray(b"no image")), (None, pgm(whole[0]))]
    df = spark.createDataFrame(rows, "id long, image binary").withColumn("node", F.lit(1)).repartition(3)
    got = {r.id: r.class_id for r in images.image_copies(df).collect()}
    want = {k: k for k in range(12)} | {20: 0, 21: 1, 22: 2, 23: 3, 24: 4, 25: 25, 26: 26, 27: 26, None: None}
    assert got == want
    assert images.image_copies(df.limit(0)).count() == 0


def test_pgm():
    x = np.arange(12.0).reshape(3, 4)
    assert (images.read_pgm(images.write_pgm(x)) == x).all()
    for bad in (None, b"", b"P5", b"P5 4 3 255\nxx", b"P5 a b 255\n", b"P5\n# only a comment"):
        assert images.read_pgm(bad).size == 0


def test_rendered(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 3.0, 9.0]), (2, []), (3, None), (4, [None, 1.0, 1.0, None])], "id long, values array<double>")
    got = {r.id: r.image for r in images.rendered(df, 8).collect()}
    assert got[2] is None and got[3] is None and images.read_pgm(bytes(got[1])).max() == 255 and images.read_pgm(bytes(got[4])).shape == (8, 8)


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns, name
        before = {r.doc_id for r in now.select("doc_id").collect()}
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before and (name in ("quality", "near") or after == before)
        now = out
    ids = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    assert ids == after


def textured(seed, h, w):
    """A picture with detail at every scale."""
    r = np.random.default_rng(seed)
    out = np.zeros((h, w), np.float32)
    for n in (8, 16, 32, 64, 128):
        out += images.resized(r.normal(size=(n, n)).astype(np.float32), h, w) / n**0.5
    return (out - out.min()) / (out.max() - out.min()) * 255


def turned(x, degrees):
    h, w = x.shape
    ys, xs = np.mgrid[0:h, 0:w].astype(np.float32)
    a = np.radians(degrees)
    dy, dx = ys - h / 2, xs - w / 2
    return images.bilinear(x, np.cos(a) * dy - np.sin(a) * dx + h / 2, np.sin(a) * dy + np.cos(a) * dx + w / 2)


def test_pictures_larger_than_a_thumbnail(spark):
    """Two megapixels: copies of other sizes, crops and turns are found, unrelated ones aren't, in bounded time."""
    import time

    one, two = textured(1, 1200, 1600), textured(2, 1200, 1600)
    copies = [images.resized(one, 600, 800), images.resized(images.blur(one), 150, 200), one[200:1000, 300:1400], turned(one, 40)[200:1000, 300:1300], images.read_pgm(images.write_pgm(one * 0.8 + 20))]
    made = [one, two, *copies]
    described = images.corners_of_all(made)
    assert max(map(len, described)) < 3000
    began = time.process_time()
    votes = [images.matched(described[0].tobytes(), x.tobytes()) for x in described[1:]]
    assert time.process_time() - began < 15
    assert votes[0] == 0 and min(votes[1:]) >= images.VOTES
    df = spark.createDataFrame([(i, bytearray(images.write_pgm(x))) for i, x in enumerate(made)], "id long, image binary")
    assert {r.id: r.class_id for r in images.image_copies(df).collect()} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0}
    whole = {r.id: r.class_id for r in images.image_copies(df, few=100, meetings=1).collect()}
    assert whole == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0}
    assert images.reduced(np.zeros((3, 4000), np.float32)).shape == (1, 256) and images.reduced(one).shape == (192, 256)


def test_extended_components(spark):
    """Roots that links come to are those of all edges at once, whatever is new in them."""
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(200, 201)]
    more = [(int(a), int(b)) for a, b in rng.integers(30, 90, (20, 2))] + [(7, 7), (200, 199), (None, 3)]
    make = lambda rows: spark.createDataFrame(rows, "a long, b long")
    roots = components(make(edges))
    got = {(x.node, x.root) for x in extended(roots, make(more)).collect()}
    assert got == {(x.node, x.root) for x in components(make(edges + more)).collect()}
    assert {(x.node, x.root) for x in extended(roots, make([])).collect()} == {(x.node, x.root) for x in roots.collect()}
    assert components(make([])).count() == 0


def test_crowd_of_one_class_does_not_meet(spark):
    """Images of one class aren't joined with each other again; every agreeing pair of two classes is found."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 256, (8, 8)).astype(np.float32)
    drawn = [images.resized(np.clip(base + rng.normal(0, 1, (8, 8)), 0, 255).astype(np.float32), 64, 64) for _ in range(30)]
    drawn += [images.resized(rng.integers(0, 256, (8, 8)).astype(np.float32), 64, 64) for _ in range(200)]
    raw = [c.tobytes() for c in images.corners_of_all([images.read_pgm(images.write_pgm(x)) for x in drawn])]
    found = spark.createDataFrame(list(enumerate(raw)), "id long, corners binary")
    held = images.shared(found)
    first = images.led(held)
    pairs = [(x.a, x.b) for x in first.collect()]
    assert len({a for a, _ in pairs}) == len(pairs) and all(b < a for a, b in pairs)
    roots = components(images.verified(first, found, images.VOTES))
    root = {x.node: x.root for x in roots.collect()}
    assert len({root.get(k, k) for k in range(30)}) == 1
    every = {(x.a, x.b, x.n) for x in images.meeting(found).collect()}
    assert sum(a < 30 for a, _, _ in every) > 400
    want = {x for x in every if root.get(x[0], x[0]) != root.get(x[1], x[1])}
    assert want
    for most in (images.MET, 20):
        assert {(x.a, x.b, x.n) for x in images.meeting(found, most=most, held=held, roots=roots).collect()} == want


def test_what_many_classes_share_brings_nobody_together(spark):
    """Of a table in which all images have two corners that agree, pairs that also share a rarer corner are candidates, and pairs
    that share most of several such sets; their number grows with the table and not with its square."""
    rng = np.random.default_rng(21)

    def corner(n):
        out = np.zeros(n, images.CORNER)
        out["x"], out["y"], out["size"] = rng.uniform(0, 64, n), rng.uniform(0, 64, n), 1
        out["bits"] = rng.integers(0, 256, (n, images.BITS // 8))
        return out

    everywhere, rare, motif = corner(1), corner(1), corner(12)
    made = [np.concatenate([everywhere, corner(5)]) for _ in range(160)]
    for k in (3, 90):
        made[k] = np.concatenate([made[k], rare])  # with the one that all have: two that agree
    for k in range(70):
        made.append(np.concatenate([rng.permutation(motif)[:11], corner(5)]))
    found = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(made)], "id long, corners binary")
    held = cut(images.shared(found))
    got = {(x.a, x.b) for x in images.meeting(found, held=held).collect()}
    crowd = {(a, b) for a in range(160, 230) for b in range(160, a)}
    assert got == {(90, 3)} | crowd
    every = {(x.a, x.b) for x in images.meeting(found, held=held, wide=None).collect()}
    assert every == got
    assert {(x.a, x.b) for x in images.meeting(found, held=held, wide=4, most=500).collect()} == got
    one = {(x.a, x.b) for x in images.meeting(found, 1, held=held, wide=None).collect()}
    assert len(one) == 160 * 159 // 2 + 70 * 69 // 2 and one > got
    twos = [corner(2) for _ in range(20)]  # chance: an image has four of twenty pairs of corners that a hundred others have too
    made = [np.concatenate([*(twos[j] for j in rng.permutation(20)[:4]), corner(2)]) for _ in range(400)]
    found = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(made)], "id long, corners binary")
    held = cut(images.shared(found))
    every, got = ({(x.a, x.b) for x in images.meeting(found, held=held, **how).collect()} for how in ({"wide": None}, {}))
    assert got < every and len(every) > 40_000 and len(got) < len(every) / 2
    alike = [(a, b) for a, b in every if len(set(map(bytes, made[a]["bits"])) & set(map(bytes, made[b]["bits"]))) >= 6]
    assert len(alike) > 500 and len(got & set(alike)) > 0.97 * len(alike)


def test_sketches_of_wide_keys():
    rng = np.random.default_rng(4)
    keys, at = rng.integers(-(2**62), 2**62, 40), np.arange(40) // 2
    assert (images.sketches(keys, at) == images.sketches(np.append(keys[::-1], keys[:3]), np.append(at[::-1], at[:3]))).all()
    assert len(images.sketches(keys[:2], at[:2])) == len(images.sketches(keys[:0], at[:0])) == 0 and len(images.sketches(keys[:4], at[:4])) > 0
    some = lambda: rng.permutation(20)[:16] * 2
    met = [len(np.intersect1d(*(images.sketches(keys[k], at[k]) for k in (some(), some())))) > 0 for _ in range(300)]
    assert np.mean(met) > 0.97  # two that share two thirds of what either has


def test_pairs_matched_together():
    """Pairs of pictures that are told together are told as each alone."""
    rng = np.random.default_rng(3)
    base = [images.resized(rng.integers(0, 256, (8, 8)).astype(np.float32), 64, 64) for _ in range(4)]
    drawn = [x + rng.normal(0, 3, x.shape).astype(np.float32) for x in base for _ in range(4)] + [base[0][:40, :40], np.zeros((64, 64), np.float32), np.zeros((5, 5), np.float32)]
    raw = [c.tobytes() for c in images.corners_of_all(drawn)]
    a, b = zip(*((x, y) for x in raw for y in raw), strict=True)
    for least in (2, images.VOTES):
        got = images.matched_all(list(a), list(b), least=least)
        assert got.tolist() == [images.matched(x, y, least=least) for x, y in zip(a, b, strict=True)]
        assert (got >= images.VOTES).sum() >= 64


def test_image_copies_try_all_that_share_keys(spark, monkeypatch):
    """Chance pairs: an image has four of twenty pairs of corners that a hundred others have too. All of them are tried."""
    rng = np.random.default_rng(22)

    def corner(n):
        out = np.zeros(n, images.CORNER)
        out["x"], out["y"], out["size"] = rng.uniform(0, 64, n), rng.uniform(0, 64, n), 1
        out["bits"] = rng.integers(0, 256, (n, images.BITS // 8))
        return out

    twos = [corner(2) for _ in range(20)]
    own = [rng.permutation(20)[:4] for _ in range(360)]
    made = [np.concatenate([*(twos[j] for j in four), corner(2)]) for four in own]
    found = cut(spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(made)], "id long, corners binary"))
    tried = set()

    def none_matches(pairs, *_):
        tried.update((max(x.a, x.b), min(x.a, x.b)) for x in pairs.select("a", "b").collect())
        return pairs.select("a", "b").where(F.lit(False))

    monkeypatch.setattr(images, "described", lambda _: found)
    monkeypatch.setattr(images, "verified", none_matches)
    df = spark.createDataFrame([(k, b"%d" % k) for k in range(len(made))], "id long, image binary")
    assert {x.class_id for x in images.image_copies(df).collect()} == set(range(len(made)))
    assert tried == {(a, b) for a in range(len(made)) for b in range(a) if set(own[a]) & set(own[b])}
