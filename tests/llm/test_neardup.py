"""Near-dedup and line dedup against brute force, and their edge cases."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quaver.llm import neardup
from quaver.llm.lines import common_blocks, dedup_lines
from quaver.llm.textbuf import slices

WORDS = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "ion", "ur", "est")]


def text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(r, t, n):
    w = t.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "x" + r.choice(WORDS)
    return " ".join(w)


def corpus():
    r = random.Random(5)
    docs = [text(r, r.randrange(30, 200)) for _ in range(60)]
    docs += [docs[3]] * 3 + [edited(r, docs[k], 1) for k in range(20)] + [edited(r, docs[k], 9) for k in range(20, 40)]
    passage = text(r, 60)
    docs += [f"{text(r, 20)} {passage} {text(r, 30)}" for _ in range(40)]
    return docs + ["", "", None, "one", "one", "two words", " two  words "]


def kmers(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, out = defaultdict(int), []
    for g in [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []):
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_classes(docs):
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ks = {i: kmers(t) for i, t in docs.items() if t is not None}
    for i in ks:
        for j in ks:
            if j < i:
                same = docs[i] == docs[j]
                if not same and ks[i] and ks[j] and set(ks[i]) & set(ks[j]):
                    m = lcs(ks[i], ks[j])
                    same = m >= 0.8 * (len(ks[i]) + len(ks[j]) - m) - 1e-9
                if same:
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: find(i) for i in docs}


def test_classes_equal_brute_force(spark):
    docs = dict(enumerate(corpus()))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == brute_classes(docs)
    kept = {r.doc_id for r in neardup.one_of_each(df).collect()}
    assert kept == {i for i, c in got.items() if i == c}


def test_alignment_is_the_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(200):
        a = r.sample(range(60), r.randrange(1, 40))
        b = [x for x in a if r.random() < 0.9] + r.sample(range(60, 80), r.randrange(3))
        if r.random() < 0.3:
            r.shuffle(b)
        want = lcs(a, b) / (len(a) + len(b) - lcs(a, b))
        got = neardup.alignment(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def test_odd_tables(spark):
    schema = "doc_id long, text string, root string, failed int, KEY string"
    rows = [(1, "a b c d e f", "x", 1, "k"), (1, "a b c d e f", "x", 1, "k"), (2, "a b c d e f", None, None, None), (None, "a b c d e f", "x", 1, "k"), (3, None, "x", 1, "k")]
    df = spark.createDataFrame(rows, schema)
    got = sorted((str(r.doc_id), str(r.class_id)) for r in neardup.near_duplicates(df).collect())
    assert got == [("1", "1"), ("1", "1"), ("2", "1"), ("3", "3"), ("None", "None")]
    assert sorted(str(r.doc_id) for r in neardup.one_of_each(df).collect()) == ["1", "3", "None"]
    assert neardup.one_of_each(df).columns == df.columns
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    lines = dedup_lines(df)
    assert lines.count() == 5 and lines.columns == [*df.columns, "n_lines", "n_removed"]
    assert dedup_lines(df.limit(0)).count() == 0


def test_long_text_has_as_many_kmers_as_words():
    long = " ".join(f"w{i}" for i in range(300_000))
    own = [k for words in slices(pa.array([long, "a", None])) for k in neardup.labelled(words)]
    assert [len(k) for k in own] == [299_996, 1, 0]


def patience(a, b, solid):
    """Places in a of the common blocks with b: patience diff written from its description."""

    def match(i, m, j, n):
        head = []
        while i < m and j < n and a[i] == b[j]:
            head.append((i, j))
            i, j = i + 1, j + 1
        tail = []
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            tail.append((m, n))
        both = [x for x in set(a[i:m]) if solid(x) and a[i:m].count(x) == 1 == b[j:n].count(x)]
        spots = sorted((i + a[i:m].index(x), j + b[j:n].index(x)) for x in both)
        if not spots:
            nth = lambda x, low, high: {(v, x[low:k].count(v)): k for k, v in enumerate(x[:high]) if k >= low and solid(v)}
            one, two = nth(a, i, m), nth(b, j, n)
            spots = sorted((one[k], two[k]) for k in one if k in two)
        best = [()]  # of each length the rising run that ends lowest
        for p, q in spots:
            k = max(k for k in range(len(best)) if not best[k] or best[k][-1][1] < q)
            best[k + 1 : k + 2] = [(*best[k], (p, q))]
        mid = []
        if best[-1]:
            edge = [(i - 1, j - 1), *best[-1], (m, n)]
            for (p, q), (r, s) in zip(edge, edge[1:], strict=False):
                mid += match(p + 1, r, q + 1, s)
            mid += best[-1]
        return head + mid + tail

    pairs, out, block = sorted(match(0, len(a), 0, len(b))), set(), []
    for k, (i, j) in enumerate(pairs):
        if k and pairs[k - 1] != (i - 1, j - 1):
            block = []
        block.append(i)
        if k + 1 == len(pairs) or pairs[k + 1] != (i + 1, j + 1):
            out.update(block if any(solid(a[x]) for x in block) else ())
    return out


def brute_lines(docs):
    """The texts that stay: holders of a solid line, or of two lines one of which is solid, are paired
    with the first holder and the one before."""
    held = {i: [h.strip(" \t\r") for h in t.split("\n")] for i, t in docs.items()}
    solid = lambda h: len(h) >= 20
    holders = defaultdict(list)
    for i in sorted(held):
        full = [h for h in held[i] if h]
        seen = {h for h in full if solid(h)}
        seen |= {p for x in (full, held[i]) for p in zip(x, x[1:], strict=False) if solid(p[0]) or solid(p[1])}
        for h in seen:
            holders[h].append(i)
    pairs = {(i, own[0]) for own in holders.values() for i in own[1:]} | {(b, a) for own in holders.values() for a, b in zip(own, own[1:], strict=False)}
    gone = defaultdict(set)
    for i, j in pairs:
        gone[i] |= patience(held[i], held[j], solid)
    return {i: "\n".join(x for k, x in enumerate(docs[i].split("\n")) if k not in gone[i]) for i in docs}


def test_lines_equal_brute_force(spark):
    r = random.Random(9)
    line = [text(r, r.randrange(2, 9)) for _ in range(40)]
    docs = {i: "\n".join(r.choice([*line, text(r, 6), "", "ok"]) for _ in range(r.randrange(1, 12))) for i in range(150)}
    docs |= {200 + i: docs[0] for i in range(70)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    assert got == brute_lines(docs)
    assert got[0] == docs[0] and got[200] == "\n".join(x for x in docs[0].split("\n") if False)


def test_passages_of_many_documents_go(spark):
    r = random.Random(4)
    s1, s2 = text(r, 9), text(r, 9)
    docs = {0: f"{s2}\n{s1}", 1: f"{s1}\nok\n{s2}"} | {i: f"{text(r, 8)}\n{s1}\n{s2}\n{text(r, 8)}" for i in range(2, 100)}
    docs |= {i: f"{text(r, 8)}\n{s1}\nok\n{s2}" for i in range(100, 200)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    for hot in (2048, 16):  # in one range and in several
        got = {r.doc_id: r.text for r in dedup_lines(df, hot=hot).collect()}
        assert got == {i: t if i == 0 else got[1] if i == 1 else "\n".join(x for x in t.split("\n") if x not in (s1, s2, "ok")) for i, t in docs.items()}


def test_lines_against_all_overlapping_pairs(spark):
    r = random.Random(9)
    line = [text(r, r.randrange(2, 9)) for _ in range(40)]
    docs = {i: "\n".join(r.choice([*line, text(r, 6), "", "ok"]) for _ in range(r.randrange(1, 12))) for i in range(250)}
    number = {h: (k << 1) | (len(h) >= 20) for k, h in enumerate(sorted({h for t in docs.values() for h in t.split("\n") if h}), 1)}
    code = {i: [number.get(h, 0) for h in t.split("\n")] for i, t in docs.items()}
    want = {i: {k for j in range(i) for k in common_blocks(code[i], code[j])} for i in docs}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    total = sum(map(len, want.values()))
    got = {r.doc_id: r.n_removed for r in dedup_lines(df).collect()}
    assert all(got[i] <= len(want[i]) for i in docs)
    print("lines of all overlapping pairs", total, "left", total - sum(got.values()))
    assert total - sum(got.values()) < 0.03 * total


def test_line_edges(spark):
    long = "\n".join(f"line number {k} of a very long text" for k in range(20_000))
    same = "the same line in all of these texts"
    rows = [(1, long), (2, long + "\nand a line that is new to all"), (3, same), (3, same + "\nother text of one id"), (4, same), (4, same), (5, ""), (6, "\n\n"), (7, same + "\n" + same)]
    got = sorted((r.doc_id, r.text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, long), (2, "and a line that is new to all"), (3, same), (3, same + "\nother text of one id"), (4, ""), (4, ""), (5, ""), (6, "\n\n"), (7, same)])


def test_blocks():
    a, b, c, short = 3, 5, 7, 2
    assert common_blocks([a, b, c], [a, b, c]) == [0, 1, 2]
    assert common_blocks([9, a, short, b], [a, short, b, 11]) == [1, 2, 3]
    assert common_blocks([short, 9], [short, 11]) == []
    assert common_blocks([a, b], [b, a]) in ([0], [1])
    assert common_blocks([], [a]) == []


def pages_of_a_template(n, planted, seed=3):
    """Texts that share some 78 % of their k-mers with each other, and of some a copy just above 0.8."""
    r = random.Random(seed)
    frame, out = [text(r, 12).split() for _ in range(20)], {}
    own = lambda: [w for part in frame for w in part + ([f"q{r.randrange(10**9)}"] if r.random() < 0.34 else [])]
    for i in range(n):
        out[i] = " ".join(own())
    for i in range(planted):
        w = out[i].split()
        while True:
            v = list(w)
            for _ in range(5):
                v[r.randrange(len(v))] = f"z{r.randrange(10**9)}"
            t = " ".join(v)
            m = lcs_of(out[i], t)
            if 0.8 <= m < 0.87:
                break
        out[n + i] = t
    return out


def lcs_of(a, b):
    x, y = ([k for words in slices(pa.array([t])) for k in neardup.labelled(words)][0] for t in (a, b))
    return neardup.alignment(x, y, 0.5)


def test_links_in_a_crowd(spark):
    """Hundreds of pages just below the similarity, all pairs as the measure: no link is lost."""
    docs = pages_of_a_template(300, 40)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    ks = {i: [k for words in slices(pa.array([t])) for k in neardup.labelled(words)][0] for i, t in docs.items()}
    pairs = [(i, j) for i in docs for j in docs if j < i and neardup.alignment(ks[i], ks[j]) >= 0.8]
    assert all(got[300 + i] == got[i] for i in range(40))
    assert len(pairs) >= 40 and sum(got[i] != got[j] for i, j in pairs) == 0


@pytest.mark.parametrize("similar", [0.6, 0.8, 0.95])
def test_rare_pairs_lose_none(spark, similar):
    """Sequences of numbers of all lengths, in chains and crowds: each similar pair of different components is a
    candidate, and candidates are few."""
    r = random.Random(int(similar * 100))
    docs: dict[int, list[int]] = {}
    for i in range(260):
        if i and r.random() < 0.7:
            own = list(docs[r.randrange(i)])
            for _ in range(max(1, int(len(own) * r.choice([0.02, 0.1, 0.15])))):
                k = r.randrange(len(own))
                own[k : k + 1] = r.choice([[], [r.randrange(10**6)], [r.randrange(10**6), own[k]]])
                own = own or [r.randrange(10**6)]
        else:
            own = [r.randrange(r.choice([300, 10**6])) for _ in range(r.randrange(1, 90))]
        docs[i] = list(dict.fromkeys(own))
    root = {i: r.choice([0, 0, i, i % 7]) for i in docs}
    known = spark.createDataFrame([(i, 0, len(x), x) for i, x in docs.items()], "doc_id long, which long, n int, kmers array<long>")
    names = spark.createDataFrame(list(root.items()), "doc_id long, root long")
    rows = neardup.in_parts(neardup.listed(neardup.prefixes(known, similar), similar).join(names, "doc_id"))
    got = {(x.a, x.b) for x in neardup.rare_pairs(rows, similar).collect()}
    led = {(x.a, x.b) for x in neardup.lead_pairs(rows, similar).collect()}
    assert all(i > j and root[i] != root[j] for i, j in led)
    share = lambda i, j: len(both := set(docs[i]) & set(docs[j])) / (len(docs[i]) + len(docs[j]) - len(both))
    want = {(i, j) for i in docs for j in docs if i > j and root[i] != root[j] and share(i, j) >= similar}
    assert len(want) > 15 and want <= got and all(i > j and root[i] != root[j] for i, j in got)


def test_every_pair_of_a_real_table(spark):
    """All pairs of documents of a small table that share a k-mer, against the classes."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    ks = dict(zip([i for i, _ in rows], [k for words in slices(pa.array([t for _, t in rows])) for k in neardup.labelled(words)], strict=True))
    held = defaultdict(list)
    for i, k in ks.items():
        for x in k.tolist():
            held[x].append(i)
    pairs = {(max(i, j), min(i, j)) for own in held.values() for i in own for j in own if i != j}
    similar = [(i, j) for i, j in pairs if neardup.alignment(ks[i], ks[j]) >= 0.8]
    root = {i: i for i in ks}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in similar:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    alone = {i: find(i) for i in ks if len(ks[i])}
    assert len(similar) > 50 and {i: got[i] for i in alone} == alone
