"""Operator 3, language identification by Bayesian evidence fusion.

Four kinds of evidence are fused: the text's likelihood under byte-trigram models, the language that
the markup declares, and a prior of the host, which is smoothed towards its domain's, that towards its
address suffix's, that towards the whole table's. All tables are grouped aggregations: trigram counts
over all labelled texts, and for declarations, suffixes, domains and hosts the expected language counts
under the text evidence alone. A row's own part is taken out of every count before it is used for that
row, and the suffix enters once, through the hierarchy. Rare hosts
borrow strength and frequent ones speak for themselves.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quaver.functions.arrays import let
from quaver.llm.common import cut, light, prepare, small
from quaver.llm.textbuf import buffers

BITS = 16
#: Languages whose tables are in a worker's memory at a time; any number is scored, block by block.
BLOCK = 64
#: Trigrams of a text aren't independent: n of them count as n / (1 + (n - 1) / ENOUGH).
ENOUGH = 60
#: Pseudo-counts that a level of the host hierarchy, a declaration and a suffix get from above.
LEAN, FLOOR = 5.0, 0.5


def trigrams(texts: pa.Array):
    """Yields (first document, hashed trigrams, their documents, rows) of runs of lower-case texts."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    data, offsets = buffers(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (2 << 20), "right")) - 1)
        own, at = data[offsets[i] : offsets[j]].astype(np.uint32), offsets[i : j + 1] - offsets[i]
        doc = np.repeat(np.arange(j - i), np.diff(at))
        if len(own) > 2:
            tri = ((own[:-2] << 16 | own[1:-1] << 8 | own[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
            inside = doc[:-2] == doc[2:]
            yield i, tri[inside].astype(np.int64), doc[:-2][inside], j - i
        else:
            yield i, np.zeros(0, np.int64), np.zeros(0, np.int64), j - i
        i = j


def trigram_counts(labelled: DataFrame) -> DataFrame:
    """lang, feature, n over all rows of labelled (lang, text)."""
    prepare(labelled.sparkSession)

    def told(total):
        for lang, count in total.items():
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(count[at], pa.int64())], ["lang", "feature", "n"])

    @light
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, tri, doc, n in trigrams(batch.column(1)):
                own = np.array(langs[first : first + n], object)
                for lang in {x for x in own if x is not None}:
                    hit = (own == lang)[doc]
                    total[lang] = total.get(lang, 0) + np.bincount(tri[hit], minlength=1 << BITS)
                    if len(total) > BLOCK:
                        yield from told(total)
                        total.clear()
        yield from told(total)

    return labelled.select("lang", "text").mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, block: int = BLOCK) -> tuple[list[str], list]:
    """All languages that have a trigram, in order of name, and their log shares of each trigram as
    broadcast tables of at most ``block`` languages, one of which is at the driver at a time."""
    counts = cut(trigram_counts(labelled))
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    blocks = []
    for own in [langs[k : k + block] for k in range(0, len(langs), block)] or [[]]:
        table = np.full((1 << BITS, max(1, len(own))), 0.5)
        if own:
            packed = counts.where(F.col("lang").isin(own)).groupBy("lang").agg(F.collect_list("feature").alias("f"), F.collect_list("n").alias("n"))
            for r in packed.toLocalIterator():
                table[r.f, own.index(r.lang)] += r.n
        blocks.append(labelled.sparkSession.sparkContext.broadcast(np.log(table / table.sum(axis=0)).astype(np.float32)))
    return langs, blocks


def text_evidence(rows: DataFrame, model: tuple[list[str], list], text: str = "text") -> DataFrame:
    """rows without the text, with ``loglik`` (array<double> by language, 0 for an empty text).
    Beyond one block of languages the rows are written between one block and the next."""
    prepare(rows.sparkSession)
    rest = [c for c in rows.columns if c not in (text, "loglik")]
    rows = rows.select(*rest, text)
    for k, shared in enumerate(model[1]):
        rows = _scored(cut(rows) if k else rows, rest, text, shared, k + 1 == len(model[1]))
    return rows


def _scored(rows: DataFrame, rest: list[str], text: str, shared, last: bool) -> DataFrame:
    """rows (rest, text, loglik if there is one) with a block's languages added to loglik; without the
    text if it is the last block."""
    names = rest if last else [*rest, text]
    more = "loglik" in rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema) + ", loglik array<double>"
    schema = schema.removeprefix(", ")

    @light
    def run(batches):
        table = shared.value
        for batch in batches:
            out = []
            for _, tri, doc, n in trigrams(batch.column(len(rest))):
                score = np.stack([np.bincount(doc, weights=table[tri, k], minlength=n) for k in range(table.shape[1])], axis=1)
                many = np.maximum(np.bincount(doc, minlength=n), 1)[:, None]
                out.append(score / (1 + (many - 1) / ENOUGH))
            all_ = np.concatenate([np.zeros((0, table.shape[1])), *out])
            if more and len(all_):
                all_ = np.concatenate([batch.column(len(rest) + 1).flatten().to_numpy(zero_copy_only=False).reshape(len(all_), -1), all_], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(all_) + 1) * all_.shape[1], pa.int32()), pa.array(all_.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], lists], [*names, "loglik"])

    return rows.mapInArrow(run, schema)


def softmax(logs: Column) -> Column:
    raised = let(logs, lambda v: F.transform(v, lambda x: F.exp(x - F.array_max(v))))
    return let(raised, lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, y: a + y)))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + F.coalesce(y, F.lit(0.0)))


def logs(a: Column) -> Column:
    return F.transform(a, lambda x: F.log(x))


def expected(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """keys, the text posteriors of their rows added up by language (n of them) as ``name``, and the
    number of rows as ``name``_n."""
    parts = [F.sum(F.get("post", k)).alias(f"s{k}") for k in range(n)]
    rows = rows.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_n"), *parts)
    return rows.select(*keys, F.array(*[f"s{k}" for k in range(n)]).alias(name), f"{name}_n")


def smoothed(own: Column, n: Column, above: Column, lean: float = LEAN) -> Column:
    """Shares of the counts ``own`` (n in all) after ``lean`` pseudo-counts in the shares ``above``."""
    return F.zip_with(own, above, lambda x, y: (x + F.lit(lean) * y) / (n + F.lit(lean)))


def address(url: Column) -> list[Column]:
    """host, domain (its last two labels) and suffix (the last) of a URL, lower case; null without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    domain = F.when(host.isNotNull(), F.substring_index(host, ".", -2))
    return [host.alias("host"), domain.alias("domain"), F.substring_index(host, ".", -1).alias("suffix")]


_I = re.IGNORECASE | re.ASCII
_OPEN = re.compile(r"<(script|style)\b|<!--", _I)
_CLOSE = {"script": re.compile(r"</script\s*>", _I), "style": re.compile(r"</style\s*>", _I), "": re.compile("-->")}
_TAG, _ENTITY = re.compile(r"<[^>]*>"), re.compile(r"&(amp|lt|gt|quot|nbsp|#[0-9]+);")
_HTML = re.compile(r"<html\b", _I)
_LANG = re.compile(r"""\blang\s*=\s*["']?([a-z]{2,3})""", _I)


def declared_language(html: str) -> str | None:
    """The primary subtag of an html element's lang attribute, lower case; None without one. Linear: what
    lies before a closing mark is looked through once, however many elements begin there."""
    at = 0
    while m := _HTML.search(html, at):
        end = html.find(">", m.end())
        end = len(html) if end < 0 else end
        if found := _LANG.search(html, m.end(), end):
            return found[1].lower()
        at = end
    return None


def visible_text(html: str) -> str:
    """Markup, scripts, styles and comments gone, the common entities undone. What isn't closed stays.

    Linear in the page: a kind of element that was once found to be closed nowhere isn't looked for again, and
    behind the last closing mark there is no tag."""
    parts, kept, at, open_ended = [], 0, 0, set()
    while m := _OPEN.search(html, at):
        kind = (m[1] or "").lower()
        end = None if kind in open_ended else _CLOSE[kind].search(html, m.end())
        if end is None:
            open_ended.add(kind)
            at = m.start() + 1
            continue
        parts += [html[kept : m.start()], " "]
        kept = at = end.end()
    whole = "".join([*parts, html[kept:]])
    last = whole.rfind(">") + 1
    return _ENTITY.sub(" ", _TAG.sub(" ", whole[:last]) + whole[last:])


def markup(html: Column) -> Column:
    """A struct of ``declared`` and ``text`` of a page; a null page declares nothing and is empty."""

    def run(pages: pd.Series) -> pd.DataFrame:
        own = ["" if x is None else x for x in pages]
        return pd.DataFrame({"declared": [declared_language(x) for x in own], "text": [visible_text(x) for x in own]})

    return pandas_udf(run, "declared string, text string")(html)


def fuse(rows: DataFrame, langs: list[str], columns: list[str]) -> DataFrame:
    """columns, lang, confidence, text_lang of each of rows.

    rows has loglik, declared, suffix, domain and host; any of the four may be null, which is no
    evidence. With no languages lang and text_lang are null and the confidence 0. Ties go to the
    language whose name is first.
    """
    n = len(langs)
    if not n:
        none = F.lit(None).cast("string")
        return rows.select(*columns, none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"))
    rows = cut(rows.withColumn("post", softmax(F.col("loglik"))))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("post", k)).alias(f"s{k}") for k in range(n)], F.count("declared").alias("declared_n"), *[F.sum(F.when(F.col("declared").isNotNull(), F.get("post", k))).alias(f"d{k}") for k in range(n)]).first()
    numbers = lambda c: F.array(*[F.lit(float(whole[f"{c}{k}"] or 0.0)) for k in range(n)])

    levels = [("suffix", ["suffix"]), ("domain", ["suffix", "domain"]), ("host", ["suffix", "domain", "host"])]
    said = cut(expected(rows, ["declared"], n, "declared_sums"))
    kinds = said.count()
    out = rows
    for name, keys in levels:
        out = out.join(small(cut(expected(rows, keys, n, f"{name}_sums").drop(*keys[:-1])), 64 + 8 * n), name, "left")
    out = out.join(small(said, 64 + 8 * n), "declared", "left")

    zero = F.array(*[F.lit(0.0)] * n)
    less = lambda sums: F.zip_with(F.coalesce(sums, zero), "post", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    out = out.withColumn("prior", smoothed(less(numbers("s")), F.lit(float(whole.n - 1)), F.array(*[F.lit(1.0 / n)] * n)))
    for name, _ in levels:  # without a key there is no row to take out, and the prior stays
        more = smoothed(less(F.col(f"{name}_sums")), F.col(f"{name}_sums_n") - 1.0, F.col("prior"))
        out = out.withColumn("prior", F.when(F.col(f"{name}_sums").isNull(), F.col("prior")).otherwise(more))
    # P(declared | language): shares of the declared values within each language.
    given = F.zip_with(less(F.col("declared_sums")), less(numbers("d")), lambda x, y: F.log((x + F.lit(FLOOR)) / (y + F.lit(FLOOR * max(kinds, 1)))))
    total = added(added(F.col("loglik"), logs(F.col("prior"))), F.when(F.col("declared_sums").isNotNull(), given).otherwise(zero))
    names = F.array(*[F.lit(x) for x in langs])
    out = out.withColumn("fused", softmax(total))
    best = lambda c: F.get(names, (F.array_position(F.col(c), F.array_max(c)) - 1).cast("int"))
    return out.select(*columns, best("fused").alias("lang"), F.array_max("fused").alias("confidence"), best("post").alias("text_lang"))


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, lang, confidence, text_lang of pages (page_id, url, html), by models of labelled
    (lang, text); rows of labelled without a language or a text don't count."""
    langs, tables = train(labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    rows = pages.select("page_id", *address(F.col("url")), markup(F.col("html")).alias("own")).select("page_id", "own.declared", "host", "domain", "suffix", "own.text")
    return fuse(text_evidence(rows, (langs, tables)), langs, ["page_id"])


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, doc_id, lang, confidence, text_lang: a row for each page and each document.

    The models are of all documents with a language. A document declares nothing and has no
    address; its source stands for the host. Null texts and html are empty; repeated rows are kept.
    """
    langs, tables = train(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    none = F.lit(None).cast("string")
    page_rows = pages.select("page_id", *address(F.col("url")), markup(F.col("html")).alias("own"))
    page_rows = page_rows.select("page_id", F.lit(None).cast("long").alias("doc_id"), "own.declared", "host", "domain", "suffix", "own.text")
    source = F.concat(F.lit("source:"), F.col("source"))
    doc_rows = docs.select(F.lit(None).cast("long").alias("page_id"), "doc_id", none.alias("declared"), source.alias("host"), source.alias("domain"), F.lit("source:").alias("suffix"), "text")
    both = text_evidence(page_rows.unionByName(doc_rows), (langs, tables))
    return fuse(both, langs, ["page_id", "doc_id"])
