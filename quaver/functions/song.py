"""A song's words as one array column: edits whose rule is an expression of a word and its place.

They do to an array what the edits of ``operators.edit`` do to a table of words, a row at a time: no join, no window
and no exchange. A rule takes a word and its place (from 0). A word is a struct of reading and t, but
in ``merged`` and ``segmented`` that of ``functions.word``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaver.functions import text as T
from quaver.functions import word as W
from quaver.functions.arrays import let
from quaver.functions.timecode import BLANK

Rule = Callable[[Column, Column], Column]


def words(text: Column, t: Callable[[Column], Column]) -> Column:
    """The words of a plain text, each ending in a newline word, with times of their places."""
    return F.transform(T.closed(T.tokens(text)), lambda x, i: W.syllable(x, t(i)))


def _edited(w: Column, text: Column) -> Column:
    new = F.coalesce(F.regexp_replace(text, BLANK, ""), F.lit(""))
    return let(new, lambda x: F.when(x == "", w).otherwise(W.syllable(x)))


def retexted(own: Column, text: Rule) -> Column:
    """Text edits, null for none: white space goes, empty ones change nothing, an edited word's time is unset."""
    return F.transform(own, lambda w, i: let(text(w, i), lambda x: F.when(x.isNull(), w).otherwise(_edited(w, x))))


def tabbed(own: Column, text: Rule) -> Column:
    """Text edits, null for none, finished with the tab key: a space word after each."""
    space = W.syllable(F.lit(" "))
    return F.flatten(F.transform(own, lambda w, i: let(text(w, i), lambda x: F.when(x.isNull(), F.array(w)).otherwise(F.array(_edited(w, x), space)))))


def split_in_two(own: Column, which: Rule, left: Rule) -> Column:
    """Each word that meets which as left and the rest; a left that isn't a true beginning splits at the middle, the longer
    half first. A word of one character stays."""

    def parts(w: Column, start: Column) -> Column:
        n = F.length(w["reading"])
        fits = start.isNotNull() & (F.length(start) > 0) & (F.length(start) < n) & w["reading"].startswith(start)
        cut = F.when(fits, F.length(start)).otherwise(F.ceil(n / 2).cast("int"))
        return let(cut, lambda c: F.array(W.syllable(F.substring(w["reading"], F.lit(1), c), w["t"]), W.syllable(F.substring(w["reading"], c + 1, n))))

    hit = lambda w, i: F.coalesce(which(w, i), F.lit(False)) & (F.length(w["reading"]) > 1)
    return F.flatten(F.transform(own, lambda w, i: F.when(hit(w, i), let(left(w, i), lambda s: parts(w, s))).otherwise(F.array(w))))


def pasted(own: Column, which: Rule, before: bool = False) -> Column:
    """The words that meet which once more, unset, after the last of them (or before the first)."""
    copies = F.transform(F.filter(own, which), lambda w: W.syllable(w["reading"]))
    at = (F.array_min if before else F.array_max)(F.transform(own, lambda w, i: F.when(which(w, i), i)))
    cut = lambda n: F.concat(F.slice(own, F.lit(1), n), copies, F.slice(own, n + 1, F.size(own)))
    return let(at if before else at + 1, lambda n: F.when(n.isNull(), own).otherwise(cut(F.coalesce(n, F.lit(0)))))


def merged(own: Column, which: Rule) -> Column:
    """The words that meet which as one, by ``functions.word.merged``; fewer than two, or some with a gap, stay as they are."""
    places = F.filter(F.transform(own, lambda w, i: F.when(which(w, i), i)), lambda i: i.isNotNull())

    def one(p: Column) -> Column:
        low, n = F.coalesce(F.array_min(p), F.lit(0)), F.size(p)
        whole = F.concat(F.slice(own, F.lit(1), low), F.array(W.merged(F.slice(own, low + 1, n))), F.slice(own, low + n + 1, F.size(own)))
        return F.when((n > 1) & (F.array_max(p) - low + 1 == n), whole).otherwise(own)

    return let(places, one)


def unit_word(surface: Column, readings: Column, with_ruby: bool) -> Column:
    """The unset word of a tokenizer's unit; readings that differ from the surface become ruby."""
    syllables = F.when(F.size(readings) > 0, F.transform(readings, lambda r: W.syllable(r))).otherwise(F.array(W.syllable(surface)))
    ruby = (F.size(readings) > 0) & (F.array_join(readings, "") != surface) & F.lit(with_ruby)
    return W.with_syllables(surface, syllables, ruby, F.size(readings) == 0)


def segmented(own: Column, units: Rule, with_ruby: bool) -> Column:
    """Each word that units (an array of surface and readings, null for none) take apart as a word for each unit, unset. Without
    ruby a single unit changes nothing; separators never change."""

    def one(w: Column, u: Column) -> Column:
        apart = (F.size(u) > (0 if with_ruby else 1)) & ~T.is_separator(w["reading"])
        return F.when(F.coalesce(apart, F.lit(False)), F.transform(u, lambda x: unit_word(x["surface"], x["readings"], with_ruby))).otherwise(F.array(w))

    return F.flatten(F.transform(own, lambda w, i: let(units(w, i), lambda u: one(w, u))))


def total_time(own: Column) -> Column:
    """The sum of the times that are set; null if none is."""
    return F.aggregate(own, F.lit(None).cast("bigint"), lambda a, w: F.coalesce(a + w["t"], w["t"], a))
