"""Lyric text as Columns: tokens, kinds of words, punctuation, kana and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaver.functions.arrays import let
from quaver.functions.timecode import BLANK, trimmed

#: The characters that count as punctuation words.
PUNCTUATION = "「」『』（）、。！？…・～~,.;:!?\"'"
#: The small kana that stay with the one before them.
SMALL = "ゃゅょャュョ"
RUN = r"[ \t\n\r\u3000]+|[^ \t\n\r\u3000]+"


def is_blank(s: Column) -> Column:
    return s.rlike(rf"^{BLANK}*$")


def normalized(s: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.regexp_replace(trimmed(s), f"{BLANK}+", " ")


def tokens(text: Column) -> Column:
    """Words, and for each white-space run a newline word (if it has a line feed) or a space word."""

    def token(run: Column) -> Column:
        odd = let(trimmed(run), lambda bare: F.when(bare != "", bare).when(run.contains("\n"), "\n").otherwise(" "))
        return F.when(run == " ", run).when(run.rlike(BLANK), odd).otherwise(run)

    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(0)), token)


def closed(words: Column) -> Column:
    """Words with a newline word at the end."""
    ends = lambda w: F.coalesce(F.get(w, F.size(w) - 1) == "\n", F.lit(False))
    return let(words, lambda w: F.when(ends(w), w).otherwise(F.concat(w, F.array(F.lit("\n")))))


def kind(reading: Column) -> Column:
    """space, newline, punctuation (every character is one) or sung."""
    return F.when(reading == " ", "space").when(reading == "\n", "newline").when(is_punctuation(reading), "punctuation").otherwise("sung")


def is_punctuation(reading: Column) -> Column:
    return reading.rlike(f"^[{PUNCTUATION}]+$")


def is_separator(reading: Column) -> Column:
    return reading.isin(" ", "\n")


def split_punctuation(s: Column) -> Column:
    """Single punctuation characters and the text between them."""
    return F.regexp_extract_all(s, F.lit(f"[{PUNCTUATION}]|[^{PUNCTUATION}]+"), F.lit(0))


def collapsed(words: Column, newline_wins: bool = False) -> Column:
    """Each run of separators as its last one, or as a newline if one is among them; blank-only
    results keep their separators. The end gets a newline word."""
    following = F.concat(F.slice(words, 2, F.size(words)), F.array(F.lit("")))
    if not newline_wins:
        pairs = F.filter(F.arrays_zip(words.alias("x"), following.alias("y")), lambda p: ~(is_separator(p["x"]) & is_separator(p["y"])))
        kept = F.transform(pairs, lambda p: p["x"])
    else:
        both = lambda a, w: F.when(
            is_separator(w) & is_separator(F.element_at(a, -1)),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.when(F.element_at(a, -1) == "\n", "\n").otherwise(w))),
        ).otherwise(F.concat(a, F.array(w)))
        kept = F.aggregate(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 1, 1), both)
    return let(F.when(F.size(words) == 0, words).otherwise(kept), closed)


def has_kanji(s: Column) -> Column:
    return s.rlike(r"[一-鿿㐀-䶿]")


def is_kana(s: Column) -> Column:
    """Whether every character is hiragana or katakana (but not the small ka and ke)."""
    return s.rlike(r"^[぀-ヴヷ-ヿ]+$")


def morae(kana: Column) -> Column:
    """Kana split into beats: a small ya, yu or yo goes with the one before."""
    return F.regexp_extract_all(kana, F.lit(f"(?s).[{SMALL}]*"), F.lit(0))


def hiragana(s: Column) -> Column:
    """Katakana of the main block as hiragana."""
    low, high = 0x30A1, 0x30F6
    return F.translate(s, "".join(map(chr, range(low, high + 1))), "".join(chr(c - 0x60) for c in range(low, high + 1)))


def aligner_text(s: Column) -> Column:
    """White-space characters as blanks, one for one, and a leading blank."""
    out = F.regexp_replace(s, BLANK, " ")
    return F.when(out.startswith(" "), out).otherwise(F.concat(F.lit(" "), out))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def vocal_cache(path: Column) -> Column:
    """Where separated vocals of an audio file are kept."""
    return F.concat(file_stem(path), F.lit("-vocal.wav"))


def progress(line: Column) -> Column:
    """The share of a ``PROGRESS x`` line, within 0 and 1; null for other lines."""
    found = F.regexp_extract(line, r"^PROGRESS\s+([0-9]*\.?[0-9]+)\s*$", 1).try_cast("double")
    return F.when(found.isNotNull(), F.least(F.greatest(found, F.lit(0.0)), F.lit(1.0)))
