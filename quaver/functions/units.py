"""Reading units of words of a morphological tokenizer: walks along two strings, in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from quaver.functions.text import SMALL

UNITS = "array<struct<surface:string,readings:array<string>>>"
_KANA, _KANJI, _MORA = re.compile("[぀-ヴヷ-ヿ]"), re.compile("[一-鿿㐀-䶿]"), re.compile(f"(?s).[{SMALL}]*")


def fold(s: str) -> str:
    """Katakana of the main block as hiragana."""
    return "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in s)


def morae(kana: str) -> list[str]:
    return _MORA.findall(kana)


def _unit(surface: str, reading: str | None) -> dict:
    """A unit with its reading by morae; none where the reading is the surface itself."""
    return {"surface": surface, "readings": morae(reading) if reading is not None and reading != surface else []}


def mixed_units(surface: str, reading: str) -> list[dict]:
    """Units of a word with kanji and its hiragana reading: each kana of the word that the rest of the
    reading holds divides both; what stands before it takes the reading up to there. A kana inside
    the word that the reading doesn't hold is left out."""
    out: list[dict] = []
    block = ""
    for c in surface:
        if not _KANA.match(c):
            block += c
        elif not block:
            out.append(_unit(c, fold(c)))
            reading = reading[1:]
        elif (at := reading.find(c)) >= 0:
            out += [{"surface": block, "readings": morae(reading[:at])}, _unit(c, fold(c))]
            block, reading = "", reading[at + 1 :]
    return [*out, {"surface": block, "readings": morae(reading)}] if block else out


def units(surface: str | None, reading: str | None) -> list[dict]:
    """Units of a token and its katakana reading (its surface if it has none): by ``mixed_units`` if it
    has kanji; kana by morae if both have as many, more than one; else the token as one unit."""
    if not surface:
        return []
    said = reading or surface
    if _KANJI.search(surface):
        return mixed_units(surface, fold(said))
    own, other = morae(surface), morae(said)
    if len(own) == len(other) > 1:
        return [{"surface": s, "readings": [fold(r)] if s != fold(r) else []} for s, r in zip(own, other, strict=True)]
    return [_unit(surface, fold(said))]


def _batch(surface: pd.Series, reading: pd.Series) -> pd.Series:
    return pd.Series([units(s, r) for s, r in zip(surface, reading, strict=True)])


def ruby_units(surface: Column, reading: Column) -> Column:
    """The units of each row's token, in Arrow batches."""
    return pandas_udf(_batch, UNITS)(surface, reading)
