"""Shortest edit scripts between two sequences of words, in linear space, and their application both ways.

The common subsequence is found by halving one sequence and choosing where to cut the other (Hirschberg); a
half's lengths against all beginnings of the other come from one pass of bit operations on whole
numbers with a bit for each word, so that a pass over n and m words takes n * m / 64 steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

SCRIPT = "array<struct<op:string,old_idx:int,new_idx:int,word:string>>"


def lengths(a: list, b: list) -> np.ndarray:
    """How long the longest common subsequence of a and b[:j] is, for j from 0 to len(b)."""
    full, masks = (1 << len(b)) - 1, {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    v = full
    for x in a:
        if (m := masks.get(x)) is not None:
            u = v & m
            v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, ascending; of equal cuts the first is taken."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, p, j, q = todo.pop()
        while i < p and j < q and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < p and j < q and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
            out.append((p, q))
        if i == p or j == q:
            continue
        if p - i == 1:
            if a[i] in (own := b[j:q]):
                out.append((i, j + own.index(a[i])))
            continue
        mid, own = (i + p) // 2, b[j:q]
        cut = j + int(np.argmax(lengths(a[i:mid], own) + lengths(a[mid:p][::-1], own[::-1])[::-1]))
        todo += [(i, mid, j, cut), (mid, p, cut, q)]
    return sorted(out)


def script(old: list, new: list) -> list[dict]:
    """Deletions by their place in old, then insertions by their place in new: as few as there can be."""
    both = common(old, new)
    kept, there = {i for i, _ in both}, {j for _, j in both}
    gone = [{"op": "delete", "old_idx": i, "new_idx": None, "word": x} for i, x in enumerate(old) if i not in kept]
    return gone + [{"op": "insert", "old_idx": None, "new_idx": j, "word": x} for j, x in enumerate(new) if j not in there]


def patched(words: list, edits: list[dict], back: bool) -> list:
    """The other version: the new one of old words, or with ``back`` the old one of new words."""
    drop, place = ("insert", "delete") if back else ("delete", "insert")
    at = {"insert": "new_idx", "delete": "old_idx"}
    gone = {e[at[drop]] for e in edits if e["op"] == drop}
    put = {e[at[place]]: e["word"] for e in edits if e["op"] == place}
    kept = iter([x for k, x in enumerate(words) if k not in gone])
    n = len(words) - len(gone) + len(put)
    return [put[k] if k in put else next(kept) for k in range(n)]


def _lists(column: pd.Series) -> list[list]:
    return [[] if x is None else list(x) for x in column]


def edit_script(old: Column, new: Column) -> Column:
    """The shortest edit script between two arrays of words (null: none), as an array of op (delete or insert),
    old_idx or new_idx, and word."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([script(x, y) for x, y in zip(_lists(a), _lists(b), strict=True)], dtype="object")

    return pandas_udf(run, SCRIPT)(old, new)


def apply_script(words: Column, edits: Column, back: bool = False) -> Column:
    """words with a script carried out, or with ``back`` undone."""

    def run(a: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([patched(x, y, back) for x, y in zip(_lists(a), _lists(e), strict=True)], dtype=pd.ArrowDtype(pa.list_(pa.string())))

    return pandas_udf(run, "array<string>")(words, edits)
