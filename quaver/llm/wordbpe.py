"""Byte-pair ids of whole Arrow text columns, equal to the tokenizers library's.

For a tokenizer file of the kind "NFC, white space, lower case; split into contractions, letters,
single numbers and other runs; byte-level pairs with a word-end mark". Texts of common Latin
characters are split with numpy on their UTF-8 bytes; any other text, and any that holds the
beginning of a special token, is split by the library's own normaliser and pre-tokeniser. Words
are looked up in a table of words met so far, then in an optional lexicon (see ``lexicon``), and
what neither knows is merged exactly, many words at a time.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quaver.llm.textbuf import LANES, buffers, folded, lanes, mix

SLICE_BYTES = 1 << 19
#: Words kept in the table before it starts anew; bounds a worker's memory at about 100 MB.
TABLE_WORDS = 600_000
NONE = np.int32(2**31 - 1)
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The tails of English contractions that are words of their own after an apostrophe.
TAILS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    """Class of each code point below U+0180."""
    import unicodedata

    out = np.full(0x180, OTHER, np.uint8)
    for c in range(0x180):
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[[*range(9, 14), 0x20, 0x85, 0xA0]] = SPACE
    return out


CLASS = _classes()


class Table:
    """Open addressing from 64-bit keys to values 0, 1, ... in the order of insertion."""

    def __init__(self, bits: int = 16):
        self.mask, self.n = (1 << bits) - 1, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        out = self.values[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            out[todo] = self.values[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[slot[todo]] != keys[todo])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Inserts distinct keys that aren't there."""
        values = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        if self.n * 2 > self.mask:
            old = self.keys[self.values >= 0], self.values[self.values >= 0]
            bits = int(self.n * 3).bit_length()
            self.mask = (1 << bits) - 1
            self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            self._put(*old)
        self._put(keys, values)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        while len(keys):
            free = self.values[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            own = np.flatnonzero(free)[first]
            self.keys[slot[own]], self.values[slot[own]] = keys[own], values[own]
            rest = np.ones(len(keys), bool)
            rest[own] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.mask


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i] .. starts[i]+sizes[i]-1 for each i, one after another."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


class Pieces:
    """Words of lower-case text bytes as (begin, size) and the number of words of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        kind = CLASS[np.minimum(data, 0x7F)]
        kind[data >= 0x80] = OTHER
        lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC5))
        lead = lead[lead + 1 < n]
        code = (data[lead].astype(np.int32) & 0x1F) << 6 | data[lead + 1] & 0x3F
        kind[lead] = kind[lead + 1] = CLASS[code]
        first = np.ones(n, bool)
        first[1:] = kind[1:] != kind[:-1]
        first |= (kind == NUMBER) & (data & 0xC0 != 0x80)
        first[offsets[(offsets > 0) & (offsets < n)]] = True
        begin = np.flatnonzero(first)
        size = np.diff(begin, append=n)
        # An apostrophe that is a run of its own takes the tail of a contraction.
        quotes = np.flatnonzero((data[begin] == 0x27) & (size == 1))
        quotes = quotes[quotes + 1 < len(begin)]
        quotes = quotes[kind[begin[quotes + 1]] == LETTER]
        if len(quotes):
            at, room = begin[quotes] + 1, size[quotes + 1]
            bounds = offsets[(offsets > 0) & (offsets < n)]
            apart = np.isin(at, bounds)
            one, two = data[at], data[np.minimum(at + 1, n - 1)]
            taken = np.zeros(len(quotes), np.int64)
            for tail in reversed(TAILS):
                fits = one == ord(tail[0])
                if len(tail) == 2:
                    fits &= (two == ord(tail[1])) & (room >= 2)
                taken[fits] = len(tail)
            taken[apart] = 0
            begin, size = begin.copy(), size.copy()
            size[quotes] += taken
            begin[quotes + 1] += taken
            size[quotes + 1] -= taken
        keep = (kind[np.minimum(begin, max(n - 1, 0))] != SPACE) & (size > 0)
        quiet = np.zeros(len(begin), bool)
        quiet[quotes] = True  # an apostrophe with its tail
        keep |= quiet & (size > 0)
        self.begin, self.size = begin[keep], size[keep]
        self.count = np.diff(np.searchsorted(self.begin, offsets))


class WordBpe:
    """Encoder of one worker; see ``encoder``."""

    def __init__(self, path: str, lexicon=None):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.library = Tokenizer.from_file(path)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.mark = spec["model"]["end_of_word_suffix"] or ""
        letters = self.byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[letters[b] + self.mark] for b in range(256)], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in merges]
        left, right = ([vocab[x[i]] for x in pairs] for i in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = self.pair_key(np.array(left, np.int64), np.array(right, np.int64))
        self.pairs = Table(18)
        self.pairs.add(keys)
        self.strings: dict[int, bytes] = {i: s.encode() for s, i in (vocab | self.special).items()}
        self.lexicon = lexicon
        self.reset()

    def reset(self) -> None:
        self.table, self.used = Table(18), 0
        self.ids = np.zeros(1 << 20, np.uint32)
        self.start, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.known = np.zeros((LANES + 1, 1 << 18), np.uint64)  # lanes and size in bytes of each word of the table

    @staticmethod
    def byte_letters() -> list[str]:
        """The printable character that stands for each byte in a byte-level vocabulary."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = iter(range(0x100, 0x200))
        return [chr(b if b in plain else next(rest)) for b in range(256)]

    @staticmethod
    def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), 7)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The order of the merge of each pair of ids; NONE if it has none."""
        out = self.pairs.get(self.pair_key(a, b))
        out[out < 0] = NONE
        return out

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word: while any pair has a merge, the earliest merge's leftmost pair joins."""
        out: list = [None] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 1), (1, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 40), (40, 64)):
            rows = np.flatnonzero((size > low) & (size <= high))
            for part in np.array_split(rows, max(1, len(rows) // 20_000)):
                if len(part):
                    self._merge_block(words, part, size[part], high, out)
        for i in np.flatnonzero(size > 64):
            out[i] = self._merge_long(words[i])
        return out

    def _merge_block(self, words: list[bytes], rows: np.ndarray, size: np.ndarray, width: int, out: list) -> None:
        raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
        ids = self.inner[raw]
        each = np.arange(len(rows))
        ids[each, size - 1] = self.final[raw[each, size - 1]]
        rank = np.full((len(rows), width), NONE, np.int32)
        inside = np.arange(width - 1)[None, :] < (size - 1)[:, None]
        if width > 1:
            rank[:, :-1][inside] = self.rank(ids[:, :-1][inside], ids[:, 1:][inside])
        cols = np.arange(width)
        while len(rows):
            best = rank.argmin(axis=1)
            each = np.arange(len(rows))
            least = rank[each, best]
            done = least == NONE
            if done.any():
                for i, row, n in zip(rows[done], ids[done], size[done], strict=True):
                    out[i] = row[:n].astype(np.uint32)
                go = ~done
                rows, ids, rank, size, best, least = rows[go], ids[go], rank[go], size[go], best[go], least[go]
                if not len(rows):
                    return
                each = np.arange(len(rows))
            ids[each, best] = self.merged[least]
            take = np.minimum(cols[None, :] + (cols[None, :] > best[:, None]), width - 1)
            ids = np.take_along_axis(ids, take, 1)
            # The pair of best+1 starts at best now; both pairs that touch the new symbol change.
            rank = np.take_along_axis(rank, np.minimum(cols[None, :] + (cols[None, :] >= best[:, None]), width - 1), 1)
            size -= 1
            rank[each, np.minimum(size - 1, width - 1)] = NONE
            for at in (best - 1, best):
                fits = np.flatnonzero((at >= 0) & (at < size - 1))
                rank[fits, at[fits]] = self.rank(ids[fits, at[fits]], ids[fits, at[fits] + 1])

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same for one long word, by a heap of pairs."""
        raw = np.frombuffer(word, np.uint8)
        ids = self.inner[raw].tolist()
        ids[-1] = int(self.final[raw[-1]])
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        ranks = self.rank(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.merged[r]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0:
                    r = int(self.rank(np.array([ids[x]]), np.array([ids[after[x]]]))[0])
                    if r != NONE:
                        heapq.heappush(heap, (r, x, ids[x], ids[after[x]]))
        return np.array([x for x in ids if x >= 0], np.uint32)

    def ids_of(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, by the lexicon or by merging."""
        found = self.lexicon.lookup(words) if self.lexicon is not None else [None] * len(words)
        rest = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(rest, self.merge([words[i] for i in rest]), strict=True):
            found[i] = ids
        return found

    def learn(self, keys: np.ndarray, own: np.ndarray, words: list[bytes]) -> None:
        """Adds words of distinct keys, with their lanes and sizes in bytes, to the table."""
        found = self.ids_of(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        n, total = self.table.n, int(sizes.sum())
        while n + len(words) > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
            self.known = np.concatenate([self.known, self.known], axis=1)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.known[:, n : n + len(words)] = own
        self.size[n : n + len(words)] = sizes
        self.start[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + total] = np.concatenate(found)
        self.used += total
        self.table.add(keys)

    def words(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the number of each."""
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        own = np.concatenate([lanes(data, begin, size), size[None].astype(np.uint64)])
        keys = folded(own, size, 3)
        at = self.table.get(keys)
        text = b""
        if (at < 0).any():
            if self.table.n > TABLE_WORDS:
                self.reset()
                at = np.full(len(keys), -1, np.int32)
            new, first = np.unique(keys[at < 0], return_index=True)
            where = np.flatnonzero(at < 0)[first]
            text = data.tobytes()
            self.learn(new, own[:, where], [text[b : b + s] for b, s in zip(begin[where].tolist(), size[where].tolist(), strict=True)])
            at = self.table.get(keys)
        sizes = self.size[at]
        ids = self.ids[ragged(self.start[at], sizes)]
        # A word whose key another word has in the table isn't that word.
        wrong = (self.known[0, at] != own[0]) | (self.known[LANES, at] != own[LANES])
        long = np.flatnonzero(size > 8)
        wrong[long] |= (self.known[1:LANES, at[long]] != own[1:LANES, long]).any(axis=0)
        if not wrong.any():
            return ids, sizes
        text = text or data.tobytes()
        rows = np.flatnonzero(wrong)
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for i, found in zip(rows.tolist(), self.ids_of([text[begin[i] : begin[i] + size[i]] for i in rows]), strict=True):
            parts[i] = found
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def runs(self, texts: pa.Array):
        """Runs of documents: (first, lower-case bytes, their Pieces, odd documents, texts).

        Odd documents, which the library has to split, are empty in the bytes.
        """
        texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string())
        texts = texts.fill_null("") if texts.null_count else texts
        raw, offsets = buffers(texts)
        i, n = 0, len(texts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
            run = texts.slice(i, j - i)
            odd = uncommon(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), run) if odd.any() else run
            data, at = buffers(pc.utf8_lower(plain))
            yield i, data, Pieces(data, at), odd, run
            i = j

    def encode(self, texts: pa.Array):
        """Yields (first document, ids of a run of documents, offset of each document's ids)."""
        for first, data, pieces, odd, run in self.runs(texts):
            ids, sizes = self.words(data, pieces.begin, pieces.size)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            bounds = ends[np.concatenate([[0], np.cumsum(pieces.count)])]
            if odd.any():
                parts = [self.by_library(run[k].as_py()) if odd[k] else ids[bounds[k] : bounds[k + 1]] for k in range(len(run))]
                ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            yield first, ids, bounds

    def count(self, texts: pa.Array, tally: dict[bytes, int]) -> None:
        """Adds the words of texts to a tally."""
        for _, data, pieces, odd, run in self.runs(texts):
            for found in [(data, pieces.begin, pieces.size), *(x for k in np.flatnonzero(odd) for x in self.library_words(run[int(k)].as_py()) if not isinstance(x, int))]:
                data, begin, size = found
                if len(begin):
                    _, first, n = np.unique(folded(lanes(data, begin, size), size, 3), return_index=True, return_counts=True)
                    text = data.tobytes()
                    for b, s, k in zip(begin[first].tolist(), size[first].tolist(), n.tolist(), strict=True):
                        w = text[b : b + s]
                        tally[w] = tally.get(w, 0) + k

    def library_words(self, text: str):
        """Special ids of any text and, between them, its words as (bytes, begin, size)."""
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                yield self.special[part]
                continue
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
            words = [bytes(LETTER_BYTES[c] for c in w) for w, _ in found]
            if words:
                size = np.fromiter(map(len, words), np.int64, len(words))
                yield np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size

    def by_library(self, text: str) -> np.ndarray:
        """Ids of any text; the library finds its words."""
        parts = [np.array([x], np.uint32) if isinstance(x, int) else self.words(*x)[0] for x in self.library_words(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """What the library's decode gives for a tokenizer without a decoder: tokens and blanks."""
        return b" ".join(map(self.strings.__getitem__, ids.tolist()))


LETTER_BYTES = {c: b for b, c in enumerate(WordBpe.byte_letters())}


def uncommon(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a character whose case, composition or class isn't plain, or "<|"."""
    bad = np.flatnonzero(raw >= 0xC6)
    after = lambda i, k: raw[np.minimum(i + k, len(raw) - 1)]
    if len(bad):
        third = after(bad, 2)
        bad = bad[~((raw[bad] == 0xE2) & (after(bad, 1) == 0x80) & (third >= 0x90) & (third <= 0xA6))]
    dotted = np.flatnonzero(raw == 0xC4)
    dotted = dotted[after(dotted, 1) == 0xB0] if len(dotted) else dotted
    angle = np.flatnonzero(raw == 0x3C)
    angle = angle[after(angle, 1) == 0x7C] if len(angle) else angle
    out = np.zeros(len(offsets) - 1, bool)
    for found in (bad, dotted, angle):
        if len(found):
            out[np.searchsorted(offsets, found, "right") - 1] = True
    return out


_encoders: dict = {}


def encoder(path: str, lexicon_file: str | None = None) -> WordBpe:
    """This worker's encoder for a tokenizer file and a compiled lexicon."""
    key = (path, lexicon_file)
    if key not in _encoders:
        from quaver.llm.lexicon import Lexicon

        _encoders.clear()
        _encoders[key] = WordBpe(path, Lexicon(lexicon_file) if lexicon_file else None)
    return _encoders[key]
