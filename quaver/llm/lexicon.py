"""A minimal acyclic transducer: words as paths with shared prefixes and suffixes, ids as output.

Each transition carries a number; the sum along a word's path is the word's place in a list of id
sequences. Numbers instead of ids on the arcs let suffixes be shared whatever their ids are.
``compile_lexicon`` builds one from a bounded list of words, ``Lexicon`` memory-maps it.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"QLEX0001"


def minimal_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool], int]:
    """Transitions and finality of the minimal deterministic automaton of sorted distinct words."""
    arcs: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    register: dict[tuple, int] = {}
    path = [0]  # states along the last word

    def close(keep: int) -> None:
        while len(path) > keep + 1:
            child = path.pop()
            parent = path[-1]
            key = (final[child], tuple(arcs[child].items()))
            same = register.setdefault(key, child)
            if same != child:
                arcs[parent][last[len(path) - 1]] = same

    last = b""
    for word in words:
        k = 0
        while k < min(len(word), len(last)) and word[k] == last[k]:
            k += 1
        close(k)
        for b in word[k:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][b] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    close(0)
    return arcs, final, 0


def compile_lexicon(entries: dict[bytes, np.ndarray]) -> tuple[bytes, dict[str, int]]:
    """The transducer of words and their ids as the bytes of a file, and its sizes."""
    words = sorted(w for w in entries if w)
    arcs, final, root = minimal_automaton(words)
    order: dict[int, int] = {}
    stack = [root]
    while stack:  # states that can be reached
        s = stack.pop()
        if s not in order:
            order[s] = len(order)
            stack.extend(arcs[s].values())
    count: dict[int, int] = {}

    def accepted(s: int) -> int:
        todo = [s]
        while todo:
            x = todo[-1]
            waiting = [y for y in arcs[x].values() if y not in count]
            if waiting:
                todo.extend(waiting)
            else:
                count[x] = final[x] + sum(count[y] for y in arcs[x].values())
                todo.pop()
        return count[s]

    accepted(root)
    keys, target, weight = [], [], []
    for s, k in order.items():
        passed = int(final[s])
        for b in sorted(arcs[s]):
            keys.append(k << 8 | b)
            target.append(order[arcs[s][b]])
            weight.append(passed)
            passed += count[arcs[s][b]]
    by = np.argsort(np.array(keys, np.int64))
    ids = [np.asarray(entries[w], np.uint32) for w in words]
    ends = np.cumsum([0, *map(len, ids)])
    parts = {
        "keys": np.array(keys, np.int64)[by],
        "target": np.array(target, np.int64)[by],
        "weight": np.array(weight, np.int64)[by],
        "final": np.array([final[s] for s in order], np.int64),
        "ends": ends.astype(np.int64),
        "ids": np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int64),
    }
    head = MAGIC + np.array([len(x) for x in parts.values()], np.int64).tobytes()
    whole = head + b"".join(x.tobytes() for x in parts.values())
    return whole, {"words": len(words), "states": len(order), "arcs": len(keys)}


class Lexicon:
    """A compiled transducer, memory-mapped: workers of one machine share its pages."""

    def __init__(self, file: str):
        whole = np.memmap(file, np.uint8, "r")
        if bytes(whole[:8]) != MAGIC:
            raise ValueError(f"not a lexicon: {file}")
        sizes = whole[8:56].view(np.int64)
        at, parts = 56, []
        for n in sizes.tolist():
            parts.append(whole[at : at + 8 * n].view(np.int64))
            at += 8 * n
        self.keys, self.target, self.weight, self.final, self.ends, self.ids = parts

    def lookup(self, words: list[bytes]) -> list[np.ndarray | None]:
        """Ids of each word, None where it isn't in the lexicon; all words advance together."""
        out: list[np.ndarray | None] = [None] * len(words)
        if not len(self.keys) or not words:
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        rows = np.argsort(-size, kind="stable")  # longest first: those still going stay in front
        size = size[rows]
        data = np.frombuffer(b"".join(words[i] for i in rows), np.uint8)
        start = np.cumsum(size) - size
        state, rank, alive = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), size > 0
        for k in range(int(size[0]) if len(size) else 0):
            going = np.flatnonzero(alive[: int(np.searchsorted(-size, -k, "left"))])
            if not len(going):
                break
            key = state[going] << 8 | data[start[going] + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            alive[going[~hit]] = False
            going, at = going[hit], at[hit]
            state[going] = self.target[at]
            rank[going] += self.weight[at]
        found = np.flatnonzero(alive & (self.final[state] > 0))
        for i in found.tolist():
            r = rank[i]
            out[rows[i]] = self.ids[self.ends[r] : self.ends[r + 1]].astype(np.uint32)
        return out
