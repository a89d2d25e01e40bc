"""A minimal acyclic transducer from words to token ids.

Words (byte strings) are added in sorted order; states with the same future are shared, so common
endings are stored once. Ids sit on the transitions as outputs and are pushed towards the start as
far as the words of a prefix agree, which keeps the endings shareable. The finished automaton is
three flat arrays in one file that any number of processes map into memory read-only.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterable

import numpy as np

_MAGIC = b"qlex1\0\0\0"
Ids = tuple[int, ...]


class _State:
    __slots__ = ("arcs", "final", "tail")

    def __init__(self) -> None:
        self.arcs: dict[int, list] = {}  # byte -> [target, output]
        self.final = False
        self.tail: Ids = ()


def _common(a: Ids, b: Ids) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Builder:
    """Builds the automaton from words in strictly ascending byte order."""

    def __init__(self) -> None:
        self._register: dict[tuple, int] = {}
        self._states: list[tuple] = []  # frozen: (final, tail, ((byte, target, output), ...))
        self._path = [_State()]
        self._last = b""
        self._any = False

    def _freeze(self, state: _State) -> int:
        key = (state.final, state.tail, tuple((b, t, o) for b, (t, o) in sorted(state.arcs.items())))
        at = self._register.get(key)
        if at is None:
            at = self._register[key] = len(self._states)
            self._states.append(key)
        return at

    def _close(self, depth: int) -> None:
        """Freeze the open path below `depth`."""
        for i in range(len(self._path) - 1, depth, -1):
            at = self._freeze(self._path.pop())
            self._path[i - 1].arcs[self._last[i - 1]][0] = at

    def add(self, word: bytes, ids: Ids) -> None:
        if self._any and word <= self._last:
            raise ValueError("words must come in ascending order, each once")
        keep = 0
        while keep < min(len(word), len(self._last)) and word[keep] == self._last[keep]:
            keep += 1
        self._close(keep)
        left = ids
        for i in range(keep):
            arc = self._path[i].arcs[word[i]]
            n = _common(arc[1], left)
            rest = arc[1][n:]
            if rest:  # push what no longer agrees one state further
                arc[1] = arc[1][:n]
                nxt = self._path[i + 1]
                for a in nxt.arcs.values():
                    a[1] = rest + a[1]
                if nxt.final:
                    nxt.tail = rest + nxt.tail
            left = left[n:]
        for i in range(keep, len(word)):
            self._path.append(_State())
            self._path[i].arcs[word[i]] = [None, left]
            left = ()
        self._path[-1].final = True
        self._path[-1].tail = left
        self._last, self._any = word, True

    def finish(self) -> bytes:
        """The file: header, state offsets, arcs (byte, target, output offset), outputs."""
        self._close(0)
        root = self._freeze(self._path[0])
        outs: dict[Ids, int] = {(): 0}
        pool: list[int] = [0]  # each output: its length, then its ids

        def out(ids: Ids) -> int:
            at = outs.get(ids)
            if at is None:
                at = outs[ids] = len(pool)
                pool.append(len(ids))
                pool.extend(ids)
            return at

        first, tail, label, target, output = [], [], [], [], []
        for final, t, arcs in self._states:
            first.append(len(label))
            tail.append(out(t) if final else -1)
            for b, to, o in arcs:
                label.append(b)
                target.append(to)
                output.append(out(o))
        first.append(len(label))
        arrays = [np.asarray(x, dtype="<i4") for x in (first, tail, label, target, output, pool)]
        head = _MAGIC + struct.pack("<7i", root, *(len(a) for a in arrays))
        return head + b"".join(a.tobytes() for a in arrays)


def compile_lexicon(words: Iterable[tuple[bytes, Ids]]) -> bytes:
    """Bytes of the automaton for (word, ids) pairs in any order; a word given twice must have the same ids."""
    b = Builder()
    last = None
    for word, ids in sorted(words):
        if word != last:
            b.add(word, ids)
        last = word
    return b.finish()


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self._map[:8] != _MAGIC:
            raise ValueError("not a lexicon file")
        root, *sizes = struct.unpack_from("<7i", self._map, 8)
        views, at = [], 36
        for n in sizes:
            # views of the mapping itself: nothing is copied into this process
            views.append(memoryview(self._map)[at : at + 4 * n].cast("i"))
            at += 4 * n
        self._root = root
        self._first, self._tail, self._label, self._target, self._output, self._pool = views
        self._start: dict[int, int] = {self._label[a]: a for a in range(self._first[root], self._first[root + 1])}

    @property
    def n_states(self) -> int:
        return len(self._tail)

    def get(self, word: bytes) -> list[int] | None:
        """The ids of `word`, or None where the lexicon lacks it."""
        first, label, pool, output = self._first, self._label, self._pool, self._output
        ids: list[int] = []
        state = self._root
        for b in word:
            if state == self._root:
                a = self._start.get(b, -1)
                if a < 0:
                    return None
            else:
                lo, hi = first[state], first[state + 1]
                while lo < hi:
                    mid = (lo + hi) >> 1
                    if label[mid] < b:
                        lo = mid + 1
                    else:
                        hi = mid
                if lo == first[state + 1] or label[lo] != b:
                    return None
                a = lo
            o = output[a]
            if o:
                ids.extend(pool[o + 1 : o + 1 + pool[o]])
            state = self._target[a]
        t = self._tail[state]
        if t < 0:
            return None
        if t:
            ids.extend(pool[t + 1 : t + 1 + pool[t]])
        return ids
