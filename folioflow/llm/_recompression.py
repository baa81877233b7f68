"""Recompression of word sequences: runs and pairs of symbols get names round by round.

A round replaces each maximal run of one symbol by a symbol of its own, then deals all
symbols to a left or a right half and replaces each pair of a left symbol and the right one
behind it.  A name is a 64-bit hash of what it replaces, so the same run or pair has the same
name in every task, and names need no table.

Beside the words it covers, a symbol knows its context: all words that were looked at until
it was named.  Two sequences that agree on the context of a symbol both hold that symbol.
"""

from __future__ import annotations

import numpy as np

from ._shingles import mix64

_RUN, _PAIR, _HALF = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Runs are looked for in every such round: a symbol's context grows by both neighbours each time.
RUN_EVERY = 6
#: Rounds end here on sequences that never outgrow a context (endless repetition).
ROUNDS = 60
#: A context's end beyond the end of a document.
OUTSIDE = 1 << 60


class Symbols:
    """The symbols of some documents, one behind the other: names, words [b, e), context [cl, cr), document."""

    def __init__(self, words: np.ndarray, counts: np.ndarray) -> None:
        at = np.arange(len(words), dtype=np.int64)
        self.name, self.b, self.e, self.cl, self.cr = words, at, at + 1, at, at + 1
        self.doc = np.repeat(np.arange(len(counts)), counts)

    def __len__(self) -> int:
        return len(self.name)

    def _joined(self) -> np.ndarray:
        """Whether each symbol goes on in the document of the one before it."""
        return np.r_[False, self.doc[1:] == self.doc[:-1]]

    def _looked(self, joined: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts of symbols of which some have looked at their left, some at their right neighbour.
        At a document's edge they lie outside of it, as another sequence may go on there."""
        cl, cr = self.cl.copy(), self.cr.copy()
        at = np.flatnonzero(left & joined)
        cl[at], cr[at] = np.minimum(cl[at], self.cl[at - 1]), np.maximum(cr[at], self.cr[at - 1])
        follows = np.r_[joined[1:], False]
        at = np.flatnonzero(right & follows)
        cl[at], cr[at] = np.minimum(cl[at], self.cl[at + 1]), np.maximum(cr[at], self.cr[at + 1])
        cl[left & ~joined] = -1
        cr[right & ~follows] = OUTSIDE
        return cl, cr

    def _merge(self, head: np.ndarray, name: np.ndarray, cl: np.ndarray, cr: np.ndarray) -> np.ndarray:
        """Keep the heads, each up to the next one; returns each old symbol's place among the new ones."""
        at = np.flatnonzero(head)
        last = np.r_[at[1:], len(head)] - 1
        self.name, self.b, self.e, self.doc = name[at], self.b[at], self.e[last], self.doc[at]
        self.cl, self.cr = np.minimum.reduceat(cl, at), np.maximum.reduceat(cr, at)
        return np.cumsum(head) - 1

    def runs(self) -> np.ndarray:
        joined = self._joined()
        head = ~(joined & np.r_[False, self.name[1:] == self.name[:-1]])
        at = np.flatnonzero(head)
        length = np.diff(np.r_[at, len(head)])
        name = self.name.copy()
        name[at] = np.where(length > 1, mix64(name[at] * _RUN + length.astype(np.uint64)), name[at])
        return self._merge(head, name, *self._looked(joined, head, np.r_[head[1:], True]))

    def pairs(self, turn: int) -> np.ndarray:
        joined = self._joined()
        is_left = mix64(self.name + np.uint64(turn * int(_HALF) % (1 << 64))) >> np.uint64(63) == 0
        second = joined & ~is_left & np.r_[False, is_left[:-1]]
        first = np.r_[second[1:], False]
        name = np.where(first, mix64(mix64(self.name * _PAIR) + np.r_[self.name[1:], self.name[:1]]), self.name)
        # a pair needs no further look; what stays alone has looked at the neighbour it could have joined
        return self._merge(~second, name, *self._looked(joined, ~is_left & ~second, is_left & ~first))


def anchors(words: np.ndarray, counts: np.ndarray, limit: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The symbols that are the first to cover ``least`` words, made of parts that cover fewer, if their context has at
    most ``limit`` words: (document, name, context begin, context end), contexts counted from the document's first word.

    Whether a symbol is taken depends on its own parts and context alone, so it is taken wherever the context stands."""
    s = Symbols(words, counts)
    small = np.ones(len(s), bool)
    out: list[list[np.ndarray]] = []

    def take() -> np.ndarray:
        """Take what has just become large enough; which symbols are still small."""
        large = s.e - s.b >= least
        now = large & (s.cr - s.cl <= limit) & small
        out.append([x[now] for x in (s.doc, s.name, s.cl, s.cr)])
        return ~large

    small = take()
    for turn in range(ROUNDS):
        # a context never shrinks: when all small symbols have outgrown the limit nothing more is taken
        if not (small & (s.cr - s.cl <= limit)).any():
            break
        for step in ([s.runs] if turn % RUN_EVERY == 0 else []) + [lambda: s.pairs(turn)]:
            before, up = small, step()
            small = np.ones(len(s), bool)
            small[up[~before]] = False
            small &= take()
    doc, name, cl, cr = (np.concatenate(x) for x in zip(*out))
    begins = np.r_[0, np.cumsum(counts)][doc]
    return doc, name, cl - begins, cr - begins
