"""Word and shingle hashing on UTF-8 bytes, a block of documents at a time.

A word is ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; no other letter
changes and no other white space separates.  A document's shingle set holds the
64-bit hashes of its distinct runs of ``width`` words; a document of fewer words
has its whole word sequence as its one shingle, one without words has none.

Word hashes are polynomial over the bytes of the word (prefix sums give all
words of a block at once), then mixed; a shingle mixes the hashes of its words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_WEIGHTS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
#: Bytes of text hashed together; a longer document is a block of its own.
BLOCK_BYTES = 1 << 17
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[name] = np.cumprod(step, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def block_words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw) if lower else raw
    space = (low == 32) | ((low >= 9) & (low <= 13))
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power_table(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=total[1:])
    words = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(start, bounds))))
    return words, counts


def blocks(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield held


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of so many words; polynomial over the words, by prefix sums."""
    up, down = _power_table(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    n = max(0, len(words) - width + 1)
    return mix64((total[width : width + n] - total[:n]) * down[:n])


def block_shingles(words: np.ndarray, counts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    n = len(words)
    runs = np.full(max(0, n - width + 1), width, np.uint64)
    for k in range(width if len(runs) else 0):
        runs = mix64(runs * np.uint64(_WEIGHTS[k % 3]) + words[k : k + len(runs)])
    at = 0
    for c in counts:
        if c >= width:
            own = np.sort(runs[at : at + c - width + 1])
            yield own[np.r_[True, own[1:] != own[:-1]]]
        elif c:
            short = np.full(1, c, np.uint64)
            for k in range(c):
                short = mix64(short * np.uint64(_WEIGHTS[k % 3]) + words[at + k : at + k + 1])
            yield short
        else:
            yield words[:0]
        at += c


def shingle_sets(texts: Iterable[str | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text, in order."""
    for block in blocks(texts):
        yield from block_shingles(*block_words(block), width)
