"""64-bit hashes of the words of many texts at once."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
#: A random number for each byte, A-Z as a-z; white space (0x20, 0x09 to 0x0D) is told apart.
_BYTE = _RANDOM.integers(0, 2**64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_BYTE[SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes that are hashed at once.
WINDOW = 1 << 20
_POWERS: list[np.ndarray] = []
_ORDER = _RANDOM.integers(0, 2**64, 8, np.uint64) | np.uint64(1)


def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse, for one window."""
    if not _POWERS:
        for b in (_BASE, _INVERSE):
            p = np.full(WINDOW, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _window(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, unmixed hash) of the words of a window that ends with white space or the text."""
    up, down = _powers()
    sums = np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.append(edge, len(data))
    start, stop = edge[0::2], edge[1::2]
    return start, (sums[stop - 1] - np.where(start > 0, sums[start - 1], np.uint64(0))) * down[start]


def _long_word(data: np.ndarray, s: int) -> tuple[int, int]:
    """(end, unmixed hash) of the word of any length that begins at s."""
    up, total, e = _powers()[0], 0, s
    while e < len(data):
        part = data[e : e + WINDOW]
        space = SPACE[part]
        n = int(space.argmax()) if space.any() else len(part)
        got = int((_BYTE[part[:n]] * up[:n]).sum(dtype=np.uint64))
        total = (total + got * pow(int(_BASE), e - s, 2**64)) % 2**64
        e += n
        if n < len(part):
            break
    return e, total


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word: a run without white space, A-Z lower-cased.

    Texts are hashed a window at a time, cut at white space, so that a long one takes 16 bytes a word besides itself.
    """
    raw = [(x or "").encode() for x in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    starts, hashes, s = [], [], 0
    while s < len(data):
        e = min(s + WINDOW, len(data))
        space = np.flatnonzero(SPACE[data[max(s, e - 4096) : e]]) if e < len(data) else np.array([e - 1 - max(s, e - 4096)])
        if not len(space):
            space = np.flatnonzero(SPACE[data[s:e]]) + s - max(s, e - 4096)
        if len(space):
            e = max(s, e - 4096) + int(space[-1]) + 1
            at, h = _window(data[s:e])
            starts.append(at + s)
            hashes.append(h)
        else:
            e, h = _long_word(data, s)
            starts.append(np.array([s]))
            hashes.append(np.array([h], np.uint64))
        s = e
    start, h = np.concatenate(starts), np.concatenate(hashes)
    begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])])
    return np.searchsorted(begin, start, "right") - 1, mix(h)


def shingles(doc: np.ndarray, h: np.ndarray, n_texts: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of k words in a row of every text, sorted within it, and where each text's begin (n_texts + 1
    offsets). A text of fewer words has one, of all of them; a text without words has none."""
    n = np.bincount(doc, minlength=n_texts)
    long = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        if len(long):
            long += h[j : j + len(long)] * _ORDER[j]
    keep = doc[: len(long)] == doc[k - 1 :] if len(long) else np.zeros(0, bool)
    long, of = mix(long[keep]), doc[: len(keep)][keep]
    at = np.concatenate([[0], np.cumsum(n)])
    first = np.searchsorted(of, np.arange(n_texts + 1))
    out = []
    for i in range(n_texts):
        if n[i] >= k:
            x = np.sort(long[first[i] : first[i + 1]])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif n[i]:
            own = h[at[i] : at[i + 1]]
            out.append(mix(np.array([(own * _ORDER[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))])))
        else:
            out.append(long[:0])
    return np.concatenate(out) if out else long, np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)
