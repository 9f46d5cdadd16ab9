"""Hashed text features in numpy, over whole texts.

Every function takes one text and works through it in blocks of BLOCK code
points, so that memory does not grow with the text.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
SPACE = 32
_classes: dict[str, np.ndarray] = {}


def char_class(name: str) -> np.ndarray:
    """Table over code points: whether str.<name>() holds (isalpha, isdigit, isupper, isspace)."""
    if name not in _classes:
        _classes[name] = np.fromiter((getattr(chr(c), name)() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _classes[name]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def letter_grams(text: str, dims: int, n: int = 3) -> np.ndarray:
    """Counts of hashed letter n-grams of the lower-cased text; what is no letter counts as one space."""
    out = np.zeros(dims)
    letters = char_class("isalpha")
    carry = np.full(n - 1, SPACE, dtype=np.uint64)
    for at in range(0, max(len(text), 1), BLOCK):
        c = code_points(text[at : at + BLOCK].lower()).astype(np.uint64)
        c[~letters[c]] = SPACE
        if at + BLOCK >= len(text):
            c = np.append(c, np.uint64(SPACE))
        c = np.concatenate([carry, c])
        c = c[np.append(True, (c[1:] != SPACE) | (c[:-1] != SPACE))] if len(c) else c
        carry = c[-(n - 1) :] if len(c) >= n - 1 else np.concatenate([np.full(n - 1 - len(c), SPACE, dtype=np.uint64), c])
        if len(c) < n:
            continue
        h = np.zeros(len(c) - n + 1, dtype=np.uint64)
        for i in range(n):
            h = (h * np.uint64(0x100000001B3)) ^ c[i : len(c) - n + 1 + i]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        out += np.bincount((h % np.uint64(dims)).astype(np.int64), minlength=dims)
    return out


_PRIME = 0x100000001B3


def word_hashes(blocks):
    """Arrays of 64-bit hashes of the words of a text that comes in blocks: (code points or bytes, where they are separators).

    A word may reach over any number of blocks.
    """
    before, length = np.uint64(0), 0  # of the word that the last block left open
    with np.errstate(over="ignore"):
        for c, space in blocks:
            if not len(c):
                continue
            inside = ~space
            start = inside & np.append(True, space[:-1])
            at = np.flatnonzero(start)
            if length and space[0]:
                yield mix64(np.array([before]))
                length = 0
            if not len(at):
                continue
            word = np.cumsum(start) - 1
            place = np.where(inside, np.arange(len(c)) - at[np.maximum(word, 0)], 0)
            power = np.ones(int(place.max()) + 1, dtype=np.uint64)
            power[1:] = np.cumprod(np.full(len(power) - 1, _PRIME, dtype=np.uint64))
            sums = np.add.reduceat(np.where(inside, (c.astype(np.uint64) + np.uint64(1)) * power[place], np.uint64(0)), at)
            carried = length if start[0] else 0
            if carried:
                sums[0] = before + sums[0] * np.uint64(pow(_PRIME, carried, 2**64))
            length = 0
            if inside[-1]:
                before, length = sums[-1], len(c) - int(at[-1]) + (carried if len(at) == 1 else 0)
                sums = sums[:-1]
            yield mix64(sums)
        if length:
            yield mix64(np.array([before]))


def joined(arrays) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=np.uint64), *arrays])


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))
