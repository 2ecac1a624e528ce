"""Texts as arrays: the code points of many texts at once, their words and the words' hashes."""

from __future__ import annotations

from functools import cache, cached_property

import numpy as np

SPACE, LETTER, DIGIT, SYMBOL, OTHER = range(5)
UPPER = 8  # added to LETTER
SYMBOLS = "#*$%&|<>@^~_=+\\/{}[]"
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def classes() -> np.ndarray:
    """The kind of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            out[k] = LETTER + UPPER * c.isupper()
        elif c.isnumeric():
            out[k] = DIGIT
        elif c.isspace():
            out[k] = SPACE
    out[[ord(c) for c in SYMBOLS]] = SYMBOL
    return out


@cache
def ascii_space() -> np.ndarray:
    """Of every code point whether it is \\x20 or \\x09-\\x0D."""
    out = np.zeros(0x110000, bool)
    out[[32, 9, 10, 11, 12, 13]] = True
    return out


@cache
def values() -> np.ndarray:
    """A random 64-bit number for every code point."""
    return np.random.default_rng(2024).integers(1, 1 << 63, 0x110000, dtype=np.uint64)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and its inverse modulo 2 ** 64, for k under n at least."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, b in ((0, BASE), (1, BACK)):
                x = np.full(n + n // 8, b, np.uint64)
                x[0] = 1
                _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


def prefix_sums(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the first 0, 1, 2 ... codes, each times BASE ** its place, and the inverse powers."""
    up, down = powers(len(code) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.multiply(code, up[: len(code)], out=sums[1:])
        np.cumsum(sums[1:], out=sums[1:])
    return sums, down


class Hasher:
    """Hashes of any ranges of an array of code points (or of other numbers under 0x110000), in constant time each."""

    def __init__(self, x: np.ndarray):
        self.sums, self.down = prefix_sums(values().take(x))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[end] - self.sums[start]) * self.down[start]
            return h ^ (h >> np.uint64(29))


def word_hash(word: str) -> int:
    """The hash that Hasher gives for this word."""
    x = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    return int(Hasher(x)(np.array([0]), np.array([len(x)]))[0])


class Texts:
    """x: code points of all texts, each followed by a line end; begin: where each text begins; start, end: its words."""

    def __init__(self, texts: list[str], spaces: str = "unicode"):
        self.n = len(texts)
        self.x = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.begin = np.cumsum(size) - size
        inside = (self.x != 32) & (self.x - np.uint32(9) > 4) if spaces == "ascii" else (self.kind & 7) == LETTER if spaces == "letters" else self.kind != SPACE
        self.split(inside)

    @cached_property
    def kind(self) -> np.ndarray:
        return classes()[self.x]

    def split(self, inside: np.ndarray) -> None:
        """Words are the runs of code points that are ``inside``."""
        edge = inside.copy()
        np.not_equal(inside[1:], inside[:-1], out=edge[1:])
        edge = np.flatnonzero(edge)
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.begin)  # of each text
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.own = np.repeat(np.arange(self.n), self.count)

    def hasher(self) -> Hasher:
        return Hasher(self.x)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many code points of each text are in ``mask``."""
        return np.add.reduceat(mask.astype(np.int64), self.begin) if self.n else np.zeros(0, np.int64)

    def per_word(self, mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return c[self.end] - c[self.start]
