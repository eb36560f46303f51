"""Texts as numpy arrays: code points, character classes and word hashes of many texts at once."""

from __future__ import annotations

from __future__ import annotations

from functools import cache

import numpy as np

SPACE, WORD, OTHER = 0, 1, 2
#: Code points with a class and a lower-case form of their own; those above count as word characters.
TABLED = 0x20000


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: class, is-letter, lower case (itself where that is not one character), is-upper."""
    chars = [chr(c) for c in range(TABLED)]
    kind = np.array([SPACE if c.isspace() or c == "\0" else WORD if c.isalnum() else OTHER for c in chars], np.uint8)
    letter = np.array([c.isalpha() for c in chars], bool)
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars], np.uint32)
    upper = np.array([c.isupper() for c in chars], bool)
    return kind, letter, lower, upper


def code_points(texts: list[str], joint: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by ``joint``, and the start of each text (with the end as last item)."""
    points = np.frombuffer((joint.join(texts) + joint).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return points, starts


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=False) ^ np.uint64(salt)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def powers() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words:
    """Runs of word characters and runs of other visible characters of many texts.

    ``text``: index of the run's text; ``hash``: 64 bits of the lower-cased run; ``kind``; ``length``; ``capital``: no lower-case letter
    in a run of two or more letters. With ``by_space`` a run is everything between white space.
    """

    def __init__(self, texts: list[str], by_space: bool = False, prefixes: tuple[int, ...] = ()):
        kind, _, lower, upper = tables()
        points, starts = code_points(texts)
        low = np.minimum(points, TABLED - 1)
        classes = kind[low]
        classes[points >= TABLED] = WORD
        if by_space:
            np.minimum(classes, WORD, out=classes)
        turn = np.flatnonzero(np.diff(classes, prepend=np.uint8(SPACE)))
        ends = np.append(turn[1:], len(points))
        seen = classes[turn] != SPACE
        begin, end = turn[seen], ends[seen]
        self.begin, self.length, self.kind = begin, end - begin, classes[begin]
        self.text = np.searchsorted(starts, begin, side="right") - 1
        self.starts = starts
        small = np.where(points < TABLED, lower[low], points).astype(np.uint64)
        runs = np.append(turn, len(points)) if len(turn) and turn[0] == 0 else np.concatenate([[0], turn, [len(points)]])
        within = np.arange(len(points)) - np.repeat(runs[:-1], np.diff(runs))
        values = mix(small + np.uint64(1)) * powers()[within & 63]
        values *= np.uint64(2) * (within >> 6).astype(np.uint64) + np.uint64(1)
        cuts = np.stack([begin, end], 1).ravel()
        self.hash = mix(self._sums(values, cuts), 7)
        self.prefix = {}
        for n in prefixes:
            short = np.minimum(begin + n, end)
            self.prefix[n] = np.where(self.length > n, mix(self._sums(values, np.stack([begin, short], 1).ravel()), 100 + n), np.uint64(0))
        capital = upper[low] & (points < TABLED)
        self.capital = (self.length > 1) & (self.kind == WORD) & (self._sums(capital.astype(np.int64), cuts) == self.length)

    @staticmethod
    def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Sums over [cuts[0], cuts[1]), [cuts[2], cuts[3]), ...; every range is non-empty and ends before the last separator."""
        return np.add.reduceat(values, cuts)[::2] if len(cuts) else values[:0]

    def only(self, keep: np.ndarray) -> Words:
        """These runs without those that are not kept."""
        for name in ("begin", "length", "kind", "text", "hash", "capital"):
            setattr(self, name, getattr(self, name)[keep])
        self.prefix = {n: v[keep] for n, v in self.prefix.items()}
        return self

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every run of ``n`` neighbouring words; a text of fewer words, but some, is one shingle."""
        count = len(self.hash)
        if not count:
            return self.text, self.hash
        size = np.bincount(self.text, minlength=len(self.starts) - 1)
        first = np.cumsum(size) - size
        place = np.arange(count) - first[self.text]
        rest = size[self.text] - place
        total = np.zeros(count, np.uint64)
        for k in range(min(n, count)):
            part = mix(self.hash[k:], 1000 + k)
            total[: count - k] += np.where(rest[: count - k] > k, part, np.uint64(0))
        keep = (rest >= n) | ((place == 0) & (size[self.text] < n))
        return self.text[keep], mix(total[keep], 13)
