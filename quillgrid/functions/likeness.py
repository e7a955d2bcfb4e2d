"""fuzzy's likeness for all pairs of a page's texts at once: what can't reach a limit is told by shared words, by lengths and
by how often each character stands, and what has been compared is remembered for as many texts as a table holds."""

from __future__ import annotations

import numpy as np

from .fuzzy import CHARS, PART, TOKENS, common, partial_ratio, token_set_ratio

#: Texts that a table remembers, and classes of characters counted.
TEXTS, CLASSES = 2048, 64
#: Likeness below this isn't worked out unless asked for: stands for a pair that was found to be less.
LEAST, LESS = 75.0, -1.0
_SLACK = 1e-6


class Likeness:
    """Numbers for texts, and likeness by pairs of them."""

    def __init__(self, most: int = TEXTS):
        self.most, self.numbers = most, {}
        self.norms, self.words = [], []
        self.length, self.joined = np.zeros(most, np.int64), np.zeros(most, np.int64)
        self.counts = np.zeros((most, CLASSES), np.int32)
        self.tokens, self.parts = np.full((most, most), np.nan), np.full((most, most), np.nan)

    def of(self, norms: list[str]) -> np.ndarray:
        """The texts' numbers. Those given before hold until the table is full: then all are forgotten."""
        new = {s for s in norms if s not in self.numbers}
        if len(self.numbers) + len(new) > self.most:
            self.__init__(max(TEXTS, len(set(norms))))
            new = set(norms)
        for s in norms:
            if s in new:
                new.discard(s)
                i = self.numbers[s] = len(self.norms)
                words = set(s.split())
                self.norms.append(s)
                self.words.append(words)
                self.length[i], self.joined[i] = len(s), sum(map(len, words)) + len(words) - 1
                self.counts[i] = np.bincount(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) % CLASSES, minlength=CLASSES)
        return np.array([self.numbers[s] for s in norms], np.int64)

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """At most so many characters are common to texts i and j."""
        return np.minimum(self.counts[i], self.counts[j]).sum(axis=1)

    def exact(self, i: int, j: int) -> float:
        """token_set_ratio."""
        if not self.tokens[i, j] >= 0:
            self.tokens[i, j] = self.tokens[j, i] = token_set_ratio(self.norms[i], self.norms[j])
        return float(self.tokens[i, j])

    def token_sets(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """token_set_ratio of each of rows with each of columns where it is LEAST or more, else that or LESS."""
        found = self.tokens[np.ix_(rows, columns)]
        r, c = np.nonzero(np.isnan(found))
        if not len(r):
            return found
        pairs = np.unique(np.sort(np.stack([rows[r], columns[c]], axis=1), axis=1), axis=0)
        can = 200.0 * self.shared(pairs[:, 0], pairs[:, 1]) >= (LEAST - _SLACK) * (self.joined[pairs[:, 0]] + self.joined[pairs[:, 1]])
        for (i, j), alike in zip(pairs.tolist(), can.tolist(), strict=True):
            # without common words the ratio of the joined words counts; with them also those with the common ones alone
            if alike or not self.words[i].isdisjoint(self.words[j]):
                self.exact(i, j)
            else:
                self.tokens[i, j] = self.tokens[j, i] = LESS
        return self.tokens[np.ix_(rows, columns)]

    def partial(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """partial_ratio of texts i and j, pair by pair, the first one the shorter if they are as long, where it is PART or
        more, else LESS."""
        found = self.parts[i, j]
        for a, b in {(a, b) for a, b in zip(i[np.isnan(found)].tolist(), j[np.isnan(found)].tolist(), strict=True)}:
            self.parts[a, b] = self._part(a, b)
        return self.parts[i, j]

    def _part(self, a: int, b: int) -> float:
        short, long = sorted((self.norms[a], self.norms[b]), key=len)
        # a window of up to n characters holds at most what is common to both texts
        least = PART / (200.0 - PART) * len(short) - _SLACK
        if self.shared(np.array([a]), np.array([b]))[0] < least or (short not in long and common(short, long) < least):
            return LESS
        part = partial_ratio(short, long)
        return part if part >= PART else LESS

    def alike(self, rows: np.ndarray, columns: np.ndarray, together: np.ndarray, region: np.ndarray) -> np.ndarray:
        """fuzzy.alike of blocks of texts rows with blocks of texts columns, 0 for None; together: whether they are near;
        region: whether they are of one region."""
        full = (self.length[rows] > 0)[:, None] & (self.length[columns] > 0)[None, :]
        same = rows[:, None] == columns[None, :]
        tokens = self.token_sets(rows, columns)
        score = np.where((together | region) & (tokens >= TOKENS), tokens, 0.0)
        long = np.minimum(self.length[rows][:, None], self.length[columns][None, :]) >= CHARS
        r, c = np.nonzero(full & together & long & ~same & (score == 0))
        if len(r):
            # a contained text is a part of 100
            score[r, c] = np.maximum(self.partial(rows[r], columns[c]), 0.0)
        return np.where(full, np.where(same, 100.0, score), 0.0)


def near(x1, y1, x2, y2) -> np.ndarray:
    """geometry.near of each box with each."""
    least, most = (lambda v: np.minimum(v[:, None], v[None, :])), (lambda v: np.maximum(v[:, None], v[None, :]))
    wide, tall = np.maximum(0.0, x2 - x1), np.maximum(0.0, y2 - y1)
    area = wide * tall
    dx, dy = np.maximum(0.0, least(x2) - most(x1)), np.maximum(0.0, least(y2) - most(y1))
    both = dx * dy
    over = both > 0.12 * (area[:, None] + area[None, :] - both)
    gap = np.maximum(0.0, most(x1) - least(x2))
    beside = (dy > 0.35 * np.maximum(1.0, least(tall))) & (gap < 0.5 * most(wide))
    off = lambda a, b: np.abs((a + b)[:, None] - a[None, :] - b[None, :]) / 2
    return over | beside | ((off(x1, x2) < 0.6 * most(wide)) & (off(y1, y2) < 0.6 * most(tall)))


def overlap(x1, y1, x2, y2) -> np.ndarray:
    """Common area by joint area of each box with each."""
    w = np.minimum(x2[:, None], x2[None, :]) - np.maximum(x1[:, None], x1[None, :])
    h = np.minimum(y2[:, None], y2[None, :]) - np.maximum(y1[:, None], y1[None, :])
    area = np.maximum(0.0, x2 - x1) * np.maximum(0.0, y2 - y1)
    joint = area[:, None] + area[None, :] - w * h
    return np.where((w > 0) & (h > 0) & (joint > 0), w * h / np.where(joint > 0, joint, 1.0), 0.0)
