"""A run-length grammar by recompression, and longest common extensions on it.

Rounds alternate. Block compression replaces every maximal block of one symbol by one
symbol; pair compression divides the alphabet in two halves, by a hash of the symbol, and
replaces every pair of a symbol of the left half and one of the right. Both decide from
the symbols at hand alone, so equal stretches become equal symbols except at their edges.
Rounds end when no symbol is left twice.

``extension`` compares two positions by climbing: where either stands inside a block or a
pair, the lower symbols are compared (one step puts both at an edge); then both move up.
The first difference is carried down again to the words. All queries move together, level
by level, as numpy arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Level:
    """A sequence of symbols, and how it is grouped into the next one."""

    symbols: np.ndarray
    first: np.ndarray | None = None  # of each group: its first symbol
    size: np.ndarray | None = None
    up: np.ndarray | None = None  # of each symbol: its group
    blocks: bool = True  # groups are blocks of one symbol, else pairs and single symbols

    def mirrored(self) -> Level:
        if self.up is None:
            return Level(np.ascontiguousarray(self.symbols[::-1]))
        n, groups = len(self.symbols), len(self.first)
        return Level(*(np.ascontiguousarray(a[::-1]) for a in (self.symbols, n - self.first - self.size, self.size,
                                                               groups - 1 - self.up)), self.blocks)


def _left(symbols: np.ndarray, salt: int) -> np.ndarray:
    h = (symbols.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)) & np.uint64(1) > 0


def _grouped(symbols: np.ndarray, begins: np.ndarray, blocks: bool) -> Level:
    first = np.flatnonzero(begins)
    return Level(symbols, first, np.diff(np.append(first, len(symbols))), np.cumsum(begins) - 1, blocks)


class Grammar:
    """Grammar of a sequence whose first and last symbols occur nowhere else in it."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[Level] = []
        #: Rules of the new symbols: (symbol, left, right) of a pair, (symbol, symbol below, repeats) of a block.
        self.rules: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]] = []
        now = symbols.astype(np.int64)
        fresh, salt = int(now.max(initial=0)) + 1, 0
        while salt % 3 or len(np.unique(now)) < len(now):  # looked at every third round
            same = now[1:] == now[:-1]
            if same.any():
                level = _grouped(now, np.append(True, ~same), True)
                new, many = now[level.first], np.flatnonzero(level.size > 1)
                fresh = self._replace("block", new, many, new[many], level.size[many], fresh)
                self.levels.append(level)
                now = new
            left = _left(now, salt)
            salt += 1
            pair = np.append(left[:-1] & ~left[1:], False)
            if pair.any():
                level = _grouped(now, ~np.append(False, pair[:-1]), False)
                new, at = now[level.first], np.flatnonzero(pair)
                fresh = self._replace("pair", new, np.flatnonzero(level.size > 1), now[at], now[at + 1], fresh)
                self.levels.append(level)
                now = new
        self.levels.append(Level(now))
        self.mirror = [x.mirrored() for x in self.levels]

    def _replace(self, kind: str, new: np.ndarray, where: np.ndarray, a: np.ndarray, b: np.ndarray, fresh: int) -> int:
        """Name the distinct (a, b) from ``fresh`` on and put the names at ``where``."""
        wide = np.int64(b.max(initial=0)) + 1
        keys, nth = np.unique(a * wide + b, return_inverse=True)
        new[where] = fresh + nth.ravel()
        self.rules.append((kind, fresh + np.arange(len(keys)), keys // wide, keys % wide))
        return fresh + len(keys)

    def expand(self) -> np.ndarray:
        """The sequence again, from the top symbols and the rules alone."""
        now = self.levels[-1].symbols
        for kind, names, a, b in reversed(self.rules):
            at = np.clip(now - names[0], 0, len(names) - 1) if len(names) else np.zeros(len(now), np.int64)
            hit = (now >= names[0]) & (now <= names[-1])
            n = np.where(hit, b[at] if kind == "block" else 2, 1)
            out = np.repeat(np.where(hit, a[at], now), n)
            if kind == "pair":
                out[np.cumsum(n)[hit] - 1] = b[at[hit]]
            now = out
        return now

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols agree from i and j on (i < j)."""
        return _first_difference(self.levels, i, j) - i

    def extension_back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols agree up to and with i and j (i < j)."""
        n = len(self.mirror[0].symbols) - 1
        return _first_difference(self.mirror, n - i, n - j) - (n - i)


def _first_difference(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Where, counted from i's side, the symbols from i and j on first differ."""
    x, y = np.array(i, np.int64), np.array(j, np.int64)
    alive = np.arange(len(x))
    differ: list[np.ndarray] = []  # by level: the queries whose difference was met there
    for level in levels:
        a, b = x[alive], y[alive]
        same = level.symbols[a] == level.symbols[b]
        done = [alive[~same]]
        alive, a, b = alive[same], a[same], b[same]
        if level.up is not None and len(alive):
            p, q = level.up[a], level.up[b]
            inside = (a > level.first[p]) | (b > level.first[q])
            left_x = level.first[p] + level.size[p] - a
            left_y = level.first[q] + level.size[q] - b
            step = np.where(inside, np.minimum(left_x, left_y), 0)
            # one of the two stands at a group's edge after the step; unless both do, their symbols differ
            a, b = a + step, b + step
            met = (level.first[level.up[a]] < a) | (level.first[level.up[b]] < b)
            x[alive], y[alive] = a, b
            done.append(alive[met])
            alive, a, b = alive[~met], a[~met], b[~met]
            x[alive], y[alive] = level.up[a], level.up[b]
        differ.append(np.concatenate(done))
        if not len(alive):
            break
    if len(alive):
        raise ValueError("the top of the grammar holds a symbol twice")
    down = differ[-1]
    for k in range(len(differ) - 2, -1, -1):
        level = levels[k]
        p, q = x[down], y[down]
        a, b = level.first[p], level.first[q]
        same = level.symbols[a] == level.symbols[b]
        step = np.minimum(level.size[p], level.size[q]) if level.blocks else 1
        x[down], y[down] = a + same * step, b + same * step
        down = np.concatenate([down, differ[k]])
    return x
