"""Pairs of texts whose Ratcliff/Obershelp ratio (difflib's) reaches a threshold.

A ratio is 2 * M / S: M characters in matching blocks of texts of S characters in
all.  Three bounds rule pairs out, cheapest first:

* lengths: the shorter text holds M at most, so lengths differ by (2 - t) / t at most
  and are in the same or neighbouring *steps*;
* letters: M is at most what the two texts have in common of each character, and, as
  blocks keep their order, at most what the first half of one has in common with some
  start of the other and the second half with the rest;
* grams: blocks are at most one more than there are unmatched characters; in a second
  text of 200 characters or more difflib starts blocks only from characters that are
  rare in it (and one block at the start), which bounds them much better.  All but
  q - 1 of a block's characters start a q-gram that both texts have.

Counts are of hashed characters and grams, which can only raise what is in common.
The longest common subsequence, from bits, is the last bound before difflib itself.
Pairs are ruled out many at a time, by ands of bits (one for each of a bin's first
few): letters of short texts, letters of halves of longer ones, runs of four
characters where difflib starts few blocks; then common subsequences of hashed letters.

Texts of a group are dealt into tiles: pairs of chunks of neighbouring steps with a
bounded number of rows and characters.  A tile compares in numpy what passes the
bounds and returns a spanning forest or its best few, never a list of all pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from difflib import SequenceMatcher
from functools import cached_property
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS, CHARACTERS = 4096, 4_000_000  # of a chunk
TILE = ("s", "c", "u", "d")  # step and chunk of the first and of the second side
_LETTERS, _GRAMS, _FINE, _CELLS, _JUNKED, _LONG = 64, 256, 2048, 16, 200, 20_000
_SHORT, _FINELY, _HALVED, _WORDS = 40, 150, 600, 5  # lengths of short texts, of those that are cut finely, of none that is compared by halves; words of bits of one whose subsequences are bits
_HALF_BITS, _MOST_BITS = 128, 16_384  # of half a text's letters, of a text's grams
_ROWS, _WINDOW, _PAIRS = 64, 1024, 8192  # rows and pairs that are compared at once


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: one row of bits for each character of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


class Texts:
    """What the bounds need of some texts, row by row."""

    def __init__(self, texts: list[str], fine: bool = True):
        self.texts, self.finely = texts, fine
        self.size = np.array([len(t) for t in texts], np.int64)
        self.code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.owner = np.repeat(np.arange(len(texts)), self.size)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self._made: dict = {}

    @cached_property
    def two(self) -> np.ndarray:
        return self.code[:-1] * np.uint64(0x10FFFF) + self.code[1:]

    @cached_property
    def four(self) -> np.ndarray:
        return self.two[:-2] * np.uint64(0x9E3779B97F4A7C15) + self.two[2:]

    @cached_property
    def letters(self) -> np.ndarray:
        return self._counts(self.code, self.owner, _LETTERS, len(self))

    @cached_property
    def pairs(self) -> np.ndarray:
        return self._counts(self.two, self.owner[:-1], _GRAMS, len(self), self.owner[:-1] == self.owner[1:])

    @cached_property
    def fours(self) -> np.ndarray:
        return self._counts(self.four, self.owner[:-3], _GRAMS, len(self), self.owner[:-3] == self.owner[3:])

    @cached_property
    def fine(self) -> np.ndarray:
        return self._counts(self.four, self.owner[:-3], _FINE, len(self), self.owner[:-3] == self.owner[3:])

    @cached_property
    def upto(self) -> np.ndarray:
        """Letters before each of the cells' edges."""
        cell = (np.arange(len(self.code)) - self.start[self.owner]) * _CELLS // np.maximum(self.size, 1)[self.owner]
        upto = self._counts(self.code, self.owner * _CELLS + cell, _LETTERS, len(self) * _CELLS).reshape(len(self), _CELLS, _LETTERS)
        return np.concatenate([np.zeros((len(self), 1, _LETTERS), np.float32), np.cumsum(upto, axis=1)], axis=1)

    @cached_property
    def starts(self) -> np.ndarray:
        """Most blocks that difflib can find in a second text by where it starts them; -1 where that is not limited."""
        out = np.full(len(self), -1, np.int64)
        some = np.flatnonzero(self.size >= _JUNKED)
        if not len(some):
            return out
        if len(self.code) < 100_000:
            letters, letter = np.unique(self.code, return_inverse=True)
        else:
            held = np.zeros(0x110000, bool)
            held[self.code.astype(np.int64)] = True
            letters = np.flatnonzero(held)
            letter = (np.cumsum(held, dtype=np.int32) - 1)[self.code.astype(np.int64)]
        n = len(letters)
        for rows in np.array_split(some, -(-len(some) * n // 4_000_000)):
            of = np.concatenate([letter[self.start[r] : self.start[r] + self.size[r]] for r in rows])
            counts = np.bincount(np.repeat(np.arange(len(rows)), self.size[rows]) * n + of, minlength=len(rows) * n).reshape(len(rows), n)
            out[rows] = 1 + np.where(counts <= self.size[rows, None] // 100 + 1, counts, 0).sum(axis=1)
        return out

    def some(self, rows: np.ndarray) -> Texts:
        """Those rows alone."""
        out = Texts([self.texts[k] for k in rows])
        out.starts = self.starts[rows]
        return out

    @cached_property
    def letter_bits(self) -> tuple[np.ndarray, np.ndarray]:
        return _unary(self.letters, 4)

    @cached_property
    def pair_bits(self) -> tuple[np.ndarray, np.ndarray]:
        return _unary(self.pairs, 2)

    @cached_property
    def by_size(self) -> np.ndarray:
        return np.argsort(self.size, kind="stable")

    @cached_property
    def bins(self) -> np.ndarray:
        """Bins of a text's letters, place by place, where words of bits hold it; a bin that no letter has after its end."""
        some = self.size[self.owner] <= _WORDS * 64
        at = self.owner[some]
        out = np.full((len(self), _WORDS * 64), _LETTERS, np.int64)
        out[at, np.flatnonzero(some) - self.start[at]] = self._bin(self.code[some], _LETTERS)
        return out

    @cached_property
    def places(self) -> np.ndarray:
        """Bits of the places where a text has letters of a bin, where words of bits hold it."""
        some = self.size[self.owner] <= _WORDS * 64
        at, place = self.owner[some], np.flatnonzero(some) - self.start[self.owner[some]]
        out = np.zeros(len(self) * (_LETTERS + 1) * _WORDS, np.uint64)
        np.add.at(out, (at * (_LETTERS + 1) + self._bin(self.code[some], _LETTERS)) * _WORDS + place // 64, np.uint64(1) << (place % 64).astype(np.uint64))
        return out

    def four_bits(self, bins: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs of four characters as bits, word by word; and how many there are besides."""
        if ("fours", bins) not in self._made:
            whole = self.owner[:-3] == self.owner[3:]
            key = self.owner[:-3][whole] * bins + self._bin(self.four[whole], bins)
            held = np.zeros(len(self) * bins, bool)
            held[key] = True
            words = np.packbits(held).view(np.uint64).reshape(len(self), -1)
            over = np.maximum(self.size - 3, 0) - np.bitwise_count(words).sum(axis=1)
            self._made["fours", bins] = words.T.copy(), over.astype(np.uint16 if self.size.max(initial=0) < 40_000 else np.uint32)
        return self._made["fours", bins]

    def cells(self, n: int) -> np.ndarray:
        """Letters before each of so many cells' edges, of texts that may be compared by halves; none of longer ones."""
        if n not in self._made:
            some = np.repeat(self.size < _HALVED, self.size)
            owner = self.owner[some]
            cell = (np.flatnonzero(some) - self.start[owner]) * n // self.size[owner]
            each = self._counts(self.code[some], owner * n + cell, _LETTERS, len(self) * n).astype(np.int16).reshape(len(self), n, _LETTERS)
            self._made[n] = np.concatenate([np.zeros((len(self), 1, _LETTERS), np.int16), np.cumsum(each, axis=1, dtype=np.int16)], axis=1)
        return self._made[n]

    @cached_property
    def _levels(self) -> tuple[np.ndarray, np.ndarray]:
        """The letters and counts in half a text that tell texts apart best."""
        half = self.cells(_CELLS)[self.size < _HALVED, _CELLS // 2]
        held = (half[:, None, :] > np.arange(32)[:, None]).mean(axis=0) if len(half) else np.zeros((32, _LETTERS))
        level, letter = np.unravel_index(np.argsort(-(held * (1 - held)).ravel(), kind="stable")[:_HALF_BITS], held.shape)
        return letter, level

    def levels(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of letters as bits of those levels, word by word; and how many letters are not among them."""
        letter, level = self._levels
        held = np.ascontiguousarray(counts[:, letter] > level)
        over = np.minimum(counts.sum(axis=1) - held.sum(axis=1), 255).astype(np.uint8)
        return np.packbits(held, axis=1).view(np.uint64).T.copy(), over

    def cut(self, n: int, cell: int | None, by: Texts) -> tuple:
        """Bits of what is before a cut in a cell, and of what is behind it, or of both halves; by says which levels."""
        key = n, cell, by is self
        if key not in self._made:
            upto = self.cells(n)
            before, behind = (n // 2, n // 2) if cell is None else (cell + 1, cell)
            self._made[key] = by.levels(upto[:, before]), by.levels(upto[:, n] - upto[:, behind])
        return self._made[key]

    @staticmethod
    def _bin(code: np.ndarray, bins: int) -> np.ndarray:
        return ((code * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)

    @staticmethod
    def _counts(code, owner, bins: int, n: int, where=None) -> np.ndarray:
        key = owner * bins + Texts._bin(code, bins)
        return np.bincount(key if where is None else key[where], minlength=n * bins).reshape(n, bins).astype(np.float32)

    def ordered(self, i: int, other: Texts, at: np.ndarray) -> np.ndarray:
        """Most that row i can have in common with rows of other, the halves of either in order."""
        mine = self.upto[i]
        out = np.zeros(len(at), np.float32)
        for k in range(0, len(at), 512):
            upto = other.upto[at[k : k + 512]]
            out[k : k + 512] = np.minimum(_halved(upto, mine[_CELLS // 2], mine[_CELLS]), _halved(mine[None], upto[:, _CELLS // 2, None], upto[:, _CELLS, None]))
        return out

    def __len__(self) -> int:
        return len(self.texts)


def _halved(edges: np.ndarray, half: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Best over all cells that the end of the first half may fall in; edges: letters before each edge of the other text's cells."""
    ones = np.ones(_LETTERS, np.float32)
    before = np.minimum(edges[:, 1:], half) @ ones
    after = np.minimum(edges[:, -1:] - edges[:, :-1], whole - half) @ ones
    return (before + after).max(axis=1)


def possible(x: Texts, i: int, y: Texts, at: np.ndarray, threshold: float) -> np.ndarray:
    """Those rows of y that may resemble row i of x, in either order."""
    total = x.size[i] + y.size[at]
    need = np.ceil(threshold * total / 2 - 1e-9)
    keep = np.minimum(x.size[i], y.size[at]) >= need
    at, total, need = at[keep], total[keep], need[keep]
    ones = np.ones(_LETTERS, np.float32)
    keep = np.minimum(y.letters[at], x.letters[i]) @ ones >= need
    at, total, need = at[keep], total[keep], need[keep]
    if not len(at):
        return at
    free = total - 2 * need + 1
    blocks = lambda s: np.where(s < 0, free, np.minimum(free, s))
    most = np.maximum(blocks(np.full(len(at), x.starts[i])), blocks(y.starts[at]))
    ones = np.ones(_GRAMS, np.float32)
    keep = (np.minimum(y.pairs[at], x.pairs[i]) @ ones >= need - most) & (np.minimum(y.fours[at], x.fours[i]) @ ones >= need - 3 * most)
    at, need, most = at[keep], need[keep], most[keep]
    keep = (x.ordered(i, y, at) >= need) if len(at) else np.zeros(0, bool)
    at, need, most = at[keep], need[keep], most[keep]
    if not x.finely or not len(at):
        return at
    limited = np.flatnonzero(need > 3 * most)
    few = np.minimum(y.fine[at[limited]], x.fine[i]) @ np.ones(_FINE, np.float32) < (need - 3 * most)[limited]
    return np.delete(at, limited[few])


def near(x: Texts, y: Texts, one: bool, threshold: float, wanted):
    """Rows (i, j) of x and y, some at a time, of pairs that may resemble each other in either order; all others don't.

    one: x is y, and each pair of two rows comes once.  wanted(i, j) says which pairs
    are asked for, before they are compared.  Blocks of rows go against all rows of
    fitting length: short ones by their letters, pairs of which difflib may start blocks
    anywhere by the letters of halves, others by grams; what is left is compared closer.
    """
    sizes, shortest = y.size[y.by_size], threshold / (2 - threshold)
    if _JUNKED / shortest + 2 > _HALVED:  # halves know only texts below that length
        for i in range(len(x)):
            rest = np.arange(i + 1, len(x)) if one else np.arange(len(y))
            at = possible(x, i, y, rest[wanted(np.full(len(rest), i), rest)], threshold)
            yield np.full(len(at), i), at
        return
    need = np.ceil(threshold * np.arange(int(x.size.max(initial=0) + y.size.max(initial=0)) + 1) / 2 - 1e-9).astype(np.int64)
    left: dict = {_short: [], _halves: [], _grams: []}
    closer = {_short: _pairs, _halves: _halves_back, _grams: _finer}
    many = {_short: _PAIRS, _halves: _PAIRS, _grams: 8 * _PAIRS}

    def compared(kind):
        i, j = (np.concatenate(part) for part in zip(*left[kind]))
        left[kind] = []
        for c in range(0, len(i), many[kind]):
            p, q = i[c : c + many[kind]], j[c : c + many[kind]]
            some = wanted(p, q)
            p, q = p[some], q[some]
            if len(p):
                yield closer[kind](x, p, y, q, need, threshold)

    for k in range(0, len(x), _ROWS):
        block = x.by_size[k : k + _ROWS]
        own = x.size[block]
        for low, high in ((0, _SHORT), (_SHORT + 1, _JUNKED - 1), (_JUNKED, int(own[-1]))):
            rows = block[slice(*np.searchsorted(own, [low, high + 1]))]
            if not len(rows):
                continue
            first, end = int(x.size[rows[0]]) if one else int(x.size[rows[0]] * shortest), int(x.size[rows[-1]] / shortest) + 2
            if high == _SHORT or high == _JUNKED - 1:
                parts = ((_short if high == _SHORT else _halves, first, end),)
            else:
                parts = ((_halves, first, min(end, _JUNKED)), (_grams, max(first, _JUNKED), end))
            for kind, first, end in parts:
                for at in range(*np.searchsorted(sizes, [first, max(first, end)]), _WINDOW):
                    its = y.by_size[at : min(at + _WINDOW, int(np.searchsorted(sizes, end)))]
                    i, j = np.nonzero(kind(x, rows, y, its, need, threshold))
                    i, j = rows[i], its[j]
                    keep = wanted(i, j)
                    if one:
                        keep &= (y.size[j] > x.size[i]) | ((y.size[j] == x.size[i]) & (j > i))
                    left[kind].append((i[keep], j[keep]))
                if sum(len(i) for i, _ in left[kind]) >= many[kind]:
                    yield from compared(kind)
    for kind, some in left.items():
        if some:
            yield from compared(kind)


def _short(x: Texts, rows: np.ndarray, y: Texts, its: np.ndarray, need: np.ndarray, threshold: float) -> np.ndarray:
    """Letters, as bits."""
    some = np.minimum(x.letter_bits[1][rows, None], y.letter_bits[1][None, its])
    _common(some, x.letter_bits[0][:, rows], y.letter_bits[0][:, its])
    return some >= need[x.size[rows][:, None] + y.size[its]]


def _pairs(x: Texts, i: np.ndarray, y: Texts, j: np.ndarray, need: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    least = need[x.size[i] + y.size[j]]
    some = np.minimum(x.pair_bits[1][i], y.pair_bits[1][j]).astype(np.int64)
    for mine, its in zip(x.pair_bits[0], y.pair_bits[0]):
        some += np.bitwise_count(mine[i] & its[j])
    keep = some >= least - (x.size[i] + y.size[j] - 2 * least + 1)
    return _nearer(x, i[keep], y, j[keep], need)


def _cuts(n: int, shortest: int, threshold: float) -> range:
    """Cells of so many in which a text may be cut where the other one has its half: both lose few characters on either side."""
    lost = (1 - threshold) / 2 * (2 - threshold) / threshold
    return range(max(0, int(n * (threshold / 2 - lost))), min(n - 1, int(n * (1 - threshold / 2 + lost + 1 / max(1, shortest)))) + 1)


def _halves(x: Texts, rows: np.ndarray, y: Texts, its: np.ndarray, need: np.ndarray, threshold: float) -> np.ndarray:
    """Letters of a row's first half with some start of the other text, those of its second half with the rest."""
    n = _CELLS if x.size[rows[0]] < _FINELY else 2 * _CELLS
    best = np.zeros((len(rows), len(its)), np.uint8)
    for cell in _cuts(n, int(y.size[its[0]]), threshold):
        both = np.zeros_like(best)
        for (bits, over), (held, above) in zip(x.cut(n, None, y), y.cut(n, cell, y)):
            both += np.minimum(over[rows, None], above[None, its])
            _common(both, bits[:, rows], held[:, its])
        np.maximum(best, both, out=best)
    return best >= need[x.size[rows][:, None] + y.size[its]]


def _halves_back(x: Texts, i: np.ndarray, y: Texts, j: np.ndarray, need: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The other text's halves with starts and rests of the row."""
    n = 2 * _CELLS
    best = np.zeros(len(i), np.uint8)
    for cell in _cuts(n, int(x.size[i].min()), threshold):
        both = np.zeros_like(best)
        for (bits, over), (held, above) in zip(y.cut(n, None, y), x.cut(n, cell, y)):
            both += np.minimum(over[j], above[i])
            for mine, its in zip(held, bits):
                both += np.bitwise_count(mine[i] & its[j])
        np.maximum(best, both, out=best)
    keep = best >= need[x.size[i] + y.size[j]]
    return _nearer(x, i[keep], y, j[keep], need)


def _few(x: Texts, i: np.ndarray, y: Texts, j: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Least number of runs of four characters that pairs of long texts have in common."""
    total = x.size[i] + y.size[j]
    return need[total] - 3 * np.minimum(total - 2 * need[total] + 1, np.maximum(x.starts[i], y.starts[j]))


def _grams(x: Texts, rows: np.ndarray, y: Texts, its: np.ndarray, need: np.ndarray, threshold: float) -> np.ndarray:
    """Runs of four characters of two texts of which difflib starts few blocks."""
    bins = _bins_of(3 * int(x.size[rows[-1]]))
    (mine, over), (held, above) = x.four_bits(bins), y.four_bits(bins)
    some = np.minimum(over[rows, None], above[None, its])
    _common(some, mine[:, rows], held[:, its])
    return some >= _few(x, rows[:, None], y, its[None], need)


def _bins_of(n: int) -> int:
    return min(_MOST_BITS, max(1024, 1 << (n - 1).bit_length()))


def _finer(x: Texts, i: np.ndarray, y: Texts, j: np.ndarray, need: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The same in more bins, then all bounds, of those texts alone."""
    of_x, i = np.unique(i, return_inverse=True)
    of_y, j = np.unique(j, return_inverse=True)
    x, y = x.some(of_x), y.some(of_y)
    bins = _bins_of(12 * int(x.size.max()))
    (mine, over), (held, above) = x.four_bits(bins), y.four_bits(bins)
    some = np.minimum(over[i], above[j]).astype(np.int64)
    for m, h in zip(mine, held):
        some += np.bitwise_count(m[i] & h[j])
    keep = some >= _few(x, i, y, j, need)
    i, j = i[keep], j[keep]
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    out = [(i[:0], j[:0])]
    for c in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else ():
        at = possible(x, i[c[0]], y, j[c], threshold)
        out.append((np.full(len(at), i[c[0]]), at))
    i, j = (np.concatenate(part) for part in zip(*out))
    return of_x[i], of_y[j]


def _common(some: np.ndarray, mine: np.ndarray, its: np.ndarray) -> None:
    """Adds the bits that rows of mine and of its have in common, word by word."""
    both, count = np.empty(some.shape, np.uint64), np.empty(some.shape, np.uint8)
    for m, h in zip(mine, its):
        np.bitwise_and(m[:, None], h[None], out=both)
        np.bitwise_count(both, out=count)
        np.add(some, count, out=some)


def _unary(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bits, one for each up to most of a bin, word by word; and what is above."""
    held = counts[:, None, :] > np.arange(most, dtype=np.float32)[:, None]
    words = np.packbits(held, axis=2).reshape(len(counts), -1).view(np.uint64).T.copy()
    return words, np.minimum(np.maximum(counts - most, 0).sum(axis=1), 30_000).astype(np.uint16)


def _nearer(x: Texts, i: np.ndarray, y: Texts, j: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs of texts that the common subsequence of hashed letters allows.

    It is worked out row by row, in the words of bits that its places may be in; a pair
    is left as soon as a start of the first text has lost more than it may lose.
    """
    order = np.argsort(x.size[i], kind="stable")
    i, j = i[order], j[order]
    least = need[x.size[i] + y.size[j]]
    known = (y.size[j] > _WORDS * 64) | (x.size[i] > _WORDS * 64)
    out = [(i[known], j[known])]
    i, j, least = i[~known], j[~known], least[~known]
    lost, more = x.size[i] - least, y.size[j] - least  # characters that either text may lose
    row = np.full((-(-int(y.size[j].max(initial=1)) // 64), len(i)), 0xFFFFFFFFFFFFFFFF, np.uint64)
    bins, at = x.bins, j * ((_LETTERS + 1) * _WORDS)
    for k in range(int(x.size[i].max(initial=0))):
        if not len(i):
            break
        first, last = max(0, k - int(lost.max())) // 64, min(len(row) - 1, (k + int(more.max())) // 64)
        place, carry = at + bins[i, k] * _WORDS, np.zeros(len(i), bool)
        for w in range(first, last + 1):
            r = row[w]
            hit = r & y.places[place + w]
            new = r + hit
            up = new < r
            new += carry
            carry = up | (new < carry)
            row[w] = new | (r ^ hit)
        if k % 8 == 7:
            keep = _held(row, k + 1 + more) >= np.minimum(k + 1, x.size[i]) - lost
            if not keep.all():
                i, j, least, lost, more, at, row = i[keep], j[keep], least[keep], lost[keep], more[keep], at[keep], row[:, keep]
    keep = _held(row, y.size[j]) >= least
    return np.concatenate([out[0][0], i[keep]]), np.concatenate([out[0][1], j[keep]])


def _held(row: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Zeros among so many first places of each column of words."""
    out = np.zeros(row.shape[1], np.int64)
    for w, r in enumerate(row):
        n = np.clip(places - 64 * w, 0, 64)
        mask = np.where(n >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (n % 64).astype(np.uint64)) - np.uint64(1))
        out += np.bitwise_count(~r & mask)
    return out


def alike(a: str, b: str, threshold: float) -> bool:
    """Whether the ratio in either order may reach the threshold; texts beyond bounds of work count as alike."""
    if max(len(a), len(b)) > _LONG:
        return True
    return common_subsequence(a, b) >= threshold * (len(a) + len(b)) / 2 - 1e-9


# Dealing out


def step_of(text: Column, threshold: float) -> Column:
    return F.floor(F.log(F.greatest(F.length(text), F.lit(1)).cast("double")) / F.log(F.lit((2 - threshold) / threshold)) + 1e-9).cast("int")


def _chunked(rows: DataFrame, group: str, text: str, threshold: float, spread: Column) -> tuple[DataFrame, DataFrame]:
    """rows with step and chunk, and the number of chunks of each group and step."""
    rows = rows.withColumn("_step", step_of(F.col(text), threshold))
    sizes = rows.groupBy(group, "_step").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(ROWS)), F.ceil(F.sum(F.length(text)) / F.lit(CHARACTERS))).cast("int").alias("_of"))
    return rows.join(sizes, [group, "_step"]).withColumn("_chunk", F.pmod(spread, F.col("_of").cast("long")).cast("int")).drop("_of"), sizes


def tiles_within(rows: DataFrame, group: str, text: str, threshold: float, spread: Column) -> DataFrame:
    """rows once for each tile that they are in: its steps and chunks (TILE), and right, whether the row is of its second chunk."""
    rows, sizes = _chunked(rows, group, text, threshold, spread)
    of = lambda by, name: sizes.select(group, (F.col("_step") + by).alias("_step"), F.col("_of").alias(name))
    rows = rows.join(of(0, "_same"), [group, "_step"]).join(of(-1, "_up"), [group, "_step"], "left").join(of(1, "_down"), [group, "_step"], "left")
    tile = lambda s, c, u, d, right: F.struct(s.alias("s"), c.alias("c"), u.alias("u"), d.alias("d"), right.alias("right"))
    step, chunk = F.col("_step"), F.col("_chunk")
    all_of = lambda n: F.when(F.coalesce(F.col(n), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    same = F.transform(all_of("_same"), lambda k: tile(step, F.least(chunk, k), step, F.greatest(chunk, k), chunk > k))
    up = F.transform(all_of("_up"), lambda k: tile(step, chunk, step + 1, k, F.lit(False)))
    down = F.transform(all_of("_down"), lambda k: tile(step - 1, k, step, chunk, F.lit(True)))
    out = rows.withColumn("_t", F.explode(F.concat(same, up, down)))
    return out.select("*", "_t.*").drop("_t", "_same", "_up", "_down", "_step", "_chunk")


def tiles_between(left: DataFrame, right: DataFrame, group: str, text: str, threshold: float, spread: Column) -> DataFrame:
    """left and right rows (the same columns) of a group, once for each tile that they are in, with right."""
    x, of_x = _chunked(left, group, text, threshold, spread)
    y, of_y = _chunked(right, group, text, threshold, spread)
    near = F.explode(F.array(F.col("_step") - 1, F.col("_step"), F.col("_step") + 1))

    def dealt(rows: DataFrame, other: DataFrame, mine: tuple[str, str], its: tuple[str, str], right: bool) -> DataFrame:
        rows = rows.withColumn("_near", near).join(other.select(group, F.col("_step").alias("_near"), "_of"), [group, "_near"])
        rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
        named = {mine[0]: "_step", mine[1]: "_chunk", its[0]: "_near", its[1]: "_k"}
        return rows.select("*", *[F.col(named[c]).alias(c) for c in TILE], F.lit(right).alias("right")).drop("_near", "_of", "_k", "_step", "_chunk")

    return dealt(x, of_y, ("s", "c"), ("u", "d"), False).unionByName(dealt(y, of_x, ("u", "d"), ("s", "c"), True))


def _sides(key: tuple, pdf: pd.DataFrame, text: str) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """The two chunks of a tile, in one order however the rows came, and whether they are one."""
    pdf = pdf.sort_values(text, kind="stable")
    if key[1:3] == key[3:5]:
        return pdf, pdf, True
    return pdf[~pdf["right"]], pdf[pdf["right"]], False


def linked(rows: DataFrame, group: str, node: str, text: str, threshold: float) -> DataFrame:
    """Links (a, b) of node numbers that join all texts of a group that resemble each other, in either order, and may join some that don't.

    rows have distinct texts in a group.  Pairs that the common subsequence allows are
    linked without asking difflib.
    """

    def forest(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, one = _sides(key, pdf, text)
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        left = Texts(x[text].tolist())
        right = left if one else Texts(y[text].tolist())
        ids = x[node].to_numpy() if one else np.concatenate([x[node].to_numpy(), y[node].to_numpy()])
        shift = 0 if one else len(left)
        root = np.arange(len(ids))
        out: list[tuple[int, int]] = []
        for some, others in near(left, right, one, threshold, lambda i, j: root[i] != root[j + shift]):
            for i, j in zip(some.tolist(), others.tolist()):
                p, q = root[i], root[j + shift]
                if p != q and alike(left.texts[i], right.texts[j], threshold):
                    out.append((int(ids[i]), int(ids[j + shift])))
                    root[root == max(p, q)] = min(p, q)
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    dealt = tiles_within(rows.select(group, node, text), group, text, threshold, F.xxhash64(node))
    # Tiles are few bytes but much work each: dealt out by number, so that they are not put together by their bytes.
    return dealt.repartition(16 * rows.sparkSession.sparkContext.defaultParallelism, group, *TILE).groupBy(group, *TILE).applyInPandas(forest, "a long, b long")


class _Best:
    """The best few of a tile's pairs: by ratio, then by their smallest pair of ids."""

    def __init__(self, limit: int, least: float):
        self.limit, self.least, self.rows = limit, least, []

    def add(self, r: float, a: int, b: int, left: str, right: str) -> None:
        self.rows.append((-r, a, b, left, right))
        if len(self.rows) >= 2 * self.limit:
            self.cut()

    def cut(self) -> list[tuple]:
        self.rows = sorted(self.rows)[: self.limit]
        if len(self.rows) == self.limit:
            self.least = max(self.least, -self.rows[-1][0])
        return self.rows


def best_pairs(rows: DataFrame, group: str, text: str, ids: str, threshold: float, limit: int, least: float | None = None, rounds: str = "all") -> DataFrame:
    """left, right and similarity of the limit most similar ordered pairs of a tile's texts.

    rows have distinct texts in a group with ids, an ascending list; left stands before
    right where one of its ids is smaller.  A pair whose bound is below what the
    tile's limit-th best has reached is not compared.  rounds: the tiles of one chunk
    alone ("one"), those of two ("two") or all.
    """

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, one = _sides(key, pdf, text)
        found = _Best(limit, threshold if least is None else max(least, threshold))
        if len(x) and len(y):
            left = Texts(x[text].tolist())
            right = left if one else Texts(y[text].tolist())
            of_x, of_y = [list(v) for v in x[ids]], [list(v) for v in y[ids]]
            match = SequenceMatcher(None)
            ones = np.ones(_LETTERS, np.float32)
            for i in range(len(left)):
                rest = np.arange(i + 1, len(left)) if one else np.arange(len(right))
                at = possible(left, i, right, rest, found.least)
                bound = 2 * (np.minimum(right.letters[at], left.letters[i]) @ ones) / np.maximum(left.size[i] + right.size[at], 1)
                for j, most in sorted(zip(at.tolist(), bound.tolist()), key=lambda p: -p[1]):
                    if most < found.least - 1e-9:
                        break
                    a, b, p, q = left.texts[i], right.texts[j], of_x[i], of_y[j]
                    if not alike(a, b, found.least):
                        continue
                    for first, second, m, n in ((a, b, p, q), (b, a, q, p)):
                        later = next((k for k in n if k > m[0]), None)
                        if later is None:
                            continue
                        match.set_seqs(first, second)
                        if match.real_quick_ratio() >= found.least and match.quick_ratio() >= found.least:
                            r = match.ratio()
                            if r >= found.least:
                                found.add(r, m[0], later, first, second)
        out = found.cut()
        return pd.DataFrame({group: [key[0]] * len(out), "left": [r[3] for r in out], "right": [r[4] for r in out], "similarity": [-r[0] for r in out]}, dtype=object)

    dealt = tiles_within(rows.select(group, text, ids), group, text, threshold, F.xxhash64(text))
    alone = (F.col("s") == F.col("u")) & (F.col("c") == F.col("d"))
    dealt = dealt if rounds == "all" else dealt.where(alone if rounds == "one" else ~alone)
    return dealt.groupBy(group, *TILE).applyInPandas(best, f"{group} string, left string, right string, similarity double")


def resembling(new: DataFrame, old: DataFrame, group: str, text: str, threshold: float) -> DataFrame:
    """Distinct (group, text) of new whose ratio with a text of old in its group reaches the threshold (new first)."""

    def hits(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(text, kind="stable")
        x, y = pdf[~pdf["right"]][text].tolist(), pdf[pdf["right"]][text].tolist()
        out = []
        if x and y:
            left, right, known, match = Texts(x), Texts(y), set(y), SequenceMatcher(None)
            hit = np.array([a in known for a in x])
            for some, others in near(left, right, False, threshold, lambda i, j: ~hit[i]):
                for i, j in zip(some.tolist(), others.tolist()):
                    if not hit[i] and alike(x[i], y[j], threshold):
                        hit[i] = _reaches(match, x[i], y[j], threshold)
            out = [a for a, h in zip(x, hit) if h]
        return pd.DataFrame({group: [key[0]] * len(out), text: out}, dtype=object)

    both = tiles_between(new.select(group, text).distinct(), old.select(group, text).distinct(), group, text, threshold, F.xxhash64(text))
    return both.groupBy(group, *TILE).applyInPandas(hits, f"{group} string, {text} string").distinct()


def ordered_pairs(rows: DataFrame, group: str, at: str, text: str, threshold: float) -> DataFrame:
    """Pairs (group, a, b) of places whose texts resemble each other: the one at b, the later place, compared with the one at a.

    rows have distinct texts and distinct places (numbers) in a group.
    """

    def pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, one = _sides(key, pdf, text)
        out: list[tuple[int, int]] = []
        if len(x) and len(y):
            left = Texts(x[text].tolist())
            right, match = left if one else Texts(y[text].tolist()), SequenceMatcher(None)
            p, q = x[at].tolist(), y[at].tolist()
            for some, others in near(left, right, one, threshold, lambda i, j: np.ones(len(i), bool)):
                for i, j in zip(some.tolist(), others.tolist()):
                    (a, first), (b, then) = sorted(((p[i], left.texts[i]), (q[j], right.texts[j])))
                    if alike(then, first, threshold) and _reaches(match, then, first, threshold):
                        out.append((a, b))
        made = pd.DataFrame(out, columns=["a", "b"]).astype("int64")
        made.insert(0, group, key[0])
        return made

    dealt = tiles_within(rows.select(group, at, text), group, text, threshold, F.xxhash64(text))
    return dealt.groupBy(group, *TILE).applyInPandas(pairs, f"{group} string, a long, b long")


def _longest(a: str, b: str, hits: list[int], b2j: dict[str, list[int]], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """difflib's longest match of two parts; hits: places of a whose character may start a block in b."""
    besti, bestj, bestsize, before, ends = alo, blo, 0, -2, {}
    for i in hits[bisect_left(hits, alo) : bisect_left(hits, ahi)]:
        now = {}
        if i != before + 1:
            ends = now
        for j in b2j[a[i]]:
            if j < blo:
                continue
            if j >= bhi:
                break
            k = now[j] = (ends.get(j - 1, 0) if ends is not now else 0) + 1
            if k > bestsize:
                besti, bestj, bestsize = i - k + 1, j - k + 1, k
        before, ends = i, now
    while besti > alo and bestj > blo and a[besti - 1] == b[bestj - 1]:
        besti, bestj, bestsize = besti - 1, bestj - 1, bestsize + 1
    while besti + bestsize < ahi and bestj + bestsize < bhi and a[besti + bestsize] == b[bestj + bestsize]:
        bestsize += 1
    return besti, bestj, bestsize


def _reaches(match: SequenceMatcher, a: str, b: str, threshold: float) -> bool:
    """Whether difflib's ratio reaches the threshold: its blocks, until those found are enough or all that may be left is not."""
    match.set_seqs(a, b)
    total = len(a) + len(b)
    if match.real_quick_ratio() < threshold or max(len(a), len(b)) > _LONG and match.quick_ratio() < threshold:
        return False
    if not total:
        return True
    hits, sure, most = [i for i, c in enumerate(a) if c in match.b2j], 0, min(len(a), len(b))
    todo = [(-most, 0, len(a), 0, len(b))]  # parts with the most to win or lose first
    while 2.0 * sure / total < threshold:
        if not todo or 2.0 * most / total < threshold:
            return False
        room, alo, ahi, blo, bhi = heappop(todo)
        i, j, k = _longest(a, b, hits, match.b2j, alo, ahi, blo, bhi)
        most, sure = most + room, sure + k
        if k:
            most += k
            for part in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
                if left := min(part[1] - part[0], part[3] - part[2]):
                    most += left
                    heappush(todo, (-left, *part))
    return True
