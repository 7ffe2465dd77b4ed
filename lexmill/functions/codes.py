"""Texts as code points in numpy: what depends on a window of items is worked out once for each distinct window.  Inventory: P3, P4, P6, W1.

Functions over Arrow batches; a batch is cut into stretches of whole texts, so
that memory stays bounded by ``SLICE_ITEMS`` and the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexmill.functions.templates import REACH, Template

#: items that are worked out at a time; a text is never cut
SLICE_ITEMS = 1 << 20
#: rows of numbers are counted in a table of at most this many cells, else sorted
DENSE = 1 << 22
#: what stands beyond the ends of a text
SENTINELS = tuple(f"_B{k}" for k in range(-REACH, 0)) + tuple(f"_B+{k}" for k in range(1, REACH + 1))
#: code points are below this
POINTS = 0x110000


def slices(lengths: np.ndarray, most: int = SLICE_ITEMS) -> Iterator[tuple[int, int]]:
    """First and last (exclusive) text of stretches of about ``most`` items."""
    ends, a = np.cumsum(lengths), 0
    while a < len(lengths):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, z
        a = z


def starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def text_lengths(texts: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.utf8_length(texts), 0)).astype(np.int64)


def code_points(texts: pa.Array) -> np.ndarray:
    """Code points of all texts, one after another."""
    return np.frombuffer("".join((texts.fill_null("") if texts.null_count else texts).to_pylist()).encode("utf-32-le"), np.uint32)


class Items:
    """Code points of texts as numbers below ``base``: ranks in ``symbols``, the sentinels last."""

    def __init__(self, points: np.ndarray, lengths: np.ndarray):
        used = np.flatnonzero(np.bincount(points))
        rank = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.int64)
        rank[used] = np.arange(len(used))
        self.lengths, self.first, self.ranks = lengths, starts(lengths), rank[points]
        self.symbols = np.array([*map(chr, used), *SENTINELS], dtype=object)
        self.base, self._shifted = len(self.symbols), {}

    def at(self, row: int) -> np.ndarray:
        """The item ``row`` places on from each, or the sentinel of its distance beyond the end."""
        if row not in self._shifted:
            self._shifted[row] = _shifted(self.ranks, self.first, self.lengths, row, self.base - len(SENTINELS))
        return self._shifted[row]


def _shifted(ranks: np.ndarray, first: np.ndarray, n: np.ndarray, row: int, sentinels: int) -> np.ndarray:
    """The ranks ``row`` places on from each; beyond the ends those of the sentinels, which begin at ``sentinels``."""
    if row == 0:
        return ranks
    out = np.roll(ranks, -row)
    for d in range(1, abs(row) + 1):
        # places whose neighbour lies d beyond the end
        place = abs(row) - d if row < 0 else n - 1 - row + d
        sentinel = f"_B-{d}" if row < 0 else f"_B+{d}"
        there = (n > place) & (place >= 0)
        out[(first + place)[there]] = sentinels + SENTINELS.index(sentinel)
    return out


def distinct(columns: list[np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of numbers below ``base``: a row that has each, how many have it, and each row's place among them."""
    key, size = columns[0], base
    for c in columns[1:]:
        if size * base >= 1 << 62:
            found, key = np.unique(key, return_inverse=True)
            size = len(found)
        key, size = key * base + c, size * base
    if size <= DENSE:
        n = np.bincount(key, minlength=size)
        found, place = np.flatnonzero(n), np.zeros(size, np.int64)
        place[found] = np.arange(len(found))
        n, inverse = n[found], place[key]
    else:
        found, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    row = np.zeros(len(found), np.int64)
    row[inverse] = np.arange(len(key))
    return row, n, inverse


class Tally:
    """How often each window of items is met, over all stretches of texts that are added.

    Symbols keep their rank from stretch to stretch, so a window is one number while
    there are not too many rows, and no window is looked at outside numpy.
    """

    def __init__(self, rows: range):
        self._rows, self._rank = rows, np.full(POINTS, -1, np.int32)
        self._symbols, self._keys, self._waiting, self._held, self.size = list(SENTINELS), [], 0, [], 0
        self._grow()

    def _grow(self) -> None:
        self._count()
        self._base = len(self._symbols) + max(16, len(self._symbols) // 8)
        cells = self._base ** len(self._rows)
        self._kind = np.int32 if cells < 1 << 31 else np.int64 if cells < 1 << 62 else None

    def _ranks(self, points: np.ndarray) -> np.ndarray:
        ranks = self._rank[points]
        if ranks.min() < 0:
            new = np.unique(points[ranks < 0])
            self._rank[new] = np.arange(len(self._symbols), len(self._symbols) + len(new))
            self._symbols += map(chr, new.tolist())
            if len(self._symbols) > self._base:
                self._grow()
            ranks = self._rank[points]
        return ranks

    def add(self, points: np.ndarray, lengths: np.ndarray) -> None:
        """The items of texts, one at least."""
        ranks, first = self._ranks(points), starts(lengths)
        columns = [_shifted(ranks, first, lengths, row, 0) for row in self._rows]
        if self._kind is None:
            row, n, _ = distinct([c.astype(np.int64) for c in columns], self._base)
            self._hold([c[row] for c in columns], n)
            return
        key = columns[0].astype(self._kind)
        for c in columns[1:]:
            key *= self._base
            key += c
        self._keys.append(key)
        self._waiting += len(key)
        if self._waiting >= SLICE_ITEMS:
            self._count()

    def _count(self) -> None:
        if not self._keys:
            return
        keys, self._keys, self._waiting = np.concatenate(self._keys), [], 0
        if self._base ** len(self._rows) <= DENSE:
            n = np.bincount(keys)
            found = np.flatnonzero(n)
            n = n[found]
        else:
            found, n = np.unique(keys, return_counts=True)
        columns = []
        for _ in self._rows:
            found, rank = np.divmod(found, self._base)
            columns.append(rank.astype(np.int32))
        self._hold(columns[::-1], n)

    def _hold(self, columns: list[np.ndarray], n: np.ndarray) -> None:
        self._held.append((columns, n))
        self.size += len(n)

    def merge(self) -> None:
        """Equal windows of all that is held become one; ``size`` is then their number."""
        self._count()
        if len(self._held) > 1:
            columns = [np.concatenate(c).astype(np.int64) for c in zip(*(c for c, _ in self._held), strict=True)]
            row, _, place = distinct(columns, len(self._symbols))
            # whole numbers, exact in doubles
            n = np.bincount(place, np.concatenate([n for _, n in self._held])).astype(np.int64)
            self._held, self.size = [], 0
            self._hold([c[row].astype(np.int32) for c in columns], n)

    def taken(self) -> tuple[list[pa.Array], pa.Array]:
        """The values of all windows by row, and how often each window was met; nothing is held any more."""
        self.merge()
        columns, n = self._held[0] if self._held else ([np.zeros(0, np.int32)] * len(self._rows), np.zeros(0, np.int64))
        self._held, self.size = [], 0
        symbols = pa.array(self._symbols, pa.string())
        return [symbols.take(pa.array(c)) for c in columns], pa.array(n, pa.int64())


def features_of(items: Items, template: Template, rows: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
    """The distinct features of a template, and each item's place among them; of the items ``rows`` only, if given."""
    refs = [p[0] for p in template.parts if not isinstance(p, str)]
    if not refs:
        return ["".join(template.parts)], np.zeros(len(items.ranks if rows is None else rows), np.int64)
    columns = [items.at(r) if rows is None else items.at(r)[rows] for r in refs]
    row, _, place = distinct(columns, items.base)
    values = iter([items.symbols[c[row]].tolist() for c in columns])
    parts = [[p] * len(row) if isinstance(p, str) else next(values) for p in template.parts]
    return list(map("".join, zip(*parts, strict=True))), place


def feature_ids(items: Items, templates: tuple[Template, ...], found: dict[str, int], rows: np.ndarray | None = None) -> np.ndarray:
    """(items, templates): ids of all features, -1 where the dictionary has none."""
    out = np.empty((len(items.ranks if rows is None else rows), len(templates)), np.int32)
    for k, t in enumerate(templates):
        made, place = features_of(items, t, rows)
        out[:, k] = np.array([found.get(f, -1) for f in made], np.int32)[place]
    return out


def window_ids(items: Items, templates: tuple[Template, ...], found: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """``feature_ids`` of the distinct windows of items, and each item's place among them."""
    refs = sorted({p[0] for t in templates for p in t.parts if not isinstance(p, str)} or {0})
    row, _, place = distinct([items.at(r) for r in refs], items.base)
    return feature_ids(items, templates, found, row), place


def list_array(values: pa.Array | np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))
