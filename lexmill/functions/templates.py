"""Feature templates compiled to columns.  Inventory: P4-P8, W1, S23.

A pattern is literal text with references ``%x[row,col]``.  It is parsed once on
the driver; expansion is an array expression over a sentence, so no shuffle and
no Python worker is needed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import text as X

#: fixed values: the shipped templates
DEFAULT = (
    "U00:%x[-1,0]",
    "U01:%x[0,0]",
    "U02:%x[1,0]",
    "U03:%x[-1,0]/%x[0,0]",
    "U04:%x[0,0]/%x[1,0]",
    "U05:%x[-1,0]/%x[1,0]",
)
#: fixed value: sentinels reach this far beyond either end
REACH = 4
_REF = re.compile(r"%x\[(-?\d+),(\d+)\]")


@dataclass(frozen=True)
class Template:
    """Literal and (row, col) parts in turn."""

    pattern: str
    parts: tuple

    @property
    def name(self) -> str:
        return self.pattern.split(":", 1)[0]


def parse(pattern: str) -> Template:
    parts, at = [], 0
    for m in _REF.finditer(pattern):
        parts.append(pattern[at : m.start()])
        row = int(m[1])
        if abs(row) > REACH:
            raise ValueError(f"offset {row} of {pattern!r} is beyond {REACH}")
        parts.append((row, int(m[2])))
        at = m.end()
    parts.append(pattern[at:])
    if "%x" in "".join(p for p in parts if isinstance(p, str)):
        raise ValueError(f"malformed reference in {pattern!r}")
    return Template(pattern, tuple(p for p in parts if p != ""))


def read(text: str) -> list[Template]:
    """One pattern a line; blank lines and lines that begin with ``#`` are dropped."""
    return [parse(line.strip()) for line in text.splitlines() if line.strip() and not line.strip().startswith("#")]


DEFAULT_TEMPLATES = tuple(parse(p) for p in DEFAULT)


def _value(items: Column, i: Column, row: int, col: int, width: int) -> Column:
    """The item at i+row, or the sentinel of its distance beyond the end."""
    at = i + row
    n = F.size(items) / width if width > 1 else F.size(items)
    n = n.cast("int")
    found = F.get(items, at * width + col)
    if row < 0:
        return F.when(at < 0, F.concat(F.lit("_B"), at.cast("string"))).otherwise(found)
    if row > 0:
        return F.when(at >= n, F.concat(F.lit("_B+"), (at - n + 1).cast("string"))).otherwise(found)
    return found


def expand(items: Column, templates=DEFAULT_TEMPLATES, width: int = 1) -> Column:
    """All features, item by item, template by template.  ``items`` is flat, ``width`` values an item."""

    def whole(held: Column) -> Column:
        n = (F.size(held) / width).cast("int") if width > 1 else F.size(held)

        def at(i: Column) -> Column:
            return F.array(*[F.concat(*[F.lit(p) if isinstance(p, str) else _value(held, i, p[0], p[1], width) for p in t.parts]) for t in templates])

        return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), at))).otherwise(F.array().cast("array<string>"))

    return X.bind(items, whole)


def reach(templates) -> tuple[int, int]:
    """Least and greatest offset that the templates read."""
    rows = [p[0] for t in templates for p in t.parts if not isinstance(p, str)] or [0]
    return min(rows), max(rows)


def windows(items: Column, low: int, high: int) -> Column:
    """For every item the values from ``low`` to ``high`` round it, as a struct; whole arrays are shifted, not single items."""

    def whole(held: Column) -> Column:
        n = F.size(held)

        def shifted(row: int) -> Column:
            if row < 0:
                before = F.array(*[F.lit(f"_B{k}") for k in range(row, 0)])
                return F.slice(F.concat(before, held), F.lit(1), n)
            if row > 0:
                after = F.concat(F.slice(held, F.lit(row + 1), F.greatest(n - row, F.lit(0))), F.array(*[F.lit(f"_B+{k}") for k in range(1, row + 1)]))
                return F.slice(after, F.size(after) - n + 1, n)
            return held

        rows = range(min(low, 0), max(high, 0) + 1)
        return F.arrays_zip(*[shifted(r).alias(f"x{r - min(low, 0)}") for r in rows])

    return X.bind(items, whole)


def window_features(window: Column, templates=DEFAULT_TEMPLATES) -> Column:
    """P4 at one position: the features of all templates from its window (of items of one value)."""
    low = min(reach(templates)[0], 0)
    return F.array(*[F.concat(*[F.lit(p) if isinstance(p, str) else window.getField(f"x{p[0] - low}") for p in t.parts]) for t in templates])


def is_boundary(feature: Column) -> Column:
    """Some part lies beyond an end of the sentence."""
    return feature.contains("_B-") | feature.contains("_B+")
