"""Lines of texts as sentences, cut in numpy where the texts lie: no row, array or key of a line is made before it is needed.  Inventory: S1, P2, P3, P9.

A sentence is a line that holds words; its items are the characters of its
words.  Texts are as they are to be read: lower-cased, where that is wanted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import codes
from lexmill.functions import tags as tg
from lexmill.functions import templates as tp


@dataclass(frozen=True)
class Lines:
    """The sentences of ``texts``; ``id_col`` and the line's number, from 0, are a sentence's key."""

    texts: DataFrame
    id_col: str
    text: str

    def sentences(self) -> DataFrame:
        """``key, words`` of every sentence, as rows."""
        lines = self.texts.select(self.id_col, F.posexplode(F.split(self.text, "\n")).alias("line_no", "line"))
        words = F.filter(F.split("line", r"[ \t\r\f\x0B]+"), lambda w: w != "")
        return lines.select(F.concat_ws("-", self.id_col, "line_no").alias("key"), words.alias("words")).where(F.size("words") > 0)

    def given(self) -> DataFrame:
        """``id, text`` of the texts; a filter here would have the texts lower-cased twice."""
        return self.texts.select(F.col(self.id_col).cast("string").alias("id"), F.col(self.text).alias("text"))

    def heads(self) -> DataFrame:
        """``key, n, lengths``: number of items of every sentence, and as bits 1 to 5 which lengths its words have, longer ones as 5."""
        return self.given().mapInArrow(_heads, "key string, n long, lengths int")


@dataclass(frozen=True)
class Encoding:
    """Sentences to be encoded with a dictionary, for those who can do it on the way."""

    lines: Lines
    dictionary: DataFrame
    templates: tuple = tp.DEFAULT_TEMPLATES


class Cut:
    """Sentences of some texts: code points of their items, numbers of items, and the lengths of all words."""

    def __init__(self, ids: pa.Array | None, texts: pa.Array, sizes: np.ndarray):
        points = codes.code_points(texts)
        ends = np.cumsum(sizes)
        # a line feed is white space and ends a line, and so does the end of a text; numbers below 9 wrap round
        gap = (points == 32) | (points - np.uint32(9) <= 4)
        white = np.flatnonzero(gap)
        feeds = white[points[white] == 10]
        per_text = 1 + np.bincount(np.searchsorted(ends, feeds, side="right"), minlength=len(sizes))
        line_ends, last = np.empty(int(per_text.sum()), np.int64), np.cumsum(per_text) - 1
        inner = np.ones(len(line_ends), bool)
        inner[last] = False
        line_ends[last], line_ends[inner] = ends, feeds
        lengths = np.diff(line_ends - np.searchsorted(white, line_ends), prepend=0)
        some = np.flatnonzero(lengths)
        self._ids, self._per_text, self._some = ids, per_text, some
        self._gap, self._first = gap, (ends - sizes)[sizes > 0]
        self.points, self.lengths = points[~gap], lengths[some]

    @cached_property
    def words(self) -> np.ndarray:
        kept = ~self._gap
        begins = kept.copy()
        begins[1:] &= self._gap[:-1]
        begins[self._first] = kept[self._first]
        return np.diff((np.cumsum(kept) - 1)[begins], append=len(self.points))

    def keys(self) -> pa.Array:
        text = np.repeat(np.arange(len(self._per_text)), self._per_text)[self._some]
        number = self._some - codes.starts(self._per_text)[text]
        return pc.binary_join_element_wise(self._ids.take(pa.array(text)).cast(pa.string()), pa.array(number).cast(pa.string()), "-", null_handling="skip")

    def labels(self) -> np.ndarray:
        """Label ids of all items."""
        return tag_ids(self.words)


def tag_ids(n: np.ndarray) -> np.ndarray:
    """Label ids of the items of words of given lengths, one item at least."""
    a = codes.starts(n)
    out = np.full(int(n.sum()), tg.TAGS.index("M"), np.int32)
    for tag, at in (("B2", (a + 2)[n > 3]), ("B1", (a + 1)[n > 2]), ("E", a + n - 1), ("B", a), ("S", a[n == 1])):
        out[at] = tg.TAGS.index(tag)
    return out


def cuts(batches: Iterator[pa.RecordBatch], most: int = codes.SLICE_ITEMS) -> Iterator[Cut]:
    """Sentences of stretches of texts (``id, text``) that have some."""
    for batch in batches:
        sizes = codes.text_lengths(batch.column(1))
        for a, z in codes.slices(sizes, most):
            made = Cut(batch.column(0)[a:z], batch.column(1)[a:z], sizes[a:z])
            if len(made.lengths):
                yield made


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cut in cuts(batches):
        of_word = np.searchsorted(codes.starts(cut.words), codes.starts(cut.lengths))
        met = np.bitwise_or.reduceat(1 << np.minimum(cut.words, 5), of_word)
        yield pa.RecordBatch.from_arrays([cut.keys(), pa.array(cut.lengths.astype(np.int64)), pa.array(met.astype(np.int32))], ["key", "n", "lengths"])
