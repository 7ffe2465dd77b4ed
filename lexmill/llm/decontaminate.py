"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters, digits and non-ASCII bytes, lower-cased (A-Z).  A
fixed mask selects some of the positions below it and ignores the others, so a
substituted token under a gap does not change the hash.  Hashes of the benchmark
under each mask are joined with those of every position of every document; each
hit fixes an alignment of document and item, which is then compared token by
token.  A document is contaminated by an item where

* the item has ``match_tokens`` tokens or more and some window of as many aligned
  tokens agrees in at least ``agree_percent`` of them;
* a shorter item of ``ONE_OFF_TOKENS`` or more occurs whole with at most one token substituted;
* a shorter one of ``LEAST_TOKENS`` or more occurs whole and unchanged;
* an item of fewer tokens is all that the document says.

The masks are proven (by enumeration, in the tests) to hit every window of 13
tokens with up to two substitutions, and every window of 8 to 12 with up to one.

The benchmark is a stated query set: it is dealt into blocks of at most
``BLOCK_BYTES`` of text, so what a task holds is bounded; with more than one block
each is broadcast in turn, its result written, and the broadcast given up.
Documents stream past and are never shuffled.  An executor lost costs the tasks
that it ran.  Alignments of one document and item are checked together, in pieces
of bounded size, so monotonous texts cost no more memory than others; a task holds
one text at a time whole, however long.

Defined edge cases: null or empty texts and items hold nothing; a row's item is
reported once, at the alignment with the most agreeing tokens (the first of
equals); repeated items and rows each give their rows; ids may be null; an empty
table gives an empty result; extra columns are ignored by ``contaminated`` and
kept by ``drop_contaminated``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import wordhash
from lexmill.llm.scratch import Scratch

MASKS = ("11101011", "1101001101")
MATCH_TOKENS = 13
AGREE_PERCENT = 80
#: for items of 8 to 12 tokens with one substitution
ONE_OFF_MASKS = ("11011",)
ONE_OFF_TOKENS = 8
LEAST_TOKENS = 5
BLOCK_BYTES = 8_000_000
#: hits and compared tokens held at once
_CELLS = 1_000_000
_FILTER_BITS = 20

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[:128] = [b if chr(b).isalnum() else 32 for b in range(128)]
_CLEAN[65:91] += 32


def _tokens(data: np.ndarray, offsets: np.ndarray):
    return wordhash.words(_CLEAN[data], offsets)


def masked(hashed: np.ndarray, mask: str) -> np.ndarray:
    """Hash under the mask at each position where it fits."""
    n = len(hashed) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), dtype=np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = out * wordhash._MULT + hashed[k : k + n]
    return wordhash.mix64(out)


class Seeds:
    """The hashed benchmark of one block."""

    def __init__(self, items: list[tuple[int, str]], match_tokens: int = MATCH_TOKENS, agree_percent: int = AGREE_PERCENT):
        texts = [(t or "").encode() for _, t in items]
        hashed, _, _, row = _tokens(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        at = np.searchsorted(row, np.arange(len(items) + 1))
        self.ids, self.tokens = [i for i, _ in items], [hashed[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.match_tokens, self.agree_percent = match_tokens, agree_percent
        by_mask: dict[str, list[int]] = {}
        for k, own in enumerate(self.tokens):
            for mask in self._masks(len(own)):
                by_mask.setdefault(mask, []).append(k)
        self.parts = []
        for mask, own in sorted(by_mask.items()):
            hs = [masked(self.tokens[k], mask) for k in own]
            h, item = np.concatenate(hs), np.repeat(np.array(own, dtype=np.int64), [len(x) for x in hs])
            pos = np.concatenate([np.arange(len(x)) for x in hs])
            order = np.argsort(h, kind="stable")
            h, item, pos = h[order], item[order], pos[order]
            known = np.zeros(1 << _FILTER_BITS, dtype=bool)
            known[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.parts.append((mask, h, item, pos, known))

    def _masks(self, n: int) -> tuple[str, ...]:
        if n >= self.match_tokens:
            return MASKS
        if n >= ONE_OFF_TOKENS:
            return ONE_OFF_MASKS
        return ("1" * n,) if n else ()

    def _needs(self, n: int) -> tuple[int, int]:
        """Width of the window that decides for an item of ``n`` tokens, and how many of it must agree."""
        if n >= self.match_tokens:
            return self.match_tokens, -(-self.agree_percent * self.match_tokens // 100)
        return n, n - (n >= ONE_OFF_TOKENS)

    def _alignments(self, hashed: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Distinct (item, row, first token of the item in the block) of all hits."""
        reach = max(map(len, self.tokens), default=0)
        rows, span, out = int(row[-1]) + 1 if len(row) else 1, len(hashed) + reach + 1, []
        for mask, h, item, pos, known in self.parts:
            own = masked(hashed, mask)
            at = np.flatnonzero(known[(own >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            at = at[row[at] == row[at + len(mask) - 1]]
            lo, hi = np.searchsorted(h, own[at]), np.searchsorted(h, own[at], side="right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            total = np.cumsum(n)
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + _CELLS, side="right")))
                m = n[a:b]
                k = np.repeat(lo[a:b] - np.cumsum(m) + m, m) + np.arange(m.sum())
                where = np.repeat(at[a:b], m)
                out.append(np.unique((item[k] * rows + row[where]) * span + (where - pos[k] + reach)))
                a = b
        key = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return np.stack([key // span // rows, key // span % rows, key % span - reach], axis=1)

    def found(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first token of the item's alignment in the row, matches, item length): the best of each row and item."""
        hashed, _, _, row = _tokens(data, offsets)
        first = np.searchsorted(row, np.arange(len(offsets)))
        hits = self._alignments(hashed, row)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        edges = np.searchsorted(hits[:, 0], np.arange(len(self.tokens) + 1)) if len(hits) else []
        for i in np.unique(hits[:, 0]).tolist():
            x, own = self.tokens[i], hits[edges[i] : edges[i + 1]]
            width, need = self._needs(len(x))
            col, step = np.arange(len(x)), max(1, _CELLS // len(x))
            for a in range(0, len(own), step):
                r, start = own[a : a + step, 1], own[a : a + step, 2]
                at = start[:, None] + col
                inside = (at >= first[r][:, None]) & (at < first[r + 1][:, None])
                same = inside & (hashed[np.clip(at, 0, len(hashed) - 1)] == x)
                run = np.zeros((len(r), len(x) + 1), dtype=np.int32)
                np.cumsum(same, axis=1, out=run[:, 1:])
                agree = run[:, width:] - run[:, :-width]
                held = np.zeros_like(run)
                np.cumsum(inside, axis=1, out=held[:, 1:])
                agree[held[:, width:] - held[:, :-width] < width] = -1
                ok = agree.max(axis=1) >= need
                if len(x) < LEAST_TOKENS:
                    ok &= first[r + 1] - first[r] == len(x)
                ok = np.flatnonzero(ok)
                ok = ok[np.lexsort((start[ok], -run[ok, -1], r[ok]))]
                ok = ok[np.concatenate(([True], r[ok][1:] != r[ok][:-1]))] if len(ok) else ok
                for k in ok.tolist():
                    key, got = (int(r[k]), i), (int(run[k, -1]), int(first[r[k]] - start[k]), len(x))
                    if key not in best or got > best[key]:
                        best[key] = got
        return [(r, i, -a, m, n) for (r, i), (m, a, n) in sorted(best.items())]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int, match_tokens: int = MATCH_TOKENS, agree_percent: int = AGREE_PERCENT) -> Iterator[Seeds]:
    """The query set in blocks of bounded size, fetched one at a time."""
    items = benchmark.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).where(F.col("t").isNotNull())
    held, size = [], 0
    for r in items.toLocalIterator():
        if held and size + len(r["t"].encode()) > block_bytes:
            yield Seeds(held, match_tokens, agree_percent)
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += len(r["t"].encode())
    if held:
        yield Seeds(held, match_tokens, agree_percent)


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        for batch in batches:
            ids = batch.column(0)
            for row, data, offsets in wordhash.blocks(batch.column(1)):
                got = seeds.found(data, offsets)
                if got:
                    r, i, a, m, n = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([row + k for k in r])), pa.array([seeds.ids[k] for k in i], pa.int64()), *(pa.array(c, pa.int64()) for c in (a, m, n))], ["doc_id", "item_id", "token_start", "n_match", "n_item"])

    return run


def _clean_rows(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for row, data, offsets in wordhash.blocks(batch.column(at)):
                keep[[row + r for r, *_ in seeds.found(data, offsets)]] = False
            yield batch if keep.all() else batch.filter(pa.array(keep))

    return run


def contaminated(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    match_tokens: int = MATCH_TOKENS,
    agree_percent: int = AGREE_PERCENT,
) -> DataFrame:
    """A row for each document and item that overlap: ``doc_id, item_id, token_start, n_match, n_item``."""
    schema = "doc_id long, item_id long, token_start long, n_match long, n_item long"
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    scratch, out, held = Scratch(spark, "decontamination"), None, None
    for seeds in benchmark_blocks(benchmark, item_col, item_text, block_bytes, match_tokens, agree_percent):
        if held is not None:  # not the last block: write what the one before finds, then give its broadcast up
            part = scratch.table(given.mapInArrow(_search(held), schema))
            out = part if out is None else out.unionAll(part)
            held.destroy()
        held = spark.sparkContext.broadcast(seeds)
    if held is None:
        return spark.createDataFrame([], schema)
    last = given.mapInArrow(_search(held), schema)
    return last if out is None else out.unionAll(last)


def drop_contaminated(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    match_tokens: int = MATCH_TOKENS,
    agree_percent: int = AGREE_PERCENT,
) -> DataFrame:
    """The documents that overlap with no item, as they came."""
    scratch, held = Scratch(spark, "decontamination"), None
    at, schema, before = docs.columns.index(text_col), docs.schema, None
    for seeds in benchmark_blocks(benchmark, item_col, item_text, block_bytes, match_tokens, agree_percent):
        if held is not None:
            docs = scratch.table(docs.mapInArrow(_clean_rows(held, at), schema))
            held.destroy()
            if before is not None:
                scratch.drop(before)
            before = docs
        held = spark.sparkContext.broadcast(seeds)
    return docs if held is None else docs.mapInArrow(_clean_rows(held, at), schema)
