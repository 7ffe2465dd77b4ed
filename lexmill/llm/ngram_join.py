"""N-gram Jaccard join: a blocked sparse product of document by shingle incidence.

Two documents link when ``100 * |A n B| >= threshold * |A u B|`` over their sets
of distinct five-word shingles.  The result is exact whatever the data.

1. Documents with equal sets collapse into one class (copies cost nothing more).
2. In a fixed global order of shingles, the first c of a linked pair's overlap lie
   among the first ``n - ceil(t n) + c`` of either set.  The order is by hash, with
   shingles that repeat often last.  (That list of frequent shingles is bounded;
   it steers cost only, any order gives the same links.)  With c a tenth of the
   set, a class of which fewer leading shingles meet another class can't link and
   is dropped with its entries; that is repeated, as others may fall with it.
3. Classes are dealt to row blocks by their least leading shingle, which near
   copies mostly share; a block with more than ``block_rows`` classes or
   ``block_cells`` entries is cut.  A pair of blocks is multiplied only where they
   share leading shingles at sizes that could link, and only by the rows that share
   enough of them with the other block.  Nothing is closed over chains of documents.
4. In a block pair the product is taken row by row: a row's columns, rarest first,
   add their postings into overlap counts (integers).  After the first
   ``n - ceil(t n) + 1`` columns, rows without a count can't reach the bound, and
   neither can those whose count and remaining columns stay below
   ``t (|A| + |B|) / (1 + t)``; they are discarded, as are rows that are connected
   with this one already.  Only for what is left the other columns are added.
5. Each task returns a spanning forest of the links that it found; connected
   components over those gives the groups.

Defined edge cases: text null or without words gives an empty set, linked with
nothing; fewer words than the shingle size gives one shingle; a very long text is
one row, whose set a task holds whole; a tie at the threshold links; rows with one
doc_id count as one document; a row with a null doc_id adds no link and reports
the group of its set (null where no other row has it); an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.llm import wordhash
from lexmill.llm.components import components
from lexmill.llm.scratch import Scratch

SHINGLE_WORDS = 5
THRESHOLD = 80
SHARED_PERCENT = 10
FREQUENT_KEPT = 1 << 17
FREQUENT_LEAST = 16
PRUNING_ROUNDS = 3
BLOCK_ROWS = 1000
BLOCK_CELLS = 4_000_000
#: cuts of one row block at most; the block's number stands above them
_CUTS = 1 << 20


def _key(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys per set, the same for equal sets."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    ends, out = np.cumsum(sizes), []
    for salt in (0xA5A5A5A5, 0x5BD1E9955BD1E995):
        total = np.zeros(len(flat) + 1, dtype=np.uint64)
        np.cumsum(wordhash.mix64(flat ^ np.uint64(salt)), out=total[1:])
        out.append(wordhash.mix64(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)))
    return out[0], out[1]


def _digest(size: int, flush: int = 4_000_000):
    """doc_id, n and keys of every document (kind 0), and shingles met in several classes of one slice (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        n_held = 0

        def frequent() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c > 1], c[c > 1]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), pa.nulls(len(h), pa.int64()), pa.array(c.astype(np.int32)), pa.array(h.view(np.int64)), pa.nulls(len(h), pa.int64())], ["kind", "doc_id", "n", "key", "key2"])

        for batch in batches:
            ids = batch.column(0)
            for first, sets in wordhash.shingle_sets(batch.column(1), size):
                keys, more = _key(sets)
                for s, k in zip(sets, keys.tolist(), strict=True):
                    if k not in seen and len(s):
                        seen.add(k)
                        held.append(s)
                        n_held += len(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), ids.slice(first, len(sets)), pa.array(np.array([len(s) for s in sets], np.int32)), pa.array(keys.view(np.int64)), pa.array(more.view(np.int64))], ["kind", "doc_id", "n", "key", "key2"])
                if n_held >= flush:
                    yield frequent()
                    seen, held, n_held = set(), [], 0
        if held:
            yield frequent()

    return run


def _shared(n: int) -> int:
    """How many leading shingles two linked sets of about this size are asked to share."""
    return max(1, n * SHARED_PERCENT // 100)


def _prefix(n: int, threshold: int) -> int:
    """So many leading shingles hold the first ``_shared(n)`` of the overlap with any linked set."""
    return min(n, n - math.ceil(threshold * n / 100) + _shared(n))


def _entries(size: int, threshold: int, frequent):
    """(shingle, keys, n) for the leading shingles of each set, those in ``frequent`` coming last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        for batch in batches:
            done: set[tuple[int, int]] = set()
            for _, sets in wordhash.shingle_sets(batch.column(0), size):
                keys = _key(sets)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                at = np.minimum(np.searchsorted(hot, flat), max(len(hot) - 1, 0))
                late = hot[at] == flat if len(hot) else np.zeros(len(flat), bool)
                hs, ks, ns, a = [], [], [], 0
                for s, *k in zip(sets, keys[0].tolist(), keys[1].tolist(), strict=True):
                    k = tuple(k)
                    n, is_late = len(s), late[a : a + len(s)]
                    a += n
                    if not n or k in done:
                        continue
                    done.add(k)
                    lead = np.concatenate((s[~is_late], s[is_late]))[: _prefix(n, threshold)]
                    hs.append(lead)
                    ks.append(np.tile(np.array(k, dtype=np.uint64), (len(lead), 1)))
                    ns.append(np.full(len(lead), n, np.int32))
                if hs:
                    key = np.concatenate(ks).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), pa.array(np.concatenate(ns))], ["h", "key", "key2", "n"])

    return run


def _sets(size: int):
    """The set of each class beside the block pairs that it takes part in; copies in one slice of the input are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int, int]] = set()
        for batch in batches:
            nodes = batch.column(1).to_pylist()
            for first, sets in wordhash.shingle_sets(batch.column(0), size):
                keep = []
                for k, name in enumerate(zip(nodes[first : first + len(sets)], *(x.tolist() for x in _key(sets)), strict=True)):
                    if name not in done:
                        done.add(name)
                        keep.append(k)
                rest = [batch.column(c).take(pa.array([first + k for k in keep], pa.int64())) for c in (1, 2)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([sets[k].tobytes() for k in keep], pa.binary())], ["node", "pairs", "hashes"])

    return run


class _Forest:
    """Connected rows of one block pair, and the links that connected them."""

    def __init__(self, n: int):
        self.root, self.links = np.arange(n), []

    def join(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = self.root[i], self.root[j]
            if a != b:
                self.root[self.root == max(a, b)] = min(a, b)
                self.links.append((i, j))


def block_links(sets: list[np.ndarray], left: int, threshold: int) -> list[tuple[int, int]]:
    """Spanning links of the first ``left`` sets with the others, or among themselves where there are no others."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = df[col] > 1
    row, col = row[keep], col[keep]
    # columns by rising frequency: within a row the rarest come first
    rank = np.empty(len(df), dtype=np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    col = rank[col]
    order = np.lexsort((col, row))
    row, col = row[order], col[order]
    begin = np.searchsorted(row, np.arange(len(sets) + 1))
    among = left == len(sets)
    by_col = np.lexsort((row, col))
    by_col = by_col if among else by_col[row[by_col] >= left]
    posted, at = row[by_col], np.searchsorted(col[by_col], np.arange(len(df) + 1))
    forest = _Forest(len(sets))

    def counted(cols: np.ndarray) -> np.ndarray:
        lo, n = at[cols], at[cols + 1] - at[cols]
        return np.bincount(posted[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))

    for i in range(1 if among else 0, left):
        own, n = col[begin[i] : begin[i + 1]], int(size[i])
        least = -(-threshold * n // 100)
        first = n - least + 1 - (n - len(own))
        if len(own) < least or first <= 0:
            continue
        got = counted(own[:first])
        if among:
            got[i:] = 0
        j = np.flatnonzero(got)
        # overlap * (100 + threshold) >= threshold * (|A| + |B|)
        need = threshold * (n + size[j])
        j = j[((got[j] + len(own) - first) * (100 + threshold) >= need) & (np.minimum(n, size[j]) * (100 + threshold) >= need)]
        j = j[forest.root[j] != forest.root[i]]
        if len(j):
            total = got[j] + counted(own[first:])[j]
            forest.join(i, j[total * (100 + threshold) >= threshold * (n + size[j])])
    return forest.links


def _link_tasks(threshold: int):
    """Over rows sorted by (i, j, side): the links of each block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, nodes, sets, left = None, [], [], 0

        def close() -> pa.RecordBatch:
            links = block_links(sets, left, threshold) if len(sets) > 1 and left else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in links], pa.int64()), pa.array([nodes[y] for _, y in links], pa.int64())], ["a", "b"])

        for batch in batches:
            for i, j, side, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (i, j) != name:
                    yield close()
                    name, nodes, sets, left = (i, j), [], [], 0
                nodes.append(node)
                sets.append(np.frombuffer(raw, dtype=np.uint64))
                left += side == 0
        yield close()

    return run


def jaccard_groups(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    threshold: int = THRESHOLD,
    block_rows: int = BLOCK_ROWS,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, class_id``.

    ``component_id`` is the smallest id reachable by links, itself included;
    ``class_id`` the smallest id among documents with an equal set.
    """
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    digest = scratch.table(docs.mapInArrow(_digest(shingle_words), "kind int, doc_id long, n int, key long, key2 long"))
    own = digest.where("kind = 0").select("doc_id", "n", "key", "key2")
    hot = [r.key for r in digest.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_LEAST).orderBy(F.desc("n"), "key").limit(FREQUENT_KEPT).collect()]
    frequent = spark.sparkContext.broadcast(np.sort(np.array(hot, dtype=np.int64).view(np.uint64)))

    name = ["key", "key2", "n"]
    classes = scratch.table(own.where("n > 0 AND doc_id IS NOT NULL").groupBy(*name).agg(F.min("doc_id").alias("rep")))
    entries = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(_entries(shingle_words, threshold, frequent), "h long, key long, key2 long, n int")
    order = Window.partitionBy("h").orderBy("n", "key", "key2")

    def fits(low: str, high: str):
        return F.coalesce(100 * F.col(high).cast("long") >= threshold * F.col(low).cast("long"), F.lit(False))

    def other(at: str):
        return F.coalesce((F.col(f"{at}key") != F.col("key")) | (F.col(f"{at}key2") != F.col("key2")) | (F.col(f"{at}n") != F.col("n")), F.lit(False))

    def met(rows: DataFrame) -> DataFrame:
        """Entries whose shingle is led by another class of a size that could link."""
        beside = rows.select("h", *name, *(F.lag(c).over(order).alias(f"p{c}") for c in name), *(F.lead(c).over(order).alias(f"f{c}") for c in name))
        # beyond a run of copies of one class stands another class, so copies at either end stay until they are merged
        return beside.where((other("p") & fits("n", "pn")) | (other("f") & fits("fn", "n")) | (~other("p") & F.col("pkey").isNotNull()) | (~other("f") & F.col("fkey").isNotNull())).groupBy("h", *name).agg(F.lit(1).alias("one")).drop("one")

    least = f"greatest(1, ((n * {threshold}L + 99) div 100) * {SHARED_PERCENT} div 100)"
    kept = scratch.table(met(entries))
    for _ in range(PRUNING_ROUNDS):
        enough = kept.groupBy(*name).agg(F.count("*").alias("s")).where(F.expr(f"s >= {least}"))
        fewer = scratch.table(met(kept.join(enough.select(*name), name)))
        scratch.drop(kept)
        kept = fewer

    # row blocks: by the least leading shingle, the large ones cut
    rows = scratch.table(kept.groupBy(*name).agg(F.min("h").alias("lead")).join(classes, name))
    blocks = max(1, -(-2 * rows.count() // block_rows))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("lead"), F.lit(blocks)))
    weight = rows.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / F.lit(block_rows)), F.ceil(F.sum(F.col("n").cast("long")) / F.lit(block_cells))).alias("cuts"))
    cut = F.pmod(F.xxhash64("rep"), F.least("cuts", F.lit(_CUTS)))
    rows = scratch.table(rows.join(weight, "block").select(*name, F.col("rep").alias("node"), (F.col("block") * _CUTS + cut).alias("block")))

    # pairs of blocks that share leading shingles at sizes that could link, and the rows that share enough of them
    placed = scratch.table(kept.join(rows, name).select("h", "block", "node", "n"))
    held = placed.groupBy("h", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("node").alias("one"), F.max("node").alias("two"))
    left, right = (held.select("h", *(F.col(c).alias(f"{side}{c}") for c in ("block", "low", "high", "one", "two"))) for side in ("i", "j"))
    pairs = left.join(right, "h").where((F.col("iblock") < F.col("jblock")) | ((F.col("iblock") == F.col("jblock")) & (F.col("ione") < F.col("itwo"))))
    pairs = pairs.where(fits("jlow", "ihigh") & fits("ilow", "jhigh"))
    ends = F.expr("IF(iblock = jblock, array(named_struct('block', iblock, 'side', 0)), array(named_struct('block', iblock, 'side', 0), named_struct('block', jblock, 'side', 1)))")
    sides = pairs.select("h", F.col("iblock").alias("i"), F.col("jblock").alias("j"), F.explode(ends).alias("e")).select("h", "i", "j", "e.block", "e.side")
    members = placed.join(sides, ["h", "block"]).groupBy("i", "j", "side", "node", "n").agg(F.count("*").alias("s")).where(F.expr(f"s >= {least}"))
    members = members.groupBy(F.col("node").alias("id")).agg(F.collect_set(F.struct("i", "j", "side")).alias("pairs"))
    members = scratch.table(members)
    scratch.drop(placed)
    scratch.drop(kept)

    # a class is looked up by its representative's id; its text is read once more
    texts = docs.join(members.hint("shuffle_hash"), F.col("doc_id") == F.col("id")).select("text", F.col("id").alias("node"), "pairs")
    sets = texts.mapInArrow(_sets(shingle_words), "node long, pairs array<struct<i:long,j:long,side:int>>, hashes binary")
    dealt = sets.select("node", "hashes", F.explode("pairs").alias("p")).select("p.i", "p.j", "p.side", "node", "hashes")
    links = dealt.repartition("i", "j").sortWithinPartitions("i", "j", "side", "node").mapInArrow(_link_tasks(threshold), "a long, b long")
    groups = scratch.table(components(links, scratch))

    out = own.join(classes, name, "left").join(groups, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"))
