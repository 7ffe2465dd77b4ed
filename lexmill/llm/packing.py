"""Best-fit packing of token sequences by a linear grouping scheme.

Lengths are integers up to the capacity, so everything that decides which
lengths share a sequence works on their histogram, whose size does not follow
the corpus:

1. large lengths are cut, in order, into groups of equal cardinality and rounded
   up to the largest of their group;
2. the few rounded sizes are packed by the configuration program (column
   generation over a small simplex basis, priced by an integer knapsack), whole
   configurations first;
3. actual lengths take the places of the rounded ones, and what room that frees
   stays usable;
4. configurations that actual lengths fill badly are given back; they, what the
   rounding of the program left over and the small lengths go best fit, longest
   first, into the fullest sequence that still holds them.  Of a few group counts
   and fill bounds the one with the fewest sequences is taken.

Runs of equal sequences stay one plan row, so a plan is a few thousand rows at
any corpus size.  Documents are then ranked within their length (in salted
buckets; a length that a third of all pieces share is spread) and look their
place up by rank.

Defined edge cases: null text counts as empty and is one end token; a null
doc_id is packed as any other; repeated rows are packed each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.llm.merging import Merger, prove
from lexmill.llm.scratch import Scratch
from lexmill.llm.token_counts import load_tokenizer

CAPACITY = 2048
SCHEMES = ((32, 1 / 8), (64, 1 / 4), (128, 1 / 4))
#: configurations filled less than this by actual lengths are given back to best fit
FILLS = (0.0, 0.9, 0.95, 0.98, 0.995)
MEMO_ENTRIES = 1_000_000
MEMO_BYTES = 64
BLOCK_BYTES = 1 << 21
BUCKET_ROWS = 500_000


# --- the plan, from a histogram of lengths ---------------------------------------------------


def _knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int, most: np.ndarray) -> tuple[float, np.ndarray]:
    """Best bounded choice of sizes by value; ``most`` bounds each size's count."""
    best = np.zeros(capacity + 1)
    took = []
    for s, v, m in zip(sizes.tolist(), value.tolist(), most.tolist(), strict=True):
        m = min(m, capacity // s)
        took.append([])
        k = 1
        while m > 0 and v > 0:
            k = min(k, m)
            w = k * s
            if w > capacity:
                break
            with_it = best[: capacity + 1 - w] + k * v
            better = np.zeros(capacity + 1, dtype=bool)
            better[w:] = with_it > best[w:] + 1e-12
            best[w:] = np.where(better[w:], with_it, best[w:])
            took[-1].append((k, better))
            m -= k
            k *= 2
    c = int(np.argmax(best))
    value_best, count = float(best[c]), np.zeros(len(sizes), dtype=np.int64)
    for i in range(len(sizes) - 1, -1, -1):
        for k, better in reversed(took[i]):
            if better[c]:
                count[i] += k
                c -= k * int(sizes[i])
    return value_best, count


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Whole configurations of the fractional optimum: (count of each size, times)."""
    k = len(sizes)
    basis = np.diag(np.minimum(capacity // sizes, np.maximum(need, 1))).astype(float)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(k))
        value, column = _knapsack(sizes, dual, capacity, need)
        if value <= 1 + 1e-7:
            break
        x, d = np.linalg.solve(basis, need.astype(float)), np.linalg.solve(basis, column.astype(float))
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[:, int(np.argmin(ratio))] = column
    x = np.linalg.solve(basis, need.astype(float))
    return [(basis[:, j].astype(np.int64), int(np.floor(x[j] + 1e-9))) for j in range(k) if x[j] >= 1 - 1e-9]


def plan(counts: np.ndarray, capacity: int = CAPACITY, schemes: tuple[tuple[int, float], ...] = SCHEMES, fills: tuple[float, ...] = FILLS) -> list[tuple[int, tuple[int, ...]]]:
    """Runs of equal sequences: (number of sequences, lengths in each).  ``counts[l]`` is how many have length l.

    Every scheme (number of groups, least large share of the capacity) is solved,
    and its configurations kept down to each of ``fills``; the fewest sequences win.
    """
    counts = np.array(counts, dtype=np.int64)
    best = None
    for groups, large_share in schemes:
        runs = _grouped(counts, capacity, groups, large_share)
        for fill in fills:
            kept = [r for r in runs if sum(r[1]) >= fill * capacity]
            left = counts.copy()
            for times, lengths in kept:
                for length in lengths:
                    left[length] -= times
            done = _best_fit(kept, left, capacity)
            if best is None or sum(n for n, _ in done) < sum(n for n, _ in best):
                best = done
    return best


def _grouped(counts: np.ndarray, capacity: int, groups: int, large_share: float) -> list[tuple[int, tuple[int, ...]]]:
    """Whole configurations of the rounded large lengths, with actual lengths in their places."""
    counts = counts.copy()
    runs: list[tuple[int, tuple[int, ...]]] = []
    if counts[capacity]:
        runs.append((int(counts[capacity]), (capacity,)))
        counts[capacity] = 0
    least = max(1, int(capacity * large_share))
    large = np.arange(capacity - 1, least - 1, -1)
    n = int(counts[large].sum())
    if n:
        # equal cardinality, longest first; each group is rounded up to its longest
        held: list[list[list[int]]] = []
        sizes, each, room = [], -(-n // groups), 0
        for length in large.tolist():
            left = int(counts[length])
            while left:
                if not room:
                    held.append([])
                    sizes.append(length)
                    room = each
                take = min(left, room)
                held[-1].append([length, take])
                left, room = left - take, room - take
        size, need = np.array(sizes), np.array([sum(c for _, c in h) for h in held])
        for column, times in configurations(size, need, capacity):
            times = min([times, *(sum(c for _, c in held[g]) // int(column[g]) for g in np.flatnonzero(column))])
            while times > 0:
                slots = [g for g in np.flatnonzero(column) for _ in range(column[g])]
                # a run lasts as long as the actual lengths of every group's front do
                run = min([times, *(held[g][0][1] // int(column[g]) if held[g][0][1] >= column[g] else 0 for g in np.flatnonzero(column))])
                if run:
                    lengths = tuple(held[g][0][0] for g in slots)
                    for g in slots:
                        held[g][0][1] -= run
                else:
                    run, lengths = 1, []
                    for g in slots:
                        held[g][0][1] -= 1
                        lengths.append(held[g][0][0])
                        if not held[g][0][1]:
                            held[g].pop(0)
                    lengths = tuple(lengths)
                for g in np.flatnonzero(column):
                    if held[g] and not held[g][0][1]:
                        held[g].pop(0)
                runs.append((run, lengths))
                times -= run
    return runs


def _best_fit(runs: list[tuple[int, tuple[int, ...]]], counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Place what is left, longest first, each into the fullest open sequence that holds it."""
    free: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]
    for times, lengths in runs:
        free[capacity - sum(lengths)].append((times, lengths))
    some = np.array([bool(f) for f in free])
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            at = np.flatnonzero(some[length:])
            if not len(at):
                per = capacity // length
                whole, rest = divmod(left, per)
                for times, k in ((whole, per), (1, rest)):
                    if times and k:
                        free[capacity - k * length].append((times, (length,) * k))
                        some[capacity - k * length] = True
                break
            room = length + int(at[0])
            times, lengths = free[room].pop()
            some[room] = bool(free[room])
            if times > left:
                free[room].append((times - left, lengths))
                some[room] = True
                times = left
            free[room - length].append((times, (*lengths, length)))
            some[room - length] = True
            left -= times
    return [run for f in free for run in f]


def slots(runs: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted by length and rank."""
    out, used, first = [], {}, 0
    for times, lengths in runs:
        offset = 0
        for length in lengths:
            out.append((length, used.get(length, 0), first, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        first += times
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 4)


# --- pieces and places ------------------------------------------------------------------------


#: a Python worker keeps its tokenizer and memo from task to task
_worker: dict = {}


def _pieces(shared, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, proof = shared.value
        if _worker.get("spec") != spec:
            _worker.update(spec=spec, tok=load_tokenizer(spec), merger=Merger(spec) if proof["plain"] else None, memo={})
        tok, merger, memo = _worker["tok"], _worker["merger"], _worker["memo"]
        special = [a.lower().encode() for a in proof["added"]]
        end = np.array([end_id], "<u4").tobytes()

        def runs_of(text: bytes | None) -> list[bytes]:
            # lower case first makes runs alike; not where an added token may be near
            if not text:
                return []
            if proof["lower"]:
                low = text.lower()
                if not any(a in low for a in special):
                    text = low
            return text.split() if proof["space"] else [text]

        def learn(parts: set[bytes]) -> list[bytes]:
            """Put the ids of new runs in the memo: plain ones are merged together, the library has the rest."""
            new, rest = list(parts), parts
            if merger is not None and new:
                plain, ids, n = merger.words(new)
                raw, end, done = ids.tobytes(), (4 * np.cumsum(n)).tolist(), plain.tolist()
                memo.update(zip((p for p, ok in zip(new, done, strict=True) if ok), (raw[a:b] for a, b in zip([0, *end], end, strict=False)), strict=True))
                rest = [p for p, ok in zip(new, done, strict=True) if not ok]
            found = tok.encode_batch_fast([p.decode("utf-8", "replace") for p in rest], add_special_tokens=False)
            for p, e in zip(rest, found, strict=True):
                memo[p] = array("I", e.ids).tobytes()
            return new

        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()
            rows: list[tuple] = []
            at = 0
            while at < len(docs):
                # a block of whole texts; what it needs beyond the memo's room is forgotten after it
                split, size = [], 0
                while at + len(split) < len(docs) and (not split or size < BLOCK_BYTES):
                    text = texts[at + len(split)]
                    size += len(text or b"")
                    split.append(runs_of(text))
                added = learn(set().union(*split) - memo.keys())
                for doc, parts in zip(docs[at:], split, strict=False):
                    own = b"".join(map(memo.__getitem__, parts)) + end
                    n = len(own) // 4
                    for k, start in enumerate(range(0, n, capacity)):
                        part = own[4 * start : 4 * (start + capacity)]
                        rows.append((doc, k, start, len(part) // 4, zlib.crc32(part)))
                full = len(memo) > MEMO_ENTRIES
                for p in added:
                    if full or len(p) > MEMO_BYTES:
                        memo.pop(p, None)
                at += len(split)
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _places(shared):
    """Look each piece's place up by its length and its rank within that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            sequence = table[at, 2] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(table[at, 3])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    schemes: tuple[tuple[int, float], ...] = SCHEMES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document's ids end with ``end_id``; a longer one than ``capacity`` is cut
    into pieces of that length, the last one shorter.  What encoding relies on
    (white space parts words, ASCII case makes no difference, plain words merge as
    ``merging`` does) is proven for the file first; where a proof fails, whole
    texts or runs go to the library.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shared = spark.sparkContext.broadcast((spec, prove(spec, load_tokenizer(spec))))
    scratch = Scratch(spark, "packing")
    pieces = scratch.table(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pieces(shared, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    placed = spark.sparkContext.broadcast(slots(plan(counts, capacity, schemes)))

    buckets = max(16, -(-int(counts.max()) // BUCKET_ROWS))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rn", F.row_number().over(within)).join(base, ["length", "bucket"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rn") - 1).cast("long").alias("rank")).mapInArrow(_places(placed), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
