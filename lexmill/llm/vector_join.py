"""Exact cosine near-duplicates by a subspace pigeonhole join.

``cos(x, y) >= c`` for unit vectors means ``|x - y|^2 <= 2 - 2c``.  Vectors are
rotated to the principal axes of the whole table (its second moments are summed
over every row) and cut into blocks of consecutive axes.  The squared budget is
shared among the blocks in proportion to their variance; if every block of a
pair exceeded its share, the pair would exceed the budget, so each link is
within the share in at least one block.

1. Each block is a range join.  A k-d tree of the block (its cuts are medians of
   a bounded sample; every row is placed) deals vectors to cells, and a vector
   visits the cells of lower number that its block's radius reaches.  Its depth
   is the one with the least estimated cost: where the table is so even that
   cells do not thin out, few are cut.  A cell with more than ``part_rows``
   vectors is cut into parts, and each pair of parts is a task group of its own.
2. What moves is the number of a vector and the block's coordinates in single
   precision.  A task group answers with the vectors that have a partner within
   the share, not with pairs.
3. Only those vectors are fetched, whole, and their candidates verified where
   they meet, by cosine in double precision.  A pair is counted in the first
   block that holds it, so the union needs no pass over pairs; links leave a task
   as counts and as a spanning forest.

Vectors with equal components collapse into one class first, keyed by their
components: copies add to counts and never meet as pairs.

Defined edge cases: vectors that are null, empty, zero or hold null or
non-finite components link with nothing, not even with equal ones; vectors of
different length never link; a null vec_id counts as a vector and is never the
smallest id (a component of nulls alone has none); rows that share a vec_id are
vectors of their own; repeated rows each count; ties at the threshold link; an
empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.components import components
from lexmill.llm.scratch import Scratch

THRESHOLD = 0.95
BLOCK_AXES = 16
PART_ROWS = 4096
#: a part holds at most this many components
PART_CELLS = 4_000_000
#: rows from which the trees are cut, and fewest of them in a cell
SAMPLE_ROWS = 32_768
LEAST_SAMPLE = 16
#: longer vectors are cut into blocks as they are, without rotation
ROTATED_AXES = 2048
#: slack on squared distances: of single-precision screening, and of shares in double precision
_SCREEN, _EXACT = 1e-5, 1e-9
#: estimated cost of a row that is sent, against that of a comparison on one axis
_ROW_COST = 16_000.0


def _rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix of unit rows in double precision) for each length in a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.diff(column.offsets.to_numpy())
    start = np.cumsum(length) - length
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        yield n, at, _unit(flat[start[at][:, None] + np.arange(n)])


def _unit(x: np.ndarray) -> np.ndarray:
    # by the largest component first, so that squares stay finite
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


# --- the plan of one vector length --------------------------------------------------------------


@dataclass
class Block:
    """Axes ``a`` to ``b``, their share of the squared budget, and a tree of ``depth`` levels: axis and cut of each inner node."""

    a: int
    b: int
    share: float
    depth: int
    axis: np.ndarray
    cut: np.ndarray

    def home(self, y: np.ndarray) -> np.ndarray:
        """Number of the cell of each row."""
        node = np.zeros(len(y), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (y[np.arange(len(y)), self.axis[node]] >= self.cut[node])
        return node - ((1 << self.depth) - 1)

    def reached(self, y: np.ndarray, radius2: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell within the squared radius of a row, its own cell included."""
        row, node = np.arange(len(y)), np.zeros(len(y), dtype=np.int64)
        beyond, total = np.zeros(y.shape), np.zeros(len(y))
        for _ in range(self.depth):
            axis = self.axis[node]
            away = y[row, axis] - self.cut[node]
            near = 2 * node + 1 + (away >= 0)
            old = beyond[np.arange(len(row)), axis]
            far_total = total - old * old + np.maximum(away * away, old * old)
            far = np.flatnonzero(far_total <= radius2)
            more = beyond[far]
            more[np.arange(len(far)), axis[far]] = np.maximum(np.abs(away[far]), old[far])
            row, node = np.concatenate((row, row[far])), np.concatenate((near, 4 * node[far] + 3 - near[far]))
            beyond, total = np.concatenate((beyond, more)), np.concatenate((total, far_total[far]))
        return row, node - ((1 << self.depth) - 1)


@dataclass
class Plan:
    """How vectors of one length are compared."""

    axes: np.ndarray | None
    blocks: list[Block]
    part_rows: int

    def turned(self, x: np.ndarray) -> np.ndarray:
        return x if self.axes is None else x @ self.axes


def grow(y: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis of greatest spread and its median for every inner node of a tree over the rows of ``y``."""
    axis, cut = np.zeros((1 << levels) - 1, dtype=np.int64), np.zeros((1 << levels) - 1)
    held = [y]
    for k in range(len(axis)):
        own = held[k]
        if len(own):
            axis[k] = int(np.argmax(own.std(axis=0)))
            cut[k] = float(np.median(own[:, axis[k]]))
        right = own[:, axis[k]] >= cut[k]
        held += [own[~right], own[right]]
        held[k] = own[:0]
    return axis, cut


def plan_block(sample: np.ndarray, a: int, share: float, rows: int, part_rows: int) -> Block:
    """The depth with the least cost of sending and comparing, estimated on the sample for ``rows`` rows."""
    most = max(0, int(np.log2(max(1, min(len(sample) / LEAST_SAMPLE, 2 * rows / part_rows)))))
    width = sample.shape[1]
    axis, cut = grow(sample, most)
    probe = sample[:: max(1, len(sample) // 512)]
    best = None
    for depth in range(most + 1):
        block = Block(a, a + width, share, depth, axis[: (1 << depth) - 1], cut[: (1 << depth) - 1])
        own = np.bincount(block.home(sample), minlength=1 << depth) * (rows / max(len(sample), 1))
        row, cell = block.reached(probe, share)
        met = np.bincount(cell, minlength=1 << depth) * (rows / max(len(probe), 1))
        visits = np.maximum(met - own, 0) / 2
        cuts, more = np.ceil(own / part_rows), np.ceil(visits / part_rows)
        cost = _ROW_COST * (own * (cuts + more) + visits * cuts).sum() + width * (own * (own / 2 + visits)).sum()
        if best is None or cost < best[0]:
            best = (cost, block)
    return best[1]


def plan_length(sample: np.ndarray, axes: np.ndarray | None, variance: np.ndarray, rows: int, threshold: float, block_axes: int, part_rows: int) -> Plan:
    y = sample if axes is None else sample @ axes
    total, budget, blocks = variance.sum(), 2 - 2 * threshold, []
    for a in range(0, len(variance), block_axes):
        b = min(a + block_axes, len(variance))
        blocks.append(plan_block(y[:, a:b], a, float(budget * variance[a:b].sum() / total) + _EXACT, rows, part_rows))
    return Plan(axes, blocks, part_rows)


def _moments(wanted: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, _, x in _rows(batch.column(0)):
                if n in wanted:
                    total[n] = total.get(n, 0) + x.T @ x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.ravel().tolist() for m in total.values()], pa.list_(pa.float64()))], ["dim", "m"])

    return run


def rotations(vectors: DataFrame, dims: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Principal axes (columns) by falling variance, and the variances, of each length; partial sums are added in Spark."""
    parts = vectors.select("v").mapInArrow(_moments(dims), "dim int, m array<double>")
    rows = parts.select("dim", F.posexplode("m").alias("k", "v")).groupBy("dim", "k").agg(F.sum("v").alias("v")).orderBy("dim", "k").collect()
    out = {}
    for n in dims:
        total = np.array([r["v"] for r in rows if r["dim"] == n]).reshape(n, n)
        value, axes = np.linalg.eigh(total / np.trace(total))
        out[n] = (axes[:, ::-1], np.maximum(value[::-1], 1e-12))
    return out


def plans(classes: DataFrame, threshold: float, block_axes: int = BLOCK_AXES, part_rows: int = PART_ROWS, sample_rows: int = SAMPLE_ROWS) -> dict[int, Plan]:
    """A plan for each length that two classes or more have; lengths with few vectors are one block in one cell."""
    counts = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).where("n > 1").collect()}
    out, large = {}, []
    for dim, n in counts.items():
        part = max(64, min(part_rows, PART_CELLS // dim))
        if n > part:
            large.append(dim)
        else:
            out[dim] = Plan(None, [Block(0, dim, 2 - 2 * threshold + _EXACT, 0, np.zeros(0, np.int64), np.zeros(0))], part)
    turned = rotations(classes.where(F.col("dim").isin(large)), [d for d in large if d <= ROTATED_AXES]) if any(d <= ROTATED_AXES for d in large) else {}
    for dim in large:
        part, n = max(64, min(part_rows, PART_CELLS // dim)), counts[dim]
        most = max(1024, min(sample_rows, 4 * PART_CELLS // dim))
        draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(min(1.0, 1.5 * most / n) * (1 << 30))
        picked = classes.where((F.col("dim") == dim) & draw).select("v").limit(most).collect()
        sample = _unit(np.array([r["v"] for r in picked], dtype=np.float64).reshape(-1, dim))
        axes, variance = turned.get(dim, (None, np.maximum((sample * sample).mean(axis=0) if len(sample) else np.ones(dim), 1e-12)))
        out[dim] = plan_length(sample, axes, variance, n, threshold, block_axes, part)
    return out


# --- candidates ----------------------------------------------------------------------------------


def _cells(shared):
    """Number, own cell or visited cells and coordinates of each vector in every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_of = shared.value
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            for dim, at, x in _rows(batch.column(1)):
                if dim not in plan_of:
                    continue
                plan = plan_of[dim]
                for k, block in enumerate(plan.blocks):
                    y = plan.turned(x)[:, block.a : block.b]
                    home = block.home(y)
                    row, cell = block.reached(y, block.share + _SCREEN)
                    ahead = cell <= home[row]
                    row, cell = row[ahead], cell[ahead]
                    low = y.astype(np.float32)
                    raw = pa.array([low[r].tobytes() for r in range(len(low))], pa.binary())
                    n = len(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(cell.astype(np.int32)), pa.array(cell == home[row]), pa.array(node[at][row]), raw.take(pa.array(row))],
                        ["dim", "block", "cell", "home", "node", "y"],
                    )

    return run


#: side of a row in its task group: compared with the right ones, with the left ones, or among themselves
_LEFT, _RIGHT, _BOTH = 0, 1, 2
_GROUP = ["dim", "block", "cell", "i", "j"]


def _by_group(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """(group, its rows) of batches sorted by the first ``columns`` columns."""
    name, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(columns)], axis=1)
        edges = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = tuple(keys[a].tolist())
            if own != name:
                if held:
                    yield name, held
                name, held = own, []
            held.append(batch.slice(a, b - a))
    if held:
        yield name, held


def _within(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distance of every row of ``p`` to every row of ``q``."""
    return np.maximum((p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * (p @ q.T), 0)


def _screen(shared):
    """Of each task group, the rows that have a partner within the block's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_of = shared.value
        for name, held in _by_group(batches, 5):
            block = plan_of[name[0]].blocks[name[1]]
            rows = pa.Table.from_batches(held).combine_chunks()
            side, node = rows["side"].to_numpy(), rows["node"].to_numpy()
            y = np.frombuffer(b"".join(rows["y"].to_pylist()), dtype=np.float32).reshape(len(node), -1)
            left, right = np.flatnonzero(side != _RIGHT), np.flatnonzero(side != _LEFT)
            if not len(left) or not len(right):
                continue
            # |p - q|^2 <= s where p q - |p|^2 / 2 - |q|^2 / 2 >= - s / 2: one product and one comparison
            half, one = (y * y).sum(axis=1, keepdims=True) / -2, np.ones((len(y), 1), np.float32)
            p, q = np.concatenate((y, half, one), axis=1), np.concatenate((y, one, half), axis=1)[right].T.copy()
            met = np.zeros(len(node), dtype=bool)
            for a in range(0, len(left), 512):
                l = left[a : a + 512]
                close = p[l] @ q >= np.float32((block.share + _SCREEN) / -2)
                same = np.flatnonzero(side[l] == _BOTH)
                close[same, np.searchsorted(right, l[same])] = False
                met[l] |= close.any(axis=1)
                met[right] |= close.any(axis=0)
            at = np.flatnonzero(met)
            if len(at):
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(at), v, np.int32)) for v in name), pa.array(side[at]), pa.array(node[at])], [*_GROUP, "side", "node"])

    return run


def _surely(value: np.ndarray, bound: float, exact, slack: float, below: bool) -> np.ndarray:
    """``value <= bound`` (or >=), decided by ``exact(i, j)`` where rounding of the product might."""
    out = value <= bound if below else value >= bound
    i, j = np.nonzero(np.abs(value - bound) <= slack)
    for a in range(0, len(i), 65_536):
        p, q = i[a : a + 65_536], j[a : a + 65_536]
        got = exact(p, q)
        out[p, q] = got <= bound if below else got >= bound
    return out


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links of rows ``left`` with columns ``right`` (numbers of one set)."""
    out, new_row, new_col = [], np.ones(len(left), dtype=bool), np.ones(len(right), dtype=bool)
    for start in range(len(left)):
        if not new_row[start]:
            continue
        new_row[start] = False
        todo = [start]
        while todo:
            cols = np.flatnonzero(linked[todo].any(axis=0) & new_col)
            new_col[cols] = False
            out += [(int(left[start]), int(c)) for c in right[cols]]
            rows = np.flatnonzero(linked[:, cols].any(axis=1) & new_row) if len(cols) else cols
            new_row[rows] = False
            out += [(int(left[start]), int(r)) for r in left[rows]]
            todo = rows.tolist()
    return [(a, b) for a, b in out if a != b]


def _verify(shared, threshold: float):
    """Links of each task group, counted in the first block that holds them: counts by node (b null) and a spanning forest (n 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_of = shared.value
        for name, held in _by_group(batches, 5):
            plan, which = plan_of[name[0]], name[1]
            rows = pa.Table.from_batches(held).combine_chunks()
            side, node, copies = (rows[c].to_numpy() for c in ("side", "node", "copies"))
            ((_, _, x),) = _rows(rows["v"].combine_chunks() if rows["v"].num_chunks != 1 else rows["v"].chunk(0))
            y = plan.turned(x)
            left, right = np.flatnonzero(side != _RIGHT), np.flatnonzero(side != _LEFT)
            if not len(left) or not len(right):
                continue
            linked = np.zeros((len(left), len(right)), dtype=bool)
            for a in range(0, len(left), 256):
                l = left[a : a + 256]
                ok = _surely(x[l] @ x[right].T, threshold, lambda p, q: (x[l[p]] * x[right[q]]).sum(axis=1), 1e-12, False)
                # both ends own a place in this cell: each pair once
                ok &= ~((side[l] == _BOTH)[:, None] & (side[right] == _BOTH)[None, :] & (node[l][:, None] >= node[right][None, :]))
                ok &= node[l][:, None] != node[right][None, :]
                for k, block in enumerate(plan.blocks[: which + 1]):
                    if not ok.any():
                        break
                    u, v = y[l, block.a : block.b], y[right, block.a : block.b]
                    inside = _surely(_within(u, v), block.share, lambda p, q: ((u[p] - v[q]) ** 2).sum(axis=1), 1e-12, True)
                    ok &= inside if k == which else ~inside
                linked[a : a + 256] = ok
            if not linked.any():
                continue
            gain = np.zeros(len(node), dtype=np.int64)
            for a in range(0, len(left), 256):
                got = linked[a : a + 256]
                gain[left[a : a + 256]] += (got.astype(np.float64) @ copies[right].astype(np.float64)).astype(np.int64)
                gain[right] += (copies[left[a : a + 256]].astype(np.float64) @ got.astype(np.float64)).astype(np.int64)
            links = _forest(linked, node[left], node[right])
            at = np.flatnonzero(gain)
            a = [*node[at].tolist(), *(p for p, _ in links)]
            b = [*([None] * len(at)), *(q for _, q in links)]
            n = [*gain[at].tolist(), *([0] * len(links))]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    return run


def _dealt(cells: DataFrame, part: dict[int, int]) -> DataFrame:
    """Rows of cells beside every task group in which they are compared."""
    key = ["dim", "block", "cell"]
    rows = F.lit(PART_ROWS)
    for dim, n in part.items():
        rows = F.when(F.col("dim") == dim, F.lit(n)).otherwise(rows)
    size = cells.groupBy(*key).agg(F.count_if("home").alias("own"), F.count("*").alias("n")).where("own > 0 AND n > 1")
    size = size.select(*key, F.ceil(F.col("own") / rows).cast("int").alias("cuts"), F.ceil((F.col("n") - F.col("own")) / rows).cast("int").alias("more"))
    dealt = cells.join(size, key).withColumn("cut", F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("cuts")).otherwise(F.col("more"))).cast("int"))
    among = f"transform(sequence(0, cuts - 1), k -> named_struct('i', least(k, cut), 'j', greatest(k, cut), 'side', IF(k = cut, {_BOTH}, IF(cut < k, {_LEFT}, {_RIGHT}))))"
    ahead = f"IF(more = 0, array(), transform(sequence(0, greatest(more, 1) - 1), k -> named_struct('i', cut, 'j', cuts + k, 'side', {_LEFT})))"
    visits = f"transform(sequence(0, cuts - 1), k -> named_struct('i', k, 'j', cuts + cut, 'side', {_RIGHT}))"
    placed = dealt.select(*key, "node", "y", F.explode(F.expr(f"IF(home, concat({among}, {ahead}), {visits})")).alias("p"))
    return placed.select(*key, "p.i", "p.j", "p.side", "node", "y")


def cosine_groups(
    spark: SparkSession,
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    block_axes: int = BLOCK_AXES,
    part_rows: int = PART_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``."""
    scratch = Scratch(spark, "vector-join")
    given = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
    element = "float" if given.schema["v"].dataType.elementType.typeName() == "float" else "double"
    # + 0.0 makes -0.0 equal 0.0
    given = given.withColumn("v", F.transform(F.col("v").cast(f"array<{element}>"), lambda x: x + F.lit(0.0).cast(element)))
    sound = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    key = F.md5(F.concat_ws(" ", F.transform("v", lambda x: x.cast("string"))))
    given = given.withColumn("key", F.when(sound, key))
    grouped = given.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = scratch.table(grouped.select("key", "least", "copies", "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("node")))

    plan_of = plans(classes, threshold, block_axes, part_rows, sample_rows)
    shared = spark.sparkContext.broadcast(plan_of)
    cells = scratch.table(classes.select("node", "v").mapInArrow(_cells(shared), "dim int, block int, cell int, home boolean, node long, y binary"))
    groups = _dealt(cells, {d: p.part_rows for d, p in plan_of.items()})
    partners = groups.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_screen(shared), "dim int, block int, cell int, i int, j int, side int, node long")
    partners = scratch.table(partners)
    scratch.drop(cells)
    whole = partners.join(classes.select("node", "copies", "v"), "node").select(*_GROUP, "side", "node", "copies", "v")
    found = scratch.table(whole.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_verify(shared, threshold), "a long, b long, n long"))
    scratch.drop(partners)

    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = scratch.table(components(found.where("b IS NOT NULL").select("a", "b"), scratch))
    least = roots.join(classes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component"))
    linked = roots.join(least, "root").select("node", "component").join(counts, "node", "left")
    known = scratch.table(classes.select("key", "least", "copies", "node").join(linked, "node", "left").select(F.col("key").alias("ckey"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component_id")))
    out = given.select("vec_id", "key").join(known, F.col("key") == F.col("ckey"), "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
