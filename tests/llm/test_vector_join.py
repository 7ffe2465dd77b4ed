import math

import numpy as np
import pytest

from lexmill.llm import vector_join


def brute(rows, threshold=0.95):
    """(vec_id, n_links, component_id, kept) of every row, by all pairs."""
    vec = []
    for _, v in rows:
        ok = v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)
        x = np.array(v, dtype=float) if ok else None
        vec.append(x / np.abs(x).max() if ok else None)
    near = [[i != j and x is not None and y is not None and len(x) == len(y) and (np.array_equal(x, y) or float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)) >= threshold) for j, y in enumerate(vec)] for i, x in enumerate(vec)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near[i][j] and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((k, sum(near[i]), least, k is not None and k == least))
    return sorted(out, key=str)


def found(spark, rows, kind="double", **how):
    df = spark.createDataFrame([(k, v, "n", 1, "x") for k, v in rows], f"vec_id long, embedding array<{kind}>, node string, key int, v string")
    return sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_join.cosine_groups(spark, df, **how).collect()], key=str)


def test_null_and_repeated_ids_and_odd_vectors(spark):
    rows = [(None, [0.0, 0.0, 1.0]), (5, [0.0, 0.01, 1.0]), (1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.01])]
    rows += [(None, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (8, [-1.0, -1.0, 1.0]), (8, [-1.0, -1.0, 1.0]), (9, [1e300, 1e300, -1e300]), (10, [1e-300, 1e-300, -1e-300])]
    rows += [(11, None), (12, []), (13, [0.0, 0.0, 0.0]), (14, [math.nan, 1.0, 1.0]), (15, [None, 1.0, 1.0]), (16, [math.inf, 1.0, 1.0]), (17, [1.0, 0.0]), (18, [1.0]), (19, [2.0]), (20, [-0.0, 1.0, 0.0])]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("part_rows, dim", [(64, 40), (64, 9), (4096, 40)])
def test_trees_parts_and_a_hot_group_by_brute_force(spark, part_rows, dim):
    rnd = np.random.default_rng(dim + part_rows)
    hot = rnd.normal(size=dim)
    x = [hot + rnd.normal(size=dim) * 0.15 for _ in range(170)] + [rnd.normal(size=dim) * np.linspace(3, 0.3, dim) for _ in range(250)]
    x += [x[k] + rnd.normal(size=dim) * 0.2 for k in range(170, 230)] + [x[3]] * 5
    order = rnd.permutation(len(x))
    rows = [(int(k), x[k].tolist()) for k in order]
    got = found(spark, rows, part_rows=part_rows, block_axes=4)
    assert got == brute(rows)
    assert sum(r[1] for r in got) > 1000


def test_a_tree_reaches_every_cell_within_the_radius():
    rnd = np.random.default_rng(2)
    y = rnd.normal(size=(600, 5)) * [2, 1, 1, 0.5, 0.5]
    axis, cut = vector_join.grow(y, 5)
    block, r2 = vector_join.Block(0, 5, 0.4, 5, axis, cut), 0.4
    home = block.home(y)
    reached = {(int(i), int(c)) for i, c in zip(*block.reached(y, r2), strict=True)}
    assert all((i, int(home[i])) in reached for i in range(600)) and len(reached) < 600 * 20
    close = ((y[:, None] - y[None]) ** 2).sum(axis=2) <= r2
    assert all((int(i), int(home[j])) in reached for i, j in zip(*np.nonzero(close), strict=True))


def test_long_vectors_and_lengths_of_one(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=5000)
    rows = [(1, base.tolist()), (2, (base + 0.1 * rnd.normal(size=5000)).tolist()), (3, rnd.normal(size=5000).tolist()), (4, [1.0] * 7)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
