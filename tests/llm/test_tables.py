import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import licences, line_dedup, resharding
from lexmill.llm.components import components
from lexmill.llm.scratch import Scratch
from lexmill.llm.vector_join import cosine_groups


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(500, k) for k in range(501, 540)] + [(7, 7), (None, 3), (3, None), (61, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {k: 0 for k in range(62)} | {k: 500 for k in range(500, 540)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def brute_lines(rows):
    import hashlib

    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out.append((i, None))
            continue
        lines = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        r = [((h[k - 1] if k else 0) * 1000003 + h[k]) % 2147483647 for k in range(len(h))]
        ends = [k for k in range(len(r)) if k == len(r) - 1 or (k and r[k] < r[k - 1] and r[k] <= r[k + 1])]
        kept, a = [], 0
        for e in ends:
            chunk = lines[a : e + 1]
            body = "\n".join(chunk)
            if len(chunk) < 2 or not body.strip(" \t\r\n") or body not in seen:
                kept += chunk
            if len(chunk) >= 2:
                seen.add(body)
            a = e + 1
        out.append((i, "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_by_brute_force(spark):
    rnd = random.Random(6)
    pool = [[f"line {k} {j} é" for j in range(rnd.randint(2, 9))] for k in range(8)]
    rows = []
    for k in range(60):
        lines = [f"own {k} {j}" for j in range(rnd.randint(0, 6))]
        for _ in range(rnd.randint(0, 2)):
            lines += rnd.choice(pool)
        rows.append((k, "\n".join(lines)))
    rows += [(90, None), (91, ""), (92, "\n\n\n"), (93, "\n\n\n"), (94, rows[3][1]), (95, "one line"), (96, "one line"), (97, "\n".join(f"{k % 50}" for k in range(20_000)))]
    df = spark.createDataFrame([(i, t, "h", 3) for i, t in rows], "doc_id long, text string, h string, s int")
    out = line_dedup.dedup_lines(spark, df)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == brute_lines(rows)
    assert set(df.columns) <= set(out.columns)
    twice = line_dedup.dedup_lines(spark, spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (None, "a\nb"), (2, "a\nb")], "doc_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in twice.collect()), key=str) == sorted([(1, ""), (1, ""), (None, "a\nb"), (2, "")], key=str)
    assert line_dedup.dedup_lines(spark, df.limit(0)).count() == 0


def test_line_dedup_cuts_passages_to_their_true_ends(spark):
    def passage(name, *sizes):
        return [" ".join(f"{name}{k}w{j}" for j in range(n)) for k, n in enumerate(sizes)]

    planted = [passage("a", 60), passage("b", 3, 40, 9), passage("c", *[3] * 18), passage("d", 55, 4), passage("e", 2, 70, 5, 1), passage("f", 30, 10, 30)]
    short = passage("g", 25, 25)
    rows, want = [], []
    for k, p in enumerate([*planted, short]):
        for copy in range(3):
            before, after = [f"foreign {k} {copy} {j}" for j in range(copy + 1)], [f"own {k} {copy} {j}" for j in range(2)]
            rows.append((k * 3 + copy, "\n".join(before + p + after)))
            want.append((k * 3 + copy, "\n".join(before + (p if copy == 0 or p is short else []) + after), len(p) if copy and p is not short else 0))
    rows += [(90, "\n".join(passage("h", 60))), (91, "\n".join(passage("h", 60))), (92, "\n".join(["x"] * 200))]
    out = line_dedup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), passage_words=line_dedup.PASSAGE_WORDS).collect()
    got = {r["doc_id"]: (r["text"], r["__lines_removed"]) for r in out}
    assert {i: got[i] for i, _, _ in want[: 3 * len(planted)]} == {i: (t, n) for i, t, n in want[: 3 * len(planted)]}
    assert got[90][0] == rows[-3][1] and got[91] == ("", 1)
    assert len(got[92][0].split("\n")) <= 51


def test_licences_and_inheritance(spark):
    rows = [
        (1, "src/a/LICENSE", "Released under the MIT License."),
        (2, "src/a/b/c/x.py", "plain text\nof nothing"),
        (3, "src/a/b/y.py", "words\nLicensed under the Apache License, Version 2.0.\nmore words here, a lot of further prose about something else entirely, so most of it says nothing of terms"),
        (4, "src/z.py", "nothing"),
        (5, "other/q.py", "All rights reserved."),
        (6, "other/deep/er/w.py", None),
        (7, None, "no path"),
        (8, "src/a/b/c/x.py", ""),
        (9, "top.py", "x"),
        (9, "top.py", "x"),
        (10, "src/ab/t.py", "x"),
        (11, "long.txt", "filler words " * 20_000 + "\nThis work is licensed under the GNU General Public License, version 3."),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "id long, path string, text string, licence string")
    got = sorted(((r.id, r.own_licence, r.licence, r.licence_from, r.is_licence_file) for r in licences.scan(spark, df, "id", "path", "text").collect()), key=str)
    none = (None, None, None, False)
    assert got == sorted([
        (1, "MIT", "MIT", "src/a/LICENSE", True), (2, None, "MIT", "src/a/LICENSE", False), (3, "Apache-2.0", "Apache-2.0", "src/a/b/y.py", False),
        (4, *none), (5, "Proprietary", "Proprietary", "other/q.py", True), (6, None, "Proprietary", "other/q.py", False),
        (7, *none), (8, None, "MIT", "src/a/LICENSE", False), (9, *none), (9, *none), (10, *none), (11, "GPL-3.0", "GPL-3.0", "long.txt", False),
    ], key=str)
    assert licences.scan(spark, df.limit(0), "id", "path", "text").count() == 0


def test_licences_inside_lines_and_across_them(spark):
    prose = " ".join(f"word{k}" for k in range(400))
    gnu = "/* This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License\n * as published by the Free Software Foundation; either\n * version {} of the License, or (at your option) any later version. */\n"
    rows = [
        (1, "a.py", "alpha beta gamma delta Released under the MIT License. epsilon zeta eta theta", "MIT"),
        (2, "b.py", f"{prose} This work is licensed under the GNU Affero General Public License, version 3. {prose}", "AGPL-3.0"),
        (3, "c.py", gnu.format(2) + prose, "GPL-2.0"),
        (4, "d.py", gnu.format(3) + prose, "GPL-3.0"),
        (5, "e.py", f"{prose}\nLicensed under\nthe Apache\nLicense, Version\n2.0.\n{prose}", "Apache-2.0"),
        (6, "f.py", prose, None),
        (7, "g.py", "the license of this poet was released by version two of all work", None),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "id long, path string, text string")
    got = {r.id: (r.own_licence, r.is_licence_file) for r in licences.scan(spark, df, "id", "path", "text").collect()}
    assert got == {r[0]: (r[3], False) for r in rows}


@pytest.mark.parametrize("parts", [4000, 5])
def test_vector_links_by_brute_force(spark, parts):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 24))
    x = np.concatenate([b + rng.normal(size=(rng.integers(1, 14), 24)) * 0.22 for b in base]).astype(np.float32)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    n = len(rows)
    rows += [(n, rows[0][1], 2), (n + 1, rows[0][1], 2), (n + 2, [0.0] * 24, 0), (n + 3, [0.0] * 24, 0), (n + 4, None, 0), (n + 5, [math.nan] * 24, 0), (n + 6, [1.0, None] * 12, 0), (n + 7, [1.0, 2.0], 0), (n + 8, [1.0, 2.01], 0), (n + 9, [], 0), (n + 10, [math.inf] + [0.0] * 23, 0)]
    df = spark.createDataFrame([(*r, "n") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    links, root = defaultdict(set), {r[0]: r[0] for r in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, v, _ in rows:
        for j, w, _ in rows:
            if i < j and v and w and len(v) == len(w) and None not in v and None not in w:
                p, q = np.array(v, dtype=np.float32).astype(float), np.array(w, dtype=np.float32).astype(float)
                if np.isfinite(p).all() and np.isfinite(q).all() and p.any() and q.any() and p @ q / math.sqrt((p @ p) * (q @ q)) >= 0.95:
                    links[i].add(j), links[j].add(i)
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cosine_groups(spark, df, part_rows=parts).collect()}
    assert got == {i: (len(links[i]), find(i), find(i) == i) for i, _, _ in rows}
    assert sum(map(len, links.values())) > 100
    assert cosine_groups(spark, df.limit(0)).count() == 0


def test_min_cost_flow_by_enumeration():
    rnd = random.Random(9)
    for _ in range(60):
        n, m = rnd.randint(1, 3), rnd.randint(1, 3)
        supply = {i: rnd.randint(0, 4) for i in range(n)}
        room = {j: rnd.randint(0, 5) for j in range(m)}
        cost = {(i, j): rnd.randint(0, 5) for i in range(n) for j in range(m)}
        if sum(room.values()) < sum(supply.values()):
            with pytest.raises(ValueError):
                resharding.min_cost_flow(supply, room)
            continue
        flow = resharding.min_cost_flow(supply, room, lambda i, j: cost[i, j])
        assert all(sum(f for (a, _), f in flow.items() if a == i) == s for i, s in supply.items())
        assert all(sum(f for (_, b), f in flow.items() if b == j) <= r for j, r in room.items())
        states = {tuple(room[j] for j in range(m)): 0}
        for i in range(n):
            for _ in range(supply[i]):
                states = min_states((tuple(r - (k == j) for k, r in enumerate(s)), c + cost[i, j]) for s, c in states.items() for j in range(m) if s[j])
        assert sum(f * cost[k] for k, f in flow.items()) == min(states.values())


def min_states(items):
    out = {}
    for s, c in items:
        out[s] = min(c, out.get(s, c))
    return out


def test_reshard_is_even_and_gapless(spark):
    rnd = random.Random(8)
    rows = [(k, rnd.choice(["same text", "x" * rnd.randint(0, 3000), None, ""]), rnd.choice([0, 0, 0, 1, 2, None]), "q") for k in range(600)]
    rows += [(5, "again", 1, "q"), (5, "again", 1, "q"), (None, "no id", 7, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, old int, shard string")
    out = resharding.reshard(spark, df, F.col("old"), 6)
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(size) == set(range(6)) and max(size.values()) - min(size.values()) < max(r["size"] for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert resharding.reshard(spark, df.limit(0), F.col("old"), 6).count() == 0
