import itertools
import random

from lexmill.llm.ngram_join import jaccard_groups

SCHEMA = "doc_id long, text string, key string, n int, rep long"


def brute(rows):
    sets = {}
    for i, text in rows:
        ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        sets[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    rnd = random.Random(3)
    vocab = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(1, 120))]
        for _ in range(rnd.randint(1, 12)):
            own = list(base)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = rnd.choice(vocab).upper()
            rows.append((n, rnd.choice([" ", "\n"]).join(own)))
            n += 1
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, ""), (n + 4, "one two"), (n + 5, "One  two"), (n + 6, "x " * 50_000)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "k", 1, 9) for i, t in rows], SCHEMA)
    return [tuple(r) for r in jaccard_groups(spark, df, **kw).select("doc_id", "n_shingles", "component_id").collect()]


def test_groups_match_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    assert {i: (n, c) for i, n, c in run(spark, rows)} == want


def test_small_blocks_find_the_same_groups(spark):
    rows = corpus()
    assert {i: (n, c) for i, n, c in run(spark, rows, block_rows=3)} == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "a b c d e f g h"
    got = sorted(run(spark, [(4, text), (4, text), (None, text), (2, text)]), key=str)
    assert got == sorted([(4, 4, 2), (4, 4, 2), (2, 4, 2), (None, 4, 2)], key=str)
    assert run(spark, []) == []


def linked(sets, left, threshold=80):
    import numpy as np

    from lexmill.llm.ngram_join import block_links

    root = list(range(len(sets)))
    for i, j in block_links([np.array(sorted(s), dtype=np.uint64) for s in sets], left, threshold):
        assert 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])
        root = [root[i] if r == root[j] else r for r in root]
    return {frozenset(k for k, r in enumerate(root) if r == g) for g in set(root)}


def test_block_links_by_all_pairs():
    rnd = random.Random(7)
    for trial in range(60):
        base = [set(rnd.sample(range(400), rnd.randint(1, 60))) for _ in range(5)]
        sets = []
        for _ in range(rnd.randint(2, 25)):
            own = set(rnd.choice(base))
            for _ in range(rnd.randint(0, 6)):
                own.add(rnd.randrange(400)) if rnd.random() < 0.5 else own.discard(rnd.choice(sorted(own) or [0]))
            sets.append(own | {1000})
        left = rnd.choice([len(sets), rnd.randint(1, len(sets) - 1)])
        root = list(range(len(sets)))
        for i, j in itertools.combinations(range(len(sets)), 2):
            if (left == len(sets) or i < left <= j) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root = [root[i] if r == root[j] else r for r in root]
        assert linked(sets, left) == {frozenset(k for k, r in enumerate(root) if r == g) for g in set(root)}


def test_a_tie_of_very_large_sets_links():
    import numpy as np

    from lexmill.llm.ngram_join import block_links

    both = 8 * 186_415
    n = both // 8 * 9
    a = np.arange(n, dtype=np.uint64)
    b = np.concatenate((a[:both], np.arange(n - both, dtype=np.uint64) + np.uint64(10 * n)))
    assert block_links([a, b], 1, 80) == [(0, 1)]
    assert block_links([a, np.append(b, np.uint64(99 * n))], 1, 80) == []


def test_a_long_chain_and_a_group_over_many_blocks(spark):
    """Neighbours of a chain share most shingles, its ends none; a group of near copies is larger than a block."""
    words = [f"c{k}" for k in range(60 + 8 * 150)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 100])) for k in range(140)]
    rnd = random.Random(1)
    base = [f"b{k}" for k in range(80)]
    for k in range(120):
        own = list(base)
        own[rnd.randrange(80)] = f"x{k}"
        rows.append((1000 + k, " ".join(own)))
    rows += [(5000 + k, f"passage shared by many texts of all kinds and lengths here {k} " * 3) for k in range(40)]
    got = {i: (n, c) for i, n, c in run(spark, rows, block_rows=8)}
    assert got == brute(rows)
    assert len({c for i, (_, c) in got.items() if 1000 <= i < 2000}) == 1
