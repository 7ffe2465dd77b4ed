import itertools
import random
import re

from lexmill.llm.decontaminate import AGREE_PERCENT, LEAST_TOKENS, MASKS, MATCH_TOKENS, ONE_OFF_MASKS, ONE_OFF_TOKENS, Seeds, contaminated, drop_contaminated


def tokens(text):
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = set()
    for i, t in docs:
        d = tokens(t)
        for j, s in items:
            x = tokens(s)
            n = len(x)
            if n < LEAST_TOKENS:
                if n and d == x:
                    out.add((i, j))
                continue
            w = min(MATCH_TOKENS, n)
            need = -(-AGREE_PERCENT * w // 100) if n >= MATCH_TOKENS else n - (n >= ONE_OFF_TOKENS)
            for a in range(-n, len(d) + 1):
                same = [d[a + k] == x[k] for k in range(n) if 0 <= a + k < len(d)]
                if any(sum(same[k : k + w]) >= need for k in range(len(same) - w + 1)):
                    out.add((i, j))
                    break
    return out


def test_masks_hit_every_window_with_two_substitutions():
    for k in range(3):
        for gone in itertools.combinations(range(MATCH_TOKENS), k):
            assert any(all(a + p not in gone for p, bit in enumerate(m) if bit == "1") for m in MASKS for a in range(MATCH_TOKENS - len(m) + 1))


def test_masks_hit_every_shorter_window_with_one_substitution():
    for n in range(ONE_OFF_TOKENS, MATCH_TOKENS):
        for gone in [(), *((p,) for p in range(n))]:
            assert any(all(a + p not in gone for p, bit in enumerate(m) if bit == "1") for m in ONE_OFF_MASKS for a in range(n - len(m) + 1))


def test_found_as_by_brute_force(spark):
    rnd = random.Random(2)
    vocab = [f"w{k}" for k in range(300)] + ["é", "ñandú"]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([2, 3, 5, 7, 8, 10, 12, 14, 30, 50])))) for k in range(30)] + [(30, None), (31, ""), (None, "some item without any id here " * 4)]
    docs = []
    for k in range(150):
        text = [rnd.choice(vocab) for _ in range(rnd.randint(0, 120))]
        own = tokens(items[rnd.randrange(30)][1])
        cut = own[rnd.randint(0, len(own) // 2) :]
        for _ in range(rnd.randint(0, 3)):
            cut[rnd.randrange(len(cut))] = "changed"
        at = rnd.randint(0, len(text))
        docs.append((k, ", ".join(text[:at] + [w.upper() for w in cut] + text[at:])))
    docs += [(950 + k, t) for k, (_, t) in enumerate(items[:30])] + [(None, items[4][1]), (None, "of no item")]
    docs += [(900, None), (901, ""), (902, "x " * 30_000 + items[3][1]), (903, items[3][1]), (903, items[3][1])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, n_match string")
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    for size in (8_000_000, 300):
        got = {(r.doc_id, r.item_id) for r in contaminated(spark, df, bench, block_bytes=size).collect()}
        assert got == brute(docs, items)
    clean = drop_contaminated(spark, df, bench, block_bytes=300)
    assert clean.columns == df.columns
    bad = {i for i, _ in brute(docs, items)}
    assert sorted((r.doc_id or -1) for r in clean.collect()) == sorted((i or -1) for i, t in docs if i not in bad or t == "of no item")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p")], "item_id long, text string")
    assert contaminated(spark, none, bench).count() == 0
    assert contaminated(spark, bench.withColumnRenamed("item_id", "doc_id"), bench.limit(0)).count() == 0


def test_monotonous_texts_stay_small():
    import resource
    import time

    import numpy as np

    data = b"x " * 60_000 + b"y " + b"x " * 30
    began, before = time.process_time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for item, want in (("x " * 50, (0, 50, 50)), ("x " * 25 + "y " + "x " * 24, (59_975, 50, 50)), ("x " * 25 + "z " + "x " * 24, (0, 49, 50))):
        (got,) = Seeds([(1, item)]).found(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert got == (0, 0, *want)
    assert time.process_time() - began < 10 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
    assert Seeds([(1, "x y x x")]).found(np.frombuffer(data, np.uint8), np.array([0, len(data)])) == []
