import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.llm import resharding


def carried_out(spark, rows, shards, path):
    df = spark.createDataFrame(rows, "doc_id long, text string, old_shard int, shard string, slot int, row string")
    return resharding.reshard_and_rewrite(spark, df, F.col("old_shard"), shards, path).collect()


def sizes(got, which):
    out = Counter()
    for r in got:
        out[r[which]] += r["size"]
    return out


def check(rows, got, shards):
    """Every row once, in its shard and slot, the fewest bytes moved for the sizes reached."""
    size = lambda t: len((t or "").encode()) + 8
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.old_shard) for r in got) == Counter((i, size(t), crc(t), o or 0) for i, t, o, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    old, new = sizes(got, "old_shard"), sizes(got, "shard")
    moved = sum(r["size"] for r in got if r.shard != r.old_shard)
    assert moved == sum(max(0, new[j] - old[j]) for j in range(shards))
    return new, moved


def test_large_and_small_shards_move_the_fewest_bytes(spark, tmp_path):
    rows = [(k, "x" * 3000, 0, "s", 1, "r") for k in range(300)] + [(1000 + k, "y" * 92, 1, "s", 1, "r") for k in range(1500)]
    new, moved = check(rows, carried_out(spark, rows, 2, str(tmp_path / "o")), 2)
    assert max(new.values()) - min(new.values()) <= 3008 and 376_200 - 3008 <= moved <= 376_200 + 3008


@pytest.mark.parametrize("seed", [1, 2])
def test_random_shards_by_row(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(k % 300, rnd.choice(["same", "z" * rnd.randint(0, 900), None, "", "é" * rnd.randint(0, 200)]), rnd.choice([0, 0, 0, 1, 2, 9, None]), "s", 1, "r") for k in range(900)]
    rows += [(7, "copy " * 40, 0, "s", 1, "r")] * 300 + [(None, "no id", 3, "s", 1, "r"), (8, "long " * 4000, 1, "s", 1, "r")]
    got = carried_out(spark, rows, 5, str(tmp_path / "o"))
    new, _ = check(rows, got, 5)
    rest = [n for j, n in new.items() if n < 20_000 or j != max(new, key=new.get)]
    assert max(rest) - min(rest) < 4500


def test_shards_that_fit_are_left_alone(spark, tmp_path):
    rows = [(k, "t" * 50, k % 4, "s", 1, "r") for k in range(400)]
    got = carried_out(spark, rows, 4, str(tmp_path / "o"))
    assert all(r.shard == r.old_shard for r in got) and len(got) == 400
    assert carried_out(spark, [], 4, str(tmp_path / "p")) == []
