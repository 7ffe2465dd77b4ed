import random
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers

from lexmill.llm import lang_id
from lexmill.llm.scratch import Scratch, shared_dir, swept
from lexmill.llm.token_counts import load_tokenizer
from tests.llm import test_decontaminate, test_ngram_join
from tests.llm.test_models import WORDS as LONG
from tests.llm.test_models import text
from tests.llm.test_tables import brute_lines

WORDS = {
    "en": "the house near river and they walk there with some other people while morning light falls over green hills beyond".split(),
    "de": "das haus steht nahe dem fluss und sie gehen dort mit anderen leuten wenn licht über grüne hügel fällt".split(),
}


def brute_passages(rows, words=51):
    """Lines of each text that belong to a run of ``words`` words or more which an earlier place has."""
    lines = {i: [(k, x.split()) for k, x in enumerate(t.split("\n")) if x.split()] for i, t in rows}
    places = defaultdict(list)
    for i, own in lines.items():
        for a in range(len(own)):
            for step in (1, -1):
                run, n, z = [], 0, a
                while 0 <= z < len(own) and n < words:
                    run.append(z)
                    n += len(own[z][1])
                    z += step
                if n >= words:
                    run.sort()
                    text = "\n".join(rows_text(rows, i)[own[k][0]] for k in run)
                    places[(step, text)].append((i, own[run[0]][0], own[run[-1]][0]))
    gone = defaultdict(set)
    for found in places.values():
        first = min(found)
        for i, a, z in found:
            if i != first[0] or a > first[2]:
                gone[i] |= set(range(a, z + 1))
    return gone


def rows_text(rows, i):
    return dict(rows)[i].split("\n")


def corpus():
    rnd = random.Random(21)

    def prose(lang, n):
        return " ".join(rnd.choice(WORDS[lang]) + (str(rnd.randrange(30)) if rnd.random() < 0.3 else "") for _ in range(n))

    rows, lang = [], {}
    for k in range(70):
        lang[k] = rnd.choice(["en", "de"])
        rows.append((k, "\n".join(prose(lang[k], rnd.randint(3, 40)) for _ in range(rnd.randint(1, 5)))))
    passage = "\n".join(prose("en", 30) for _ in range(3))
    for k in (5, 17, 40):
        rows[k] = (k, rows[k][1] + "\n" + passage + "\n" + prose("en", 6))
    for k, of in ((80, 3), (81, 3), (82, 9)):
        own = rows[of][1].replace("\n", " ").split(" ")
        own[len(own) // 2] = "edited"
        rows.append((k, " ".join(own)))
    item = prose("en", 20)
    rows.append((90, prose("en", 10) + " " + item + " " + prose("en", 10)))
    rows += [(91, "12345 +++ ,,, \n 99"), (92, ""), (93, "?? !!"), (94, prose("de", 2500))]
    return rows, {**lang, 80: "en", 94: "de"}, [(1, item), (2, "an item that nobody has in any text at all so it stays unmet for ever and ever")]


def test_each_stage_does_its_part_and_keeps_the_rest(spark, tmp_path):
    rnd = random.Random(12)
    rows = [(k, text(rnd, lang, rnd.randint(30, 90)) + "\n" + text(rnd, lang, 20), lang, f"s{k % 3}") for k, lang in enumerate(rnd.choice(list(LONG)) for _ in range(60))]
    passage = " ".join(f"bench{k}" for k in range(20))
    rows += [
        (100, None, "en", "s0"), (101, "", "en", "s0"), (102, "12 34 ...", "en", "s0"),  # no language
        (103, rows[5][1], rows[5][2], "s1"), (104, rows[5][1], rows[5][2], "s1"),  # copies
        (105, text(rnd, "en", 30) + " " + passage + " " + text(rnd, "en", 30), "en", "s2"),  # a leak
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    given = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, given, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"stage{k}"))
            given = spark.read.parquet(str(tmp_path / f"stage{k}"))
        left[name] = sorted(r.doc_id for r in out.collect())
    all_ids = sorted(r[0] for r in rows)
    assert left["language identification"] == [i for i in all_ids if i not in (100, 101, 102)]
    assert left["line dedup"] == left["language identification"]
    # the copies' repeated lines are cut, so what is left of both is empty and linked with nothing, or they are dropped here
    assert set(left["near duplicates"]) <= set(left["line dedup"]) and set(range(60)) <= set(left["near duplicates"])
    assert left["decontamination"] == [i for i in left["near duplicates"] if i != 105]
    assert sorted(set(left["best-fit packing"])) == left["decontamination"]


def test_every_stage_by_brute_force(spark, tmp_path):
    rows, lang, items = corpus()
    df = spark.createDataFrame([(i, t, lang.get(i), "s", len(t), i * 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, text_hash long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, held = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    scratch = Scratch(spark, "stages")
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, str(tmp_path)))
        held.append(docs.collect())
    assert all(d.columns == df.columns for d in [spark.createDataFrame(h) for h in held[:4]])

    # 1: the network by plain convolution
    net = lang_id.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    want = []
    for i, t in rows:
        raw = t.encode()
        starts = [min(a, max(0, len(raw) - 256)) for a in range(0, max(len(raw), 1), 256)]
        x = np.stack([np.frombuffer(raw[a : a + 256].ljust(256, b"\0"), np.uint8) for a in starts])
        z = (np.maximum(np.concatenate([r.max(axis=1) for r in lang_id._responses(net, x)], axis=1), 0) @ net.out + net.out_bias).mean(axis=0)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if any(c.isalpha() for c in t) and p.max() >= corpus_pipeline.LEAST_LANGUAGE_SCORE:
            want.append((i, t))
    assert sorted((r.doc_id, r.text) for r in held[0]) == want and {91, 92, 93}.isdisjoint(i for i, _ in want) and len(want) > 60
    # 2
    rest, gone = dict(brute_lines(want)), brute_passages(want)
    want = [(i, rest[i] if not gone[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in want]
    assert sorted((r.doc_id, r.text, r.n_chars) for r in held[1]) == [(i, t, len(t)) for i, t in want] and sum(map(len, gone.values())) >= 4
    # 3
    groups = test_ngram_join.brute(want)
    want = [(i, t) for i, t in want if groups[i][1] == i]
    assert sorted((r.doc_id, r.text) for r in held[2]) == want and len({80, 81, 82} - {i for i, _ in want}) >= 1
    # 4
    bad = {i for i, _ in test_decontaminate.brute(want, items)}
    want = [(i, t) for i, t in want if i not in bad]
    assert 90 in bad and sorted((r.doc_id, r.text) for r in held[3]) == want
    # 5
    with open(public_tokenizers.path(corpus_pipeline.VOCABULARY), encoding="utf-8") as f:
        tok = load_tokenizer(f.read())
    pieces = set()
    for i, t in want:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        pieces |= {(i, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in held[4]} == pieces
    room = defaultdict(list)
    for r in held[4]:
        room[r.sequence_id].append((r.offset, r.length))
    for own in room.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect())) == sorted((i, k, c) for i, k, _, _, c in pieces)


def test_stages_take_nulls_repeats_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, node int, h long"
    same = " ".join(WORDS["en"]) + "\nsecond line of it"
    rows = [(None, same, "en"), (None, same, None), (3, same, "en"), (3, same, "en"), (4, None, "de"), (5, " ".join(WORDS["de"]) * 3, "de"), (6, "", None), (7, "x" * 70_000, None)]
    spark.createDataFrame([(1, "nothing like it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, given in enumerate((rows, [])):
        docs = spark.createDataFrame([(i, t, n, "s", 9, "r", 1, 2) for i, t, n in given], schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = Scratch(spark, "edge").table(stage(spark, docs, str(tmp_path)))
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        got = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        kept = [r.doc_id for r in got if r.piece == 0]
        assert (kept.count(None) == 2 and kept.count(3) == 1 and 4 not in kept and 6 not in kept) if not k else got == []


def test_scratch_goes_when_swept(spark):
    with swept(spark):
        out = Scratch(spark, "sweep").table(spark.range(3))
        assert out.count() == 3
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out._scratch_path)
    assert not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
    assert shared_dir(spark)
