import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import tags as tg
from lexmill.functions import templates as tp
from lexmill.functions import text as X
from lexmill.operators import crf, dictseg, features, hybrid, instances, model, pretok, train
from lexmill.sources import config, corpus


def one(spark, col, schema="x string", row=("",)):
    return spark.createDataFrame([row], schema).select(col.alias("v")).first()["v"]


def test_tags_of_words_and_back(spark):
    words = ["a", "bc", "def", "ghij", "klmnop"]
    df = spark.createDataFrame([(words,)], "w array<string>")
    got = df.select(tg.words_to_tags(F.col("w")).alias("t"), F.array_join("w", "").alias("s"))
    assert got.first()["t"] == "S B E B B1 E B B1 B2 E B B1 B2 M M E".split()
    assert got.select(tg.tags_to_words(F.col("t"), F.col("s")).alias("w")).first()["w"] == words


@pytest.mark.parametrize(("tags", "text", "legacy", "lossless"), [(["B", "S"], "xy", ["", "y"], ["x", "y"]), (["B", "B1", "B", "E"], "abcd", ["a", "cd"], ["ab", "cd"]), (["B", "B1"], "ab", ["ab"], ["ab"])])
def test_ill_formed_tags(spark, tags, text, legacy, lossless):
    df = spark.createDataFrame([(tags, text)], "t array<string>, s string")
    assert df.select(tg.tags_to_words(F.col("t"), F.col("s")).alias("w")).first()["w"] == lossless
    assert df.select(tg.tags_to_words(F.col("t"), F.col("s"), legacy=True).alias("w")).first()["w"] == legacy


def test_templates(spark):
    got = one(spark, tp.expand(X.chars(F.col("x"))), row=("ab",))
    assert got == ["U00:_B-1", "U01:a", "U02:b", "U03:_B-1/a", "U04:a/b", "U05:_B-1/b", "U00:a", "U01:b", "U02:_B+1", "U03:a/b", "U04:b/_B+1", "U05:a/_B+1"]
    kept = features.sentence_features(spark.createDataFrame([("ab",), ("",)], "x string"), F.col("x"))
    assert sorted(r.feature for r in kept.collect()) == sorted(["U01:a", "U02:b", "U04:a/b", "U00:a", "U01:b", "U03:a/b"])
    wide = tp.expand(F.array(*[F.lit(x) for x in "aXbY"]), [tp.parse("T:%x[0,1]%x[-2,0]")], width=2)
    assert one(spark, wide) == ["T:X_B-2", "T:Y_B-1"]
    for bad in ("%x[5,0]", "%x[0]"):
        with pytest.raises(ValueError):
            tp.parse(bad)
    assert [t.name for t in tp.read("# c\n\nU00:%x[0,0]\n")] == ["U00"]


def test_counts_rules_and_repairs(spark):
    df = spark.createDataFrame([("U01:x", 5), ("U01:y", 6), ("U09:x", 1)], "feature string, cnt long")
    assert sorted(r.feature for r in features.filtered(df, corpus.rules(spark, "U01 5")).collect()) == ["U01:y", "U09:x"]
    v = spark.createDataFrame([(-5,), (-1,), (7,)], "c long")
    assert [r[0] for r in v.select(X.repair_filter(F.col("c"))).collect()] == [4294967291, -1, 7]
    assert v.select(X.repair_stat(F.col("c"))).first()[0] == 2147483642
    assert [r[0] for r in spark.createDataFrame([(79,), (80,), (99999,), (100000,)], "c long").select(X.frequency_bucket(F.col("c"))).collect()] == ["79", "80-1000", "10000-100000", "100000-"]


def test_dictionary_and_shrink(spark):
    f = spark.createDataFrame([("c",), ("a",), ("b",), ("a",)], "feature string")
    found = features.dictionary(f)
    assert {r.feature: r.attr_id for r in found.collect()} == {"a": 0, "b": 1, "c": 2}
    assert features.check_dense(found).first()["dense"]
    uses = spark.createDataFrame([(0,)] * 3 + [(1,)] * 2 + [(2,)] * 5 + [(-1,)], "attr_id int")
    assert sorted((r.old_id, r.attr_id) for r in features.shrink(found, uses, 2).collect()) == [(0, 0), (2, 1)]


def test_walks_and_regions(spark):
    words = spark.createDataFrame([(w,) for w in ("一千", "千年", "来人", "人类", "历史")], "word string")
    row = dictseg.both(spark.createDataFrame([("一千年来人类历史",)], "run string"), words).first()
    assert row.fwd == [2, 1, 2, 1, 2] and row.bwd == [1, 2, 1, 2, 2] and not row.same
    got = spark.createDataFrame([(row.fwd, row.bwd)], "f array<int>, b array<int>").select(dictseg.regions(F.col("f"), F.col("b")).alias("r")).first()["r"]
    assert [tuple(x)[:6] for x in got] == [(0, 3, 0, 0, 2, 2), (3, 6, 2, 2, 4, 4)]
    numbers = dictseg.forward(spark.createDataFrame([("二十三一千",)], "run string"), words, numbers=True)
    assert numbers.first()["lengths"] == [5]


def test_walk_and_regions_of_long_runs(spark):
    """Words that begin in one block of the walk and end in the next; a long dictionary word beside short ones."""
    rng = np.random.default_rng(4)
    longest = "".join("abc"[k] for k in rng.integers(0, 3, 300))
    words = ["ab", "abc", "cab", "bca", "ca", longest]
    runs = ["".join("abc"[k] for k in rng.integers(0, 3, n)) for n in (1, 255, 256, 257, 2000)] + ["ab" * 200 + longest + "ca"]

    def walk(run, have, longest):
        out, at = [], 0
        while at < len(run):
            n = next((k for k in range(min(longest, len(run) - at), 1, -1) if run[at : at + k] in have), 1)
            out.append(n)
            at += n
        return out

    def regions(f, b):
        e, g = list(itertools.accumulate(f)), list(itertools.accumulate(b))
        at = [0, *(x for x in e if x in set(g))]
        spans = [(a, z, *(sum(x <= p for x in side) for p in (a, z) for side in (e, g))) for a, z in zip(at, at[1:])]
        return [s for s in spans if s[4] - s[2] > 1 or s[5] - s[3] > 1]

    got = dictseg.both(spark.createDataFrame([(r,) for r in runs], "run string"), spark.createDataFrame([(w,) for w in words], "word string"))
    rows = got.withColumn("regions", dictseg.regions(F.col("fwd"), F.col("bwd"))).collect()
    assert {r.run for r in rows} == set(runs)
    for r in rows:
        assert r.fwd == walk(r.run, set(words), 300)
        assert r.bwd == walk(r.run[::-1], {w[::-1] for w in words}, 300)[::-1]
        assert [tuple(x) for x in r.regions] == regions(r.fwd, r.bwd)


def test_pretokens(spark):
    got = one(spark, pretok.groups(F.col("x")), row=("我爱 3.14元。",))
    assert [(t["text"], t["type"]) for t in got] == [("我爱", "CWORD"), (" ", "PUNCT"), ("3.14", "NUMBER"), ("元", "CWORD"), ("。", "PUNCT")]
    legacy = one(spark, pretok.groups(F.col("x"), legacy_trailing_drop=True), row=("我爱 3.14元。",))
    assert [t["text"] for t in legacy] == ["我爱", " ", "3.14", "元"]
    toks = one(spark, pretok.tokens(F.col("x")), row=("don't foo_bar a1b2 x.y 1,000 3.a " + "z" * 300,))
    assert [(t["text"], t["type"]) for t in toks if t["type"]] == [("don't", "WORD"), ("foo_bar", "WORD"), ("a1b2", "WORD"), ("x.y", "WORD"), ("1,000", "NUM"), ("3", "NUM"), ("a", "WORD")]
    assert all(t["end"] - t["begin"] == len(t["text"]) for t in toks) and one(spark, pretok.tokens(F.col("x")), row=("",)) == []


def weights(rng, attributes=7, labels=3):
    return crf.Weights(*(rng.normal(size=s) for s in (labels, labels, (labels, labels), (attributes, labels))))


def test_decoding_and_probability_by_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 4):
        w, attrs = weights(rng), rng.integers(-1, 7, (n, 2))
        paths = sorted(((crf.path_score(w, attrs, np.array(y)), y) for y in itertools.product(range(3), repeat=n)), key=lambda c: -c[0])
        assert tuple(crf.viterbi(w, attrs)) == paths[0][1]
        best = crf.n_best(w, attrs, 5)
        assert [tuple(y) for _, y in best] == [y for _, y in paths[:5]] and np.allclose([s for s, _ in best], [s for s, _ in paths[:5]])
        log_z = math.log(sum(math.exp(s) for s, _ in paths))
        assert np.isclose(crf.log_prob(w, attrs, np.array(paths[0][1])), paths[0][0] - log_z)
    assert np.allclose(crf.log_prob(crf.Weights.zeros(2, 6), np.zeros((5, 1), int), np.zeros(5, int)), -5 * math.log(6))
    ties = crf.Weights.zeros(1, 3)
    assert crf.viterbi(ties, np.zeros((3, 1), int)).tolist() == [0, 0, 0]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_update_is_the_gradient(n):
    rng = np.random.default_rng(n)
    w, attrs, y = weights(rng), rng.integers(-1, 7, (n, 2)), rng.integers(0, 3, n)
    moved = w.copy()
    grown, logp = crf.update(moved, attrs, y, 1e-3)
    assert np.isclose(logp, crf.log_prob(w, attrs, y)) and np.isclose(moved.norm2 - w.norm2, grown)
    for a, b in zip(w.arrays(), moved.arrays(), strict=True):
        for at in np.ndindex(a.shape):
            old = a[at]
            a[at] = old + 1e-5
            up = crf.log_prob(w, attrs, y)
            a[at] = old - 1e-5
            down = crf.log_prob(w, attrs, y)
            a[at] = old
            assert np.isclose((b[at] - old) / 1e-3, (up - down) / 2e-5, atol=1e-4)


def test_training_raises_likelihood_and_averages(spark):
    sentences = spark.createDataFrame([(f"k{k}", w) for k, w in enumerate([["the", "cat"], ["a", "cat", "sat"], ["the", "hat"], ["a", "hat"]] * 4)], "key string, words array<string>")
    found = features.dictionary(features.sentence_features(sentences, F.array_join("words", "")))
    enc = instances.encode_words(sentences, "key", "words", found)
    params, told = config.TrainingParams(sigma=5.0), []
    train.train(enc, params, 2, 1, 3, on_round=lambda k, df: told.extend((k, r.epoch, r.loglik) for r in df.collect()))
    assert [t[:2] for t in told] == [(0, 0), (0, 1), (0, 2)] and told[0][2] < told[2][2] < 0
    for groups, rounds in ((1, 1), (2, 2)):
        w = train.train(enc, params, groups, rounds, 12, save_round=lambda df, k: spark.createDataFrame(df.collect(), df.schema))
        out = hybrid.segment_crf(sentences.select("key", F.array_join("words", "").alias("s")), "key", "s", found, model.attr_weights(w), w)
        want = {r.key: r.words for r in sentences.collect()}
        got = {r.key: r.words for r in out.collect()}
        assert sum(got[k] == want[k] for k in want) >= (16 if groups == 1 else 12)


def test_hybrid_keeps_every_character(spark):
    words = spark.createDataFrame([(w,) for w in ("一千", "千年", "来人", "人类", "历史")], "word string")
    found = features.dictionary(features.sentence_features(spark.createDataFrame([("一千年来人类历史",)], "x string"), F.col("x")))
    aw = found.select("attr_id", F.array(*[((F.col("attr_id") * 31 + k * 17) % 23 - 11).cast("double") for k in range(6)]).alias("w"))
    mw = spark.createDataFrame([("bw", 0, 0.0)], "kind string, idx int, w double")
    texts = spark.createDataFrame([(1, "一千年来人类历史, x 12"), (2, "")], "id long, t string")
    for legacy in (False, True):
        got = sorted((r.begin, r.end, r.text) for r in hybrid.segment(texts, "id", "t", words, found, aw, mw, legacy_context=legacy).collect() if r.key == 1)
        assert "".join(t for _, _, t in got) == "一千年来人类历史, x 12"
        assert all(z == b and t == "一千年来人类历史, x 12"[a:z] for (a, z, t), (b, _, _) in zip(got, got[1:]))


def choice(spark, weights):
    """A dictionary of features and weights by feature and tag; whatever is not named is 0."""
    found = spark.createDataFrame([(f, k) for k, f in enumerate(weights)], "feature string, attr_id int")
    aw = spark.createDataFrame([(k, [float(w.get(t, 0)) for t in tg.TAGS]) for k, w in enumerate(weights.values())], "attr_id int, w array<double>")
    return found, aw, spark.createDataFrame([("bw", 0, 0.0)], "kind string, idx int, w double")


def test_hybrid_by_groups_with_types_and_offsets(spark):
    words = spark.createDataFrame([("我爱",), ("hello",)], "word string")
    texts = spark.createDataFrame([(1, "我爱 3.14元 hello word_x")], "id long, t string")
    got = sorted(tuple(r)[1:] for r in hybrid.segment(texts, "id", "t", words, *choice(spark, {"U01:爱": {"E": 1}})).collect())
    assert got == [(0, 2, "我爱", "CWORD"), (2, 3, " ", "PUNCT"), (3, 7, "3.14", "NUMBER"), (7, 8, "元", "CWORD"), (8, 9, " ", "PUNCT"), (9, 14, "hello", "ALPHA"), (14, 15, " ", "PUNCT"), (15, 21, "word_x", "ALPHA")]


@pytest.mark.parametrize(("weights", "want"), [
    ({"U01:一": {"B": 5}}, "一千/年/来人/类/历史"),  # the first region: 一 begins a word, as forward has it
    ({"U01:一": {"S": 5}}, "一/千年/来人/类/历史"),  # alone, as backward has it
    ({"U01:类": {"E": 5}, "U01:一": {"B": 5}}, "一千/年/来/人类/历史"),
    ({"U01:类": {"E": 5}, "U01:一": {"S": 5}}, "一/千年/来/人类/历史"),
    ({"U01:史": {"E": 5}}, "一千/年/来人/类/历史"),  # a tie: forward stays
])
def test_hybrid_takes_the_better_side_of_each_region(spark, weights, want):
    words = spark.createDataFrame([(w,) for w in ("一千", "千年", "来人", "人类", "历史")], "word string")
    texts = spark.createDataFrame([(1, "一千年来人类历史")], "id long, t string")
    for legacy in (False, True):
        got = sorted((r.begin, r.text) for r in hybrid.segment(texts, "id", "t", words, *choice(spark, weights), legacy_context=legacy).collect())
        assert "/".join(t for _, t in got) == want


def test_hybrid_context_decides(spark):
    """历史 behind the second region counts only with the corrected context: 类 at the end of a slice or before 历."""
    words = spark.createDataFrame([(w,) for w in ("一千", "千年", "来人", "人类", "历史")], "word string")
    texts = spark.createDataFrame([(1, "一千年来人类历史")], "id long, t string")
    weights = {"U04:类/历": {"E": 5}}
    for legacy, want in ((False, "来/人类"), (True, "来人/类")):
        got = sorted((r.begin, r.text) for r in hybrid.segment(texts, "id", "t", words, *choice(spark, weights), legacy_context=legacy).collect())
        assert "/".join(t for a, t in got if 3 <= a < 6) == want


def test_windows_give_the_features_of_sentences(spark):
    df = spark.createDataFrame([("abcab",), ("a",), ("",), (None,), ("ab",)], "x string")
    for patterns in (tp.DEFAULT, ("T:%x[0,0]",), ("T:%x[-3,0]/%x[2,0]",), ("T:%x[2,0]", "V:%x[4,0]"), ("T:%x[-4,0]",)):
        made = tuple(tp.parse(p) for p in patterns)
        want = sorted(map(tuple, features.count(features.sentence_features(df, F.col("x"), made)).collect()))
        assert sorted(map(tuple, features.count_sentences(df, F.col("x"), made).collect())) == want
        windows = features.windows(df, F.col("x"), made).select(F.explode(tp.window_features(F.col("window"), made)).alias("f"), "n").groupBy("f").agg(F.sum("n").alias("n"))
        whole = df.where("x <> ''").select(F.explode(tp.expand(X.chars(F.col("x")), made)).alias("f")).groupBy("f").agg(F.count("*").alias("n"))
        assert sorted(map(tuple, windows.collect())) == sorted(map(tuple, whole.collect()))


def test_calibration_finds_the_best_rate_tried():
    rng = np.random.default_rng(3)
    data = [(a, a[:, 0] % 3) for a in (rng.integers(0, 9, (5, 2)) for _ in range(30))]
    lam, eta, rate = 1 / (25 * len(data)), 0.1, 2.0
    base = -sum(len(y) for _, y in data) * math.log(3)
    for start, wanted in ((eta, 4), (eta * 4096, 4), (eta / 64, 3)):
        tried = {start * rate**k: crf._one_pass(data, 9, 3, lam, start * rate**k) for k in range(-40, 20)}
        up = [e for e in sorted(tried) if e >= start]
        up = list(itertools.takewhile(lambda e: tried[e] > base, up))
        down = [e for e in sorted(tried, reverse=True) if e < start and tried[e] > base][: max(0, wanted - len(up))]
        best = max(up + down, key=tried.get)
        assert np.isclose(crf.calibrate(data, 9, 3, lam, start, rate, wanted), 1 / (lam * best))
        assert tried[best] > base


def test_classic_tokens(spark):
    got = one(spark, pretok.tokens(F.col("x"), mode="classic"), row=(". & ' @. mail a.b@c.org I.B.M. it's AT&T www.x.com 3.14 我爱 x9",))
    assert [(t["text"], t["type"]) for t in got if t["type"]] == [("mail", "ALPHANUM"), ("a.b@c.org", "EMAIL"), ("I.B.M.", "ACRONYM"), ("it's", "APOSTROPHE"), ("AT&T", "COMPANY"), ("www.x.com", "HOST"), ("3.14", "NUM"), ("我", "CJ"), ("爱", "CJ"), ("x9", "ALPHANUM")]


def test_order_check_and_reports(spark):
    ranked = spark.createDataFrame([(0, 5.0), (1, 3.0), (2, 4.0), (3, 4.0)], "new_id int, score double")
    assert [tuple(r) for r in model.not_descending(ranked).collect()] == [(1, 3.0, 4.0)]
    lines = {r.tag: r.line for r in model.report(model.confusion(spark.createDataFrame([("S", "S"), ("B", "S")], "gold string, pred string"))).collect()}
    assert lines["S"] == "S precision=50.0000% recall=100.0000%" and "NaN" in lines["M"]
    part = model.accuracy(spark.createDataFrame([(["S", "B"], ["S", "E"])], "gold array<string>, pred array<string>"))
    both = model.merge(part.unionByName(part)).first()
    assert (both["items"], both.items_right, both.sentences, both.item_accuracy) == (4, 2, 2, 0.5)
    states = spark.createDataFrame([("k", [[1.0] * 6, [2.0] * 6])], "key string, states array<array<double>>")
    best = spark.createDataFrame([("k", [1, 2])], "key string, label_ids array<int>")
    small = {"bw": [0.5] * 6, "ew": [0.25] * 6, "tw": [float(i) for i in range(36)]}
    nodes, edges = model.lattice(states, best, small)
    assert nodes.count() == 12 and sorted((r.pos, r.label) for r in nodes.where("best").collect()) == [(0, 1), (1, 2)]
    assert [tuple(r) for r in edges.collect()] == [("k", 1, 2, 8.0)]
    told = sorted(tuple(r)[1:] for r in model.explain_path(states, best, small).collect())
    assert told == [(0, 1, 1.0, 0.5, 0.0, 0.0, 1.5), (1, 2, 2.0, 0.0, 8.0, 0.25, 10.25)]
    train_rows, held = train.split(spark.range(1000).withColumnRenamed("id", "k"), "k", 20)
    assert train_rows.count() + held.count() == 1000 and 150 < held.count() < 250
    dealt = instances.buckets(spark.range(500).withColumnRenamed("id", "key"), 10)
    assert dealt.select("bucket").distinct().count() == 10


def test_command_line_keeps_every_line(spark, tmp_path):
    from lexmill import cli

    def run(*argv):
        cli.run(cli.parser().parse_args([str(a) for a in argv]), spark)

    (tmp_path / "c.txt").write_text("the\tcat\nthe\tcat\na\that\n\nthe\tcat\n", encoding="utf-8")
    (tmp_path / "t.txt").write_text("thecat\n\nahat\nthecat\n", encoding="utf-8")
    (tmp_path / "g.txt").write_bytes("中国\t人民\n人民\n".encode("gbk"))
    (tmp_path / "r.txt").write_text("U01 1", encoding="utf-8")
    run("feature-count", tmp_path / "c.txt", tmp_path / "counts")
    run("feature-stat", tmp_path / "counts", tmp_path / "stat")
    run("feature-filter", tmp_path / "counts", tmp_path / "kept", "--rules", tmp_path / "r.txt")
    run("feature-dict", tmp_path / "kept", tmp_path / "dict")
    run("reverse-dict", tmp_path / "dict", tmp_path / "reverse")
    run("dict-size", tmp_path / "dict")
    run("instances", tmp_path / "c.txt", tmp_path / "inst", "--dictionary", tmp_path / "dict")
    assert spark.read.parquet(str(tmp_path / "inst")).count() == 4
    (tmp_path / "p.txt").write_text("iterations=6\nsigma=5\n", encoding="utf-8")
    run("train", tmp_path / "inst", tmp_path / "model", "--dictionary", tmp_path / "dict", "--properties", tmp_path / "p.txt")
    run("importance", tmp_path / "model", tmp_path / "rank")
    run("truncate", tmp_path / "model", tmp_path / "small", "--top", 5)
    run("test", tmp_path / "c.txt", "--model", tmp_path / "model")
    run("seg", tmp_path / "t.txt", tmp_path / "out", "--model", tmp_path / "model")
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [x.replace("\t", "") for x in lines] == ["thecat", "", "ahat", "thecat"] and lines[0] == lines[3]
    run("word-count", tmp_path / "g.txt", tmp_path / "gbk", "--charset", "GBK")
    assert {r.word: r.n for r in spark.read.parquet(str(tmp_path / "gbk")).collect()} == {"中国": 1, "人民": 2}


def test_small_readers(spark, tmp_path):
    (tmp_path / "w.txt").write_text(" ab \nc\nab\nxyz\n", encoding="utf-8")
    assert sorted(r.word for r in corpus.word_list(spark, str(tmp_path / "w.txt")).collect()) == ["ab", "xyz"]
    (tmp_path / "n.txt").write_text("U01:a\t-5\nbad\nU01:b\t7\textra\nU02:c\t9\n", encoding="utf-8")
    assert sorted(tuple(r) for r in corpus.feature_counts(spark, str(tmp_path / "n.txt")).collect()) == [("U01:a", -5), ("U02:c", 9)]
    (tmp_path / "l.txt").write_text("x 1 NN\ny 2 VB\n\nz 3 NN\n", encoding="utf-8")
    assert sorted(tuple(r) for r in corpus.column_labels(corpus.column_corpus(spark, str(tmp_path / "l.txt"))).collect()) == [("NN", 0), ("VB", 1)]
    corpus.write_tsv(spark.createDataFrame([("a", 1)], "f string, i int"), str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["a\t1"]
    wide = instances.encode(spark.createDataFrame([("k", ["a", "X", "b", "Y"])], "key string, items array<string>"), "key", F.col("items"), None, spark.createDataFrame([("T:aY", 3)], "feature string, attr_id int"), [tp.parse("T:%x[0,0]%x[1,1]")], width=2)
    assert [(r.attr_ids, r.n) for r in wide.collect()] == [([3, -1], 2)]


def test_model_tables(spark, tmp_path):
    rows = [("fw", k, float(v)) for k, v in enumerate([1, -2, 0, 0, 3, 0, 0, 0, 1, 0, 0, 0])] + [("bw", 0, 1.0)]
    w = spark.createDataFrame(rows, "kind string, idx int, w double")
    scored = model.scores(model.attr_weights(w))
    assert {r.attr_id: r.score for r in scored.collect()} == {0: 14.0, 1: 1.0}
    with pytest.raises(Exception, match="weights missing"):
        model.attr_weights(w.where("idx <> 4")).collect()
    found = spark.createDataFrame([("a", 0), ("b", 1)], "feature string, attr_id int")
    kept, cut = model.truncate(w, found, 1)
    assert [r.feature for r in kept.collect()] == ["a"] and cut.count() == 7
    model.save(str(tmp_path / "m"), w, found, config.TrainingParams().to_json())
    back, names, meta = model.load(spark, str(tmp_path / "m"))
    assert back.count() == 13 and names.count() == 2 and meta["labels"][0] == "S"
    order = spark.createDataFrame([(7, 2.0), (3, 2.0), (1, 5.0)], "attr_id int, score double")
    assert [r.attr_id for r in model.ranked(order).collect()] == [1, 3, 7]
    mean = model.average(spark.createDataFrame([("fw", 0, 1.0), ("fw", 0, 2.0), ("fw", 0, 6.0)], "kind string, idx int, w double")).first()
    assert mean.w == 3.0 and mean.contributors == 3


def test_evaluation(spark):
    pairs = spark.createDataFrame([("S", "S"), ("B", "S"), ("E", "E")], "gold string, pred string")
    got = {r.tag: (r.tp, r.fp, r.fn) for r in model.confusion(pairs).collect()}
    assert got["S"] == (1, 1, 0) and got["B"] == (0, 0, 1) and got["E"] == (1, 0, 0)
    acc = model.accuracy(spark.createDataFrame([(["S", "B"], ["S", "E"]), (["S"], ["S"])], "gold array<string>, pred array<string>")).first()
    assert (acc["items"], acc.items_right, acc.sentences_right) == (3, 2, 1)


def test_sources(spark, tmp_path):
    (tmp_path / "c.txt").write_text("a\tb\t\t\n \n\nc\n", encoding="utf-8")
    assert [r.tokens for r in corpus.tab_corpus(spark, str(tmp_path / "c.txt")).collect()] == [["a", "b"], ["c"]]
    (tmp_path / "d.txt").write_text("x 1 S\ny\t2 B\n\n \nz 3 E\n", encoding="utf-8")
    got = corpus.column_corpus(spark, str(tmp_path / "d.txt")).orderBy("sent_no").collect()
    assert [(r.cols, r.labels, r.n) for r in got] == [([["x", "1"], ["y", "2"]], ["S", "B"], 2), ([["z", "3"]], ["E"], 1)]
    (tmp_path / "e.txt").write_text("x 1 S\ny B\n", encoding="utf-8")
    with pytest.raises(Exception, match="inconsistent"):
        corpus.column_corpus(spark, str(tmp_path / "e.txt")).collect()
    enc = spark.createDataFrame([("k", [1, -1], [0], 1)], "key string, attr_ids array<int>, label_ids array<int>, n int")
    assert corpus.parse_instance_json(corpus.instance_json(enc)).first() == ([1, -1], [0], 1)
    p = config.load_params("mininumFeatureFrequency=3\nsigma = 5.0\n#x\nother=1", "U00:%x[0,0]")
    assert (p.min_feature_freq, p.sigma, p.templates, p.samples) == (3, 5.0, ("U00:%x[0,0]",), 1000)
    assert config.TrainingParams.from_json(p.to_json()) == p
    with pytest.raises(Exception, match="unknown weight key"):
        corpus.parse_weights(spark.createDataFrame([("zz1", "1")], "key string, value string")).collect()


def test_stream_of_lines(spark, tmp_path):
    from lexmill.streaming import streams

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ab\tc\n", encoding="utf-8")
    query = streams.tag_counts(streams.lines(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("tag_counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {r.tag: r.n for r in spark.table("tag_counts").collect()} == {"B": 1, "E": 1, "S": 1}


def test_entry_module_without_the_llm_folder(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    with monkeypatch.context() as m:
        m.setitem(sys.modules, "corpus_pipeline", None)
        assert not any(k.startswith("op") and k[2].isdigit() for k in importlib.reload(entry).queries())
    importlib.reload(entry)


@pytest.fixture(scope="module")
def corpus_dir(spark, tmp_path_factory):
    """Three documents with words, digits, punctuation and repeats."""
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(1, "The cat, the cat!\n\nok 42"), (2, "A bb ccc dddd eeeee"), (3, None)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def test_reverse_lookup_finds_every_id(spark, corpus_dir):
    from lexmill.plans import catalog

    want = {(r.attr_id, r.feature) for r in catalog.feature_dict(spark, corpus_dir).collect()}
    got = catalog.reverse_lookup(spark, corpus_dir).collect()
    assert {(r.attr_id, r.feature) for r in got} == want and len(got) == len(want) > 50


def test_crf_train_eval_covers_every_sentence(spark, corpus_dir):
    from lexmill.plans import catalog

    r = catalog.crf_train_eval(spark, corpus_dir).first()
    lines = ["thecat,thecat!", "ok42", "abbcccddddeeeee"]
    assert (r["sentences"], r["items"]) == (len(lines), sum(map(len, lines)))


def test_sentence_queries_cover_whole_lines(spark, corpus_dir):
    from lexmill.plans import catalog

    lines = {"1-0": ["the", "cat,", "the", "cat!"], "1-2": ["ok", "42"], "2-0": ["a", "bb", "ccc", "dddd", "eeeee"]}
    joined = {k: "".join(v) for k, v in lines.items()}
    items = sum(map(len, joined.values()))
    dictionary = {r.feature: r.attr_id for r in catalog.feature_dict(spark, corpus_dir).collect()}
    aw = np.zeros((len(dictionary), 6))
    for a in dictionary.values():
        aw[a] = [(a * 31 + k * 17) % 23 - 11 for k in range(6)]
    small = {k: np.array([float((i * 7 + z) % 13 - 6) for i in range(n)]) for k, n, z in (("bw", 6, 1), ("ew", 6, 5), ("tw", 36, 3))}
    w = crf.Weights(small["bw"], small["ew"], small["tw"].reshape(6, 6), aw)
    want, states, gold, strongest = {}, {}, {}, {}
    for key, t in joined.items():
        padded = ["_B-1", *t, "_B+1"]
        made = [[f"U00:{p}", f"U01:{c}", f"U02:{n}", f"U03:{p}/{c}", f"U04:{c}/{n}", f"U05:{p}/{n}"] for p, c, n in zip(padded, padded[1:], padded[2:])]
        attrs = np.array([[dictionary.get(f, -1) for f in fs] for fs in made])
        y = crf.viterbi(w, attrs)
        want[key] = (crf.path_score(w, attrs, y), [tg.TAGS[k] for k in y], crf.n_best(w, attrs, 3))
        labels = [tg.TAGS.index(x) for v in lines[key] for x in (["S"] if len(v) == 1 else ["B", "B1", "B2", "M", "M", "M"][: len(v) - 1] + ["E"])]
        gold[key] = crf.path_score(w, attrs, np.array(labels))
        for i, s in enumerate(crf.state_scores(w, attrs)):
            for label in range(6):
                states[key, label] = states.get((key, label), 0) + s[label]
                strongest[key, i, label] = s[label]
    got = {r.key: (r.score, r.tags.split(" ")) for r in catalog.viterbi(spark, corpus_dir).collect()}
    assert got == {k: v[:2] for k, v in want.items()}
    best = {(r.key, r["rank"]): r.score for r in catalog.nbest(spark, corpus_dir).collect()}
    assert best == {(k, i): s for k, v in want.items() for i, (s, _) in enumerate(v[2])}
    assert {r.key: r.words.replace("/", "") for r in catalog.segment_crf(spark, corpus_dir).collect()} == joined
    assert {r.key: r.score for r in catalog.path_score(spark, corpus_dir).collect()} == gold
    assert {(r.key, r.label): r.score for r in catalog.state_scores(spark, corpus_dir).collect()} == states
    assert {(r.key, r.pos, r.label): r.score for r in catalog.explained_items(spark, corpus_dir).collect()} == strongest
    assert sorted((r.key, r.n, r.n_ids) for r in catalog.instance_json(spark, corpus_dir).collect()) == sorted((k, len(t), 6 * len(t)) for k, t in joined.items())
    folded = {r.key: (r.total, r.labels) for r in catalog.explain_path(spark, corpus_dir).collect()}
    assert folded == {k: (v[0], sum(tg.TAGS.index(x) * (i % 97 + 1) for i, x in enumerate(v[1]))) for k, v in want.items()}
    assert {(r.key, r["rank"]): (r.score, r.words.replace("/", "")) for r in catalog.segment_n_best(spark, corpus_dir).collect()} == {k: (s, joined[k[0]]) for k, s in best.items()}
    assert catalog.loglik_zero(spark, corpus_dir).first()["loglik"] == round(-items * math.log(6), 3)
