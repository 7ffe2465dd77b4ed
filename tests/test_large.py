"""Steps that must not shuffle items, against the plain ways."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import tags as tg
from lexmill.functions import templates as tp
from lexmill.functions import text as X
from lexmill.operators import crf, decode, features, hybrid, instances, model, pretok, train
from lexmill.plans import catalog
from lexmill.sources import shared
from lexmill.sources.config import TrainingParams

WORDS = [("a", ["ab", "c", "abcde", "x"]), ("b", ["b"]), ("c", ["ça", "日本語", "𝄞x", "b-"]), ("d", ["ab"] * 30 + ["longest"] * 9)]


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(k, "\n".join(["So das  Haus Ämter b", "", "x", "das haus " * (9 * k)])) for k in range(1, 6)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def encoded(spark):
    rows = spark.createDataFrame(WORDS, "key string, words array<string>")
    found = features.dictionary(features.count_sentences(rows, F.array_join("words", "")).where("feature <> 'U01:c'"))
    return rows, found.localCheckpoint()


def same(a, b):
    def shown(df):
        return sorted(map(repr, (r.asDict(True) for r in df.select(*b.columns).collect())))

    assert shown(a) == shown(b)


def test_sentences_are_encoded_without_a_shuffle(encoded):
    rows, found = encoded
    from lexmill.functions import tags as tg

    for templates in (tp.DEFAULT_TEMPLATES, [tp.parse(p) for p in ("U07:%x[-4,0]", "U03:%x[-1,0]/%x[0,0]", "Q", "U08:%x[-2,0]%x[0,0]%x[1,0]%x[4,0]")]):
        got = instances.encode_words(rows, "key", "words", found, templates)
        same(got, instances.encode(rows, "key", X.chars(F.array_join("words", "")), tg.words_to_tags(F.col("words")), found, templates))
        assert exchanges(got) == 0


def test_larger_dictionaries_and_models_are_joined(encoded, monkeypatch):
    rows, found = encoded
    aw = catalog.synthetic_attr_weights(found).where("attr_id % 7 <> 3")
    small = catalog.synthetic_model_weights(rows.sparkSession)
    enc = instances.encode_words(rows, "key", "words", found)

    def all_of():
        return [decode.attribute_rows(enc, aw), decode.sentence_states(enc, aw), decode.path_scores(enc, aw, small), decode.viterbi(enc, aw, small, states=True), decode.n_best(enc, aw, small, 3), model.explain(enc, found, aw), model.explain(enc, found, aw, most=1)]

    sent = all_of()
    assert [exchanges(df) for df in sent] == [0] * len(sent)
    held = instances.encode_words(rows, "key", "words", found, carry=("words",))
    monkeypatch.setattr(decode, "SENT_WEIGHTS", 3)
    monkeypatch.setattr(instances, "SENT_FEATURES", 3)
    for a, b in zip(sent, all_of(), strict=True):
        same(a, b)
    same(held, instances.encode_words(rows, "key", "words", found, carry=("words",)))


@pytest.mark.parametrize("wide", [1, 64])
def test_many_sentences_at_once(wide, monkeypatch):
    monkeypatch.setattr(crf, "WIDE", wide)
    rng = np.random.default_rng(4)
    lengths = np.array([3, 1, 40, 1, 7, 2, 40, 1000])
    w = crf.Weights(*(rng.integers(-3, 4, s).astype(float) for s in ((6,), (6,), (6, 6), (int(lengths.sum()), 6))))
    got, (scores, paths), norms = crf.viterbi_all(w, w.aw, lengths), crf.n_best_all(w, w.aw, lengths, 4), crf.log_norms(w, w.aw, lengths)
    for k, (a, z) in enumerate(zip(np.cumsum(lengths) - lengths, np.cumsum(lengths), strict=True)):
        attrs = np.arange(a, z)[:, None]
        assert got[a:z].tolist() == crf.viterbi(w, attrs).tolist()
        assert [(s, p.tolist()) for s, p in zip(scores[k], paths[:, a:z], strict=True) if np.isfinite(s)] == crf.n_best(w, attrs, 4)
        assert np.isclose(norms[k], crf.forward_backward(w, w.aw[a:z])[3], rtol=1e-12)
        assert np.isclose(crf.path_scores(w, w.aw, lengths, got)[k], crf.path_score(w, attrs, got[a:z]))


def test_long_sentences_are_summed_over_in_blocks():
    rng = np.random.default_rng(5)
    w = crf.Weights(*(rng.normal(size=s) for s in ((6,), (6,), (6, 6), (50, 6))))
    for n in (16, 17, 99, 400):
        attrs = rng.integers(-1, 50, (n, 3))
        alpha, beta, scale, log_z = crf.forward_backward(w, crf.state_scores(w, attrs))
        node, edge, got = crf.marginals(w, attrs)
        assert np.isclose(got, log_z, rtol=1e-12) and np.allclose(node, alpha * beta * (scale[-1] / scale[:-1])[:, None])
        assert np.allclose(edge.sum(axis=2), node[:-1]) and np.allclose(edge.sum(axis=1), node[1:])


def test_groups_dealt_before_they_are_encoded_train_alike(encoded):
    rows, found = encoded
    params = TrainingParams(sigma=5.0, t0=100.0)
    plain = train.train(instances.encode_words(rows, "key", "words", found), params, 2, 1, 3)
    dealt = train.train(instances.encode_words(train.deal(rows, 2), "key", "words", found), params, 2, 1, 3, dealt_already=True)
    a, b = ({(r.kind, r.idx): r.w for r in w.collect()} for w in (plain, dealt))
    assert a.keys() == b.keys() and all(np.isclose(a[k], b[k], rtol=1e-9) for k in a)


def test_features_are_summed_up_where_their_sentence_lies(spark, corpus):
    got = catalog.template_expand(spark, corpus)
    made = catalog.sentences(spark, corpus).select("key", F.explode(tp.expand(X.chars(F.array_join("words", "")))).alias("feature"))
    want = made.groupBy("key", X.feature_prefix(F.col("feature")).alias("template")).agg(F.count("*").alias("n"), F.count_if(tp.is_boundary(F.col("feature"))).alias("n_boundary"), F.min("feature").alias("first"), F.max("feature").alias("last"))
    same(got, want)
    assert exchanges(got) == 0


@pytest.mark.parametrize("query", ["lattice_nodes", "lattice_edges", "explain_path", "explain_path_free", "explain_features", "state_scores"])
def test_folded_queries_shuffle_sums_only(spark, corpus, query):
    got = getattr(catalog, query)(spark, corpus)
    assert exchanges(got) <= 1 and got.count() > 0


@pytest.mark.parametrize("query", ["descending_scores", "reverse_lookup", "model_saved", "weight_average", "truncate_model", "feature_shrink"])
def test_texts_are_read_once_for_a_dictionary(spark, corpus, query):
    assert "documents.parquet" not in getattr(catalog, query)(spark, corpus)._jdf.queryExecution().optimizedPlan().toString() + str(getattr(catalog, query)(spark, corpus).inputFiles())


def test_columns_are_taken_apart_once(spark, corpus):
    plan = catalog.crfpp_parse(spark, corpus)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(block") == 1


def test_explained_items_are_summed_up_where_they_lie(encoded, monkeypatch):
    rows, found = encoded
    aw = catalog.synthetic_attr_weights(found).where("attr_id % 7 <> 3")
    enc = instances.encode_words(rows, "key", "words", found)
    got = model.explained_sums(enc, found, aw)
    strongest = F.get("features", F.lit(0))["attr_id"].cast("long") * (F.col("pos") % 97 + 1)
    want = model.explain(enc, found, aw, most=1).groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.sum("n_features").cast("long").alias("n_features"), F.sum(strongest).alias("strongest"))
    same(got, want)
    assert exchanges(got) == 0
    monkeypatch.setattr(decode, "SENT_WEIGHTS", 3)
    same(model.explained_sums(enc, found, aw), want)


def test_best_paths_of_equal_scores_in_order():
    # whole numbers of a small range, so that ties are many
    rng = np.random.default_rng(6)
    score, trans = -np.sort(-rng.integers(-1, 2, (6, 3, 200)).astype(float), axis=1), rng.integers(-1, 2, (6, 6)).astype(float)
    score[:, 1:, :40] = -np.inf
    reach = (score.transpose(2, 0, 1)[:, None] + trans.T[None, :, :, None]).reshape(200, 6, 18)
    order = np.argsort(-reach, axis=2, kind="stable")[:, :, :3]
    best, which = crf._best_across(score, trans)
    assert (best == np.take_along_axis(reach, order, 2).transpose(2, 1, 0)).all() and (which == order.transpose(2, 1, 0)).all()


def test_a_large_row_group_is_dealt_out(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).coalesce(1).write.parquet(path)
    got = shared.spread(spark.read.parquet(path), "doc_id")
    held = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 20_000 and max(held) < 5_000
    small = spark.read.parquet(path).limit(9)
    assert shared.spread(small, "doc_id") is small


GROUPED = [("a", "我爱 3.14元 hello word_x か゚ ーア ก1 한글 ١٢ ́ 𝄞"), ("b", ""), ("c", None), ("d", "x" * 300 + " 的一是" + "不" * 300 + "。" + "1" * 256), ("e", "的一 的一是 一的"), ("f", "\n")]


def test_groups_as_rows(spark):
    texts = spark.createDataFrame(GROUPED, "k string, t string")
    got = pretok.group_rows(texts, "k", "t")
    same(got, texts.select(F.col("k").alias("key"), F.explode(pretok.groups(F.col("t"))).alias("g")).select("key", "g.text", "g.begin", "g.end", "g.type"))
    assert exchanges(got) == 0


def test_texts_are_cut_where_they_lie(spark, monkeypatch):
    texts = spark.createDataFrame(GROUPED, "k string, t string")
    words = spark.createDataFrame([("的一",), ("一是",), ("是不",), ("不不不",)], "word string")
    found = features.dictionary(features.count_sentences(texts, F.col("t"))).localCheckpoint()
    given = (texts, "k", "t", words, found, catalog.synthetic_attr_weights(found), catalog.synthetic_model_weights(spark))
    sent = hybrid.segment_texts(*given)
    assert exchanges(sent) == 0
    rows = hybrid.segment(*given)
    want = {k: t for k, t in GROUPED if t}
    assert {r.key: "".join(t.text for t in r.tokens) for r in sent.collect()} == want
    monkeypatch.setattr(hybrid, "SENT_RUNS", 1)
    same(sent, hybrid.segment_texts(*given))
    same(rows, hybrid.segment(*given))


def test_words_from_tags_of_long_lines(spark):
    long = "𝄞x\nSB" * 20_000
    rows = [("a", ["B"] + ["M"] * (len(long) - 2) + ["E"], long), ("b", ["S", "B", "E", "E", "M", "B", None, "S"], "SBE\nxB𝄞S"), ("c", ["S", "S", "S"], "ab"), ("d", ["B", "E"], "abc"), ("e", [], "a"), ("f", ["S"], None)]
    got = spark.createDataFrame(rows, "k string, t array<string>, s string").select("k", tg.tags_to_words(F.col("t"), F.col("s")).alias("w"))
    assert dict(got.collect()) == {"a": [long], "b": ["S", "BE", "\n", "x", "B𝄞", "S"], "c": ["a", "b", ""], "d": ["ab"], "e": [], "f": [None]}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "B.(?:x.)*+(?:E.)?" in plan


ODD_TEXTS = [(1, "So  das\tHaus\n\n x \n"), (2, None), (3, ""), (4, "\n"), (5, " \x0b\f\r\t"), (None, "Ämter 𝄞x ça\x85b　c\n日本語"), (7, "ab" * 700 + "\r\nabcde a"), (8, "x"), (9, "\nab c")]


@pytest.fixture(scope="module")
def odd(spark):
    from lexmill.operators.lines import Lines

    return Lines(spark.createDataFrame(ODD_TEXTS, "doc_id long, text string").repartition(2), "doc_id", "text")


def test_lines_are_cut_where_they_lie(odd):
    rows = odd.sentences()
    lengths = F.expr("aggregate(words, 0, (a, w) -> a | shiftleft(1, least(length(w), 5)))")
    same(odd.heads(), rows.select("key", F.length(F.array_join("words", "")).cast("long").alias("n"), lengths.alias("lengths")))
    assert exchanges(odd.heads().select("n")) <= 1
    for templates in (tp.DEFAULT_TEMPLATES, [tp.parse("U07:%x[-4,0]%x[3,0]")]):
        same(features.line_windows(odd, templates), features.windows(rows, F.array_join("words", ""), templates))
        same(features.count_lines(odd, templates), features.count_sentences(rows, F.array_join("words", ""), templates))


def test_first_pass_of_lines(odd):
    got, want = train.first_pass_of_lines(odd, 3), train.first_pass(odd.sentences(), "key", "words", 3)
    for a, b in zip(got[:2] + got[3:], want[:2] + want[3:], strict=True):
        same(a, b)
    same(got[2], want[2].select("key"))


@pytest.mark.parametrize("most", [500_000, 3])
def test_lines_are_encoded_and_scored_on_the_way(odd, most, monkeypatch):
    from lexmill.operators.lines import Encoding

    spark, rows = odd.texts.sparkSession, odd.sentences()
    found = features.dictionary(features.count_lines(odd).where("feature <> 'U01:x'")).localCheckpoint()
    aw = catalog.synthetic_attr_weights(found).where("attr_id % 7 <> 3")
    small, free = catalog.synthetic_model_weights(spark), catalog._free(spark)
    enc, ids = Encoding(odd, found), instances.encode_words(rows, "key", "words", found)
    held = decode.viterbi(ids, aw, free, states=True)
    steps, (nodes, _) = model.explain_path(held, None, decode.small_weights(small)), model.lattice(held, None, decode.small_weights(small))
    totals = [F.sum(c).alias(c) for c in ("state", "begin", "move", "end", "total")]
    want = [
        decode.path_scores(ids, aw, small), decode.log_probs(ids, aw, free).select("key", F.round("logp", 9).alias("logp")), decode.viterbi(ids, aw, small),
        decode.attribute_rows(ids, aw).select("key", F.posexplode("s").alias("label", "s")).groupBy("key", "label").agg(F.sum("s").alias("score")),
        steps.groupBy("key").agg(*totals, F.sum(F.col("label") * (F.col("pos") % 97 + 1)).alias("labels")),
        nodes.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.count_if("best").alias("on_path"), F.sum(F.when(F.col("best"), F.col("pos") % 97 + 1).otherwise(0)).alias("places")),
        decode.viterbi(ids, aw, small).select("key", F.array_join(tg.tag_text(F.col("label_ids")), " ").alias("tags")),
    ]
    want = [df.localCheckpoint() for df in want]
    monkeypatch.setattr(decode, "SENT_WEIGHTS", most)
    got = [decode.path_scores(enc, aw, small), decode.log_probs(enc, aw, free).select("key", F.round("logp", 9).alias("logp")), decode.viterbi(enc, aw, small), decode.state_sums(enc, aw), model.path_sums(enc, aw, free, small), model.lattice_sums(enc, aw, free), decode.viterbi(enc, aw, small, text=True)]
    for a, b in zip(got, want, strict=True):
        same(a, b)


@pytest.mark.parametrize("query", ["viterbi", "path_score", "loglik_zero", "state_scores", "lattice_nodes", "explain_path", "explain_path_free"])
def test_ids_and_states_stay_where_they_are_made(spark, corpus, query):
    plan = getattr(catalog, query)(spark, corpus)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "explode(states" not in plan and "array<array<" not in plan


def test_one_long_sentence_among_short_ones():
    rng = np.random.default_rng(8)
    lengths = np.array([1, 900, 2] + [5] * 100)
    w = crf.Weights(*(rng.integers(-2, 3, s).astype(float) for s in ((6,), (6,), (6, 6), (int(lengths.sum()), 6))))
    got = crf.viterbi_all(w, w.aw, lengths)
    for a, z in zip(np.cumsum(lengths) - lengths, np.cumsum(lengths), strict=True):
        assert got[a:z].tolist() == crf.viterbi(w, np.arange(a, z)[:, None]).tolist()


def test_runs_are_walked_where_they_lie(spark, monkeypatch):
    from lexmill.operators import dictseg

    rng = np.random.default_rng(9)
    drawn = ["".join(rng.choice(list("ab𝄞"), n)) for n in (1, 2, 3, 5, 8, 13, 400) for _ in range(4)]
    runs = spark.createDataFrame([(r,) for r in [*drawn, "", None, "a"]], "run string")
    words = spark.createDataFrame([(w,) for w in ("ab", "ba", "aab", "b𝄞", "𝄞ab", "bbaa", "a", "abab𝄞a", None)], "word string")

    def all_of():
        return [f(runs.where("run IS NOT NULL"), words) for f in (dictseg.forward, dictseg.backward, dictseg.both, dictseg.disagreements)]

    sent = all_of()
    assert all("Join" not in df._jdf.queryExecution().optimizedPlan().toString() for df in sent)
    monkeypatch.setattr(dictseg, "SENT_WORDS", 3)
    for a, b in zip(sent, all_of(), strict=True):
        same(a, b)


@pytest.mark.parametrize("mode", ["uax29", "classic"])
def test_equal_stretches_are_cut_once(spark, mode, monkeypatch):
    texts = spark.createDataFrame([("a b.c_ d\u0301 \u0301x\n\n3.14, a@b.c U.S. o'clock",), ("我 爱\t\u3000ー か゚ x:y \x85\xa0a", ), ("",), (None,), ("  a\r\nb " * 3,)], "t string")
    pattern = pretok.PATTERN if mode == "uax29" else pretok.CLASSIC_PATTERN
    want = texts.select(F.explode(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    monkeypatch.setattr(pretok, "HELD_WORDS", 3)
    got = pretok.piece_types(texts, "t", mode)
    same(got.select("piece", "n"), want)
    assert "extract_all(word" in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query", ["fmm", "bmm", "seg_disagreement"])
def test_texts_are_read_once_for_runs(spark, corpus, query):
    assert "documents.parquet" not in str(getattr(catalog, query)(spark, corpus).inputFiles())


def test_windows_are_tallied_over_stretches(monkeypatch):
    from collections import Counter

    import pyarrow as pa

    from lexmill.functions import codes

    rng = np.random.default_rng(11)
    # few symbols, then many, then some past 16 bits; narrow windows, and ones of too many rows for one number
    texts = ["".join(map(chr, rng.integers(low, high, n))) for low, high in ((97, 100), (0x4E00, 0x5E00), (0x1F300, 0x1F310)) for n in (1, 2, 3, 50, 700)]
    monkeypatch.setattr(codes, "SLICE_ITEMS", 400)
    for rows in (range(-1, 2), range(0, 1), range(-4, 5), range(0, 4)):
        held, want = codes.Tally(rows), Counter()
        for a in range(0, len(texts), 2):
            part = texts[a : a + 2]
            held.add(codes.code_points(pa.array(part)), np.array([len(t) for t in part]))
        for t in texts:
            beyond = {-d: f"_B-{d}" for d in range(1, 5)} | {len(t) - 1 + d: f"_B+{d}" for d in range(1, 5)}
            want.update(tuple(t[i + r] if 0 <= i + r < len(t) else beyond[i + r] for r in rows) for i in range(len(t)))
        held.merge()
        assert held.size == len(want)
        values, n = held.taken()
        assert dict(zip(zip(*(v.to_pylist() for v in values), strict=True), n.to_pylist(), strict=True)) == want and held.size == 0
        assert len(held.taken()[1]) == 0


def test_many_windows_are_handed_on(odd, monkeypatch):
    want = features.windows(odd.sentences(), F.array_join("words", "")).localCheckpoint()
    monkeypatch.setattr(features, "HELD_WINDOWS", 1)
    same(features.line_windows(odd), want)


@pytest.mark.parametrize("query", ["feature_count", "feature_filter_stat"])
def test_texts_are_lower_cased_once(spark, corpus, query):
    plan = getattr(catalog, query)(spark, corpus)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(text") == 1


@pytest.mark.parametrize("query", ["weight_average", "feature_scores", "topn_features", "truncate_model", "weight_kinds", "reverse_lookup", "model_saved", "descending_scores"])
def test_windows_are_counted_once_for_a_model(spark, corpus, query, monkeypatch):
    counted, count_lines = [], features.count_lines
    monkeypatch.setattr(features, "count_lines", lambda *given: counted.append(1) or count_lines(*given))
    getattr(catalog, query)(spark, corpus)
    assert len(counted) == 1
