import random

import numpy as np

from lexmill.llm import lang_id, toxicity, wordhash

WORDS = {"en": "the house is near river and they walk there with some other people".split(), "de": "das haus steht nahe dem fluss und sie gehen dort mit anderen leuten".split(), "fr": "la maison est près de la rivière et ils marchent avec quelques personnes".split()}


def text(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n))


def test_language_of_held_out_rows_and_odd_texts(spark):
    rnd = random.Random(1)
    rows = [(k, text(rnd, lang, rnd.randint(4, 200)), lang, 1) for k, lang in enumerate(rnd.choice(list(WORDS)) for _ in range(240))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    net = lang_id.fit(df.where("doc_id < 160"))
    assert net.langs == ["de", "en", "fr"]
    got = {r.row.doc_id: (r.lang_pred, r.score) for r in lang_id.predict(spark, df.where("doc_id >= 160"), net).collect()}
    assert np.mean([got[i][0] == lang for i, _, lang, _ in rows if i >= 160]) >= 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 .,% \n"), (None, text(rnd, "en", 30_000)), (5, "ß"), (5, "ß")], "doc_id long, text string")
    out = {r.row.doc_id: r for r in lang_id.predict(spark, odd, net).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and out[None].lang_pred == "en" and out[5].lang_pred != "und"
    assert sorted(r.doc_id or 0 for r in lang_id.keep_known(spark, odd, net, 0.0).collect()) == [0, 5, 5]
    assert lang_id.predict(spark, odd.limit(0), net).count() == 0
    assert lang_id.fit(odd.withColumn("lang", odd.text).where("doc_id = 2")).langs == ["und"]


def test_pair_tables_score_as_plain_convolution():
    rng = np.random.default_rng(0)
    net = lang_id.Network(["a", "b"], [rng.normal(size=(w, 256, 4)).astype(np.float32) for w in lang_id.WIDTHS], [rng.normal(size=4).astype(np.float32) for _ in lang_id.WIDTHS], rng.normal(size=(12, 2)).astype(np.float32), np.zeros(2, np.float32))
    x = rng.integers(0, 256, (7, 64)).astype(np.uint8)
    plain = np.maximum(np.concatenate([r.max(axis=1) for r in lang_id._responses(net, x)], axis=1), 0) @ net.out
    assert np.allclose(lang_id.Scorer(net, 64).logits(x), plain, atol=1e-4)


def test_toxic_words_and_their_misspellings():
    rnd = random.Random(4)
    bad = ["villainous", "scoundrel", "wretched"]
    texts, labels = [], []
    for k in range(500):
        words = [rnd.choice(WORDS["en"] + ["lantern", "window", "garden", "orchard"]) for _ in range(rnd.randint(3, 80))]
        if k % 3 == 0:
            words[rnd.randrange(len(words))] = rnd.choice(bad)
        texts.append(" ".join(words).encode())
        labels.append(int(k % 3 == 0))
    model = toxicity.train(texts, np.array(labels))

    def score(*given):
        return toxicity.score_block(model, np.frombuffer(b"".join(given), np.uint8), np.cumsum([0, *map(len, given)]))

    assert (score(b"the garden is near", b"they walk " * 500) < 0.5).all()
    assert (score(b"you Villainous, person", b"they walk there " * 400 + b"scoundrel", b"a vilainous garden", b"wretchedd people walk") >= 0.7).all()
    assert len(score()) == 0 and 0 <= score(b"")[0] <= 1


def test_scores_over_a_frame(spark):
    rows = [(k, ("awful " if k % 2 else "nice ") + f"day number {k}", k % 2, "x") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int, score string")
    model = toxicity.fit(df.drop("label"), df.select("doc_id", "label"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (None, "awful"), (5, "z" * 100_000), (5, "nice day")], "doc_id long, text string")
    out = toxicity.scores(spark, odd, model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert toxicity.scores(spark, odd.limit(0), model).count() == 0
    assert toxicity.fit(df, df.limit(0))["bias"] < 0


def test_subwords_by_hand():
    data = b"Ab, cd"
    gram, word, row = toxicity.subwords(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    # " ab", "ab ", " ab " and " cd", "cd ", " cd "
    assert sorted(word.tolist()) == [0, 0, 0, 1, 1, 1] and row.tolist() == [0, 0] and len(set(gram.tolist())) == 6


def test_words_do_not_cross_rows():
    import pyarrow as pa

    (_, data, offsets), = wordhash.blocks(pa.array(["ab", None, "c d", ""]))
    hashed, start, end, row = wordhash.words(data, offsets)
    assert row.tolist() == [0, 2, 2] and [bytes(data[a:b]) for a, b in zip(start, end)] == [b"ab", b"c", b"d"]
    assert len(set(hashed.tolist())) == 3


def test_scores_by_brute_force():
    """Every window of every text, n-gram by n-gram."""
    rnd = random.Random(12)
    rng = np.random.default_rng(12)
    model = {"weight": rng.normal(size=1 << toxicity.TABLE_BITS), "bias": -0.3, "window": 3}
    texts = ["", "...", "a", "one Two, three four five six", "x" * 40 + " yy é日本"] + [" ".join(rnd.choice(WORDS["fr"]) for _ in range(rnd.randint(1, 30))) for _ in range(20)]

    def slots(word):
        gram, _, _ = toxicity.subwords(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))
        return gram.tolist()

    want = []
    for t in texts:
        words = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in t).split(" ")
        words = [w for w in words if w]
        tops = [model["bias"]] if not words else []
        for k in range(len(words)):
            got = [g for w in words[k : k + 3] for g in slots(w)]
            tops.append(sum(model["weight"][g] for g in got) / max(len(got), 1) + model["bias"])
        want.append(1 / (1 + np.exp(-max(tops))))
    raw = [t.encode() for t in texts]
    assert np.allclose(toxicity.score_block(model, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])), want)


def test_the_sample_holds_long_texts_and_no_doubtful_labels(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, seed: seen.update(texts=texts, labels=labels.tolist()) or {"weight": np.zeros(1 << toxicity.TABLE_BITS), "bias": 0.0, "window": 6})
    long = " ".join(f"w{k}" for k in range(60_000))
    docs = [(1, long), (2, "short one"), (3, None), (4, "..."), (5, "both ways"), (6, "alike"), (7, "first"), (7, "other"), (None, "no id"), (8, "bad words")]
    docs += [(9, "much repeated")] * 500
    labels = [(1, 1), (2, 0), (3, 1), (4, 1), (5, 0), (5, 1), (6, 0), (6, 0), (7, 1), (None, 1), (8, None), (9, 0), (77, 1)]
    df, ldf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int")
    toxicity.fit(df, ldf)
    got = sorted(zip(seen["texts"], seen["labels"], strict=True))
    assert len(got) == 5 and (long.encode(), 1) in got and (b"short one", 0) in got and (b"alike", 0) in got and (b"much repeated", 0) in got
    assert {t for t, y in got if y == 1} - {long.encode()} < {b"first", b"other"}
    toxicity.fit(df, ldf, most_bytes=40_000)
    cut = max(seen["texts"], key=len)
    assert 30_000 < len(cut) <= 40_100 and cut.startswith(b"w0 w1 ") and cut.endswith(b"w59999") and b" w30000 " in long.encode()
    # labels whose texts are missing take no place in the sample
    more = spark.createDataFrame([(1000 + k, k % 2) for k in range(3000)] + [(1, 1), (2, 0)], "doc_id long, label int")
    toxicity.fit(df, more, rows=4)
    assert sorted(seen["labels"]) == [0, 1]
