import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from lexmill.llm.packing import configurations, pack_documents, plan, slots
from lexmill.llm.token_counts import load_tokenizer, prove, token_counts

SCHEMA = "doc_id long, text string, n_tokens string, length int, piece string"
ODD = [
    None, "", " ", "  \n\n x", "a", "Hello, world's  best\n\n\tthing 123 4567 ###", "don't I'LL we've 'S",
    "é̈ café naïve ß ſ İ İ", "日本語のテキスト と 漢字。", "🙂👍🏽 emoji \U0001d54f", " wide nbsp line \u0085 next", "<|endoftext|> inside <|startoftext|>x<|endoftext|>",
    "tab\x1cfs\x1d gs\x00nul", "Ⅷ ½ ² ٣ ৩", "x" * 5000, "ab " * 20_000, "ßẞ Σσς İ", "a̸ ̸= ",
]


def rows():
    rnd = random.Random(5)
    out = list(enumerate(ODD))
    for k in range(60):
        out.append((100 + k, "".join(rnd.choice("abcdefg ééñ.,'\n 12$%") for _ in range(rnd.randint(1, 400)))))
    return [*out, (100, out[-60][1]), (None, "no id")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def spec(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def test_counts_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = load_tokenizer(spec("byte_bpe_50k.json"))
    got = Counter(map(tuple, token_counts(spark, frame(spark, rows()), path).collect()))
    want = Counter()
    for i, t in rows():
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 1024)] += 1
    assert got == want
    assert token_counts(spark, frame(spark, []), path).count() == 0


def test_whole_tokens_are_single():
    proof = prove(spec("byte_bpe_50k.json"))
    assert len(proof["whole"]) > 40_000 and "<|endoftext|>" in proof["added"]


def test_packing_is_gapless_and_ids_are_the_librarys(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = load_tokenizer(spec("word_bpe_49k.json"))
    given = [(i, t) for i, t in rows() if i is not None]
    given = list(dict(given).items())
    got = pack_documents(spark, frame(spark, given), path).collect()
    want = {}
    for i, t in given:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4").tobytes()
            want[i, k // 2048] = (k, len(part) // 4, zlib.crc32(part))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(held) <= -(-total // 2048) + 2


def test_packing_odd_tables(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert pack_documents(spark, frame(spark, []), path).count() == 0
    got = pack_documents(spark, frame(spark, [(1, "a"), (1, "a"), (None, None)]), path).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (1, 2), (1, 2)]
    assert sorted((r.offset, r.length) for r in got) in ([(0, 2), (2, 2), (4, 1)], [(0, 1), (1, 2), (3, 2)])


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_length_once(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1 + 500 * (seed % 2), 2049, 3000)
    counts = np.bincount(lengths, minlength=2049)
    runs = plan(counts)
    placed = np.zeros(2049, dtype=np.int64)
    for times, inside in runs:
        assert sum(inside) <= 2048
        for length in inside:
            placed[length] += times
    assert (placed == counts).all()
    table = slots(runs)
    for length in np.unique(lengths):
        own = table[table[:, 0] == length]
        assert own[0, 1] == 0


def test_three_to_a_sequence_needs_the_configurations():
    rng = np.random.default_rng(1)
    lengths = rng.integers(600, 760, 6000)
    used = sum(n for n, _ in plan(np.bincount(lengths, minlength=2049)))
    assert used <= 1.02 * -(-int(lengths.sum()) // 2048)


def test_configuration_program_beats_one_size_each():
    found = configurations(np.array([1024, 700, 640]), np.array([10, 20, 20]), 2048)
    assert found and all((c * np.array([1024, 700, 640])).sum() <= 2048 for c, _ in found)


def test_merges_in_step_equal_the_library():
    import random

    import public_tokenizers

    from lexmill.llm import merging
    from lexmill.llm.token_counts import load_tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    tok, merger, rnd = load_tokenizer(spec), merging.Merger(spec), random.Random(5)
    alphabet = "abcdefghilnorstuéèüñßÄÇ0179.,!-#*<'œЖ"
    words = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 12))) for _ in range(4000)] + ["aaaaaaaa", "a" * 3000, "×÷", "à×à"]
    plain, ids, n = merger.words([w.encode() for w in words])
    want = [tok.encode(w, add_special_tokens=False).ids for w, ok in zip(words, plain, strict=True) if ok]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    assert 500 < plain.sum() < len(words)
    assert merger.words([])[1].tolist() == []


def test_packing_with_a_file_that_fails_the_proofs(spark):
    import public_tokenizers

    from lexmill.llm.packing import pack_documents
    from lexmill.llm.token_counts import load_tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        tok = load_tokenizer(f.read())
    rows = [(1, "Two  spaces, and CAPITALS\n\tkept"), (2, None), (3, " a <|endoftext|> b"), (None, "x " * 3000), (None, "x " * 3000)]
    got = pack_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    length = {}
    for r in got:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    ids = {k: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in rows}
    assert length == ids | {None: 2 * ids[None]}
