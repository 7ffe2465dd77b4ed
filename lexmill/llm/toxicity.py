"""Toxicity scores from averaged subword embeddings and a linear softmax.

Text is lower-cased (A-Z), ASCII punctuation becomes space, and every word gives
its byte n-grams of three to five with a space at either end, hashed to rows of
one embedding table.  A window of a few words is the mean of its n-gram vectors;
a linear softmax of two classes scores it.  Embeddings and softmax are trained
jointly in numpy.  A label belongs to a document, not to a window, so after a
first pass over all windows the training follows the highest window of each
document.  A document's score is that of its highest window, over the whole text.

As the softmax is linear in the mean, scoring needs one number per table row.
Misspellings never seen share most n-grams with the word that was.

Training sees a bounded sample: ``SAMPLE_ROWS`` labelled documents whose text has
a word, half of each label where there are enough, in the order of a hash of their
id, whatever their length.  What the driver fetches is bounded by ``SAMPLE_BYTES``
for all of them together: where whole texts are more, the longest are seen in
windows spread evenly over them.

Defined edge cases: null, empty or wordless text scores as the softmax of the
bias alone and trains nothing; a null doc_id is passed through; repeated rows each
give a row; a doc_id labelled both ways is not learnt from, one labelled twice
alike counts once; of several texts under one labelled doc_id that of the smallest
hash is learnt; a very long text is scored in one piece, window by window; where a
label has no text to learn from all scores are alike; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import wordhash

GRAMS = (3, 4, 5)
TABLE_BITS = 18
DIM = 8
WINDOW_WORDS = 6
SAMPLE_ROWS = 2400
SAMPLE_BYTES = 12_000_000
#: bytes of one window of a text that is not seen whole
PIECE_BYTES = 2000
THRESHOLD = 0.7

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[:128] = [b if chr(b).isalnum() else 32 for b in range(128)]
_CLEAN[65:91] += 32


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table row of each n-gram, its word, row of each word) of a block of texts."""
    n_docs = len(offsets) - 1
    # a space before each text and after the last
    text = np.full(len(data) + n_docs + 1, 32, dtype=np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(1, n_docs + 1), np.diff(offsets))] = _CLEAN[data]
    space = text == 32
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    row = np.searchsorted(offsets + np.arange(n_docs + 1), start - 1, side="right") - 1
    total = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * wordhash._power("mult", wordhash._MULT, len(text)), out=total[1:])
    inverse = wordhash._power("inv", wordhash._INV, len(text))
    spaces = np.zeros(len(text) + 1, dtype=np.int32)
    np.cumsum(space, out=spaces[1:])
    word_at = np.zeros(len(text), dtype=np.int32)
    word_at[start] = 1
    np.cumsum(word_at, out=word_at)
    word_at -= 1
    rows, at = [], []
    for n in GRAMS:
        if len(text) < n:
            continue
        p = np.flatnonzero(spaces[n - 1 : -1] == spaces[1 : len(text) - n + 2])  # nothing but the ends may be a space
        h = wordhash.mix64((total[p + n] - total[p]) * inverse[p] + np.uint64(n))
        rows.append((h >> np.uint64(64 - TABLE_BITS)).astype(np.int32))
        at.append(word_at[p + space[p]])
    gram = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    word = np.concatenate(at) if at else np.zeros(0, np.int32)
    return gram, word, row


def window_logits(sums: np.ndarray, counts: np.ndarray, row: np.ndarray, bias: float, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Highest window logit of each text and the first word of that window (-1: no word), from each word's sum and number of n-grams."""
    n_words = len(row)
    top, first = np.full(n_rows, bias), np.full(n_rows, -1, dtype=np.int64)
    if not n_words:
        return top, first
    s, c = np.zeros(n_words + 1), np.zeros(n_words + 1)
    np.cumsum(sums, out=s[1:])
    np.cumsum(counts, out=c[1:])
    a = np.arange(n_words)
    bounds = np.searchsorted(row, np.arange(n_rows + 1))
    b = np.minimum(a + size, bounds[row + 1])
    z = (s[b] - s[a]) / np.maximum(c[b] - c[a], 1) + bias
    held = np.flatnonzero(bounds[1:] > bounds[:-1])
    top[held] = np.maximum.reduceat(z, bounds[held])
    order = np.lexsort((-z, row))
    first[held] = order[bounds[held]]
    return top, first


def _grams(texts: list[bytes], block_bytes: int = 500_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table rows word by word, where each word's begin, row of each word), a few texts at a time."""
    grams, counts, rows, at = [], [], [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= block_bytes):
            size += len(texts[end])
            end += 1
        gram, word, row = subwords(np.frombuffer(b"".join(texts[at:end]), dtype=np.uint8), np.cumsum([0, *map(len, texts[at:end])]))
        grams.append(gram[np.argsort(word, kind="stable")])
        counts.append(np.bincount(word, minlength=len(row)))
        rows.append(row + at)
        at = end
    none = np.zeros(0, np.int64)
    return np.concatenate([*grams, none.astype(np.int32)]), np.concatenate(([0], np.cumsum(np.concatenate([*counts, none])))), np.concatenate([*rows, none])


def _word_sums(gram: np.ndarray, begin: np.ndarray, weight: np.ndarray, words: int = 100_000) -> np.ndarray:
    """Sum of the weights of each word's n-grams."""
    out = np.zeros(len(begin) - 1)
    for a in range(0, len(out), words):
        b = min(a + words, len(out))
        total = np.concatenate(([0.0], np.cumsum(weight[gram[begin[a] : begin[b]]])))
        out[a:b] = np.diff(total[begin[a : b + 1] - begin[a]])
    return out


def train(texts: list[bytes], labels: np.ndarray, seed: int = 11, window: int = WINDOW_WORDS, warm: int = 2, rounds: int = 12, rate: float = 0.25) -> dict:
    """Joint training; returns the table's rows folded with the softmax, and the bias."""
    rng = np.random.default_rng(seed)
    gram, g_at, row = _grams(texts)
    n_words = len(row)
    ends = np.searchsorted(row, np.arange(len(texts) + 1))
    table = rng.normal(0, 0.02, (1 << TABLE_BITS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    t_sq, o_sq, b_sq = np.full(len(table), 1e-2, np.float32), np.full((DIM, 2), 1e-2, np.float32), np.full(2, 1e-2, np.float32)

    def fit(firsts: np.ndarray, y: np.ndarray) -> None:
        share = np.bincount(y, minlength=2) / max(len(y), 1)
        for at in np.array_split(rng.permutation(len(firsts)), max(1, len(firsts) // 256)):
            w, t = firsts[at], y[at]
            last = np.minimum(w + window, ends[row[w] + 1])
            lo, hi = g_at[w], g_at[last]
            n = hi - lo
            which = np.repeat(np.arange(len(w)), n)
            g = gram[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            mean = np.zeros((len(w), DIM), np.float32)
            np.add.at(mean, which, table[g])
            mean /= np.maximum(n, 1)[:, None]
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(t)), t] -= 1
            d = p * (0.5 / np.maximum(share[t], 1e-3))[:, None]
            grad = (d @ out.T) / np.maximum(n, 1)[:, None]
            g_out, g_bias = mean.T @ d, d.sum(axis=0)
            slot, inv = np.unique(g, return_inverse=True)
            step = np.zeros((len(slot), DIM), np.float32)
            np.add.at(step, inv, grad[which].astype(np.float32))
            t_sq[slot] += (step * step).mean(axis=1)
            table[slot] -= rate * step / np.sqrt(t_sq[slot])[:, None]
            o_sq[...] += g_out * g_out
            out[...] -= 0.2 * rate * g_out / np.sqrt(o_sq)
            b_sq[...] += g_bias * g_bias
            bias[...] -= 0.2 * rate * g_bias / np.sqrt(b_sq)

    all_firsts = np.arange(0, n_words, window)
    for _ in range(warm):
        fit(all_firsts, labels[row[all_firsts]])
    for _ in range(rounds):
        weight = (table @ (out[:, 1] - out[:, 0])).astype(np.float64)
        _, first = window_logits(_word_sums(gram, g_at, weight), np.diff(g_at), row, float(bias[1] - bias[0]), len(texts), window)
        kept = np.flatnonzero(first >= 0)
        more = rng.choice(all_firsts[labels[row[all_firsts]] == 0], size=min(len(kept), int((labels[row[all_firsts]] == 0).sum())), replace=False)
        fit(np.concatenate((first[kept], more)), np.concatenate((labels[kept], np.zeros(len(more), labels.dtype))))
    return {"weight": (table @ (out[:, 1] - out[:, 0])).astype(np.float64), "bias": float(bias[1] - bias[0]), "window": window}


def score_block(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of class 1 for each text of a block."""
    gram, word, row = subwords(data, offsets)
    sums, counts = np.bincount(word, weights=model["weight"][gram], minlength=len(row)), np.bincount(word, minlength=len(row))
    z, _ = window_logits(sums, counts, row, model["bias"], len(offsets) - 1, model["window"])
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _level(lengths: list[int], total: int) -> int:
    """The length up to which texts are seen whole, so that all together stay within ``total``."""
    left = sorted(lengths)
    for k, n in enumerate(left):
        if n * (len(left) - k) > total:
            return max(1, total // (len(left) - k))
        total -= n
    return max(left, default=1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "label", text: str = "text", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, seed: int = 11) -> dict:
    """Train on at most ``rows`` labelled texts, of which at most about ``most_bytes`` are fetched.

    Only ids, lengths and hashes of documents are dealt out to meet the labels;
    the texts of the sample, chosen by then, are fetched by a broadcast of it.
    """
    given = labels.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{label}`").cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isin(0, 1))
    given = given.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("i", "y", F.xxhash64("i", F.lit(seed)).alias("o"))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike("[^\\x00-\\x2f]"))
    one = texts.select("id", F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n")).alias("t")).groupBy("id").agg(F.min("t").alias("t"))
    met = given.join(one, F.col("i") == F.col("id")).select("i", "o", "y", "t.h", "t.n")
    picked = [r for y in (0, 1) for r in met.where(F.col("y") == y).orderBy("o", "i").limit(rows // 2).collect()]
    if len({r["y"] for r in picked}) < 2:
        only = 1.0 if any(r["y"] for r in picked) else 0.0
        return {"weight": np.zeros(1 << TABLE_BITS), "bias": 4.0 * (2 * only - 1), "window": WINDOW_WORDS}
    whole = _level([r["n"] for r in picked], most_bytes)
    chosen = F.broadcast(labels.sparkSession.createDataFrame([(r["i"], r["h"]) for r in picked], "i long, h long"))
    raw, n, size = F.encode("text", "UTF-8"), F.octet_length("text"), min(PIECE_BYTES, whole)
    pieces = max(2, whole // size)
    windows = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda k: F.substring(F.col("raw"), (F.lit(1) + F.floor(k * (F.col("n") - size) / (pieces - 1))).cast("int"), F.lit(size)))
    found = texts.join(chosen, (F.col("id") == F.col("i")) & (F.xxhash64("text") == F.col("h"))).select("i", raw.alias("raw"), n.alias("n"))
    found = found.select("i", F.when(F.col("n") <= whole, F.array("raw")).otherwise(windows).alias("w")).groupBy("i").agg(F.first("w").alias("w"))
    text_of = {r["i"]: b"\n".join(map(bytes, r["w"])) for r in found.collect()}
    picked = [r for r in picked if r["i"] in text_of]
    return train([text_of[r["i"]] for r in picked], np.array([r["y"] for r in picked]), seed)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first, data, offsets in wordhash.blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(offsets) - 1), pa.array(score_block(model, data, offsets))], ["doc_id", "score"])

    return run


def scores(spark: SparkSession, docs: DataFrame, model: dict, threshold: float = THRESHOLD, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every whole text."""
    shared = spark.sparkContext.broadcast(model)
    out = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(_scorer(shared), "doc_id long, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
