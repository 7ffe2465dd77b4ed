"""Language identification by a byte-level convolutional network.

Fixed-length windows of UTF-8 bytes go through filters of several widths, a
maximum over the window for each filter, and a softmax.  The network is trained
in numpy by Adam on windows of a bounded sample of labelled documents.

A filter's response is a sum of table entries, one per byte.  For scoring, the
tables of neighbouring bytes are added up once into tables over byte pairs, so
that a width of two costs one look-up per position.  A document's score is the
softmax of the mean of its windows' logits; windows cover the whole text.

Defined edge cases: null text, empty text and text without a letter give
``und`` with score 0; a text shorter than a window is padded with zero bytes; a
very long text is worked on window by window, all of it; of equally likely
languages the first by name wins; a null doc_id is passed through; repeated rows
each give a row; without a labelled text everything is ``und``; an empty table
gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import wordhash

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 256
SAMPLE_ROWS = 1500
SAMPLE_WINDOWS = 3
EPOCHS = 8
#: a small sample is gone through more often, for so many steps at least
LEAST_STEPS = 200
UNDETERMINED = "und"


@dataclass
class Network:
    langs: list[str]
    tables: list[np.ndarray]  # per width: (width, 256, filters)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray


def _responses(net: Network, x: np.ndarray) -> list[np.ndarray]:
    """(windows, positions, filters) for each width."""
    found = []
    for table, bias in zip(net.tables, net.bias, strict=True):
        w = len(table)
        n = x.shape[1] - w + 1
        r = bias + table[0][x[:, :n]]
        for k in range(1, w):
            r += table[k][x[:, k : k + n]]
        found.append(r)
    return found


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 0, epochs: int = EPOCHS, filters: int = FILTERS, widths: tuple[int, ...] = WIDTHS, rate: float = 0.02) -> Network:
    """Fit on rows of bytes; ``labels`` are places in ``langs``."""
    rng = np.random.default_rng(seed)
    net = Network(langs, [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths], [np.zeros(filters, np.float32) for _ in widths], rng.normal(0, 0.1, (len(widths) * filters, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    params = [*net.tables, *net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = (len(labels) / np.maximum(np.bincount(labels, minlength=len(langs)), 1)).astype(np.float32)
    weight /= len(langs)
    for _ in range(max(epochs, -(-LEAST_STEPS * 64 // max(len(windows), 64)))):
        for at in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // 64)):
            x, y = windows[at], labels[at]
            step += 1
            responses = _responses(net, x)
            where = [r.argmax(axis=1) for r in responses]
            top = np.concatenate([np.take_along_axis(r, p[:, None, :], 1)[:, 0, :] for r, p in zip(responses, where, strict=True)], axis=1)
            hidden = np.maximum(top, 0)
            z = hidden @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            dz = p
            dz[np.arange(len(y)), y] -= 1
            dz *= weight[y][:, None] / len(y)
            dh = (dz @ net.out.T) * (top > 0)
            grads: list[np.ndarray] = []
            for i, w in enumerate(widths):
                g, d = np.zeros_like(net.tables[i]), dh[:, i * filters : (i + 1) * filters]
                for k in range(w):
                    np.add.at(g[k], (np.take_along_axis(x, where[i] + k, 1), np.arange(filters)[None, :]), d)
                grads.append(g)
            grads += [dh[:, i * filters : (i + 1) * filters].sum(axis=0) for i in range(len(widths))]
            grads += [hidden.T @ dz, dz.sum(axis=0)]
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


class Scorer:
    """Mean logits of whole texts, with tables over byte pairs."""

    def __init__(self, net: Network, window: int = WINDOW):
        self.net, self.window = net, window
        self.plans = []
        for table, bias in zip(net.tables, net.bias, strict=True):
            parts = []
            for k in range(0, len(table), 2):
                if k + 1 < len(table):
                    parts.append((k, (table[k][:, None, :] + table[k + 1][None, :, :]).reshape(65536, -1).astype(np.float32)))
                else:
                    parts.append((k, table[k].astype(np.float32)))
            self.plans.append((len(table), parts, bias))

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """One row per window."""
        one = windows.astype(np.int32)
        pair = one[:, :-1] * 256 + one[:, 1:]
        tops = []
        for width, parts, bias in self.plans:
            n = windows.shape[1] - width + 1
            r = None
            for k, table in parts:
                index = pair if len(table) == 65536 else one
                got = table.take(index[:, k : k + n], axis=0)
                r = got if r is None else np.add(r, got, out=r)
            tops.append(r.max(axis=1) + bias)
        return np.maximum(np.concatenate(tops, axis=1), 0) @ self.net.out + self.net.out_bias

    def scores(self, data: np.ndarray, offsets: np.ndarray, rows_at_once: int = 64) -> np.ndarray:
        """Probabilities, a row for each text of a block."""
        size = self.window
        length = np.diff(offsets)
        per = np.maximum(1, -(-length // size))
        row = np.repeat(np.arange(len(length)), per)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
        # the last window of a longer text is moved back to end with the text
        start = offsets[row] + np.minimum(nth * size, np.maximum(length[row] - size, 0))
        padded = np.concatenate((data, np.zeros(size, np.uint8)))
        total = np.zeros((len(length), len(self.net.langs)))
        for a in range(0, len(row), rows_at_once):
            s, r = start[a : a + rows_at_once], row[a : a + rows_at_once]
            x = padded[s[:, None] + np.arange(size)]
            short = length[r] < size
            if short.any():
                x[short] = np.where(np.arange(size) < length[r][short][:, None], x[short], 0)
            np.add.at(total, r, self.logits(x))
        z = total / per[:, None]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def sample_windows(docs: DataFrame, lang: Column, size: int, rows: int, windows: int, seed: int) -> tuple[np.ndarray, list[str]]:
    """At most ``rows`` labelled documents, chosen by hash, with ``windows`` windows of each.

    A share that leaves about one and a half times as many is drawn first, so
    what tasks send to the driver does not grow with the table.
    """
    labelled = docs.where(lang.isNotNull()).count()
    share = min(1.0, 1.5 * rows / max(labelled, 1))
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))
    length = F.octet_length("text")
    at = [F.expr(f"substring(encode(text, 'UTF-8'), 1 + CAST(pmod(xxhash64(text, {seed + k}), greatest(1, octet_length(text) - {size - 1})) AS INT), {size})") for k in range(windows)]
    picked = (
        docs.where(draw)
        .select(F.col("text"), lang.alias("lang"))
        .where(F.col("lang").isNotNull() & (length > 0) & F.col("text").rlike(r"\p{L}"))
        .select("lang", F.array(*at).alias("w"), F.xxhash64("text", F.lit(seed)).alias("o"))
        .orderBy("o", "lang")
        .limit(rows)
        .collect()
    )
    x, y = [], []
    for r in picked:
        for w in r["w"]:
            x.append(np.frombuffer(bytes(w).ljust(size, b"\0"), dtype=np.uint8))
            y.append(r["lang"])
    return np.array(x, dtype=np.uint8).reshape(-1, size), y


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id", window: int = WINDOW, rows: int = SAMPLE_ROWS, windows: int = SAMPLE_WINDOWS, seed: int = 7) -> Network:
    """Train on a sample of at most ``rows`` labelled documents (the bound is this parameter)."""
    x, y = sample_windows(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")), F.col("lang"), window, rows, windows, seed)
    langs = sorted(set(y))
    if not langs:
        return Network([UNDETERMINED], [np.zeros((w, 256, 1), np.float32) for w in WIDTHS], [np.zeros(1, np.float32)] * len(WIDTHS), np.zeros((len(WIDTHS), 1), np.float32), np.zeros(1, np.float32))
    return train(x, np.array([langs.index(v) for v in y]), langs, seed=seed)


def _predictor(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        scorer = Scorer(net, window)
        for batch in batches:
            for first, data, offsets in wordhash.blocks(batch.column(1)):
                n = len(offsets) - 1
                p = scorer.scores(data, offsets)
                lettered = batch.column(2).slice(first, n).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
                best = p.argmax(axis=1)
                lang = [net.langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(lang, pa.string()), pa.array(np.where(lettered, p.max(axis=1), 0.0))], ["row", "lang_pred", "score"])

    return run


def predict(spark: SparkSession, docs: DataFrame, net: Network, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), ``lang_pred`` and ``score``."""
    shared = spark.sparkContext.broadcast(net)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"), F.col(text).rlike(r"\p{L}").alias("lettered"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predictor(shared, window), schema)


def _keeper(shared, window: int, at: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, window)
        for batch in batches:
            text = batch.column(at)
            keep = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False).astype(bool)
            for first, data, offsets in wordhash.blocks(text):
                n = len(offsets) - 1
                keep[first : first + n] &= scorer.scores(data, offsets).max(axis=1) >= least
            yield batch.filter(pa.array(keep))

    return run


def keep_known(spark: SparkSession, docs: DataFrame, net: Network, least: float, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with a letter and a likeliest language of at least ``least``, as they came."""
    shared = spark.sparkContext.broadcast(net)
    return docs.mapInArrow(_keeper(shared, window, docs.columns.index(text), least), docs.schema)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id falls into none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
