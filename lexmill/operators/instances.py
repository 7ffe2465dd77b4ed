"""Sentences encoded as feature and label ids.  Inventory: J2-J7, S18, W4."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import codes
from lexmill.functions import tags as tg
from lexmill.functions import templates as tp
from lexmill.functions import text as X
from lexmill.operators.lines import tag_ids

#: dictionaries up to this size are sent to every worker, about 60 MB there; larger ones are joined
SENT_FEATURES = 500_000


def encode(sentences: DataFrame, key: str, items: Column, labels: Column | None, dictionary: DataFrame, templates=tp.DEFAULT_TEMPLATES, width: int = 1) -> DataFrame:
    """``key, attr_ids, label_ids, n``; features not in the dictionary are -1.

    The dictionary is probed by an equi-join on the feature; whether its side is
    sent round is decided by its measured size, not by a hint.
    """
    base = sentences.select(F.col(key).alias("key"), items.alias("__items"), (labels if labels is not None else F.lit(None).cast("array<string>")).alias("__tags")).where(F.size("__items") > 0)
    flat = base.select("key", F.posexplode(tp.expand(F.col("__items"), templates, width)).alias("pos", "feature"))
    coded = flat.join(dictionary.select("feature", "attr_id"), "feature", "left")
    ids = coded.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("attr_id", F.lit(-1)).alias("id")))), lambda s: s["id"]).alias("attr_ids"))
    heads = base.select("key", F.transform("__tags", tg.label_id).alias("label_ids"), (F.size("__items") / width).cast("int").alias("n"))
    return ids.join(heads, "key").select("key", "attr_ids", "label_ids", "n")


def sent_dictionary(dictionary: DataFrame) -> dict[str, int] | None:
    """Ids by feature, if the dictionary is small enough to be sent round and has no feature twice."""
    rows = dictionary.select("feature", F.coalesce("attr_id", F.lit(-1)).cast("int").alias("attr_id")).where("feature IS NOT NULL").limit(SENT_FEATURES + 1).toArrow()
    found = dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
    return found if len(found) == rows.num_rows <= SENT_FEATURES else None


def single(templates) -> bool:
    """Whether templates read items of one value only."""
    return all(isinstance(p, str) or p[1] == 0 for t in templates for p in t.parts)


def encode_text(sentences: DataFrame, key: str, sentence: Column, words: str | None, dictionary: DataFrame, templates=tp.DEFAULT_TEMPLATES, carry: tuple[str, ...] = ()) -> DataFrame:
    """``encode`` of the characters of a text, with the tags of ``words`` if named; columns of ``carry`` stay beside.

    A dictionary of up to ``SENT_FEATURES`` is sent to the workers, and ids are
    found once for each distinct window of a stretch of sentences: nothing is
    shuffled.  Larger dictionaries are joined.
    """
    found = sent_dictionary(dictionary) if single(templates) else None
    if found is None:
        tags = tg.words_to_tags(F.col(words)) if words else None
        coded = encode(sentences, key, X.chars(sentence), tags, dictionary, templates)
        return coded.join(sentences.select(F.col(key).alias("key"), *carry), "key") if carry else coded
    lens = F.when(F.forall(words, lambda w: w.isNotNull()), F.transform(words, lambda w: F.length(w))) if words else F.lit(None)
    texts = sentences.select(F.col(key).alias("key"), sentence.alias("__text"), lens.cast("array<int>").alias("__lens"), *carry).where(F.length("__text") > 0)
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    shape = ", ".join(f"`{c}` {k}" for c, k in [("key", kinds["key"]), ("attr_ids", "array<int>"), ("label_ids", "array<int>"), ("n", "int"), *((c, kinds[c]) for c in carry)])
    sent = sentences.sparkSession.sparkContext.broadcast(found)
    return texts.mapInArrow(_encoder(sent, tuple(templates)), shape)


def _labels(lens: pa.Array, lengths: np.ndarray) -> pa.Array:
    """Label ids from the lengths of words; null where there are no words."""
    known = np.asarray(lens.is_valid())
    n = np.asarray(lens.flatten()).astype(np.int64)
    out = tag_ids(n[n > 0])
    ends = np.concatenate(([0], np.cumsum(np.where(known, lengths, 0)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out), mask=pa.array(~known))


def _encoder(sent, templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        for batch in batches:
            lengths = codes.text_lengths(batch.column(1))
            for a, z in codes.slices(lengths):
                part, n = batch.slice(a, z - a), lengths[a:z]
                ids = codes.feature_ids(codes.Items(codes.code_points(part.column(1)), n), templates, found)
                columns = [part.column(0), codes.list_array(ids.ravel(), n * len(templates)), _labels(part.column(2), n), pa.array(n.astype(np.int32)), *part.columns[3:]]
                yield pa.RecordBatch.from_arrays(columns, ["key", "attr_ids", "label_ids", "n", *part.schema.names[3:]])

    return run


def encode_words(sentences: DataFrame, key: str, words: str, dictionary: DataFrame, templates=tp.DEFAULT_TEMPLATES, carry: tuple[str, ...] = ()) -> DataFrame:
    """From words; characters are the items, the words give the tags."""
    return encode_text(sentences, key, F.array_join(words, ""), words, dictionary, templates, carry)


def buckets(instances: DataFrame, n: int = 100) -> DataFrame:
    """Rows dealt evenly over ``n`` buckets by a hash of the key, the same on any engine."""
    return instances.withColumn("bucket", X.md5_modulo(F.col("key").cast("string"), n))
