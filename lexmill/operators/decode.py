"""Decoding and scoring of encoded sentences.  Inventory: C2, C9, C12-C15, C18, G8, J10, F9, A16.

Instances are ``key, attr_ids, label_ids, n``; the model is ``attr_weights(attr_id,
w array)`` and ``model_weights(kind, idx, w)``.  Sentences are scored and decoded in
Arrow functions, many at a time.  Weights of up to ``SENT_WEIGHTS`` features are
sent to the workers, and nothing is shuffled; of larger models, the weights that
a sentence needs are joined to it, so no task holds the whole model.  Instead of
instances an ``Encoding`` may be given: lines are then cut, encoded and scored in one
step, with one score for each distinct window of a stretch, and no ids leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import codes
from lexmill.functions.tags import TAGS
from lexmill.operators import crf, instances as inst
from lexmill.operators.lines import Encoding, cuts

LABELS = 6
#: models of up to this many features are sent to every worker, 24 MB there; larger ones are joined
SENT_WEIGHTS = 500_000


class Table:
    """Weights by feature id; ids without weights, and -1, have zeros."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.weights = ids[order], np.vstack((weights[order], np.zeros((1, LABELS))))

    def places(self, attrs: np.ndarray) -> np.ndarray:
        """Row of ``weights`` of each id; the last for those that have none."""
        n = len(self.ids)
        if n and self.ids[0] == 0 and self.ids[-1] == n - 1:
            return np.where((attrs >= 0) & (attrs < n), attrs, n)
        at = np.searchsorted(self.ids, attrs)
        return np.where(np.append(self.ids, -1)[at] == attrs, at, n) if n else np.zeros(len(attrs), np.int64)


def sent_table(attr_weights: DataFrame):
    """The weights as a broadcast ``Table``, if there are few enough features, each once."""
    rows = attr_weights.where("attr_id >= 0").select(F.col("attr_id").cast("long"), *[F.coalesce(F.get("w", F.lit(k)), F.lit(0.0)).alias(f"w{k}") for k in range(LABELS)]).limit(SENT_WEIGHTS + 1).toArrow()
    ids = np.asarray(rows.column(0)).astype(np.int64)
    if rows.num_rows > SENT_WEIGHTS or len(np.unique(ids)) < len(ids):
        return None
    weights = np.stack([np.asarray(rows.column(1 + k)).astype(np.float64) for k in range(LABELS)], axis=1)
    return attr_weights.sparkSession.sparkContext.broadcast(Table(ids, weights))


def _joined_rows(instances: DataFrame, attr_weights: DataFrame) -> DataFrame:
    """J10, F9 by joins: ``key, pos, s``."""
    flat = instances.select("key", "n", F.posexplode("attr_ids").alias("k", "attr_id"), (F.size("attr_ids") / F.col("n")).cast("int").alias("r")).select("key", F.floor(F.col("k") / F.col("r")).cast("int").alias("pos"), "attr_id")
    wide = flat.where("attr_id >= 0").join(attr_weights, "attr_id")
    return wide.groupBy("key", "pos").agg(F.array(*[F.sum(F.get("w", F.lit(k))) for k in range(LABELS)]).alias("s"))


def _joined_states(instances: DataFrame, attr_weights: DataFrame, zeros: bool = True) -> DataFrame:
    by_key = _joined_rows(instances, attr_weights).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("pos", "s"))).alias("m"))
    none = F.array(*[F.lit(0.0)] * LABELS) if zeros else F.lit(None).cast("array<double>")
    return instances.join(by_key, "key", "left").withColumn("states", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("m", i), none)))


def _known_states(batch: pa.RecordBatch, lengths: np.ndarray, sent) -> tuple[np.ndarray, np.ndarray]:
    """State scores of all items of a batch, and which items have a known feature."""
    if sent is None:
        rows = batch.column("attr_ids_or_states").flatten()
        known = np.asarray(rows.is_valid())
        state = np.zeros((len(known), LABELS))
        state[known] = np.asarray(rows.flatten()).astype(np.float64).reshape(-1, LABELS)
        return state, known
    table, attrs = sent.value, batch.column("attr_ids_or_states")
    sizes = np.asarray(pc.list_value_length(attrs)).astype(np.int64)
    place = table.places(np.asarray(attrs.flatten()))
    state, known = np.zeros((int(lengths.sum()), LABELS)), np.zeros(int(lengths.sum()), bool)
    # all sentences have the same number of features an item, as a rule
    for r in np.unique(sizes // lengths):
        mine = sizes // lengths == r
        rows, ids = (slice(None), place) if mine.all() else (np.repeat(mine, lengths), place[np.repeat(mine, sizes)])
        found, some = np.zeros((int(lengths[mine].sum()), LABELS)), np.zeros(int(lengths[mine].sum()), bool)
        for k in range(r):
            found += table.weights[ids[k::r]]
            some |= ids[k::r] < len(table.ids)
        state[rows], known[rows] = found, some
    return state, known


def _states_array(state: np.ndarray, known: np.ndarray, lengths: np.ndarray) -> pa.Array:
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, state.size + 1, LABELS, dtype=np.int32)), pa.array(state.ravel()), mask=pa.array(~known))
    return codes.list_array(inner, lengths)


def small_weights(model_weights: DataFrame) -> dict[str, list[float]]:
    """bos, eos and transition weights: L, L and L*L numbers."""
    out: dict[str, dict[int, float]] = {"bw": {}, "ew": {}, "tw": {}}
    for r in model_weights.where(F.col("kind").isin("bw", "ew", "tw")).collect():
        out[r["kind"]][r["idx"]] = r["w"]
    return {k: [v.get(i, 0.0) for i in range(36 if k == "tw" else 6)] for k, v in out.items()}


def _shape(kinds: dict[str, str], fields: dict, carry: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {k}" for c, k in [("key", kinds["key"]), ("n", "int"), *((c, k) for c, (k, _) in fields.items()), *((c, kinds[f"__{c}"]) for c in carry)])


def _arrays(made: list, fields: dict) -> list[pa.Array]:
    return [pa.array(x, kind) if isinstance(x, np.ndarray) else x for x, (_, kind) in zip(made, fields.values(), strict=True)]


def scored(instances: DataFrame | Encoding, attr_weights: DataFrame, work, fields: dict[str, tuple[str, pa.DataType]], carry: tuple[str, ...] = (), zeros: bool = True) -> DataFrame:
    """``key, n``, what ``work`` makes of the states of many sentences, and the columns of ``carry``."""
    sent = sent_table(attr_weights)
    if isinstance(instances, Encoding):
        lines, templates = instances.lines, tuple(instances.templates)
        found = inst.sent_dictionary(instances.dictionary) if sent is not None and inst.single(templates) else None
        if found is not None and not carry:
            return lines.given().mapInArrow(_on_the_way(lines.texts.sparkSession.sparkContext.broadcast(found), sent, templates, work, fields), _shape({"key": "string"}, fields, ()))
        instances = inst.encode_words(lines.sentences(), "key", "words", instances.dictionary, templates)
    given = instances.where("n > 0")
    given = given.withColumn("attr_ids_or_states", F.col("attr_ids")) if sent is not None else _joined_states(given, attr_weights, zeros).withColumnRenamed("states", "attr_ids_or_states")
    beside = [F.col(c).alias(f"__{c}") for c in carry]
    labels = F.when(F.forall("label_ids", lambda x: x.between(0, LABELS - 1)) & (F.size("label_ids") == F.col("n")), F.col("label_ids")).cast("array<int>")
    given = given.select("key", "n", "attr_ids_or_states", labels.alias("gold"), *beside)
    names = ["key", "n", *fields, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_lengths = np.asarray(batch.column(1)).astype(np.int64)
            for a, z in codes.slices(all_lengths):
                part, lengths = batch.slice(a, z - a), all_lengths[a:z]
                state, known = _known_states(part, lengths, sent)
                made = _arrays(work(state, known, lengths, part.column(3)), fields)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), *made, *part.columns[4:]], names)

    return given.mapInArrow(run, _shape({f.name: f.dataType.simpleString() for f in given.schema}, fields, carry))


def _on_the_way(dictionary, sent, templates, work, fields):
    """Lines cut, encoded and scored in one step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, table = dictionary.value, sent.value
        for cut in cuts(batches):
            ids, place = codes.window_ids(codes.Items(cut.points, cut.lengths), templates, found)
            at = table.places(ids)
            of_window = np.zeros((len(ids), LABELS))
            for k in range(len(templates)):
                of_window += table.weights[at[:, k]]
            some = (at < len(table.ids)).any(axis=1)
            made = _arrays(work(of_window[place], some[place], cut.lengths, codes.list_array(cut.labels(), cut.lengths)), fields)
            yield pa.RecordBatch.from_arrays([cut.keys(), pa.array(cut.lengths.astype(np.int32)), *made], ["key", "n", *fields])

    return run


_STATES = ("array<array<double>>", pa.list_(pa.list_(pa.float64())))
_IDS = ("array<int>", pa.list_(pa.int32()))
_NUMBER = ("double", pa.float64())
#: a number for each label
BY_LABEL = {"double": ("array<double>", pa.list_(pa.float64())), "long": ("array<bigint>", pa.list_(pa.int64()))}


def weights(model_weights: DataFrame) -> crf.Weights:
    small = small_weights(model_weights)
    return crf.Weights(np.array(small["bw"]), np.array(small["ew"]), np.array(small["tw"]).reshape(LABELS, LABELS), np.zeros((0, LABELS)))


def attribute_rows(instances: DataFrame, attr_weights: DataFrame) -> DataFrame:
    """``key, pos, s``: state scores of each item by label, an array; missing features add nothing."""
    got = scored(instances, attr_weights, lambda state, known, lengths, gold: [_states_array(state, known, lengths)], {"states": _STATES}, zeros=False)
    return got.select("key", F.posexplode("states").alias("pos", "s")).where("s IS NOT NULL")


def by_label(values: np.ndarray) -> pa.Array:
    """Rows of a number for each label."""
    return codes.list_array(values.ravel(), np.full(len(values), LABELS))


def summed_labels(rows: DataFrame, columns: tuple[str, ...], beside: tuple[str, ...] = ()) -> DataFrame:
    """``key, label`` and sums over the rows of a key: of the numbers of ``beside``, and of those of ``columns``, one for each label."""
    one = [F.sum(c).alias(c) for c in beside] + [F.sum(F.get(c, F.lit(k))).alias(f"{c}{k}") for c in columns for k in range(LABELS)]
    each = F.array(*[F.struct(*[F.col(f"{c}{k}").alias(c) for c in columns]) for k in range(LABELS)])
    return rows.groupBy("key").agg(*one).select("key", *beside, F.posexplode(each).alias("label", "x")).select("key", "label", *beside, *[f"x.{c}" for c in columns])


def state_sums(instances: DataFrame | Encoding, attr_weights: DataFrame) -> DataFrame:
    """``key, label, score``: ``attribute_rows`` summed up where they lie; sentences without a known feature have none."""

    def work(state, known, lengths, gold):
        first = codes.starts(lengths)
        return [by_label(np.add.reduceat(state, first)), np.logical_or.reduceat(known, first)]

    got = scored(instances, attr_weights, work, {"score": BY_LABEL["double"], "known": ("boolean", pa.bool_())}, zeros=False)
    return summed_labels(got.where("known"), ("score",))


def sentence_states(instances: DataFrame, attr_weights: DataFrame) -> DataFrame:
    """``key, n, states``: the scores of all items in order, zeros where no feature is known."""
    return scored(instances, attr_weights, lambda state, known, lengths, gold: [_states_array(state, np.ones(len(state), bool), lengths)], {"states": _STATES})


def _of_gold(gold: pa.Array, lengths: np.ndarray, state: np.ndarray, score) -> pa.Array:
    """``score(state, lengths, labels)`` of the sentences that have labels, null for others."""
    known = np.asarray(gold.is_valid())
    out = np.zeros(len(lengths))
    out[known] = score(state if known.all() else state[np.repeat(known, lengths)], lengths[known], np.asarray(gold.flatten()))
    return pa.array(out, mask=~known)


def path_scores(instances: DataFrame, attr_weights: DataFrame, model_weights: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key, score`` of the given labels."""
    w = weights(model_weights)

    def work(state, known, lengths, gold):
        return [_of_gold(gold, lengths, state, lambda *x: crf.path_scores(w, *x))]

    return scored(instances, attr_weights, work, {"score": _NUMBER}, carry).drop("n")


def viterbi(instances: DataFrame | Encoding, attr_weights: DataFrame, model_weights: DataFrame, carry: tuple[str, ...] = (), states: bool = False, text: bool = False) -> DataFrame:
    """``key, label_ids, score``, with ``states`` the items' scores too; columns of ``carry`` stay beside.

    With ``text`` there are ``tags`` in place of ids, one line.
    """
    w = weights(model_weights)

    def work(state, known, lengths, gold):
        y = crf.viterbi_all(w, state, lengths)
        shown = pc.binary_join(codes.list_array(pa.array(TAGS).take(pa.array(y)), lengths), " ") if text else codes.list_array(y, lengths)
        made = [shown, crf.path_scores(w, state, lengths, y)]
        return [*made, _states_array(state, np.ones(len(state), bool), lengths)] if states else made

    fields = {"tags": ("string", pa.string())} if text else {"label_ids": _IDS}
    fields |= {"score": _NUMBER} | ({"states": _STATES} if states else {})
    return scored(instances, attr_weights, work, fields, carry).drop("n")


def n_best(instances: DataFrame, attr_weights: DataFrame, model_weights: DataFrame, n_paths: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key, rank, score, label_ids``; fewer rows where there are fewer paths."""
    w = weights(model_weights)

    def work(state, known, lengths, gold):
        score, labels = crf.n_best_all(w, state, lengths, n_paths)
        held = [codes.list_array(y, lengths) for y in labels]
        there = np.isfinite(score)
        # paths of a sentence, best first, from the lists of each rank
        take = (np.arange(n_paths) * len(lengths) + np.arange(len(lengths))[:, None])[there]
        paths = pa.StructArray.from_arrays([pa.array(score[there]), pa.concat_arrays(held).take(pa.array(take))], ["score", "label_ids"])
        return [codes.list_array(paths, there.sum(axis=1))]

    kind = pa.list_(pa.struct([("score", pa.float64()), ("label_ids", pa.list_(pa.int32()))]))
    out = scored(instances, attr_weights, work, {"paths": ("array<struct<score:double,label_ids:array<int>>>", kind)}, carry)
    return out.select("key", F.posexplode("paths").alias("rank", "p"), *carry).select("key", "rank", "p.score", "p.label_ids", *carry)


def log_probs(instances: DataFrame, attr_weights: DataFrame, model_weights: DataFrame) -> DataFrame:
    """``key, logp`` of the given labels."""
    w = weights(model_weights)

    def work(state, known, lengths, gold):
        return [_of_gold(gold, lengths, state, lambda s, n, y: crf.path_scores(w, s, n, y) - crf.log_norms(w, s, n))]

    return scored(instances, attr_weights, work, {"logp": _NUMBER}).drop("n")
