"""Segmentation by dictionary, with a random field where the two walks differ.  Inventory: G4-G9, C14, Q11, Q12.

Only runs on which the walks disagree are encoded and scored; all others never
leave the JVM.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import codes
from lexmill.functions import text as X
from lexmill.operators import decode, dictseg, instances, pretok
from lexmill.sources.shared import written

#: up to this many distinct runs are sent to every worker with their words' lengths; more are joined
SENT_RUNS = 500_000


def _slices(ambiguous: DataFrame, legacy_context: bool) -> DataFrame:
    """Both candidate word lists of every region, with one word of context where both sides have the same."""
    r = F.col("r")
    rows = ambiguous.select("run", "fwd", "bwd", F.posexplode(dictseg.regions(F.col("fwd"), F.col("bwd"))).alias("region", "r"))
    f, b = dictseg.cut(F.col("run"), F.col("fwd")), dictseg.cut(F.col("run"), F.col("bwd"))
    left = (r["i0"] > 0) & (r["j0"] > 0) & F.coalesce(F.get("fwd", r["i0"] - 1) == F.get("bwd", r["j0"] - 1), F.lit(False))
    if legacy_context:
        right = (r["i1"] < F.size("fwd") - 2) & F.coalesce(F.get("fwd", r["i1"] + 2) == F.get("bwd", r["j1"] + 2), F.lit(False))
    else:
        right = (r["i1"] < F.size("fwd")) & (r["j1"] < F.size("bwd")) & F.coalesce(F.get("fwd", r["i1"]) == F.get("bwd", r["j1"]), F.lit(False))

    def words(all_words, a, z):
        first = a - F.when(left, 1).otherwise(0)
        return F.slice(all_words, first + 1, z - first + F.when(right, 1).otherwise(0))

    return rows.select("run", "region", "r", words(f, r["i0"], r["i1"]).alias("w0"), words(b, r["j0"], r["j1"]).alias("w1"))


def disambiguate(runs: DataFrame, words: DataFrame, dictionary: DataFrame, attr_weights: DataFrame, model_weights: DataFrame, legacy_context: bool = False) -> DataFrame:
    """``run, lengths``; the forward words of a region stay where they score at least as high."""
    # read several times below, and the runs and words by both walks
    walked = written(dictseg.both(written(runs, "runs"), words), "walked")
    sides = _slices(walked.where("NOT same"), legacy_context).select("run", "region", "r", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("w0").alias("words")), F.struct(F.lit(1).alias("side"), F.col("w1").alias("words")))).alias("s")).select(F.to_json(F.struct("run", "region", "s.side")).alias("key"), "run", "region", "r", "s.side", "s.words")
    encoded = instances.encode_words(sides.select("key", "words"), "key", "words", dictionary)
    scored = sides.join(decode.path_scores(encoded, attr_weights, model_weights), "key")
    better = scored.groupBy("run", "region", "r").agg(F.max(F.when(F.col("side") == 0, F.col("score"))).alias("s0"), F.max(F.when(F.col("side") == 1, F.col("score"))).alias("s1")).where("s1 > s0")
    taken = better.groupBy("run").agg(F.array_sort(F.collect_list("r")).alias("taken"))
    joined = walked.join(taken, "run", "left")
    # forward words up to each region taken, the region's backward words, and what follows the last
    parts = F.transform("taken", lambda t, i: F.flatten(F.array(F.slice("fwd", *_span(F.coalesce(F.get("taken", i - 1)["i1"], F.lit(0)), t["i0"])), F.slice("bwd", *_span(t["j0"], t["j1"])))))
    merged = F.concat(F.flatten(parts), F.slice("fwd", *_span(F.element_at("taken", -1)["i1"], F.size("fwd"))))
    return joined.select("run", F.when(F.col("taken").isNull(), F.col("fwd")).otherwise(merged).alias("lengths"))


def _span(a, z):
    """First element (from 1) and number of the elements ``a`` to ``z`` (from 0)."""
    return a + 1, z - a


def _runs(texts: DataFrame, text: str) -> DataFrame:
    """Distinct runs of ideographs of two characters at least."""
    pieces = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pretok.COVERING), F.lit(0))).alias("run"))
    return pieces.where((F.length("run") > 1) & F.col("run").rlike(r"^\p{IsHan}")).distinct()


def segment_texts(texts: DataFrame, key: str, text: str, words: DataFrame, dictionary: DataFrame, attr_weights: DataFrame, model_weights: DataFrame, legacy_context: bool = False) -> DataFrame:
    """``segment`` with a row a text that has tokens: ``key, tokens``, structs of ``begin, end, text, type`` in order.

    Distinct runs are segmented; up to ``SENT_RUNS`` of them are sent to the workers, and
    texts are cut where they lie.  More are joined, with a shuffle of every token.
    """
    solved = written(disambiguate(_runs(texts, text), words, dictionary, attr_weights, model_weights, legacy_context), "solved")
    rows = solved.select("run", "lengths").limit(SENT_RUNS + 1).toArrow()
    if rows.num_rows > SENT_RUNS:
        got = _cut_joined(pretok.group_rows(texts, key, text), solved)
        return got.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "text", "type"))).alias("tokens"))
    sent = texts.sparkSession.sparkContext.broadcast(dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)))

    def cut(piece: str, letter: str) -> list[str]:
        if letter == "C" and len(piece) > 1:
            ends = list(itertools.accumulate(sent.value[piece]))
            return [piece[a:z] for a, z in zip([0, *ends], ends)]  # noqa: B905
        return list(piece) if letter == "L" else [piece]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n, tokens, begins, ends, letters in pretok.cut_pieces(batches, cut):
            made = pa.StructArray.from_arrays([pa.array(begins), pa.array(ends), tokens, pretok.group_names(letters)], ["begin", "end", "text", "type"])
            some = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([keys.filter(some), codes.list_array(made, n[n > 0])], ["key", "tokens"])

    held = pretok.lettered(texts, key, text)
    return held.mapInArrow(run, f"key {held.schema['key'].dataType.simpleString()}, tokens array<struct<begin:int,end:int,text:string,type:string>>")


def segment(texts: DataFrame, key: str, text: str, words: DataFrame, dictionary: DataFrame, attr_weights: DataFrame, model_weights: DataFrame, legacy_context: bool = False, legacy_trailing_drop: bool = False) -> DataFrame:
    """``key, begin, end, text, type`` of every token of whole texts.

    Runs of ideographs (CWORD) are segmented; words, numbers and every character
    between are tokens as the pre-tokenizer groups them.  Offsets are in the text.
    """
    if not legacy_trailing_drop:
        got = segment_texts(texts, key, text, words, dictionary, attr_weights, model_weights, legacy_context)
        return got.select("key", F.explode("tokens").alias("t")).select("key", "t.begin", "t.end", "t.text", "t.type")
    grouped = texts.select(F.col(key).alias("key"), F.explode(pretok.groups(F.col(text), legacy_trailing_drop)).alias("g")).select("key", "g.text", "g.begin", "g.end", "g.type")
    runs = grouped.where(_long()).select(F.col("text").alias("run")).distinct()
    return _cut_joined(grouped, disambiguate(runs, words, dictionary, attr_weights, model_weights, legacy_context))


def _long() -> Column:
    return (F.col("type") == "CWORD") & (F.length("text") > 1)


def _cut_joined(grouped: DataFrame, solved: DataFrame) -> DataFrame:
    one = grouped.where(~_long()).select("key", "begin", "end", "text", "type")
    runs = grouped.where(_long()).join(solved, F.col("text") == F.col("run"))
    cut = X.bind(F.col("lengths"), lambda n: F.arrays_zip(X.starts(n).alias("at"), n.alias("len")))
    many = runs.select("key", "begin", "text", "type", F.explode(cut).alias("w")).where("w.len IS NOT NULL")
    many = many.select("key", (F.col("begin") + F.col("w.at")).alias("begin"), (F.col("begin") + F.col("w.at") + F.col("w.len")).alias("end"), F.expr("substring(text, w.at + 1, w.len)").alias("text"), "type")
    return one.unionByName(many)


def segment_n_best(sentences: DataFrame, key: str, sentence: str, dictionary: DataFrame, attr_weights: DataFrame, model_weights: DataFrame, n_paths: int) -> DataFrame:
    """``key, rank, score, words`` of the best paths."""
    from lexmill.functions import tags as tg

    given = sentences.select(F.col(key).alias("key"), F.col(sentence).alias("sentence"))
    encoded = instances.encode_text(given, "key", F.col("sentence"), None, dictionary, carry=("sentence",))
    best = decode.n_best(encoded, attr_weights, model_weights, n_paths, carry=("sentence",))
    return best.select("key", "rank", "score", tg.tags_to_words(tg.tag_text(F.col("label_ids")), F.col("sentence")).alias("words"))


def segment_crf(sentences: DataFrame, key: str, sentence: str, dictionary: DataFrame, attr_weights: DataFrame, model_weights: DataFrame) -> DataFrame:
    """C14: ``key, sentence, words`` by the best tags alone."""
    from lexmill.functions import tags as tg

    given = sentences.select(F.col(key).alias("key"), F.col(sentence).alias("sentence"))
    encoded = instances.encode_text(given, "key", F.col("sentence"), None, dictionary, carry=("sentence",))
    best = decode.viterbi(encoded, attr_weights, model_weights, carry=("sentence",))
    return best.select("key", "sentence", tg.tags_to_words(tg.tag_text(F.col("label_ids")), F.col("sentence")).alias("words"))
