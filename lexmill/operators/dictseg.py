"""Dictionary segmentation by longest match, and its disagreements.  Inventory: G1-G3, J11, J12, U3, U4, W6, P22, P23, P26.

A dictionary of up to ``SENT_WORDS`` words is sent to every worker, which walks
over distinct runs.  Of a larger one, and with numbers, longest matches of all
positions are found by a join, and the greedy walk over them is an array
expression.  A dictionary word holds no white space, so the walk over a text is
the walk over its runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X


#: places of a run that are walked at a time, so that no array grows by one place after another
WALK_BLOCK = 256
#: dictionaries up to this size are sent to every worker, about 60 MB there; larger ones are joined
SENT_WORDS = 500_000
#: runs whose walks a worker holds at a time
WALKED_RUNS = 10_000


def longest(runs: DataFrame, dictionary: DataFrame, run: str = "run") -> DataFrame:
    """``run, at, len`` of the longest dictionary word at each position that begins one.

    Only lengths that words with the same first two characters have are tried, so
    one long word costs nothing elsewhere.
    """
    lengths = dictionary.where(F.length("word") >= 2).groupBy(F.substring("word", 1, 2).alias("__two")).agg(F.collect_set(F.length("word")).alias("__lens"))
    starts = runs.select(run).where(F.length(run) >= 2).select(run, F.explode(F.sequence(F.lit(0), F.length(run) - 2)).alias("at"))
    near = starts.withColumn("__two", F.expr(f"substring({run}, at + 1, 2)")).join(lengths, "__two")
    spans = near.select(run, "at", F.explode(F.filter("__lens", lambda n: n <= F.length(run) - F.col("at"))).alias("len"))
    tried = spans.withColumn("word", F.expr(f"substring({run}, at + 1, len)"))
    return tried.join(dictionary.select("word"), "word").groupBy(run, "at").agg(F.max("len").alias("len"))


def _everywhere(found: Column, n: Column) -> Column:
    """Word lengths of all ``n`` places from ``at, len`` of some, in order; 1 where none begins."""
    return X.bind(
        found,
        lambda f: F.concat(
            F.flatten(F.transform(f, lambda x, i: F.concat(F.array_repeat(F.lit(1), F.when(i > 0, x["at"] - F.get(f, i - 1)["at"] - 1).otherwise(x["at"])), F.array(x["len"])))),
            F.array_repeat(F.lit(1), n - F.coalesce(F.try_element_at(f, F.lit(-1))["at"] + 1, F.lit(0))),
        ),
    )


def _walk(run: Column, found: Column) -> Column:
    """Lengths of the words of the greedy walk over ``found``, sorted ``at, len``; linear in the run's length.

    Places are walked in blocks; a block gives its own array and hands on where the
    next word begins.
    """

    def within(lens: Column, first: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("next"), F.array().cast("array<int>").alias("out"))

        # ``next`` counts the places that the word before still covers
        def step(acc: Column, n: Column) -> Column:
            return F.when(acc["next"] > 0, F.struct((acc["next"] - 1).alias("next"), acc["out"].alias("out"))).otherwise(F.struct((n - 1).alias("next"), F.concat(acc["out"], F.array(n)).alias("out")))

        return F.aggregate(F.slice(lens, first + 1, F.lit(WALK_BLOCK)), start, step)

    def whole(lens: Column) -> Column:
        none = F.struct(F.lit(0).alias("next"), F.array().cast("array<array<int>>").alias("out"))

        def block(acc: Column, first: Column) -> Column:
            return X.bind(within(lens, first, acc["next"]), lambda got: F.struct(got["next"].alias("next"), F.concat(acc["out"], F.array(got["out"])).alias("out")))

        return F.aggregate(F.sequence(F.lit(0), F.size(lens) - 1, F.lit(WALK_BLOCK)), none, block, lambda a: F.flatten(a["out"]))

    return F.when(F.length(run) > 0, X.bind(_everywhere(found, F.length(run)), whole)).otherwise(F.array().cast("array<int>"))


def cut(run: Column, lengths: Column) -> Column:
    """Words of given lengths."""
    return X.bind(lengths, lambda n: X.bind(X.starts(n), lambda at: F.transform(n, lambda k, i: F.substring(run, F.get(at, i) + 1, k))))


def number_runs(runs: DataFrame, run: str = "run") -> DataFrame:
    """``run, at, len`` of number characters from each position on, two at least."""
    chars = runs.select(run, F.explode(F.sequence(F.lit(0), F.length(run) - 1)).alias("at")).where(F.length(run) > 0)
    rest = F.regexp_extract(F.expr(f"substring({run}, at + 1)"), f"^[{X.NUMBER_CHARS}]+", 0)
    return chars.select(run, "at", F.length(rest).alias("len")).where("len > 1")


class Words:
    """Dictionary words, and by their first and last two characters their lengths, longest first."""

    def __init__(self, words: set[str]):
        self.words = {w for w in words if len(w) >= 2}
        self.after, self.before = ({two: sorted(k, reverse=True) for two, k in self._lengths(part).items()} for part in (slice(None, 2), slice(-2, None)))

    def _lengths(self, part: slice) -> dict[str, set[int]]:
        out: dict[str, set[int]] = {}
        for w in self.words:
            out.setdefault(w[part], set()).add(len(w))
        return out

    def forward(self, run: str) -> list[int]:
        """G1: lengths of the words of the greedy walk; 1 where none begins."""
        at, n, out = 0, len(run), []
        while at < n:
            out.append(next((k for k in self.after.get(run[at : at + 2], ()) if at + k <= n and run[at : at + k] in self.words), 1))
            at += out[-1]
        return out

    def backward(self, run: str) -> list[int]:
        """The same from the end."""
        end, out = len(run), []
        while end > 0:
            out.append(next((k for k in self.before.get(run[max(end - 2, 0) : end], ()) if k <= end and run[end - k : end] in self.words), 1))
            end -= out[-1]
        return out[::-1]


def sent_words(dictionary: DataFrame):
    """The dictionary as broadcast ``Words``, if it is small enough."""
    rows = dictionary.where("word IS NOT NULL").select("word").limit(SENT_WORDS + 1).toArrow()
    return None if rows.num_rows > SENT_WORDS else dictionary.sparkSession.sparkContext.broadcast(Words(set(rows.column(0).to_pylist())))


def _distinct(runs: DataFrame, run: str) -> DataFrame:
    return runs.select(run).where(F.col(run).isNotNull()).distinct()


def _walked(runs: DataFrame, run: str, sides: dict[str, str], sent) -> DataFrame:
    """Distinct runs and their walks: columns by name and method of ``Words``."""
    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, WALKED_RUNS):
                part = batch.column(0)[a : a + WALKED_RUNS]
                held = part.to_pylist()
                made = [pa.array(map(getattr(sent.value, way), held), pa.list_(pa.int32())) for way in sides.values()]
                yield pa.RecordBatch.from_arrays([part, *made], [run, *sides])

    return _distinct(runs, run).mapInArrow(walks, ", ".join([f"`{run}` string", *(f"`{c}` array<int>" for c in sides)]))


def forward(runs: DataFrame, dictionary: DataFrame, numbers: bool = False, run: str = "run") -> DataFrame:
    """G1: ``run, lengths`` of distinct runs; with ``numbers``, a longer run of number characters wins."""
    if not numbers and (sent := sent_words(dictionary)) is not None:
        return _walked(runs, run, {"lengths": "forward"}, sent)
    return _forward_joined(runs, dictionary, numbers, run)


def _forward_joined(runs: DataFrame, dictionary: DataFrame, numbers: bool, run: str) -> DataFrame:
    runs = runs.select(run).distinct()
    found = longest(runs, dictionary, run)
    if numbers:
        found = found.unionByName(number_runs(runs, run)).groupBy(run, "at").agg(F.max("len").alias("len"))
    by_run = found.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("at", "len"))).alias("__found"))
    return runs.join(by_run, run, "left").select(run, _walk(F.col(run), F.coalesce("__found", F.array().cast("array<struct<at:int,len:int>>"))).alias("lengths"))


def backward(runs: DataFrame, dictionary: DataFrame, numbers: bool = False, run: str = "run") -> DataFrame:
    """The forward walk over reversed runs and words, turned round."""
    if not numbers and (sent := sent_words(dictionary)) is not None:
        return _walked(runs, run, {"lengths": "backward"}, sent)
    return _backward_joined(runs, dictionary, numbers, run)


def _backward_joined(runs: DataFrame, dictionary: DataFrame, numbers: bool, run: str) -> DataFrame:
    turned = _forward_joined(runs.select(F.reverse(run).alias(run)), dictionary.select(F.reverse("word").alias("word")), numbers, run)
    return turned.select(F.reverse(run).alias(run), F.reverse("lengths").alias("lengths"))


def ends(lengths: Column) -> Column:
    """Running end offsets."""
    return X.bind(lengths, lambda n: F.zip_with(X.starts(n), n, lambda a, k: a + k))


def both(runs: DataFrame, dictionary: DataFrame, run: str = "run") -> DataFrame:
    """``run, fwd, bwd, same`` (P23: segmentations are equal when their lengths are)."""
    if (sent := sent_words(dictionary)) is not None:
        return _walked(runs, run, {"fwd": "forward", "bwd": "backward"}, sent).withColumn("same", F.col("fwd") == F.col("bwd"))
    f, b = _forward_joined(runs, dictionary, False, run).withColumnRenamed("lengths", "fwd"), _backward_joined(runs, dictionary, False, run).withColumnRenamed("lengths", "bwd")
    return f.join(b, run).withColumn("same", F.col("fwd") == F.col("bwd"))


def differing(fwd: list[int], bwd: list[int]) -> list[tuple[int, ...]]:
    """``regions`` of two lists of word lengths that come to the same."""
    out, begin, i, j = [], (0, 0, 0), 0, 0
    while i < len(fwd):
        e1, e2, i, j = begin[0] + fwd[i], begin[0] + bwd[j], i + 1, j + 1
        while e1 != e2:
            if e1 < e2:
                e1, i = e1 + fwd[i], i + 1
            else:
                e2, j = e2 + bwd[j], j + 1
        start, i0, j0 = begin
        if i - i0 > 1 or j - j0 > 1:
            out.append((start, e1, i0, j0, i, j))
        begin = e1, i, j
    return out


def disagreements(runs: DataFrame, dictionary: DataFrame, run: str = "run") -> DataFrame:
    """``run, start, end, i0, j0, i1, j1``: the regions of all distinct runs on which the two walks differ."""
    names = ("start", "end", "i0", "j0", "i1", "j1")
    sent = sent_words(dictionary)
    if sent is None:
        got = both(runs, dictionary, run).where("NOT same").select(run, F.explode(regions(F.col("fwd"), F.col("bwd"))).alias("r"))
        return got.select(run, *[f"r.{c}" for c in names])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, WALKED_RUNS):
                held = batch.column(0)[a : a + WALKED_RUNS].to_pylist()
                rows = [(r, *x) for r in held for x in differing(sent.value.forward(r), sent.value.backward(r))]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * (1 + len(names))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int32()) for c in columns[1:]]], [run, *names])

    return _distinct(runs, run).mapInArrow(found, f"`{run}` string, " + ", ".join(f"`{c}` int" for c in names))


def regions(fwd: Column, bwd: Column) -> Column:
    """Between common boundaries where the words differ: ``start, end, i0, j0, i1, j1`` (word indexes)."""
    return X.bind(ends(fwd), lambda e1: X.bind(ends(bwd), lambda e2: _regions(e1, e2)))


def _regions(e1: Column, e2: Column) -> Column:
    """Ends of both sides are sorted together; where two meet, both sides' word numbers are at hand."""

    def side(e: Column, k: int) -> Column:
        return F.transform(e, lambda v, i: F.struct(v.alias("at"), F.lit(k).alias("side"), (i + 1).alias("words")))

    def met(t: Column) -> Column:
        pairs = F.transform(t, lambda x, i: F.struct(x["at"].alias("at"), x["words"].alias("i"), F.get(t, i + 1)["words"].alias("j"), F.get(t, i + 1)["at"].alias("next")))
        return F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("next"))), F.filter(pairs, lambda p: p["at"] == p["next"]))

    def between(m: Column) -> Column:
        return F.zip_with(F.slice(m, F.lit(1), F.size(m) - 1), F.slice(m, F.lit(2), F.size(m) - 1), lambda a, b: F.struct(a["at"].alias("start"), b["at"].alias("end"), a["i"].alias("i0"), a["j"].alias("j0"), b["i"].alias("i1"), b["j"].alias("j1")))

    full = X.bind(X.bind(F.array_sort(F.concat(side(e1, 0), side(e2, 1))), met), between)
    return F.filter(full, lambda r: ((r["i1"] - r["i0"]) > 1) | ((r["j1"] - r["j0"]) > 1))
