"""Resharding by minimum-cost flow: from old shard sizes and new capacities, the block transfers that move the fewest bytes.

The network has the old shards as sources, the new ones as sinks and a cost per
byte on each pair (0 where the shard stays, 1 elsewhere, or a given matrix).  It
is solved once, by successive shortest paths on shard sizes alone, a few dozen
numbers on the driver.  In its solution no shard both sends and receives, and
neither do the documents: only senders give any up, each in the amounts of the
flow, so the bytes moved are the fewest that lead to the sizes reached.

A sender's documents are dealt to its amounts in hash order, cut at running byte
totals: first all but its smallest (which make up about ``FILL_SHARE`` of its
bytes), each amount taking its part of them, then those, against what room is
really left of each amount, so that sizes end within a few small documents of
the flow's.  Running totals are two-level: within hash buckets of an old shard,
then over bucket sums, so that an old shard with a third of all rows is spread.

A row is known by the file that holds it and its place there (rows that come from
no files are written first), so copies that the plan parts stay apart when
``rewrite_affected`` writes the shards that gain or lose rows.

Law: ``bytes``.  A document's size is the UTF-8 bytes of its text (null: none)
plus 8.  Defined edge cases: null text has size 8 and checksum 0, empty text has
too; null ids are placed as others; repeated rows are placed each; a very long
text is one document and goes whole, so sizes differ by as much; an old shard of
null is 0; an empty table gives an empty one; extra columns are ignored by
``reshard`` and kept by ``rewrite_affected``, whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.llm.scratch import Scratch

FILL_SHARE = 0.1
BUCKET_ROWS = 500_000


def min_cost_flow(supply: dict[int, int], room: dict[int, int], cost=None) -> dict[tuple[int, int], int]:
    """Amount from each old to each new shard, all supply placed, least total cost.

    ``cost(i, j)`` is per unit and not negative; by default 0 if i == j, else 1.
    Total room must not be less than total supply.
    """
    cost = cost or (lambda i, j: int(i != j))
    left = [i for i in sorted(supply) if supply[i] > 0]
    right = [j for j in sorted(room) if room[j] > 0]
    if sum(supply[i] for i in left) > sum(room[j] for j in right):
        raise ValueError("more to place than room")
    flow: dict[tuple[int, int], int] = {}
    need, free = dict(supply), dict(room)
    height = {("l", i): 0 for i in left} | {("r", j): 0 for j in right}
    while any(need[i] for i in left):
        # Dijkstra with potentials over the residual graph, from every old shard with something left
        dist, back = {("l", i): 0 for i in left if need[i]}, {}
        heap = [(0, v) for v in dist]
        heapq.heapify(heap)
        done = set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            if v[0] == "l":
                near = [(("r", j), cost(v[1], j)) for j in right]
            else:
                near = [(("l", i), -cost(i, v[1])) for i in left if flow.get((i, v[1]))]
            for u, c in near:
                e = d + c + height[v] - height[u]
                if e < dist.get(u, float("inf")):
                    dist[u], back[u] = e, v
                    heapq.heappush(heap, (e, u))
        ends = [("r", j) for j in right if free[j]]
        end = min(ends, key=lambda v: (dist.get(v, float("inf")) + height[v], v))
        far = max(dist.values())
        for v in height:
            height[v] += dist.get(v, far)
        path, v = [], end
        while v in back:
            path.append((back[v], v))
            v = back[v]
        amount = min([need[v[1]], free[end[1]], *(flow[b[1], a[1]] for a, b in path if a[0] == "r")])
        for a, b in path:
            if a[0] == "l":
                flow[a[1], b[1]] = flow.get((a[1], b[1]), 0) + amount
            else:
                flow[b[1], a[1]] -= amount
        need[v[1]] -= amount
        free[end[1]] -= amount
    return {k: f for k, f in flow.items() if f}


def _even(total: int, parts: int) -> dict[int, int]:
    return {j: total // parts + (j < total % parts) for j in range(parts)}


def _placed(rows: DataFrame, bins: dict[int, list[tuple[int, float]]], buckets: int) -> DataFrame:
    """``rows`` with ``shard``: each old shard's rows in hash order, cut at running totals into ``bins`` of (new shard, amount)."""
    whole = F.lit(None).cast("int")
    for i in sorted(bins):
        if len(bins[i]) == 1:
            whole = F.when(F.col("old") == i, F.lit(bins[i][0][0])).otherwise(whole)
    cut = sorted(i for i in bins if len(bins[i]) > 1)
    kept = rows.where(~F.col("old").isin(cut)).withColumn("shard", whole)
    if not cut:
        return kept
    dealt = rows.where(F.col("old").isin(cut)).withColumn("bucket", F.pmod(F.col("mix"), F.lit(buckets)))
    ahead = Window.partitionBy("old").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("old", "bucket").agg(F.sum("size").alias("s")).select("old", "bucket", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("old", "bucket").orderBy("mix", "file", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = dealt.withColumn("upto", F.sum("size").over(within)).join(base, ["old", "bucket"])
    middle = F.col("before") + F.col("upto") - F.col("size") / 2
    shard = F.lit(None).cast("int")
    for i in cut:
        inner, start = F.lit(bins[i][0][0]), bins[i][0][1]
        for j, amount in bins[i][1:]:
            inner = F.when(middle >= start, F.lit(j)).otherwise(inner)
            start += amount
        shard = F.when(F.col("old") == i, inner).otherwise(shard)
    return kept.unionByName(total.withColumn("shard", shard.cast("int")).select(kept.columns))


def _rooms(want: dict[int, float], fill: float) -> dict[int, float]:
    """Room of each bin, lowered by one level where they offer more than ``fill``."""
    room = {j: max(0.0, w) for j, w in want.items()}
    over = sum(room.values()) - fill
    while over > 1e-6:
        open_ = [j for j in room if room[j] > 0]
        step = min(min(room[j] for j in open_), over / len(open_))
        for j in open_:
            room[j] -= step
        over -= step * len(open_)
    return room


def _free(docs: DataFrame) -> str:
    """A column name that ``docs`` lacks."""
    name = "old_shard"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def with_places(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` as ``row``, with the file and the place in it that tell rows apart."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    try:
        at = docs.metadataColumn("_metadata")
        return docs.select(row, F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("place"))
    except AnalysisException:
        held = Scratch(spark, "resharding-rows").table(docs.select(row))
        at = held.metadataColumn("_metadata")
        return held.select("row", F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("place"))


def reshard(spark: SparkSession, docs: DataFrame, old_shard: Column, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard`` of every row, and its ``file`` and ``place``.

    ``old_shard`` is the number of the shard that now holds the row; a new shard
    of that number counts as the same place.
    """
    name = _free(docs)
    return plan_moves(spark, with_places(spark, docs.withColumn(name, old_shard)), shards, id_col, text_col, name)


def plan_moves(spark: SparkSession, placed: DataFrame, shards: int, id_col: str, text_col: str, old_col: str) -> DataFrame:
    """``reshard`` over the rows of ``with_places``."""
    scratch = Scratch(spark, "resharding")
    text = F.col("row").getField(text_col)
    rows = placed.select(
        F.col("row").getField(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.col("row").getField(old_col), F.lit(0)).cast("int").alias("old"),
        "file",
        "place",
    ).withColumn("mix", F.xxhash64("doc_id", "text_crc32", "size", "file", "place"))
    rows = scratch.table(rows)
    # by old shard, sizes in steps of an eighth of a power of two
    step = F.ceil(8 * F.log2("size")).cast("int")
    by_step: dict[int, list] = {}
    for r in rows.groupBy("old", step.alias("step")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).orderBy("old", "step").collect():
        by_step.setdefault(r["old"], []).append(r)
    sums = {i: sum(r["b"] for r in steps) for i, steps in by_step.items()}
    buckets = max(16, -(-sum(r["n"] for steps in by_step.values() for r in steps) // BUCKET_ROWS))
    flow: dict[int, dict[int, int]] = {}
    for (i, j), f in sorted(min_cost_flow(sums, _even(sum(sums.values()), shards)).items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        flow.setdefault(i, {})[j] = f
    # the step up to which an old shard's documents are its small ones, and their bytes
    small, fill = F.lit(False), {}
    for i, steps in by_step.items():
        fill[i], least = 0, 0
        for r in steps:
            if fill[i] >= FILL_SHARE * sums[i]:
                break
            fill[i], least = fill[i] + r["b"], r["step"]
        small = F.when(F.col("old") == i, step <= least).otherwise(small)
    rows = rows.withColumn("small", small)
    share = {i: 1 - fill[i] / sums[i] for i in sums}
    first = scratch.table(_placed(rows.where("NOT small"), {i: [(j, f * share[i]) for j, f in to.items()] for i, to in flow.items()}, buckets))
    taken = {(r["old"], r["shard"]): r["b"] for r in first.groupBy("old", "shard").agg(F.sum("size").alias("b")).collect()}
    left = {i: list(_rooms({j: f - taken.get((i, j), 0) for j, f in to.items()}, fill[i]).items()) for i, to in flow.items()}
    second = _placed(rows.where("small"), left, buckets)
    placed = scratch.table(first.unionByName(second.select(first.columns)))
    scratch.drop(first)

    dealt = placed.withColumn("bucket", F.pmod(F.xxhash64("mix"), F.lit(buckets)))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("c")).select("shard", "bucket", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "file", "place")
    slotted = dealt.withColumn("rn", F.row_number().over(within)).join(base, ["shard", "bucket"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"), "file", "place")


def rewrite_affected(placed: DataFrame, plan: DataFrame, path: str) -> list[int]:
    """Write, below ``path``, the shards that gain or lose rows, each row with its ``slot``; returns their numbers.

    ``placed`` are the rows of ``with_places`` that the plan was made of.  A new
    shard whose rows are just those of the old shard of its number is left alone.
    """
    moved = plan.where(F.col("shard") != F.col("old_shard"))
    touched = sorted(r[0] for r in moved.select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct().collect())
    here = plan.where(F.col("shard").isin(touched)).select(F.col("file").alias("pfile"), F.col("place").alias("pplace"), "slot", "shard")
    met = placed.join(here.hint("shuffle_hash"), (F.col("file") == F.col("pfile")) & (F.col("place") == F.col("pplace")))
    met.select("row", "slot", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    return touched


def reshard_and_rewrite(spark: SparkSession, docs: DataFrame, old_shard: Column, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The plan carried out: rows of affected shards as they were read back from their new files, the others as planned."""
    scratch = Scratch(spark, "resharding-plan")
    name = _free(docs)
    placed = with_places(spark, docs.withColumn(name, old_shard))
    plan = scratch.table(plan_moves(spark, placed, shards, id_col, text_col, name))
    touched = rewrite_affected(placed, plan, path)
    columns = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "old_shard"]
    kept = plan.where(~F.col("shard").isin(touched)).select(columns)
    if not touched:
        return kept
    text = F.col("row").getField(text_col)
    written = spark.read.schema(placed.select("row").schema.add("slot", "long").add("shard", "integer")).parquet(path)
    return kept.unionByName(
        written.select(
            F.col("row").getField(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            "shard",
            "slot",
            F.lit(None).cast("int").alias("grown_shard"),
            F.coalesce(F.col("row").getField(name), F.lit(0)).cast("int").alias("old_shard"),
        )
    )
