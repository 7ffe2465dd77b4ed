"""Removal of multi-line chunks and passages that repeat anywhere in the corpus, in DataFrame operations only.

Lines are hashed; a rolling hash over each line and the one before it chooses
chunk boundaries at its local minima, so an insertion moves only the boundaries
next to it, and a chunk inside a text has two lines at least.  Chunks of two or
more lines (not all blank) are counted by hash over the whole corpus; those met
more than once are then compared byte by byte, and all but the first occurrence
(smallest doc_id, then text hash, then line) are removed.

Chunks miss passages between foreign lines, so with ``passage_words`` every run
of whole lines with so many words or more that an earlier place has goes as well,
up to its true ends and down to a single line.  The shortest runs of so many words from
each line on and back from each line, blank lines left out, depend on nothing
outside themselves and together cover every such passage; runs are compared by
SHA-256 of the SHA-256 of their lines.  In one document, a run that overlaps its
first occurrence stays.  The query and the pipeline ask for passages of
``PASSAGE_WORDS``; without, chunks alone go.  ``__chunks_removed`` counts chunks,
and passages that reach beyond them.

Texts are split and hashed once, into a table of marks (place and hash of every
chunk and line).  Only the chunks and lines whose hash repeats are fetched; a
passage can lie only within neighbouring lines that all repeat.

Repeats inside one document count.  Hot chunks and lines are safe: counts and
firsts are partially aggregated, and the joins on them may be split by adaptive
execution.

Defined edge cases: null text stays null, empty text stays empty; a single-line
text is changed only as a passage; a very long text is one row and its lines are
worked on as others are; a null doc_id comes before all others; rows with equal
doc_id and equal text are treated alike (the pair counts as a repeat but keeps
its own first occurrence); all columns of the input are kept as they are, whatever
their names, but for ``__lines_removed`` and ``__chunks_removed``, which the result
replaces; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.scratch import Scratch

MIN_LINES = 2
#: words of a repeated passage that goes whatever its lines, "over 50"
PASSAGE_WORDS = 51
_MOD = 2147483647
_BASE = 1000003

_WORD = r"[^ \\t\\r]"

#: chunks (kind 0) and lines that are not blank (kind 1, with their rank among these) of ``text``; each inner array is bound once
_MARKS = f"""
transform(array(split(text, '\n', -1)), lines ->
  transform(array(transform(lines, x -> xxhash64(x))), lh ->
    transform(array(transform(lines, x -> CAST(conv(substr(md5(x), 1, 7), 16, 10) AS BIGINT))), h ->
      transform(array(transform(h, (x, i) -> (IF(i = 0, 0L, h[i - 1]) * {_BASE}L + x) % {_MOD}L)), r ->
        transform(array(filter(sequence(0, size(r) - 1), i -> i = size(r) - 1 OR (i > 0 AND r[i] < r[i - 1] AND r[i] <= r[i + 1]))), ends ->
          concat(
            transform(
              filter(
                transform(ends, (e, j) -> named_struct('s', IF(j = 0, 0, ends[j - 1] + 1), 'n', e - IF(j = 0, -1, ends[j - 1]))),
                c -> c.n >= {MIN_LINES} AND exists(slice(lines, c.s + 1, c.n), x -> x RLIKE '{_WORD}')
              ),
              c -> named_struct('kind', 0, 's', c.s, 'n', c.n, 'k', 0, 'h', xxhash64(slice(lh, c.s + 1, c.n)))
            ),
            {{lines}}
          )
        )[0]
      )[0]
    )[0]
  )[0]
)[0]
"""
_LINE_MARKS = f"transform(filter(sequence(0, size(lines) - 1), i -> lines[i] RLIKE '{_WORD}'), (i, k) -> named_struct('kind', 1, 's', i, 'n', 1, 'k', k, 'h', lh[i]))"
_NO_LINES = "array()"


def _bodies(scratch: Scratch, docs: DataFrame, passages: bool) -> DataFrame:
    """id, text hash, kind, first line, number of lines, rank and text of every chunk and line whose hash is met more than once."""
    made = F.expr(_MARKS.replace("{lines}", _LINE_MARKS if passages else _NO_LINES))
    marks = scratch.table(docs.where("text IS NOT NULL").select("id", "th", F.explode(made).alias("m")).select("id", "th", "m.*"))
    repeated = marks.groupBy("kind", "h").agg(F.count("*").alias("c")).where("c > 1").select("kind", "h")
    met = marks.join(repeated.hint("shuffle_hash"), ["kind", "h"]).groupBy(F.col("id").alias("mid"), F.col("th").alias("mth")).agg(F.collect_set(F.struct("kind", "s", "n", "k")).alias("met"))
    held = docs.join(met.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("mid")) & (F.col("th") == F.col("mth")))
    cut = F.expr("""
        transform(array(split(text, '\n', -1)), lines ->
          transform(met, m -> named_struct('kind', m.kind, 's', m.s, 'n', m.n, 'k', m.k, 'body', array_join(slice(lines, m.s + 1, m.n), '\n')))
        )[0]""")
    out = scratch.table(held.select("id", "th", F.explode(cut).alias("m")).select("id", "th", "m.*"))
    scratch.drop(marks)
    return out


def _passage_rows(bodies: DataFrame, words: int) -> DataFrame:
    """id, text hash, first and last line, side and digest of the shortest runs of ``words`` words from each line on and back from it, among neighbouring lines that repeat."""
    lines = bodies.where("kind = 1").select("id", "th", F.col("s").alias("i"), "k", F.expr(r"regexp_count(body, '[^ \\t\\r]+')").cast("long").alias("w"), F.sha2("body", 256).alias("d"))
    # rows alike in id and text are one; a single exchange serves this and the windows
    lines = lines.repartition("id", "th").distinct()
    own = Window.partitionBy("id", "th").orderBy("k")
    lines = lines.withColumn("part", F.col("k") - F.row_number().over(own))
    own = Window.partitionBy("id", "th", "part")
    lines = lines.withColumn("all", F.sum("w").over(own)).where(F.col("all") >= words)
    lines = lines.withColumn("e", F.sum("w").over(own.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).withColumn("first", F.col("e") - F.col("w"))
    ahead, back = own.orderBy("first").rangeBetween(0, words - 1), own.orderBy("e").rangeBetween(1 - words, 0)
    key = lambda w: F.unhex(F.sha2(F.concat_ws("", F.collect_list("d").over(w)), 256))
    on = F.when(F.max("e").over(ahead) - F.col("first") >= words, F.struct(F.lit(0).alias("side"), F.col("i").alias("a"), F.max("i").over(ahead).alias("z"), key(ahead).alias("key")))
    to = F.when(F.col("e") - F.min("first").over(back) >= words, F.struct(F.lit(1).alias("side"), F.min("i").over(back).alias("a"), F.col("i").alias("z"), key(back).alias("key")))
    return lines.select("id", "th", on.alias("on"), to.alias("to")).select("id", "th", F.explode(F.array("on", "to")).alias("r")).where("r IS NOT NULL").select("id", "th", "r.*")


def _passages_gone(scratch: Scratch, bodies: DataFrame, words: int) -> DataFrame:
    """id, text hash and the merged runs of lines, first and number, that an earlier place has."""
    made = scratch.table(_passage_rows(bodies, words))
    firsts = made.groupBy("side", "key").agg(F.min(F.struct("id", "th", "a", "z")).alias("first"), F.count("*").alias("c")).where("c > 1").select(F.col("side").alias("fside"), F.col("key").alias("fkey"), "first")
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    later = made.join(firsts.hint("shuffle_hash"), (F.col("side") == F.col("fside")) & (F.col("key") == F.col("fkey"))).where(~same | (F.col("a") > F.col("first.z")))
    own = Window.partitionBy("id", "th").orderBy("a", "z")
    runs = later.select("id", "th", "a", "z").withColumn("reach", F.max("z").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("k", F.sum(F.when(F.col("a") <= F.col("reach") + 1, 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("id", "th", "k").agg(F.min("a").alias("s"), F.max("z").alias("z"))
    return runs.groupBy("id", "th").agg(F.collect_list(F.struct("s", (F.col("z") - F.col("s") + 1).alias("n"))).alias("passages"))


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_words: int | None = None) -> DataFrame:
    """The input with repeated chunks, and passages of ``passage_words`` words if given, cut out of ``text_col``; adds ``__lines_removed`` and ``__chunks_removed``."""
    scratch = Scratch(spark, "line-dedup")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("th", F.xxhash64("text"))
    bodies = _bodies(scratch, base, bool(passage_words))
    chunks = bodies.where("kind = 0").select("id", "th", "s", "n", "body")
    firsts = chunks.groupBy("body").agg(F.min(F.struct("id", "th", "s")).alias("first"), F.count("*").alias("c")).where("c > 1").select(F.col("body").alias("fbody"), "first")
    later = chunks.join(firsts, F.col("body") == F.col("fbody")).where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")) & (F.col("s") == F.col("first.s"))))
    gone = later.groupBy("id", "th").agg(F.collect_set(F.struct("s", "n")).alias("chunks"), F.lit(None).cast("array<struct<s:int,n:int>>").alias("passages"))
    if passage_words:
        gone = gone.unionByName(_passages_gone(scratch, bodies, passage_words).select("id", "th", F.lit(None).alias("chunks"), "passages"))
    gone = gone.groupBy(F.col("id").alias("gid"), F.col("th").alias("gth")).agg(F.first("chunks", True).alias("chunks"), F.first("passages", True).alias("passages"))
    spread = lambda c: f"array_distinct(flatten(transform(coalesce({c}, array()), g -> sequence(g.s, g.s + g.n - 1))))"
    gone = gone.withColumn("cut", F.expr(spread("chunks"))).withColumn("more", F.expr("size(filter(coalesce(passages, array()), g -> size(array_except(sequence(g.s, g.s + g.n - 1), cut)) > 0))"))
    gone = scratch.table(gone.select("gid", "gth", F.expr(f"array_union(cut, {spread('passages')})").alias("gone"), (F.expr("size(coalesce(chunks, array()))") + F.col("more")).alias("n")))
    given = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("th", F.xxhash64("text"))
    out = given.join(gone.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left")
    kept = F.expr("""
        transform(array(split(text, '\n', -1)), lines ->
          array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\n')
        )[0]""")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    columns = [text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("__lines_removed", "__chunks_removed")]
    return out.select(*columns, F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("__lines_removed"), F.coalesce("n", F.lit(0)).alias("__chunks_removed"))


ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents WHERE text IS NOT NULL
), h AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS x FROM l
), r AS (
  SELECT *, (coalesce(lag(x) OVER (PARTITION BY doc_id ORDER BY i), 0) * {_BASE} + x) % {_MOD} AS r FROM h
), e AS (
  SELECT *, CASE WHEN r < lag(r) OVER w AND r <= lead(r) OVER w THEN 1 ELSE 0 END AS is_end FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), k AS (
  SELECT *, coalesce(sum(is_end) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e
), c AS (
  SELECT doc_id, k, min(i) AS s, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM k GROUP BY doc_id, k
), o AS (
  SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, s) AS nth FROM c WHERE n >= {MIN_LINES} AND length(translate(chunk, ' ' || chr(9) || chr(13) || chr(10), '')) > 0
), n AS (
  SELECT doc_id, i, line, e, e - w AS s FROM (
    SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT *, len(regexp_extract_all(line, '[^ \\t\\r]+')) AS w FROM l) WHERE w > 0
  )
), p AS (
  SELECT doc_id, 0 AS side, i AS a, max(i) OVER f AS z, string_agg(line, chr(10)) OVER f AS key, max(e) OVER f - s AS words FROM n
  WINDOW f AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND {PASSAGE_WORDS - 1} FOLLOWING)
  UNION ALL
  SELECT doc_id, 1, min(i) OVER f, i, string_agg(line, chr(10)) OVER f, e - min(s) OVER f FROM n
  WINDOW f AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN {PASSAGE_WORDS - 1} PRECEDING AND CURRENT ROW)
), q AS (
  SELECT *, first_value(doc_id) OVER f AS first_doc, first_value(z) OVER f AS first_z FROM p WHERE words >= {PASSAGE_WORDS}
  WINDOW f AS (PARTITION BY side, key ORDER BY doc_id, a, z)
), pl AS (
  SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM q WHERE doc_id <> first_doc OR a > first_z
), m AS (
  SELECT k.doc_id, k.i, k.line, coalesce(o.nth, 1) > 1 AS in_chunk, pl.i IS NOT NULL AS in_passage, CASE WHEN o.nth > 1 AND o.s = k.i THEN 1 ELSE 0 END AS starts
  FROM k LEFT JOIN o ON o.doc_id = k.doc_id AND o.k = k.k LEFT JOIN pl ON pl.doc_id = k.doc_id AND pl.i = k.i
), more AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT doc_id, run FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m WHERE in_passage) GROUP BY doc_id, run HAVING NOT bool_and(in_chunk)
  ) GROUP BY doc_id
), t AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT in_chunk AND NOT in_passage), '') AS text,
         CAST(count(*) FILTER (WHERE in_chunk OR in_passage) AS BIGINT) AS lines_removed, CAST(sum(starts) AS BIGINT) AS chunks_removed
  FROM m GROUP BY doc_id
)
SELECT d.doc_id, t.text, coalesce(t.lines_removed, 0) AS lines_removed, CAST(coalesce(t.chunks_removed, 0) + coalesce(more.n, 0) AS BIGINT) AS chunks_removed
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN more ON more.doc_id = d.doc_id
"""
