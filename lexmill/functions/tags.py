"""Position tags of characters in words, and back.  Inventory: P9-P12, J3."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import text as X

#: fixed values: tags in the order of their ids
TAGS = ("S", "B", "E", "B1", "B2", "M")


def word_tags(word: Column) -> Column:
    """Tags of one word by its length."""
    n = F.length(word)
    head = F.array(F.lit("B"), F.lit("B1"), F.lit("B2"))
    return (
        F.when(n <= 0, F.array().cast("array<string>"))
        .when(n == 1, F.array(F.lit("S")))
        .otherwise(F.concat(F.slice(head, F.lit(1), F.least(n - 1, F.lit(3))), F.array_repeat(F.lit("M"), F.greatest(n - 4, F.lit(0))), F.array(F.lit("E"))))
    )


def words_to_tags(words: Column) -> Column:
    """P9."""
    return F.flatten(F.transform(words, word_tags))


def label_id(tag: Column, missing: int = -1) -> Column:
    """Id of a tag, ``missing`` if there is none."""
    ids = F.create_map(*[x for k, t in enumerate(TAGS) for x in (F.lit(t), F.lit(k))])
    return F.coalesce(F.try_element_at(ids, tag), F.lit(missing))


def tag_text(ids: Column) -> Column:
    """P12."""
    names = F.array(*[F.lit(t) for t in TAGS])
    return F.transform(ids, lambda i: F.get(names, i))


def tags_to_words(tags: Column, sentence: Column, legacy: bool = False) -> Column:
    """P10.  B opens a word, E closes it, S is one; others change nothing.

    In an ill-formed sequence B or S may come while a word is open.  By default
    that word is closed before it, and nothing is lost.  ``legacy`` drops the
    character before, as the original does (possibly leaving an empty word).
    """
    if legacy:
        return X.bind(tags, lambda t: X.bind(sentence, lambda s: _legacy_words(t, s)))
    # one letter a tag: a word is B, what changes nothing and E if it comes, or any one item
    line = F.array_join(F.transform(tags, lambda t: F.when(t.isin("S", "B", "E"), t).otherwise("x")), "")
    lengths = F.transform(F.regexp_extract_all(line, F.lit("Bx*E?|."), F.lit(0)), lambda w: F.length(w))
    placed = X.bind(X.chars(sentence), lambda c: X.bind(lengths, lambda n: X.bind(X.starts(n), lambda at: F.transform(n, lambda k, i: F.array_join(F.slice(c, F.get(at, i) + 1, k), "")))))
    # tags and characters in turn, as a rule: words are found and stripped of tags by patterns, with no places to add up
    turn = F.array_join(F.zip_with(tags, X.chars(sentence), lambda t, c: F.concat(F.when(t.isin("S", "B", "E"), t).otherwise("x"), c)), "")
    matched = F.transform(F.regexp_extract_all(turn, F.lit("(?s)B.(?:x.)*+(?:E.)?|.."), F.lit(0)), lambda w: F.regexp_replace(w, "(?s).(.)", "$1"))
    words = F.when(F.length(sentence) == F.size(tags), matched).otherwise(placed)
    return F.when(F.size(tags) > 0, words).otherwise(F.array().cast("array<string>"))


def _legacy_words(tags: Column, sentence: Column) -> Column:
    start = F.struct(F.lit(-1).alias("open"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        tag = F.get(tags, i)
        opened = acc["open"] >= 0
        cut = F.substring(sentence, acc["open"] + 1, i - acc["open"] - 1)
        closed = F.when(opened, F.array(cut)).otherwise(F.array().cast("array<string>"))
        single = F.substring(sentence, i + 1, F.lit(1))
        whole = F.substring(sentence, acc["open"] + 1, i - acc["open"] + 1)
        return (
            F.when(tag == "B", F.struct(i.alias("open"), F.concat(acc["out"], closed).alias("out")))
            .when(tag == "S", F.struct(F.lit(-1).alias("open"), F.concat(acc["out"], closed, F.array(single)).alias("out")))
            .when((tag == "E") & opened, F.struct(F.lit(-1).alias("open"), F.concat(acc["out"], F.array(whole)).alias("out")))
            .otherwise(acc)
        )

    def end(acc: Column) -> Column:
        return F.when(acc["open"] >= 0, F.concat(acc["out"], F.array(F.substring(sentence, acc["open"] + 1, F.size(tags))))).otherwise(acc["out"])

    return F.when(F.size(tags) > 0, F.aggregate(F.sequence(F.lit(0), F.size(tags) - 1), start, step, end)).otherwise(F.array().cast("array<string>"))
