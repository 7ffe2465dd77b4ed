"""Scalar column functions over text lines, features and counts.  Inventory: P1-P3, P13-P18, P26, F1, F2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MAX = 2147483647
#: fixed values: the characters of Chinese numbers
NUMBER_CHARS = "零一二三四五六七八九十百千万亿"


def normalize(text: Column) -> Column:
    """Lower case."""
    return F.lower(text)


def strip_tabs(text: Column) -> Column:
    """Words of a tab corpus line joined to the sentence."""
    return F.translate(text, "\t", "")


def chars(text: Column) -> Column:
    """Characters (code points) of a text; empty text gives an empty array."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def not_blank(line: Column) -> Column:
    """something is left when control characters and spaces are trimmed at both ends."""
    return F.length(F.regexp_replace(line, r"^[\x00-\x20]+|[\x00-\x20]+$", "")) > 0


def split_tabs(line: Column) -> Column:
    """Fields between tabs, without trailing empty ones."""
    return F.split(F.regexp_replace(line, r"\t+$", ""), "\t")


def reverse(text: Column) -> Column:
    """P13."""
    return F.reverse(text)


def feature_prefix(feature: Column) -> Column:
    """Template name before the first colon."""
    return F.substring_index(feature, ":", 1)


def histogram_key(prefix: Column, count: Column) -> Column:
    """``prefix-0000000012``."""
    return F.concat(prefix, F.lit("-"), F.lpad(count.cast("string"), 10, "0"))


def frequency_bucket(count: Column) -> Column:
    """Exact below 80, then ranges."""
    return F.when(count < 80, count.cast("string")).when(count < 1000, "80-1000").when(count < 10000, "1000-10000").when(count < 100000, "10000-100000").otherwise("100000-")


def repair_filter(count: Column) -> Column:
    """Undo a 32-bit overflow the way the filter job does; -1 stays."""
    return F.when((count < -1) & (count >= -(1 << 31)), count + F.lit(1 << 32)).otherwise(count)


def repair_stat(count: Column) -> Column:
    """The histogram job's other repair."""
    return F.when(count < 0, count + INT_MAX).otherwise(count)


def is_number_char(ch: Column) -> Column:
    """P26."""
    return F.lit(NUMBER_CHARS).contains(ch)


def md5_modulo(text: Column, n: int) -> Column:
    """0 to ``n`` - 1 by the first 32 bits of the text's MD5; any engine has it."""
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n).cast("int")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row, however often the body's lambdas read it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def starts(lengths: Column, block: int = 256) -> Column:
    """Where each piece begins, from the pieces' lengths.

    Sums run within blocks and over block totals, so the cost stays near linear
    in long texts (one accumulating array would copy itself at every step).
    """

    def running(values: Column) -> Column:
        zero = F.array(F.lit(0))
        return F.aggregate(values, zero, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def whole(held: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(held) - 1, F.lit(0)), F.lit(block)), lambda b: F.slice(held, b + 1, F.lit(block)))

        def placed(blocks: Column) -> Column:
            totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
            return bind(running(totals), lambda before: F.flatten(F.transform(blocks, lambda b, k: F.slice(F.transform(running(b), lambda x: x + F.get(before, k)), F.lit(1), F.size(b)))))

        return bind(cuts, placed)

    return bind(lengths, whole)
