"""Word-break tokens and runs of ideographs, by a covering pattern in the JVM.  Inventory: G4, G10-G14, F10, P21.

The pattern takes every character of a text, so offsets are running sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import codes
from lexmill.functions import text as X

MAX_TOKEN = 255
#: distinct stretches between spaces that a task holds before it hands on their numbers
HELD_WORDS = 500_000
_L, _N = r"[\p{L}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}]]\p{M}*", r"\p{Nd}"
#: word-break rules: a letter run may go on over : . ' and a digit run over . ' , ; where the same kind follows
PATTERN = (
    r"\p{IsHan}\p{M}*|\p{IsHiragana}\p{M}*|[\p{IsKatakana}ー]+\p{M}*|\p{IsHangul}+|[\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}]+"
    rf"|_*(?:{_L}|{_N})(?:_+(?:{_L}|{_N})|(?<=[\p{{L}}\p{{M}}])[:.'](?={_L}){_L}|(?<={_N})[.',;](?={_N}){_N}|{_L}|{_N})*_*|(?s:.)"
)
#: runs of ideographs are taken whole by the pattern itself
COVERING = r"(?:\p{IsHan}\p{M}*)+|" + PATTERN.split("|", 1)[1]
#: types of groups by a letter; L is a piece too long for a token, which falls into its characters
GROUPS = {"C": "CWORD", "A": "ALPHA", "N": "NUMBER", "U": "UNKNOWN", "P": "PUNCT", "L": "PUNCT"}
CLASSIC_PATTERN = (
    r"[\p{L}\p{N}]+(?:[._-][\p{L}\p{N}]+)*@[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)+"  # mail
    r"|(?:[A-Za-z]\.){2,}"  # acronym
    r"|[A-Za-z]+(?:'[A-Za-z]+)+"  # apostrophe
    r"|[A-Za-z]+[&@][A-Za-z]+"  # company
    r"|[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)+"  # host or number
    r"|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+|(?s:.)"
)


def _type(token: Column) -> Column:
    return (
        F.when(token.rlike(r"^\p{IsHan}"), "IDEOGRAPHIC")
        .when(token.rlike(r"^\p{IsHiragana}"), "HIRAGANA")
        .when(token.rlike(r"^[\p{IsKatakana}ー]"), "KATAKANA")
        .when(token.rlike(r"^\p{IsHangul}"), "HANGUL")
        .when(token.rlike(r"^[\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}]"), "SOUTHEAST_ASIAN")
        .when(token.rlike(r"\p{L}"), "WORD")
        .when(token.rlike(r"\p{Nd}"), "NUM")
    )


def _classic_type(token: Column) -> Column:
    """A sign alone is no token, whatever sign it is."""
    return (
        F.when(~token.rlike(r"[\p{L}\p{N}]"), None)
        .when(token.contains("@") & token.rlike(r"\."), "EMAIL")
        .when(token.rlike(r"^(?:[A-Za-z]\.){2,}$"), "ACRONYM")
        .when(token.contains("'"), "APOSTROPHE")
        .when(token.rlike("[&@]"), "COMPANY")
        .when(token.rlike(r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]$"), "CJ")
        .when(token.contains(".") & token.rlike(r"\d"), "NUM")
        .when(token.contains("."), "HOST")
        .when(token.rlike(r"^\p{N}+$"), "NUM")
        .otherwise("ALPHANUM")
    )


def tokens(text: Column, mode: str = "uax29", max_token: int = MAX_TOKEN) -> Column:
    """``text, begin, end, type`` of every piece of a text; what is no token, or too long for one (F10), has a null type."""
    pieces = F.regexp_extract_all(text, F.lit(PATTERN if mode == "uax29" else CLASSIC_PATTERN), F.lit(0))
    kind = _type if mode == "uax29" else _classic_type
    return X.bind(pieces, lambda held: _placed(held, lambda p: F.when(F.length(p) <= max_token, kind(p)), lambda p: p))


def spaced(texts: DataFrame, text: str) -> DataFrame:
    """``word, n``: the distinct stretches of all texts between spaces and line feeds, and these themselves, with their number.

    No piece of either pattern, and no run of letters, reaches over a space or depends on what stands
    beyond it, so what is cut from distinct stretches is what texts hold.
    """
    given = texts.select(F.col(text).alias("text")).where(F.length("text") > 0)
    return given.mapInArrow(_spaced, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _spaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def shown() -> pa.RecordBatch:
        held.pop("", None)
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    held: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update({c: n for c in " \n" if (n := text.count(c))})
            held.update(text.replace("\n", " ").split(" "))
            if len(held) > HELD_WORDS:
                yield shown()
                held = Counter()
    yield shown()


def piece_types(texts: DataFrame, text: str, mode: str = "uax29", max_token: int = MAX_TOKEN) -> DataFrame:
    """``piece, type, n``: distinct pieces of all texts with their number; equal stretches are cut and equal pieces typed once, and need no offsets."""
    pieces = spaced(texts, text).select(F.explode(F.regexp_extract_all(F.col("word"), F.lit(PATTERN if mode == "uax29" else CLASSIC_PATTERN), F.lit(0))).alias("piece"), "n")
    kind = (_type if mode == "uax29" else _classic_type)(F.col("piece"))
    return pieces.groupBy("piece").agg(F.sum("n").alias("n")).select("piece", F.when(F.length("piece") <= max_token, kind).alias("type"), "n")


def _placed(pieces: Column, kind, text) -> Column:
    """``text, begin, end, type`` of pieces in order."""

    def whole(at: Column) -> Column:
        return F.transform(pieces, lambda p, i: F.struct(text(p).alias("text"), F.get(at, i).alias("begin"), (F.get(at, i) + F.length(text(p))).alias("end"), kind(p).alias("type")))

    return X.bind(X.starts(F.transform(pieces, lambda p: F.length(text(p)))), whole)


def groups(text: Column, legacy_trailing_drop: bool = False) -> Column:
    """``text, begin, end, type``: runs of ideographs (CWORD), words (ALPHA), numbers (NUMBER), others (UNKNOWN), and every character between as PUNCT.

    ``legacy_trailing_drop`` loses what follows the last token, as the original does.
    """
    pieces = F.regexp_extract_all(text, F.lit(COVERING), F.lit(0))
    kind = _type

    def named(p: Column) -> Column:
        t = F.when(F.length(p) <= MAX_TOKEN, kind(p))
        t = F.when(p.rlike(r"^\p{IsHan}"), "IDEOGRAPHIC").otherwise(t)
        return F.when(t == "IDEOGRAPHIC", "CWORD").when(t == "WORD", "ALPHA").when(t == "NUM", "NUMBER").when(t.isNotNull(), "UNKNOWN").otherwise("PUNCT")

    # a piece too long for a token falls into its characters
    split = F.flatten(F.transform(pieces, lambda p: F.when((F.length(p) > MAX_TOKEN) & ~p.rlike(r"^\p{IsHan}"), F.transform(F.filter(F.split(p, ""), lambda c: c != ""), lambda c: F.struct(c.alias("p"), F.lit("PUNCT").alias("t")))).otherwise(F.array(F.struct(p.alias("p"), named(p).alias("t"))))))
    out = X.bind(split, lambda held: _placed(held, lambda s: s["t"], lambda s: s["p"]))
    if legacy_trailing_drop:
        def cut(held: Column) -> Column:
            last = F.coalesce(F.array_max(F.transform(F.filter(held, lambda t: t["type"] != "PUNCT"), lambda t: t["end"])), F.lit(0))
            return X.bind(last, lambda z: F.filter(held, lambda t: t["begin"] < z))

        out = X.bind(out, cut)
    return out


def _letter(piece: Column) -> Column:
    """The letter of a piece's group, with few patterns tried on common pieces."""
    scripts = r"\p{IsHiragana}\p{IsKatakana}ー\p{IsHangul}\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}"
    return (
        F.when(piece.rlike(r"^\p{IsHan}"), "C")
        .when(F.length(piece) > MAX_TOKEN, "L")
        .when(~piece.rlike(rf"^[{scripts}]|[\p{{L}}\p{{Nd}}]"), "P")
        .when(piece.rlike(rf"^[{scripts}]"), "U")
        .when(piece.rlike(r"\p{L}"), "A")
        .otherwise("N")
    )


def lettered(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pieces, letters``: the pieces of ``groups``, long ones whole, and a letter each of ``GROUPS``."""
    held = texts.select(F.col(key).alias("key"), F.regexp_extract_all(F.col(text), F.lit(COVERING), F.lit(0)).alias("pieces"))
    return held.select("key", "pieces", F.array_join(F.transform("pieces", _letter), "").alias("letters"))


def cut_pieces(batches: Iterator[pa.RecordBatch], cut: Callable[[str, str], list[str]]) -> Iterator[tuple]:
    """Stretches of ``lettered`` texts: keys, tokens of each text, and of all tokens texts, begins, ends and letters.

    ``cut(piece, letter)`` gives a piece's tokens, once for each distinct piece of a stretch.
    """
    for batch in batches:
        counts = np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), 0)).astype(np.int64)
        for a, z in codes.slices(counts):
            part, n = batch.slice(a, z - a), counts[a:z]
            letters = np.frombuffer("".join(filter(None, part.column(2).to_pylist())).encode(), np.uint8)
            coded = part.column(1).flatten().dictionary_encode()
            place, pieces = np.asarray(coded.indices), coded.dictionary.to_pylist()
            letter = np.zeros(len(pieces), np.uint8)
            letter[place] = letters
            made = pa.array([cut(p, chr(k)) for p, k in zip(pieces, letter.tolist(), strict=True)], pa.list_(pa.string()))
            tokens = made.take(pa.array(place)).flatten()
            each = np.asarray(pc.list_value_length(made)).astype(np.int64)[place]
            before = np.concatenate(([0], np.cumsum(each)))[np.concatenate(([0], np.cumsum(n)))]
            lengths = np.asarray(pc.utf8_length(tokens)).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(lengths)))
            begins = ends[:-1] - np.repeat(ends[before[:-1]], np.diff(before))
            yield part.column(0), np.diff(before), tokens, begins.astype(np.int32), (begins + lengths).astype(np.int32), np.repeat(letters, each)


def group_names(letters: np.ndarray) -> pa.Array:
    """Types of groups from their letters."""
    names = list(GROUPS)
    place = np.zeros(128, np.int32)
    place[[ord(k) for k in names]] = np.arange(len(names))
    return pa.array(list(GROUPS.values())).take(pa.array(place[letters]))


def group_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text, begin, end, type``: ``groups`` of texts as rows; pieces are cut and placed in Arrow, many texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n, tokens, begins, ends, letters in cut_pieces(batches, lambda p, k: list(p) if k == "L" else [p]):
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(np.arange(len(n)), n))), tokens, pa.array(begins), pa.array(ends), group_names(letters)], ["key", "text", "begin", "end", "type"])

    held = lettered(texts, key, text)
    return held.mapInArrow(run, f"key {held.schema['key'].dataType.simpleString()}, text string, begin int, end int, type string")
