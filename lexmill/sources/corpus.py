"""Scans and sinks of corpora, counts, rules, instances and weights.  Inventory: S1-S12, S14-S18, S25, U1, F8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.functions import text as X

INSTANCE = T.StructType([T.StructField("attrIds", T.ArrayType(T.IntegerType())), T.StructField("labelIds", T.ArrayType(T.IntegerType())), T.StructField("length", T.IntegerType())])


def tab_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``tokens`` of each line that is not blank.  Directories, hidden files and compression are the reader's work."""
    return tab_lines(spark.read.text(path))


def tab_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """S1 over a frame, batch or stream, that has the lines already."""
    return lines.where(X.not_blank(F.col(value))).select(*[c for c in lines.columns if c != value], X.split_tabs(F.col(value)).alias("tokens"))


def column_corpus(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    """S3: ``path, sent_no, cols, labels, n``; a blank line ends a sequence, the last column is the label."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return column_text(whole, "path", labelled)


def column_text(texts: DataFrame, id_col: str, labelled: bool = True, value: str = "value") -> DataFrame:
    """S3 over texts.  Lines with another number of columns than the text's first raise an error."""
    blocks = texts.select(id_col, F.posexplode(F.split(value, r"\n(?:[ \t\r]*\n)+")).alias("sent_no", "block"))

    def cells(line):
        return X.bind(F.trim(F.regexp_replace(line, r"[\x00-\x20]+", " ")), lambda x: F.split(x, " "))

    # lines are taken apart once a block: what several columns read would be worked out for each, and inside a lambda for each line
    def parts(rows):
        return X.bind(F.size(F.get(rows, F.lit(0))), lambda width: F.struct(
            F.transform(rows, lambda r: F.when(F.size(r) == width, F.slice(r, F.lit(1), width - (1 if labelled else 0))).otherwise(F.raise_error(F.lit("inconsistent number of columns")).cast("array<string>"))).alias("cols"),
            (F.transform(rows, lambda r: F.element_at(r, -1)) if labelled else F.lit(None).cast("array<string>")).alias("labels"),
            F.size(rows).alias("n"),
        ))

    made = blocks.select(id_col, "sent_no", F.explode(F.transform(F.array(F.transform(F.filter(F.split("block", "\n"), X.not_blank), cells)), parts)).alias("x"))
    return made.where("x.n > 0").select(id_col, "sent_no", "x.cols", "x.labels", "x.n")


def column_labels(sequences: DataFrame) -> DataFrame:
    """``label, label_id``: the labels that occur, numbered from 0 in text order."""
    found = sequences.select(F.explode("labels").alias("label")).distinct()
    return found.select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias("label_id"))


def feature_counts(spark: SparkSession, path: str) -> DataFrame:
    """``feature <tab> count`` lines; lines of another arity are dropped (F2)."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where(F.size(parts) == 2).select(parts[0].alias("feature"), F.try_to_number(parts[1], F.lit("S9999999999999999999")).cast("long").alias("cnt"))


def rules(spark: SparkSession, text: str) -> DataFrame:
    """``prefix threshold`` lines of filter rules."""
    rows = [line.split() for line in text.splitlines() if line.strip()]
    return spark.createDataFrame([(p, int(n)) for p, n in rows], "prefix string, threshold int")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """One cleaned dictionary: trimmed, two characters at least, distinct."""
    return clean_words(spark.read.text(path).select(F.col("value").alias("word")))


def clean_words(words: DataFrame) -> DataFrame:
    return words.select(F.trim("word").alias("word")).where(F.length("word") >= 2).distinct()


def decode(binary, charset: str = "UTF-8"):
    """Text of encoded bytes; unknown charsets raise.  GBK wants ``spark.sql.legacy.javaCharsets=true``."""
    return F.decode(binary, charset)


def instance_json(df: DataFrame, key: str = "key") -> DataFrame:
    """``key <tab> json`` lines."""
    return df.select(F.concat(F.col(key).cast("string"), F.lit("\t"), F.to_json(F.struct(F.col("attr_ids").alias("attrIds"), F.col("label_ids").alias("labelIds"), F.col("n").alias("length")))).alias("value"))


def parse_instance_json(lines: DataFrame, value: str = "value") -> DataFrame:
    """The JSON after the first tab; other columns stay."""
    body, rest = F.regexp_replace(value, r"^[^\t]*\t", ""), [c for c in lines.columns if c != value]
    return lines.select(*rest, F.from_json(body, INSTANCE).alias("i")).select(*rest, F.col("i.attrIds").alias("attr_ids"), F.col("i.labelIds").alias("label_ids"), F.col("i.length").alias("n"))


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab separated text."""
    df.write.mode("overwrite").csv(path, sep="\t", quote="\u0000", emptyValue="")


def parse_weights(lines: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """``fw12 -> kind, idx, w``; an unknown kind raises."""
    kind = F.substring(key, 1, 2)
    known = F.when(kind.isin("fw", "bw", "ew", "tw"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown weight key "), F.col(key))).cast("string"))
    return lines.select(known.alias("kind"), F.substring(F.col(key), 3, 20).cast("int").alias("idx"), F.col(value).cast("double").alias("w"))
