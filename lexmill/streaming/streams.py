"""The stateless operators and the counts over streams of lines.  Inventory: S26, A11, section 2.11.

Column functions are the same as in batch; only counts keep state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import tags as tg
from lexmill.functions import text as X
from lexmill.operators import features, model, pretok
from lexmill.sources import corpus


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files that arrive in a folder."""
    return spark.readStream.text(folder)


def tokens(stream: DataFrame, value: str = "value") -> DataFrame:
    """Word-break tokens, row by row."""
    return stream.select(F.explode(pretok.tokens(F.col(value))).alias("t")).select("t.*").where("type IS NOT NULL")


def feature_counts(stream: DataFrame, value: str = "value") -> DataFrame:
    """Running feature counts; for update or complete mode."""
    return features.count(features.sentence_features(stream, X.strip_tabs(X.normalize(F.col(value)))))


def tag_counts(stream: DataFrame, value: str = "value") -> DataFrame:
    """Running counts of tags over a tab corpus."""
    return corpus.tab_lines(stream, value).select(F.explode(tg.words_to_tags(F.col("tokens"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def evaluation(stream: DataFrame) -> DataFrame:
    """Running accuracy over ``gold, pred`` arrays; for complete mode."""
    return model.accuracy(stream)
