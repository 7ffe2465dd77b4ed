"""Command line.  Inventory: section 2.13, S28.

Each command reads and writes tables by path, so a step can be left out by
starting from what an earlier one wrote.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexmill.functions import templates as tp
from lexmill.functions import text as X
from lexmill.operators import decode, features, hybrid, instances, model, train
from lexmill.sources import config, corpus
from lexmill.sources.shared import written


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _features(spark, path, templates):
    lines = spark.read.text(path).where(X.not_blank(F.col("value")))
    return features.sentence_features(lines, X.strip_tabs(X.normalize(F.col("value"))), templates)


def _keyed(corpus_df):
    """Every line, repeated ones too, under a key of its own; written, so that the keys stay."""
    return written(corpus_df.select(F.monotonically_increasing_id().alias("key"), F.transform("tokens", F.lower).alias("tokens")), "lines")


def _lines(spark, args):
    """Lines of text, decoded where a charset is named."""
    lines = spark.read.text(args.input)
    if getattr(args, "charset", None):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        lines = lines.select(corpus.decode(F.col("value").cast("binary"), args.charset).alias("value"))
    return lines


def _segmented(spark, args, found, aw, w):
    """Every line in its place, segmented; blank lines stay as they are, equal ones are worked on once."""
    lines = written(spark.read.text(args.input).select(F.monotonically_increasing_id().alias("at"), "value", F.lower("value").alias("line")), "lines")
    distinct = lines.where(X.not_blank(F.col("line"))).select(F.col("line").alias("key")).distinct()
    words = hybrid.segment_crf(distinct.withColumn("line", F.col("key")), "key", "line", found, aw, w).select(F.col("key").alias("line"), F.array_join("words", "\t").alias("words"))
    return lines.join(words, "line", "left").orderBy("at").select(F.coalesce("words", "value").alias("value"))


def run(args, spark: SparkSession) -> None:
    templates = tp.read(_read(args.templates)) if getattr(args, "templates", None) else tp.DEFAULT_TEMPLATES
    if args.command == "feature-count":
        features.count(_features(spark, args.input, templates)).write.mode("overwrite").parquet(args.output)
    elif args.command == "feature-filter":
        counts, rules = spark.read.parquet(args.input), corpus.rules(spark, _read(args.rules))
        out = features.filter_stat(counts, rules) if args.stat_only else features.filtered(counts, rules)
        out.write.mode("overwrite").parquet(args.output)
    elif args.command == "feature-stat":
        features.histogram(spark.read.parquet(args.input)).write.mode("overwrite").parquet(args.output)
    elif args.command == "word-count":
        words = _lines(spark, args).select(F.explode(X.split_tabs(F.lower("value"))).alias("word")).where("word <> ''")
        words.groupBy("word").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(args.output)
    elif args.command == "feature-dict":
        features.dictionary(spark.read.parquet(args.input)).write.mode("overwrite").parquet(args.output)
    elif args.command == "reverse-dict":
        corpus.write_tsv(spark.read.parquet(args.input).select("feature", "attr_id"), args.output)
    elif args.command == "dict-size":
        print(features.check_dense(spark.read.parquet(args.input)).first().asDict())
    elif args.command == "instances":
        instances.encode_words(_keyed(corpus.tab_corpus(spark, args.input)), "key", "tokens", spark.read.parquet(args.dictionary), templates).write.mode("overwrite").parquet(args.output)
    elif args.command == "train":
        params = config.load_params(_read(args.properties)) if args.properties else config.TrainingParams()
        found = spark.read.parquet(args.dictionary)

        def saved(df, k):
            path = f"{args.output}/result{k}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.parquet(path)

        def told(k, epochs):
            for r in epochs.toLocalIterator():
                print(f"round {k} epoch {r['epoch']} log likelihood {r['loglik']:.4f}")

        w = train.train(spark.read.parquet(args.input), params, args.groups, args.rounds, params.iterations, saved, told)
        model.save(args.output, w, found, params.to_json())
    elif args.command == "importance":
        model.ranked(model.scores(model.attr_weights(model.load(spark, args.input)[0]))).write.mode("overwrite").parquet(args.output)
    elif args.command == "truncate":
        w, found, meta = model.load(spark, args.input)
        kept, weights = model.truncate(w, found, args.top)
        import json

        model.save(args.output, weights, kept, json.dumps(meta["params"]))
    elif args.command in ("test", "seg"):
        w, found, _ = model.load(spark, args.model)
        aw = model.attr_weights(w)
        if args.command == "seg":
            _segmented(spark, args, found, aw, w).write.mode("overwrite").text(args.output)
        else:
            enc = instances.encode_words(_keyed(corpus.tab_corpus(spark, args.input)), "key", "tokens", found, templates)
            got = decode.viterbi(enc, aw, w).select("key", F.col("label_ids").alias("pred")).join(enc.select("key", F.col("label_ids").alias("gold")), "key")
            print(model.accuracy(got).first().asDict())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexmill")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("feature-count", "feature-filter", "feature-stat", "word-count", "feature-dict", "reverse-dict", "dict-size", "instances", "train", "importance", "truncate", "test", "seg"):
        s = sub.add_parser(name)
        s.add_argument("input")
        if name not in ("dict-size", "test"):
            s.add_argument("output")
        if name in ("feature-count", "instances", "test"):
            s.add_argument("--templates")
        if name == "feature-filter":
            s.add_argument("--rules", required=True)
            s.add_argument("--stat-only", action="store_true")
        if name == "word-count":
            s.add_argument("--charset")
        if name in ("instances", "train"):
            s.add_argument("--dictionary", required=True)
        if name == "train":
            s.add_argument("--properties")
            s.add_argument("--groups", type=int, default=1)
            s.add_argument("--rounds", type=int, default=1)
        if name == "truncate":
            s.add_argument("--top", type=int, required=True)
        if name in ("test", "seg"):
            s.add_argument("--model", required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    run(parser().parse_args(argv), SparkSession.builder.appName("lexmill").getOrCreate())
    return 0


if __name__ == "__main__":
    sys.exit(main())
