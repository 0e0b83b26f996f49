"""Corpus pipeline: ``documents`` to token ids, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each result as Parquet in the shared folder and reads it back as the next
stage's documents.  All stages but the last keep the columns of ``documents``.

1. quality classifier: texts scored below ``quality.ACCEPT`` go;
2. quality rules: lines that fail a rule are removed (``text`` and ``n_chars``
   change), documents that are rejected go;
3. near-duplicates: the document with the smallest id of each group stays; rows
   that repeat an id are one document, the row with the longest text (among equals
   the largest by its columns) stays; rows without an id stay;
4. decontamination: contaminated documents go;
5. byte-level BPE: ``ids`` (little-endian unsigned 32-bit) of each whole text.

Null texts are empty texts: the rules reject them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderscope.llm import byte_bpe, decontaminate, line_rules, near_dedup, quality
from orderscope.llm.common import table, tune, written


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality model accepts."""
    tune(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    out = _free(docs, "_score")
    return quality.score(docs, model, out=out).where(F.col(out) >= quality.ACCEPT).drop(out)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes failing lines, and documents that fail or lose too much."""
    out = _free(docs, "_rules")
    found = line_rules.clean(docs, out=out)
    # a generator, not a filter: a filter would be pushed below and judge every line twice
    kept = F.explode(F.filter(F.array(out), lambda r: r["kept"]))
    found = found.withColumn(out, kept).withColumn("text", F.col(f"{out}.text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    tune(spark)
    kept = written(near_dedup.near_duplicates(docs).where("kept and doc_id is not null").groupBy("doc_id")
                   .agg(F.count("*").alias("rows")), "kept")
    once, again = kept.where("rows = 1").select("doc_id"), kept.where("rows > 1").select("doc_id")
    longest = F.max(F.struct(F.char_length("text").alias("_size"), F.struct(*docs.columns).alias("_row")))
    one = docs.join(again, "doc_id", "left_semi").select(docs.columns).groupBy("doc_id").agg(longest.alias("_best"))
    return (docs.join(once, "doc_id", "left_semi").select(docs.columns)
            .union(one.select("_best._row.*"))
            .union(docs.where("doc_id is null").select(docs.columns)))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are not contaminated by the benchmark."""
    out = _free(docs, "_hits")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), out=out)
    return found.where(~decontaminate.contaminated(out)).drop(out)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``ids`` of each whole text."""
    tune(spark)
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", classifier),
    ("quality rules", rules),
    ("near-duplicates", duplicates),
    ("decontamination", benchmark),
    ("byte-level BPE", encoding),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
