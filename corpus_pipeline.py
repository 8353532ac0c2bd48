"""From raw documents to a training mix in stages, each written as Parquet and read again as the next one's input.

language    documents whose language is not recognised go
near-dups   one document of each group of near copies stays, the one with the smallest id
repeats     passages of 50 words and more that stand in another document too are cut; documents with nothing left go
benchmark   documents with an item of the benchmark go
mixing      documents are taken as often as the target weights of their sources ask for

Defined results: null and wordless texts go in the first stage.  The stages decide by the text, or by id and text where one
of several stays, so rows with a null id or with one id and different texts are judged as all others are; texts are named by
64-bit hashes.  An empty table gives an empty result.  Further columns of
documents are carried along; all but the last stage return the columns they were given.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, langid, mixing, ngram_join, suffix_dedup
from graphloom.llm.common import Scratch, id_remainder, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the identifier accepts."""
    named = docs.withColumn("doc_id", F.coalesce("doc_id", F.xxhash64("text")))  # for the draw
    model = langid.train(named.where(id_remainder("doc_id", 5) != 0))
    return langid.identify(docs, model, tuple(docs.columns), "__").where("not __rejected").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, Jaccard 0.8 or more."""
    key = F.xxhash64("doc_id", "text")
    groups = ngram_join.ngram_join(docs.select(key.alias("doc_id"), "text"), gram=5, percent=80)
    groups = groups.select(F.col("doc_id").alias("__key"), "component_id").distinct()
    ids = docs.select(key.alias("__key"), F.col("doc_id").alias("__id")).distinct()
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__key"))
    kept = ids.join(groups, "__key").groupBy("component_id").agg(first.alias("m")).select(F.col("m.__key").alias("__key"))
    return docs.withColumn("__key", key).join(kept, "__key").dropDuplicates(["__key"]).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand in another text too, from their first word to their last."""
    found = suffix_dedup.remove_passages(docs.select(F.xxhash64("text").alias("doc_id"), "text"), with_text=True)

    def texts(batches):
        for b in batches:
            kept = [k.decode() for k in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string())], names=["__id", "__kept"])

    cut = found.where("n_removed > 0").select("doc_id", "kept").mapInArrow(texts, "__id long, __kept string")
    cut = cut.dropDuplicates(["__id"])  # copies lose the same
    joined = docs.join(cut, F.xxhash64("text") == F.col("__id"), "left")
    changed = F.col("__id").isNotNull()
    text = F.when(changed, F.col("__kept")).otherwise(F.col("text"))
    blank = changed & ~F.col("__kept").rlike(r"[^\x20\x09-\x0D]")
    columns = [text.alias(c) if c == "text" else F.when(changed, F.length("__kept").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return joined.where(~blank).select(*columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    found = decontaminate.find_items(docs.select(F.xxhash64("text").alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    hit = found.where("size(hits) > 0").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(hit, F.xxhash64("text") == F.col("__id"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their size and the words taken, repeats counted."""
    return mixing.mix(docs).where("taken > 0")


STAGES: list[tuple[str, Stage]] = [
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("benchmark", drop_contaminated),
    ("mixing", mix_sources),
]

#: The first stage trains a model, so SQL cannot express the rows of run().
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
