"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkeda.llm import lang_id, line_dedup, near_dup, packing, quality_rules
from sparkeda.llm.shared import WORD, shared_folder

#: A document whose language covers a smaller share of its letters is too mixed to keep.
LANGUAGE_SHARE = 0.5


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns under names that no operator uses, and these names."""
    at = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*at.values()), at


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table; null and empty texts go."""
    return quality_rules.passing(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the stage's own labelled input; texts without a letter go.

    Where no document has a language there is nothing to learn from, and every document stays.
    """
    model = lang_id.learn_held_out(docs)
    if not model.langs:
        return docs
    plain, at = _numbered(docs)
    found = lang_id.predict(plain, model, text=at["text"], carry=plain.columns)
    stays = found.filter((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= LANGUAGE_SHARE))
    return stays.select(*(F.col(at[c]).alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand, up to one edit, earlier in the corpus.

    n_chars follows the text. A document that has lost lines goes only if no word is left in it; short lines alone are a text too.
    """
    plain, at = _numbered(docs)
    made = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    other = [at[c] for c in docs.columns if c not in made]
    found = line_dedup.dedup(plain, at["doc_id"], at["text"], other).filter((F.col("n_dropped") == 0) | F.col("text").rlike(WORD))
    return found.select(*(made.get(c, F.col(at[c])).alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of near copies; of rows equal in id and text one.

    A row is known by its id and the digest of its text, so different texts under one id, or under none, all stay.
    """
    chosen = near_dup.firsts(docs).select(F.col("doc_id").alias("chosen"), F.col("d1").alias("c1"), F.col("d2").alias("c2"))
    named = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", *(c.alias(n) for n, c in near_dup.digests().items()))
    kept = named.join(chosen, F.expr("d1 = c1 AND d2 = c2 AND doc_id <=> chosen"), "left_semi")
    return kept.dropDuplicates(["doc_id", "d1", "d2"]).select("row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality), ("language_id", language), ("line_dedup", lines), ("near_dedup", near_copies),
    ("packing", sequences),
]
#: The stages learn a model, link by sketches and run a tokenizer, which SQL cannot say; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; each result is written as Parquet and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
