"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows of the stage before it; run() writes each stage's rows as
Parquet into the shared folder (spark.checkpoint.dir) and reads them again. A stage keeps the columns of documents,
but for the last, which gives the encoded rows. Extra columns of documents stay; their names don't matter.

Rows with null texts go in the first stage (they have no words). Later stages define what they do with null ids: they
are kept as single documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.llm import decontaminate, pieces, quality, simhash, substrings
from tabprep.llm.queries import table
from tabprep.session import cut_lineage, ensure_checkpoint_dir


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, id, digest): a document's columns, whatever their names, beside what tells it from others."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("digest"))


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text")


def _same() -> Column:
    return F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.digest") == F.col("b.digest"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and are no anomaly. Rows of one id pass or go with their own text."""
    judged = quality.assess(_narrow(docs), table(spark, sf_dir, "labels"))
    passed = judged.where("kept").select("id", "digest").distinct()
    return _keyed(docs).alias("a").join(passed.alias("b"), _same(), "left_semi").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links (three-word shingles, 3 bits): the one with the smallest id. Rows of that
    id in one group are reduced to one; rows without an id stay unless their group has one, equal ones reduced to one."""
    groups = cut_lineage(simhash.near_duplicates(_narrow(docs)).select("id", "digest", "root", "component"))
    keep = groups.where("id <=> component")
    repeated = not groups.groupBy("id").count().where("count > 1").isEmpty()
    if repeated:
        keep = keep.where("id is not null").groupBy("root", "id").agg(F.min("digest").alias("digest")).unionByName(keep.where("id is null").select("root", "id", "digest").distinct())
    first = _keyed(docs).alias("a").join(keep.select("id", "digest").alias("b"), _same(), "left_semi")
    if repeated:  # texts are shuffled once more only for repeated rows
        first = first.dropDuplicates(["id", "digest"])
    return first.select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; documents of which nothing is left go."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("others")
    left = substrings.remove_repeats(docs.select("doc_id", "text", others), keep="others").where("n_removed = 0 or n_removed < n_words")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("kept.n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.select(*[(new[c] if c in new else F.col(f"kept.`{c}`")).alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    judged = decontaminate.decontaminate(_narrow(docs), table(spark, sf_dir, "benchmark"))
    bad = judged.where("contaminated").select("id", "digest").distinct()
    return _keyed(docs).alias("a").join(bad.alias("b"), _same(), "left_anti").select("row.*")


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, all pieces of its n best paths with their scores, and whether decoding gives the text back."""
    back = pieces.round_trip(_narrow(docs))
    exact = F.sha2(F.col("text").cast("binary"), 256).eqNullSafe(F.col("text_sha256"))
    return back.select(F.col("id").alias("doc_id"), "n_pieces", F.try_element_at("scores", F.lit(1)).alias("score"), F.try_element_at("scores", F.lit(2)).alias("second_score"), exact.alias("exact"), "ids", "scores", "paths")


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", piece_encoding),
]

#: Components of near-duplicates and trained stages are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
