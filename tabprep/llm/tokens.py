"""Exact length histogram of encoded documents (operator 2).

Documents are aggregated by encoded length. Sums from the long end of the
histogram answer, for every context limit at once, how many documents and
tokens there are, how many are cut off, and any quantile. The tokenizer's file
is a parameter; it is read on the driver and its ranks go to every task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprep.llm.bpe import PATTERN, encode_ordinary, encodings
from tabprep.llm.words import slices
from tabprep.session import cut_lineage

#: Byte-level ranks of a public tokenizer.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Lengths of a histogram part that is summed by itself.
PART = 1024
_encoders: dict = {}


def encoder(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """Of the rank file's content; one a worker."""
    return _both(ranks, pattern)[0]


def _both(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
    key = (hash(ranks), pattern)
    if key not in _encoders:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _encoders[key] = encodings(table, pattern)
    return _encoders[key]


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_file: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """id and n_tokens of every row. Null and empty texts have none; whole texts are encoded, long white space included.
    A pattern of one's own splits white space before words as the given one does."""
    with open(ranks_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _both(shared.value, pattern)
        for batch in slices(batches, "text"):
            n = [len(encode_ordinary(both, t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long")


def histogram(encoded: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row per length that occurs, and what holds for it as a context limit.

    n_tokens, n_docs; docs_longer and tokens_longer (documents above it and their tokens), docs_within,
    tokens_within; truncated_total (tokens when every document is cut to it), lost (tokens cut off), share_whole
    (documents that fit), n_all and tokens_all. Null lengths count as nothing. An empty table gives an empty result.

    Lengths are summed in parts of PART lengths, and only the parts' totals over one ordered window: the longest
    document's length over PART rows.
    """
    counts = encoded.where(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))
    counts = cut_lineage(counts)  # one row per length; the texts are encoded once
    counts = counts.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("part", (F.col("n_tokens") / PART).cast("long"))
    after = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    everything = Window.partitionBy()
    parts = counts.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    parts = parts.select("part", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in ("d", "t")], F.sum("d").over(everything).alias("n_all"), F.sum("t").over(everything).alias("tokens_all"))
    own = Window.partitionBy("part").orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    rows = counts.join(parts, "part")
    rows = rows.withColumn("docs_longer", F.coalesce(F.sum("n_docs").over(own), F.lit(0)) + F.col("d_after")).withColumn("tokens_longer", F.coalesce(F.sum("tokens").over(own), F.lit(0)) + F.col("t_after"))
    rows = rows.withColumn("docs_within", F.col("n_all") - F.col("docs_longer")).withColumn("tokens_within", F.col("tokens_all") - F.col("tokens_longer"))
    rows = rows.withColumn("truncated_total", F.col("tokens_within") + F.col("docs_longer") * F.col("n_tokens"))
    return rows.select("n_tokens", "n_docs", "docs_longer", "tokens_longer", "docs_within", "tokens_within", "truncated_total", (F.col("tokens_all") - F.col("truncated_total")).alias("lost"),
                       (F.col("docs_within") / F.col("n_all")).alias("share_whole"), "n_all", "tokens_all")


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_whole, truncated_total and lost for any context limits, from a histogram.

    Cutting at a limit between two lengths works as at the next smaller one, but every longer document keeps more."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    # the largest length within each limit, by a join on a handful of limits
    below = sums.join(F.broadcast(asked), F.col("n_tokens") <= F.col("limit")).groupBy("limit").agg(F.max_by(F.struct("n_tokens", "docs_longer", "docs_within", "tokens_within", "tokens_all"), "n_tokens").alias("x"))
    whole = sums.agg(F.max("n_all").alias("n_all"), F.max("tokens_all").alias("tokens_all"))
    out = asked.join(below, "limit", "left").join(F.broadcast(whole))
    longer, within = F.coalesce("x.docs_longer", "n_all"), F.coalesce("x.tokens_within", F.lit(0))
    out = out.select("limit", F.coalesce("x.docs_within", F.lit(0)).alias("docs_whole"), (within + longer * F.col("limit")).alias("truncated_total"), "tokens_all")
    return out.select("limit", "docs_whole", "truncated_total", (F.col("tokens_all") - F.col("truncated_total")).alias("lost"))


def quantile(sums: DataFrame, share: float) -> int | None:
    """The smallest length that at least ``share`` of the documents stay within."""
    row = sums.where(F.col("docs_within") >= share * F.col("n_all")).agg(F.min("n_tokens").alias("n")).first()
    return row.n
