"""Score a stream with a fitted ``PipelineModel`` (imputer / encoder / scaler / learner).

Every fitted stage of this package is a ``select`` built from literals (or a
broadcast lookup of a bounded table), so applying it to ``readStream`` output is
a stateless projection; no stage that needs the whole table (duplicate removal,
refitting) is run on the stream.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def score_stream(model: PipelineModel, stream: DataFrame) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    return model.transform(stream)


def stream_parquet(spark: SparkSession, path: str, schema, max_files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def run_to_memory(scored: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Drain a bounded source into a memory table (tests / smoke runs)."""
    q = (scored.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", checkpoint).start())
    q.processAllAvailable()
    return q
