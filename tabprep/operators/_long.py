"""Turn a one-row aggregate into a long (column, metric...) table without a
driver round trip: ``explode(array(struct(...)))`` over the single row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row_long(df: DataFrame, per_column: dict[str, dict[str, Column]],
                 extra: dict[str, Column] | None = None) -> DataFrame:
    """Aggregate ``df`` once and return one row per key of ``per_column``.

    ``per_column`` maps an output key (usually a column name) to named aggregate
    expressions; every key must have the same metric names and types.
    ``extra`` holds table-level aggregates repeated on every output row.
    """
    extra = extra or {}
    aggs, structs = [], []
    for i, (key, metrics) in enumerate(per_column.items()):
        fields = [F.lit(key).alias("column")]
        for j, (m, expr) in enumerate(metrics.items()):
            alias = f"_a{i}_{j}"
            aggs.append(expr.alias(alias))
            fields.append(F.col(alias).alias(m))
        structs.append(F.struct(*fields))
    extras = [e.alias(f"_x_{k}") for k, e in extra.items()]
    row = df.agg(*aggs, *extras)
    out = row.select(F.explode(F.array(*structs)).alias("_s"),
                     *[F.col(f"_x_{k}").alias(k) for k in extra])
    return out.select("_s.*", *extra.keys())
