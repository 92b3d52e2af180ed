"""Inputs of the catalogue: the driver's tables and the dirty tables derived from them.

The driver's tables have no nulls and no duplicate rows, so every missing /
duplicate / NA-token case is derived deterministically from the data values.
Each derivation is one SQL text that Spark SQL and DuckDB both run unchanged,
so the Spark query and its oracle start from the same rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Dirty lineitem: line 7 loses most of its fields (a sparse row), returned
# line 5 loses its discount, l_rebate is present only for quantities ≥ 49
# (~96 % missing), l_gross tracks l_extendedprice (|r| ≈ 1).
DIRTY_LINEITEM = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS l_quantity,
       l_extendedprice,
       CASE WHEN l_linenumber = 7 OR (l_returnflag = 'R' AND l_linenumber = 5) THEN NULL
            ELSE l_discount END AS l_discount,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS l_tax,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END AS l_returnflag,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linestatus END AS l_linestatus,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_shipdate END AS l_shipdate,
       CASE WHEN l_quantity >= 49 THEN l_extendedprice * 0.5 END AS l_rebate,
       l_extendedprice * (1 + l_tax) AS l_gross
FROM lineitem
"""

# Dirty lineitem plus exact copies of every first line whose discount is 0.
DIRTY_LINEITEM_DUP = """
SELECT * FROM dl
UNION ALL
SELECT * FROM dl WHERE l_linenumber = 1 AND l_discount = 0
"""

# Lineitem as a delimited file would deliver it: every field a string, with NA
# tokens, currency symbols, units, padded yes/no words, on/off flags, blanks,
# one column that is never filled, and (line 7 of 'N' items) rows made only of
# NA tokens. Note 'N' itself is an NA token, so l_returnflag loses its N.
RAW_LINEITEM = """
SELECT
  CASE WHEN e THEN 'NA' ELSE CAST(l_orderkey AS STRING) END AS l_orderkey,
  CASE WHEN e THEN '' WHEN l_linenumber = 2 THEN 'N/A'
       WHEN l_linenumber = 3 AND l_returnflag = 'A' THEN '?'
       ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS l_quantity,
  CASE WHEN e THEN 'null' WHEN l_linenumber = 4 THEN concat('$', CAST(l_extendedprice AS STRING))
       ELSE CAST(l_extendedprice AS STRING) END AS l_extendedprice,
  CASE WHEN e THEN '--' WHEN l_linenumber = 5 THEN concat(CAST(CAST(l_quantity AS BIGINT) AS STRING), 'kg')
       ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS l_weight,
  CASE WHEN e THEN 'NaN' WHEN l_linenumber = 6 THEN 'missing' ELSE CAST(l_discount AS STRING) END AS l_discount,
  CASE WHEN e THEN '?' WHEN l_returnflag = 'R' THEN ' yes' WHEN l_returnflag = 'A' THEN 'No ' ELSE 'n' END AS l_returned,
  CASE WHEN e THEN 'None' WHEN l_linestatus = 'O' THEN 'on' ELSE 'off' END AS l_open,
  l_returnflag,
  CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS l_shipdate,
  CASE WHEN e THEN 'unknown' WHEN l_linenumber = 1 THEN '  ' ELSE 'x' END AS l_pad,
  CASE WHEN l_quantity > 50 THEN 'never' END AS l_empty
FROM (SELECT *, l_linenumber = 7 AND l_returnflag = 'N' AS e FROM lineitem) AS li
"""

# The raw table with the header line repeated inside the data (as files
# concatenated with their headers produce): one copy per order whose first
# line has quantity 1.
RAW_LINEITEM_HDR = """
SELECT * FROM raw_li
UNION ALL
SELECT 'l_orderkey', 'L_Quantity', 'l_extendedprice', 'l_weight', 'l_discount', 'l_returned',
       ' l_open', 'l_returnflag', 'l_shipdate', 'l_pad', 'l_empty'
FROM lineitem WHERE l_linenumber = 1 AND l_quantity = 1
"""

# Customer with an 'age' column (balance / 100, so some are negative), a bonus
# paid in four nations only (zero elsewhere, so IQR = 0) and a copy of the
# balance (perfect leakage when the balance is the target).
CUSTOMER_EXT = """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
       c_acctbal / 100 AS age,
       CASE WHEN c_nationkey < 4 THEN c_acctbal ELSE 0 END AS c_bonus,
       c_acctbal * 2 + 1 AS c_bal2
FROM customer
"""

# Dirty lineitem with a label for the source and a zero column (constant where set).
DIRTY_LINEITEM_CONST = """
SELECT *, 'lineitem' AS l_source, 0.0 * l_tax AS l_zero FROM dl
"""

# Deterministic scores and predictions derived from lineitem, for the metrics.
SCORED = """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
       l_discount * 5 + l_tax * 2 + CASE WHEN l_linestatus = 'O' THEN 0.1 ELSE 0 END AS score,
       CASE WHEN l_discount * 5 + l_tax * 2 + CASE WHEN l_linestatus = 'O' THEN 0.1 ELSE 0 END >= 0.4
            THEN 1 ELSE 0 END AS prediction
FROM lineitem
"""

SCORED_MULTICLASS = """
SELECT l_orderkey, l_linenumber,
       CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label,
       CASE WHEN l_discount < 0.03 THEN 0 WHEN l_discount < 0.07 THEN 1 ELSE 2 END AS prediction
FROM lineitem
"""

SCORED_REGRESSION = """
SELECT l_orderkey, l_linenumber, l_extendedprice AS label, l_quantity * 1500 AS prediction FROM lineitem
"""

# Document features with the quality label (classification learners).
DOC_FEATURES = """
SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars,
       CAST(length(d.text) - length(replace(d.text, '.', '')) AS DOUBLE) AS n_dots,
       CASE WHEN d.lang = 'en' THEN 1.0 ELSE 0.0 END AS is_en,
       CAST(l.quality AS DOUBLE) AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

DERIVED = {
    "dl": (DIRTY_LINEITEM, ("lineitem",)),
    "dl_dup": (DIRTY_LINEITEM_DUP, ("dl",)),
    "dl_c": (DIRTY_LINEITEM_CONST, ("dl",)),
    "cust_x": (CUSTOMER_EXT, ("customer",)),
    "raw_li": (RAW_LINEITEM, ("lineitem",)),
    "scored": (SCORED, ("lineitem",)),
    "scored_mc": (SCORED_MULTICLASS, ("lineitem",)),
    "scored_reg": (SCORED_REGRESSION, ("lineitem",)),
    "doc_feats": (DOC_FEATURES, ("documents", "labels")),
    "raw_li_hdr": (RAW_LINEITEM_HDR, ("raw_li", "lineitem")),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a derived one (registered as a temp view of the same name)."""
    if name in DERIVED:
        sql, deps = DERIVED[name]
        for d in deps:
            table(spark, sf_dir, d)
        df = spark.sql(sql)
    else:
        df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    df.createOrReplaceTempView(name)
    return df


def with_clause(*names: str) -> str:
    """DuckDB CTE text defining the derived tables ``names`` (and their dependencies)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in DERIVED and n not in order:
            for d in DERIVED[n][1]:
                visit(d)
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return ""
    return "WITH " + ",\n".join(f"{n} AS ({DERIVED[n][0]})" for n in order) + "\n"
