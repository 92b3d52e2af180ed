"""Oracle SQL (DuckDB dialect) for every catalogue entry that SQL can express.

Written independently of the Spark operators: plain aggregates, windows and
CTEs over the same derived tables (``inputs.with_clause``). Column names and
rounding match the Spark side.
"""

from __future__ import annotations

from tabprep.plans import file_queries
from tabprep.plans.inputs import with_clause

ORACLE: dict[str, str] = {}

DL_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "l_rebate", "l_gross"]
DL_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_rebate", "l_gross"]
DL_ALL_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"] + DL_NUMERIC
CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CUSTOMER_STRINGS = ["c_name", "c_mktsegment"]
EVENT_NUMERIC = ["event_id", "user_id", "value"]


def sql(name: str, text: str) -> None:
    ORACLE[name] = text.strip()


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def missing_sql(cols: list[str], frm: str) -> str:
    return union([
        f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_missing, "
        f"round(CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) * 100 / count(*), 2) AS pct_missing FROM {frm}"
        for c in cols])


def cardinality_sql(cols: list[str], frm: str) -> str:
    return union([
        f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, "
        f"CAST(count(DISTINCT {c}) AS DOUBLE) / count(*) AS ratio_raw FROM {frm}" for c in cols])


def missing_flags_sql(cols: list[str], frm: str) -> str:
    return f"""m AS ({missing_sql(cols, frm)})
SELECT "column", pct_missing, CASE WHEN pct_missing > 95 THEN 'critical' ELSE 'warning' END AS severity
FROM m WHERE pct_missing > 95 OR (pct_missing > 50 AND (SELECT max(pct_missing) FROM m) <= 95)"""


def sparse_sql(cols: list[str], frm: str) -> str:
    s = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in cols)
    return f"SELECT CAST(count(*) FILTER (WHERE CAST({s} AS DOUBLE) / {len(cols)} > 0.5) AS BIGINT) AS n_sparse_rows FROM {frm}"


def low_variance_sql(cols: list[str], frm: str) -> str:
    return f"""c AS ({cardinality_sql(cols, frm)})
SELECT "column", n_distinct,
       CASE WHEN n_distinct = 1 THEN 'constant' ELSE 'low_variance' END AS kind
FROM c WHERE n_distinct = 1 OR (ratio_raw < 0.01 AND n_distinct < 5)"""


def corr_pairs_sql(cols: list[str], frm: str, digits: int = 6) -> str:
    parts = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            parts.append(f"SELECT '{cols[i]}' AS feature1, '{cols[j]}' AS feature2, "
                         f"round(corr({cols[i]}, {cols[j]}), {digits}) AS r FROM {frm}")
    return union(parts)


def stats_sql(cols: list[str], frm: str) -> str:
    return union([
        f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS n, avg({c}) AS mean, "
        f"stddev_pop({c}) AS sdp, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min, "
        f"CAST(max({c}) AS DOUBLE) AS max, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, "
        f"quantile_cont({c}, 0.75) AS q3 FROM {frm}" for c in cols])


def outlier_ctes(cols: list[str], frm: str, k: float = 3.0, z: float = 5.0) -> str:
    """CTEs s, o, t; t = (column, n, z_outliers, iqr_outliers, min, max, mean, std, q1, q3)
    for columns with at least 3 values."""
    counts = union([
        f"SELECT '{c}' AS \"column\", "
        f"(SELECT count(*) FROM {frm}, s WHERE s.\"column\" = '{c}' AND s.sdp > 0 AND abs({c} - s.mean) / s.sdp > {z}) AS zc, "
        f"(SELECT count(*) FROM {frm}, s WHERE s.\"column\" = '{c}' AND ({c} < s.q1 - {k} * (s.q3 - s.q1) OR {c} > s.q3 + {k} * (s.q3 - s.q1))) AS ic"
        for c in cols])
    return f"""s AS ({stats_sql(cols, frm)}),
o AS ({counts}),
t AS (SELECT s."column", s.n, CAST(o.zc AS BIGINT) AS z_outliers, CAST(o.ic AS BIGINT) AS iqr_outliers,
       s.min, s.max, s.mean, s.std, s.q1, s.q3
FROM s JOIN o ON s."column" = o."column" WHERE s.n >= 3)
"""


def ctes(*names: str) -> str:
    """WITH clause for derived tables, ready for more CTEs to be appended after a comma."""
    w = with_clause(*names)
    return w + "," if w else "WITH "


# ---------------------------------------------------------------- profiling

sql("p02_basic", with_clause("dl") + f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST({len(DL_COLS)} AS BIGINT) AS n_cols FROM dl")
sql("p03_missing", with_clause("dl") + missing_sql(DL_COLS, "dl"))
sql("p04_missing_flags", ctes("dl") + missing_flags_sql(DL_COLS, "dl"))
sql("p05_sparse_rows", with_clause("dl") + sparse_sql(DL_COLS, "dl"))
sql("p08_cardinality", f"""WITH c AS ({cardinality_sql(CUSTOMER_COLS, "customer")})
SELECT "column", n_distinct, round(ratio_raw, 4) AS ratio FROM c""")
sql("p09_id_columns", f"""WITH c AS ({cardinality_sql(CUSTOMER_COLS, "customer")})
SELECT "column", n_distinct, round(ratio_raw, 4) AS ratio FROM c WHERE ratio_raw > 0.95 AND n_distinct > 100""")
sql("p10_high_cardinality", f"""WITH c AS ({cardinality_sql(CUSTOMER_STRINGS, "customer")})
SELECT "column", n_distinct FROM c WHERE n_distinct > 50""")
sql("p11_low_variance", ctes("dl") + low_variance_sql(DL_COLS, "dl"))
sql("p12_duplicates", with_clause("dl_dup") + """
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dl_dup)) AS BIGINT) AS n_duplicates,
       round(CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dl_dup)) AS DOUBLE) / count(*), 4) AS duplicate_ratio
FROM dl_dup""")
sql("p13_zscore_outliers", "WITH " + outlier_ctes(EVENT_NUMERIC, "events") + 'SELECT "column", n, z_outliers FROM t')
sql("p14_iqr_outliers", "WITH " + outlier_ctes(EVENT_NUMERIC, "events")
    + 'SELECT "column", iqr_outliers, round(q1, 6) AS q1, round(q3, 6) AS q3 FROM t')
sql("p15_numeric_stats", f"""WITH s AS ({stats_sql(EVENT_NUMERIC, "events")})
SELECT "column", round(min, 6) AS min, round(max, 6) AS max, round(mean, 6) AS mean, round(std, 6) AS std FROM s WHERE n >= 3""")
sql("p16_outlier_rules", ctes("cust_x") + outlier_ctes(["c_acctbal", "age", "c_bonus"], "cust_x") + """
SELECT "column", 'age_range' AS rule, round(max, 6) AS measured FROM t WHERE lower("column") = 'age' AND (min < 0 OR max > 150)
UNION ALL
SELECT "column", 'many_outliers' AS rule, round(CAST(iqr_outliers AS DOUBLE) / n, 6) AS measured FROM t WHERE iqr_outliers > n * 0.1""")
sql("p17_numeric_summary", ctes("dl") + f"""s AS ({stats_sql(DL_NUMERIC, "dl")})
SELECT "column", n AS count, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min,
       round(q1, 6) AS q25, round(q2, 6) AS q50, round(q3, 6) AS q75, round(max, 6) AS max FROM s""")


def top_sql(cols: list[str], frm: str) -> str:
    return union([
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n, "
        f"row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR) ASC) AS rank "
        f"FROM {frm} WHERE {c} IS NOT NULL GROUP BY {c}" for c in cols])


sql("p18_string_summary", f"""WITH t AS ({top_sql(["event_type", "props"], "events")})
SELECT "column", CAST(count(*) AS BIGINT) AS n_unique, max(value) FILTER (WHERE rank = 1) AS mode FROM t GROUP BY "column" """)
sql("p18_top_values", f"""WITH t AS ({top_sql(["event_type", "props"], "events")})
SELECT "column", value, n, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 10""")
sql("p19_correlation", with_clause("dl") + corr_pairs_sql(DL_NUMERIC, "dl"))
sql("p20_high_correlation", ctes("dl") + f"""c AS ({corr_pairs_sql(DL_ALL_NUMERIC, "dl", 12)})
SELECT feature1, feature2, round(r, 3) AS r FROM c WHERE abs(r) > 0.9""")
sql("p21_target_profile", with_clause("dl") + """
SELECT 'l_returnflag' AS target, CAST(count(*) FILTER (WHERE l_returnflag IS NULL) AS BIGINT) AS n_missing,
       CAST(count(DISTINCT l_returnflag) AS BIGINT) AS n_unique, 'classification' AS task_type FROM dl""")
sql("p22_task_type", """
SELECT 'p_retailprice' AS target, CAST(count(*) FILTER (WHERE p_retailprice IS NULL) AS BIGINT) AS n_missing,
       CAST(count(DISTINCT p_retailprice) AS BIGINT) AS n_unique,
       CASE WHEN count(DISTINCT p_retailprice) > 20 THEN 'regression' ELSE 'classification' END AS task_type FROM part""")
sql("p23_class_distribution", """
SELECT CAST(quality AS VARCHAR) AS class, CAST(count(*) AS BIGINT) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality""")
sql("p24_class_balance", """
WITH d AS (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality)
SELECT CAST(count(*) AS BIGINT) AS n_classes, CAST(max(n) AS BIGINT) AS max_n, CAST(min(n) AS BIGINT) AS min_n,
       round(CAST(max(n) AS DOUBLE) / min(n), 4) AS ratio,
       count(*) < 2 OR CAST(max(n) AS DOUBLE) / min(n) < 3 AS is_balanced, min(n) < 2 AS min_class_critical FROM d""")
sql("p26_regression_target", """
SELECT round(min(p_retailprice), 6) AS min, round(max(p_retailprice), 6) AS max, round(avg(p_retailprice), 6) AS mean,
       round(stddev_samp(p_retailprice), 6) AS std, round(skewness(p_retailprice), 6) AS skewness FROM part""")
sql("p27_leakage", ctes("cust_x") + """
r AS (
  SELECT 'c_custkey' AS "column", corr(c_custkey, c_acctbal) AS r FROM cust_x
  UNION ALL SELECT 'c_nationkey', corr(c_nationkey, c_acctbal) FROM cust_x
  UNION ALL SELECT 'age', corr(age, c_acctbal) FROM cust_x
  UNION ALL SELECT 'c_bonus', corr(c_bonus, c_acctbal) FROM cust_x
  UNION ALL SELECT 'c_bal2', corr(c_bal2, c_acctbal) FROM cust_x),
i AS (
  SELECT 'c_custkey' AS "column", CAST(count(DISTINCT c_custkey) AS DOUBLE) / count(*) AS ratio FROM cust_x
  UNION ALL SELECT 'c_nationkey', CAST(count(DISTINCT c_nationkey) AS DOUBLE) / count(*) FROM cust_x)
SELECT "column", 'target_correlation' AS reason, 'high' AS severity, round(r, 3) AS measured FROM r WHERE abs(r) > 0.99
UNION ALL
SELECT "column", 'id_like' AS reason, 'medium' AS severity, round(ratio, 4) AS measured FROM i WHERE ratio > 0.95""")


# ---------------------------------------------------------------- post-read cleanup, repair

from tabprep.config import DEFAULT_SETTINGS  # noqa: E402

RAW_COLS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_weight", "l_discount", "l_returned",
            "l_open", "l_returnflag", "l_shipdate", "l_pad", "l_empty"]
NUM_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INT_RE = r"^[+-]?\d+$"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TOKENS = "(" + ", ".join(lit(t) for t in DEFAULT_SETTINGS.missing_tokens) + ")"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def na(c: str) -> str:
    return f"CASE WHEN {c} IN {TOKENS} THEN NULL ELSE {c} END"


HEADER_FREE = "NOT (" + " AND ".join(f"coalesce(lower(trim({c})) = {lit(c)}, false)" for c in RAW_COLS) + ")"
NA_SELECT = ", ".join(f"{na(c)} AS {c}" for c in RAW_COLS)
NOT_EMPTY = "NOT (" + " AND ".join(f"{c} IS NULL" for c in RAW_COLS) + ")"
CLEAN_CTES = ctes("raw_li_hdr") + f"""h AS (SELECT * FROM raw_li_hdr WHERE {HEADER_FREE}),
nt AS (SELECT {NA_SELECT} FROM h),
ne AS (SELECT * FROM nt WHERE {NOT_EMPTY}),
census AS ({union([
    f"SELECT '{c}' AS \"column\", count({c}) AS nn, count(*) FILTER (WHERE regexp_matches({strip(c)}, '{INT_RE}')) AS n_int, "
    f"count(*) FILTER (WHERE regexp_matches({strip(c)}, '{NUM_RE}')) AS n_num, "
    f"count(*) FILTER (WHERE lower({strip(c)}) IN ('true', 'false')) AS n_bool, count(*) AS n FROM ne" for c in RAW_COLS])}),
decisions AS (
  SELECT "column", CASE WHEN nn = 0 THEN 'drop_empty_column' ELSE 'type' END AS action,
         CASE WHEN nn = 0 THEN NULL
              WHEN n_int = nn THEN CASE WHEN nn = n THEN 'bigint' ELSE 'double' END
              WHEN n_num = nn THEN 'double'
              WHEN n_bool = nn AND nn = n THEN 'boolean'
              ELSE 'string' END AS detail
  FROM census)
"""

# Types the inference assigns to the raw table (checked by s08_type_inference).
CLEAN_TYPES = {"l_orderkey": "BIGINT", "l_quantity": "DOUBLE", "l_extendedprice": None, "l_weight": None,
               "l_discount": "DOUBLE", "l_returned": None, "l_open": None, "l_returnflag": None,
               "l_shipdate": None, "l_pad": None}
TYPED_SELECT = ", ".join(
    (f"TRY_CAST({strip(c)} AS {t}) AS {c}" if t else c) for c, t in CLEAN_TYPES.items())

sql("s07_na_tokens", ctes("raw_li") + f"nt AS (SELECT {NA_SELECT} FROM raw_li)\n" + missing_sql(RAW_COLS, "nt"))
sql("s14_repeated_headers", with_clause("raw_li_hdr") + f"""
SELECT CAST(count(*) FILTER (WHERE {HEADER_FREE}) AS BIGINT) AS n_rows,
       CAST(count(*) FILTER (WHERE NOT ({HEADER_FREE})) AS BIGINT) AS n_header_rows FROM raw_li_hdr""")
sql("s11_drop_empty_rows", CLEAN_CTES + "SELECT CAST(count(*) AS BIGINT) AS n_rows FROM ne")
sql("s08_type_inference", CLEAN_CTES + "SELECT * FROM decisions")
sql("s16_ingest_cleanup", CLEAN_CTES + f"SELECT {TYPED_SELECT} FROM ne")

DT_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d-%m-%Y", "%d.%m.%Y"]
DT_LIST = "[" + ", ".join(lit(f) for f in DT_FORMATS) + "]"
BOOL_INFER = "('true', 'false', '1', '0', 'yes', 'no', 't', 'f', 'y', 'n')"
sql("p06_semantic_types", ctes("raw_li") + f"""nt AS (SELECT {NA_SELECT} FROM raw_li),
c AS ({union([
    f"SELECT '{c}' AS \"column\", count({c}) AS nn, count(*) FILTER (WHERE regexp_matches({strip(c)}, '{NUM_RE}')) AS n_num, "
    f"count(*) FILTER (WHERE try_strptime({strip(c)}, {DT_LIST}) IS NOT NULL) AS n_dt, "
    f"count(*) FILTER (WHERE lower({strip(c)}) IN {BOOL_INFER}) AS n_bool, count(DISTINCT {c}) AS nu FROM nt" for c in RAW_COLS])})
SELECT "column", 'string' AS dtype, 'categorical' AS dtype_group,
       CASE WHEN nn = 0 THEN 'empty' WHEN n_num = nn THEN 'numeric'
            WHEN CAST(n_num AS DOUBLE) / nn > 0.8 THEN 'numeric_with_noise'
            WHEN n_dt = nn THEN 'datetime' WHEN n_bool = nn THEN 'boolean' ELSE 'categorical' END AS inferred_type,
       CAST(nu AS BIGINT) AS n_unique FROM c""")

STRING_CLEAN = [c for c, t in CLEAN_TYPES.items() if t is None]


def looks_numeric_sql(c: str) -> str:
    return f"regexp_matches(regexp_replace({c}, '[,$%€£¥\\s]', '', 'g'), '{NUM_RE}')"


def clean_numeric_sql(c: str) -> str:
    v = strip(c)
    v = f"regexp_replace({v}, '[,$%€£¥]', '', 'g')"
    v = f"regexp_replace({v}, '[a-zA-Z]+$', '', 'g')"
    v = f"replace({v}, ' ', '')"
    return f"CASE WHEN regexp_matches({v}, '{NUM_RE}') THEN TRY_CAST({v} AS DOUBLE) END"


BOOL_REPAIR = "('true', '1', 'yes', 't', 'y', 'on', 'false', '0', 'no', 'f', 'n', 'off')"


def repair_sql(units_ok: bool) -> str:
    parts = []
    for c in STRING_CLEAN:
        gate = f"regexp_replace({c}, '[a-zA-Z]+\\s*$', '', 'g')" if units_ok else c
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS nn, "
            f"count(*) FILTER (WHERE {c} IS NOT NULL AND {looks_numeric_sql(gate)}) AS n_look, "
            f"count(*) FILTER (WHERE ({clean_numeric_sql(c)}) IS NOT NULL) AS n_conv, "
            f"count(*) FILTER (WHERE {c} IS NOT NULL AND lower({strip(c)}) NOT IN {BOOL_REPAIR}) AS n_nonbool FROM typed")
    return CLEAN_CTES + f""", typed AS (SELECT {TYPED_SELECT} FROM ne),
r AS ({union(parts)})
SELECT "column", CAST(nn AS BIGINT) AS nn, round(CAST(n_look AS DOUBLE) / nn, 4) AS share_looks_numeric,
       round(CAST(n_conv AS DOUBLE) / nn, 4) AS share_converted,
       CASE WHEN nn = 0 THEN 'unchanged'
            WHEN CAST(n_look AS DOUBLE) / nn >= 0.7 AND CAST(n_conv AS DOUBLE) / nn > 0.8 THEN 'numeric'
            WHEN n_nonbool = 0 THEN 'boolean' ELSE 'unchanged' END AS kind
FROM r"""


sql("v06_repair_decisions", repair_sql(False))
sql("v06_repair_units_ok", repair_sql(True))


def to_bool_sql(c: str) -> str:
    v = f"lower({strip(c)})"
    return (f"CASE WHEN {v} IN ('true', '1', 'yes', 't', 'y', 'on') THEN 1 "
            f"WHEN {v} IN ('false', '0', 'no', 'f', 'n', 'off') THEN 0 END")


# Decisions taken by v06_repair_decisions on this table.
REPAIRED = {"l_extendedprice": clean_numeric_sql("l_extendedprice"), "l_weight": clean_numeric_sql("l_weight"),
            "l_returned": to_bool_sql("l_returned"), "l_open": to_bool_sql("l_open")}
sql("v03_repaired_table", CLEAN_CTES + f""", typed AS (SELECT {TYPED_SELECT} FROM ne)
SELECT {", ".join((REPAIRED[c] + " AS " + c) if c in REPAIRED else c for c in CLEAN_TYPES)} FROM typed""")


# ---------------------------------------------------------------- all findings

DL_STRINGS = ["l_returnflag", "l_linestatus"]
sql("p29_findings", ctes("dl") + missing_flags_sql(DL_COLS, "dl").replace(
    "\nSELECT \"column\", pct_missing,", ",\nmf AS (SELECT \"column\", pct_missing,", 1) + ")," + f"""
card AS ({cardinality_sql(DL_COLS, "dl")}),
""" + outlier_ctes(DL_ALL_NUMERIC, "dl") + f""",
corrs AS ({corr_pairs_sql(DL_ALL_NUMERIC, "dl", 12)}),
cls AS (SELECT l_returnflag, count(*) AS n FROM dl WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag),
bal AS (SELECT count(*) AS k, max(n) AS mx, min(n) AS mn FROM cls)
SELECT 'missing' AS rule, "column", severity, pct_missing AS measured FROM mf
UNION ALL
SELECT 'sparse_rows', NULL, 'warning', CAST(n_sparse_rows AS DOUBLE) FROM ({sparse_sql(DL_COLS, "dl")}) WHERE n_sparse_rows > 0
UNION ALL
SELECT 'id_column', "column", 'warning', round(ratio_raw, 4) FROM card WHERE ratio_raw > 0.95 AND n_distinct > 100
UNION ALL
SELECT 'high_cardinality', "column", 'info', CAST(n_distinct AS DOUBLE) FROM card
  WHERE "column" IN ({", ".join(lit(c) for c in DL_STRINGS)}) AND n_distinct > 50
UNION ALL
SELECT CASE WHEN n_distinct = 1 THEN 'constant' ELSE 'low_variance' END, "column",
       CASE WHEN n_distinct = 1 THEN 'warning' ELSE 'info' END, CAST(n_distinct AS DOUBLE)
  FROM card WHERE n_distinct = 1 OR (ratio_raw < 0.01 AND n_distinct < 5)
UNION ALL
SELECT 'duplicates', NULL, 'warning', CAST(d AS DOUBLE) FROM
  (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dl)) AS d FROM dl) WHERE d > 0
UNION ALL
SELECT 'age_range', "column", 'warning', round(max, 6) FROM t WHERE lower("column") = 'age' AND (min < 0 OR max > 150)
UNION ALL
SELECT 'many_outliers', "column", 'warning', round(CAST(iqr_outliers AS DOUBLE) / n, 6) FROM t WHERE iqr_outliers > n * 0.1
UNION ALL
SELECT 'high_correlation', feature1 || ' ~ ' || feature2, 'warning', round(r, 3) FROM corrs WHERE abs(r) > 0.9
UNION ALL
SELECT 'target_missing', 'l_returnflag', 'critical', CAST(count(*) AS DOUBLE) FROM dl WHERE l_returnflag IS NULL HAVING count(*) > 0
UNION ALL
SELECT 'imbalanced', 'l_returnflag', 'warning', round(CAST(mx AS DOUBLE) / mn, 4) FROM bal WHERE NOT (k < 2 OR CAST(mx AS DOUBLE) / mn < 3)
UNION ALL
SELECT 'tiny_class', 'l_returnflag', 'critical', CAST(mn AS DOUBLE) FROM bal WHERE mn < 2
UNION ALL
SELECT 'leakage_id_like', "column", 'info', round(ratio_raw, 4) FROM card
  WHERE "column" IN ('l_orderkey', 'l_partkey', 'l_suppkey') AND ratio_raw > 0.95""")


# ---------------------------------------------------------------- EDA

DOC_NUMERIC = ["doc_id", "n_chars"]
PART_NUMERIC = ["p_partkey", "p_size", "p_retailprice"]


def iqr_counts_sql(cols: list[str], frm: str, k: float) -> str:
    return union([
        f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} < q1 - {k} * (q3 - q1) OR {c} > q3 + {k} * (q3 - q1)) AS BIGINT) AS n_outliers, "
        f"round(CAST(count(*) FILTER (WHERE {c} < q1 - {k} * (q3 - q1) OR {c} > q3 + {k} * (q3 - q1)) AS DOUBLE) * 100 / count(*), 2) AS pct "
        f"FROM {frm}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {frm}) AS q" for c in cols])


sql("e01_feasibility", "SELECT 'dataset_too_small' AS issue, 'High' AS severity, CAST(count(*) AS DOUBLE) AS measured FROM benchmark HAVING count(*) < 50")
sql("e02_dimensionality", "SELECT 'high_dimensionality' AS issue, 'High' AS severity, CAST(2 AS DOUBLE) AS measured FROM benchmark HAVING 2 > count(*)")
sql("e03_outliers_iqr15", iqr_counts_sql(EVENT_NUMERIC, "events", 1.5))
sql("e03_outlier_issue", f"""SELECT 'outliers' AS issue, 'Medium' AS severity, CAST(sum(n_outliers) AS DOUBLE) AS measured
FROM ({iqr_counts_sql(DOC_NUMERIC, "documents", 1.5)}) HAVING sum(n_outliers) > 0""")
sql("e04_imbalance", """SELECT 'class_imbalance' AS issue, 'Medium' AS severity, round(CAST(max(n) AS DOUBLE) / min(n), 1) AS measured
FROM (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality) HAVING CAST(max(n) AS DOUBLE) / min(n) > 3""")
sql("e05_missing_table", ctes("dl") + f"m AS ({missing_sql(DL_COLS, 'dl')})\nSELECT * FROM m WHERE n_missing > 0")
sql("e06_histogram", union([f"""SELECT '{c}' AS "column", bin, round(mn + bin * ((mx - mn) / 30), 6) AS lo,
       round(mn + (bin + 1) * ((mx - mn) / 30), 6) AS hi, CAST(count(*) AS BIGINT) AS n
FROM (SELECT CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((CAST({c} AS DOUBLE) - mn) * 30 / (mx - mn)), 29) END AS INTEGER) AS bin, mn, mx
      FROM events, (SELECT CAST(min({c}) AS DOUBLE) AS mn, CAST(max({c}) AS DOUBLE) AS mx FROM events) AS b WHERE {c} IS NOT NULL)
GROUP BY bin, mn, mx""" for c in ["user_id", "value"]]))
sql("e07_top_values", f"""WITH t AS ({top_sql(["o_orderstatus", "o_orderpriority"], "orders")})
SELECT "column", value, n, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 10""")
sql("e08_missing_advice", ctes("dl") + f"m AS ({missing_sql(DL_COLS, 'dl')})\n"
    "SELECT \"column\", pct_missing, CASE WHEN pct_missing > 50 THEN 'drop_column' ELSE 'impute' END AS action FROM m WHERE n_missing > 0")
sql("e09_apply_decisions", with_clause("dl") + "SELECT * EXCLUDE (l_rebate) FROM dl WHERE l_tax IS NOT NULL")
sql("e10_input_ranges", union([f"SELECT '{c}' AS \"column\", round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, round(avg({c}), 6) AS mean FROM part" for c in PART_NUMERIC]))
sql("e10_category_domains", union([f"SELECT DISTINCT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM part WHERE {c} IS NOT NULL" for c in ["p_brand", "p_type"]]))

# ---------------------------------------------------------------- preparation and cleaning

sql("t01_drop_null_target", with_clause("dl") + "SELECT * FROM dl WHERE l_returnflag IS NOT NULL")
sql("t02_drop_duplicates", with_clause("dl_dup") + "SELECT DISTINCT * FROM dl_dup")
sql("t04_prepare_data", with_clause("cust_x") + """
SELECT DISTINCT c_name, c_nationkey, c_acctbal, age, c_bonus, c_bal2, c_mktsegment AS label FROM cust_x
WHERE c_mktsegment IS NOT NULL
  AND (SELECT CAST(count(DISTINCT c_custkey) AS DOUBLE) / count(*) FROM (SELECT DISTINCT * FROM cust_x WHERE c_mktsegment IS NOT NULL)) > 0.95""")


def mode_sql(c: str, frm: str) -> str:
    return f"(SELECT {c} FROM {frm} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) ASC LIMIT 1)"


def impute_sql(stat: str) -> str:
    num = {"l_quantity", "l_discount", "l_tax", "l_gross"}
    cols = []
    for c in DL_COLS:
        if c == "l_rebate":
            continue
        if c in num:
            fill = f"(SELECT {stat}({c}) FROM dl)" if stat == "avg" else f"(SELECT quantile_cont({c}, 0.5) FROM dl)"
            cols.append(f"round(coalesce({c}, {fill}), 6) AS {c}")
        elif c in ("l_returnflag", "l_linestatus", "l_shipdate"):
            cols.append(f"coalesce({c}, {mode_sql(c, 'dl')}) AS {c}")
        elif c == "l_extendedprice":
            cols.append(f"round({c}, 6) AS {c}")
        else:
            cols.append(c)
    return with_clause("dl") + f"SELECT {', '.join(cols)} FROM dl"


sql("t06_impute", impute_sql("median"))
sql("t07_impute_mean", impute_sql("avg"))
sql("t08_cap_iqr", """
SELECT event_id, round(CASE WHEN value IS NULL THEN NULL ELSE greatest(least(value, q3 + 3.0 * (q3 - q1)), q1 - 3.0 * (q3 - q1)) END, 6) AS value
FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) AS q""")
sql("t09_cap_zscore", """
SELECT doc_id, round(CASE WHEN n_chars IS NULL THEN NULL ELSE greatest(least(CAST(n_chars AS DOUBLE), m + 5.0 * s), m - 5.0 * s) END, 6) AS n_chars
FROM documents, (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS s FROM documents) AS q""")
sql("t10_drop_constants", with_clause("dl_c") + "SELECT * EXCLUDE (l_source, l_zero) FROM dl_c")
sql("t11_high_cardinality", """
SELECT * EXCLUDE (c_name) FROM customer
WHERE (SELECT count(DISTINCT c_name) > 50 AND CAST(count(DISTINCT c_name) AS DOUBLE) / count(*) >= 0.5 FROM customer)""")
T12_NUM = ["l_orderkey", "l_quantity", "l_discount", "l_empty"]
sql("t12_type_convert", ctes("raw_li") + f"nt AS (SELECT {NA_SELECT} FROM raw_li)\nSELECT " + ", ".join(
    (f"CASE WHEN regexp_matches({strip(c)}, '{NUM_RE}') THEN TRY_CAST({strip(c)} AS DOUBLE) END AS {c}" if c in T12_NUM
     else f"coalesce({c}, 'nan') AS {c}") for c in RAW_COLS) + " FROM nt")
sql("t13_rare_categories", """
WITH f AS (SELECT props, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY props),
r AS (SELECT props FROM f WHERE CAST(n AS DOUBLE) / (SELECT sum(n) FROM f) < 0.01)
SELECT event_id, event_type, CASE WHEN props IN (SELECT props FROM r) THEN 'Other' ELSE props END AS props FROM events""")

# ---------------------------------------------------------------- encoding and scaling

sql("t14_binary_encode", with_clause("dl") + """
SELECT l_orderkey, l_linenumber,
       CAST(CASE coalesce(l_linestatus, 'missing') WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'missing' THEN 2 ELSE 3 END AS BIGINT) AS l_linestatus
FROM dl""")


def onehot_sql(c: str, values: list[str]) -> str:
    return ", ".join(f"CAST(coalesce({c} = {lit(v)}, false) AS INTEGER) AS \"{c}_{v}\"" for v in values)


sql("t15_onehot_encode", "SELECT o_orderkey, " + onehot_sql("o_orderstatus", ["O", "P"]) + ", "
    + onehot_sql("o_orderpriority", ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]) + " FROM orders")


def ordinal_sql(c: str, frm: str) -> str:
    """Code = position in the sorted distinct values; unseen/null → vocabulary size."""
    return (f"CAST(coalesce((SELECT code FROM (SELECT {c} AS v, dense_rank() OVER (ORDER BY {c}) - 1 AS code "
            f"FROM (SELECT DISTINCT {c} FROM {frm} WHERE {c} IS NOT NULL)) AS d WHERE d.v = {frm}.{c}), "
            f"(SELECT count(DISTINCT {c}) FROM {frm})) AS BIGINT) AS {c}")


sql("t16_ordinal_encode", "SELECT c_custkey, " + ordinal_sql("c_name", "customer") + ", "
    + onehot_sql("c_mktsegment", ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]) + " FROM customer")
sql("t16_ordinal_small", "SELECT p_partkey, " + ordinal_sql("p_name", "part") + ", "
    + onehot_sql("p_type", ["LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]) + " FROM part")
sql("t17_ordinal_all", "SELECT o_orderkey, " + ordinal_sql("o_orderstatus", "orders") + ", "
    + ordinal_sql("o_orderpriority", "orders") + " FROM orders")

SCALE_COLS = ["l_quantity", "l_discount", "l_gross"]


def scale_sql(method: str) -> str:
    parts = []
    for c in SCALE_COLS:
        if method == "standard":
            e = f"({c} - (SELECT avg({c}) FROM dl)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM dl)"
        elif method == "minmax":
            e = f"({c} - (SELECT min({c}) FROM dl)) / (SELECT CASE WHEN max({c}) = min({c}) THEN 1 ELSE max({c}) - min({c}) END FROM dl)"
        else:
            e = (f"({c} - (SELECT quantile_cont({c}, 0.5) FROM dl)) / (SELECT CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) "
                 f"THEN 1 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END FROM dl)")
        parts.append(f"round({e}, 6) AS {c}")
    return with_clause("dl") + f"SELECT l_orderkey, l_linenumber, {', '.join(parts)} FROM dl"


sql("t18_scale_standard", scale_sql("standard"))
sql("t19_scale_minmax", scale_sql("minmax"))
sql("t20_scale_robust", scale_sql("robust"))
sql("t21_ratio_features", """
SELECT p_partkey, p_size, round(p_retailprice, 6) AS p_retailprice,
  round(p_partkey / CASE WHEN p_size = 0 THEN 1e-10 ELSE CAST(p_size AS DOUBLE) END, 6) AS p_partkey_div_p_size,
  round(p_partkey / CASE WHEN p_retailprice = 0 THEN 1e-10 ELSE p_retailprice END, 6) AS p_partkey_div_p_retailprice,
  round(p_size / CASE WHEN p_retailprice = 0 THEN 1e-10 ELSE p_retailprice END, 6) AS p_size_div_p_retailprice
FROM part""")
sql("t22_square_features", """
SELECT p_partkey, p_size, round(p_retailprice, 6) AS p_retailprice,
  round(CAST(p_partkey AS DOUBLE) * p_partkey, 6) AS p_partkey_squared,
  round(CAST(p_size AS DOUBLE) * p_size, 6) AS p_size_squared,
  round(p_retailprice * p_retailprice, 6) AS p_retailprice_squared
FROM part""")


def target_enc_sql(c: str) -> str:
    return (f"round(coalesce((SELECT (CAST(n AS DOUBLE) * mu + g) / (n + 1.0) FROM "
            f"(SELECT {c} AS v, count(*) AS n, avg(p_retailprice) AS mu FROM part WHERE {c} IS NOT NULL GROUP BY {c}) AS s "
            f"WHERE s.v = part.{c}), g), 6) AS {c}")


sql("t23_target_encode", "SELECT p_partkey, " + target_enc_sql("p_brand") + ", " + target_enc_sql("p_type")
    + ", round(p_retailprice, 6) AS p_retailprice FROM part, (SELECT avg(p_retailprice) AS g FROM part) AS gm")
sql("t24_label_encode", with_clause("dl") + """
SELECT l_orderkey, l_linenumber, l_returnflag,
       CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS DOUBLE) AS label_idx,
       l_returnflag AS label_back
FROM dl""")


# ---------------------------------------------------------------- split and folds

LI_KEY = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)"


def md5_of(key: str) -> str:
    return f"md5('42|' || {key})"


def bucket(h: str, start: int = 1, mod: int = 100) -> str:
    return f"(('0x' || substr({h}, {start}, 8))::BIGINT % {mod})"


IS_TEST_LI = f"{bucket(md5_of(LI_KEY))} < 20"

sql("m01_row_cap", f"SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY {md5_of(LI_KEY)} LIMIT 5000")
sql("m02_matrix_check", ctes("dl") + "x AS (" + union([
    f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_null, "
    f"CAST(count(*) FILTER (WHERE isnan({c})) AS BIGINT) AS n_nan, CAST(count(*) FILTER (WHERE isinf({c})) AS BIGINT) AS n_inf, "
    f"true AS is_numeric FROM dl" for c in DL_NUMERIC]) + """
UNION ALL SELECT 'l_returnflag', CAST(count(*) FILTER (WHERE l_returnflag IS NULL) AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false FROM dl)
SELECT * FROM x""")
sql("m03_split_hash", f"SELECT l_orderkey, l_linenumber, {IS_TEST_LI} AS is_test FROM lineitem")
sql("m03_split_exact", f"""
SELECT doc_id, (row_number() OVER (PARTITION BY quality ORDER BY {md5_of('CAST(doc_id AS VARCHAR)')}) - 1)
              < (count(*) OVER (PARTITION BY quality) * 20 + 99) // 100 AS is_test FROM labels""")
sql("m04_stratified_folds", f"""
SELECT doc_id, CAST((row_number() OVER (PARTITION BY quality ORDER BY {md5_of('CAST(doc_id AS VARCHAR)')}) - 1) % 3 AS INTEGER) AS fold
FROM labels""")
sql("m05_kfold_hash", f"SELECT l_orderkey, l_linenumber, CAST({bucket(md5_of(LI_KEY), 9, 3)} AS INTEGER) AS fold FROM lineitem")

# ---------------------------------------------------------------- evaluation

PRF = """
WITH lab AS (SELECT label AS class, count(*) AS support, count(*) FILTER (WHERE label = prediction) AS tp FROM {t} GROUP BY label),
prd AS (SELECT prediction AS class, count(*) AS predicted FROM {t} GROUP BY prediction),
c AS (SELECT coalesce(lab.class, prd.class) AS class, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
             coalesce(predicted, 0) AS predicted FROM lab FULL JOIN prd ON lab.class = prd.class),
m AS (SELECT support, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0 END AS p,
             CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS r FROM c)
SELECT round(sum(p * support) / sum(support), 4) AS precision, round(sum(r * support) / sum(support), 4) AS recall,
       round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * support) / sum(support), 4) AS f1 FROM m"""
SCORES = """s AS (SELECT CAST(score AS DOUBLE) AS score, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS pos,
             CAST(count(*) FILTER (WHERE label <> 1) AS DOUBLE) AS neg FROM scored GROUP BY score)"""

sql("x01_accuracy", with_clause("scored_mc") + "SELECT round(avg(CAST(label = prediction AS DOUBLE)), 4) AS accuracy FROM scored_mc")
sql("x02_weighted_prf", with_clause("scored_mc").rstrip("\n").replace("WITH ", "WITH ", 1) + PRF.replace("WITH lab", ", lab", 1).format(t="scored_mc")
    if with_clause("scored_mc") else PRF.format(t="scored_mc"))
sql("x03_roc_auc", ctes("scored") + SCORES + """,
c AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM s)
SELECT round(sum(pos * (cum_neg - neg + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc FROM c""")
sql("x04_regression_metrics", with_clause("scored_reg") + """
SELECT round(sqrt(avg((label - prediction) * (label - prediction))), 4) AS rmse, round(avg(abs(label - prediction)), 4) AS mae,
       round(1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(*)), 4) AS r2 FROM scored_reg""")
sql("x05_confusion_matrix", with_clause("scored_mc") + """
SELECT label, CAST(round(prediction) AS BIGINT) AS prediction, CAST(count(*) AS BIGINT) AS n FROM scored_mc GROUP BY label, round(prediction)""")
ROC = ctes("scored") + SCORES + """,
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
             sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM s),
pts AS (SELECT score AS threshold, cn / (SELECT sum(neg) FROM s) AS fpr, cp / (SELECT sum(pos) FROM s) AS tpr FROM c
        UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0)
"""
sql("x06_roc_curve", ROC + "SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM pts")
sql("x06_roc_area", ROC + """, l AS (SELECT fpr, tpr, lag(fpr) OVER (ORDER BY fpr, tpr) AS pf, lag(tpr) OVER (ORDER BY fpr, tpr) AS pt FROM pts)
SELECT round(sum((fpr - pf) * (tpr + pt) / 2), 6) AS area FROM l""")

# ---------------------------------------------------------------- learners with closed forms

LIN = f"""WITH tr AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE NOT ({IS_TEST_LI})),
te AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE {IS_TEST_LI}),
s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my FROM tr),
c AS (SELECT sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (y - my)) AS sxy FROM tr, s),
w AS (
  SELECT 'linear' AS model, 1 AS position, sxy / sxx AS w FROM c
  UNION ALL SELECT 'ridge', 2, sxy / (sxx + 1000.0) FROM c
  UNION ALL SELECT 'lasso', 3, sign(sxy) * greatest(abs(sxy) / n - 1000.0, 0) / (sxx / n) FROM c, s
  UNION ALL SELECT 'elastic_net', 4, sign(sxy) * greatest(abs(sxy) / n - 500.0, 0) / (sxx / n + 500.0) FROM c, s),
coef AS (SELECT model, position, my - w * mx AS intercept, w AS coef FROM w, s)
"""


def coef_sql(model: str) -> str:
    return LIN + f"SELECT model, round(intercept, 3) AS intercept, round(coef, 3) AS coef FROM coef WHERE model = '{model}'"


sql("l04_linear_regression", coef_sql("linear"))
sql("l05_ridge", coef_sql("ridge"))
sql("l06_lasso", coef_sql("lasso"))
sql("l07_elastic_net", coef_sql("elastic_net"))
LAB_TEST = f"{bucket(md5_of('CAST(doc_id AS VARCHAR)'))} < 20"
sql("l01_baseline_majority", f"""
WITH tr AS (SELECT quality FROM labels WHERE NOT ({LAB_TEST})),
m AS (SELECT quality AS v FROM tr WHERE quality IS NOT NULL GROUP BY quality ORDER BY count(*) DESC, quality ASC LIMIT 1)
SELECT CAST((SELECT v FROM m) AS INTEGER) AS majority, round(avg(CAST(quality = (SELECT v FROM m) AS DOUBLE)), 4) AS accuracy
FROM labels WHERE {LAB_TEST}""")
sql("l02_baseline_mean", LIN + """, b AS (SELECT my AS m FROM s)
SELECT round((SELECT m FROM b), 4) AS mean, round(sqrt(avg((y - (SELECT m FROM b)) * (y - (SELECT m FROM b)))), 4) AS rmse,
       round(avg(abs(y - (SELECT m FROM b))), 4) AS mae,
       round(1 - sum((y - (SELECT m FROM b)) * (y - (SELECT m FROM b))) / (var_pop(y) * count(*)), 4) AS r2 FROM te""")
EMB_TEST = f"{bucket(md5_of('CAST(vec_id AS VARCHAR)'))} < 20"
sql("l12_knn", f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, {EMB_TEST} AS is_test FROM embeddings),
d AS (SELECT q.vec_id AS q, t.vec_id AS t, t.label AS y, list_distance(q.v, t.v) AS dist
      FROM e q JOIN e t ON q.is_test AND NOT t.is_test),
k AS (SELECT q, y, row_number() OVER (PARTITION BY q ORDER BY dist, t) AS r FROM d),
v AS (SELECT q, y, count(*) AS c FROM k WHERE r <= 5 GROUP BY q, y)
SELECT q AS vec_id, CAST(y AS INTEGER) AS prediction
FROM (SELECT q, y, row_number() OVER (PARTITION BY q ORDER BY c DESC, y ASC) AS rr FROM v) WHERE rr = 1""")
EV_TEST = f"{bucket(md5_of('CAST(event_id AS VARCHAR)'))} < 20"
sql("l13_gaussian_nb", f"""
WITH ev AS (SELECT *, {EV_TEST} AS is_test FROM events),
tr AS (SELECT * FROM ev WHERE NOT is_test),
g AS (SELECT 1e-9 * greatest(var_pop(value), var_pop(user_id)) AS eps, count(*) AS n FROM tr),
c AS (SELECT event_type AS cls, count(*) AS nc, avg(value) AS m1, var_pop(value) AS v1, avg(user_id) AS m2,
             var_pop(user_id) AS v2 FROM tr GROUP BY event_type),
p AS (SELECT te.event_id, c.cls,
             ln(CAST(c.nc AS DOUBLE) / g.n) - 0.5 * ln(2 * pi() * (c.v1 + g.eps)) - (te.value - c.m1) ^ 2 / (2 * (c.v1 + g.eps))
             - 0.5 * ln(2 * pi() * (c.v2 + g.eps)) - (te.user_id - c.m2) ^ 2 / (2 * (c.v2 + g.eps)) AS ll
      FROM ev te, c, g WHERE te.is_test)
SELECT event_id, cls AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ll DESC, cls ASC) AS r FROM p)
WHERE r = 1""")

BOARD = LIN + """, b AS (SELECT my AS m FROM s),
pred AS (SELECT 'dummy' AS model, 0 AS position, y, (SELECT m FROM b) AS p FROM te
         UNION ALL SELECT coef.model, coef.position, te.y, coef.intercept + coef.coef * te.x FROM te, coef),
met AS (SELECT model, position, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae,
               round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) AS r2 FROM pred GROUP BY model, position)
"""
sql("m09_leaderboard", BOARD + "SELECT model, round(rmse, 2) AS test_rmse, round(mae, 2) AS test_mae, round(r2, 3) AS test_r2 FROM met")
sql("m10_best_model", BOARD + """, best AS (SELECT model, r2 FROM met WHERE model <> 'dummy' ORDER BY r2 DESC, position LIMIT 1),
base AS (SELECT r2 AS b FROM met WHERE model = 'dummy')
SELECT model, round(r2, 3) AS score,
       round(round(CASE WHEN b = 0 THEN 0 ELSE (r2 - b) / abs(b) * 100 END, 4), 1) AS improvement_pct FROM best, base""")


# ---------------------------------------------------------------- sources and sinks

sql("s02_content_sniff", """
SELECT page_id, (lower(html) LIKE '%<html%' OR lower(html) LIKE '%<!doctype%') AS is_html,
       starts_with(hex(encode(substr(html, 1, 8))), 'D0CF11E0A1B11AE1') AS is_ole2,
       starts_with(hex(encode(substr(html, 1, 8))), '504B0304') AS is_zip FROM pages""")
sql("s05_delimiter", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
nb AS (SELECT * FROM l WHERE trim(line) <> ''),
c AS (SELECT * FROM (VALUES (',', 0), (';', 1), ('|', 2), (chr(9), 3), ('^', 4), ('~', 5), (':', 6)) AS t(d, pos)),
k AS (SELECT doc_id, d, pos, length(line) - length(replace(line, d, '')) AS k FROM nb, c),
g AS (SELECT doc_id, d, pos, avg(k) AS a, stddev_pop(k) AS sd FROM k GROUP BY doc_id, d, pos HAVING avg(k) > 0),
s AS (SELECT doc_id, d, a * a / (sd + 1) AS score,
             row_number() OVER (PARTITION BY doc_id ORDER BY a * a / (sd + 1) DESC, pos ASC) AS r FROM g)
SELECT docs.doc_id, coalesce(s.d, ',') AS delimiter, round(s.score, 6) AS score
FROM (SELECT DISTINCT doc_id FROM documents) AS docs LEFT JOIN s ON docs.doc_id = s.doc_id AND s.r = 1""")
ORACLE["s16_ingest_csv"] = ORACLE["s16_ingest_cleanup"]
ORACLE.update(file_queries.ORACLE)
