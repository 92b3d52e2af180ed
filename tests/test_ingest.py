"""Fixtures of the FIXTURES.md shapes, generated here (the reference is not read)."""
import gzip
import os
import tempfile

from pyspark.sql import functions as F

from tabprep.sources import files as FS


def _edge_cases_csv() -> str:
    rows = ["id,mixed_types,with_units,missing_various,whitespace,high_cardinality,constant,target"]
    units = ["10kg", "20kg", "5ft", "15kg", "30kg"]
    missing = ["", "N/A", "???", "--", "null", "missing", "Unknown"]
    pads = ["value", " value", "value ", "  value", "value  "]
    for i in range(50):
        mv = "5" if i == 48 else ("10" if i == 49 else missing[i % len(missing)])
        rows.append(f"{i + 1}.0,{i},{units[i % 5]},{mv},{pads[i % 5]},cat_{i},same,{1.0 if i % 3 else 0.0}")
    rows += rows[1:4]  # three duplicate rows
    rows.append(",,,,,,,")  # an empty row
    return "\n".join(rows) + "\n"


def test_clean_names():
    assert FS.clean_column_name("﻿  a​  b ") == "a b"
    assert FS.clean_column_name(" ") == "column"
    assert FS.dedupe_names(["a", "a", "a_1", "a"]) == ["a", "a_1", "a_1_1", "a_2"]


def test_ingest_edge_cases(spark):
    d = tempfile.mkdtemp(prefix="tabprep-ingest-")
    with open(os.path.join(d, "edge.csv"), "w", encoding="utf-8") as f:
        f.write(_edge_cases_csv())
    df, findings = FS.ingest(spark, d)
    assert df is not None
    assert df.count() == 53  # 54 data rows, the empty one dropped
    types = dict(df.dtypes)
    assert types["id"] == "double" and types["mixed_types"] == "bigint"
    assert types["missing_various"] == "bigint" or types["missing_various"] == "double"
    miss = df.agg(F.count_if(F.col("missing_various").isNull())).first()[0]
    assert miss == 51
    assert df.select("whitespace").distinct().count() == 5
    assert df.dropDuplicates().count() == 50
    steps = {r["step"] for r in findings.collect()}
    assert {"encoding", "delimiter", "cleanup"} <= steps


def test_ingest_semicolon_gzip_and_gate(spark):
    d = tempfile.mkdtemp(prefix="tabprep-gz-")
    text = "a;b;c\n" + "".join(f"{i};x{i};{i * 0.5}\n" for i in range(30))
    with gzip.open(os.path.join(d, "t.csv.gz"), "wt", encoding="utf-8") as f:
        f.write(text)
    assert FS.detect_delimiter(spark, d) == ";"
    small = tempfile.mkdtemp(prefix="tabprep-small-")
    with open(os.path.join(small, "s.csv"), "w") as f:
        f.write("a,b\n" + "".join(f"{i},{i}\n" for i in range(9)))
    df, findings = FS.ingest(spark, small)
    assert df is None and any(r["step"] == "gate" for r in findings.collect())


def test_sniff_rejects_html_and_empty(spark):
    d = tempfile.mkdtemp(prefix="tabprep-sniff-")
    with open(os.path.join(d, "page.csv"), "w") as f:
        f.write("<!DOCTYPE html><html><body>x</body></html>")
    open(os.path.join(d, "empty.csv"), "w").close()
    census = {os.path.basename(r["path"]): r["verdict"] for r in FS.file_census(spark, d).collect()}
    assert census["empty.csv"] == "reject_empty"
    sn = {os.path.basename(r["path"]): r["is_html"] for r in FS.sniff_files(spark, d).collect()}
    assert sn["page.csv"] is True
    df, _ = FS.ingest(spark, d)
    assert df is None


def test_long_rows_dropped_short_padded(spark):
    d = tempfile.mkdtemp(prefix="tabprep-ragged-")
    lines = ["a,b,c"] + [f"{i},{i},{i}" for i in range(20)] + ["1,2", "1,2,3,4"]
    with open(os.path.join(d, "r.csv"), "w") as f:
        f.write("\n".join(lines) + "\n")
    df = FS.safe_read(spark, d, "utf-8", ",", ["a", "b", "c"])
    # the header line is still data here (removed later as a repeated header)
    assert df.count() == 22
    assert df.where(F.col("c").isNull()).count() == 1
    assert df.where(F.col("a") == "1").where(F.col("c") == "3").count() == 0  # the long row is gone
