"""Queries over files that Spark writes from lineitem into the shared folder: archives, encodings, records, headers."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.plans.inputs import table
from tabprep.session import ensure_checkpoint_dir
from tabprep.sources import files as FS

#: Column line of files with repeated, blank and untidy names, and of files with blank ones.
UNTIDY, BLANK = ' l_orderkey ,qty,qty,,"a ​ b"', "l_orderkey,,l_tax,"


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _with_header(header: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([header])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])
    return run


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One archive of a note and a table."""
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("README", "a note, no table\n")
        with z.open("lines.csv", "w") as f:
            f.write(b"l_orderkey,l_linenumber,l_returnflag\n")
            for batch in batches:
                f.write(b"".join(v.encode() + b"\n" for v in batch.column("value").to_pylist()))
    yield pa.RecordBatch.from_arrays([pa.array([blob.getvalue()], pa.binary())], names=["value"])


def s03_zip(spark: SparkSession, sf: str) -> DataFrame:
    """Eight archives, each read as a stream by one task."""
    path = _folder(spark)
    lines = table(spark, sf, "lineitem").select(F.concat_ws(",", "l_orderkey", "l_linenumber", "l_returnflag").alias("value"))
    lines.repartition(8).mapInArrow(_zipped, "value binary").select(F.col("value").cast("string")).write.text(path)
    df, _ = FS.read_files(spark, path)
    return df.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long"), "l_returnflag")


def s04_encoding(spark: SparkSession, sf: str) -> DataFrame:
    """Every encoding in a folder of its own, found file by file and read in one table."""
    path = _folder(spark)
    forms = {"ascii": ("plain ", "UTF-8", "utf-8"), "utf8": ("café ", "UTF-8", "utf-8"), "latin1": ("café ", "ISO-8859-1", "iso-8859-1"), "gzip": ("café ", "ISO-8859-1", "iso-8859-1"),
             "cp1252": ("caf\xe9 \x80", "ISO-8859-1", "cp1252"), "utf16le": ("café ", "UTF-16LE", "utf-16-le"), "utf16be": ("café ", "UTF-16BE", "utf-16-be")}
    rows = table(spark, sf, "lineitem")
    # the first row of a partition has the column line before it; a partition without rows has no file
    header = F.when(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0, F.lit("folder;l_orderkey;l_linenumber;word\n")).otherwise("")
    for name, (word, charset, _) in forms.items():
        line = F.concat_ws(";", F.lit(name), "l_orderkey", "l_linenumber", F.concat(F.lit(word), "l_returnflag"))
        out = rows.select(F.concat(header, line).alias("value"))
        writer = out.select(F.encode("value", charset).cast("string").alias("value")).write.option("lineSep", "\n").option("encoding", charset)
        (writer.option("compression", "gzip") if name == "gzip" else writer).text(f"{path}/{name}")
    told = FS.detect_encoding(spark, path).groupBy(F.regexp_extract("path", "/([^/]*)/[^/]*$", 1).alias("folder")).agg(F.min("encoding").alias("encoding"), F.max("encoding").alias("other"))
    df, _ = FS.read_files(spark, path)
    if df is None:  # no rows, no files
        df = spark.createDataFrame([], "folder string, l_orderkey string, word string")
    # words are counted first: Spark would sort all rows for the smallest of them
    words = df.groupBy("folder", "word").agg(F.count("*").alias("n"), F.sum(F.col("l_orderkey").cast("long")).alias("key"))
    found = words.groupBy("folder").agg(F.sum("n").alias("n_rows"), F.sum("key").alias("sum_key"), F.sum(F.col("n") * F.char_length("word")).alias("n_chars"), F.min("word").alias("first_word"))
    return found.join(told, "folder").select("folder", "encoding", "other", "n_rows", "sum_key", "n_chars", "first_word")


def _text(n: Column, flag: Column) -> Column:
    return (F.when(n == 2, F.concat(F.lit(',"a, '), flag, F.lit('"'))).when(n == 3, F.concat(F.lit(',"two\nlines ""'), flag, F.lit('"""'))).when(n == 4, F.lit(""))
            .when(n == 5, F.lit(",x,y")).when(n == 6, F.concat(F.lit(',5" '), flag)).otherwise(F.concat(F.lit(","), flag)))


def s06_safe_read(spark: SparkSession, sf: str) -> DataFrame:
    """Quoted delimiters and line breaks, short, long and stray-quote records."""
    path = _folder(spark)
    line = F.concat(F.concat_ws(",", "l_orderkey", "l_linenumber"), _text(F.col("l_linenumber"), F.col("l_returnflag")))
    table(spark, sf, "lineitem").select(line.alias("value")).write.text(path)
    df = FS.safe_read(spark, path, "utf-8", ",", ["l_orderkey", "l_linenumber", "note"])
    return df.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long"), "note")


def _sums(df: DataFrame) -> DataFrame:
    """(name, n, total) of every column of numbers."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("v")) for c in df.columns])).alias("x")).groupBy("x.name").agg(F.count("x.v").alias("n"), F.round(F.sum("x.v"), 2).alias("total"))


def s10_names(spark: SparkSession, sf: str) -> DataFrame:
    """A header with blanks around, repeated, blank, invisible and quoted names; every file has it twice."""
    path = _folder(spark)
    lines = table(spark, sf, "lineitem").select(F.concat_ws(",", "l_orderkey", "l_quantity", "l_discount", "l_linenumber", "l_tax").alias("value"))
    lines.mapInArrow(_with_header(UNTIDY), "value string").mapInArrow(_with_header(UNTIDY), "value string").write.text(path)
    return _sums(FS.read_files(spark, path)[0])


def s13_unnamed(spark: SparkSession, sf: str) -> DataFrame:
    """Of two columns without a name the one that is nearly empty goes."""
    path = _folder(spark)
    rare = F.when(F.col("l_orderkey") % 100 == 0, "1").otherwise("")
    lines = table(spark, sf, "lineitem").select(F.concat_ws(",", "l_orderkey", "l_linenumber", "l_tax", rare).alias("value"))
    lines.mapInArrow(_with_header(BLANK), "value string").write.text(path)
    return _sums(FS.ingest(spark, path)[0])


QUERIES = {f.__name__: f for f in (s03_zip, s04_encoding, s06_safe_read, s10_names, s13_unnamed)}

_FORMS = "(VALUES ('ascii', 'plain ', 'utf-8'), ('utf8', 'café ', 'utf-8'), ('latin1', 'café ', 'iso-8859-1'), ('gzip', 'café ', 'iso-8859-1'), ('cp1252', 'café €', 'cp1252'), ('utf16le', 'café ', 'utf-16-le'), ('utf16be', 'café ', 'utf-16-be')) AS f(folder, word, encoding)"


def _total(pairs: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(f"SELECT '{name}' AS name, count({c}) AS n, round(sum(CAST({c} AS DOUBLE)), 2) AS total FROM lineitem" for name, c in pairs.items())


ORACLE = {
    "s03_zip": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag FROM lineitem",
    "s04_encoding": f"SELECT folder, encoding, encoding AS other, count(*) AS n_rows, CAST(sum(l_orderkey) AS BIGINT) AS sum_key, CAST(sum(length(word || l_returnflag)) AS BIGINT) AS n_chars, min(word || l_returnflag) AS first_word FROM lineitem, {_FORMS} GROUP BY ALL",
    "s06_safe_read": """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CASE l_linenumber WHEN 2 THEN 'a, ' || l_returnflag WHEN 3 THEN 'two' || chr(10) || 'lines "' || l_returnflag || '"' WHEN 4 THEN NULL WHEN 6 THEN '5" ' || l_returnflag ELSE l_returnflag END AS note
FROM lineitem WHERE l_linenumber <> 5""",
    "s10_names": _total({"l_orderkey": "l_orderkey", "qty": "l_quantity", "qty_1": "l_discount", "Unnamed: 3": "l_linenumber", "a b": "l_tax"}),
    "s13_unnamed": _total({"l_orderkey": "l_orderkey", "Unnamed: 1": "l_linenumber", "l_tax": "l_tax"}),
}
