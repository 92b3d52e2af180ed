"""Encodings told and decoded by Spark's expressions against the ways that see every byte in Python."""
import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from tabprep.plans.file_queries import s04_encoding
from tabprep.sources import files as FS
from tabprep.sources import raw
from tabprep.sources import records as R

LATIN = "iso-8859-1"


def put(folder, name, data):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(gzip.compress(data) if name.endswith(".gz") else data)


def odd_files(seed):
    r = random.Random(seed)
    some = lambda codes, n: "\n".join("".join(chr(r.choice(codes)) for _ in range(r.randrange(9))) for _ in range(n))
    ascii_ = [*range(32, 127)]
    return {
        "ascii": some(ascii_, 30).encode(), "letters": some([*ascii_, *range(0xA0, 0x100)], 40).encode(LATIN), "letters.gz": some([*ascii_, *range(0xA0, 0x100)], 40).encode(LATIN),
        "windows": some([*ascii_, 0x80, 0x92, 0xE9, 0xD7, 0xF7], 40).encode(LATIN), "any": some([*range(10), *range(11, 256)], 80).encode(LATIN),
        "mixed": b"\xe9\n" * 3 + "é\n".encode() * 3 + b'"\x81\x80"', "utf8": some([*ascii_, 0xE9, 0x20AC, 0x1F600], 30).encode(), "marked8": b"\xef\xbb\xbfa,b\n1,\xc3\xa9\n",
        "little": some([*ascii_, 0xE9], 30).encode("utf-16-le"), "big": some([*ascii_, 0xD8, 0xFE], 30).encode("utf-16-be"), "marked": "a\U0001f600\nb\n".encode("utf-16"),
        "chinese": "\n".join("日本語" for _ in range(9)).encode("utf-16"), "quoted": b'a,"b\n\n\n\n\n\n\n\n\n\n\nc"\nlast,\xe9\n', "feeds": b"\n\n\n"}


@pytest.mark.parametrize("seed", range(3))
def test_profiles_are_those_of_all_bytes(spark, tmp_path, seed):
    for name, data in odd_files(seed).items():
        put(tmp_path, name, data)
    names = ["encoding", "confidence", "head", "n_lines", "n_bytes", "high_lines", "bad_lines", "n_quotes", "n_nul", "nul_even", "nul_odd"]
    want = {r.path: r for r in raw.encodings(raw.byte_profiles(raw.stored_lines(spark, str(tmp_path)))).collect()}
    got = {r.path: r for r in raw.encodings(raw.stored_profiles(spark, str(tmp_path))).collect()}
    assert set(got) == set(want) and len(want) == len(odd_files(seed))
    for path, w in want.items():
        own = names + (["n_high", "n_control", "n_undefined", "n_letters"] if w.encoding in (LATIN, "cp1252") else []) + (["n_wide"] if w.encoding.startswith("utf-16") else [])
        for n in own:
            assert got[path][n] == w[n] or n == "confidence" and abs(got[path][n] - w[n]) < 1e-12, (path, n)


@pytest.mark.parametrize("encoding", ["utf-8", LATIN, "cp1252", "utf-16-le", "utf-16-be"])
def test_lines_are_decoded_as_python_does(spark, encoding):
    r = random.Random(1)
    lines = [bytes(r.randrange(256) for _ in range(r.randrange(8))) for _ in range(400)]
    if encoding.startswith("utf-16"):  # others are left to Python
        lines = [x for x in lines if not set(x) & {*range(0xD8, 0xE0), 0xFE}]
    rows = spark.createDataFrame([(i, 7, bytearray(x), encoding) for i, x in enumerate(lines)], "i int, start long, bytes binary, encoding string")
    got = {x.i: x.line for x in rows.select("i", R.text().alias("line")).collect()}
    assert [got[i] for i in range(len(lines))] == [x.decode(encoding, "replace") for x in lines]


def test_every_encoding_is_read_without_python(spark, tmp_path):
    rows = set()
    for name, word in (("utf-8", "naïve"), (LATIN, "naïve"), ("cp1252", "5 €"), ("utf-16-le", "naïve"), ("utf-16-be", "naïve"), ("utf-16", "naïve")):
        put(tmp_path, name, (f"name;id;word\n" + "".join(f"{name};{i};{word} {i}\n" for i in range(50)) + "\n \t\nNAME ; id;Word\n").encode(name))
        rows |= {(name, str(i), f"{word} {i}") for i in range(50)}
    df, _ = FS.read_files(spark, str(tmp_path))
    assert df.columns == ["name", "id", "word"] and sorted(map(tuple, df.collect())) == sorted(rows)
    plan = df._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and plan.count("Generate") > 0


def test_surrogates_and_marks_inside(spark, tmp_path):
    for name, word in (("utf-16-le", "x \U0001f600"), ("utf-16-be", "﻿y")):
        put(tmp_path, name, ("id;word\n" + "".join(f"{i};{word}\n" for i in range(30))).encode(name))
    put(tmp_path, "half", "id;word\n1;z".encode("utf-16-le") + b"\xd8")
    df, _ = FS.read_files(spark, str(tmp_path))
    assert {tuple(r) for r in df.groupBy("word").count().collect()} == {("x \U0001f600", 30), ("﻿y", 30), ("z�", 1)}


@pytest.fixture
def tiny_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_partitions_without_rows_tell_no_encoding(spark, tmp_path, tiny_splits):
    """A table of one row group over many partitions: files that hold a column line alone would be taken for UTF-8."""
    table = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    table.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert spark.read.parquet(f"{tmp_path}/lineitem.parquet").rdd.getNumPartitions() > 1
    got = s04_encoding(spark, str(tmp_path)).collect()
    assert len(got) == 7 and all(r.encoding == r.other and r.n_rows == table.count() for r in got)


def test_no_rows(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert s04_encoding(spark, str(tmp_path)).collect() == []
