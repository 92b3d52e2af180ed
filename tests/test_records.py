"""Files of many encodings, archives and dialects against plain readers."""
import csv
import gzip
import io
import os
import random
import struct
import zipfile

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabprep.sources import files as FS
from tabprep.sources import raw
from tabprep.sources import records as R


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def put(folder, name, data):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def by_pandas(text, sep=","):
    df = pd.read_csv(io.StringIO(text), sep=sep, dtype=str, keep_default_na=False, na_values=[], on_bad_lines="skip")
    return [tuple(None if pd.isna(x) else x for x in r) for r in df.itertuples(index=False)]


def messy(r, n=120):
    """Text with quoted line breaks, doubled quotes, stray quotes, blank, short and long lines."""
    out = ["a,b,c", "-1,x,y"]
    for i in range(n):
        kind = r.randrange(9)
        out.append([f"{i},x,y", f'{i},"q, q",z', f'{i},"two\nlines ""quoted""\n\nthree",w', f'{i},5" pipe,v', "", f"{i},short", f"{i},l,o,n,g", f'"{i}","",""', f'{i},"long\n{"line " * 60}\nend",u'][kind])
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("seed", range(4))
def test_records_over_many_splits(spark, tmp_path, small_splits, seed):
    """One file in splits of 200 bytes equals a plain reader's table."""
    text = messy(random.Random(seed))
    put(tmp_path, "t.csv", text.replace("\n", "\r\n").encode() if seed == 3 else text.encode())
    df, _ = FS.read_files(spark, str(tmp_path))
    lines = raw.stored_lines(spark, str(tmp_path))
    assert lines.select("start").distinct().count() > 10
    want = by_pandas(text)
    clean = lambda rows: sorted([tuple(None if x in (None, "") else x.replace("\r", "") for x in r) for r in rows], key=str)
    assert clean(df.collect()) == clean(want)


def test_a_quote_that_never_closes(spark, tmp_path, small_splits):
    rows = [f"{i},text {i},x" for i in range(60)]
    rows[20] = '20,"never closed,x'
    put(tmp_path, "t.csv", ("a,b,c\n" + "\n".join(rows) + "\n").encode())
    got = rows_of(FS.read_files(spark, str(tmp_path))[0])
    assert len(got) == 60 and ("19", "text 19", "x") in got and ("59", "text 59", "x") in got and ("20", "never closed,x", None) in got


@given(st.text(alphabet='ab,"', max_size=14), st.booleans())
@settings(max_examples=300, deadline=None)
def test_state_of_a_line(line, inside):
    """A line leaves quotes open if a plain reader goes on reading for the field."""
    text = ('"x' if inside else "") + (" " if False else "") + line
    got = R.ends_inside(line, ",", inside)
    rows = list(csv.reader(io.StringIO(text + "\nEND\n")))
    assert got == (not any(r == ["END"] for r in rows))


CODECS = {"utf-8": "utf-8", "utf-8-sig": "utf-8-sig", "utf-16-le": "utf-16-le", "utf-16-be": "utf-16-be", "utf-16": "utf-16", "latin-1": "iso-8859-1", "cp1252": "cp1252", "ascii": "utf-8"}


@pytest.mark.parametrize("packed", ["", "gz", "gzip", "zip"])
def test_encodings(spark, tmp_path, packed):
    """Every encoding in a file of its own, all read as one table."""
    want, rows = {}, set()
    for codec in CODECS:
        word = {"ascii": "plain", "cp1252": "café €5 “x”"}.get(codec, "café über naïve")
        data = ("codec;id;name;note\n" + "".join(f'{codec};{i};{word} {i};"a; b"\n' for i in range(200))).encode(codec)
        rows |= {(codec, str(i), f"{word} {i}", "a; b") for i in range(200)}
        if packed == "zip":
            b = io.BytesIO()
            with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("README", "read me\n")
                z.writestr("data/table.CSV", data)
                z.writestr("other.csv", "x,y\n")
            data = b.getvalue()
        elif packed:
            data = gzip.compress(data)
        put(tmp_path, codec + {"": ".csv", "gz": ".csv.gz", "gzip": ".bin", "zip": ".zip"}[packed], data)
        want[codec] = {"utf-16": "utf-16-le"}.get(codec, CODECS[codec])
    if packed in ("", "gz"):
        want["utf-8-sig"] = "utf-8"  # the text source has taken the mark away
    told = {os.path.basename(r.path).split(".")[0]: r for r in FS.detect_encoding(spark, str(tmp_path)).collect()}
    assert {k: r.encoding for k, r in told.items()} == want and all(0.7 < r.confidence <= 1 for r in told.values())
    df, findings = FS.read_files(spark, str(tmp_path))
    assert df.columns == ["codec", "id", "name", "note"] and df.count() == len(rows) and set(map(tuple, df.collect())) == rows
    assert packed != "zip" or sum(f[0] == "zip" and f[2] == "using data/table.CSV" for f in findings) == len(CODECS)


def test_encoding_looks_at_whole_files(spark, tmp_path):
    """A single accent behind 200 000 bytes of ASCII decides, and no character is cut."""
    put(tmp_path, "late.csv", b"a,b\n" + b"1,plain\n" * 25_000 + "2,é\n".encode("latin-1"))
    put(tmp_path, "cut.csv", ("a,b\n" + "1,日本語\n" * 12_000).encode())
    put(tmp_path, "some_bad.csv", ("a,b\n" + "1,é\n" * 500).encode() + b"2,\xff\n")
    got = {os.path.basename(r.path): r.encoding for r in FS.detect_encoding(spark, str(tmp_path)).collect()}
    assert got == {"late.csv": "iso-8859-1", "cut.csv": "utf-8", "some_bad.csv": "utf-8"}
    df, _ = FS.read_files(spark, str(tmp_path))
    assert df.where("a = 2").count() == 2 and df.where("b = '�'").count() == 1


@pytest.mark.parametrize("header,names", [("a,a,b", ["a", "a_1", "b"]), ('"x, y","",z', ["x, y", "Unnamed: 1", "z"]), ("a,,", ["a", "Unnamed: 1", "Unnamed: 2"]), ("﻿ q ,a​  b,a b", ["q", "a b", "a b_1"]), ('"two\nlines",b,c', ["two lines", "b", "c"])])
def test_headers(spark, tmp_path, header, names):
    put(tmp_path, "t.csv", (f"{header}\n" + "".join(f"{i},{i + 1},{i + 2}\n" for i in range(20)) + f"{header}\n").encode())
    df, _ = FS.read_files(spark, str(tmp_path))
    assert df.columns == names and df.count() == 20
    typed, _ = FS.ingest(spark, str(tmp_path))
    assert typed.count() == 20 and all(t == "bigint" for _, t in typed.dtypes)


def test_unnamed_columns_go(spark, tmp_path):
    put(tmp_path, "t.csv", (",a,,b\n" + "".join(f"{i},{i},{'x' if i == 0 else ''},{i}\n" for i in range(50))).encode())
    typed, _ = FS.ingest(spark, str(tmp_path))
    assert typed.columns == ["Unnamed: 0", "a", "b"]


def test_folder_of_dialects(spark, tmp_path):
    put(tmp_path, "1.csv", ("id,name\n" + "".join(f"{i},n{i}\n" for i in range(20))).encode())
    put(tmp_path, "2.txt", ("name|id|more\n" + "".join(f"café{i}|{i}|m\n" for i in range(15))).encode("latin-1"))
    df, findings = FS.read_files(spark, str(tmp_path))
    assert df.columns == ["id", "name", "more"] and df.count() == 35
    assert df.where("more is null").count() == 20 and df.where("name = 'café3' and id = 3").count() == 1
    assert any(f[0] == "header" for f in findings)


def test_zip_members(spark, tmp_path):
    def archive(name, members, method=zipfile.ZIP_DEFLATED, stream=False):
        b = io.BytesIO()
        out = b if not stream else Unseekable(b)
        with zipfile.ZipFile(out, "w", method) as z:
            for k, v in members:
                z.writestr(k, v)
        return put(tmp_path, name, b.getvalue())
    archive("only.zip", [("notes.dat", "a,b\n1,2\n")])
    archive("first.zip", [("x.md", "no"), ("d/", ""), ("one.TSV", "t\n"), ("two.csv", "u\n")], zipfile.ZIP_STORED)
    archive("none.zip", [("x.md", "no"), ("y.md", "no")])
    archive("streamed.zip", [("big.csv", "\n".join(str(i) for i in range(50_000))), ("z.csv", "")], stream=True)
    put(tmp_path, "broken.zip", b"PK\x03\x04" + b"\x00" * 40)
    chosen = raw.choose_members(spark, [p for p, k in FS.kinds(spark, str(tmp_path)).items() if k == "zip"])
    assert {os.path.basename(k): v for k, v in chosen.items()} == {"only.zip": "notes.dat", "first.zip": "one.TSV", "none.zip": None, "streamed.zip": "big.csv", "broken.zip": None}
    lines = FS.zip_lines(spark, str(tmp_path)).collect()
    assert sorted(int(r.line) for r in lines if r.member == "big.csv") == list(range(50_000))
    assert [r.line for r in lines if r.member == "one.TSV"] == ["t"]
    df, findings = FS.read_files(spark, str(tmp_path))
    assert sum(f[0] == "zip" and f[2].startswith("no member") for f in findings) == 2


class Unseekable(io.RawIOBase):
    """Makes zipfile write sizes behind the data."""

    def __init__(self, to):
        self.to = to

    def writable(self):
        return True

    def write(self, data):
        return self.to.write(data)


def test_archive_is_read_in_chunks():
    """A member of 300 MB from an archive of 300 kB needs a few chunks of memory."""
    import tracemalloc
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        with z.open("big.csv", "w") as f:
            for _ in range(300):
                f.write(b"0123456789abcde\n" * 65_536)
    lines = b.getvalue().split(b"\n")
    tracemalloc.start()
    total = 0
    for name, body in raw.zip_entries(raw.Stream(iter(lines))):
        assert name == "big.csv"
        total += sum(len(x) for x in body)
    assert total == 300 * 16 * 65_536 and tracemalloc.get_traced_memory()[1] < 5e6
    tracemalloc.stop()


def test_split_of_utf_16_lines():
    data = "a਀b\n\u000ax".encode("utf-16-le")
    assert raw._split(data, b"\n\x00") == [p.encode("utf-16-le") for p in "a਀b\n\u000ax".split("\n")]
    assert struct.calcsize("<HHHHHIIIHH") == 26


def test_lines_that_close_need_no_python(spark, tmp_path):
    """Quotes that open and close within a piece: fields by Spark alone, equal to a plain reader's."""
    text = 'a;b;c\n"";x;"two words"\n1;5" y;""\n"q";"a ""b""";z\n2;"";"é"\n'
    simple = "".join(x + "\n" for x in text.splitlines() if '""b""' not in x)
    for name, body, native in (("closed", simple, True), ("open", text, False), ("broken", simple + '3;"two\nlines";x\n', False), ("return", simple.replace("\n", "\r\n"), True)):
        folder = tmp_path / name
        folder.mkdir()
        put(folder, "t.csv", body.encode())
        df, _ = FS.read_files(spark, str(folder))
        got = rows_of(df)
        want = sorted(map(tuple, list(csv.reader(io.StringIO(body, newline=""), delimiter=";"))[1:]), key=str)
        assert got == want, name
        assert ("MapInArrow" not in df._jdf.queryExecution().toString()) == native, name


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: b.replace(b"\n", b"")), min_size=1, max_size=8))
def test_counts_of_bytes(lines):
    import pyarrow as pa
    whole = b"\n".join(lines) + b"\n"
    got = raw._counts(pa.array([b"x\x80", *lines], pa.binary()).slice(1))
    assert got[0] == len(lines) and got[1] == len(whole) and got[2] == sum(not x.isascii() for x in lines)
    assert got[8] == whole.count(b'"') and got[9] == whole.count(b"\0") and got[4] == sum(c >= 0x80 for c in whole)


def test_sniffing_reads_first_bytes_only(spark, tmp_path):
    put(tmp_path, "t.csv", b"a,b\n" + b"1,2\n" * 400 + b"<html>")
    put(tmp_path, "u.csv", b"<HTML>")
    found = FS.sniff_files(spark, str(tmp_path))
    assert {os.path.basename(r.path): r.is_html for r in found.collect()} == {"t.csv": False, "u.csv": True}
    assert "binaryFile" not in found._jdf.queryExecution().toString()
