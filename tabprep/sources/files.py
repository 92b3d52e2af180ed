"""Delimited-file sources with the read safeguards.

The census lists files, the sniff reads their first bytes; archives, encodings and
records are read from raw lines (``raw.py``, ``records.py``) as all-string columns,
each file by its own dialect, so every later decision (NA tokens, header repeats,
types) is a column expression or one aggregate.
"""

from __future__ import annotations

import csv
import re
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.config import DEFAULT_SETTINGS, DELIMITER_ATTEMPTS, INVISIBLE_CHARS, Settings
from tabprep.sources import cleanup as C
from tabprep.sources import raw
from tabprep.sources.records import Dialect, _kept_lines, closes, table, text

OLE2_MAGIC_HEX = "D0CF11E0A1B11AE1"
ZIP_MAGIC_HEX = "504B0304"
GZIP_MAGIC_HEX = "1F8B"


class IngestError(ValueError):
    pass


# ------------------------------------------------------------------ S1 census


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, length) of every file under ``path`` from the Hadoop file system listing
    (metadata only; empty files included, which a file scan would skip)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    it = fs.listFiles(p, True)
    out = []
    while it.hasNext():
        st = it.next()
        name = st.getPath().getName()
        if not name.startswith(("_", ".")):
            out.append((st.getPath().toString(), int(st.getLen())))
    return out


def file_census(spark: SparkSession, path: str, s: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """(path, length, verdict): empty → reject, above the size cap (off by default) →
    reject, above the warning size → warn, else ok."""
    files = spark.createDataFrame(list_files(spark, path), "path string, length long")
    mb = F.col("length") / (1024 * 1024)
    verdict = F.when(F.col("length") == 0, "reject_empty")
    if s.max_file_size_mb is not None:
        verdict = verdict.when(mb > s.max_file_size_mb, "reject_too_large")
    verdict = verdict.when(mb > s.warn_file_size_mb, "warn_large").otherwise("ok")
    return files.withColumn("verdict", verdict)


# ------------------------------------------------------------------ S2 sniff


def sniff_text(c: Column, n_chars: int | None = None) -> Column:
    """S2 on text: html / doctype markers (case-insensitive) in the first ``n_chars``
    (whole text when None)."""
    head = F.lower(c if n_chars is None else F.substring(c, 1, n_chars))
    return head.contains("<html") | head.contains("<!doctype")


def sniff_bytes(content: Column, n_bytes: int = 1000) -> DataFrame | Column:
    """S2 on bytes: struct(is_html, is_ole2, is_zip, is_gzip) of the first bytes."""
    head = F.substring(content, 1, n_bytes)
    hx = F.hex(head)
    txt = F.lower(F.decode(head, "ISO-8859-1"))
    return F.struct((txt.contains("<html") | txt.contains("<!doctype")).alias("is_html"),
                    hx.startswith(OLE2_MAGIC_HEX).alias("is_ole2"),
                    hx.startswith(ZIP_MAGIC_HEX).alias("is_zip"),
                    hx.startswith(GZIP_MAGIC_HEX).alias("is_gzip"))


def sniff_files(spark: SparkSession, path: str, s: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """S2 for every file under ``path``, of which only the first bytes are read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    heads = []
    for p, length in list_files(spark, path):
        at = jvm.org.apache.hadoop.fs.Path(p)
        stream = at.getFileSystem(conf).open(at)
        try:
            heads.append((p, bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(length, s.sniff_bytes)))))
        finally:
            stream.close()
    return spark.createDataFrame(heads, "path string, content binary").select("path", sniff_bytes(F.col("content"), s.sniff_bytes).alias("s")).select("path", "s.*")


# ------------------------------------------------------------------ S3 compression, S4 encoding


def kinds(spark: SparkSession, path: str) -> dict[str, str]:
    """plain, zip or gzip of each file by its first bytes (``.gz`` files, which Spark inflates, are plain)."""
    first = raw.stored_lines(spark, path).where("start = 0").groupBy("path").agg(F.first("bytes").alias("head"))
    return {r.path: r.kind for r in first.select("path", _kind(F.col("head")).alias("kind")).collect()}


def _kind(first: Column) -> Column:
    head = F.hex(F.substring(first, 1, 4))
    return F.when(head == ZIP_MAGIC_HEX, "zip").when(head.startswith(GZIP_MAGIC_HEX), "gzip").otherwise("plain")


def file_lines(spark: SparkSession, found: dict[str, str], members: dict[str, str | None], encodings: dict[str, str] | None = None) -> DataFrame:
    """(path, start, bytes, encoding) of every line of plain files, chosen zip members and gzip streams, in file order within
    splits. Files of one encoding are read together."""
    parts = []
    told = {p: (encodings or {}).get(p, "utf-8") for p in found}
    for encoding in sorted(set(told.values())):
        own, feed, name = [p for p in found if told[p] == encoding], raw.line_feeds(encoding), F.lit(encoding).alias("encoding")
        if plain := [p for p in own if found[p] == "plain"]:
            parts.append(raw.stored_lines(spark, plain, feed).select("*", name))
        if packed := {p: members.get(p) for p in own if found[p] == "gzip" or members.get(p) is not None}:
            parts.append(raw.inflated_lines(spark, packed, feed).select("*", name))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], raw.LINES + ", encoding string")


def zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """S3: (path, member, line) of the chosen member of every zip archive under ``path``, read in chunks; archives without
    a member to choose have no lines."""
    archives = [p for p, k in kinds(spark, path).items() if k == "zip"]
    chosen = {p: m for p, m in raw.choose_members(spark, archives).items() if m is not None} if archives else {}
    if not chosen:
        return spark.createDataFrame([], "path string, member string, line string")
    member = F.create_map(*[F.lit(x) for kv in chosen.items() for x in kv])[F.col("path")]
    return raw.inflated_lines(spark, chosen).select("path", member.alias("member"), F.regexp_replace(F.make_valid_utf8(F.col("bytes").cast("string")), "\r$", "").alias("line"))


def _profiled(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str], dict[str, str | None]]:
    """Byte profiles of every file, archives by what is inflated from them; kinds, and chosen members of zip archives. One
    pass over all files, and one more over archives."""
    stored = raw.encodings(raw.stored_profiles(spark, path)).withColumn("kind", _kind(F.element_at("head", 1)))
    found = {r.path: r.kind for r in stored.select("path", "kind").collect()}
    archives = [p for p, k in found.items() if k == "zip"]
    members = raw.choose_members(spark, archives) if archives else {}
    profiles = stored.where("kind = 'plain'")
    packed = {p: k for p, k in found.items() if k == "gzip" or members.get(p) is not None}
    if packed:
        inflated = raw.encodings(raw.byte_profiles(file_lines(spark, packed, members)))
        profiles = profiles.unionByName(inflated.withColumn("kind", F.lit("packed")))
    return profiles, found, members


def detect_encoding(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, confidence) of every file, by all of its bytes; archives by the inflated ones."""
    return _profiled(spark, path)[0].select("path", "encoding", "confidence")


# ------------------------------------------------------------------ S5 delimiter


def delimiter_scores(lines: DataFrame, key: str, line: str = "line",
                     candidates: tuple = DELIMITER_ATTEMPTS) -> DataFrame:
    """Per ``key`` (file or document) and candidate over its non-blank lines:
    avg·avg/(std_pop + 1) of the per-line counts; best wins, ties by list order;
    no positive score → comma. Returns (key, delimiter, score)."""
    cand = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("pos")) for i, d in enumerate(candidates)])
    x = lines.where(F.trim(F.col(line)) != "").select(key, line, F.explode(cand).alias("c"))
    x = x.select(key, "c.d", "c.pos",
                 (F.length(line) - F.length(F.replace(F.col(line), F.col("c.d"), F.lit("")))).alias("k"))
    g = x.groupBy(key, "d", "pos").agg(F.avg("k").alias("a"), F.stddev_pop("k").alias("sd"))
    g = g.where(F.col("a") > 0).withColumn("score", F.col("a") * F.col("a") / (F.col("sd") + 1))
    best = g.groupBy(key).agg(F.max_by(F.struct("d", "score"), F.struct(F.col("score"), -F.col("pos"))).alias("b"))
    keys = lines.select(key).distinct()
    return keys.join(best, key, "left").select(
        key, F.coalesce(F.col("b.d"), F.lit(",")).alias("delimiter"), F.col("b.score").alias("score"))


def detect_delimiter(spark: SparkSession, path: str, encoding: str = "utf-8",
                     s: Settings = DEFAULT_SETTINGS) -> str:
    """S5 for files of one dialect: the first ``delimiter_sample_lines`` lines read."""
    lines = spark.read.option("encoding", encoding).text(path).limit(s.delimiter_sample_lines) \
                 .select(F.lit(path).alias("f"), F.col("value").alias("line"))
    row = delimiter_scores(lines, "f").first()
    return row["delimiter"] if row else ","


# ------------------------------------------------------------------ S9/S10 names


def clean_column_name(name: str) -> str:
    """Drop invisible code points, trim, collapse whitespace, empty → 'column'."""
    for ch in INVISIBLE_CHARS:
        name = name.replace(ch, "")
    name = re.sub(r"\s+", " ", name.strip())
    return name or "column"


def dedupe_names(names: list[str]) -> list[str]:
    """Repeated names get _1, _2 … (looping until unique, so a,a,a_1 stays distinct)."""
    seen: set[str] = set()
    counters: dict[str, int] = {}
    out = []
    for n in names:
        cand = n
        while cand in seen:
            counters[n] = counters.get(n, 0) + 1
            cand = f"{n}_{counters[n]}"
        seen.add(cand)
        out.append(cand)
    return out


# ------------------------------------------------------------------ S6 read, S15 gate, S16 composition


def read_names(header: tuple[str, ...] | list[str]) -> list[str]:
    """Column names of a header: blank ones are numbered, as S13 expects them; the others cleaned (S9); then made unique."""
    return dedupe_names([clean_column_name(h) if h else f"Unnamed: {i}" for i, h in enumerate(header)])


def dialects(spark: SparkSession, path: str, s: Settings = DEFAULT_SETTINGS) -> tuple[list[Dialect], list[tuple[str, str, str]]]:
    """Every file's encoding, delimiter (S5) and header, and findings on files that can't be read. One row a file reaches
    the driver, with its first lines."""
    profiles, found, members = _profiled(spark, path)
    archives = [p for p, k in found.items() if k == "zip"]
    findings = [("zip", p, "no member that is a table") for p in archives if members[p] is None]
    findings += [("zip", p, f"using {members[p]}") for p in archives if members[p] is not None]
    told = profiles.select("path", "encoding", "confidence", "head", "n_quotes", "n_wide").collect()
    heads = {r.path: _head_text(r.head or [], r.encoding) for r in told}
    lines = [(p, line) for p, text in heads.items() for line in text.split("\n")[: s.delimiter_sample_lines]]
    best = {r.path: r.delimiter for r in delimiter_scores(spark.createDataFrame(lines, "path string, line string"), "path").collect()} if lines else {}
    out = []
    for r in told:
        delimiter = best.get(r.path, ",")
        rows = (row for row in csv.reader(_kept_lines(heads[r.path]), delimiter=delimiter) if any(c.strip() for c in row))
        out.append(Dialect(r.path, r.encoding, delimiter, tuple(next(rows, ())), members.get(r.path), found[r.path], r.confidence, r.n_quotes > 0, rare=r.n_wide > _marked(r.head)))
    return sorted(out, key=lambda d: d.path), findings


def _marked(head: list[bytes] | None) -> bool:
    """Whether a file begins with a byte order mark of UTF-16."""
    return bool(head) and bytes(head[0][:2]) in (b"\xff\xfe", b"\xfe\xff")


def _head_text(head: list[bytes], encoding: str) -> str:
    """The first lines of a file; lines of UTF-16 were cut at one of the two bytes of their line feed."""
    text = b"\n".join(map(bytes, head))
    text = text[: len(text) // 2 * 2] if encoding.startswith("utf-16") else text
    return text.decode("utf-8" if encoding == "utf-8-sig" else encoding, "replace").removeprefix("\ufeff").replace("\r\n", "\n")


def safe_read(spark: SparkSession, path: str, encoding: str, delimiter: str, header: list[str]) -> DataFrame:
    """S6 for files of one known dialect: all strings, a header line being a record like others. Records with more fields
    than ``header`` go; shorter ones are filled up with nulls; undecodable bytes are replaced; quoted fields may hold line
    breaks."""
    found = kinds(spark, path)
    archives = [p for p, k in found.items() if k == "zip"]
    members = raw.choose_members(spark, archives) if archives else {}
    own = [Dialect(p, encoding, delimiter, tuple(header), members.get(p), k) for p, k in found.items()]
    lines = file_lines(spark, found, members, dict.fromkeys(found, encoding))
    return table(lines, own, {p: list(header) for p in found}, keep_headers=True)


def read_files(spark: SparkSession, path: str, s: Settings = DEFAULT_SETTINGS) -> tuple[DataFrame | None, list[tuple[str, str, str]]]:
    """Every file under ``path`` by its own dialect as one all-string table, and findings."""
    own, findings = dialects(spark, path, s)
    findings += [("encoding", d.path, d.encoding) for d in own] + [("delimiter", d.path, d.delimiter) for d in own]
    names = {d.path: read_names(d.header) for d in own}
    findings += [("header", d.path, f"{n} repeated or blank names") for d in own if (n := len(d.header) - len(set(d.header) - {""}))]
    findings += [("header", d.path, "columns differ from those of the first file") for d in own[1:] if names[d.path] != names[own[0].path]]
    if not any(names.values()):
        return None, findings
    kind, member = {d.path: d.kind for d in own}, {d.path: d.member for d in own if d.member is not None}
    lines = file_lines(spark, kind, member, {d.path: d.encoding for d in own})
    return table(lines, _closed(lines, own), names), findings


def _closed(lines: DataFrame, own: list[Dialect]) -> list[Dialect]:
    """Dialects that know whether all lines of their file close. Where every file with quotes is decoded by Spark, one pass
    tells; otherwise none is known to."""
    if not any(d.quotes for d in own) or not all(d.native for d in own):
        return own
    delimiters = sorted({d.delimiter for d in own})
    line, close = text(), closes(F.col("line"), delimiters[0])
    for delimiter in delimiters[1:]:
        close = F.when(F.col("path").isin([d.path for d in own if d.delimiter == delimiter]), closes(F.col("line"), delimiter)).otherwise(close)
    open_ones = {r.path for r in lines.select("path", line.alias("line")).where(~close).select("path").distinct().collect()}
    return [replace(d, closed=d.path not in open_ones) for d in own]


def ingest(spark: SparkSession, path: str, s: Settings = DEFAULT_SETTINGS) -> tuple[DataFrame | None, DataFrame]:
    """Census → sniff → archives (S3), encoding (S4), delimiter (S5) and header (S9, S10) of every file → records
    → cleanup (S7, S8, S11–S14) → gate (S15). Returns (typed table or None, findings (step, path, detail))."""
    schema = "step string, path string, detail string"
    census = file_census(spark, path, s).collect()
    findings = [("census", r["path"], r["verdict"]) for r in census if r["verdict"] != "ok"]
    sniff = [r for r in sniff_files(spark, path, s).collect() if r["is_html"] or r["is_ole2"]]
    findings += [("sniff", r["path"], "html" if r["is_html"] else "ole2") for r in sniff]
    if any(r["verdict"].startswith("reject") for r in census) or sniff or not census:
        return None, spark.createDataFrame(findings or [("census", path, "no_files")], schema)
    df, told = read_files(spark, path, s)
    findings += told
    if df is None:
        return None, spark.createDataFrame([*findings, ("gate", path, "no columns")], schema)
    typed, decisions = C.cleanup(df, s)
    if typed.limit(s.min_rows).count() < s.min_rows:
        return None, spark.createDataFrame([*findings, ("gate", path, f"fewer than {s.min_rows} rows")], schema)
    fdf = spark.createDataFrame(findings, schema)
    fdf = fdf.unionByName(decisions.select(F.lit("cleanup").alias("step"), F.col("column").alias("path"),
                                           F.concat_ws(":", "action", "detail").alias("detail")))
    return typed, fdf


def preview(df: DataFrame, n: int = 20) -> tuple[DataFrame, list[tuple[str, str]]]:
    """First rows and (column, type)."""
    return df.limit(n), df.dtypes
