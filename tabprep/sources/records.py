"""Records of delimited text, quoted line breaks included, in files that Spark splits.

Whether a line begins inside a quoted field depends on all lines before it. Each line is a function from the state it
begins in (outside or inside quotes) to the one it ends in; a split's lines compose to one such function, and the few
functions of a file's splits, taken in order, say in which state each split begins. Lines that begin and end outside are
whole records and stay where they are; the rest meet by the line that opened their record. A quote that the file never
closes opens nothing: from its record on, every line is a record.

Fields follow the usual rules: a quote opens a field only at its beginning, two quotes inside are one, the delimiter ends a
field outside of quotes.
"""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.sources import raw

csv.field_size_limit(1 << 31 - 1)

_MARKED = "path string, start long, at long, line string, out_in boolean, out_end boolean, in_in boolean, in_end boolean, out_from long, in_from long"


@dataclass(frozen=True)
class Dialect:
    """How one file is written."""

    path: str
    encoding: str
    delimiter: str
    header: tuple[str, ...] = ()
    member: str | None = None
    kind: str = "plain"
    confidence: float = 1.0
    quotes: bool = True  # whether the file may hold any
    closed: bool = False  # whether every line is known to ``close``
    rare: bool = True  # whether UTF-16 may have surrogates, U+FFFE, or U+FEFF behind its beginning

    @property
    def native(self) -> bool:
        """Whether Spark decodes the lines itself, as Python would."""
        return self.encoding in ("utf-8", "iso-8859-1", "cp1252") or (self.encoding in ("utf-16-le", "utf-16-be") and not self.rare)


def ends_inside(line: str, delimiter: str, inside: bool) -> bool:
    """Whether a line ends inside quotes, given whether it begins there."""
    fresh = not inside  # at the beginning of a field
    at, n = 0, len(line)
    while at < n:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
                continue
            inside, fresh, at = False, False, at + 1
        elif fresh and line[at] == '"':
            inside, at = True, at + 1
        else:
            at = line.find(delimiter, at)
            if at < 0:
                return False
            fresh, at = True, at + 1
    return inside


def _marked(dialects: dict[str, Dialect]):
    """Decoded lines with their place in the split, and for a split that begins outside (out) or inside (in) quotes whether
    the line begins and ends inside, and which line opened the record it is in (null: one of an earlier split)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, out, into, opened = None, 0, False, True, [None, None]
        for batch in batches:
            paths, starts = batch.column("path").to_pylist(), batch.column("start").to_pylist()
            cuts = [0, *[i for i in range(1, len(paths)) if paths[i] != paths[i - 1] or starts[i] != starts[i - 1]], len(paths)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True) if paths else ():
                d = dialects[paths[a]]
                if (paths[a], starts[a]) != key:
                    key, at, out, into, opened = (paths[a], starts[a]), 0, False, True, [None, None]
                lines = raw.decoded(batch.column("bytes").slice(a, b - a), d.encoding)
                if at == 0 and starts[a] == 0 and lines and lines[0][:1] == "\ufeff":
                    lines[0] = lines[0][1:]
                quoted = raw.has_quotes(lines).tolist()
                marks: list[list[bool]] = [[], [], [], []]
                openers: list[list] = [[], []]
                for place, (line, some) in enumerate(zip(lines, quoted, strict=True), at):
                    before = (out, into)
                    opened = [o if inside else place for o, inside in zip(opened, before, strict=True)]
                    openers[0].append(opened[0])
                    openers[1].append(opened[1])
                    if some:
                        out, into = ends_inside(line, d.delimiter, out), ends_inside(line, d.delimiter, into)
                    for m, v in zip(marks, (before[0], out, before[1], into), strict=True):
                        m.append(v)
                n = b - a
                yield pa.RecordBatch.from_arrays([pa.array(paths[a:b]), pa.array(starts[a:b], pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array(lines, pa.string()), *[pa.array(m, pa.bool_()) for m in marks], *[pa.array(o, pa.int64()) for o in openers]],
                                                 names=["path", "start", "at", "line", "out_in", "out_end", "in_in", "in_end", "out_from", "in_from"])
                at += n
    return run


def closes(line: Column, delimiter: str) -> Column:
    """Whether every quoted field of a line is one piece between delimiters without quotes inside: begun outside of quotes,
    such a line ends outside, and its fields are its pieces. (That may hold for other lines too.)"""
    line = _without_return(line)
    bare = lambda p: p.endswith('"') & ~F.substring(p, F.lit(2), F.char_length(p) - 2).contains('"')
    pieces = F.forall(F.split(line, "\\" + delimiter, -1), lambda p: ~p.startswith('"') | ((F.char_length(p) > 1) & bare(p)))
    return ~line.contains('"') | (~line.contains("\r") & pieces)


#: Characters of code page 1252 from 80 to 9F; U+FFFD: none.
WINDOWS = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")


def text() -> Column:
    """Decoded lines (bytes, encoding) of files that are ``native``."""
    plain, n, encoding = F.col("bytes").cast("string"), F.octet_length("bytes"), F.col("encoding")
    latin = F.decode("bytes", "ISO-8859-1")
    single = lambda decoded: F.when(raw.is_ascii(), plain).otherwise(decoded)

    def wide(charset: str) -> Column:
        """Half a character at the end becomes U+FFFD; the mark at the beginning goes."""
        whole = F.when(n % 2 == 0, F.decode("bytes", charset)).otherwise(F.concat(F.decode(F.substring("bytes", F.lit(1), n - 1), charset), F.lit("\ufffd")))
        return F.when((F.col("start") == 0) & whole.startswith("\ufeff"), F.substring(whole, F.lit(2), n)).otherwise(whole)

    return (F.when(encoding == "utf-8", F.make_valid_utf8(plain)).when(encoding == "iso-8859-1", single(latin))
            .when(encoding == "cp1252", single(F.translate(latin, "".join(map(chr, range(0x80, 0xA0))), WINDOWS)))
            .when(encoding == "utf-16-le", wide("UTF-16LE")).when(encoding == "utf-16-be", wide("UTF-16BE")))


def _once(value: Column) -> Column:
    """A column that is worked out once for each row, however often it is used: Spark would repeat what it stands for in every
    filter behind."""
    return F.explode(F.array(value))


def records(lines: DataFrame, dialects: list[Dialect]) -> DataFrame:
    """(path, start, at, record) of every record that is not blank, from raw lines (path, start, bytes, encoding) in file order
    within their splits. One small row for each split reaches the driver. Where all lines close every line is a
    record, and Spark decodes the common encodings itself."""
    spark = lines.sparkSession
    if not any(d.quotes and not d.closed for d in dialects) and all(d.native for d in dialects):
        return _not_blank(lines.select("path", "start", F.lit(0).cast("long").alias("at"), _once(text()).alias("record")))
    known = {d.path: d for d in dialects}
    shared = spark.sparkContext.broadcast(known)
    marked = lines.drop("encoding").mapInArrow(lambda batches: _marked(shared.value)(batches), _MARKED)
    last = F.struct("at", "out_end", "in_end")
    opened = lambda begins: F.max(F.when(~F.col(begins), F.col("at")))
    splits = marked.groupBy("path", "start").agg(F.max(last).alias("last"), opened("out_in").alias("out_open"), opened("in_in").alias("in_open")).collect()
    begins: dict = {}
    tail: dict = {}
    by_file = defaultdict(list)
    for r in splits:
        by_file[r.path].append(r)
    for path, own in by_file.items():
        inside, opener = False, None
        for r in sorted(own, key=lambda r: r.start):
            begins[path, r.start] = (inside, *(opener or (None, None)))
            here = r.in_open if inside else r.out_open
            opener = (r.start, here) if here is not None else opener
            inside = r.last.in_end if inside else r.last.out_end
        if inside:
            tail[path] = opener
    rows = [(p, s, *v, *tail.get(p, (None, None))) for (p, s), v in begins.items()]
    states = spark.createDataFrame(rows, "path string, start long, inside boolean, from_start long, from_at long, tail_start long, tail_at long")
    told = marked.join(F.broadcast(states), ["path", "start"])  # a row a split
    begin, end = (F.when(F.col("inside"), F.col(f"in_{w}")).otherwise(F.col(f"out_{w}")) for w in ("in", "end"))
    told = told.withColumn("begin", begin).withColumn("end", end)
    loose = F.col("tail_start").isNotNull() & ((F.col("start") > F.col("tail_start")) | ((F.col("start") == F.col("tail_start")) & (F.col("at") >= F.col("tail_at"))))
    alone = F.coalesce(loose, F.lit(False)) | (~F.col("begin") & ~F.col("end"))
    whole = told.where(alone).select("path", "start", "at", F.col("line").alias("record"))
    # lines of longer records meet by the line that opens them: in their own split the last one that begins outside
    parts = told.where(~alone).withColumn("own", F.when(F.col("inside"), F.col("in_from")).otherwise(F.col("out_from")))
    parts = parts.select("path", F.when(F.col("own").isNotNull(), F.col("start")).otherwise(F.col("from_start")).alias("s"), F.coalesce("own", "from_at").alias("a"), F.struct("start", "at", "line").alias("part"))
    long = parts.groupBy("path", "s", "a").agg(F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["line"]), "\n").alias("record"))
    every = whole.unionByName(long.select("path", F.col("s").alias("start"), F.col("a").alias("at"), "record"))
    return _not_blank(every)


def _without_return(line: Column) -> Column:
    return F.when(line.endswith("\r"), F.substring(line, F.lit(1), F.char_length(line) - 1)).otherwise(line)


def _not_blank(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("record", _without_return(F.col("record")))
    return rows.where(F.ltrim("record", F.lit(" \t\x0b\x0c\r")) != "")


def _parsed(dialects: dict[str, Dialect]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [fields_of(r, dialects[p].delimiter) for p, r in zip(batch.column("path").to_pylist(), batch.column("record").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fields, pa.list_(pa.string()))], names=[*batch.schema.names, "fields"])
    return run


def fields_of(record: str, delimiter: str) -> list[str]:
    """The fields of one record; a quote that stays open is closed by the record's end."""
    return next(csv.reader(_kept_lines(record), delimiter=delimiter), [])


def _kept_lines(record: str) -> list[str]:
    lines = record.split("\n")
    return [x + "\n" for x in lines[:-1]] + [lines[-1]]


def fields(rows: DataFrame, dialects: list[Dialect]) -> DataFrame:
    """``rows`` (path, record, ..) with the array fields. Records without quotes, and those of files whose lines all close, are
    split by Spark, the others in Arrow batches."""
    shared = rows.sparkSession.sparkContext.broadcast({d.path: d for d in dialects})
    quoted = F.col("record").contains('"')
    split_all = not any(d.quotes and not d.closed for d in dialects)
    plain = rows if split_all else rows.where(~quoted)
    bare = lambda p: F.when(p.startswith('"'), F.substring(p, F.lit(2), F.char_length(p) - 2)).otherwise(p)
    out = None
    for delimiter in sorted({d.delimiter for d in dialects}):
        own = [d.path for d in dialects if d.delimiter == delimiter]
        some = plain if len(own) == len(dialects) else plain.join(F.broadcast(rows.sparkSession.createDataFrame([(p,) for p in own], "path string")), "path", "left_semi")
        pieces = F.split("record", "\\" + delimiter, -1)
        if any(d.quotes and d.closed for d in dialects):
            pieces = F.when(quoted, F.transform(pieces, bare)).otherwise(pieces)
        some = some.select("*", _once(pieces).alias("fields"))
        out = some if out is None else out.unionByName(some)
    if split_all:
        return out
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", fields array<string>"
    return out.unionByName(rows.where(quoted).mapInArrow(lambda batches: _parsed(shared.value)(batches), schema))


def table(lines: DataFrame, dialects: list[Dialect], names: dict[str, list[str]], keep_headers: bool = False) -> DataFrame:
    """An all-string table of the records of all files. ``names`` are each file's column names; columns of one name are
    one column, and a file without it has nulls there.

    Records with more fields than names go, shorter ones are filled up with nulls. The first record of a file and records
    equal to its header (lower-cased, trimmed) go, unless ``keep_headers``."""
    spark = lines.sparkSession
    columns = list(dict.fromkeys(n for d in dialects for n in names[d.path]))
    rows = fields(records(lines, dialects), dialects)
    alike = len({(tuple(names[d.path]), d.header) for d in dialects}) == 1
    tidy = lambda header: [h.strip().lower() for h in header]
    if alike:  # nothing depends on the file
        width, header = F.lit(len(columns)), tidy(dialects[0].header)
        cell = lambda i: F.get("fields", F.lit(i))
    else:
        places = [(d.path, [names[d.path].index(c) if c in names[d.path] else -1 for c in columns], len(names[d.path]), tidy(d.header)) for d in dialects]
        known = spark.createDataFrame(places, "path string, places array<int>, width int, header array<string>")
        rows = rows.join(F.broadcast(known), "path")  # a row a file
        width, header = F.col("width"), F.col("header")
        cell = lambda i: F.get("fields", F.get("places", F.lit(i)))
    rows = rows.where(F.size("fields") <= width)
    if not keep_headers:
        plain = lambda x: F.lower(F.trim(F.replace(x, F.lit("\ufeff"), F.lit(""))))
        if alike:
            same = reduce(Column.__and__, [plain(F.get("fields", F.lit(i))) == h for i, h in enumerate(header)], F.size("fields") == len(header))
        else:
            first = plain(F.get("fields", F.lit(0))) == F.get(header, F.lit(0))
            same = F.coalesce(first, F.lit(False)) & (F.transform("fields", plain) == header)
        rows = rows.where(~F.coalesce(same, F.lit(False)))
    return rows.select(*[cell(i).alias(c) for i, c in enumerate(columns)])
