"""Raw lines of files in any store, compressed or not, and what their bytes say.

Spark's text source hands out the bytes between line feeds unchanged, splits large files and reads every store that
Spark does; the bytes of a file in order are its rows sorted by (split start, place). On that rest

- the members of zip archives and gzip streams: one task reads an archive's rows in order and inflates it chunk by
  chunk, so that neither archive nor member has to fit into memory;
- the byte profile of every file: counts that tell its encoding, over all of its (decompressed) bytes, added up by file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are inflated at once.
CHUNK = 1 << 16
LINES = "path string, start long, bytes binary"
PACKED = (b"PK\x03\x04", b"\x1f\x8b")  # the first bytes of zip and gzip files
# Member names that are taken for tables when an archive has several (fixed values).
TABLE_SUFFIXES = (".csv", ".txt", ".tsv")


def stored_lines(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """(path, start, bytes) of every line of files as they are stored (``.gz`` files inflated); start: of the file's split.
    In UTF-16 a line feed has two bytes; the encoding says which. (One character U+0Axx before one U+xx00 looks alike.)"""
    rows = spark.read.option("lineSep", "\n").option("encoding", encoding).option("recursiveFileLookup", "true").text(paths)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("bytes"))


# ---------------------------------------------------------------- S3 archives


class Stream:
    """Bytes of a file from its lines, one after the other."""

    def __init__(self, lines: Iterator[bytes]):
        self.lines, self.held = lines, b""

    def some(self, most: int = CHUNK) -> bytes:
        """At most ``most`` bytes; none at the end."""
        while not self.held:
            gathered, size = [], 0
            for line in self.lines:
                gathered += (line, b"\n")
                size += len(line) + 1
                if size >= CHUNK:
                    break
            if not gathered:
                return b""
            self.held = b"".join(gathered)
        out, self.held = self.held[:most], self.held[most:]
        return out

    def exactly(self, n: int) -> bytes:
        out = b""
        while len(out) < n and (got := self.some(n - len(out))):
            out += got
        return out

    def back(self, data: bytes) -> None:
        self.held = data + self.held


def _inflated(source: Stream, bits: int) -> Iterator[bytes]:
    """One deflate stream; what follows it stays in the source."""
    z = zlib.decompressobj(bits)
    while not z.eof:
        data = z.unconsumed_tail or source.some()
        if not data:
            raise ValueError("the archive ends inside a member")
        if out := z.decompress(data, CHUNK):
            yield out
    source.back(z.unused_data)


def gunzipped(source: Stream) -> Iterator[bytes]:
    """All members of a gzip stream; anything else behind them is left out, as a line feed added at the end is."""
    while (head := source.exactly(2)) == b"\x1f\x8b":
        source.back(head)
        yield from _inflated(source, 31)


def zip_entries(source: Stream) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(name, content) of every member by its local header; a content that is not read is skipped. Members that are
    encrypted, or compressed by other means than deflate, are errors when read."""
    while source.exactly(4) == b"PK\x03\x04":
        _, flags, method, _, _, _, packed, size, names, extras = struct.unpack("<HHHHHIIIHH", source.exactly(26))
        if not names:
            raise ValueError("a member without a name")
        name = source.exactly(names).decode("utf-8" if flags & 0x800 else "cp437")
        extra = source.exactly(extras)
        long = False
        while len(extra) >= 4:
            tag, n = struct.unpack("<HH", extra[:4])
            if tag == 1:  # 64-bit sizes: of the content first, then packed
                long = True
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                size = next(wide) if size == 0xFFFFFFFF else size
                packed = next(wide) if packed == 0xFFFFFFFF else packed
            extra = extra[4 + n :]

        def content(flags=flags, method=method, packed=packed) -> Iterator[bytes]:
            if flags & 1 or method not in (0, 8) or (method == 0 and flags & 8):
                raise ValueError("encrypted, or packed in a way that can't be read in order")
            if method == 8:
                yield from _inflated(source, -15)
                return
            left = packed
            while left and (got := source.some(min(left, CHUNK))):
                left -= len(got)
                yield got

        body = content()
        yield name, body
        if flags & 1 or method not in (0, 8):
            if flags & 8:
                return  # nothing says where it ends
            left = packed
            while left and (got := source.some(min(left, CHUNK))):
                left -= len(got)
        else:
            for _ in body:
                pass
        if flags & 8:
            mark = source.exactly(4)
            rest = source.exactly(20 if long else 12)
            if mark != b"PK\x07\x08":  # the mark may be left out
                source.back(mark + rest)
                source.exactly(20 if long else 12)
            elif long is False and source.held[:2] != b"PK" and len(source.held) >= 10 and source.held[8:10] == b"PK":
                source.exactly(8)


def _by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(path, its lines) of rows that are sorted by path. Each file's lines are to be read before the next one's."""
    rows = ((p, b) for batch in batches for p, b in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist(), strict=True))
    now = next(rows, None)

    def lines(path: str) -> Iterator[bytes]:
        nonlocal now
        while now is not None and now[0] == path:
            yield now[1]
            now = next(rows, None)

    while now is not None:
        path = now[0]
        own = lines(path)
        yield path, own
        for _ in own:
            pass


def _in_order(rows: DataFrame, parts: int) -> DataFrame:
    """All rows of a file in one task, in order."""
    return rows.withColumn("at", F.monotonically_increasing_id()).repartition(max(1, parts), "path").sortWithinPartitions("path", "start", "at").drop("at")


def zip_members(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, number, member) of every file in zip archives, in archive order; an archive that can't be read has one row
    without a member."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, lines in _by_file(batches):
            names: list[str | None] = []
            try:
                names += [name for name, _ in zip_entries(Stream(lines)) if not name.endswith("/")]
            except (ValueError, struct.error, zlib.error):
                names.append(None)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(names), pa.string()), pa.array(range(len(names)), pa.int32()), pa.array(names, pa.string())], names=["path", "number", "member"])

    return _in_order(stored_lines(spark, paths), len(paths)).mapInArrow(run, "path string, number int, member string")


def choose_members(spark: SparkSession, paths: list[str]) -> dict[str, str | None]:
    """S3: of each archive the only member, else the first whose name is a table's; None if there is no such. One row an
    archive reaches the driver."""
    members = zip_members(spark, paths)
    table = reduce(lambda a, b: a | b, [F.lower("member").endswith(s) for s in TABLE_SUFFIXES])
    first = members.groupBy("path").agg(F.count("*").alias("n"), F.count("member").alias("known"), F.min("member").alias("only"), F.min(F.when(table, F.struct("number", "member"))).alias("table"))
    out: dict[str, str | None] = dict.fromkeys(paths)
    for r in first.collect():
        out[r.path] = r.only if r.n == 1 and r.known == 1 else r.table.member if r.table else None
    return out


def inflated_lines(spark: SparkSession, chosen: dict[str, str | None], encoding: str = "UTF-8") -> DataFrame:
    """The lines of archives' chosen members, and of gzip files (member None). One task reads an archive, in chunks; files of
    any number are read side by side."""
    feed = {"UTF-16LE": b"\n\x00", "UTF-16BE": b"\x00\n"}.get(encoding, b"\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, lines in _by_file(batches):
            source = Stream(lines)
            member = chosen[path]
            body = gunzipped(source) if member is None else next((c for name, c in zip_entries(source) if name == member), iter(()))
            rest: list[bytes] = []
            for data in body:
                if feed[0] not in data:
                    rest.append(data)
                    continue
                whole = _split(b"".join([*rest, data]), feed)
                rest = [whole.pop()]
                if whole:
                    yield _lines(path, whole)
            if last := b"".join(rest):
                yield _lines(path, [last])

    return _in_order(stored_lines(spark, list(chosen)), len(chosen)).mapInArrow(run, LINES)


def _split(data: bytes, feed: bytes) -> list[bytes]:
    """At line feeds that begin at a whole character."""
    parts = data.split(feed)
    if len(feed) == 1:
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        if len(out[-1]) % 2:
            out[-1] += feed + p
        else:
            out.append(p)
    return out


def _lines(path: str, lines: list[bytes]) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([0] * n, pa.int64()), pa.array(lines, pa.binary())], names=["path", "start", "bytes"])


# ---------------------------------------------------------------- S4 encoding

_COUNTS = ["n_lines", "n_bytes", "high_lines", "bad_lines", "n_high", "n_control", "n_undefined", "n_letters", "n_quotes", "n_nul", "n_wide", "nul_even", "nul_odd"]
_UNDEFINED = [0x81, 0x8D, 0x8F, 0x90, 0x9D]  # bytes without a character in code page 1252 (fixed values)
_LETTERS = np.r_[0xC0:0xD7, 0xD8:0xF7, 0xF8:0x100]
_WIDE = [*range(0xD8, 0xE0), 0xFE]  # bytes that surrogates and byte order marks of UTF-16 have
#: Lines at the beginning of a file that tell its delimiter.
HEAD_LINES = 10
#: Files whose first bytes are read side by side.
HEADS_AT_ONCE = 16


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each run of lines of one split; the first lines of a file come along, whole records at least."""
    key, counts, head, quotes = None, None, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), *[pa.array([int(c)], pa.int64()) for c in counts], pa.array([head or None], pa.list_(pa.binary()))], names=["path", "start", *_COUNTS, "head"])

    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch.column("path").dictionary_encode(), batch.column("start").to_numpy()
        file = files.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (starts[1:] != starts[:-1])) + 1).tolist(), len(file)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = files.dictionary[int(file[a])].as_py(), int(starts[a])
            if now != key:
                if key is not None:
                    yield row()
                key, counts, head, quotes = now, np.zeros(len(_COUNTS), np.int64), [], 0
                if now[1] == 0:  # behind the first line feed both UTF-16 forms look alike
                    first = batch.column("bytes")[a].as_py()
                    counts[-2:] = first[::2].count(0), first[1::2].count(0)
            lines = batch.column("bytes").slice(a, b - a)
            counts += _counts(lines)
            if key[1] == 0:
                for i in range(a, b):
                    if len(head) >= HEAD_LINES and quotes % 2 == 0:
                        break
                    head.append(batch.column("bytes")[i].as_py())
                    quotes += head[-1].count(b'"')
    if key is not None:
        yield row()


def _counts(lines: pa.Array) -> np.ndarray:
    # the bytes of all lines lie one after the other
    ends = np.frombuffer(lines.buffers()[1], np.int64 if pa.types.is_large_binary(lines.type) else np.int32)[lines.offset : lines.offset + len(lines) + 1]
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    seen = np.bincount(data, minlength=256)
    high = bad = 0
    if seen[0x80:].any():
        for line in lines.to_pylist():
            if not line.isascii():
                high += 1
                try:
                    line.decode("utf-8")
                except UnicodeDecodeError:
                    bad += 1
    return np.array([len(lines), len(data) + len(lines), high, bad, seen[0x80:].sum(), seen[0x80:0xA0].sum(), seen[_UNDEFINED].sum(), seen[_LETTERS].sum(), seen[ord('"')], seen[0], seen[_WIDE].sum(), 0, 0])


def byte_profiles(lines: DataFrame) -> DataFrame:
    """(path, counts over all bytes of the file, head): one row for each file of ``lines`` (path, start, bytes)."""
    parts = lines.mapInArrow(_profile, "path string, start long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", head array<binary>")
    return parts.groupBy("path").agg(*[F.sum(c).alias(c) for c in _COUNTS], F.min_by("head", "start").alias("head"))


def is_ascii() -> Column:
    """Whether a line's bytes are ASCII alone."""
    text = F.col("bytes").cast("string")
    return F.is_valid_utf8(text) & (F.octet_length(text) == F.char_length(text))


def line_counts(lines: DataFrame) -> DataFrame:
    """(path, counts) of each file of ``lines`` that tell UTF-8 and UTF-16, by Spark's expressions alone."""
    text = F.col("bytes").cast("string")
    size = F.octet_length
    count = lambda x: F.when(text.contains(x), size(text) - size(F.replace(text, F.lit(x), F.lit("")))).otherwise(0)
    rows = lines.select("path", size("bytes").alias("n"), F.is_valid_utf8(text).alias("valid"), is_ascii().alias("ascii"), count('"').alias("n_quotes"), count("\0").alias("n_nul"))
    number = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("path").agg(F.count("*").alias("n_lines"), number(F.col("n") + 1).alias("n_bytes"), number(~F.col("ascii")).alias("high_lines"),
                                    number(~F.col("valid")).alias("bad_lines"), number(F.col("n_quotes")).alias("n_quotes"), number(F.col("n_nul")).alias("n_nul"))


def byte_counts(lines: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(path, counts) of each file of ``lines``: the ``names`` of those that classes of bytes beyond ASCII have, by Spark's expressions
    alone."""
    latin, size = F.col("latin"), F.octet_length  # a character a byte, of two bytes from 80 on
    rows = lines.where(~is_ascii()).select("path", size("bytes").alias("n"), F.decode("bytes", "ISO-8859-1").alias("latin"))
    of = lambda codes: (size(latin) - size(F.regexp_replace(latin, "[" + "".join(map(chr, codes)) + "]", ""))) / 2
    rows = rows.select("path", "latin", (size(latin) - F.col("n")).alias("n_high"), of(_LETTERS.tolist()).alias("n_letters"))
    rest = F.col("n_high") > F.col("n_letters")
    own = {"n_high": F.col("n_high"), "n_letters": F.col("n_letters"), "n_control": F.when(rest, of(range(0x80, 0xA0))).otherwise(0), "n_undefined": F.when(rest, of(_UNDEFINED)).otherwise(0),
           "n_wide": F.when(F.col("n_letters") > 0, of(_WIDE)).otherwise(0)}
    return rows.groupBy("path").agg(*[F.sum(own[n].cast("long")).alias(n) for n in names])


def first_lines(spark: SparkSession, paths: list[str]) -> dict[str, list[bytes]]:
    """The first lines of files as they are stored (``.gz`` files inflated), whole records at least; only their beginning is
    read. A quote that stays open is looked for as far as the first split of a file may reach."""
    sc = spark.sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()

    def head(path: str) -> list[bytes]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        stream, codec = at.getFileSystem(conf).open(at), codecs.getCodec(at)
        try:
            stream = codec.createInputStream(stream) if codec is not None else stream
            data, more = b"", True
            while True:
                got = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, max(CHUNK, len(data)))))
                data, more = data + got, bool(got)
                lines = data.removeprefix(b"\xef\xbb\xbf").split(b"\n")
                rest = lines.pop()
                lines += [rest] if rest and not more else []
                quotes = 0
                for n, line in enumerate(lines, 1):
                    quotes += line.count(b'"')
                    if n >= HEAD_LINES and quotes % 2 == 0:
                        return lines[:n]
                if not more or len(data) >= most and lines:
                    return lines
        finally:
            stream.close()

    with ThreadPoolExecutor(HEADS_AT_ONCE) as pool:
        return dict(zip(paths, pool.map(head, paths), strict=True))


def stored_profiles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``byte_profiles`` of files as they are stored, with those counts that tell their encoding (others are zero). Spark counts
    alone; files of single bytes and of UTF-16 are read twice. One row a file reaches the driver."""
    counts = line_counts(stored_lines(spark, paths)).persist()
    found = {r.path: dict.fromkeys(_COUNTS, 0) | r.asDict() | {"head": None} for r in counts.collect()}
    for path, head in first_lines(spark, list(found)).items():
        if head:  # behind the first line feed both UTF-16 forms look alike
            found[path] |= {"nul_even": head[0][::2].count(0), "nul_odd": head[0][1::2].count(0), "head": [bytearray(x) for x in head]}

    def table() -> DataFrame:
        return spark.createDataFrame([(p, *[r[c] for c in (*_COUNTS, "head")]) for p, r in found.items()], "path string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", head array<binary>")

    told = {r.path: r.encoding for r in encodings(table()).select("path", "encoding").collect()}
    packed = {p for p, r in found.items() if r["head"] and r["head"][0].startswith(PACKED)}
    for names, own in ((("n_high", "n_control", "n_undefined", "n_letters"), ["iso-8859-1"]), (("n_wide",), ["utf-16-le", "utf-16-be"])):
        if some := sorted(p for p, e in told.items() if e in own and p not in packed):
            for r in byte_counts(stored_lines(spark, some), names).persist().collect():
                found[r.path] |= r.asDict()
    return table()


def encodings(profiles: DataFrame) -> DataFrame:
    """``profiles`` with encoding and confidence (0 to 1), decided on whole files.

    A byte order mark decides (the text source takes that of UTF-8 away itself, from files that are not inflated here).
    Otherwise a quarter of the bytes or more being zero is UTF-16 without a mark, the first line's zeros saying which; text whose lines beyond ASCII are UTF-8 for the most part is UTF-8 (confidence: their share); the rest
    is code page 1252 if bytes from 80 to 9F stand for characters there, else ISO 8859-1 (confidence: how many of the bytes
    beyond ASCII are letters or such characters). ASCII alone is UTF-8."""
    mark = F.hex(F.substring(F.element_at("head", 1), 1, 3))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    wide = share("n_nul", "n_bytes") > 0.25
    little = F.col("nul_odd") >= F.col("nul_even")
    utf8 = 1 - share("bad_lines", "high_lines")
    windows = (F.col("n_control") > 0) & (F.col("n_undefined") == 0)
    encoding = (F.when(mark == "EFBBBF", "utf-8-sig").when(mark.startswith("FFFE"), "utf-16-le").when(mark.startswith("FEFF"), "utf-16-be")
                .when(wide & little, "utf-16-le").when(wide, "utf-16-be").when(utf8 >= 0.5, "utf-8").when(windows, "cp1252").otherwise("iso-8859-1"))
    confidence = (F.when(mark.startswith("FFFE") | mark.startswith("FEFF") | (mark == "EFBBBF"), 1.0).when(wide, F.least(F.lit(1.0), 2 * share("n_nul", "n_bytes")))
                  .when(utf8 >= 0.5, utf8).otherwise(F.when(windows, (F.col("n_letters") + F.col("n_control")) / F.col("n_high")).otherwise(share("n_letters", "n_high"))))
    return profiles.withColumn("encoding", encoding).withColumn("confidence", confidence)


def line_feeds(encoding: str) -> str:
    """Which line feed an encoding has, as the text source names it."""
    return {"utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}.get(encoding, "UTF-8")


def decoded(values: pa.Array, encoding: str) -> list[str]:
    """Text of lines; what can't be decoded becomes U+FFFD."""
    if encoding in ("utf-8", "utf-8-sig"):
        try:
            return values.cast(pa.string()).to_pylist()
        except pa.ArrowInvalid:
            pass
    name = "utf-8" if encoding == "utf-8-sig" else encoding
    return [v.decode(name, "replace") for v in values.to_pylist()]


def has_quotes(lines: list[str]) -> np.ndarray:
    return pc.match_substring(pa.array(lines, pa.string()), '"').to_numpy(zero_copy_only=False)
