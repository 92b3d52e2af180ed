"""Benchmark decontamination by winnowing (operator 8). DataFrame functions only.

Every run of ``gram`` words has a hash; of each window of consecutive hashes
the smallest is kept (the first of equal ones), for documents and benchmark
items alike. Any ``span`` words that a document shares with an item hold one
whole window (gram + window - 1 words), whose kept hash is the same in both, so that the join of kept
hashes meets every shared span. Each meeting is extended word by word to both
sides, over the few words around it that a hit needs; spans of at least
``span`` words are hits.

A kept hash is 33 bits above a 30-bit position, so that the smallest long of a
window is its first smallest hash. Spans are compared by the 64-bit hashes of
their words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kept hashes of the benchmark up to which it is sent to every executor (about 0.5 KB each).
BROADCAST_ROWS = 100_000
POSITION_BITS = 30
HEADER = -1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hashes_of(text: Column) -> Column:
    """Hashes of a text's words, A-Z lower-cased: runs of digits, letters and all that is not ASCII. Null has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.transform(F.filter(F.split(low, _MARKS), lambda w: w != ""), lambda w: F.xxhash64(w))


def _places(count: Column) -> Column:
    """1 .. count, none for less than 1."""
    return F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))


def _ahead(values: Column, by: int, join: Callable[[Column, Column], Column]) -> Column:
    """Each element joined with the one ``by`` places on (null past the end)."""
    return _with(values, lambda v: F.zip_with(v, F.slice(v, by + 1, F.greatest(F.size(v) - by, F.lit(0))), join))


def kept_hashes(hashes: Column, gram: int, window: int) -> Column:
    """Winnowed (hash << POSITION_BITS | position from 0) of an array of word hashes; gram and window are powers of
    two, reached by doubling. Past the end of a text hashes and windows are shorter, which adds a few hashes."""
    width, out = 1, hashes
    while width < gram:
        out = _ahead(out, width, lambda a, b: F.xxhash64(a, b))
        width *= 2
    out = F.transform(out, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 31), POSITION_BITS).bitwiseOR(i.cast("long")))
    width = 1
    while width < window:
        out = _ahead(out, width, lambda a, b: F.least(a, b))
        width *= 2
    return F.array_distinct(out)


def _grams(hashes: Column, n: int) -> Column:
    """Every run of n hashes (whole) and where it starts."""
    return F.transform(_places(F.size(hashes) - (n - 1)), lambda i: F.struct((i - 1).alias("start"), F.slice(hashes, i, F.lit(n)).alias("whole")))


def _seeds(rows: DataFrame, gram: int, window: int, header: bool) -> DataFrame:
    """A row for each kept hash of ``rows`` (columns h and others): key and at (position). With ``header``, one more
    for each input row, of key HEADER."""
    kept = kept_hashes(F.col("h"), gram, window)
    if header:
        kept = F.concat(F.array(F.lit(HEADER).cast("long")), kept)
    # a column of its own, so that the explosion is compiled and copies no h; outer, so that no filter computes it twice
    out = rows.withColumn("kept", kept).withColumn("code", F.explode_outer("kept")).drop("kept")
    at = F.col("code").bitwiseAND(F.lit((1 << POSITION_BITS) - 1).cast("long")).cast("int")
    out = out.withColumn("key", F.shiftright("code", POSITION_BITS)).withColumn("at", at)
    return out.drop("code")


def _near(rows: DataFrame, gram: int, reach: int) -> DataFrame:
    """``rows`` with near, the hashes around position at, and lead, that position in near, in place of h."""
    first = F.greatest(F.col("at") - reach, F.lit(0))
    header = F.col("key") == HEADER
    near = F.when(header, F.array().cast("array<bigint>")).otherwise(F.slice("h", F.when(header, 1).otherwise(first + 1), F.lit(2 * reach + gram)))
    return rows.withColumn("near", near).withColumn("lead", F.col("at") - first).drop("h")


def _extend(gram: int) -> Column:
    """struct(left, right): how far near and b_near agree on both sides of a meeting; null if not in the meeting itself."""
    back = F.least("lead", "b_lead")
    whole = F.least(F.size("near") - F.col("lead"), F.size("b_near") - F.col("b_lead")) + back
    part = lambda c, lead: F.slice(c, F.col(lead) - back + 1, F.greatest(whole, F.lit(0)))
    equal = F.zip_with(part("near", "lead"), part("b_near", "b_lead"), lambda a, b: a == b)

    def run(flags: Column) -> Column:
        stop = F.array_position(flags, F.lit(False)).cast("int")
        return F.when(stop > 0, stop - 1).otherwise(F.size(flags))

    left = lambda e: run(F.reverse(F.slice(e, F.lit(1), back)))
    right = lambda e: run(F.slice(e, back + 1 + gram, F.greatest(F.size(e) - back - gram, F.lit(0))))
    meets = lambda e: (F.size(e) >= back + gram) & ~F.array_contains(F.slice(e, back + 1, F.lit(gram)), F.lit(False))
    return _with(equal, lambda e: F.when(meets(e), F.struct(left(e).alias("left"), right(e).alias("right"))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  gram: int = 4, span: int = 13, share: int = 20) -> DataFrame:
    """One row per row of ``docs``: id, digest (xxhash64 of the text), n_words, n_hit (words inside a shared span of
    ``span`` words, or of a whole item with fewer), items (ids of the items with shared spans, as sorted strings),
    spans (start and length of each), contaminated (n_hit > 0 and share * n_hit >= n_words).

    Null and empty texts have no words; items without words match nothing; an item with a null id hits but is not
    listed; items with equal ids are listed once. Rows with equal ids are judged each by its own text. Empty tables
    work; other columns are not read.
    """
    reach = span - gram
    window = 1 << (reach + 1).bit_length() - 1  # gram + window - 1 words of a shared span suffice
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("digest"), hashes_of(F.col("text")).alias("h")).withColumn("n_words", F.size("h").cast("long"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), hashes_of(F.col(text_col).cast("string")).alias("h"))
    marks = _near(_seeds(items.where(F.size("h") >= span), gram, window, False), gram, reach)
    marks = marks.select("item", *[F.col(c).alias(f"b_{c}") for c in ("key", "near", "lead")]).distinct()
    header = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("item"), F.lit(HEADER).cast("long").alias("b_key"),
                                               F.array().cast("array<bigint>").alias("b_near"), F.lit(0).alias("b_lead"))
    small = marks.count() <= BROADCAST_ROWS
    marks = marks.unionByName(header)
    seeds = _seeds(rows, gram, window, True)
    if small:  # words around a hash are cut out where it meets the benchmark only
        met = _near(seeds.join(F.broadcast(marks), F.col("key") == F.col("b_key")), gram, reach)
    else:  # or before the shuffle, which then moves no whole texts
        met = _near(seeds, gram, reach).join(marks, F.col("key") == F.col("b_key"))
    met = met.withColumn("header", F.col("key") == HEADER).withColumn("far", _extend(gram))
    # a meeting that is no hit stays as a row without span and item: a filter would move into the join and stop its compilation
    hit = ~F.col("header") & (F.col("far.left") + F.col("far.right") >= reach)
    start, length = F.col("at") - F.col("far.left"), F.col("far.left") + F.col("far.right") + gram
    met = met.select("id", "digest", "n_words", F.when(hit, F.col("item")).alias("item"), F.when(hit, F.struct(start.alias("start"), length.alias("length"))).alias("span"), "header")
    short = items.where((F.size("h") > 0) & (F.size("h") < span))
    sizes = [r.n for r in short.select(F.size("h").alias("n")).distinct().collect()]  # at most span - 1
    for n in sorted(sizes):
        some = short.where(F.size("h") == n).select("item", F.col("h").alias("whole"), F.xxhash64("h").alias("key")).distinct()
        grams = _grams(F.col("h"), n)
        found = rows.select("id", "digest", "n_words", F.explode(grams).alias("g")).select("id", "digest", "n_words", F.col("g.start").alias("start"), F.col("g.whole").alias("own"), F.xxhash64("g.whole").alias("own_key"))
        few = some.count() <= BROADCAST_ROWS
        found = found.join(F.broadcast(some) if few else some, (F.col("own_key") == F.col("key")) & (F.col("own") == F.col("whole")))
        met = met.unionByName(found.select("id", "digest", "n_words", "item", F.struct("start", F.lit(n).alias("length")).alias("span"), F.lit(False).alias("header")))
    by_row = met.groupBy("id", "digest", "n_words").agg(
        F.collect_set("span").alias("spans"), F.array_sort(F.collect_set("item")).alias("items"), F.sum(F.col("header").cast("int")).alias("copies"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    by_row = by_row.withColumn("n_hit", F.size(covered).cast("long"))
    each = by_row.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("id", "digest", "n_words", "n_hit", "items", "spans", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
