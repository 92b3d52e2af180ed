"""URL filter: rules, and a blocked Bloom filter before an exact join (operator 6). DataFrame functions only.

Listed URLs are brought into one canonical form. A Bloom filter of 256-bit
blocks (four longs, two bits in each) tells which rows may be listed; only those
go on to the exact hash join with the list, which removes false positives. The
filter is a table of at most MOST_BLOCKS rows, 12 MB, whatever the list; a
fuller filter passes more rows to the join and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each listed URL, and blocks at most.
BITS_A_URL, BLOCK_BITS, MOST_BLOCKS = 16, 256, 1 << 18
WORDS = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for the spellings of a page: no scheme, www., m., default port, fragment, tracking parameter, order of
    parameters, trailing slash or .html. Null for null and for URLs without a host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), r":(80|443)?$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/+$", ""), r"\.html?$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref|fbclid|gclid)(=|$)")))
    asked = F.array_join(kept, "&")
    return F.when(host_of(url) != "", F.concat(host, path, F.when(asked == "", "").otherwise(F.concat(F.lit("?"), asked))))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host, path) that fits, as host and path together, and its verdict; null if none.
    A rule fits its host and all subdomains if the path starts with its own; of rules as long, the first counts."""
    rule = verdict = None
    for says, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def _masks(name: str) -> list[Column]:
    """The bits of a URL in each word of its block."""
    h = F.xxhash64(F.lit(1), F.col(name))
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return [bit(12 * i).bitwiseOR(bit(12 * i + 6)) for i in range(WORDS)]


def blocked_bloom(listed: DataFrame, name: str, blocks: int) -> DataFrame:
    """(block, w0..w3): the filter of the values of a column."""
    rows = listed.where(F.col(name).isNotNull()).select(F.pmod(F.xxhash64(name), F.lit(blocks)).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks(name))])
    return rows.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, url, host, path, rule, verdict (allow or block), canonical, listed.

    listed: a column url of blocked URLs, in any spelling; null and hostless ones block nothing. A rule's verdict comes
    before the list's. Null and hostless URLs have empty host and path and are allowed. Repeated rows are judged each;
    empty tables (either one) work; other columns are not read.
    """
    bad = listed.select(canonical(F.col("url").cast("string")).alias("canonical")).where("canonical is not null").distinct()
    blocks = min(MOST_BLOCKS, 1 << (BITS_A_URL * bad.count() // BLOCK_BITS).bit_length())
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("said"), F.pmod(F.xxhash64("canonical"), F.lit(blocks)).alias("block"))
    # at most MOST_BLOCKS rows of five longs
    probed = rows.join(F.broadcast(blocked_bloom(bad, "canonical", blocks)), "block", "left")
    hit = F.lit(True)
    for i, m in enumerate(_masks("canonical")):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
    probed = probed.select(*[c for c in rows.columns if c != "block"], (F.col("canonical").isNotNull() & F.coalesce(hit, F.lit(False))).alias("maybe"))
    never = probed.where(~F.col("maybe")).withColumn("listed", F.lit(False))
    maybe = probed.where("maybe").join(bad.withColumn("listed", F.lit(True)), "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    own = F.coalesce("said", F.when(F.col("listed"), "block").otherwise("allow"))
    return never.unionByName(maybe).select("id", "url", "host", "path", "rule", own.alias("verdict"), "canonical", "listed")
