"""URL filters: listed URLs behind a blocked Bloom filter, confirmed by an exact join; site rules come first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
#: Bits of the filter for each listed URL; 16 give about 1 false hit in 1,000.
BITS_PER_URL = 16
#: Most blocks of 512 bits: the filter stays at 64 MB whatever the list. A fuller filter lets more through to the exact join.
MOST_BLOCKS = 1 << 20
#: Names of sites whose pages the query lists (fixed values of the given tables).
LISTED_SITES = ("spam-farm", "cheap-pills")
#: (host, path, verdict), fixed values.
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url)))
    return F.translate(
        F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without its ending slash: one form for the addresses of a page."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, "/+$", ""))


def site_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict. A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for site, start, said in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == site) | F.endswith(host, F.lit("." + site))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, F.lit(site + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _masks(url: Column) -> list[Column]:
    """One bit in each of the eight words of a block."""
    h = F.xxhash64(url, F.lit("bits"))
    place = [F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in place]


def bloom_blocks(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """The blocks that hold a bit: at most ``blocks`` rows of nine numbers."""
    bits = listed.select(_block(F.col(url), blocks).alias("block"), *[m.alias(f"m{k}") for k, m in enumerate(_masks(F.col(url)))])
    return bits.groupBy("block").agg(*[F.bit_or(f"m{k}").alias(f"w{k}") for k in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, maybe_listed, is_listed) of every page.

    ``listed`` has a column ``url`` with addresses in canonical form; null and repeated ones do no harm. A page takes the
    verdict of its rule, else ``block`` if its canonical address is listed and ``allow`` if not. Null URLs and those
    without ``://`` have empty host and path, no rule, and are allowed. The Bloom filter is sized by the list and has an
    upper bound, so it is broadcast; only its hits are shuffled, and the exact join removes the false ones.
    """
    listed = listed.select(F.col("url").cast("string").alias("listed_url")).where("listed_url is not null and listed_url <> ''").distinct()
    blocks = max(1, min(MOST_BLOCKS, -(-listed.count() * BITS_PER_URL // (64 * WORDS))))
    host, path = url_host(F.col(f"`{url}`").cast("string")), url_path(F.col(f"`{url}`").cast("string"))
    parsed = pages.select(F.col(f"`{key}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = site_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("*", rule.alias("rule"), verdict.alias("said"), canonical(F.col("host"), F.col("path")).alias("at"))
    parsed = parsed.withColumn("block", _block(F.col("at"), blocks))
    tested = parsed.join(F.broadcast(bloom_blocks(listed, "listed_url", blocks)), "block", "left")
    hit = F.lit(True)
    for k, mask in enumerate(_masks(F.col("at"))):
        hit = hit & (F.col(f"w{k}").bitwiseAND(mask) == mask)
    tested = tested.withColumn("maybe_listed", F.coalesce(hit, F.lit(False))).drop("block", *[f"w{k}" for k in range(WORDS)])
    passed = tested.where("maybe_listed").join(listed.withColumn("is_listed", F.lit(True)), F.col("at") == F.col("listed_url"), "left")
    passed = passed.withColumn("is_listed", F.coalesce("is_listed", F.lit(False))).drop("listed_url")
    both = tested.where("not maybe_listed").withColumn("is_listed", F.lit(False)).unionByName(passed)
    verdict = F.coalesce("said", F.when(F.col("is_listed"), "block").otherwise("allow"))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "maybe_listed", "is_listed")


def listed_sites(pages: DataFrame, sites: Sequence[str] = LISTED_SITES, url: str = "url") -> DataFrame:
    """The list of the query: canonical addresses of all pages of the named sites."""
    host, path = url_host(F.col(f"`{url}`").cast("string")), url_path(F.col(f"`{url}`").cast("string"))
    seen = pages.select(host.alias("host"), canonical(host, path).alias("url"))
    return seen.where(F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, sites)))).select("url").distinct()
