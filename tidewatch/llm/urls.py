"""URL filters: path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter of the listed URLs is a table of blocks of 512 bits, eight words of
64 bits. A URL belongs to one block and sets one bit in each of its words. A
page's URL looks up its block by an equi-join; where all eight bits are set the
page is a possible hit, and only possible hits go on to the exact join with
the list, which removes the false positives. Both tables grow with the list, so
Spark decides by their size whether to broadcast them.

Cases: a null URL or one without ``://`` has an empty host and path, no rule and
no listed URL, and is allowed; empty lists allow all; URLs and rules may
repeat; an empty table gives no rows. Of other columns none is looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialise

#: Verdict, host, path; fixed by the contract of the query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Names of hosts whose pages make the list of the query.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
WORDS = 8
BITS_PER_URL = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One form of a URL's page: no scheme, ``www.``, query, fragment, or slash at the end."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def rule_verdict(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (struct of length, rule, verdict), or null.

    A rule fits its host and the host's subdomains. Of rules of one length the first by text wins.
    """
    fits = []
    for verdict, rule_host, rule_path in rules:
        here = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        # The order of structs: longest first, then text.
        fits.append(F.when(here, F.struct(F.lit(-len(rule_host) - len(rule_path)).alias("length"), F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_min(F.filter(F.array(*fits), lambda x: x.isNotNull())) if fits else F.lit(None)


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("block")), F.lit(blocks))


def _bit(url: Column, word: int) -> Column:
    """The bit of a URL in one word of its block: six bits of one hash."""
    place = F.shiftrightunsigned(F.xxhash64(url, F.lit("bits")), 6 * word + 3).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom_blocks(listed: DataFrame) -> tuple[DataFrame, int]:
    """The filter of distinct ``listed`` (url): block, w0 to w7; and its number of blocks."""
    blocks = max(1, -(-listed.count() * BITS_PER_URL // (64 * WORDS)))
    bits = listed.select(_block(F.col("url"), blocks).alias("block"), *[_bit(F.col("url"), k).alias(f"w{k}") for k in range(WORDS)])
    return materialise(bits.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)]), "bloom"), blocks


def filter_listed(rows: DataFrame, listed: DataFrame, column: str = "url_key") -> DataFrame:
    """Add ``listed``: whether the row's canonical URL is among the distinct ``listed`` (url)."""
    bloom, blocks = bloom_blocks(listed)
    at = rows.withColumn("block", _block(F.col(column), blocks)).join(bloom, "block", "left")
    hit = F.lit(True)
    for k in range(WORDS):
        bit = _bit(F.col(column), k)
        hit = hit & (F.col(f"w{k}").bitwiseAND(bit) == bit)
    tested = materialise(at.withColumn("possible", F.coalesce(hit, F.lit(False))).select(*rows.columns, "possible"), "bloom-tested")
    exact = listed.select(F.col("url").alias("exact")).hint("shuffle_hash")
    hits = tested.where("possible").join(exact, F.col(column) == F.col("exact"), "left")
    return tested.where("not possible").select(*rows.columns, F.lit(False).alias("listed")).unionByName(
        hits.select(*rows.columns, F.col("exact").isNotNull().alias("listed")))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, and whether the list has the URL.

    ``listed``: canonical URLs to block, in a column ``url``; they may repeat.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("url_key", canonical(F.col("host"), F.col("path")))
    exact = materialise(listed.select("url").where("url <> ''").distinct(), "bloom-list")
    ruled = rule_verdict(F.col("host"), F.col("path"), rules)
    found = filter_listed(rows, exact).withColumn("fit", ruled)
    return found.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def listed_urls(pages: DataFrame, names=LISTED_NAMES) -> DataFrame:
    """The query's list: canonical URLs of the pages on hosts with a listed name."""
    host = host_of("url")
    named = F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, names)))
    return pages.where(named).select(canonical(host, path_of("url")).alias("url"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, listed_urls(pages))


def _sql_rules() -> str:
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"(VALUES {rows}) AS r(verdict, host, path)"


OP6_SQL = f"""
WITH u AS (SELECT page_id, lower(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)) AS host,
    regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
    regexp_replace(coalesce(host, ''), '^www\\.', '') || regexp_replace(coalesce(path, ''), '/+$', '') AS url FROM u),
listed AS (SELECT DISTINCT url FROM p
  WHERE list_has_any(string_split(host, '.'), [{", ".join(f"'{n}'" for n in LISTED_NAMES)}]) AND url <> ''),
fits AS (SELECT page_id, p.host, p.path, p.url, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY page_id, p.host, p.path ORDER BY length(r.host || r.path) DESC, r.host || r.path) AS k
  FROM p JOIN {_sql_rules()} ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE WHEN l.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.url IS NOT NULL AS listed
FROM p LEFT JOIN fits f ON f.page_id = p.page_id AND f.host = p.host AND f.path = p.path AND f.k = 1
LEFT JOIN listed l ON l.url = p.url
"""
