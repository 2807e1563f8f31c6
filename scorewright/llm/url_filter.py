"""URL filter: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter.

A rule fits its host and all subdomains where the URL's path starts with the rule's; the longest
fitting rule decides. Other URLs are judged by the list: a canonical URL that is listed is blocked.
The list's Bloom filter has one 64-bit word per block; a URL's hash picks a block and eight bits of
its word. Words are OR-ed by block in a grouped aggregate and probed by an equality join on the block
number. Up to ``MOST_BLOCKS`` words are broadcast; beyond that pages and words are dealt out by block.
Only the possible hits then go into an exact hash join with the list on the canonical URL, which
removes the false positives. Pages that a rule decides, or that have no canonical URL, are never probed.

Canonical: lower-case host without ``www.`` or ``m.`` and default port, path without trailing
slashes, query without tracking parameters in sorted order, no scheme and no fragment.

Null URLs (very long ones are like others) and URLs without ``://`` have empty host and path: no rule fits, and they are never
listed, so they are allowed. Repeated pages are each judged. Null entries of the list are ignored,
repeated ones count once. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, materialise, table


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
TRACKING = ("ref", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")
#: Characters of HTML below which a page is thin.
THIN = 1_500
BITS_PER_URL = 16
PROBES = 8
#: Words up to which the filter is broadcast: 16 bytes each, for 4 listed URLs.
MOST_BLOCKS = 1 << 20


def host(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit(""))
    return ascii_lower(rest)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct<name, verdict> of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def canonical(url: Column) -> Column:
    """Canonical form, or null for what has no ``://``."""
    site = F.regexp_replace(F.regexp_replace(host(url), ":(80|443)?$", ""), r"^(www|m)\.", "")
    where = F.regexp_replace(path(url), "/+$", "")
    query = F.regexp_extract(url, r"(?s)://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
    asked = let(kept, lambda k: F.when(F.size(k) > 0, F.concat(F.lit("?"), F.array_join(k, "&"))).otherwise(""))
    return F.when(F.contains(url, F.lit("://")), F.concat(site, where, asked))


def _mask(url: Column) -> Column:
    """``PROBES`` bits of a 64-bit word, six bits of a hash each."""
    h = F.xxhash64(url, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(PROBES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def bloom(listed: DataFrame) -> tuple[DataFrame, int]:
    """((block, word), number of blocks) of the listed URLs (url: canonical, distinct)."""
    blocks = max(1, -(-listed.count() * BITS_PER_URL // 64))
    words = listed.groupBy(_block(F.col("url"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("url"))).alias("word"))
    return materialise(words, "url-bloom"), blocks


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. ``listed``: a column ``url`` of canonical URLs."""
    listed = materialise(listed.select(F.col("url").cast("string").alias("url")).where("url is not null").distinct(), "url-list")
    words, blocks = bloom(listed)
    url = pages["url"].cast("string")
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("_url"))
    rows = rows.withColumn("_rule", rule(F.col("host"), F.col("path"), rules))
    open_ = F.col("_rule").isNull() & F.col("_url").isNotNull()
    words = F.broadcast(words) if blocks <= MOST_BLOCKS else words
    mask = F.col("word").bitwiseAND(_mask(F.col("_url"))) == _mask(F.col("_url"))
    probed = rows.where(open_).join(words, _block(F.col("_url"), blocks) == words["block"], "left").withColumn("_maybe", F.coalesce(mask, F.lit(False)))
    exact = listed.select(F.col("url").alias("_listed")).hint("shuffle_hash")
    hits = probed.where("_maybe").join(exact, F.col("_url") == F.col("_listed"), "left")
    verdict = F.when(F.col("_listed").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    out = lambda df, rule, verdict: df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    none, allow = F.lit(None).cast("string"), F.lit("allow")
    ruled = out(rows.where(~open_), F.col("_rule.name"), F.coalesce("_rule.verdict", allow))
    return ruled.unionByName(out(probed.where("not _maybe"), none, allow)).unionByName(out(hits, none, verdict))


def thin(pages: DataFrame) -> DataFrame:
    """The list of the registered query: canonical URLs that have been seen with a thin page, under any spelling. Any other list can be passed to ``judge``."""
    found = pages.where(F.length(pages["html"].cast("string")) < THIN)
    return found.select(canonical(found["url"].cast("string")).alias("url"))


def query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return judge(pages, thin(pages))


_LOWER = "translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{{{i}}}'" for i, r in sorted(enumerate(RULES), key=lambda x: (-len(x[1].name), x[1].name)))
_NAME = "CASE " + _FITS.format(*[r.name for r in RULES]) + " END"
_VERDICT = "CASE " + _FITS.format(*[r.verdict for r in RULES]) + " END"
SQL = f"""
WITH page AS (
  SELECT page_id, coalesce({_LOWER % "regexp_extract(url, '://([^/?#]*)', 1, 's')"}, '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '://[^?#]*\\?([^#]*)', 1, 's'), '&'), lambda p: p <> '' AND string_split(p, '=')[1] NOT IN {TRACKING})) AS asked, coalesce(contains(url, '://'), false) AS real, coalesce(length(html) < {THIN}, false) AS thin
  FROM pages
), canon AS (
  SELECT *, CASE WHEN real THEN regexp_replace(regexp_replace(host, ':(80|443)?$', ''), '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS url FROM page
), listed AS (
  SELECT DISTINCT url AS l FROM canon WHERE url IS NOT NULL AND thin
)
SELECT page_id, host, path, {_NAME} AS rule, coalesce({_VERDICT}, CASE WHEN l IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM canon LEFT JOIN listed ON url = l
"""
