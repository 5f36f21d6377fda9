"""URL filter: a blocked Bloom filter before an exact hash join, in DataFrame functions only.

Listed urls are brought to a canonical form and hashed. The filter is an array of 256-bit blocks
(eight words of 32 bits, one bit in each), aggregated from the list with bit_or; a key touches one
block alone. The page side probes the filter inside the scan's projection; only possible hits reach
the hash join with the list, which removes false positives.

The filter is built once, written out, and read by the pages' tests as a scalar subquery; it is
bounded by `most_blocks` (32 MB with the default, for 25 million keys at ten bits each; a longer list gets
more false positives, and no wrong result). The list itself is broadcast only if its measured
size is under `broadcast_rows`; beyond that, possible hits (not pages) are shuffled to it.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is
not on the list: allowed. Repeated rows and page ids are judged each by itself. An empty list or
table is fine. Other columns are ignored by `judge`, and `filter_pages` returns them unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import checkpointed, lower_ascii, whole_row

#: (host, path, verdict)
Rule = tuple[str, str, str]

BLOCKS_MOST = 1 << 20  # of 32 bytes: 32 MB
BROADCAST_ROWS = 100_000
KEYS_PER_BLOCK = 24  # about 10 bits a key
SALTS = tuple((i * 0x9E3779B1 + 0x7F4A7C15) % (1 << 32) | 1 for i in range(1, 9))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_key(host: Column) -> Column:
    """Canonical url of the whole site: without port, user, a trailing dot, and the labels www and m."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "\\.?(:[0-9]*)?$", "")
    return F.concat(F.regexp_replace(bare, "^(?:(?:www|m)\\.)+(?=[^.]+\\.[^.]+)", ""), F.lit("/"))


def page_key(host: Column, path: Column) -> Column:
    """Canonical url of the page: site, then the path without doubled and closing slashes."""
    tidy = F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "(?:/index\\.html?|/)$", "")
    return F.concat(site_key(host), F.regexp_replace(tidy, "^/", ""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(key), 32), F.lit(blocks))


def bits_of(key: Column, i: int) -> Column:
    """One bit of the i-th 32-bit word, from the hash's low half."""
    low = F.xxhash64(key).bitwiseAND(F.lit((1 << 32) - 1))
    place = F.shiftright((low * F.lit(SALTS[i] >> 2)).bitwiseAND(F.lit((1 << 32) - 1)), 27)
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """One row, one array: word i of block b at b * 8 + i. keys: column key."""
    words = F.array(*[F.bit_or(bits_of(F.col("key"), i)) for i in range(8)])
    filled = keys.groupBy(block_of(F.col("key"), blocks).cast("int").alias("b")).agg(words.alias("w"))
    by_block = F.map_from_entries(F.collect_list(F.struct("b", "w")))
    none = F.array_repeat(F.lit(0).cast("long"), 8)
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.coalesce(F.try_element_at(F.col("m"), b), none)))
    # At most `blocks` rows of 8 words meet here.
    return filled.agg(by_block.alias("m")).select(whole.alias("bloom"))


def may_hold(bloom_words: Column, key: Column, blocks: int) -> Column:
    at = block_of(key, blocks).cast("int") * 8
    test = F.lit(True)
    for i in range(8):
        bit = bits_of(key, i)
        test = test & (F.get(bloom_words, at + i).bitwiseAND(bit) == bit)
    return test


def listed_keys(listed: DataFrame) -> DataFrame:
    """Distinct canonical keys of the listed urls; a url without a path lists the whole site."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return listed.where(host_of(F.col("url")) != "").select(page_key(host, path).alias("key")).distinct()


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), *, keep: Sequence[str] = ("page_id",), most_blocks: int = BLOCKS_MOST, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """keep, host, path, rule, verdict, on_list of every page."""
    keys = listed_keys(listed)
    n = keys.count()
    blocks = 1 << max(0, min(most_blocks.bit_length() - 1, (n // KEYS_PER_BLOCK).bit_length()))
    built = checkpointed(bloom(keys, blocks))
    # A subquery's value is read in place; as a column it would be copied into every row.
    words = built.scalar()
    host, path = F.col("host"), F.col("path")
    parsed = pages.select(*keep, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(host, path, rules)
    parsed = parsed.select(*keep, "host", "path", rule.alias("rule"), verdict.alias("ruled"), site_key(host).alias("site"), page_key(host, path).alias("page"))
    sought = F.col("ruled").isNull() & (host != "")
    possible = parsed.select(
        *keep, "host", "path", "rule", "ruled",
        F.when(sought & may_hold(words, F.col("site"), blocks), F.col("site")).alias("site"),
        F.when(sought & may_hold(words, F.col("page"), blocks), F.col("page")).alias("page"),
    )

    def exact(rows: DataFrame, table: DataFrame) -> DataFrame:
        by_site = table.select(F.col("key").alias("site"), F.lit(True).alias("site_hit"))
        by_page = table.select(F.col("key").alias("page"), F.lit(True).alias("page_hit"))
        return rows.join(by_site, "site", "left").join(by_page, "page", "left")

    if n <= broadcast_rows:
        found = exact(possible, F.broadcast(keys))
    else:
        none = F.col("site").isNull() & F.col("page").isNull()
        found = exact(possible.where(~none), keys).unionByName(possible.where(none).withColumns({"site_hit": F.lit(None).cast("boolean"), "page_hit": F.lit(None).cast("boolean")}))
    on_list = F.coalesce("site_hit", "page_hit", F.lit(False))
    return found.select(*keep, "host", "path", "rule", F.coalesce("ruled", F.when(on_list, "block").otherwise("allow")).alias("verdict"), on_list.alias("on_list"))


def filter_pages(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = ()) -> DataFrame:
    """The pages whose url is allowed, with all their columns."""
    packed = pages.select("url", whole_row(pages).alias("sieve_row"))
    return judge(packed, listed, rules, keep=("sieve_row",)).where("verdict = 'allow'").select("sieve_row.*")
