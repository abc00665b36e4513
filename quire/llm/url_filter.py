"""URL filters (native): a blocked Bloom filter, then an exact hash join.

Listed canonical URLs are host + path prefixes; one fits its host, all subdomains and
every path that starts with its path. Each page URL yields the keys that could be
listed (host suffixes by label x path prefixes of the listed lengths). A blocked Bloom
filter of the listed keys (one 64-bit block a key) drops nearly all of them inside the
row; rows without a hit are done. The few hits are joined exactly, which removes false
positives. The filter holds at most ``max_blocks`` longs; with more keys than it can part it
only passes more hits.

Cases: a null URL or one without ``://`` has empty host and path and fits nothing. Of
listed rows for the same key the first by verdict counts; the longest key wins, on
equal length the longer host. Repeated pages are each returned. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import with_clear_names

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), A_Z, a_z)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit("bits"))
    bit = lambda at: F.call_function(
        "shiftleft", F.lit(1).cast("long"),
        F.call_function("shiftrightunsigned", h, F.lit(at)).bitwiseAND(F.lit(63).cast("long")).cast("int")
    )
    return bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12)).bitwiseOR(bit(18))


def bloom(listed: DataFrame, key: str, n: int, max_blocks: int = 1 << 18) -> tuple[Column, int]:
    """The filter as an array literal of at most ``max_blocks`` longs, four keys a block."""
    blocks = min(max_blocks, max(1, 1 << max(0, (n // 4).bit_length())))
    rows = listed.select(
        _block(F.col(key), blocks).alias("b"), _mask(F.col(key)).alias("m")
    ).groupBy("b").agg(F.bit_or("m").alias("m")).collect()
    words = [0] * blocks
    for b, m in rows:
        words[b] = m
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>"), blocks


def url_filter(
    pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
    broadcast_rows: int = 10_000
) -> DataFrame:
    """rules: host, path, verdict. listed: host, path, verdict of the blocklist that decides
    where no rule fits (else allow). Returns id, host, path, rule, verdict and ``listed``,
    the blocklist's entry that fits."""
    keyed = rules.select("host", "path", "verdict", F.lit(True).alias("is_rule"))
    if listed is not None:
        keyed = keyed.unionByName(listed.select("host", "path", "verdict", F.lit(False).alias("is_rule")))
    keyed = keyed.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    keyed = keyed.groupBy(
        F.concat("host", "path").alias("key"), F.length("host").alias("host_len"), "is_rule"
    ).agg(F.min("verdict").alias("listed_verdict"))
    facts = keyed.agg(
        F.count(F.lit(1)), F.array_sort(F.collect_set(F.length("key") - F.col("host_len"))),
        F.coalesce(F.max("host_len"), F.lit(0))
    ).first()
    n, lengths, longest = facts[0], facts[1], facts[2]
    words, blocks = bloom(keyed, "key", n)

    out = with_clear_names(pages, id_col, url_col).select(
        id_col, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"),
        F.monotonically_increasing_id().alias("_row")
    )
    # a listed host is no longer than ``longest``: neither is a suffix that could be one
    out = out.withColumn("_labels", F.split(F.right("host", F.lit(longest + 1)), "\\."))
    out = out.withColumn(
        "_hosts", F.transform("_labels", lambda x, i: F.array_join(F.slice("_labels", i + 1, F.size("_labels")), "."))
    )
    paths = F.filter(
        F.lit(lengths).cast("array<int>"), lambda k: k <= F.length("path")
    ) if lengths else F.array().cast("array<int>")
    keys = F.flatten(
        F.transform(
            "_hosts",
            lambda h: F.transform(
                F.col("_cuts"),
                lambda k: F.struct(F.concat(h, F.substring("path", F.lit(1), k)).alias("key"), F.length(h).alias("host_len"))
            )
        )
    )
    out = out.withColumn("_cuts", paths).withColumn("_keys", keys)
    hits = F.filter(
        "_keys", lambda k: F.element_at(words, _block(k["key"], blocks) + 1).bitwiseAND(_mask(k["key"])) == _mask(k["key"])
    )
    out = out.select("_row", id_col, "host", "path", hits.alias("_hits"))
    # rows without a hit are done; only the others meet the list
    clear = out.where(F.size("_hits") == 0).select(
        id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"),
        F.lit(None).cast("string").alias("listed")
    )
    some = out.where(F.size("_hits") > 0).select(
        "_row", id_col, "host", "path", F.explode("_hits").alias("_hit")
    ).select("_row", id_col, "host", "path", "_hit.key", "_hit.host_len")
    exact = some.join(F.broadcast(keyed) if n <= broadcast_rows else keyed, ["key", "host_len"], "left")
    best = lambda rule: F.max(
        F.when(F.col("is_rule") == rule, F.struct(F.length("key").alias("n"), "host_len", "key", "listed_verdict"))
    )
    found = exact.groupBy("_row").agg(
        F.first(id_col).alias(id_col), F.first("host").alias("host"), F.first("path").alias("path"), best(True).alias("r"),
        best(False).alias("b")
    )
    return found.select(
        id_col, "host", "path", F.col("r.key").alias("rule"),
        F.coalesce("r.listed_verdict", "b.listed_verdict", F.lit("allow")).alias("verdict"), F.col("b.key").alias("listed")
    ).unionAll(clear)
