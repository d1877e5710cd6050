"""URL verdicts: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table (block, word): a key hashes to one 64-bit block and to a few bits of it, so a probe is
one lookup.  It has a block for every four listed URLs, so that few others pass whatever the list's length; up to
a fixed number of blocks it is broadcast, beyond that it is dealt out by block and so are the URLs that no rule
decides.  Rows that pass it meet the list in an exact hash join, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import without

#: (verdict, host, path prefix)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Listed URLs a block, bits set for each, and the most blocks that are broadcast (some 50 MB).
LISTED_A_BLOCK, BITS, MOST_BROADCAST = 4, 5, 1 << 20


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and
    ``path`` (from there up to ``?``, ``#`` or the end); both empty for a null or one without ``://``."""
    c = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(c, "://")
    rest = F.when(at > 0, c.substr(at + 3, F.length(c))).otherwise("")
    bare = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    host = F.substring_index(bare, "/", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("host", lower).withColumn("path", bare.substr(F.length(host) + 1, F.length(bare)))


def canonical(host: Column, path: Column) -> Column:
    """The form in which URLs are listed: host without ``www.`` or ``m.``, path without final ``/``, ``.html``."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), r"/+$", ""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, null where none does."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column, bits: int) -> Column:
    h = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("long")
    for i in range(bits):
        at = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return out


def blocks_for(listed: DataFrame) -> int:
    """Blocks for the list's different URLs, counted within a few percent."""
    n = listed.agg(F.approx_count_distinct("canonical", 0.03)).first()[0]
    return max(1 << 10, -(-n // LISTED_A_BLOCK))


def bloom(listed: DataFrame, key: str, blocks: int, bits: int = BITS) -> DataFrame:
    """Blocked Bloom filter of ``listed[key]``: (block, word), at most ``blocks`` rows."""
    k = F.col(key)
    return listed.groupBy(_block(k, blocks).alias("block")).agg(F.bit_or(_mask(k, bits)).alias("word"))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, blocks: int | None = None, bits: int = BITS) -> DataFrame:
    """Adds ``host, path, rule, verdict, listed_hit`` to the pages: the longest rule's verdict, else ``block``
    for a listed canonical URL and ``allow`` for the rest.

    ``listed`` has a column ``canonical``; repeats and nulls in it count once and never.  Every page stays,
    repeated rows too; an empty list lists nothing, no pages give no rows.  Columns of the pages that are called as
    a result give way to it, others pass through.  ``blocks`` is the filter's size, by default from the list's.
    """
    blocks = blocks or blocks_for(listed)
    parts = with_parts(without(pages, ["host", "path", "rule", "verdict", "listed_hit"]))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    parts = parts.withColumn("rule", rule).withColumn("__v", verdict).withColumn("__key", F.when(F.col("__v").isNull(), canonical(F.col("host"), F.col("path"))))
    words = bloom(listed.where("canonical is not null"), "canonical", blocks, bits).select(F.col("block").alias("__block"), F.col("word").alias("__word"))
    words = F.broadcast(words) if blocks <= MOST_BROADCAST else words
    asked, ruled = parts.where("__key is not null"), parts.where("__key is null")
    mask = _mask(F.col("__key"), bits)
    probed = asked.withColumn("__b", _block(F.col("__key"), blocks)).join(words, F.col("__b") == F.col("__block"), "left")
    probed = probed.withColumn("__maybe", F.coalesce(F.col("__word").bitwiseAND(mask) == mask, F.lit(False)))
    probed = probed.drop("__b", "__block", "__word").unionByName(ruled.withColumn("__maybe", F.lit(False)))
    exact = listed.where("canonical is not null").select(F.col("canonical").alias("__listed")).distinct()
    hits = probed.where("__maybe").join(exact, F.col("__key") == F.col("__listed"), "left").withColumn("listed_hit", F.col("__listed").isNotNull()).drop("__listed")
    both = hits.unionByName(probed.where("not __maybe").withColumn("listed_hit", F.lit(False)))
    return both.withColumn("verdict", F.coalesce("__v", F.when(F.col("listed_hit"), "block").otherwise("allow"))).drop("__v", "__key", "__maybe")
