"""URL rules behind a blocked Bloom filter, in DataFrame functions only.

A rule is a canonical URL prefix, ``host/path``: it fits its host and all subdomains where the URL's path starts with its path. Every URL
could only be fitted by the rules at few keys: each host suffix with as many labels as some rule has, with each path prefix as long as some rule's.
These keys are looked up in a Bloom filter of the rules whose bits of one key lie in one block of 256 bits, so that a lookup reads one row of
the filter. The keys that pass, rules and a few false positives, meet the rules themselves in a hash join, which removes the latter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: Bits of the filter for each rule, and the most it has of blocks (four longs each), whatever the number of rules: above about 16 million rules
#: more keys pass by chance, and the join has more of them to remove.
BITS_PER_RULE = 16
MOST_BLOCKS = 1 << 20
WORDS, WORD_BITS = 4, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, only A-Z in lower case; empty for null and without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end; empty for null and without ``://``."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_rules(rules: DataFrame) -> DataFrame:
    """(rule, rule_host, rule_path, rule_verdict) of rules (rule, verdict): the host in lower case (A-Z), one row per host and path.

    Of repeated rules that disagree ``block`` counts. Null rules and null verdicts are no rules.
    """
    text = F.col("rule").cast("string")
    host = F.translate(F.regexp_extract(text, "(?s)^([^/]*)", 1), UPPER, LOWER)
    parts = rules.where(text.isNotNull() & F.col("verdict").isNotNull()).select(
        host.alias("rule_host"), F.regexp_extract(text, "(?s)^[^/]*(.*)$", 1).alias("rule_path"), F.col("verdict").cast("string").alias("verdict")
    )
    one = parts.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))
    return one.select(F.concat("rule_host", "rule_path").alias("rule"), "rule_host", "rule_path", "rule_verdict")


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, F.lit("/"), path)


def _block_of(key: Column, blocks: int) -> Column:
    return F.pmod(key, F.lit(blocks).cast("long"))


def _masks(key: Column) -> list[Column]:
    """The bits of a key in its block: two in each of its words, taken from a second hash."""
    bits = F.xxhash64(key, F.lit(1))

    def bit(n: int) -> Column:
        place = F.shiftrightunsigned(bits, 6 * n).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of ``keys`` (host, path) as rows (block, w0 ...), of which there are at most ``blocks``; blocks without a bit have no row."""
    hashed = keys.select(_hash(F.col("host"), F.col("path")).alias("key"))
    words = hashed.select(_block_of(F.col("key"), blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))))
    return words.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def might_be_listed(candidates: DataFrame, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``candidates`` (key_host, key_path and others) whose key passes the filter: all that are listed, and few others."""
    key = _hash(F.col("key_host"), F.col("key_path"))
    asked = candidates.withColumn("key", key).withColumn("block", _block_of(F.col("key"), blocks))
    found = asked.join(F.broadcast(filter_blocks), "block")  # at most ``blocks`` rows of 40 bytes
    passes = reduce(Column.__and__, (F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col("key")))))
    return found.where(passes).drop("key", "block", *(f"w{i}" for i in range(WORDS)))


def _candidates(urls: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """(host, path, key_host, key_path): the keys under which a rule could fit, one for each (labels, path length) that some rule has."""

    def key(labels: int, length: int) -> Column:
        fits = (_labels(F.col("host")) >= labels) & (F.length("path") >= length)
        made = F.struct(F.substring_index("host", ".", -labels).alias("key_host"), F.substring("path", 1, length).alias("key_path"))
        return F.when(fits, made)

    keys = F.filter(F.array(*(key(*s) for s in shapes)), lambda k: k.isNotNull())
    return urls.select("host", "path", F.explode(keys).alias("k")).select("host", "path", "k.*")


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = ALLOW, blocks: int | None = None) -> DataFrame:
    """``pages`` with the columns host, path, rule and verdict put in (instead of own columns of these names); every row is kept.

    ``pages`` needs a column ``url``; ``rules`` has (rule, verdict). Of the rules that fit a URL the longest wins, of equally long ones the one
    with the longer host. Without a rule the rule is null and the verdict ``otherwise``. Null and empty URLs have an empty host and path, which
    only a rule of an empty host fits; repeated rows stay repeated; an empty table gives an empty result; without rules every verdict is ``otherwise``.

    Each different (host, path) is looked up once, so a URL that a third of all rows hold costs one lookup, and the join that hands its rule back
    has one row of it on the other side, which adaptive execution splits. The driver gets the number of rules and the shapes of
    their keys (labels and path length), which are bounded by the lengths of rules, not by their number.
    """
    listed = canonical_rules(rules)
    seen = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    shape = F.struct(_labels(F.col("rule_host")).alias("labels"), F.length("rule_path").alias("length"))
    told = listed.agg(F.count("*").alias("n"), F.collect_set(shape).alias("shapes")).first()
    if not told.n:
        return seen.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})
    blocks = blocks or max(1, min(MOST_BLOCKS, -(-told.n * BITS_PER_RULE // (WORDS * WORD_BITS))))
    bloom = bloom_blocks(listed.select(F.col("rule_host").alias("host"), F.col("rule_path").alias("path")), blocks)

    candidates = _candidates(seen.select("host", "path").distinct(), sorted((s.labels, s.length) for s in told.shapes))
    possible = might_be_listed(candidates, bloom, blocks)
    fits = (F.col("key_host") == F.col("rule_host")) & (F.col("key_path") == F.col("rule_path"))
    longest = F.struct(F.length("rule"), F.length("rule_host"))
    best = possible.join(listed, fits).groupBy(F.col("host").alias("_host"), F.col("path").alias("_path"))
    best = best.agg(F.max_by(F.struct("rule", "rule_verdict"), longest).alias("best"))
    judged = seen.join(best, (seen["host"] == best["_host"]) & (seen["path"] == best["_path"]), "left")
    rule, verdict = best["best"]["rule"], F.coalesce(best["best"]["rule_verdict"], F.lit(otherwise))
    return judged.select(*(seen[f"`{c}`"] for c in seen.columns), rule.alias("rule"), verdict.alias("verdict"))
