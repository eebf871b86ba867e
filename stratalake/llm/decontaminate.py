"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a fixed mask over words in a row: the words under a 1 are hashed, those under a 0 are ignored. Training and test texts that share a seed hash
are aligned at the hit, and the words around it are compared one by one, so that a passage with replaced words is still
found. A passage with an inserted or a missing word is found at either side of it.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import let, text_key

#: 1: the word counts; 0: any word may stand there.
MASKS = ("1101011", "110010011")
#: A passage is this many words in a row (or a whole shorter item) ...
WINDOW = 20
#: ... of which this share is equal, place by place.
NUMERATOR, DENOMINATOR = 4, 5
#: Items of up to so many words have masks of their own, for each choice of words that may be replaced.
SHORT = 10
#: Up to so many test hashes (four numbers each, about 100 bytes with what a hash table adds) go to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Runs of letters, marks and numbers in lower case; an empty array for a null text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def _seeds(hashes: Column, masks: dict[str, Column | None]) -> Column:
    """(seed, at) of each mask (where its condition holds) at each position of an array of word hashes."""

    def seeds(h: Column, number: int, mask: str, condition: Column | None) -> Column:
        picked = [i for i, c in enumerate(mask) if c == "1"]
        fits = F.size(h) >= len(mask)
        if condition is not None:
            fits = fits & condition
        at = F.when(fits, F.sequence(F.lit(0), F.greatest(F.size(h) - len(mask), F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.xxhash64(F.lit(number), *(F.get(h, i + k) for k in picked)).alias("seed"), i.alias("at")))

    return let(hashes, lambda h: F.concat(*(seeds(h, n, mask, condition) for n, (mask, condition) in enumerate(masks.items()))))


def _whole(n: int) -> list[str]:
    """The masks of a whole item of n words but for as many as may be replaced; without the places at its ends, as a text may end there."""
    out = combinations(range(n), n - -(-n * NUMERATOR // DENOMINATOR))
    return list(dict.fromkeys("".join("0" if i in o else "1" for i in range(n)).strip("0") for o in out))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and test item of which it holds a passage: doc_id, text_key, item_id, matched and window (words), doc_at (first word of the best window).

    ``docs`` (doc_id, text), ``benchmark`` (item_id, text). Of repeated rows one match is returned. Null texts have no words; null ids are kept as ids. Other columns are
    ignored. Items without a word match nothing; those of up to ``SHORT`` words are looked for as a whole, with every choice of replaced words, which is none
    below five words: such an item must stand there word for word. Of equally good windows the
    first counts.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), words(F.col("text")).alias("words"))
    items = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("item"))
        .where(F.size("item") > 0)
        .distinct()
    )
    short = items.where(F.size("item") <= SHORT).select(F.size("item").alias("n")).distinct().collect()  # a few lengths at most
    sizes: dict[str, list[int]] = {}  # no document is searched for lengths that do not occur
    for n in sorted(r.n for r in short):
        for mask in _whole(n):
            sizes.setdefault(mask, []).append(n)
    masks = {m: None for m in [*MASKS, *(m for m in sizes if m not in MASKS)]}
    item_masks = {m: None if m in MASKS else F.size("item").isin(sizes[m]) for m in masks}
    test = items.select("item_id", "item", F.explode(_seeds(F.transform("item", lambda w: F.xxhash64(w)), item_masks)).alias("s"))
    test = test.select("s.seed", "item_id", F.xxhash64("item").alias("item_key"), F.col("s.at").alias("item_at"))
    if test.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        test = F.broadcast(test)
    train = d.select("doc_id", "text_key", F.explode(_seeds(F.transform("words", lambda w: F.xxhash64(w)), masks)).alias("s"))
    hits = (
        train.select("doc_id", "text_key", "s.seed", F.col("s.at").alias("doc_at"))
        .join(test, "seed")
        .select("doc_id", "text_key", "item_id", "item_key", (F.col("doc_at") - F.col("item_at")).alias("shift"))
        .distinct()
    )
    keyed_items = items.withColumn("item_key", F.xxhash64("item")).withColumnRenamed("item_id", "_item")
    aligned = hits.join(keyed_items, hits["item_id"].eqNullSafe(keyed_items["_item"]) & (hits["item_key"] == keyed_items["item_key"])).select("doc_id", "text_key", "item_id", "shift", "item")
    # Texts go through the shuffle, not arrays of words, which are twice as large.
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), text_key().alias("_key"), F.col("text").cast("string").alias("text"))
    placed = aligned.join(own, aligned["doc_id"].eqNullSafe(own["_id"]) & (aligned["text_key"] == own["_key"]))
    window = F.least(F.size("item"), F.lit(WINDOW))
    same = let(
        words(F.col("text")),
        lambda found: F.transform(
            "item", lambda w, i: F.when((i + F.col("shift") >= 0) & F.get(found, F.greatest(i + F.col("shift"), F.lit(0))).eqNullSafe(w), 1).otherwise(0)
        ),
    )
    compared = placed.select("doc_id", "text_key", "item_id", "shift", window.alias("window"), same.alias("same"))
    sums = F.transform(
        F.sequence(F.lit(0), F.size("same") - F.col("window")),
        lambda i: F.struct(F.aggregate(F.slice("same", i + 1, F.col("window")), F.lit(0), lambda a, b: a + b).alias("matched"), (-(i + F.col("shift"))).alias("before")),
    )
    best = compared.select("doc_id", "text_key", "item_id", "window", F.array_max(sums).alias("best")).where(F.col("best.matched") * DENOMINATOR >= F.col("window") * NUMERATOR)
    return (
        best.groupBy("doc_id", "text_key", "item_id")
        .agg(F.max(F.struct("best.matched", "window", "best.before")).alias("b"))
        .select("doc_id", "text_key", "item_id", F.col("b.matched").alias("matched"), F.col("b.window").alias("window"), F.greatest(-F.col("b.before"), F.lit(0)).alias("doc_at"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a passage of the benchmark; columns and other rows stay as they are."""
    found = matches(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_id"]) & (text_key() == found["_key"]), "left_anti")
