"""Similarity self-join on word n-grams: every pair of texts with Jaccard similarity of at least the threshold, by MinHash banding.

1. Each text becomes its set of hashed word n-grams; texts with the same set are copies and are represented once.
2. MinHash values in bands; band and row counts are chosen so that a pair at the threshold shares a band with the target recall. Representatives
   are shuffled on the band hashes. A bucket is gone through in order against its pivots, with one byte per MinHash value as a sketch: a member near a pivot
   joins it, others become pivots. By the triangle inequality of the sketches' distance this links any two members that could be similar
   with a chain, without pairing all members.
3. The linked families are verified on the full sets, block against block. A task counts each member's similar texts and
   returns the counts and a spanning forest of the links, never the pairs: a family of n texts has n^2 / 2 of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import components, grouped, kept, mix, shingles, slices, stored, text_key

THRESHOLD = Fraction(4, 5)
WORDS = 5
RECALL = 0.99999
MOST_HASHES = 150
#: Rows of a bucket per task in the first pass, and texts per block of a family.
SALT_ROWS, BLOCK = 512, 512
#: Sketch distances, as shares of differing values: nearer than TIGHT is covered by the pivot; a pair at the threshold is
#: within SLACK but for a chance of about 1e-6.
TIGHT, SLACK = 0.1, 0.36
#: The reach of the member that all parts of a cut bucket share.
HEAD = 0.85


def bands_for(threshold: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band, so the fewest chance hits, that reach the recall at the threshold with at most ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches the recall with so few hashes")
    return best


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minhash(items: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least hash of the items under each function (32 bits)."""
    a, b = factors
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(items), 1024):
        values = a[:, None] * items[None, k : k + 1024] + b[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least >> np.uint64(32)


def set_key(items: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    low, high = mix(items), mix(items ^ np.uint64(0xD1B54A32D192ED03))
    return int(low.sum(dtype=np.uint64)).to_bytes(8, "big") + int(high.sum(dtype=np.uint64)).to_bytes(8, "big")


def signatures(docs: DataFrame, threshold: Fraction = THRESHOLD, words: int = WORDS) -> DataFrame:
    """Per row: doc_id, text_key, set_key (null without a word), sketch (a byte per hash) and band hashes."""
    bands, rows = bands_for(float(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, place = kept(("minhash", bands * rows), lambda: _factors(bands * rows)), np.arange(1, bands + 1, dtype=np.uint64)
        for batch in slices(batches, 2):
            keys, sketches, hashes = [], [], []
            for text in batch.column(2):
                items = shingles(text.as_py(), words)
                if not len(items):
                    keys.append(None)
                    sketches.append(None)
                    hashes.append(None)
                    continue
                values = minhash(items, factors)
                keys.append(set_key(items))
                sketches.append((values & np.uint64(255)).astype(np.uint8).tobytes())
                folded = mix(place)
                for r in range(rows):
                    folded = mix(folded ^ values.reshape(bands, rows)[:, r])
                hashes.append(folded.view(np.int64))
            columns = [*batch.columns[:2], pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "set_key", "sketch", "bands"])

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows_in.mapInArrow(run, "doc_id long, text_key long, set_key binary, sketch binary, bands array<long>")


def _pivots(batches: Iterator[pa.RecordBatch], reach: float, keep_pivots: bool) -> Iterator[pa.RecordBatch]:
    """Go through sorted buckets: links (a, b), and with ``keep_pivots`` the pivots of cut buckets as rows with a null b.

    A member links to one pivot of each group of linked pivots within reach, and makes them one group: as connected as links to all of them,
    but never more of them than members. The first pivot of a cut bucket is in all its parts and reaches to ``HEAD``; pivots so near it that whatever
    is within ``reach`` of them or of what they cover is linked with it as well need no second pass.
    """
    bucket, pivots, names, group = None, np.zeros((0, 0), np.uint8), [], np.zeros(0, np.int64)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        width = len(batch.column("sketch")[0].as_py())
        sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(n, width)
        keys = list(zip(batch.column("bucket").to_pylist(), batch.column("salt").to_pylist(), strict=True))
        nodes, parts = batch.column("set_key").to_pylist(), batch.column("parts").to_pylist()
        out: list[tuple] = []
        for i in range(n):
            if keys[i] != bucket:
                bucket, pivots, names, group = keys[i], np.zeros((0, width), np.uint8), [], np.zeros(0, np.int64)
            if names and names[0] == nodes[i]:
                continue  # the bucket's least member came first already
            apart = (pivots != sketches[i]).mean(axis=1)
            near = apart <= reach
            if parts[i] > 1 and names and apart[0] <= HEAD:
                near[0] = True
            groups, first = np.unique(group[near], return_index=True)
            out += [(nodes[i], names[k], None) for k in np.flatnonzero(near)[first]]
            own = groups[0] if len(groups) else len(names)
            group[np.isin(group, groups)] = own
            if not (apart <= TIGHT).any():
                far = not names or apart[0] > HEAD - SLACK - TIGHT
                pivots = np.concatenate([pivots, sketches[i : i + 1]])
                names.append(nodes[i])
                group = np.append(group, own)
                if keep_pivots and parts[i] > 1 and far:
                    out.append((nodes[i], None, bucket[0]))
        if out:
            a, b, cut = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(cut, pa.int64())], names=["a", "b", "bucket"])


LINK = "a binary, b binary, bucket long"


def families(signed: DataFrame) -> DataFrame:
    """(node, root) of the sets that may be similar to another one.

    A bucket of many members is dealt out over tasks by a salt. Each task goes through its members after the bucket's least member, so that what is near that one
    needs no other task; the other pivots of such a bucket then meet in a second pass with a wider reach.
    """
    sets = signed.where("set_key is not null").groupBy("set_key").agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    banded = sets.select("set_key", F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("set_key").alias("least")).where("n > 1")
    full = banded.join(sizes, "bucket").withColumn("parts", F.ceil(F.col("n") / SALT_ROWS).cast("int"))
    sketches = sets.select("set_key", "sketch")
    members = full.select("bucket", "parts", "set_key", F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int").alias("salt"), F.lit(1).alias("later"))
    # The least member goes to every part of its bucket: one row per SALT_ROWS members.
    heads = (
        sizes.withColumn("parts", F.ceil(F.col("n") / SALT_ROWS).cast("int"))
        .where("parts > 1")
        .select("bucket", "parts", F.col("least").alias("set_key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("later"))
    )
    rows = members.unionByName(heads).join(sketches, "set_key")
    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "bucket", "salt").sortWithinPartitions("bucket", "salt", "later", "set_key")
    links = stored(dealt.mapInArrow(lambda it: _pivots(it, SLACK + TIGHT, True), LINK), "links")
    again = (
        links.where("b is null").select("bucket", F.col("a").alias("set_key")).distinct()
        .join(sketches, "set_key").select("bucket", F.lit(1).alias("parts"), F.lit(0).alias("salt"), "set_key", "sketch")
        .repartition(parts, "bucket").sortWithinPartitions("bucket", "set_key")
    )
    wider = again.mapInArrow(lambda it: _pivots(it, SLACK + 3 * TIGHT, False), LINK)
    return components(links.where("b is not null").unionByName(wider).select("a", "b"), "families")


def _verify(table: pa.Table, threshold: Fraction) -> list[tuple[bytes, int, int, bytes]]:
    """(set, similar sets, their rows, least similar set) for the pairs between (or, with equal blocks, within) two blocks."""
    first = table.column("block_a")[0].as_py() == table.column("block_b")[0].as_py()
    seen: dict[bytes, int] = {}
    for i, k in enumerate(table.column("set_key").to_pylist()):
        seen.setdefault(k, i)
    table = table.take(list(seen.values()))
    keys, weight = table.column("set_key").to_pylist(), np.array(table.column("rows").to_pylist(), dtype=np.int64)
    side = np.array(table.column("block").to_pylist()) == table.column("block_b")[0].as_py()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
    sizes, n = np.array([len(s) for s in sets]), len(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, item, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.zeros((n, n), dtype=np.float32)
    shared += int((count == n).sum())  # items that all have; those that one has pair with nothing
    middle = np.flatnonzero((count > 1) & (count < n))
    new = np.full(len(count), -1)
    new[middle] = np.arange(len(middle))
    column = new[item]
    kept = column >= 0
    column, owner = column[kept], owner[kept]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 2048
    cuts = np.searchsorted(column, np.arange(0, len(middle) + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            part = np.zeros((n, width), dtype=np.float32)
            part[owner[a:b], column[a:b] - k * width] = 1
            shared += part @ part.T
    common, both = shared.astype(np.int64), sizes[:, None] + sizes[None, :]
    p, q = threshold.numerator, threshold.denominator
    similar = (p + q) * common >= p * both  # common / (both - common) >= p / q
    np.fill_diagonal(similar, False)
    if not first:
        similar &= side[:, None] != side[None, :]
    names = np.arange(n)
    while True:  # each takes the least name among its similar ones
        least = np.minimum(names, np.where(similar, names[None, :], n).min(axis=1, initial=n))
        least = least[least]
        if (least == names).all():
            break
        names = least
    texts, rows = similar.sum(axis=1), similar @ weight
    return [(keys[i], int(texts[i]), int(rows[i]), keys[names[i]]) for i in range(n) if texts[i]]


def join_similar(docs: DataFrame, threshold: Fraction = THRESHOLD, words: int = WORDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its class and its links.

    * ``class_id``: least doc_id of the rows that similar pairs connect; ``class_size``: their number.
    * ``copy_of``: least doc_id of the rows with the same n-gram set; ``n_copies``: their number.
    * ``n_similar_texts``: other n-gram sets at or over the threshold; ``n_links``: the rows that have these, and the other copies.

    Words are runs of letters, marks and numbers in lower case; a text of fewer than ``words`` words is one n-gram; a text without a word (or a null one) is
    linked with nothing and a class of its own. Repeated rows are copies of each other. Null doc_ids count as greater than any other; a class of only
    those has a null class_id. Other columns are ignored. ``text_key`` and ``class_key`` tell rows and classes apart where ids do not.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"TIGHT, SLACK and HEAD hold for thresholds of {THRESHOLD} and more; at {threshold} similar texts would be missed")
    signed = stored(signatures(docs, threshold, words), "signatures")
    sets = signed.where("set_key is not null").groupBy("set_key").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("at"))
    sets = stored(sets.select("set_key", "rows", "first_id", F.col("at.text_key").alias("text_key")), "sets")
    family = stored(families(signed), "family")
    sized = family.groupBy("root").agg(F.count("*").alias("n"))
    # Blocks of a family by a hash; each block meets itself and every later one.
    member = family.join(sized, "root").select(F.col("node").alias("set_key"), "root", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    member = member.withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")).join(sets, "set_key")
    source = docs.select(F.col("doc_id").cast("long").alias("first_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    pairing = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.least("block", other).alias("a"), F.greatest("block", other).alias("b")),
    )
    texts = member.join(source, member["first_id"].eqNullSafe(source["first_id"]) & (member["text_key"] == source["text_key"])).select(
        "set_key", "root", "block", "rows", pairing.alias("pairs"), "text"
    )

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5):
            items = [shingles(t.as_py(), words).tobytes() for t in batch.column(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(items, pa.binary())], names=["set_key", "root", "block", "rows", "pairs", "items"])

    with_sets = texts.mapInArrow(to_sets, "set_key binary, root binary, block int, rows long, pairs array<struct<a:int,b:int>>, items binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    meeting = (
        with_sets.withColumn("pair", F.explode("pairs"))
        .select("root", F.col("pair.a").alias("block_a"), F.col("pair.b").alias("block_b"), "set_key", "block", "rows", "items")
        .repartition(parts, "root", "block_a", "block_b")
        .sortWithinPartitions("root", "block_a", "block_b", "set_key")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["root", "block_a", "block_b"]):
            found = _verify(table, threshold)
            if found:
                a, texts, rows, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(texts, pa.int64()), pa.array(rows, pa.int64()), pa.array(b, pa.binary())], names=["a", "texts", "rows", "b"])

    counted = stored(meeting.mapInArrow(verify, "a binary, texts long, rows long, b binary"), "similar")
    totals = counted.groupBy("a").agg(F.sum("texts").alias("texts"), F.sum("rows").alias("linked"))
    roots = components(counted.select("a", "b"), "classes")
    named = (
        sets.join(totals, sets["set_key"] == totals["a"], "left").drop("a")
        .join(roots, F.col("set_key") == roots["node"], "left").drop("node")
        .withColumn("class_key", F.coalesce("root", "set_key"))
    )
    classes = named.groupBy("class_key").agg(F.min("first_id").alias("class_id"), F.sum("rows").alias("class_size"))
    labels = named.join(classes, "class_key").select("set_key", "class_key", "class_id", "class_size", F.col("first_id").alias("copy_of"), "rows", "texts", "linked")
    labels = stored(labels, "labels")
    return (
        signed.select("doc_id", "text_key", "set_key")
        .join(labels, "set_key", "left")
        .select(
            "doc_id",
            "text_key",
            "class_key",
            F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("class_size", F.lit(1)).alias("class_size"),
            F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
            F.coalesce("rows", F.lit(1)).alias("n_copies"),
            F.coalesce("texts", F.lit(0)).alias("n_similar_texts"),
            (F.coalesce("linked", F.lit(0)) + F.coalesce("rows", F.lit(1)) - 1).alias("n_links"),
        )
    )


def keep_one(docs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id, of equal ones the least text key. Columns stay as they are.

    Rows of a class of their own pass through; of others one row is picked by an aggregate that combines before the shuffle.
    """
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):  # names that no column of docs has
        mark += "_"
    id_, key, own, group, size = (mark + c for c in ("id", "key", "own", "class", "size"))
    labels = join_similar(docs, threshold).select(
        F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("class_key").alias(group), F.col("class_size").alias(size)
    )
    labels = labels.distinct()
    keyed = docs.withColumn(own, text_key())
    joined = keyed.join(labels, keyed["doc_id"].cast("long").eqNullSafe(labels[id_]) & (keyed[own] == labels[key]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    alone = joined.where(F.col(size) == 1).select(*columns)
    picked = joined.where(F.col(size) > 1).groupBy(group).agg(F.min_by(F.struct(*columns), F.struct(F.col(id_).isNull(), id_, key)).alias("row"))
    return alone.unionByName(picked.select("row.*"))
