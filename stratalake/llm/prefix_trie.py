"""The trie of what conversations begin with, by ROLLUP over columns of turn ids.

A conversation becomes rows of ``COLUMNS`` turn ids, one row for each block of so many turns, keyed by the node where the block before it ends. One
ROLLUP over the columns, together with block and key, aggregates the members of every prefix at once; grouping_id tells how long the prefix is. The node of a prefix is
known by the exclusive or of a hash of each place and its turn, twice 64 bits: the parent's is found by taking the last turn out again, and the key of
a block is a running aggregate.

What a whole subtree adds up to needs no walk over the levels: every node's own value is put on its smallest member, at the node's depth. The subtree below a node
then holds just what its members have from that depth on, which a second ROLLUP over suffix sums gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.llm.common import stored

#: Turns of one row of the ROLLUP.
COLUMNS = 8
#: Ids that go into one piece of a list of ids.
IDS_PER_PIECE = 10_000
#: The borrowed turns: a conversation c begins like the first one of its GROUP ids, by less than MOST turns.
GROUP, MOST = 20, 4

_WORD = r"[^\x20\x09-\x0D]+"


def turn_table(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_id, words) of conversations (conv_id, turn, role, text): places from 1 by turn (null first), then by role and text.

    Null roles and texts are empty. Equal turns (role and text) have equal ids of 128 bits. Rows without a conv_id belong to no conversation and are
    left out; repeated rows are turns of their own; other columns are ignored.
    """
    slim = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    digest = F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)
    return slim.select(
        "conv_id",
        place.cast("long").alias("place"),
        F.unhex(F.substring(digest, 1, 32)).alias("turn_id"),
        F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words"),
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first turns replaced by those of another: (conv_id) and (conv_id, place, turn_id, words).

    Conversation c gets the first h turns of conversation c - c % 20 (all if it has fewer, none if there is none), then its own after its first h;
    h is the unsigned crc32 of c in decimal, modulo 4. One without any turn stays a conversation.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).cast("int")
    convs = turns.select("conv_id").distinct()
    first = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < MOST)).groupBy(F.col("conv_id").alias("first"))
    heads = first.agg(F.sort_array(F.collect_list(F.struct("place", "turn_id", "words"))).alias("head"))
    lent = convs.withColumn("first", F.col("conv_id") - F.col("conv_id") % GROUP).join(heads, "first", "left")
    lent = lent.select("conv_id", F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,turn_id:binary,words:bigint>>")), F.lit(1), h).alias("head"))
    # Where a lender has fewer turns than asked for, the own ones move up.
    own = turns.where(F.col("place") > h).join(lent.select("conv_id", F.size("head").alias("n_lent")), "conv_id")
    own = own.select("conv_id", (F.col("place") - h + F.col("n_lent")).alias("place"), "turn_id", "words")
    return convs, lent.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*").unionByName(own)


def _mark(half: int, place: Column, turn_id: Column) -> Column:
    """Half of the hash of a turn at a place."""
    return F.xxhash64(F.lit(half), place, turn_id)


def _xor(columns: list[Column]) -> Column:
    return reduce(Column.bitwiseXOR, columns)


def blocks_of(convs: DataFrame, turns: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """A row per block of a conversation: (conv_id, block, t1 ..., n, a, b, own_a, own_b, last).

    t1 and so on are (id, words) of its ``n`` turns; a and b are the key, the node where the block before ends; own_a and own_b what this
    block's turns put to it; last tells whether no block follows. A conversation without turns has one block of none.
    """
    place = F.col("place")
    empty = convs.select("conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("turn_id"), F.lit(None).cast("long").alias("words"))
    slot = (place - 1) % columns + 1
    both = turns.select("conv_id", "place", "turn_id", "words").unionByName(empty)
    block = F.coalesce(F.floor((place - 1) / columns), F.lit(0)).alias("block")
    turn = F.struct(F.col("turn_id").alias("id"), "words")
    rows = both.groupBy("conv_id", block).agg(
        *(F.max(F.when(slot == i, turn)).alias(f"t{i}") for i in range(1, columns + 1)),
        F.count("turn_id").alias("n"),
        *(F.coalesce(F.bit_xor(F.when(place.isNotNull(), _mark(half, place, F.col("turn_id")))), F.lit(0)).alias(name) for half, name in ((1, "own_a"), (2, "own_b"))),
    )
    order = Window.partitionBy("conv_id").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns(
        {
            "a": F.coalesce(F.bit_xor("own_a").over(before), F.lit(0)),
            "b": F.coalesce(F.bit_xor("own_b").over(before), F.lit(0)),
            "last": F.lead("block").over(order).isNull(),
        }
    )


def _rolled_up(blocks: DataFrame, columns: int, sums: list[str]) -> DataFrame:
    """A row per node: conv_id (the smallest member), depth, node and parent hashes, n_convs, words of its last turn, childless, and for each of ``sums`` its
    value, the sum of the members' column ``{sum}{level}``."""
    names = [f"t{i}" for i in range(1, columns + 1)]
    totals = "".join(f", sum({s}{i}) AS {s}{i}" for s in sums for i in range(columns + 1))
    grouped = blocks.sparkSession.sql(
        f"""SELECT block, a, b, {", ".join(names)}, {columns} - bit_count(grouping_id()) AS level,
                min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS longest, bool_and(last) AS all_last{totals}
            FROM {{blocks}} GROUP BY block, a, b, ROLLUP ({", ".join(names)})""",
        blocks=blocks,
    )

    def at_level(of) -> Column:
        """The value of the row's level."""
        value = of(0)
        for i in range(1, columns + 1):
            value = F.when(F.col("level") == i, of(i)).otherwise(value)
        return value

    # A conversation that has ended has no turn there; the top of a later block is a node of the block before.
    last = at_level(lambda i: F.col(f"t{i}") if i else F.lit(None))
    nodes = grouped.withColumn("turn", last).where(F.col("turn").isNotNull() | ((F.col("level") == 0) & (F.col("block") == 0)))
    depth = F.col("block") * columns + F.col("level")

    def marks(half: int) -> list[Column]:
        return [F.when(F.col(t).isNotNull(), _mark(half, F.col("block") * columns + i, F.col(t)["id"])).otherwise(F.lit(0)) for i, t in enumerate(names, 1)]

    def parent(half: int, node: str) -> Column:
        return F.when(F.col("depth") > 0, F.col(node).bitwiseXOR(_mark(half, F.col("depth"), F.col("turn")["id"])))

    full = (F.col("level") < columns) | F.col("all_last")
    return (
        nodes.withColumns({"depth": depth, "node_a": _xor([F.col("a"), *marks(1)]), "node_b": _xor([F.col("b"), *marks(2)])})
        .withColumns({"parent_a": parent(1, "node_a"), "parent_b": parent(2, "node_b")})
        .select(
            *("conv_id", "depth", "node_a", "node_b", "parent_a", "parent_b", "n_convs"),
            F.coalesce(F.col("turn")["words"], F.lit(0)).alias("words"),
            ((F.col("longest") == F.col("level")) & full).alias("childless"),
            *(at_level(lambda i, s=s: F.col(f"{s}{i}")).alias(s) for s in sums),
        )
    )


def _with_suffix_sums(blocks: DataFrame, nodes: DataFrame, columns: int) -> DataFrame:
    """``blocks`` with, for each level, what the conversation holds from there on of leaves and of saved words: those of the nodes whose smallest member it is."""
    block = F.when(F.col("depth") == 0, 0).otherwise(F.floor((F.col("depth") - 1) / columns))
    level = F.col("depth") - F.col("block") * columns
    values = nodes.select("conv_id", block.alias("block"), "depth", F.col("childless").cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    values = values.where("leaves > 0 or saved > 0")
    kinds, levels = ("leaves", "saved"), range(columns + 1)
    held = values.groupBy("conv_id", "block").agg(*(F.sum(F.when(level == i, F.col(k)).otherwise(0)).alias(f"{k}{i}") for k in kinds for i in levels))
    joined = blocks.join(held, ["conv_id", "block"], "left").fillna(0, [f"{k}{i}" for k in kinds for i in levels])
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = {}
    for k in kinds:
        whole = reduce(Column.__add__, (F.col(f"{k}{i}") for i in levels))
        after = F.coalesce(F.sum(whole).over(later), F.lit(0))
        for i in levels:
            sums[f"{k}{i}"] = after + reduce(Column.__add__, (F.col(f"{k}{j}") for j in levels if j >= i))
    return joined.withColumns(sums)


def id_digests(ends: DataFrame, ids_per_piece: int = IDS_PER_PIECE) -> DataFrame:
    """(node_a, node_b, ends_sha256) of (node_a, node_b, conv_id): the SHA-256 of each node's ids, ascending, in decimal and with commas between.

    Ranges of sorted ids become pieces of text in tasks that share a node's ids; the digest then goes over a node's few pieces, one at a time.
    """
    keys = ["node_a", "node_b"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"node_a": [key[0]], "node_b": [key[1]], "first": [ids[0]], "ids": [",".join(map(str, ids))]})

        for batch in batches:
            for a, b, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and ((a, b) != key or len(ids) >= ids_per_piece):
                    yield piece()
                    ids = []
                key = (a, b)
                ids.append(conv_id)
        if ids:
            yield piece()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[tuple[int, int, str]]:
            key, sha = None, hashlib.sha256()
            for batch in batches:
                for a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (a, b) == key:
                        sha.update(b",")
                    else:
                        if key is not None:
                            yield *key, sha.hexdigest()
                        key, sha = (a, b), hashlib.sha256()
                    sha.update(ids.encode())
            if key is not None:
                yield *key, sha.hexdigest()

        rows = []
        for row in told():
            rows.append(row)
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[*keys, "ends_sha256"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[*keys, "ends_sha256"])

    ranged = ends.select(*keys, "conv_id").repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    cut = ranged.mapInArrow(pieces, "node_a long, node_b long, first long, ids string")
    return cut.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digests, "node_a long, node_b long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, columns: int = COLUMNS, ids_per_piece: int = IDS_PER_PIECE) -> DataFrame:
    """One row per different sequence of first turns, from the empty one on: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``convs`` has every conv_id once, ``turns`` (conv_id, place, turn_id, words) with places from 1 on. A node is named by its smallest member and its depth; members
    are the conversations that begin with it. ``n_leaves`` and ``saved_tokens`` are of its subtree with itself: nodes without children, and the words of last
    turns that a cache of prefixes would not read again, (n_convs - 1) times each. ``ends_sha256`` digests the members that have no more turns.
    No conversation gives no row; one without turns ends at the root.

    A popular prefix is combined in each task before it is shuffled, and a conversation of any length is rows of ``columns`` turns; numbering its turns and
    adding up its blocks stream over them in one task.
    """
    blocks = stored(blocks_of(convs, turns, columns), "blocks")
    nodes = stored(_rolled_up(blocks, columns, []), "nodes")
    full = _rolled_up(_with_suffix_sums(blocks, nodes, columns), columns, ["leaves", "saved"])

    ends = blocks.where("last").select("conv_id", *(F.col(k).bitwiseXOR(F.col(f"own_{k}")).alias(f"node_{k}") for k in "ab"))
    children = nodes.where("depth > 0").groupBy(F.col("parent_a").alias("node_a"), F.col("parent_b").alias("node_b")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("node_a").alias("parent_a"), F.col("node_b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"))
    told = full.join(children, ["node_a", "node_b"], "left").join(id_digests(ends, ids_per_piece), ["node_a", "node_b"], "left")
    return told.join(parents, ["parent_a", "parent_b"], "left").select(
        *("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs"),
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
