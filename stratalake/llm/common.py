"""What the operators share: written tables, grouped streams, hashes of text, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.sources.storage import scratch_dir

#: An odd multiplier for rolling hashes modulo 2^64, and its inverse there.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back, so that lost executors cost no recomputation."""
    path = scratch_dir(df.sparkSession, name) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text="text"):
    """A 64-bit key of a text; null and empty texts differ."""
    return F.xxhash64(F.col(text).isNull(), F.col(text))


def let(value, body):
    """``body`` of a column that is computed once, also where ``body`` uses it inside lambdas (a projection could be merged into them)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (the splitmix64 finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n, kept per Python worker."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for key, factor in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class SpanHash:
    """Hashes of any spans of a sequence of numbers, from prefix sums: equal spans get equal hashes."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


@cache
def _kinds() -> np.ndarray:
    """Per code point: 1 letter or mark, 2 number, 0 anything else."""
    import unicodedata

    kinds = np.zeros(0x110000, dtype=np.uint8)
    for i in range(0x110000):
        kinds[i] = {"L": 1, "M": 1, "N": 2}.get(unicodedata.category(chr(i))[0], 0)
    return kinds


def kinds(points: np.ndarray) -> np.ndarray:
    return _kinds()[points]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word: a run of letters, marks and numbers, in lower case."""
    points = code_points(text.lower())
    starts, ends = runs(kinds(points) > 0)
    return SpanHash(points)(starts, ends)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of ``size`` words in a row.

    Fewer words make one shingle of them all; no word makes none.
    """
    words = word_hashes(text or "")
    if not len(words):
        return words
    size = min(size, len(words))
    starts = np.arange(len(words) - size + 1)
    return np.unique(SpanHash(words)(starts, starts + size))


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]):
    """What a Python worker keeps from task to task (vocabularies, memos), made once; what it kept for another key goes."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


#: Bytes of text that an operator takes out of a batch at a time.
SLICE_BYTES = 1 << 22


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of less than ``most`` bytes of the texts of one column after their first row: a batch has as many rows whatever their length."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths, dtype=np.int64) // most)) + 1
        for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key in turn, from batches sorted by the keys (which may not be null)."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            column = batch.column(k)
            change[1:] |= np.asarray(pc.not_equal(column[1:], column[:-1]))
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[-1] != table.column(k)[0] for k in keys):
            yield pa.concat_tables(held)
            held = []
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield pa.concat_tables([*held, table.slice(a, b - a)])
            held = []
        held.append(table.slice(cuts[-2], cuts[-1] - cuts[-2]))
    if held:
        yield pa.concat_tables(held)


#: Tasks that share the edges of one node.
SPREAD = 16


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); the root is the least node of the component.

    Alternates two steps until nothing changes: every node hands its least neighbour to the greater ones, then to
    the smaller ones. Minima are combined before the shuffle; the edges of a node meet its least neighbour in ``SPREAD`` tasks, so a node that holds a
    third of all edges puts that part of them on one task. Each round is a written table of at most as many rows as there were edges.
    An empty table gives an empty result; edges from a node to itself keep the node.
    """
    now = stored(edges.select("a", "b").distinct(), name)
    before = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        # The edges of a node are dealt over SPREAD tasks for the join.
        copies = least.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        large = both.withColumn("deal", F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int")).join(copies, ["a", "deal"]).where("b >= a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        now = stored(small.unionByName(low.select("a", F.col("least").alias("b"))).distinct(), name)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no end after {most} rounds")
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
