"""Document fingerprints by winnowing.

Every ``K`` code points in a row get a rolling hash; of every ``WINDOW`` hashes in a row the least is kept, the rightmost of equal ones,
with its position. Two texts that share a passage of at least ``K + WINDOW - 1`` code points share a kept hash. A text with fewer hashes
than a window keeps its least one; a text shorter than ``K`` is one hash of the whole; an empty text has none.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import SpanHash, code_points

K, WINDOW = 24, 41


def winnow(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept 32-bit hashes and their positions, in order of position."""
    n = len(points)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    k = min(k, n)
    starts = np.arange(n - k + 1)
    hashes = SpanHash(points)(starts, starts + k) >> np.uint64(32)
    # Hash above, position from the right below: the least number is the least hash, rightmost of equals.
    keys = hashes << np.uint64(32) | (np.uint64(0xFFFFFFFF) - starts.astype(np.uint64))
    window = min(window, len(keys))
    span = 1
    while span < window:  # least of the next ``span`` keys, doubled until the window is covered
        step = min(span, window - span)
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
        span += step
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    return (keys >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (keys & np.uint64(0xFFFFFFFF))).astype(np.int64)


def fingerprint(text: str) -> np.ndarray:
    return np.unique(winnow(code_points(text))[0])


def shown(marks: np.ndarray) -> str:
    """A fingerprint as text: its sorted hashes in base64."""
    return base64.b64encode(marks.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of marks; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as many first code points of ``after``, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """(part, ahead, doc_id, text): rows dealt out by descending doc_id, and to each part a copy of the row that follows its last one.

    Parts are cut at quantiles of doc_id; the copies are one row per part. Rows of one doc_id (a null one comes last) are ordered by text.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = sorted({-float(q) for q in slim.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)})
    # Searches the cuts, however many there are: the number of cuts at or above an id, greater ids first.
    places = Bucketizer(splits=[-math.inf, *(cuts or [1e300]), math.inf], inputCol="place", outputCol="bucket")
    dealt = places.transform(slim.withColumn("place", -F.coalesce("doc_id", F.lit(0)).cast("double")))
    part = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.col("bucket").cast("int"))
    dealt = dealt.select("doc_id", "text", part.alias("part"))
    ends = {r.part: r.top for r in dealt.groupBy("part").agg(F.max("doc_id").alias("top")).collect()}  # one row per part
    filled = sorted(ends)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}  # the first part follows the last
    rows = [(p, before[p], ends[p]) for p in filled]
    # The first row of a part in its order: the largest id, of equal ones the least text.
    spark = docs.sparkSession
    tops = spark.createDataFrame(rows, "part int, goes_to int, top long")
    firsts = (
        dealt.join(F.broadcast(tops), (dealt["part"] == tops["part"]) & dealt["doc_id"].eqNullSafe(tops["top"]))
        .groupBy("goes_to", "doc_id")
        .agg(F.min("text").alias("text"))
        .select(F.col("goes_to").alias("part"), F.lit(1).alias("ahead"), "doc_id", "text")
    )
    return dealt.select("part", F.lit(0).alias("ahead"), "doc_id", "text").unionByName(firsts)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the fingerprint of the text and of its edited text, and how alike they and the next document's are.

    The next document is that of the next lower doc_id; after the last comes the first; a document alone is its own next. A null text is empty. One shuffle of the
    texts; a task goes through its part in order and holds two texts.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: part, doc_id, text, fingerprint
        for batch in batches:
            rows = []
            for part, _ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = fingerprint(text)
                if held is not None and held[0] == part:
                    _, last_id, last, marks = held
                    changed = edited(last, text)
                    changed_marks = fingerprint(changed)
                    rows.append((last_id, len(last), hashlib.sha256(changed.encode()).hexdigest(), shown(marks), shown(changed_marks), likeness(marks, changed_marks), likeness(marks, own)))
                held = part, doc_id, text, own
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    dealt = in_order(docs, parts)
    ordered = dealt.repartitionByRange(parts, "part").sortWithinPartitions("part", "ahead", F.desc_nulls_last("doc_id"), "text")
    return ordered.mapInArrow(run, SCHEMA)
