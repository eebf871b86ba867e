"""How the sources of a language differ in their words, from in-mapper stripes.

Each task folds the whole documents it reads into stripes: (language, term) -> (number of documents, occurrences per source). Stripes spill as rows when a task
holds many, and are merged by their key. The merged stripes give the divergences directly: a stripe has all that one term adds to the
distance of any two sources, so tasks add up the distances of their terms and hand over the most telling ones. All numbers are integers and exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalake.llm.common import stored

#: A term is a run of bytes of UTF-8 that are an ASCII letter or no ASCII at all; only A-Z change case.
GAP = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if GAP.match(bytes([b])) else b for b in range(256))
#: Texts are cut into words by pieces of about so many bytes; a task holds so many counts before it spills them.
PIECE = 1 << 20
MOST_COUNTS = 400_000
#: Terms that are dealt out together, and the cells (terms times sources) that a task looks at together.
TERMS_PER_PART = 1 << 14
CELLS = 1 << 21
#: A kept term is in so many documents of its language; smoothing; one in parts.
LEAST_DOCS, ADDED, ONE = 30, 5, 1_000_000_000
#: Stands for the documents themselves in the stripes; no term is empty.
DOCUMENTS = b""

_PARTIAL = "lang string, term binary, df long, source string, count long"
_STRIPES = "lang string, term binary, df long, sources array<string>, counts array<long>"
_FOUND = "lang string, source string, part string, item string, value long"


def term_counts(text: bytes) -> Counter[bytes]:
    """The terms of a text in UTF-8 and how often each occurs."""
    counts: Counter[bytes] = Counter()
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        counts.update(text[at:end].translate(_LOWER).split())
        at = end
    return counts


class Stripes:
    """The stripes of one language that a task holds. Most terms come in one document only; those are kept as (source, count)."""

    def __init__(self):
        self.once: dict[bytes, tuple[str, int]] = {}
        self.more: dict[bytes, list] = {}  # number of documents, {source: count}

    def add(self, source: str, counts: Counter[bytes]) -> int:
        """Fold one document in; gives how many counts came to the held ones."""
        once, more, new = self.once, self.more, 0
        for term, n in counts.items():
            stripe = more.get(term)
            if stripe is not None:
                stripe[0] += 1
                of = stripe[1]
                if source in of:
                    of[source] += n
                else:
                    of[source] = n
                    new += 1
                continue
            first = once.pop(term, None)
            new += 1
            if first is None:
                once[term] = (source, n)
            elif first[0] == source:
                more[term] = [2, {source: first[1] + n}]
            else:
                more[term] = [2, {first[0]: first[1], source: n}]
        return new

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        """Partial stripes as rows, one for each source; the first one has the number of documents."""

        def batch(terms: list, dfs: list, sources: list, counts: list) -> pa.RecordBatch:
            columns = [pa.repeat(pa.scalar(lang, pa.string()), len(terms)), pa.array(terms, pa.binary()), pa.array(dfs, pa.int64()), pa.array(sources, pa.string()), pa.array(counts, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "term", "df", "source", "count"])

        for part in batched(self.once.items(), 20_000):
            yield batch([t for t, _ in part], [1] * len(part), [s for _, (s, _) in part], [n for _, (_, n) in part])
        flat = ((term, df if i == 0 else 0, source, n) for term, (df, of) in self.more.items() for i, (source, n) in enumerate(of.items()))
        for part in batched(flat, 20_000):
            yield batch(*map(list, zip(*part, strict=True)))


def fold(docs: DataFrame, most_counts: int = MOST_COUNTS) -> DataFrame:
    """Partial stripes (lang, term, df, source, count) of documents (lang, source, text); the empty term counts the documents themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Stripes] = {}
        size = 0
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, batch.column("text").cast(pa.binary()), strict=True):
                counts = term_counts(text.as_py())
                counts[DOCUMENTS] = 1
                if lang not in held:
                    held[lang] = Stripes()
                size += held[lang].add(source, counts)
                if size >= most_counts:  # spill
                    for name, stripes in held.items():
                        yield from stripes.rows(name)
                    held, size = {}, 0
        for name, stripes in held.items():
            yield from stripes.rows(name)

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*text).mapInArrow(run, _PARTIAL)


def merge(partial: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One stripe for each language and term in at least ``least_docs`` documents, and one of the documents of each language.

    A task reads partial stripes with equal keys side by side. It adds up the numbers of documents of a batch at once and looks only at the sources of
    the terms that stay, one stripe at a time, of as many entries as the language has sources.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged() -> Iterator[tuple[str, bytes, int, dict[str, int]]]:
            key, df, counts = None, 0, {}

            def whole() -> bool:
                return key is not None and (df >= least_docs or key[1] == DOCUMENTS)

            for batch in batches:
                if not batch.num_rows:
                    continue
                lang, term, dfs, source, count = batch.columns
                starts = np.flatnonzero(np.concatenate(([True], _differ(lang) | _differ(term))))
                ends = np.append(starts[1:], batch.num_rows)
                docs = np.add.reduceat(dfs.to_numpy(), starts)
                looked_at = docs >= least_docs
                looked_at |= np.asarray(pc.equal(term, DOCUMENTS))[starts]
                looked_at[[0, -1]] = True  # these may go on in another batch
                for k in np.flatnonzero(looked_at).tolist():
                    a, n = int(starts[k]), int(ends[k] - starts[k])
                    found = (lang[a].as_py(), term[a].as_py())
                    if found != key:
                        if whole():
                            yield *key, df, counts
                        key, df, counts = found, 0, {}
                    df += int(docs[k])
                    for s, c in zip(source.slice(a, n).to_pylist(), count.slice(a, n).to_pylist(), strict=True):
                        counts[s] = counts.get(s, 0) + c
            if whole():
                yield *key, df, counts

        for part in batched(merged(), 1000):
            columns = [
                pa.array([s[0] for s in part], pa.string()),
                pa.array([s[1] for s in part], pa.binary()),
                pa.array([s[2] for s in part], pa.int64()),
                pa.array([list(s[3]) for s in part], pa.list_(pa.string())),
                pa.array([list(s[3].values()) for s in part], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "df", "sources", "counts"])

    # A number sorts faster than the terms; what matters is that equal keys meet.
    keyed = partial.withColumn("key", F.xxhash64("lang", "term")).repartition("key").sortWithinPartitions("key", "lang", "term")
    return keyed.drop("key").mapInArrow(run, _STRIPES)


def _differ(column: pa.Array) -> np.ndarray:
    """Which values differ from the one before, from the second on."""
    return np.asarray(pc.not_equal(column[1:], column[:-1]))


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(ONE * counts / totals) for 0 <= counts <= totals < 2^53, by long division in three steps so that nothing overflows."""
    quotient, rest = np.zeros(np.broadcast(counts, totals).shape, dtype=np.int64), counts + 0 * totals
    for _ in range(3):
        rest = rest * 1000
        quotient = quotient * 1000 + rest // totals
        rest = rest % totals
    return quotient + 1


class _Language:
    """The sources of a language, and the kept terms that a task has not looked at yet."""

    def __init__(self, lang: str, sources: list[str], counted: list[int], n_terms: int, top: int, cells: int):
        self.lang, self.sources, self.top = lang, sources, top
        self.place = {s: i for i, s in enumerate(sources)}
        self.totals = np.array(counted, dtype=np.int64) + ADDED * n_terms
        self.total = np.int64(sum(counted) + ADDED * n_terms)
        self.room = max(1, cells // len(sources))
        self.terms: list[bytes] = []
        self.cells: list[tuple[list[int], list[int]]] = []

    def add(self, term: bytes, sources: list[str], counts: list[int]) -> Iterator[pa.RecordBatch]:
        self.terms.append(term)
        self.cells.append(([self.place[s] for s in sources], counts))
        if len(self.terms) == self.room:
            yield from self.found()

    def found(self) -> Iterator[pa.RecordBatch]:
        """What the held terms add to the distance of each pair of sources, and the top terms of each source among them."""
        if not self.terms:
            return
        counts = np.zeros((len(self.terms), len(self.sources)), dtype=np.int64)
        for row, (places, ns) in zip(counts, self.cells, strict=True):
            row[places] = ns
        p = shares(counts + ADDED, self.totals)
        gap = p - shares(counts.sum(axis=1) + ADDED, self.total)[:, None]
        gap[counts == 0] = 0
        names = pa.array(self.sources, pa.string())
        for i, source in enumerate(self.sources):
            distance = np.abs(p - p[:, i : i + 1]).sum(axis=0)
            others = np.flatnonzero(np.arange(len(self.sources)) != i)
            yield self._rows(source, "pair", names.take(pa.array(others)), distance[others])
            more = np.flatnonzero(gap[:, i] > 0)
            if len(more) > self.top:  # equal values at the border are settled by the terms
                border = np.partition(gap[more, i], -self.top)[-self.top]
                more = more[gap[more, i] >= border]
            best = sorted(more.tolist(), key=lambda t: (-gap[t, i], self.terms[t]))[: self.top]
            yield self._rows(source, "term", pa.array([self.terms[t].decode() for t in best], pa.string()), gap[best, i] if best else np.zeros(0, dtype=np.int64))
        self.terms, self.cells = [], []

    def _rows(self, source: str, part: str, items: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        same = [pa.repeat(pa.scalar(x, pa.string()), len(items)) for x in (self.lang, source, part)]
        return pa.RecordBatch.from_arrays([*same, items, pa.array(values, pa.int64())], names=["lang", "source", "part", "item", "value"])


def _emitted(kept: DataFrame, totals: DataFrame, top: int, terms_per_part: int, cells: int) -> DataFrame:
    """(lang, source, part, item, value): per task, what its terms add to each pair, and its top terms of each source.

    Terms are dealt out by hash; the totals of a language, one row, go ahead of each of its parts.
    """
    parts = max(1, -(-kept.count() // terms_per_part))
    dealt = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(parts)).alias("deal"), F.lit(None).cast("long").alias("n_terms"), "term", "sources", "counts")
    heads = dealt.select("lang", "deal").distinct().join(totals, "lang").select("lang", "deal", "n_terms", F.lit(None).cast("binary").alias("term"), "sources", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Language | None = None
        for batch in batches:
            for lang, n_terms, term, sources, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if term is None:
                    if now is not None:
                        yield from now.found()
                    now = _Language(lang, sources, counts, n_terms, top, cells)
                else:
                    yield from now.add(term, sources, counts)
        if now is not None:
            yield from now.found()

    rows = heads.unionByName(dealt).repartition("lang", "deal").sortWithinPartitions("lang", "deal", F.col("term").asc_nulls_first())
    return rows.drop("deal").mapInArrow(run, _FOUND)


def divergences(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    top: int = 50,
    most_counts: int = MOST_COUNTS,
    terms_per_part: int = TERMS_PER_PART,
    cells: int = CELLS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (lang, source, text), whose nulls count as empty; other columns are ignored.

    Every language keeps its terms in ``least_docs`` documents or more, V of them. A group, all documents of a language and source, gives a kept term the
    share p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N its occurrences of kept terms; so does the language as a whole. Part ``pair``: for each other
    source of the language, the sum of the differences of shares over the kept terms (0 without any). Part ``term``: the ``top`` terms
    that a group has and uses more than its language, by the difference. Ranks begin at 1, greater values first, equal ones by the item's bytes.

    Repeated rows count as often as they stand there; an empty table gives no row; a group without terms is compared like any other. A task holds
    ``most_counts`` counts and the terms of one document while it folds, one stripe while it merges, and ``cells`` cells afterwards. A hot source or term costs no
    task more than others: it reaches the merge as one partial stripe of each task and spill.
    """
    stripes = stored(merge(fold(docs, most_counts), least_docs), "stripes")
    marks, kept = stripes.where(F.col("term") == F.lit(DOCUMENTS)), stripes.where(F.col("term") != F.lit(DOCUMENTS))
    counted = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    groups = marks.select("lang", F.explode("sources").alias("source")).join(counted, ["lang", "source"], "left")
    terms = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    by_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"))
    totals = stored(
        by_lang.join(terms, "lang", "left").select("lang", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.col("g.source").alias("sources"), F.col("g.n").alias("counts")),
        "totals",
    )

    found = stored(_emitted(kept, totals.where("n_terms > 0"), top, terms_per_part, cells), "found")
    # Languages without kept terms: every pair has the distance 0.
    wordless = totals.where("n_terms = 0").select("lang", "sources", F.explode("sources").alias("source")).repartition("lang", "source")
    zero = wordless.select("lang", "source", F.explode("sources").alias("item"), F.lit(0).cast("long").alias("value")).where("item <> source")
    sums = found.where("part = 'pair'").select("lang", "source", "item", "value").unionByName(zero).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    best = found.where("part = 'term'").select("lang", "source", "part", "item", "value", rank).where(F.col("rank") <= top)
    return pairs.unionByName(best)
