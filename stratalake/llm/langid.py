"""Language identification with a linear-chain conditional random field over words.

Each word (a run of letters and marks, in lower case) gets a score per language from its features: prefixes and suffixes of 1 to 4 letters,
letter n-grams of 2 and 3, and the word itself (the lexicon). Learned transition scores link neighbours, and forward-backward gives every word's
language probabilities given the whole text, so that a word that several languages share follows its neighbours and a text may switch languages. A
document's score for a language is the mean of its words' probabilities.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalake.llm.common import SpanHash, code_points, kept, kinds, runs, slices

#: Feature weights live in a table of this many rows (hashed), or of fewer so that it has no more than MOST_CELLS weights (from 65 languages on).
TABLE_BITS, MOST_CELLS = 17, 1 << 23
#: The model is fitted on at most this many labelled documents per language (those of the smallest hash), and on as many of each as make no more than
#: SAMPLE_TEXTS of all languages (from 67 languages on, but one of each), ...
SAMPLE_PER_LANG, SAMPLE_TEXTS = 300, 20_000
#: ... and on at most this many words from the middle of each.
SAMPLE_WORDS = 400
#: Words per block in forward-backward, and words handled at once.
BLOCK, CHUNK = 32, 1 << 16
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (2^bits, langs)
    moves: np.ndarray  # (langs, langs), from a word to the next

    @property
    def bits(self) -> int:
        return len(self.weights).bit_length() - 1


def table_bits(n_langs: int) -> int:
    """Of the rows of the table for so many languages."""
    return max(1, min(TABLE_BITS, (MOST_CELLS // max(1, n_langs)).bit_length() - 1))


def sample_size(n_langs: int) -> int:
    """Texts of each language that the model is fitted on."""
    return max(1, min(SAMPLE_PER_LANG, SAMPLE_TEXTS // max(1, n_langs)))


def features(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int = TABLE_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, row of the table) arrays, one pair per kind of feature, for the words between ``starts`` and ``ends``."""
    span, index, lengths = SpanHash(points), np.arange(len(starts)), ends - starts

    def rows(kind: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((span(a, b) + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int32)

    for n in range(1, 5):
        long = np.flatnonzero(lengths > n)
        yield long, rows(n, starts[long], starts[long] + n)
        yield long, rows(10 + n, ends[long] - n, ends[long])
    yield index, rows(20, starts, ends)
    owner = np.repeat(index, lengths)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place, left = np.repeat(starts, lengths) + at, np.repeat(lengths, lengths) - at
    for n in range(2, 4):
        fits = np.flatnonzero(left >= n)
        yield owner[fits], rows(30 + n, place[fits], place[fits] + n)


def emissions(model: Model, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words, langs) scores: the weights of a word's features, summed and divided by the root of their number."""
    n, m = len(starts), len(model.langs)
    out, count = np.zeros((n, m)), np.zeros(n)
    for word, row in features(points, starts, ends, model.bits):
        found = model.weights[row]
        if len(word) <= n and (not len(word) or word[-1] < n and np.all(word[1:] > word[:-1])):
            out[word] += found
            count[word] += 1
        else:
            for k in range(m):
                out[:, k] += np.bincount(word, weights=found[:, k], minlength=n)
            count += np.bincount(word, minlength=n)
    return out / np.sqrt(np.maximum(count, 1))[:, None]


def posteriors(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains laid end to end: (words, langs) probabilities, and the expected number of each transition.

    ``scores`` holds the word scores, ``lengths`` the words of each chain (at least 1). Chains are cut into blocks of ``BLOCK`` words that are gone through
    side by side: first the product of each block's step matrices, then the messages from block to block, then those inside the blocks.
    """
    n, m = scores.shape
    step = np.exp(moves - moves.max())
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    n_blocks = -(-lengths // BLOCK)
    first = np.cumsum(n_blocks) - n_blocks
    blocks = int(n_blocks.sum())
    # Where each word stands among the blocks, whose last ones are filled up.
    place = np.arange(n) + np.repeat(first * BLOCK - (np.cumsum(lengths) - lengths), lengths)
    padded, real = np.ones((blocks * BLOCK, m)), np.zeros(blocks * BLOCK, dtype=bool)
    padded[place], real[place] = emit, True
    padded, real = padded.reshape(blocks, BLOCK, m), real.reshape(blocks, BLOCK)
    entry, leave = np.full((blocks, m), 1.0 / m), np.full((blocks, m), 1.0 / m)
    if n_blocks.max() > 1:
        product = np.broadcast_to(np.eye(m), (blocks, m, m)).copy()
        for t in range(BLOCK):
            new = (product @ step) * padded[:, t, None, :]
            product = np.where(real[:, t, None, None], new / new.max(axis=(1, 2), keepdims=True), product)
        for k in range(1, int(n_blocks.max())):
            at = first[n_blocks > k] + k
            message = np.einsum("bi,bij->bj", entry[at - 1], product[at - 1])
            entry[at] = message / message.sum(axis=1, keepdims=True)
        for k in range(int(n_blocks.max()) - 2, -1, -1):
            at = first[n_blocks > k + 1] + k
            message = np.einsum("bij,bj->bi", product[at + 1], leave[at + 1])
            leave[at] = message / message.sum(axis=1, keepdims=True)
    ahead, back = np.empty((blocks, BLOCK, m)), np.empty((blocks, BLOCK, m))
    message = entry
    for t in range(BLOCK):
        message = (message @ step) * padded[:, t]
        message = message / message.sum(axis=1, keepdims=True)
        ahead[:, t] = message
    message = leave
    for t in range(BLOCK - 1, -1, -1):
        back[:, t] = message
        new = (padded[:, t] * message) @ step.T
        message = np.where(real[:, t, None], new / new.sum(axis=1, keepdims=True), message)
    ahead, back = ahead.reshape(-1, m)[place], back.reshape(-1, m)[place]
    out = ahead * back
    inner = np.ones(n, dtype=bool)
    inner[np.cumsum(lengths) - 1] = False  # the last word of a chain has no next
    here = np.flatnonzero(inner)
    following = emit[here + 1] * back[here + 1]
    weight = 1.0 / np.einsum("ni,ij,nj->n", ahead[here], step, following)
    pairs = step * ((ahead[here] * weight[:, None]).T @ following)
    return out / out.sum(axis=1, keepdims=True), pairs


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points in lower case, and starts and ends of the words in them; runs of marks without a letter are no words."""
    points = code_points(text.lower())
    starts, ends = runs(kinds(points) == 1)
    if len(starts) and not any(map(str.isalpha, text)):
        return points, starts[:0], ends[:0]
    return points, starts, ends


def predict(model: Model, texts: list[str]) -> Iterator[tuple[str, float, int, list[float]]]:
    """(language, score, number of words, mean probability per language) of each text; ``und``, 0, 0 and no means without a letter.

    Short texts are handled together; a text of more than ``CHUNK`` words is gone through in chains of that length.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for text in texts:
        held.append(words_of(text))
        if sum(len(h[1]) for h in held) >= CHUNK:
            yield from _predict(model, held)
            held = []
    yield from _predict(model, held)


def _predict(model: Model, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[str, float, int, list[float]]]:
    counts = np.array([len(h[1]) for h in held], dtype=np.int64)
    total, m = np.zeros((len(held), len(model.langs))), len(model.langs)
    pieces = [(d, k) for d, n in enumerate(counts.tolist()) for k in range(0, n, CHUNK)] if m else []
    at = 0
    while at < len(pieces):
        chosen, words = [], 0
        while at < len(pieces) and (not chosen or words + min(CHUNK, counts[pieces[at][0]] - pieces[at][1]) <= CHUNK):
            chosen.append(pieces[at])
            words += int(min(CHUNK, counts[pieces[at][0]] - pieces[at][1]))
            at += 1
        parts, starts, ends, size = [], [], [], 0
        for d, k in chosen:
            points, a, b = held[d]
            a, b = a[k : k + CHUNK], b[k : k + CHUNK]
            parts.append(points[a[0] : b[-1]])
            starts.append(a + (size - a[0]))
            ends.append(b + (size - a[0]))
            size += len(parts[-1])
        lengths = np.array([len(a) for a in starts])
        scores = emissions(model, np.concatenate(parts), np.concatenate(starts), np.concatenate(ends))
        found = posteriors(scores, lengths, model.moves)[0]
        np.add.at(total, [d for d, _ in chosen], np.add.reduceat(found, np.cumsum(lengths) - lengths, axis=0))
    for d, n in enumerate(counts.tolist()):
        if not n or not m:
            yield UNKNOWN, 0.0, 0, []
            continue
        share = total[d] / n
        best = int(share.argmax())
        yield model.langs[best], float(min(1.0, share[best])), n, share.tolist()


def fit(texts: list[tuple[str, str]], rounds: int = 3, seed: int = 7) -> Model:
    """Learn from (text, language) pairs by stochastic gradient (AdaGrad) on the chains' likelihood.

    Chains are spliced from passages of 4 to 40 words of different documents, so that transitions see switches. Results depend only on the pairs and the seed.
    """
    langs = sorted({lang for _, lang in texts})
    m, rng = len(langs), np.random.default_rng(seed)
    model = Model(langs, np.zeros((1 << table_bits(m), m)), np.zeros((m, m)))
    pieces = []
    for text, lang in sorted(texts):
        points, starts, ends = words_of(text)
        skip = max(0, (len(starts) - SAMPLE_WORDS) // 2)
        starts, ends = starts[skip : skip + SAMPLE_WORDS], ends[skip : skip + SAMPLE_WORDS]
        at = 0
        while at < len(starts):
            n = int(rng.integers(4, 41))
            a, b = starts[at : at + n], ends[at : at + n]
            pieces.append((points[a[0] : b[-1]], a - a[0], b - a[0], langs.index(lang)))
            at += n
    if m < 2 or not pieces:
        return model
    seen_w, seen_m, rate = np.full_like(model.weights, 1e-6), np.full_like(model.moves, 1e-6), 0.3
    for _ in range(rounds):
        order = rng.permutation(len(pieces))
        for k in range(0, len(order), 256):
            chosen = [pieces[i] for i in order[k : k + 256]]
            sizes = np.cumsum([0, *(len(p[0]) for p in chosen)])
            points = np.concatenate([p[0] for p in chosen])
            starts = np.concatenate([p[1] + s for p, s in zip(chosen, sizes, strict=False)])
            ends = np.concatenate([p[2] + s for p, s in zip(chosen, sizes, strict=False)])
            truth = np.concatenate([np.full(len(p[1]), p[3]) for p in chosen])
            scores = emissions(model, points, starts, ends)
            error, pairs = posteriors(scores, np.array([len(truth)]), model.moves)
            error[np.arange(len(truth)), truth] -= 1.0
            kinds_of = list(features(points, starts, ends, model.bits))
            word, row = np.concatenate([w for w, _ in kinds_of]), np.concatenate([r for _, r in kinds_of])
            error /= np.sqrt(np.bincount(word, minlength=len(starts)))[:, None]
            used, place = np.unique(row, return_inverse=True)
            gradient = np.stack([np.bincount(place, weights=error[:, j][word], minlength=len(used)) for j in range(m)], axis=1)
            seen_w[used] += gradient**2
            model.weights[used] -= rate * gradient / np.sqrt(seen_w[used])
            np.add.at(pairs, (truth[:-1], truth[1:]), -1.0)
            seen_m += pairs**2
            model.moves -= rate * pairs / np.sqrt(seen_m)
    model.weights = np.clip(model.weights, -20, 20).astype(np.float32)
    return model


def held_out(doc_id="doc_id"):
    """Whether a row is kept out of the fit: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """The labelled rows to fit on: of every language at most ``sample_size`` different texts, chosen by a hash of text and label alone.

    Null ids are not held out, as they have no remainder. Copies of a text count once. Rows reach the driver only after each task kept its share, at most
    so many of each language, and a piece of ``24 * SAMPLE_WORDS`` characters around the middle of each.
    """
    pool = docs.where(~held_out()).where("lang is not null and text is not null").select("text", F.col("lang").cast("string").alias("lang"))
    size = 24 * SAMPLE_WORDS
    keyed = pool.withColumn("h", F.xxhash64("text", "lang")).select(
        "lang", "h", F.substring("text", F.greatest(F.lit(1), F.floor((F.length("text") - size) / 2)).cast("int"), F.lit(size)).alias("text")
    )
    counts = keyed.select("lang", "h").distinct().groupBy("lang").count().collect()
    wanted = sample_size(len(counts))
    # About twice the texts wanted pass the hash, so that few rows leave each task whatever their number.
    least = [(lang, int(min(1.0, 2 * wanted / n) * (1 << 32))) for lang, n in counts]
    least = docs.sparkSession.createDataFrame(least, "lang string, least long")
    passed = keyed.join(F.broadcast(least), "lang").where(F.shiftrightunsigned("h", 32) < F.col("least")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    top = passed.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= wanted)
    return [(r.text, r.lang) for r in top.select("text", "lang").collect()]


def learn(docs: DataFrame) -> Model:
    """The model of the rows of ``docs`` (doc_id, text, lang) that are not held out."""
    return fit(sample(docs))


SCHEMA = "lang_pred string, score double, n_words long, lang_share map<string,double>"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), n_words and lang_share (mean probability per language), from the text alone.

    Null texts and those without a letter are ``und`` with score 0. All other columns are kept (ones of these names are replaced). One pass
    without a shuffle; the model is a table of fixed size that goes out with the tasks.
    """
    names = [c for c in docs.columns if c not in {s.split()[0] for s in SCHEMA.split(", ")}]
    docs = docs.select(*names)
    text_at = names.index("text")
    name = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept(("langid", name), lambda: Model(*sent.value))
        for batch in slices(batches, text_at):
            texts = [t or "" for t in batch.column(text_at).to_pylist()]
            rows = [(lang, score, n, list(zip(known.langs, shares, strict=False))) for lang, score, n, shares in predict(known, texts)]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            new = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, *(s.split()[0] for s in SCHEMA.split(", "))])

    from pyspark.sql.types import StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(SCHEMA).fields]))
