"""Byte-level BPE encoding and decoding with a rank queue on a hierarchical bitmap.

A text is cut by the vocabulary's pattern; each cut ("pre-token") is merged by itself. The queue has one bucket per
merge rank, which holds the positions of the linked list of parts whose pair has that rank. Two levels of 256-bit
words tell which buckets are filled, so the next rank is found with two find-first-set steps whatever the number of
parts: a pre-token of n bytes takes O(n log n) steps, where a scan for the least rank after each merge takes O(n^2).
Entries are not removed when a neighbour merges; they are skipped when they come up and their pair has changed.

Short pre-tokens that a memo lacks go through one queue together: the least rank of all is the least of each pre-token
that has it, and no pair crosses from one to the next. So a rank is looked for once for all that have it.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from bisect import bisect
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stratalake.llm.common import kept

#: Longer pre-tokens and words are not kept in a memo.
MEMO_CHARS = 40
#: Longer pre-tokens go through a queue of their own.
ALONE_BYTES = 256
#: As many bytes of pre-tokens share a queue, and as many characters of texts are encoded at a time (one text at least).
QUEUE_BYTES, BATCH_CHARS = 1 << 14, 1 << 20
#: All white space, as the pattern sees it.
SPACES = frozenset(regex.findall(r"\s", "".join(map(chr, range(sys.maxunicode + 1)))))
#: What stands first or last where a word is missing or white space follows: nothing, or white space.
NO_WORD = SPACES | {""}


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: per line a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Memo:
    """The entries used last, in two generations: what the later one lacks moves there from the older one, which goes when the later one is full."""

    def __init__(self, most: int):
        self.most, self.recent, self.older = most, {}, {}

    def __len__(self) -> int:
        return len(self.recent) + len(self.older)

    def lacking(self, keys: set[str]) -> set[str]:
        """The keys that have no entry; after this, all others have theirs in ``recent``."""
        missing, older = keys.difference(self.recent), self.older
        self.recent.update([(k, older[k]) for k in missing if k in older])
        return missing.difference(older)

    def age(self) -> None:
        """Between two batches: one generation has at most half of the entries and what a batch added to them."""
        if len(self.recent) > self.most // 2:
            self.older = self.recent if len(self.recent) <= self.most else {}
            self.recent = {}


class Bpe:
    """Encoder and decoder for the ranks of a vocabulary and the pattern that cuts texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 700_000):
        self.ranks = ranks
        self.cuts = regex.compile(pattern)
        self.longest = max(map(len, ranks))
        tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.digits = pa.array([b" %d" % rank for rank in range(len(tokens))], pa.large_binary())
        self.pairs = np.array([ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)], np.int32)
        self.words_of_bits = [0] * ((len(tokens) >> 8) + 1)  # all 0 between merges
        self.words = Memo(memo)  # by word, for a space and the word
        self.others = Memo(memo)  # by pre-token, without a space before it

    def merge(self, cut: str) -> tuple[int, ...]:
        """The ids of one pre-token: a whole token stays; else the pair of least rank, leftmost, merges until none is left."""
        piece = cut.encode()
        ranks, longest, n = self.ranks, self.longest, len(piece)
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        get, buckets, words, top = ranks.get, {}, self.words_of_bits, 0
        after = list(range(1, n + 1))  # where the part that starts here ends, and so the next one starts
        before = list(range(-1, n))
        pair = [-1] * n  # the rank of the part that starts here with the next one; -1: none
        for i in range(n - 1):
            if (rank := get(piece[i : i + 2], -1)) >= 0:
                pair[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    words[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
        while top:
            high = (top & -top).bit_length() - 1
            word = words[high]
            rank = high << 8 | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[high] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if pair[i] != rank:
                continue  # stale: one of the two parts has merged meanwhile
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = pair[i] = -1
            if end < n:
                before[end] = i
            left = before[i]
            if left >= 0:
                pair[left] = -1
            for start, stop in ((left, end), (i, after[end] if end < n else 0)):
                if 0 <= start and 0 < stop - start <= longest and (rank := get(piece[start:stop], -1)) >= 0:
                    pair[start] = rank
                    if rank in buckets:
                        heappush(buckets[rank], start)
                    else:
                        buckets[rank] = [start]
                        words[rank >> 8] |= 1 << (rank & 255)
                        top |= 1 << (rank >> 8)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(ids)

    def merge_together(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens as ``merge`` finds them, as 4 bytes each, by one queue for all."""
        ranks, get, buckets, words, top = self.ranks, self.ranks.get, {}, self.words_of_bits, 0
        data = b"".join([piece + b" " for piece in pieces])  # a position after each pre-token, where no part starts
        n, stops = len(data), np.cumsum([len(piece) + 1 for piece in pieces]) - 1
        codes, links = np.frombuffer(data, np.uint8).astype(np.int32), np.arange(1, n + 1)
        first = np.append(self.pairs[codes[:-1] << 8 | codes[1:]], np.int32(-1))
        first[stops] = first[stops - 1] = -1
        links[stops] = 0
        after = links.tolist()  # where the part that starts here ends, and so the next one starts; 0: past the end
        links = np.arange(-1, n - 1)
        links[0] = links[stops[:-1] + 1] = -1
        before = links.tolist()
        pair = first.tolist()  # the rank of the part that starts here with the next one; -1: none, -2: no part starts here
        ends = stops.tolist()
        order = np.argsort(first, kind="stable")[int((first < 0).sum()) :]
        edges = np.flatnonzero(np.diff(first[order], prepend=-1, append=-1)).tolist()
        starts = order.tolist()
        for lo, hi in zip(edges, edges[1:], strict=False):
            buckets[rank := pair[starts[lo]]] = starts[lo:hi]
            words[rank >> 8] |= 1 << (rank & 255)
            top |= 1 << (rank >> 8)
        while top:
            high = (top & -top).bit_length() - 1
            word = words[high]
            rank = high << 8 | (word & -word).bit_length() - 1
            words[high] = word = word & (word - 1)
            if not word:
                top &= top - 1
            bucket = buckets.pop(rank)
            bucket.sort()
            wait, waiting = 0, []
            for i in bucket:
                if pair[i] != rank:
                    continue  # stale: one of the two parts has merged meanwhile
                if i < wait:
                    waiting.append(i)
                    continue
                gone = after[i]
                end = after[i] = after[gone]
                pair[gone] = -2
                before[end] = i
                if stop := after[end]:
                    pair[i] = new = get(data[i:stop], -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            words[new >> 8] |= 1 << (new & 255)
                            top |= 1 << (new >> 8)
                        if new < rank:
                            wait = ends[bisect(ends, i)]
                else:
                    pair[i] = -1
                left = before[i]
                if left >= 0:
                    pair[left] = new = get(data[left:end], -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            buckets[new] = [left]
                            words[new >> 8] |= 1 << (new & 255)
                            top |= 1 << (new >> 8)
                        if new < rank:  # it comes before what else this pre-token has in the bucket
                            wait = ends[bisect(ends, i)]
            if waiting:
                buckets[rank] = waiting
                words[rank >> 8] |= 1 << (rank & 255)
                top |= 1 << (rank >> 8)
        begins = np.array(pair) == -1
        begins[stops] = False
        parts = np.flatnonzero(begins)
        ids = np.array([ranks[data[i : after[i]]] for i in parts.tolist()], "<i4").tobytes()
        cuts = (4 * np.searchsorted(parts, stops)).tolist()
        return [ids[lo:hi] for lo, hi in zip([0, *cuts], cuts, strict=False)]

    def merge_all(self, cuts: list[str]) -> Iterator[bytes]:
        """The ids of each pre-token, as 4 bytes each."""
        out: list[bytes] = []
        short: list[tuple[int, bytes]] = []
        size = 0
        for at, cut in enumerate(cuts):
            piece = cut.encode()
            if (whole := self.ranks.get(piece)) is not None:
                out.append(whole.to_bytes(4, "little"))
            elif len(piece) > ALONE_BYTES:
                out.append(np.array(self.merge(cut), "<i4").tobytes())
            else:
                out.append(b"")
                short.append((at, piece))
                size += len(piece) + 1
            if short and (size >= QUEUE_BYTES or at == len(cuts) - 1):
                for (place, _), ids in zip(short, self.merge_together([piece for _, piece in short]), strict=True):
                    out[place] = ids
                short, size = [], 0
        return iter(out)

    def _joined(self, cuts: list[str]) -> bytes:
        words, others = self.words.recent, self.others.recent
        return b"".join([words[c[1:]] if c[0] == " " and c[1:2] not in NO_WORD else others[c] for c in cuts])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 4 bytes each.

        No pre-token of the pattern goes on past the end of a word into a space, so texts are taken apart there
        and each word is cut by the pattern once; where spaces follow other white space, the whole text is cut.
        What the memos lack is merged together.
        """
        split, words, others = [text.split(" ") for text in texts], self.words, self.others
        unknown = words.lacking(set().union(*[parts[1:-1] for parts in split]))
        odd = {w for w in unknown if w[:1] in NO_WORD or w[-1] in SPACES}
        plans: list[tuple[list[str], list[str], list[str]]] = []  # cuts at the start, words, cuts at the end
        for text, parts in zip(texts, split, strict=True):
            first, last = parts[0], parts[-1]
            if len(parts) == 1 or first[-1:] in NO_WORD or last[:1] in NO_WORD or not odd.isdisjoint(parts[1:-1]):
                plans.append((self.cuts.findall(text), [], []))
            else:
                plans.append((self.cuts.findall(first), parts[1:-1], self.cuts.findall(" " + last)))
        del split
        unknown -= odd
        several: dict[str, list[str]] = {}
        for w in unknown:
            if not (w.isascii() and w.isalpha()) and len(cuts := self.cuts.findall(" " + w)) > 1:
                several[w] = cuts
        cut = {c for start, _, end in plans for cuts in (start, end) for c in cuts}.union(*several.values())
        spaced = {c for c in cut if c[0] == " " and c[1:2] not in NO_WORD}
        new_words = words.lacking({c[1:] for c in spaced}.union(unknown.difference(several)))
        new_others = others.lacking(cut - spaced)
        merged = self.merge_all([*(" " + w for w in new_words), *new_others])
        words.recent.update(zip(new_words, merged, strict=False))
        others.recent.update(zip(new_others, merged, strict=True))
        words.recent.update([(w, self._joined(cuts)) for w, cuts in several.items()])
        get = words.recent.__getitem__
        out = [b"".join((self._joined(start), *map(get, parts), self._joined(end))) for start, parts, end in plans]
        for memo, new in ((words, chain(new_words, several)), (others, new_others)):
            for key in [k for k in new if len(k) > MEMO_CHARS]:
                del memo.recent[key]
            memo.age()
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return np.frombuffer(self.encode_all([text])[0], "<i4").tolist()

    def strings(self, of: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, memoryview]:
        """The entries of ``of`` at the ids, end to end: where each starts and the last ends, and the bytes."""
        taken = of.take(pa.array(ids))
        if taken.null_count:
            raise KeyError("an id that no token has")
        _, offsets, data = taken.buffers()
        return np.frombuffer(offsets, np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64), memoryview(data or b"")

    def decode(self, ids: Iterable[int]) -> bytes:
        ids = np.fromiter(ids, np.int64)
        ends, data = self.strings(self.tokens, ids)
        return bytes(data[: ends[-1]])


def bpe_of(path: str, pattern: str) -> Bpe:
    """The encoder of a rank file, loaded once per Python worker and kept until it turns to another operator."""
    return kept(("bpe", path, pattern), lambda: Bpe(load_ranks(path), pattern))


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _parts(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column, null as empty, in lists of about BATCH_CHARS characters."""
    texts, size = [], 0
    for value in column:
        texts.append(text := value.as_py() or "")
        size += len(text)
        if size >= BATCH_CHARS:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): number of ids, digests of the ids and of the decoded bytes, and the ids on demand.

    ``ids_sha256`` is over the decimal ids joined by one space, ``decoded_sha256`` over the bytes that the ids decode to.
    A null or empty text has no ids; a null ``doc_id`` stays null; repeated rows give repeated results; other columns
    are ignored. One pass without a shuffle; a task holds one batch of rows and the memo.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path, pattern)
        for batch in batches:
            at = 0
            for texts in _parts(batch.column(1)):
                encoded = bpe.encode_all(texts)
                counts = np.array([len(ids) // 4 for ids in encoded], np.int64)
                ids, edges = np.frombuffer(b"".join(encoded), "<i4"), np.append(0, np.cumsum(counts))
                columns = [batch.column(0).slice(at, len(texts)), pa.array(counts)]
                for of, skip in ((bpe.digits, 1), (bpe.tokens, 0)):
                    offsets, data = bpe.strings(of, ids)
                    bounds = offsets[edges].tolist()
                    columns.append(pa.array([hashlib.sha256(data[lo + skip : hi]).hexdigest() for lo, hi in pairwise(bounds)], pa.string()))
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])
                at += len(texts)

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
