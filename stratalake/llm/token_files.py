"""Files of token ids in shuffled byte or bit planes.

A file holds blocks of ``BLOCK`` ids (the last may be shorter). A block's ids are 32-bit numbers, taken apart into planes: all
lowest bytes, all second bytes, and so on (or all lowest bits, ...). Planes that belong together compress far better than whole ids do.
Every plane is one zstandard frame. After the blocks come two zstandard frames: the chunk index (per block the number of its
ids, its file offset and the lengths of its planes) and the document index (doc_id, whether it is null, number of ids). A fixed-size tail
tells where the indexes are:

    magic "TIDS" | planes ... | chunk index | document index | tail: offset and length of both indexes, planes per block, magic

Documents follow each other in ascending doc_id, and so do the files of one table.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.bpe import MEMO_CHARS
from stratalake.llm.common import kept, stored
from stratalake.sources.storage import scratch_dir

MAGIC = b"TIDS"
BLOCK = 1 << 16
TAIL = struct.Struct("<QQQQI4s")


def split_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """The planes of 32-bit ids: 4 byte planes or 32 bit planes."""
    as_bytes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [np.ascontiguousarray(as_bytes[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def join_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).copy().view("<u4").reshape(-1)
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


class Writer:
    """Writes one file; keeps one block of ids in memory."""

    def __init__(self, stream, planes: int = 4, level: int = 3):
        self.stream, self.planes = stream, planes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.at = 0
        self.chunks: list[int] = []
        self.doc_ids: list[int] = []
        self.is_null: list[bool] = []
        self.lengths: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def add(self, doc_id: int | None, ids: Sequence[int]) -> None:
        self.doc_ids.append(doc_id or 0)
        self.is_null.append(doc_id is None)
        self.lengths.append(len(ids))
        self.held.append(np.asarray(ids, dtype="<u4"))
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            held = np.concatenate(self.held)
            whole = len(held) - len(held) % BLOCK
            for k in range(0, whole, BLOCK):
                self._block(held[k : k + BLOCK])
            self.held, self.n_held = [held[whole:]], len(held) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.chunks += [len(ids), self.at]
        self.chunks += [self._put(self.zstd.compress(p)) for p in split_planes(ids, self.planes)]

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        start = self.at
        first = self._put(self.zstd.compress(np.array(self.chunks, dtype="<i8").tobytes()))
        docs = b"".join(np.array(x, dtype=t).tobytes() for x, t in ((self.doc_ids, "<i8"), (self.lengths, "<i8"), (self.is_null, "u1")))
        second = self._put(self.zstd.compress(docs))
        self._put(TAIL.pack(start, first, start + first, second, self.planes, MAGIC))
        self.stream.close()


class Reader:
    """Reads one file; any block by itself through the chunk index."""

    def __init__(self, file):
        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        size = file.size()
        *places, self.planes, magic = TAIL.unpack(self._at(size - TAIL.size, TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        self.chunks = np.frombuffer(self.zstd.decompress(self._at(*places[:2])), dtype="<i8").reshape(-1, 2 + self.planes)
        docs = self.zstd.decompress(self._at(*places[2:]))
        n = len(docs) // 17
        self.doc_ids, self.lengths = np.frombuffer(docs, "<i8", n), np.frombuffer(docs, "<i8", n, 8 * n)
        self.is_null = np.frombuffer(docs, "u1", n, 16 * n).astype(bool)

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def block(self, k: int) -> np.ndarray:
        n, offset, *lengths = self.chunks[k].tolist()
        data, planes, at = self._at(offset, sum(lengths)), [], 0
        for length in lengths:
            planes.append(self.zstd.decompress(data[at : at + length]))
            at += length
        return join_planes(planes, n)

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """(doc_id, number of ids, pieces of the ids) of each document; holds a block at a time, and a document's pieces."""
        k, block, at = 0, np.zeros(0, dtype="<u4"), 0
        for doc_id, null, n in zip(self.doc_ids.tolist(), self.is_null.tolist(), self.lengths.tolist(), strict=True):
            pieces, left = [], n
            while left:
                if at == len(block):
                    block, at, k = self.block(k), 0, k + 1
                pieces.append(block[at : at + left])
                at += len(pieces[-1])
                left -= len(pieces[-1])
            yield None if null else doc_id, n, pieces


#: A space beside other white space or at the end.
BESIDE = re.compile(r" (?:\s|\Z|(?<=\s ))")


class WordEncoder:
    """The tokenizers library, asked once for each word that follows a space while the memo holds it.

    Byte-level pre-tokenization never joins a word with a space that follows it, so a text's ids are those of its words, each with the space
    before it. The words of a text that the memo lacks go to the library as one text: the ids that begin with a space tell where each starts.
    Texts where a space follows or precedes other white space are handed over whole, as are those with the string of an added token and those that do
    not come back in as many words. No such word is in the memo, so only the words that it lacks are searched for them. The string of a special token becomes
    that token's id, as the library does it; with ``special_as_text`` it is ordinary text.
    """

    def __init__(self, path: str, most: int = 1_000_000, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.library.no_truncation()
        added = [t.content for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.whole = re.compile("|".join([BESIDE.pattern, *map(re.escape, added)]))
        self.across = [a for a in added if " " in a]  # these are not found in single words
        vocabulary = self.library.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # how byte-level tokens write a space
        self.memo: dict[str, bytes] = {}
        self.most = most

    def _ask(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text."""
        first, *words = text.split(" ")
        if not first or any(a in text for a in self.across):
            return self._ask(text)
        if len(self.memo) > self.most:
            self.memo.clear()
        found = list(map(self.memo.get, words))
        gaps = [] if all(found) else [i for i, ids in enumerate(found) if ids is None]
        new = list({words[i] for i in gaps})
        asked_text = " ".join([first, *new])
        # The last word of a text may end in white space, but what the memo takes must fit anywhere.
        if self.whole.search(asked_text + " ." if words else asked_text):
            return self._ask(text)
        asked = self._ask(asked_text)
        starts = np.flatnonzero(self.spaced[asked])
        if len(starts) != len(new):
            return self._ask(text)
        cuts, data = [*(4 * starts).tolist(), 4 * len(asked)], asked.tobytes()
        self.memo.update(zip(new, [data[a:b] for a, b in pairwise(cuts)], strict=True))
        for i in gaps:
            found[i] = self.memo[words[i]]
        for w in new:
            if len(w) > MEMO_CHARS:
                del self.memo[w]
        return np.frombuffer(b"".join([data[: cuts[0]], *found]), dtype="<u4")


def encoder_of(path: str, special_as_text: bool = False) -> WordEncoder:
    return kept(("words", path, special_as_text), lambda: WordEncoder(path, special_as_text=special_as_text))


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str, planes: int = 4, special_as_text: bool = False
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) with the tokenizers library into files below ``folder``; returns their list, written as a table.

    One shuffle deals the texts out by ranges of doc_id; each task sorts its range and writes one file under a name of its own attempt, and the
    list names the files of the attempts that count, so a lost executor leaves at worst a file that nobody reads. A null or empty text is
    just ``end_id``; null doc_ids come first; rows of one doc_id are ordered by text; other columns are ignored. The string of a special token in a text
    becomes that token's id, as the library does it; with ``special_as_text`` it is encoded as ordinary text.
    The list (part, file, n_docs, n_tokens, start) has one row per file.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    os_fs, root = pafs.FileSystem.from_uri(folder)
    os_fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, fs = encoder_of(tokenizer, special_as_text), np.array([end_id], dtype="<u4"), pafs.FileSystem.from_uri(folder)[0]
        part, writer, docs_n, tokens = TaskContext.get().partitionId(), None, 0, 0
        file = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.tids"
        for batch in batches:
            if writer is None:
                writer = Writer(fs.open_output_stream(file), planes)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.encode(text.as_py() or ""), end)
                writer.add(doc_id, ids)
                docs_n, tokens = docs_n + 1, tokens + len(ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [file], "n_docs": [docs_n], "n_tokens": [tokens]})

    ordered = docs.selectExpr("cast(doc_id as long) doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    files = stored(ordered.mapInArrow(run, "part long, file string, n_docs long, n_tokens long"), "token-files")
    # One row per file, so the running sum over them is small whatever the number of documents.
    starts, at = [], 0
    for f in sorted(files.collect(), key=lambda f: f.part):
        starts.append((*f, at))
        at += f.n_tokens
    return spark.createDataFrame(starts, "part long, file string, n_docs long, n_tokens long, start long")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """Per document of the listed files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as 32-bit little-endian)."""
    root = folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(root)[0]
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(file) as f:
                    rows = []
                    for doc_id, n, pieces in Reader(f).documents():
                        crc = 0
                        for piece in pieces:
                            crc = zlib.crc32(piece.tobytes(), crc)
                        rows.append((doc_id, start, n, crc))
                        start += n
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    n = max(1, files.count())
    return files.select("file", "start").repartition(n, F.col("file")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2, planes: int = 4) -> DataFrame:
    """Encode, write and read back: one row per document (see the two functions above). An empty table gives no file and no row."""
    folder = scratch_dir(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer, end_id, folder, planes), folder)
