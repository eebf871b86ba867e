"""The modules of the operators import all they use, in an interpreter that has loaded nothing else."""

import subprocess
import sys
import weakref
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from conftest_llm import ODD

from stratalake.llm import bpe, token_files
from stratalake.llm.common import kept, slices

ROOT = Path(__file__).resolve().parent.parent.parent

GROUPED = """
import pyarrow as pa
from stratalake.llm.common import grouped
rows = pa.RecordBatch.from_pydict({"k": [1, 1, 2], "v": [1, 2, 3]})
assert [t.num_rows for t in grouped(iter([rows, rows.slice(2)]), ["k"])] == [2, 2]
"""


def test_grouping_in_a_fresh_interpreter():
    done = subprocess.run([sys.executable, "-c", GROUPED], cwd=ROOT, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr


class Rows:
    """In place of a table: gives the function that a task would run."""

    def selectExpr(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_a_worker_keeps_the_state_of_one_operator():
    first = weakref.ref(bpe.bpe_of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    assert first() is bpe.bpe_of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    token_files.encoder_of(public_tokenizers.path("byte_bpe_50k.json"))
    assert first() is None
    assert kept(("a", 1), list) is kept(("a", 1), list)


def test_batches_are_taken_in_slices():
    batch = pa.RecordBatch.from_pydict({"id": list(range(8)), "text": ["x" * n if n else None for n in (0, 3, 3, 3, 3, 40, 3, 0)]})
    found = list(slices(iter([batch, batch.slice(0, 0)]), 1, most=10))
    assert [i for b in found for i in b.column(0).to_pylist()] == list(range(8))
    assert len(found) == 4 and all(sum(len(t or "") for t in b.column(1).to_pylist()[1:]) < 10 for b in found)


def test_encoding_gives_its_rows_in_parts(monkeypatch):
    ids, texts = zip(*ODD, strict=True)
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    run = bpe.encode_documents(Rows(), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)
    whole = list(run(iter([batch])))
    monkeypatch.setattr(bpe, "BATCH_CHARS", 1)
    parts = list(run(iter([batch])))
    assert len(whole) == 1 and len(parts) > 3
    assert pa.Table.from_batches(parts).to_pylist() == whole[0].to_pylist()
