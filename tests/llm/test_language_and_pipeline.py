import importlib
import itertools
import zlib

import numpy as np
import pytest
from conftest_llm import ODD

from stratalake.llm import langid
from stratalake.llm.common import read

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


def crc32_mod(doc_id):
    """The remainder that ``held_out`` looks at."""
    return zlib.crc32(str(doc_id).encode()) % 3


def test_forward_backward_against_all_label_sequences(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 2)
    rng = np.random.default_rng(0)
    scores, moves, lengths = rng.normal(size=(11, 3)), rng.normal(size=(3, 3)), np.array([6, 1, 4])
    found, pairs = langid.posteriors(scores, lengths, moves)
    want, want_pairs = np.zeros((11, 3)), np.zeros((3, 3))
    for a, n in zip(np.cumsum(lengths) - lengths, lengths, strict=True):
        part, total, sums, steps = scores[a : a + n], 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for y in itertools.product(range(3), repeat=int(n)):
            weight = np.exp(sum(part[i, k] for i, k in enumerate(y)) + sum(moves[j, k] for j, k in itertools.pairwise(y))) * np.exp(moves[:, y[0]]).sum()
            total += weight
            for i, k in enumerate(y):
                sums[i, k] += weight
            for j, k in itertools.pairwise(y):
                steps[j, k] += weight
        want[a : a + n], want_pairs = sums / total, want_pairs + steps / total
    assert np.allclose(found, want) and np.allclose(pairs, want_pairs)


@pytest.fixture(scope="module")
def model(spark):
    return langid.learn(read(spark, MEDIUM, "documents"))


def test_held_out_accuracy(spark, model):
    docs = read(spark, MEDIUM, "documents")
    told = langid.identify(docs.select("doc_id", "text"), model).withColumn("held_out", langid.held_out()).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(told) > 250 and sum(r.lang == r.lang_pred for r in told) >= 0.98 * len(told)
    assert all(r.held_out == (crc32_mod(r.doc_id) == 1) for r in told)


def test_switching_text_is_labelled_by_parts(spark, model):
    texts = {r.lang: r.text for r in read(spark, MEDIUM, "documents").where("n_chars between 900 and 1200").collect()}
    mixed = texts["en"][:600] + " " + texts["de"][:600]
    _, _, n, shares = next(langid.predict(model, [mixed]))
    shares = dict(zip(model.langs, shares, strict=True))
    assert n > 100 and shares["en"] > 0.3 and shares["de"] > 0.3 and abs(sum(shares.values()) - 1) < 1e-9


def test_batches_chunks_and_blocks_change_nothing(model, monkeypatch):
    texts = [t or "" for _, t in ODD] + ["der die das und", "the of and with", "uno dos tres"]
    whole = list(langid.predict(model, texts))
    monkeypatch.setattr(langid, "BLOCK", 5)
    for one, all_ in zip((next(langid.predict(model, [t])) for t in texts), whole, strict=True):
        assert one[0] == all_[0] and abs(one[1] - all_[1]) < 1e-9


def test_labels_of_held_out_and_unlabelled_rows_are_not_seen(spark, documents):
    rows = [(i, f"{'aber und der ' if i % 2 else 'the and of '} number {i}", "de" if i % 2 else "en") for i in range(60)]
    changed = [(i, t, "zz" if crc32_mod(i) == 1 else lang) for i, t, lang in rows] + [(100, "some text", None), (101, None, "fr")]
    a, b = langid.learn(documents(rows)), langid.learn(documents(changed))
    assert (a.langs, a.langs) == (b.langs, ["de", "en"])
    assert all(lang != "zz" for _, lang in langid.sample(documents(changed)))


def test_every_label_is_learned(spark, documents):
    rows = [(3 * k + i, f"{chr(0x4E00 + k) * 3} {chr(0x4E00 + k) * 2} text", f"l{k:02d}") for k in range(70) for i in range(3)]
    rows = [r for r in rows if crc32_mod(r[0]) != 1] + [(1000 + i, f"word {i}", "en") for i in range(20)]
    labels = sorted({lang for _, _, lang in rows})
    assert len(labels) > 64 and sorted({lang for _, lang in langid.sample(documents(rows))}) == labels


def test_the_model_is_bounded_whatever_the_number_of_labels():
    for n in (0, 1, 2, 4, 64, 65, 67, 1000, 100_000):
        assert max(1, n) << langid.table_bits(n) <= max(langid.MOST_CELLS, 2 * n)
        assert n * langid.sample_size(n) <= max(langid.SAMPLE_TEXTS, n)
    assert [langid.table_bits(n) for n in (2, 64, 65)] == [17, 17, 16] and [langid.sample_size(n) for n in (2, 66, 200)] == [300, 300, 100]
    texts = [(f"{chr(0x4E00 + k) * 3} {chr(0x4E00 + k) * 2} x", f"l{k:03d}") for k in range(130)]
    model = langid.fit(texts, rounds=2)
    assert model.weights.shape == (1 << 15, 130)
    told = [t[0] for t in langid.predict(model, [t for t, _ in texts])]
    assert sum(a == b for a, (_, b) in zip(told, texts, strict=True)) >= 110


def test_copies_count_once_in_the_sample(spark, documents):
    rows = [(i, f"copy of text {i % k}", f"c{k}") for k in range(1, 9) for i in range(2000)]
    rows += [(i, f"other text {i}" if i % 10 == 0 else "the same text", "mixed") for i in range(10_000)]
    picked = langid.sample(documents(rows))
    assert len(picked) == len(set(picked))
    sizes = {lang: sum(x == lang for _, x in picked) for lang in {lang for *_, lang in rows}}
    assert sizes == {**{f"c{k}": k for k in range(1, 9)}, "mixed": langid.SAMPLE_PER_LANG}


def test_odd_rows(spark, documents, model):
    df = documents(ODD, extra=True)
    got = langid.identify(df, model)
    assert set(df.columns) - {"score"} < set(got.columns) and got.count() == len(ODD)
    for r in got.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    empty = langid.learn(documents([]))
    assert {r.lang_pred for r in langid.identify(df, empty).collect()} == {"und"}
    assert langid.identify(documents([]), model).count() == 0


def test_pipeline(spark, documents, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = read(spark, SMALL, "documents")
    for name, stage in pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SMALL)
        docs = docs.cache()
        assert docs.columns == before.columns and 0 < docs.count() <= before.count(), name
    last = pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in docs.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in pipeline.run(spark, SMALL).collect()) == sorted((r.doc_id, r.ids_sha256) for r in last)


def test_pipeline_takes_odd_tables(spark, documents):
    pipeline = importlib.import_module("corpus_pipeline")
    for rows in (ODD, []):
        docs = documents(rows, extra=True)
        for _, stage in pipeline.STAGES[:-1]:
            after = stage(spark, docs, SMALL)
            assert after.columns == docs.columns and after.count() <= docs.count()
            docs = after
        assert pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
