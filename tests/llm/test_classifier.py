"""Quality classifier: held-out accuracy, folds, odd texts."""

import random
import zlib

import numpy as np
import pytest

from reviewlake.llm import quality_classifier as q


def test_held_out_accuracy(spark):
    table = "/root/testdata/sf0.1/"
    docs, labels = spark.read.parquet(table + "documents.parquet"), spark.read.parquet(table + "labels.parquet")
    found = q.classify(docs, labels).toPandas().merge(labels.toPandas()[["doc_id", "quality"]], on="doc_id")
    held = found[found.held_out]
    assert len(held) > 500 and (held.predicted == held.quality).mean() > 0.97
    assert -np.log(np.where(held.quality == 1, held.score, 1 - held.score).clip(1e-6)).mean() < 0.15


@pytest.fixture(scope="module")
def labels(spark, rows):
    rng = random.Random(2)
    return spark.createDataFrame([(r[0], rng.randint(0, 1), "clash") for r in rows], "doc_id bigint, quality int, text string")


def test_rows_and_folds(docs, rows, empty, labels):
    found = q.classify(docs, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert q.classify(empty, labels).count() == 0
    assert len({r.score for r in q.classify(docs, labels.limit(0)).collect()}) == 1


def test_word_vectors_add_up_neighbours(spark):
    texts = [(1, "aa bb cc aa"), (2, None), (3, "bb aa")]
    vectors = q.word_vectors(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3))
    places, signs = q.index_vectors()
    ids = {w: zlib.crc32(w.encode()) % q.BUCKETS for w in ("aa", "bb", "cc")}
    index = {w: np.zeros(q.DIM) for w in ids}
    for w, i in ids.items():
        index[w][places[i]] = signs[i]
    total = {w: np.zeros(q.DIM) for w in ids}
    for _, text in texts:
        words = (text or "").split()
        for i, w in enumerate(words):
            for j in range(max(0, i - q.REACH), min(len(words), i + q.REACH + 1)):
                if j != i:
                    total[w] += index[words[j]]
    for w, i in ids.items():
        assert np.allclose(vectors[i], total[w] / np.linalg.norm(total[w]), atol=1e-5)
