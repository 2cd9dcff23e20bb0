"""Collocations against a count of every n-gram, and the promise of the summaries."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from reviewlake.llm import collocations
from reviewlake.llm.frequent import MisraGries, counted

from .conftest import LOWER


def plain(rows):
    """What the contract says, from a count of every n-gram."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            f.update((lang or "und", tuple(words[i:i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    for lang in n:
        own = {p: a for (own_lang, p), a in f.items() if own_lang == lang and a >= 30}
        held = Counter()
        for p, a in own.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i:i + k]] = max(held[p[i:i + k]], a)
        kept = []
        for p, a in own.items():
            if len(p) > 1 and 100 * held[p] < 80 * a:
                score, _, left, right = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:2000], 1)]
    return Counter(out)


def made(seed=5, n=900):
    rng = random.Random(seed)
    words = [*"abcdefgh", "É", "ñu", "x\x1cy", "ZZ", "<|e|>"]
    rows = [(" ".join(rng.choice([*words, "New York City.", "in\tthe  house", "a,b", "de la casa"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, "und"]))
            for _ in range(n)]
    return rows + [(None, "en"), ("", None), (" \t\n", "en"), ("Ab " * 30000, "fr"), ("one. " * 40, "xx")] + rows[:50]


@pytest.mark.parametrize("capacity", [collocations.CAPACITY, 300])
def test_against_a_full_count(spark, capacity, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 20_000)
    rows = made()
    docs = spark.createDataFrame([(t, k, 1, "w", 2) for t, k in rows], "text string, lang string, a int, phrase string, words int").repartition(4)
    found = collocations.mine(docs, capacity=capacity)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert Counter(map(tuple, found.collect())) == plain(rows)


def test_sql_says_the_same():
    rows = made(seed=9)
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert Counter(connection.sql(collocations.sql()).fetchall()) == plain(rows)


def test_empty(spark, empty):
    assert collocations.mine(empty).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_cut_texts_are_the_text(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 50)
    text = ("word " * 30 + ". " + "b c, d\n").encode() * 20
    parts = list(collocations._sections(text))
    assert b"".join(parts) == text and len(parts) > 3 and all(p[-1:] in b".,\n" for p in parts[:-1])


@pytest.mark.parametrize("capacity", [1, 5, 50, 5000])
def test_frequent_keys_survive(capacity):
    rng = np.random.default_rng(capacity)
    for _ in range(30):
        summary, truth = MisraGries(capacity, 30), Counter()
        for _ in range(40):
            keys = (rng.zipf(1.3, 300) % 3000).astype(np.uint64)
            truth.update(keys.tolist())
            k, c = counted(keys)
            summary.add(k, np.minimum(c, 30))
        left = set(summary.survivors().tolist())
        assert {k for k, n in truth.items() if n >= 30} <= left and summary.error < 30
        if capacity > sum(truth.values()) / 30:
            assert len(summary.keys) <= capacity
    assert counted(np.zeros(0, np.uint64))[1].sum() == 0
