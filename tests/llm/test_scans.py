"""License scan, decontamination and quality rules against plain re-tellings of their rules."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from reviewlake.llm import decontaminate, licenses, quality_rules, queries

from .conftest import plain_words, solid_words


def key(row):
    return (row["doc_id"] is None, row["doc_id"] or 0)


def base_license(text):
    words, places, labels = plain_words(text), [], set()
    for phrase, label in (("mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_counts(docs, rows):
    found = licenses.scan_licenses(docs).collect()
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found)
    assert got == Counter((r[0], *base_license(r[1])) for r in rows)
    for r in found:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def longest_match(words, templates, at):
    return max((k for t in templates for s in range(len(t)) for k in range(1, len(t) - s + 1) if words[max(0, at - k + 1):at + 1] == t[s:s + k]), default=0)


def test_automaton_gives_matching_statistics():
    rng = np.random.default_rng(2)
    for _ in range(60):
        templates = [rng.integers(0, 4, rng.integers(1, 9)).tolist() for _ in range(3)]
        automaton = licenses.SuffixAutomaton(templates)
        words = rng.integers(0, 5, 25).tolist()
        stats = [longest_match(words, templates, i) for i in range(len(words))]
        want = [(i, n) for i, n in enumerate(stats) if n >= 2 and (i + 1 == len(words) or stats[i + 1] != n + 1)]
        found = automaton.matches(words, 2)
        assert [(a, n) for a, n, _ in found] == want
        for at, n, state in found:
            ends = {(k, e) for k, t in enumerate(templates) for e in range(n - 1, len(t)) if t[e - n + 1:e + 1] == words[at - n + 1:at + 1]}
            assert automaton.ends[state] == ends


def test_template_spans():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.BASE_PHRASES, 4, 0.75)
    text = "before it. " + licenses.TEMPLATES["bsd"].replace("and use in source", "and, say, use in source") + " after."
    (span,) = [s for s in scanner.scan(text.encode())["spans"] if s["label"] == "bsd"]
    assert span["first_word"] >= 2 and span["coverage"] > 0.75
    assert scanner.scan(b"permission is hereby")["spans"] == []


def covered(words, template, least):
    """Greatest share of a template in pieces of at least ``least`` words that stand in the text, in order (without overlap), by trying all."""
    best = [[0] * (len(template) + 1) for _ in range(len(words) + 1)]
    for i in range(1, len(words) + 1):
        for j in range(1, len(template) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1])
            n = 0
            while n < min(i, j) and words[i - n - 1] == template[j - n - 1]:
                n += 1
                if n >= least:
                    best[i][j] = max(best[i][j], best[i - n][j - n] + n)
    return best[-1][-1] / len(template)


def test_labels_of_whole_licenses_and_broken_ones():
    rng = np.random.default_rng(3)
    templates = licenses.every_template()
    scanner = licenses.Scanner(templates, licenses.BASE_PHRASES, 4, 0.75)
    assert len(scanner.automaton.length) > 1500
    own = [(label, plain_words(text)) for label, text in templates]
    for label, text in [t for t in templates if len(t[1]) < 800]:
        words = plain_words(text)
        for damage in (0, 0.03, 0.3):
            hurt = [w if rng.random() >= damage else "zzz" for w in words]
            around = ["one", "two"] * 5
            found = scanner.scan(" ".join(around + hurt + around).encode())
            # A piece that goes on longer in one template is a match of that one only, so a label may be missed beside a better one; none is made up.
            got = set(filter(None, found["labels"].split(",")))
            assert label in got or damage
            shares = {name: max(covered(hurt, words, 4) for n, words in own if n == name) for name in got - set(found["base_labels"].split(","))} if damage < 0.1 else {}
            assert all(share >= 0.75 for share in shares.values()), (label, damage, shares)
            for span in found["spans"]:
                assert 10 <= span["first_word"] <= span["last_word"] < 10 + len(words) and 0.75 <= span["coverage"] <= 1


@pytest.mark.parametrize("text, label", [
    ("you may not use this file except in compliance with the License", "apache-2"), ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "agpl"),
    ("This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by "
     "the additional permissions listed below.", "lgpl"),
    ("THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE. ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES "
     "RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.", "epl")])
def test_wording_that_is_often_met(text, label):
    found = licenses.Scanner(licenses.every_template(), licenses.BASE_PHRASES, 4, 0.75).scan(text.encode())
    assert label in found["labels"].split(",") and found["score"] >= 0.75 and found["spans"][0]["first_word"] == 0
    assert licenses.Scanner(licenses.every_template(), licenses.BASE_PHRASES, 4, 0.75).scan(b"use of the file and the software as is")["labels"] == ""


def test_license_query_counts_the_phrases_of_the_contract(spark, tmp_path):
    texts = ["Released under the MIT License.", "The MIT License", "Under, the MIT-license; under the mit license", "apache license version 2 under the", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in queries.op1_license_scan(spark, str(tmp_path)).collect()}
    got = [(found[i].n_words, found[i].n_base, found[i].first_word, found[i].last_word, found[i].base_labels, found[i].labels) for i in range(len(texts))]
    assert got == [(5, 1, 1, 1, "mit", "mit"), (3, 0, None, None, "", "mit"), (8, 2, 0, 4, "mit", "mit"), (6, 1, 0, 0, "apache-2", "apache-2"), (0, 0, None, None, "", "")]


def test_license_empty(empty):
    assert licenses.scan_licenses(empty).count() == 0


def leaks(text, items):
    words, hit, found = plain_words(text), set(), set()
    for item, item_text in items:
        own = plain_words(item_text)
        windows = [own[i:i + 10] for i in range(len(own) - 9)] if len(own) >= 10 else [own] if own else []
        for w in windows:
            for i in range(len(words) - len(w) + 1):
                if words[i:i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    found |= {item} - {None}
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 20])
def test_decontamination(docs, rows, items, block_words):
    found = decontaminate.find_contamination(docs, items, block_words=block_words).collect()
    own = [(r.item_id, r.text) for r in items.collect()]
    got = Counter((r.doc_id, r.n_words, r.n_hit, len(r.item_ids), decontaminate.items_digest(r.item_ids), r.contaminated) for r in found)
    want = Counter((r[0], *leaks(r[1], own)) for r in rows)
    assert got == want and any(k[5] for k in want)
    kept = decontaminate.drop_contaminated(docs, items, block_words=block_words)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if not leaks(r[1], own)[4])


def test_decontamination_empty(docs, empty, items):
    none = items.limit(0)
    assert decontaminate.find_contamination(empty, items).count() == 0
    assert decontaminate.find_contamination(docs, none).filter("contaminated").count() == 0
    assert decontaminate.drop_contaminated(docs, none).count() == docs.count()


def rule_counts(text):
    text = text or ""
    words = solid_words(text)
    lines = [x for x in text.split("\n") if solid_words(x)]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    counts = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    return *counts, counts[0] < 10 or 100 * counts[4] > 20 * counts[0]


@pytest.fixture(scope="module")
def labels(spark, rows):
    data = [(r[0], int("%" not in (r[1] or "") and (r[0] or 0) % 11 != 0), 0, "clash") for r in rows] + [(None, 1, 0, None), (5, None, None, None)]
    return spark.createDataFrame(data, "doc_id bigint, quality int, toxic int, text string")


def test_quality_counts(docs, rows, labels, empty):
    trees = quality_rules.train(docs, labels)
    found = quality_rules.judge(docs, trees).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert got == Counter((r[0], *rule_counts(r[1])) for r in rows)
    assert all(not r.kept for r in found if r.base_failed)
    kept = quality_rules.keep_good(docs, trees)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in found if r.kept)
    assert quality_rules.judge(empty, trees).count() == 0
    untaught = quality_rules.train(empty, labels.limit(0))
    assert all(r.kept != r.base_failed for r in quality_rules.judge(docs, untaught).collect())


def test_trees_are_monotone_and_flat_scoring_agrees():
    rng = np.random.default_rng(4)
    x = rng.random((1500, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.3 * rng.random(1500) < 0.7).astype(float)
    trees = quality_rules.fit_trees(x, y, np.array([-1, 0, 0], np.int8))
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.9
    for _ in range(200):
        point = np.repeat(rng.random((1, 3)), 30, axis=0)
        point[:, 0] = np.sort(rng.random(30))
        assert (np.diff(trees.margin(point)) <= 1e-9).all()
    for row, margin in zip(x[:40], trees.margin(x[:40])):  # node by node
        total = trees.start
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        assert abs(total - margin) < 1e-9


def test_spans_of_many_broken_copies_do_not_overlap():
    pieces = [p for k in range(100) for p in ((k * 100, 0, 16), (k * 100 + 18, 16, 4))]
    found = licenses.chain_spans(pieces, 20, 0.75)
    assert found == [(k * 100, k * 100 + 21, 1.0) for k in range(100)]


def test_a_stray_opening_piece_does_not_hide_a_chain():
    assert licenses.chain_spans([(0, 0, 5), (25, 5, 8), (42, 13, 7)], 20, 0.75) == [(25, 48, 0.75)]


def test_index_of_many_items_is_small():
    """A block at its limit: every word distinct, the most an index can hold, and what it finds."""
    import pickle
    import tracemalloc

    n = decontaminate.BLOCK_WORDS
    items = [(i, " ".join(f"w{k}" for k in range(i * 1000, i * 1000 + 1000))) for i in range(n // 1000)]
    tracemalloc.start()
    windows = decontaminate.Windows(items, decontaminate.WINDOW, decontaminate.SHINGLE)
    windows.order({})
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(windows) == (n // 1000) * 991
    assert held < 300 << 20 and len(pickle.dumps(windows, 5)) < 200 << 20
    text = " ".join(f"w{k}" for k in range(5995, 6020)).encode()
    assert sorted(start for start, _ in windows.find(windows.word_ids(text))) == list(range(5, 16))


def test_two_blocks_of_items(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"v{k}" for k in rng.integers(0, 50_000, 1000)) for _ in range(2000)]  # two million words
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, " ".join(texts[i * 97].split()[i:i + 30])) for i in range(20)] + [(99, " ".join(texts[5].split()[:9]))], "doc_id bigint, text string")
    found = {r.doc_id: (r.n_hit, r.item_ids) for r in decontaminate.find_contamination(docs, items).collect()}
    assert found == {**{i: (30, [i * 97]) for i in range(20)}, 99: (0, [])}
