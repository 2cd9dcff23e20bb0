"""Suffix dedup, near dedup and line dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from reviewlake.llm import line_dedup, near_dedup, suffix_dedup

from .conftest import LOWER, make_texts, solid_words


def brute_suffix(rows):
    """Start places of equal ids are the same place, so only strictly smaller (id, start) is earlier."""
    ordered = sorted(rows, key=lambda r: -2**63 if r[0] is None else r[0])
    first = {}
    for doc, text in ordered:
        data = (text or "").encode()
        for i in range(len(data) - 99):
            place = (-2**63 if doc is None else doc, i)
            w = data[i:i + 100]
            first[w] = min(first.get(w, place), place)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if first[data[i:i + 100]] < (-2**63 if doc is None else doc, i):
                gone[i:i + 100] = b"\1" * 100
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 2, 4, 8])
def test_suffix_dedup(docs, rows, empty, batches):
    found = suffix_dedup.digest(suffix_dedup.removed_spans(docs, batches=batches)).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert got == brute_suffix([r[:2] for r in rows])
    if batches == 2:
        assert suffix_dedup.removed_spans(empty).count() == 0


def test_suffix_dedup_of_cut_passages(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("ab ") for _ in range(1500))
    texts = []
    for _ in range(40):
        a, b = rng.randint(0, 1300), rng.randint(60, 200)
        texts.append("".join(rng.choice("abc") for _ in range(rng.randint(0, 50))) + base[a:a + b] + "".join(rng.choice("abc") for _ in range(30)) * rng.randint(1, 4))
    data = list(enumerate(texts))
    rng.shuffle(data)
    found = suffix_dedup.digest(suffix_dedup.removed_spans(spark.createDataFrame(data, "doc_id bigint, text string").repartition(4))).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == brute_suffix(data)


def removed(found):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(found).collect())


def test_suffix_dedup_over_many_blocks(spark, monkeypatch):
    """One passage between other words in every text: its edges are one anchor each, in more windows than a block holds."""
    monkeypatch.setattr(suffix_dedup, "_WINDOWS", 300)
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(40))
    data = []
    for i in range(120):
        begin, end = rng.randint(0, 60), rng.randint(0, 60)
        data.append((i, " ".join(word() for _ in range(12)) + passage[begin:len(passage) - end] + " ".join(word() for _ in range(12))))
    frame = spark.createDataFrame(data, "doc_id bigint, text string").repartition(6)
    assert removed(suffix_dedup.removed_spans(frame)) == brute_suffix(data)


def test_suffix_dedup_tells_texts_under_one_id_apart(spark):
    """Two texts of equal checksum under one id, and thousands of rows without an id."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    other = passage + " and a tail"
    wanted, unlike = suffix_dedup.text_tag(other.encode()), None
    body = "".join(rng.choice("ijklmnop ") for _ in range(390))
    for k in range(1 << 26):
        if suffix_dedup.text_tag(f"{body}{k}".encode()) == wanted:
            unlike = f"{body}{k}"
            break
    data = [(1, passage), (2, other), (2, unlike)]
    found = removed(suffix_dedup.removed_spans(spark.createDataFrame(data, "doc_id bigint, text string")))
    assert found == brute_suffix(data) and found[(2, len(unlike), 0, 0, hashlib.sha256(unlike.encode()).hexdigest())] == 1
    nameless = [(None, passage[:150] + f" row {i} " + "".join(rng.choice("qrstuv ") for _ in range(120))) for i in range(3000)]
    nameless += [(5, nameless[7][1]), (6, passage), *[(None, passage)] * 40]
    got = removed(suffix_dedup.removed_spans(spark.createDataFrame(nameless, "doc_id bigint, text string").repartition(8)))
    assert got == brute_suffix(nameless)


def test_suffix_batches_grow_with_the_text(spark, monkeypatch):
    frame = spark.createDataFrame([(i, "x" * 1000) for i in range(64)], "doc bigint, text string")
    assert suffix_dedup._sizes(frame, None)[1] == 4 and suffix_dedup._sizes(frame, 8)[1] == 8
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 1000)
    parts, batches = suffix_dedup._sizes(frame, None)
    assert parts == 64 and batches == 32  # whatever the session's number of partitions


def test_suffix_dedup_keeps_spans_that_agree_in_32_bits_only(spark):
    """Different spans around one anchor gram whose span hashes have the same upper half."""
    halves = [("15f5875cb631429da0a6b31c79856f94587d63d42aebf0bb40ad5e75028b", "b564729f0b11a097e1b2e6f12369d22e1c7a8eb83cb88ac68094f6d5a563"),
              ("ab4cfaef996c24273ecc82bd9b871d20df3768e071d525a831de987bc9b1", "9d67fd174df1adfb30b7fbbca1c162c8afe31d9413f66105c26863f3c48a"),
              ("a04e6ca7f62f413452c4280c757a3211a78f4c25547c34ecd23b3ddd2174", "e2a3ce2be2dc9c0626a20e3b0d438e97790aa3c2259a9b8c11a94298c4ea"),
              ("59f4cba2b4f3afb616de1db7a05732039a785a7500e3574ba96eaf6e982c", "0dd05d0dab1bced13182c696cd2989f9994893c8330185c37a38c7c976db")]
    data = [(i, f"{a}passage 16637 shared by all{b}") for i, (a, b) in enumerate(halves)]
    found = suffix_dedup.digest(suffix_dedup.removed_spans(spark.createDataFrame(data, "doc_id bigint, text string"))).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == brute_suffix(data)
    assert all(r.n_removed == 0 for r in found)


def test_suffix_scan_asks_both_fingerprints(spark):
    place = 1 << suffix_dedup._TAG
    rows = [(0, 0, 5, 9, doc, 11, place, second) for doc, second in ((1, 7), (2, 8), (3, 7))]
    found = suffix_dedup._merge_scan(spark.createDataFrame(rows, suffix_dedup._ROWS), 2, False).collect()
    assert sorted((r.doc, r.b) for r in found if r.kind == 0) == [(1, 7), (2, 8)]
    assert [r.doc for r in found if r.kind == 1] == [3]


def shingle_set(text, size):
    words = solid_words((text or "").translate(LOWER))
    return frozenset(tuple(words[i:i + min(size, len(words))]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute_near(rows, size):
    sets = {}
    for doc, text in rows:
        if doc is not None:
            sets.setdefault(shingle_set(text, size), []).append(doc)
    names = [s for s in sets if s]
    parent = {s: s for s in names}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for i, a in enumerate(names):
        for b in names[:i]:
            shared = len(a & b)
            if 100 * shared >= 80 * (len(a) + len(b) - shared):
                parent[root(a)] = root(b)
    least = {}
    for s in names:
        least[root(s)] = min([least.get(root(s), 2**62), *sets[s]])
    out = []
    for doc, text in rows:
        s = shingle_set(text, size)
        component = None if doc is None else least[root(s)] if s else doc
        out.append((doc, len(s), component, doc is None or doc == component))
    return Counter(out)


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup(docs, rows, size):
    found = near_dedup.near_duplicates(docs, size=size).collect()
    want = brute_near([r[:2] for r in rows], size)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == want
    assert any(not k[3] for k in want)


def test_chains_of_copies(spark):
    """A slowly changing text: neighbours are linked, the ends are not, so stars alone would part the chain."""
    rng = random.Random(4)
    words, data = [f"w{i}" for i in range(60)], []
    for i in range(70):
        data.append((i * 3 + 1, " ".join(words)))
        words[rng.randrange(60)] = f"n{i}"
    rng.shuffle(data)
    found = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == brute_near(data, 2)


def test_keep_one_of_each(docs, rows, empty):
    kept = near_dedup.keep_one_of_each(docs)
    want = {k[0] for k in brute_near([r[:2] for r in rows], 5) if k[3] and k[0] is not None}
    got = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns
    assert {k for k in got if k is not None} == want and all(n == 1 for k, n in got.items() if k is not None) and got[None] == 2
    assert near_dedup.keep_one_of_each(empty).count() == 0


def test_repeated_ids_follow_their_own_sets(spark):
    """An id that comes with a near copy, an unrelated text and no text at all."""
    rng = random.Random(2)
    one, other, third = ([f"{p}{rng.randrange(10**6)}" for _ in range(200)] for p in "xyz")
    near = [*one[:-1], "end"]
    data = [(3, " ".join(one)), (7, " ".join(near)), (7, " ".join(other)), (7, " ".join(other)), (3, " ".join(third)), (9, " ".join(third)), (7, None)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    found = near_dedup.near_duplicates(docs, size=5).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == brute_near(data, 5)
    kept = near_dedup.keep_one_of_each(docs).collect()
    assert Counter(map(tuple, kept)) == Counter([(3, " ".join(one)), (3, " ".join(third)), (7, " ".join(other)), (7, None)])


def test_densified_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (3, 12, 150, 900):
        equal = []
        for _ in range(60):
            pool = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64) * np.uint64(2))
            a, b = np.sort(pool[:n]), np.sort(pool[n // 5:n // 5 + n])
            equal.append((near_dedup.signature(a) == near_dedup.signature(b)).mean())
        shared = n - n // 5
        assert abs(np.mean(equal) - shared / (2 * n - shared)) < 0.08


def brute_lines(rows, ratio, least):
    pages, on = Counter(s for s, _ in rows), defaultdict(Counter)
    for site, lines in rows:
        on[site].update({x for x in lines if x.strip()})
    return [[x for x in lines if not x.strip() or not (on[site][x] >= least and on[site][x] > ratio * pages[site])] for site, lines in rows]


def test_line_dedup_of_documents(spark):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        lines = [rng.choice(["menu", "foot", " menu", "", "rare %d" % rng.randint(0, 60)]) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(lines) if i % 17 else None, rng.choice(["a", "b", None, "", "null"]), "x", i))
    rows += [rows[3]] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, site string, row int")
    got = line_dedup.dedup_documents(docs)
    assert got.schema == docs.schema
    kept = brute_lines([(r[2], r[1].split("\n") if r[1] is not None else []) for r in rows], line_dedup.RATIO, line_dedup.MIN_PAGES)
    want = Counter((r[0], None if r[1] is None else "\n".join(k), r[2], r[3], r[4]) for r, k in zip(rows, kept))
    assert Counter(map(tuple, got.collect())) == want and sum(want.values()) == len(rows)
    assert line_dedup.dedup_documents(docs.limit(0)).count() == 0


def test_both_hashes_of_a_line_read_the_line(spark):
    def signed(x):
        return x - 2**64 if x >= 2**63 else x

    (row,) = spark.createDataFrame([("menu",)], "line string").select(line_dedup._key(F.col("line")).alias("k")).collect()
    one = (1).to_bytes(4, "little")
    assert row.k.a == signed(xxhash.xxh64_intdigest(b"menu", 42))
    assert row.k.b == signed(xxhash.xxh64_intdigest(b"menu", xxhash.xxh64_intdigest(one, 42)))
    assert row.k.b != signed(xxhash.xxh64_intdigest(one, xxhash.xxh64_intdigest(b"menu", 42)))  # a function of the first


def test_line_dedup_keeps_columns(docs, rows, empty):
    assert line_dedup.dedup_documents(docs).schema == docs.schema and line_dedup.dedup_documents(docs).count() == len(rows)


def test_line_dedup_of_pages(spark):
    page = "<html><script>x='</p>'</script><style>p{}</style><body><!-- c --><nav><li>Menu</li></nav><p>Own %d</p>Foot<br/>er<b>!</b></body>"
    rows = [(i, f"https://u@Host.example:80/p{i}", page % i, "k") for i in range(9)] + [(None, None, None, None), (3, "x", "", "y")]
    found = line_dedup.dedup_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, host string"), min_pages=5)
    got = {r.page_id: r for r in found.collect()}
    assert len(got) == 10 and got[4].host == "host.example" and (got[4].n_lines, got[4].n_dropped, got[4].text) == (4, 3, "Own 4")
    assert (got[None].host, got[None].n_lines, got[None].text) == ("", 0, "")
    python = [n for n in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Python" in n or "Arrow" in n]
    assert not python


def test_lines_of_hot_site_are_combined_before_the_shuffle(spark):
    docs = spark.createDataFrame([(i, "\n".join(make_texts(n=2)), "hot") for i in range(20)], "doc_id bigint, text string, source string")
    pages = docs.select(F.col("source").alias("site"), F.split("text", "\n").alias("lines"))
    plan = line_dedup.boilerplate(pages)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "CartesianProduct" not in plan
    done = line_dedup.dedup_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in done and "Exchange hashpartitioning" not in done  # the pages are not moved


def test_pages_of_any_size(spark):
    assert line_dedup.dedup_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    same = "<p>home</p><p>imprint</p>"
    rows = [(i, "http://a.example/x", f"{same}<p>{'word ' * 40_000 if i == 3 else i}</p>", "clash", 1) for i in range(8)]
    rows += [(20, None, same, None, 2), (21, "http://a.example", None, None, 3), (22, "http://a.example", "", None, 4), (None, "nothing", "<p>x", None, 5)]
    found = {r.page_id: r for r in line_dedup.dedup_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, site string, kept int")).collect()}
    assert all((found[i].n_lines, found[i].n_dropped) == (3, 2) for i in range(8)) and len(found[3].text) == 5 * 40_000 - 1
    assert [(found[i].n_lines, found[i].n_dropped, found[i].text) for i in (20, 21, 22, None)] == [(2, 0, "home\nimprint"), (0, 0, ""), (0, 0, ""), (1, 0, "x")]
