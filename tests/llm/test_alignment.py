"""Alignment of two tokenizers against their own whole-text encodings."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from reviewlake.llm import alignment
from reviewlake.llm.tokens import PieceModel, tokenizer

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = ["<s> </s> <unk> <|endoftext|>x", "a▁b", "日本𝒳\x00\x01", " lead", "trail ", "  ", "a  b   ", "a<0x41>b", "\n\n x\ty", "don't  's", "　\xa0é́🙂", "w" * 3000, " " * 300 + "x"]


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(public_tokenizers.path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))


def spelt(models, text):
    """(id, byte end) of both sides by the libraries themselves, or nothing."""
    a, b = models
    full, alphabet = (" " + text).encode(), tokenizer(A).alphabet
    back = {c: x for x, c in alphabet.items()}
    left = [(i, bytes(back[c] if c in back else ord(c) for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if not text or b"".join(x for _, x in left) != full or b"".join(x for _, x in right) != full:
        return [], []
    return [[(i, int(e)) for (i, _), e in zip(side, np.cumsum([len(x) for _, x in side]))] for side in (left, right)]


def by_hand(models, text):
    left, right = spelt(models, text or "")
    both = sorted({e for _, e in left} & {e for _, e in right})
    cut = lambda side, s, e: [i for i, at in side if s < at <= e]
    parts = [(cut(left, s, e), cut(right, s, e)) for s, e in zip([0, *both], both)]
    links = [(i, j) for i, e in left for j, f in right if e == f]
    spelling = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in parts)
    return len(left), len(right), len(parts), links, hashlib.sha256(spelling.encode()).hexdigest() if parts else "", parts


def test_units_give_the_ids_of_the_whole_text(models):
    rng, chars = random.Random(2), list("ab '’st.,!\n\t  12é́\xa0　Σ<|>中文🙂\x1c\x0b\x01\x00s>0x")
    ours = PieceModel(B)
    cases = ODD + ["".join(rng.choice(chars) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    cases = [t for t in cases if "▁" not in t]
    for text, ids in zip(cases, ours.encode([(" " + t).encode() for t in cases])):
        assert np.frombuffer(ids, "<u4").tolist() == models[1].encode(text), text


def test_gallop_finds_what_a_scan_finds():
    rng = np.random.default_rng(4)
    for _ in range(200):
        texts = rng.integers(1, 6)
        sides, firsts, base = ([], []), ([0], [0]), 0
        for _ in range(texts):
            total = int(rng.integers(1, 400))
            for side, first in zip(sides, firsts):
                inner = rng.choice(np.arange(1, total), rng.integers(0, total), replace=False) if total > 1 else []
                side += [base + int(x) for x in sorted({*map(int, inner), total})]
                first.append(len(side))
            base += total
        a, b = np.array(sides[0]), np.array(sides[1])
        in_a, in_b = alignment.common_ends(a, b, np.array(firsts[0]), np.array(firsts[1]))
        both = sorted(set(sides[0]) & set(sides[1]))
        assert a[in_a].tolist() == both and b[in_b].tolist() == both


def test_groups_are_rank_ranges(models):
    aligner = alignment.load(A, B)
    for text in ["Unbelievable tokenization, naïve café 🙂", *ODD]:
        left, right = spelt(models, text)
        ranges = [([i for i, _ in left[s:s + n]], [i for i, _ in right[t:t + m]]) for s, n, t, m in alignment.groups(aligner, text.encode())]
        assert ranges == by_hand(models, text)[5]


@pytest.mark.parametrize("batch_bytes", [alignment.BATCH_BYTES, 3000])
def test_against_the_libraries(spark, docs, rows, models, batch_bytes, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", batch_bytes)
    own = [(r[0], r[1]) for r in rows] + [(10_000 + i, t) for i, t in enumerate(ODD)]
    more = spark.createDataFrame([(i, t, 1, "p") for i, t in own], "doc_id bigint, text string, n_links int, pairs string").repartition(3)
    want = [(doc, by_hand(models, text)) for doc, text in own]
    counts = Counter(p for _, w in want for p in w[3])
    top = defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    expected = Counter((doc, w[0], w[1], w[2], len(w[3]), sum(counts[p] == top[p[1]] for p in w[3]), sum(counts[p] for p in w[3]), w[4]) for doc, w in want)
    found = alignment.align_tokenizers(more)
    assert Counter(map(tuple, found.collect())) == expected
    table = {(r.a, r.b): (r.total, r.best) for r in alignment.pair_table(more).collect()}
    assert table == {p: (n, n == top[p[1]]) for p, n in counts.items()}


def test_empty(spark, empty):
    assert alignment.align_tokenizers(empty).count() == 0
    nothing = alignment.align_tokenizers(spark.createDataFrame([(1, None), (None, ""), (1, "a▁b")], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in nothing) == [(i, *[0] * 6, "") for i in (0, 1, 1)]
