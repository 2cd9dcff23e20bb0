"""Token files and packing: exact round trips against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reviewlake.llm import packing, token_files, tokens
from reviewlake.llm.tokens import PIECES, PieceTokenizer

ODD = ["a  b", "a \n b\n\n c", " \t x", "x<|endoftext|> y  <|endoftext|>z", "\xa0  b", "don't  's 12 3.5", "", " ", "\n\n", "É é x", "  a  b\x1c c",
       "ΑΣ ΣΑΣ.", "ﬁ ½²", "a\x01b \x01", "w" * 3000]


@pytest.mark.parametrize("name", sorted(PIECES))
def test_pieces_give_the_ids_of_the_whole_text(name):
    rng = random.Random(1)
    chars = list("ab '’st.,!\n\t  12é́\xa0　Σ<|>中文🙂\x1c\x0b\x01")
    texts = ODD + ["".join(rng.choice(chars) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    ours = PieceTokenizer(name)
    for _ in range(2):  # new pieces, then known ones
        for text, ids in zip(texts, ours.encode([t.encode() for t in texts])):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


UPPER = ["THE The the", "DON'T Don't 'S x'S", "H\u0331 h\u0331 J\u030c j\u030c I\u0307 KİT \u212a", "E\u0301.E\u0301 A=\u0338B", "a,B;c 3.5X x9Y", "", "Ó,ó Ñandú. ×a÷ ÿ;Ÿ ßS À\u0301.É"]


def test_words_are_looked_up_once_for_many_texts(monkeypatch):
    texts = ODD + UPPER + ["".join(random.Random(i).choices("aBcHJ '.,9éÉ×\u0331\u030c\u2019\u2003\x1dΣ\n", k=i % 60)) for i in range(3000)]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ours = PieceTokenizer("word_bpe_49k.json")
    for most in (1 << 22, 50):
        monkeypatch.setattr(tokens, "TOGETHER", most)
        for text, ids in zip(texts, ours.encode([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
    monkeypatch.setattr(tokens, "TOGETHER", 1 << 22)
    ours.forget()
    asked = []
    monkeypatch.setattr(PieceTokenizer, "__getitem__", lambda self, piece: asked.append(piece) or self.__missing__(piece), raising=False)
    ours.encode([b"one two, One TWO"] * 100)
    assert sorted(asked) == [b",", b"one", b"two"]


def test_spaced_pieces_are_looked_up_once_for_many_texts(monkeypatch):
    rng = random.Random(8)
    parts = [*"ab Z'’st.,!\n\t\r  129é́×÷ÿÀ٣½ǅªº_`~", "don't", " 'S", "\n\n ", " \n", "  ", "abc123", "3.5%,", " word", "e\u0301", "<|endoftext|>", "\xa0"]
    texts = ODD + UPPER + ["".join(rng.choices(parts, k=i % 25)) for i in range(6000)]
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for special_as_text, most in ((False, 1 << 22), (True, 50)):
        monkeypatch.setattr(tokens, "TOGETHER", most)
        whole.encode_special_tokens = special_as_text
        for text, ids in zip(texts, PieceTokenizer("byte_bpe_50k.json", special_as_text).encode([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
    monkeypatch.setattr(tokens, "TOGETHER", 1 << 22)
    ours, asked = PieceTokenizer("byte_bpe_50k.json"), []
    monkeypatch.setattr(PieceTokenizer, "__getitem__", lambda self, piece: asked.append(piece) or self.__missing__(piece), raising=False)
    ours.encode([b"one two, one TWO2 \n", b"one"] * 100)
    assert sorted(asked) == [b" \n", b" TWO", b" one", b" two", b",", b"2", b"one"]


def test_bytes_that_are_no_utf8_are_replaced():
    rng = random.Random(9)
    texts = [bytes(rng.choices([0xC3, 0xA9, 0xC4, 0xFF, 0x97, 32, 10, 44, 97], k=i % 8)) for i in range(3000)]
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ours = PieceTokenizer("byte_bpe_50k.json")
    for at in range(0, len(texts), 2):
        for data, ids in zip(texts[at:at + 2], ours.encode(texts[at:at + 2]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids, data


def test_new_words_are_merged_in_few_calls_of_the_library(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghilmnorstuéñßíàÖÜÀ", k=rng.randint(1, 14))) for _ in range(2500)]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ours, calls = PieceTokenizer("word_bpe_49k.json"), []
    ours.merge = lambda piece: calls.append(piece) or whole.model.tokenize(piece)
    texts = [" ".join(words[i:i + 50]) for i in range(0, len(words), 50)]
    for text, ids in zip(texts, ours.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
    assert not calls and not ours.merged
    monkeypatch.setattr(tokens, "MOST_PIECES", 7)  # pieces fall out of the table while others are asked for
    ours.forget()
    for text, ids in zip(texts, ours.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("size", [3 * 1024, 3 * 1024 + 500])
def test_both_context_orders_are_looked_up_by_one_call(size, monkeypatch):
    stream = np.random.default_rng(5).integers(0, 300, size).astype("<u4")
    data, models = token_files.write_segment([1], [stream.tobytes()]), []
    use = token_files._Models.use
    monkeypatch.setattr(token_files._Models, "use", lambda self, m: models.append(self) or use(self, m))
    assert (token_files.read_segment(data)[1] == stream).all()
    assert models[0].table.size == 2 * models[0].n * token_files._SLOTS and models[0].place.shape == (2, models[0].m)


def test_an_interval_is_asked_for_once_an_id(monkeypatch):
    stream = np.random.default_rng(3).integers(0, 500, 3 * token_files.BLOCK).astype("<u4")
    data, asked, interval = token_files.write_segment([1], [stream.tobytes()]), [], token_files._Models.interval
    monkeypatch.setattr(token_files._Models, "interval", lambda *a: asked.append(1) or interval(*a))
    assert (token_files.read_segment(data)[1] == stream).all() and len(asked) == token_files.BLOCK


@pytest.mark.parametrize("size", [0, 1, 2, 1023, 1024, 1025, 5000, 200_000])
@pytest.mark.parametrize("most", [1, 40, 65_536])
def test_segment_round_trip(size, most):
    stream = np.random.default_rng(size).integers(0, most, size)
    stream = np.where(np.arange(size) % 3 == 0, stream, np.minimum(stream, 5)).astype("<u4")
    cut = size // 3
    data = token_files.write_segment([None, 7, -5], [stream[:cut].tobytes(), b"", stream[cut:].tobytes()])
    docs, back, lengths = token_files.read_segment(data)
    assert docs == [None, 7, -5] and lengths == [cut, 0, size - cut] and (back == stream).all()


def test_repeats_cost_little_and_damage_is_seen():
    repeated = np.tile(np.random.default_rng(0).integers(0, 3000, 50), 400).astype("<u4").tobytes()
    data = token_files.write_segment([1], [repeated])
    assert len(data) < len(repeated) // 4 // 4
    for at in (3, 20, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            token_files.read_segment(data[:at] + bytes([data[at] ^ 1]) + data[at + 1:])


@pytest.fixture(scope="module")
def coded(rows):
    def of(name, end):
        whole = Tokenizer.from_file(public_tokenizers.path(name))
        return [(r[0], whole.encode(r[1] or "", add_special_tokens=False).ids + [end]) for r in rows]
    return of


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(docs, empty, coded):
    found = token_files.round_trip(docs).collect()
    want = coded("word_bpe_49k.json", 2)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in found) == \
        sorted((d is not None, d or 0, len(x), crc(x)) for d, x in want)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order)
    assert token_files.round_trip(empty).count() == 0


def test_token_files_with_ids(docs, coded, monkeypatch):
    path = token_files.shared_folder(docs.sparkSession, "test")
    token_files.write_token_files(docs, path)
    found = token_files.read_token_files(docs.sparkSession.read.parquet(path), with_ids=True).collect()
    assert sorted(map(str, ((r.doc_id, r.ids) for r in found))) == sorted(map(str, coded("word_bpe_49k.json", 2)))


def test_first_fit_decreasing():
    rng = random.Random(5)
    for _ in range(50):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(0, 40))]
        room, want = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            b = next((b for b, r in enumerate(room) if r >= sizes[i]), None)
            if b is None:
                room.append(30)
                want.append([])
                b = len(room) - 1
            room[b] -= sizes[i]
            want[b].append(i)
        assert packing.first_fit_decreasing(sizes, 30) == want


def test_pack_covers_every_token_once():
    rng = random.Random(6)
    for _ in range(40):
        totals = [rng.choice([1, 7, 63, 64, 65, rng.randint(1, 300)]) for _ in range(rng.randint(0, 30))]
        sequences = packing.pack(totals, 64)
        seen = sorted((d, s, n) for q in sequences for d, s, n in q)
        ends = defaultdict(int)
        for d, s, n in seen:
            assert s == ends[d] and n > 0
            ends[d] += n
        assert [ends[i] for i in range(len(totals))] == totals
        sizes = [sum(p[2] for p in q) for q in sequences]
        assert all(n <= 64 and n & (n - 1) == 0 for n in sizes)


def test_packing(docs, empty, coded):
    found = packing.pack_documents(docs, group=16).collect()
    want = coded("byte_bpe_50k.json", 1)
    by_doc = defaultdict(list)
    for d, ids in want:
        by_doc[d].append(ids)
    for r in found:
        assert len(r.ids) == r.length and crc(r.ids) == r.ids_crc32
        assert any(x[r.start:r.start + r.length] == r.ids and len(x) == r.doc_tokens for x in by_doc[r.doc_id])
    assert sum(r.length for r in found) == sum(len(x) for _, x in want)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    joined = packing.sequences(packing.pack_documents(docs, group=16)).collect()
    assert len(joined) == len(sequences) and all(len(r.ids) == r.length for r in joined)
    assert packing.pack_documents(empty).count() == 0


def test_packing_holds_ids_of_more_than_16_bits(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id bigint, text string")
    rows = packing.pack_documents(docs, end_id=70_000, length=64).collect()
    ends = [r.ids[-1] for r in rows if r.start + r.length == r.doc_tokens]
    assert ends == [70_000] * 2
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    assert packing.id_width("byte_bpe_50k.json", 1) == "<u2"
