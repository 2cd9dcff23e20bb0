"""Token ids of whole texts by a tokenizer file, through a table of the pieces already seen.

Both tokenizers here cut a text before they merge, and never merge over a cut. So a text's ids are the
joined ids of its pieces, and a piece is encoded by the tokenizers library once per worker and looked up
after that. A run of common letters or of ASCII marks is one cut piece and goes straight to the
library's merge model; whatever else stands between white space is encoded as a text of its own. Texts
in which a cut could depend on more than the piece (other white space, marks that may begin a special
token) are encoded whole.
"""

from __future__ import annotations

import os
import re
import struct
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = r"!-&(-/:-@\[-`{-~"  # ASCII marks but the apostrophe, which may begin a contraction
_BLANK = r" \t\n\r\x0b\x0c"
_WHOLE = re.compile(r"<\||[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
PIECES = {"word_bpe_49k.json": "_cut_words", "byte_bpe_50k.json": "_cut_spaced"}  # who cuts the texts of a tokenizer
_LATIN = re.compile(f"[{_LETTER}]+")
_ONE_CUT = re.compile(rf" ?[{_LETTER}]+|[ ]?[{_MARK}]+")
MOST_PIECES = 300_000  # pieces in each of a table's two generations; 16 MB of text have about as many: some 85 MB
_PACKED = [struct.Struct(f"<{n}I").pack for n in range(16)]
TOGETHER = 1 << 23  # bytes of texts whose pieces are looked up together, unless a single text has more
_LONGEST = 256  # longer pieces are encoded each time


# Class of a byte: blank 0, ASCII letter 1, ASCII mark but the apostrophe 2, others 4 and, beyond ASCII, 20. Between a letter and a mark is always a cut.
_BEGIN, _BEYOND = 8, 16  # a piece begins here; beyond ASCII
_CLASS = bytearray([4] * 128 + [4 | _BEYOND] * 128)
for _kind, _bytes in ((0, _BLANK), (1, "A-Za-z"), (2, _MARK)):
    for _b in range(128):
        if re.match(f"[{_bytes}]", chr(_b)):
            _CLASS[_b] = _kind
_BLANKS = bytes(b for b in range(256) if _CLASS[b] == 0)


# The same for pieces that hold their blanks; a cut is always between two of letters, marks and digits.
_SPACE, _LINE, _ALPHA, _SIGN, _DIGIT, _OTHER = range(6)
_KIND = bytes(_SPACE if b == 32 else _LINE if c == 0 else _ALPHA if c == 1 else _SIGN if c == 2 else _DIGIT if 48 <= b <= 57 else _OTHER
              for b, c in enumerate(_CLASS))


def _begins(a: int, b: int) -> int:
    """Whether a piece begins at the second (1) or first (2) of two neighbours: the last blank of several goes to what follows or stands alone."""
    if b <= _LINE:
        return int(a > _LINE)
    if a <= _LINE:
        return 2 if a == _SPACE else 3
    return int(a != b and _OTHER not in (a, b))


_NEIGHBOURS = bytes(_begins(i >> 3, i & 7) for i in range(256))  # by 8 * kind + kind


# What every match of _WHOLE has in it, by its first byte: a search for one byte is far cheaper than for several.
_ODD = ((b"<", b"<|"), *((c, c) for c in (b"\x1c", b"\x1d", b"\x1e", b"\x1f")),
        *((c[:1], c) for c in map(str.encode, "\x85\xa0\u1680\u205f\u3000")))
_ODD_SPACES = re.compile(rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]")  # U+2000 to U+200A, U+2028, U+2029, U+202F


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LATIN_BYTES = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")  # _LATIN in UTF-8
_ONE_KIND = re.compile(rb"%s|[%s]+|[0-9]+" % (_LATIN_BYTES.pattern, _MARK.encode()))  # what the byte-level tokenizer never cuts
_MERGED_AT_ONCE = 1000  # new pieces that go to the library in one call


def _is_odd(data: bytes) -> bool:
    """Whether there may be anything that :data:`_WHOLE` finds; a plain search for bytes is far cheaper."""
    return any(first in data and mark in data for first, mark in _ODD) or (b"\xe2" in data and _ODD_SPACES.search(data) is not None)


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def _latin_letters(data: np.ndarray) -> np.ndarray:
    """Places of the bytes of À to ÿ but the signs of times and division, which are no letters."""
    first = np.flatnonzero(data[:-1] == 0xC3)
    first = first[(data[first + 1] != 0x97) & (data[first + 1] != 0xB7) & (data[first + 1] >= 0x80)]
    return np.concatenate((first, first + 1))


def _pack(ids: list[int]) -> bytes:
    return _PACKED[len(ids)](*ids) if len(ids) < 16 else struct.pack(f"<{len(ids)}I", *ids)


def _byte_characters() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 characters stand for their own byte, the others for 256 and on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


class Pieces(dict):
    """piece -> ids as little-endian unsigned 32-bit integers, in two generations.

    When the young one is full it becomes the old one, and what is asked for again comes back from there.
    So the table stays small and what is frequent stays in it.
    """

    def __init__(self) -> None:
        super().__init__()
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.code(piece)
        if len(piece) <= _LONGEST:
            if len(self) >= MOST_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def code(self, piece: str) -> bytes:
        raise NotImplementedError

    def forget(self) -> None:
        self.clear()
        self.old = {}


class PieceTokenizer(Pieces):
    """A tokenizer by its cut pieces; ``encode`` gives the ids of whole texts."""

    def __init__(self, name: str, special_as_text: bool = False):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = special_as_text
        self.merge, self.cut = self.tokenizer.model.tokenize, getattr(self, PIECES[name])
        self.lower, self.alphabet = name.startswith("word"), _byte_characters()
        self.table = str.maketrans(self.alphabet)
        self.merged: dict[bytes, bytes] = {}  # new pieces, until they are asked for
        if self.lower:  # the same merges for spelt pieces between blanks; every piece ends with a token that has the suffix
            self.spelt = Tokenizer(self.tokenizer.model)
            self.spelt.pre_tokenizer = CharDelimiterSplit(" ")
            suffix = self.tokenizer.model.end_of_word_suffix
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merge_together(self, pieces: list[bytes]) -> None:
        """Merge new pieces of letters, many in a call of the library; :meth:`code` finds them and takes on all others."""
        self.merged = {}
        pieces = [p for p in pieces if len(p) <= _LONGEST and (p.isalpha() or _LATIN_BYTES.fullmatch(p))]
        for at in range(0, len(pieces), _MERGED_AT_ONCE):
            some = pieces[at:at + _MERGED_AT_ONCE]
            ids = np.array(self.spelt.encode_batch_fast([self._spell_latin(b" ".join(some))], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                coded = ids.tobytes()
                self.merged.update(zip(some, [coded[a:b] for a, b in pairwise([0, *(ends * 4).tolist()])]))

    def _spell_latin(self, letters: bytes) -> str:
        """Lower-cased bytes of Latin letters and blanks in the byte-level alphabet."""
        spelt = letters.decode().lower().encode().decode("latin-1")
        for hidden in "\x9f\xa0\xad":  # second bytes of ß, à and í; the others stand for themselves
            spelt = spelt.replace(hidden, self.alphabet[ord(hidden)])
        return spelt

    def code(self, piece: bytes) -> bytes:
        if not self.lower:
            return self._code_spaced(piece)
        if (ids := self.merged.get(piece)) is not None:
            return ids
        if piece.isalpha() and len(piece) <= _LONGEST:  # ASCII letters, the most by far; lower-cased already
            return _pack([t.id for t in self.merge(piece.decode())])
        text = piece.decode("utf-8", "replace")
        if _LATIN.fullmatch(text) and len(text) <= _LONGEST:
            return _pack([t.id for t in self.merge(self._spell_latin(text.encode()))])
        if not _ONE_CUT.fullmatch(text) or len(text) > _LONGEST:
            return self.whole(text)
        return _pack([t.id for t in self.merge(text)])  # ASCII marks

    def _code_spaced(self, piece: bytes) -> bytes:
        word = piece.removeprefix(b" ")
        if len(piece) > _LONGEST or not (word.isalpha() or _ONE_KIND.fullmatch(word)):
            return self.whole(piece.decode())
        spelt = word.decode() if word.isascii() else word.decode("latin-1").translate(self.table)
        return _pack([t.id for t in self.merge(spelt if len(word) == len(piece) else self.alphabet[32] + spelt)])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        ends = np.cumsum([len(x) for x in texts], dtype=np.int64) // TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)] if texts else []
        return [ids for a, b in pairwise(cuts) for ids in self._encode_together(texts[a:b])]

    def _cut_words(self, texts: list[bytes]) -> tuple[np.ndarray, bytes | np.ndarray, np.ndarray]:
        """Where pieces between blanks begin in the texts without their blanks, these bytes, and the number of pieces up to the end of each text."""
        joined = b" ".join([*texts, b""])  # a blank after each text
        data, kind = np.frombuffer(joined, np.uint8), np.frombuffer(bytearray(joined.translate(_CLASS)), np.uint8)
        kind[_latin_letters(data)] = 1
        begins = np.empty(len(kind), bool)
        begins[:1] = True
        np.logical_or(kind[:-1] == 0, (kind[:-1] | kind[1:]) == 3, out=begins[1:])
        begins &= kind != 0
        ends = np.cumsum([len(x) + 1 for x in texts])
        kind += begins.view(np.uint8) * np.uint8(_BEGIN)
        filled = np.frombuffer(kind.tobytes().translate(None, b"\0"), np.uint8)  # without the blanks
        held = joined.translate(_LOWER, _BLANKS)
        first = np.flatnonzero(filled & _BEGIN != 0)
        beyond = np.flatnonzero(filled >= _BEYOND)
        if len(beyond):  # pieces with characters beyond Latin-1 letters are composed before they are lower-cased
            kept = np.zeros(len(first), bool)
            kept[np.searchsorted(first, beyond, "right") - 1] = True
            plain = np.frombuffer(joined.translate(None, _BLANKS), np.uint8)
            held = np.where(np.repeat(kept, np.diff(first, append=len(held))), plain, np.frombuffer(held, np.uint8))
        return first, held, np.searchsorted(np.flatnonzero(begins), ends)

    def _cut_spaced(self, texts: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
        """The same for pieces that hold the space before them, and runs of blanks."""
        joined = b"".join(texts)
        kind = np.frombuffer(bytearray(joined.translate(_KIND)), np.uint8)
        kind[_latin_letters(np.frombuffer(joined, np.uint8))] = _ALPHA
        pairs = kind[:-1] << np.uint8(3)
        pairs |= kind[1:]
        said = np.frombuffer(pairs.tobytes().translate(_NEIGHBOURS), np.uint8)
        begins = np.zeros(len(kind), np.uint8)
        begins[1:] = said & 1
        sizes = np.array([len(x) for x in texts], np.int64)
        ends = np.cumsum(sizes)
        last = ends[sizes > 0] - 1
        alone = begins[last]  # nothing follows the end of a text
        begins[:-1] |= said >> 1
        begins[last] = alone
        begins[(ends - sizes)[sizes > 0]] = 1
        first = np.flatnonzero(begins)
        return first, joined, np.searchsorted(first, ends)

    def _encode_together(self, texts: list[bytes]) -> list[bytes]:
        joined = b" ".join(texts)
        odd = {i: text for i, data in enumerate(texts if _is_odd(joined) else ()) if _is_odd(data) and _WHOLE.search(text := data.decode("utf-8", "replace"))}
        texts = [b"" if i in odd else data for i, data in enumerate(texts)]
        if not (self.lower or _is_utf8(joined)):
            texts = [data.decode("utf-8", "replace").encode() for data in texts]
        first, held, counted = self.cut(texts)
        offsets = np.append(first, len(held)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(held)]).dictionary_encode()
        spelt, offsets = pieces.dictionary.buffers()[2].to_pybytes(), np.frombuffer(pieces.dictionary.buffers()[1], np.int32).tolist()
        coded = self._look_up([spelt[a:b] for a, b in pairwise(offsets[:len(pieces.dictionary) + 1])])
        ids, which = np.frombuffer(b"".join(coded), "<u4"), pieces.indices.to_numpy()
        sizes = np.fromiter(map(len, coded), np.int32, len(coded)) >> 2
        before = np.cumsum(sizes, dtype=np.int32) - sizes  # of each different piece, in ``ids``; texts together have less than 2^31 bytes, so ids
        sizes = sizes[which]
        until = np.zeros(len(which) + 1, np.int32)
        np.cumsum(sizes, out=until[1:])
        place = np.repeat(before[which] - until[:-1], sizes)
        place += np.arange(len(place), dtype=np.int32)
        stream = ids[place].tobytes()
        cut = [0, *(until[counted].astype(np.int64) * 4).tolist()]
        return [self.whole(odd[i]) if i in odd else stream[cut[i]:cut[i + 1]] for i in range(len(texts))]

    def _look_up(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of different pieces; those not in the table are merged together."""
        coded, ask = list(map(self.get, pieces)), self.__getitem__
        new = [i for i, ids in enumerate(coded) if ids is None]
        if self.lower:
            self.merge_together([pieces[i] for i in new if pieces[i] not in self.old])
        for i in new:
            coded[i] = ask(pieces[i])
        self.merged = {}
        return coded

    def token_bytes(self) -> list[bytes]:
        """The bytes each id stands for (byte-level vocabularies)."""
        back = {c: b for b, c in self.alphabet.items()}
        words = sorted((i, t) for t, i in self.tokenizer.get_vocab().items())
        out = [b""] * (words[-1][0] + 1)
        for i, token in words:
            out[i] = bytes(back.get(c, ord(c)) if ord(c) < 256 or c in back else 63 for c in token)
        return out


_UNIT = re.compile(r" +[^ ]*")


class PieceModel(Pieces):
    """A sentencepiece model, unit by unit.

    No entry of these vocabularies goes on over a blank after another character, so a text's ids are the
    joined ids of its units: blanks and what follows up to the next blank. The model puts a blank first.
    """

    def __init__(self, name: str):
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        blank = "\u2581"
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(blank in p.lstrip(blank) for p in pieces):
            raise ValueError("an entry of the vocabulary crosses a blank")
        self.pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(blank, " ").encode() for i, p in enumerate(pieces)]
        self.blank = struct.pack("<I", self.model.piece_to_id(blank))

    def code(self, unit: str) -> bytes:
        return self.blank if unit == " " else np.array(self.model.encode(unit[1:], num_threads=1), "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts that already begin with the model's blank."""
        get = self.__getitem__
        return [b"".join(map(get, _UNIT.findall(data.decode("utf-8", "replace")))) for data in texts]

    def token_bytes(self) -> list[bytes]:
        return self.pieces


_LOADED: dict[tuple[str, bool], PieceTokenizer] = {}
_MODELS: dict[str, PieceModel] = {}


def tokenizer(name: str, special_as_text: bool = False) -> PieceTokenizer:
    """One tokenizer per worker process; its table is given back at the end of a task (:func:`forget`) or of the next operator's."""
    key = name, special_as_text
    if key not in _LOADED:
        _LOADED[key] = PieceTokenizer(*key)
    return _LOADED[key]


def piece_model(name: str) -> PieceModel:
    if name not in _MODELS:
        _MODELS[name] = PieceModel(name)
    return _MODELS[name]


def forget() -> None:
    """Empty the tables of pieces. Workers outlive their tasks; what the tables of different operators hold must not add up in them."""
    for table in (*_LOADED.values(), *_MODELS.values()):
        table.forget()
