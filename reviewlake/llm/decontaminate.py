"""Benchmark decontamination: a prefix-filtered join of item windows with document positions.

Each window of an item (``window`` words, or the whole item when shorter) is a sequence of word
shingles. Shingles are ordered by how often they occur in all documents. A window must be contained
completely, so its prefix is one shingle: the rarest. Documents meet a window only at places of that
shingle; the shingle's offset and the window's length bound where the window can lie; those words are
then compared exactly.

The item side is collected in blocks of a bounded number of words and sent to the tasks; the
documents never move. More items mean more blocks, and each block is one more narrow pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, id_and_text, map_arrow, map_partition, plain_words, texts

WINDOW = 10
SHINGLE = 5
# Words of the items sent to the tasks at once. As flat arrays and a vocabulary they take 80 to 180 MB in a worker,
# the more the fewer words repeat.
BLOCK_WORDS = 1_000_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingle_codes(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code per place of ``size`` words; a clash only costs a comparison, which is exact."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    wide = ids.astype(np.uint64) + np.uint64(1)
    code = np.zeros(n, np.uint64)
    for k in range(size):
        code += wide[k:k + n] * _MIX[k]
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
    return code


class Windows:
    """Vocabulary and distinct windows of one block of items in flat arrays, and their shingles by length."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int, shingle: int):
        self.vocabulary: dict[bytes, int] = {}
        self.window, self.shingle = window, shingle
        rows, owners = [np.empty((0, window), np.int32)], [np.empty(0, np.int64)]
        names = sorted({item for item, _ in items if item is not None})
        self.names = np.array(names, np.int64)
        number = {item: i for i, item in enumerate(names)}
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in plain_words((text or "").encode())], np.int32)
            if len(ids):
                cut = np.lib.stride_tricks.sliding_window_view(ids, window) if len(ids) >= window else \
                    np.append(ids, np.full(window - len(ids), -1, np.int32))[None, :]
                rows.append(cut)
                owners.append(np.full(len(cut), number.get(item, -1), np.int64))
        every, owner = np.ascontiguousarray(np.concatenate(rows)), np.concatenate(owners)
        _, first, which = np.unique(every.view(np.dtype((np.void, 4 * window))).ravel(), return_index=True, return_inverse=True)
        self.words = every[first]
        self.lengths = (self.words >= 0).sum(axis=1).astype(np.int32)
        pairs = np.unique(np.stack([which, owner])[:, owner >= 0], axis=1)
        self.owner_of, self.owner_first = pairs[1].astype(np.int32), np.searchsorted(pairs[0], np.arange(len(self.words) + 1))
        self.sizes = np.minimum(self.lengths, shingle)
        self.by_size = {int(s): np.unique(np.concatenate([c[ok] for c, ok in self._shingles(int(s))])) for s in np.unique(self.sizes)}
        self.prefix: dict[int, tuple[np.ndarray, ...]] = {}

    def __len__(self) -> int:
        return len(self.words)

    def _shingles(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each offset: the codes of the windows of this shingle length there, and which windows reach so far."""
        mine = self.words[self.sizes == size]
        lengths = self.lengths[self.sizes == size]
        for offset in range(int(lengths.max()) - size + 1):
            code = np.zeros(len(mine), np.uint64)
            for k in range(size):
                code += (mine[:, offset + k].astype(np.int64) + 1).astype(np.uint64) * _MIX[k]
                code ^= code >> np.uint64(29)
                code *= np.uint64(0xBF58476D1CE4E5B9)
            yield code, offset + size <= lengths

    def order(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Choose each window's rarest shingle; ``counts`` holds codes, ascending, and their numbers over all documents, by length."""
        self.prefix = {}
        for size in self.by_size:
            codes, numbers = counts.get(size, (np.empty(0, np.uint64), np.empty(0, np.int64)))
            best: tuple[np.ndarray, ...] | None = None
            for offset, (code, reaches) in enumerate(self._shingles(size)):
                at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
                n = np.where(codes[at] == code, numbers[at], 0) if len(codes) else np.zeros(len(code), np.int64)
                if best is None:
                    best = n, code, np.zeros(len(code), np.int8)
                else:  # of equally rare ones the least code, then the first
                    better = reaches & ((n < best[0]) | (n == best[0]) & (code < best[1]))
                    best = tuple(np.where(better, new, old) for new, old in zip((n, code, np.int8(offset)), best))
            order = np.argsort(best[1], kind="stable")
            code = best[1][order]
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            users = np.flatnonzero(self.sizes == size)[order].astype(np.int32)
            self.prefix[size] = code[first], np.append(first, len(code)), best[2][order], users

    def owners(self, window: int) -> list[int]:
        return self.names[self.owner_of[self.owner_first[window]:self.owner_first[window + 1]]].tolist()

    def word_ids(self, text: bytes) -> np.ndarray:
        words = plain_words(text)
        return np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int32, len(words))

    def places(self, ids: np.ndarray, size: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of shingles that are among the sorted ``codes``, and which they are."""
        n = len(ids) - size + 1
        if n <= 0 or not len(codes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = ids[:n] >= 0
        for k in range(1, size):
            known &= ids[k:k + n] >= 0
        at = np.flatnonzero(known)
        if not len(at):
            return at, at
        wide = np.zeros(len(at), np.uint64)
        for k in range(size):  # the same code as shingle_codes, only where all words are known
            wide += (ids[at + k].astype(np.uint64) + np.uint64(1)) * _MIX[k]
            wide ^= wide >> np.uint64(29)
            wide *= np.uint64(0xBF58476D1CE4E5B9)
        which = np.minimum(np.searchsorted(codes, wide), len(codes) - 1)
        hit = codes[which] == wide
        return at[hit], which[hit]

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, window) of every occurrence."""
        for size, (codes, first, offsets, users) in self.prefix.items():
            for at, which in zip(*(x.tolist() for x in self.places(ids, size, codes))):
                for user in range(first[which], first[which + 1]):
                    w = int(users[user])
                    start, n = at - int(offsets[user]), int(self.lengths[w])
                    if start >= 0 and start + n <= len(ids) and np.array_equal(ids[start:start + n], self.words[w, :n]):
                        yield start, w


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """Items in blocks of about ``block_words`` words (one longer item is a block of its own)."""
    words = F.size(F.split(F.coalesce("text", F.lit("")), "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+"))
    total = items.agg(F.coalesce(F.sum(words), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_words))
    for b in range(blocks):
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) == b)
        yield [(r[0], r[1]) for r in mine.collect()]


def _rarity(docs: DataFrame, shared: object) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Occurrences of the block's shingles in all documents; at most one row per item shingle comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        windows = shared.value
        sums = {s: np.zeros(len(c), np.int64) for s, c in windows.by_size.items()}
        for batch in batches:
            for text in texts(batch.column(1)):
                ids = windows.word_ids(text)
                for size, codes in windows.by_size.items():
                    _, which = windows.places(ids, size, codes)
                    if len(which):
                        np.add.at(sums[size], which, 1)
        for size, n in sums.items():
            at = np.flatnonzero(n)
            yield {"size": np.full(len(at), size, np.int32), "code": windows.by_size[size][at].view(np.int64), "n": n[at]}

    rows = map_partition(docs, count, "size int, code bigint, n bigint").groupBy("size", "code").agg(F.sum("n").alias("n")).toArrow()
    sizes, codes, n = (rows.column(k).to_numpy() for k in ("size", "code", "n"))
    out = {}
    for size in np.unique(sizes).tolist():
        mine = codes[sizes == size].view(np.uint64)
        order = np.argsort(mine)
        out[size] = mine[order], n[sizes == size][order]
    return out


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
                       block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document row: words, words inside an occurrence of an item window, items found.

    Columns: doc_id, n_words, n_hit, item_ids (array, ascending), spans (array of first and last word
    of the merged hit runs), contaminated. Null or empty texts have no words and are clean; items
    without words have no window. An item without an id still marks words but is not listed. Repeated
    items count once, repeated documents each. Without items or documents nothing is hit.
    """
    spark, base = docs.sparkSession, id_and_text(docs, id_col, text_col)
    frame = base.select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("runs"), F.lit(None).cast("array<bigint>").alias("items"))
    for items_block in _blocks(id_and_text(items, item_col, item_text_col), block_words):
        windows = Windows(items_block, window, shingle)
        if not len(windows):
            continue
        windows.order(_rarity(base, spark.sparkContext.broadcast(windows)))
        frame = _mark(frame, spark.sparkContext.broadcast(windows))

    def finish(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "spans", "contaminated")}
        for text, runs in zip(texts(batch.column(1)), batch.column(2).to_pylist()):
            merged: list[list[int]] = []
            for a, b in sorted(zip(runs[::2], runs[1::2])) if runs else ():
                if merged and a <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            out["n_words"].append(len(plain_words(text)))
            out["n_hit"].append(sum(b - a + 1 for a, b in merged))
            out["spans"].append([{"first_word": a, "last_word": b} for a, b in merged])
            out["contaminated"].append(bool(merged))
        return {"doc_id": batch.column(0), "item_ids": [sorted(set(x or ())) for x in batch.column(3).to_pylist()], **out}

    return map_arrow(frame, finish, "doc_id bigint, n_words bigint, n_hit bigint, item_ids array<bigint>, "
                                    "spans array<struct<first_word: bigint, last_word: bigint>>, contaminated boolean")


def _mark(frame: DataFrame, shared: object) -> DataFrame:
    """Add the occurrences of one block: runs as first, last, first, last, ... and the items they belong to."""

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        windows, runs, items = shared.value, batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for i, text in enumerate(texts(batch.column(1))):
            places: dict[int, int] = {}
            owners: set[int] = set()
            for start, w in windows.find(windows.word_ids(text)):
                places[start] = max(places.get(start, 0), start + int(windows.lengths[w]) - 1)
                owners.update(windows.owners(w))
            if places:
                runs[i] = (runs[i] or []) + [x for pair in sorted(places.items()) for x in pair]
                items[i] = (items[i] or []) + sorted(owners)
        return {"doc_id": batch.column(0), "text": batch.column(1), "runs": runs, "items": items}

    return map_arrow(frame, step, "doc_id bigint, text string, runs array<bigint>, items array<bigint>")


def items_digest(ids: list[int]) -> str:
    """SHA-256 of the ids, sorted as strings and comma-joined."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
                      block_words: int = BLOCK_WORDS) -> DataFrame:
    """The document rows in which no item window occurs, with all their columns; same rules as above."""
    spark, kept = docs.sparkSession, docs
    place = docs.columns.index(text_col)
    base = docs.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    for items_block in _blocks(id_and_text(items, item_col, item_text_col), block_words):
        windows = Windows(items_block, window, shingle)
        if not len(windows):
            continue
        windows.order(_rarity(base, spark.sparkContext.broadcast(windows)))
        kept = filter_rows(kept, _Clean(spark.sparkContext.broadcast(windows), place))
    return kept


class _Clean:
    def __init__(self, shared: object, place: int):
        self.shared, self.place = shared, place

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        windows = self.shared.value
        return np.array([next(windows.find(windows.word_ids(t)), None) is None for t in texts(batch.column(self.place))], bool)
