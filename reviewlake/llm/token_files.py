"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Documents are ordered by id over range partitions. A task tokenises its documents, cuts their joined
ids into blocks of ``BLOCK`` ids and packs up to ``SEGMENT`` ids as one segment of its file. Every
block starts with empty models, so blocks are coded side by side: one numpy step codes the next id of
all blocks of a segment.

The chance of an id is a mixture: what followed the last two ids before (order 2), what followed the
last id (order 1), and adaptive counts of magnitudes of the id's rank (order 0), weighted by how often
each order was right lately at its present confidence. The mixture drives a range coder with 64-bit
ranges and 16-bit output words.

A segment is: magic, counts, ids by falling frequency (the ranks), document ids and lengths, words and
CRC-32 per block, words of all blocks, CRC-32 of everything before. Segments are rows of a table that
Spark writes, so a lost task's output is replaced whole and any store will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.sources.folders import shared_folder

from .common import id_and_text, map_partition, texts
from .tokens import TOGETHER, tokenizer

BLOCK = 1024
SEGMENT = 1 << 23
MAGIC = b"CMRC0001"

_U = np.uint64
_CLASS_BITS = 20  # resolution of the mixture
_ONE = _U(1 << _CLASS_BITS)
_TOP = _U(1 << 48)  # a range below this is renewed by 16 bits
_SLOTS = 512  # places of each context table of a block
_BUCKETS = 17  # magnitudes of a rank
_REFRESH = 32  # ids between two refreshes of the order-0 table
_LEAST, _MOST = 512, 57344  # bounds of a weight, of 65536


class _Models:
    """The models of ``n`` blocks side by side, the same for coding and decoding; all numbers fit 32 bits.

    Both context orders lie in one array (order 2, then order 1), so that a call serves both. Places are
    64-bit integers and results go to given arrays: numpy takes and puts these without a copy.
    """

    def __init__(self, n: int, decoding: bool):
        self.n, self.lane, self.decoding = n, np.arange(n), decoding
        self.slot = np.stack([self.lane, self.lane + n * _SLOTS]).astype(np.int32)
        self.mixed = np.stack([self.lane * 8, (self.lane + n) * 8]).astype(np.int32)
        self.row = (self.lane * _BUCKETS).astype(np.int32)
        self.table = np.zeros(2 * n * _SLOTS, np.int32)  # (rank + 1) << 3 | confidence, 0 for an empty place
        self.weights = np.repeat(np.array([16384, 9830], np.int32), n * 8)  # chance of a hit by confidence, of 65536
        self.weights[::8] = _LEAST
        self.counts = np.ones(n * _BUCKETS, np.int32)
        self.last, self.before = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.use(n)
        self.refresh()

    def use(self, m: int) -> None:
        """The arrays that results go to, for the first ``m`` blocks."""
        self.m, self.slots, self.mixes = m, np.ascontiguousarray(self.slot[:, :m]), np.ascontiguousarray(self.mixed[:, :m])
        self.hash, self.guess, self.sure, self.weight, self.bounds = np.empty((5, 2, m), np.int32)  # guess: rank + 1; weight: chance of a hit
        self.first, self.second, self.both, self.rest, self.more, self.bound = np.empty((6, m), np.int32)
        self.place, self.sure_place, self.bucket_place = np.empty((2, m), np.int64), np.empty((2, m), np.int64), np.empty(m, np.int64)
        self.last, self.before = self.last[:m], self.before[:m]

    def refresh(self) -> None:
        counts = self.counts.reshape(self.n, _BUCKETS)
        share = counts * np.int32(256 - _BUCKETS)
        share //= counts.sum(axis=1, keepdims=True, dtype=np.int32)
        share += 1
        share[self.lane, counts.argmax(axis=1)] += 256 - share.sum(axis=1, dtype=np.int32)
        ends = np.cumsum(share, axis=1, dtype=np.int32)
        self.parts = ((ends - share) | ends << 9).ravel()  # start and end of a magnitude's part, of 256
        if self.decoding:
            self.bucket_of = np.repeat(np.tile(np.arange(_BUCKETS, dtype=np.uint8), self.n), share.ravel())  # 256 per block
        counts -= counts >> 2

    def predict(self, m: int) -> None:
        """Predictions and mixture weights for the next id of the first ``m`` blocks."""
        if m != self.m:
            self.use(m)
        a, b, more, places = self.last, self.before, self.more, self.hash
        two, one = places
        np.multiply(a, 24593, out=one)
        np.multiply(b, 30013, out=two)
        two += one
        two += np.right_shift(b, 3, out=more)
        one += np.right_shift(a, 5, out=more)
        places &= _SLOTS - 1
        places *= self.n
        places += self.slots
        self.place[:] = places
        packed = self.table.take(self.place, out=self.guess, mode="clip")
        np.bitwise_and(packed, 7, out=self.sure)
        packed >>= 3
        self.sure_place[:] = np.add(self.sure, self.mixes, out=places)
        weights = self.weights.take(self.sure_place, out=self.weight, mode="clip")
        first = np.left_shift(weights[0], _CLASS_BITS - 16, out=self.first)
        second = np.right_shift(weights[1], 6, out=self.second)
        second *= np.subtract(1 << _CLASS_BITS, first, out=more)
        second >>= 10
        np.add(first, second, out=self.both)
        np.subtract(1 << _CLASS_BITS, self.both, out=self.rest)
        np.multiply(second, packed[0] == packed[1], out=more)
        first += more
        second -= more

    def interval(self, m: int, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of a magnitude's part of the mixture."""
        self.bucket_place[:] = np.add(self.row[:m], bucket, out=self.bound)
        low, size = self.bounds
        part = self.parts.take(self.bucket_place, out=self.bound, mode="clip")
        np.bitwise_and(part, 511, out=low)
        np.right_shift(part, 9, out=size)
        self.bounds *= self.rest
        self.bounds >>= 8
        size -= low
        low += self.both
        return low, size

    def learn(self, rank1: np.ndarray, right: np.ndarray, missed: np.ndarray) -> None:
        """Take the coded rank + 1 into all models; :meth:`interval` was last asked for the magnitude of those that were missed.

        ``right``: which guesses were. ``rank1`` must stay as it is for two more ids.
        """
        more, weight, sure = self.hash, self.weight, self.sure
        np.multiply(right, np.int32(_MOST - _LEAST), out=more)
        more += np.int32(_LEAST)
        more -= weight
        more >>= 5
        weight += more
        self.weights[self.sure_place] = weight
        np.minimum(sure, 3, out=sure)
        sure *= right
        fresh = np.left_shift(rank1, 3, out=self.more)
        fresh |= 1
        sure += fresh
        self.table[self.place] = sure
        counts = self.counts.take(self.bucket_place, out=self.more, mode="clip")
        counts += np.multiply(missed, np.int32(24), out=self.bound)
        self.counts[self.bucket_place] = counts
        self.before, self.last = self.last, rank1


def _magnitude(x: np.ndarray) -> np.ndarray:
    """Bits of a number above 0, less 1: the exponent of a float, exact below 2^24."""
    exponent = x.astype(np.float32).view(np.int32)
    exponent >>= 23
    exponent -= 127
    return exponent


def _chosen(other: np.ndarray, missed: np.ndarray, *choices: tuple[np.ndarray, np.ndarray]) -> None:
    """In place: ``other`` where all missed, else the value whose condition holds; at most one does. Faster than ``np.where``."""
    other *= missed
    for value, where in choices:
        other += value * where


def code_blocks(ranks: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """16-bit words of each block. ``ranks``: one row per block; only the last block may be shorter."""
    n, steps = ranks.shape
    models, columns = _Models(n, False), np.add(ranks.T, 1, dtype=np.int32, order="C")
    width = 2 * steps + 16
    lows, sizes = np.zeros(n, _U), np.full(n, 2**64 - 1, _U)
    # Words, and where the next one of each block goes; equal places of all blocks lie side by side, since blocks fill alike.
    out, ats = np.zeros(n * width, np.int32), np.arange(n)
    for i in range(steps):
        m = n if i < lengths[-1] else n - 1
        if not m:
            break
        if i and i % _REFRESH == 0:
            models.refresh()
        if i % _REFRESH == 0:
            buckets = _magnitude(columns[i:i + _REFRESH])
        models.predict(m)
        low, size, at = lows[:m], sizes[:m], ats[:m]
        rank1, bucket = columns[i, :m], buckets[i % _REFRESH, :m]
        right = models.guess == rank1
        two, one = right[0], right[1] & ~right[0]
        missed = ~(two | one)
        start, part = models.interval(m, bucket)
        _chosen(start, missed, (models.first, one))
        _chosen(part, missed, (models.first, two), (models.second, one))
        bucket *= missed
        size >>= _U(_CLASS_BITS)
        new = start.astype(_U)
        new *= size
        size *= part.astype(_U)
        size >>= bucket.astype(_U)
        inside = rank1 - np.left_shift(1, bucket, out=bucket)
        inside *= missed
        new += size * inside.astype(_U)
        new += low
        carry = np.flatnonzero(new < low)
        if len(carry):
            out[at[carry] - n] += 1
        low[:] = new
        out[at] = (new >> _U(48)).astype(np.int32)  # counts where the range is thin; elsewhere the next word takes its place
        thin = size < _TOP
        shift = thin.astype(_U)
        shift <<= _U(4)
        at += thin * n
        low <<= shift
        size <<= shift
        thin = np.flatnonzero(size < _TOP)
        while len(thin):
            out[at[thin]] = (low[thin] >> _U(48)).astype(np.int32)
            at[thin] += n
            low[thin] <<= _U(16)
            size[thin] <<= _U(16)
            thin = thin[size[thin] < _TOP]
        models.learn(rank1, right, missed)
    low, out, filled = lows, np.ascontiguousarray(out.reshape(width, n)[:int(ats.max(initial=0)) // n + 1].T), ats // n
    end = low + (_TOP - _U(1))  # one word reaches into the last range; what follows reads as zeros
    carry = np.flatnonzero(end < low)
    out[carry, filled[carry] - 1] += 1
    out[np.arange(n), filled] = (end >> _U(48)).astype(np.int32)
    filled += 1
    for k in range(int(filled.max()) - 1, 0, -1):  # settle carries from the last word on
        out[:, k - 1] += out[:, k] >> 16
    out &= 0xFFFF
    return [out[j, :filled[j]].astype("<u2") for j in range(n)]


def decode_blocks(words: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
    """The ranks that :func:`code_blocks` coded, one row per block."""
    n, steps = len(words), int(lengths.max())
    models = _Models(n, True)
    table = np.zeros((n, max(map(len, words)) + 8), np.uint16)
    for j, w in enumerate(words):
        table[j, :len(w)] = w
    ats, table = np.arange(n), np.ascontiguousarray(table.T).ravel()
    codes, sizes = np.zeros(n, _U), np.full(n, 2**64 - 1, _U)
    for _ in range(4):
        codes <<= _U(16)
        codes |= table[ats]
        ats += n
    ranks = np.zeros((steps, n), np.int32)
    cell = models.lane << 8
    for i in range(steps):
        m = n if i < lengths[-1] else n - 1
        if not m:
            break
        if i and i % _REFRESH == 0:
            models.refresh()
        models.predict(m)
        code, size, at = codes[:m], sizes[:m], ats[:m]
        size >>= _U(_CLASS_BITS)
        target = code // size
        target = np.minimum(target, _ONE - _U(1), out=target).astype(np.int32)
        two = target < models.first
        missed = target >= models.both
        one = two | missed
        np.logical_not(one, out=one)
        target -= models.both
        np.maximum(target, 0, out=target)
        target += 1
        target <<= 8
        target -= 1
        target //= models.rest
        np.minimum(target, 255, out=target)
        bucket = models.bucket_of.take(target + cell[:m], mode="clip").astype(np.int32)
        start, part = models.interval(m, bucket)
        _chosen(start, missed, (models.first, one))
        _chosen(part, missed, (models.first, two), (models.second, one))
        bucket *= missed
        extra = bucket.astype(_U)
        code -= size * start.astype(_U)
        size *= part.astype(_U)
        size >>= extra
        offset = code // size
        np.minimum(offset, (_U(1) << extra) - _U(1), out=offset)
        code -= size * offset
        thin = size < _TOP
        shift = thin.astype(_U)
        shift <<= _U(4)
        word = table.take(at, mode="clip").astype(_U)
        word *= thin
        code <<= shift
        code |= word
        size <<= shift
        at += thin * n
        thin = np.flatnonzero(size < _TOP)
        while len(thin):
            code[thin] = code[thin] << _U(16) | table.take(at[thin], mode="clip")
            at[thin] += n
            size[thin] <<= _U(16)
            thin = thin[size[thin] < _TOP]
        rank1 = np.left_shift(1, bucket, out=bucket)
        rank1 += offset.astype(np.int32)
        _chosen(rank1, missed, (models.guess[0], two), (models.guess[1], one))
        np.subtract(rank1, 1, out=ranks[i, :m])
        models.learn(rank1, models.guess == rank1, missed)
    return ranks.T


def write_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One segment from documents' ids (little-endian unsigned 32-bit)."""
    stream = np.frombuffer(b"".join(ids), "<u4")
    counts = np.bincount(stream)
    values = np.flatnonzero(counts)
    values = values[np.argsort(-counts[values], kind="stable")]
    place = np.zeros(len(counts), np.int32)
    place[values] = np.arange(len(values), dtype=np.int32)
    ranks = place[stream]
    blocks = -(-len(stream) // BLOCK)
    lengths = np.full(blocks, BLOCK)
    lengths[-1:] = len(stream) - BLOCK * (blocks - 1) if blocks else []
    padded = np.zeros(blocks * BLOCK, np.int32)
    padded[:len(ranks)] = ranks
    words = code_blocks(padded.reshape(blocks, BLOCK), lengths) if blocks else []
    sums = [zlib.crc32(stream[k * BLOCK:(k + 1) * BLOCK].tobytes()) for k in range(blocks)]
    body = b"".join([
        MAGIC, struct.pack("<IQII", len(doc_ids), len(stream), len(values), blocks), values.astype("<u4").tobytes(),
        np.array([x is not None for x in doc_ids], "u1").tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([len(x) // 4 for x in ids], "<u4").tobytes(), np.array([len(w) for w in words], "<u4").tobytes(),
        np.array(sums, "<u4").tobytes(), *(w.tobytes() for w in words)])
    return body + struct.pack("<I", zlib.crc32(body))


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, list[int]]:
    """Document ids, all ids in order, documents' lengths; raises ValueError on any damage."""
    if data[:8] != MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
        raise ValueError("damaged token file segment")
    docs, total, distinct, blocks = struct.unpack_from("<IQII", data, 8)
    at = 8 + struct.calcsize("<IQII")

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, kind, n, at)
        at += found.nbytes
        return found

    values = take("<u4", distinct)
    known, doc_ids, lengths = take("u1", docs), take("<i8", docs), take("<u4", docs)
    sizes, sums = take("<u4", blocks), take("<u4", blocks)
    words = [take("<u2", int(s)) for s in sizes]
    block_lengths = np.full(blocks, BLOCK)
    block_lengths[-1:] = total - BLOCK * (blocks - 1) if blocks else []
    stream = values[decode_blocks(words, block_lengths).ravel()[:total]] if blocks else np.empty(0, "<u4")
    for k in range(blocks):
        if zlib.crc32(stream[k * BLOCK:(k + 1) * BLOCK].tobytes()) != sums[k]:
            raise ValueError(f"damaged block {k}")
    return [int(x) if k else None for x, k in zip(doc_ids, known)], stream, lengths.tolist()


def write_token_files(docs: DataFrame, path: str, tokenizer_name: str = "word_bpe_49k.json", end_id: int = 2,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, in ascending id order, as files of segments below ``path``.

    Each range of ids is a file: rows ``shard``, ``segment`` (in order), ``n_docs``, ``n_tokens``,
    ``payload``. Null texts are empty and give the end id alone; null ids come first, equal ids next
    to each other; an empty table gives files without rows. Other columns are not read.
    """
    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    end = np.array([end_id], "<u4").tobytes()

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[bytes]]]:
        """Some megabytes of texts at a time, so that a piece is looked up once in them."""
        docs: list[int | None] = []
        found: list[bytes] = []
        size = 0
        for batch in batches:
            docs += batch.column(0).to_pylist()
            found += texts(batch.column(1))
            size += batch.column(1).nbytes
            if size >= TOGETHER:
                yield docs, found
                docs, found, size = [], [], 0
        yield docs, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        shard, segment, pending = TaskContext.get().partitionId(), 0, 0
        held: list[int | None] = []
        ids: list[bytes] = []

        def flush() -> dict[str, object]:
            return {"shard": [shard], "segment": [segment], "n_docs": [len(held)], "n_tokens": [pending], "payload": [write_segment(held, ids)]}

        for docs, found in together(batches):
            for doc, coded in zip(docs, tokenizer(tokenizer_name).encode(found)):
                held.append(doc)
                ids.append(coded + end)
                pending += len(ids[-1]) // 4
                if pending >= SEGMENT:
                    yield flush()
                    segment, pending, held, ids = segment + 1, 0, [], []
        if held:
            yield flush()

    map_partition(ordered, run, "shard int, segment int, n_docs bigint, n_tokens bigint, payload binary", keep_pieces=True).write.parquet(path)


def read_token_files(df: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of written token files: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids.

    ``start`` counts the ids of all documents before it: totals of the files (one row each) and of the
    segments inside a file are summed up in order; no segment moves. Both checksums are verified.
    """
    sizes = df.select("shard", "segment", "n_tokens")
    files = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    in_order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = files.select("shard", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sizes.select("shard", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("before"))
              .join(files, "shard").select("shard", "segment", (F.col("file_start") + F.col("before")).alias("segment_start")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, segment = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                docs, stream, lengths = read_segment(batch.column(2)[row].as_buffer().to_pybytes())
                ends = np.cumsum(lengths)
                parts = [stream[e - n:e] for e, n in zip(ends.tolist(), lengths)]
                yield {"shard": [shard] * len(docs), "segment": [segment] * len(docs), "doc_id": docs, "before": ends - lengths,
                       "n_tokens": lengths, "ids_crc32": [zlib.crc32(p.astype("<u4").tobytes()) for p in parts],
                       "ids": [p.tolist() for p in parts] if with_ids else [None] * len(docs)}

    rows = map_partition(df.select("shard", "segment", "payload"), run,
                         "shard int, segment int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint, ids array<bigint>")
    found = rows.join(starts, ["shard", "segment"]).select("doc_id", (F.col("segment_start") + F.col("before")).alias("start"),
                                                           "n_tokens", "ids_crc32", "ids")
    return found if with_ids else found.drop("ids")


def round_trip(docs: DataFrame, **options: object) -> DataFrame:
    """Write the documents' token files to the shared folder and return what is read back from them."""
    spark = docs.sparkSession
    path = shared_folder(spark, "token-files")
    write_token_files(docs, path, **options)
    return read_token_files(spark.read.parquet(path))
