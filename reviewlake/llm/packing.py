"""Packing: first-fit decreasing in randomised groups of documents, with a tournament tree of bin capacities.

A task tokenises documents; one shuffle deals them by a hash to groups of about ``GROUP`` documents.
In a group whole sequences are cut off first, then the remainders are packed: longest first, each into
the first bin that holds it, found by walking the tournament tree of free capacities from its root.
Afterwards the emptiest bins are cut up to fill the gaps of the others, and what is left of the last one
is cut into sequences whose lengths are powers of two, so that next to nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, id_and_text, map_arrow, ship, texts
from .tokens import tokenizer

LENGTH = 2048
GROUP = 2048  # documents of a group, on average; groups are independent


class Tournament:
    """First bin with enough room: a heap-shaped tree whose nodes hold the largest capacity below them."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [0] * (2 * self.leaves)
        for i in range(bins):
            self.tree[self.leaves + i] = capacity
        for i in range(self.leaves - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def take(self, size: int) -> int:
        """Put ``size`` into the first bin that has room and return the bin."""
        at = 1
        while at < self.leaves:
            at = 2 * at if self.tree[2 * at] >= size else 2 * at + 1
        found = at - self.leaves
        self.tree[at] -= size
        while at > 1:
            at //= 2
            self.tree[at] = max(self.tree[2 * at], self.tree[2 * at + 1])
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers by bin; longer items first, equal ones in order."""
    tree = Tournament(max(1, len(sizes)), capacity)
    bins: dict[int, list[int]] = {}
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bins.setdefault(tree.take(sizes[item]), []).append(item)
    return [bins[b] for b in sorted(bins)]


Piece = tuple[int, int, int]  # document of the group, start, length


def pack(totals: list[int], capacity: int = LENGTH) -> list[list[Piece]]:
    """Sequences of pieces that hold every token of the documents once; all are full or a power of two long."""
    sequences: list[list[Piece]] = []
    rest: list[Piece] = []
    for doc, total in enumerate(totals):
        whole = total // capacity * capacity
        sequences += [[(doc, at, capacity)] for at in range(0, whole, capacity)]
        if total > whole:
            rest.append((doc, whole, total - whole))
    bins = [[rest[i] for i in found] for found in first_fit_decreasing([p[2] for p in rest], capacity)]
    bins.sort(key=lambda b: -sum(p[2] for p in b))  # stable: equal fill keeps the order
    room = [capacity - sum(p[2] for p in b) for b in bins]
    low, high = 0, len(bins) - 1
    while low < high:  # cut the emptiest bin into the gaps of the fullest
        if not room[low]:
            low += 1
            continue
        doc, start, size = bins[high].pop()
        moved = min(size, room[low])
        bins[low].append((doc, start + size - moved, moved))
        room[low] -= moved
        room[high] += moved
        if moved < size:
            bins[high].append((doc, start, size - moved))
        if not bins[high]:
            high -= 1
    for found in bins:
        fill = sum(p[2] for p in found)
        if not fill:
            continue
        while fill:
            part = capacity if fill == capacity else 1 << (fill.bit_length() - 1)
            fill -= part
            sequence: list[Piece] = []
            while part:
                doc, start, size = found.pop(0)
                used = min(size, part)
                sequence.append((doc, start, used))
                part -= used
                if used < size:
                    found.insert(0, (doc, start + used, size - used))
            sequences.append(sequence)
    return sequences


SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
          "ids array<int>")


def id_width(tokenizer_name: str, end_id: int) -> str:
    """Number type that holds every id of the tokenizer and the end id: two bytes, or four from 2^16 on."""
    if not 0 <= end_id < 1 << 31:
        raise ValueError("the end id must fit into a column of integers")
    return "<u2" if max(end_id, *tokenizer(tokenizer_name).tokenizer.get_vocab().values()) < 1 << 16 else "<u4"


def pack_documents(docs: DataFrame, tokenizer_name: str = "byte_bpe_50k.json", end_id: int = 1, length: int = LENGTH,
                   group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: the document, where the piece starts in it, its ids, its sequence and place there.

    ``sequence_id`` is the group in the upper bits and the number inside the group below. A sequence
    shorter than ``length`` is a power of two long and needs no padding. Null texts are empty and give
    the end id alone; null ids stay; repeated rows are packed each; an empty table gives no rows. A row's group
    is drawn from its id, its ids and its number in the input. Files give the same numbers to a repeated task;
    what comes out of a shuffle should be written first, as the pipeline does.
    """
    spark = docs.sparkSession
    base = id_and_text(docs, id_col, text_col).withColumn("number", F.monotonically_increasing_id())
    groups = max(1, -(-base.count() // group))
    end = np.array([end_id], "<u4").tobytes()
    width = id_width(tokenizer_name, end_id)

    def tokens(batch: pa.RecordBatch) -> dict[str, object]:
        coded = [x + end for x in tokenizer(tokenizer_name).encode(texts(batch.column(1)))]
        # Ids travel in as few bytes as the vocabulary allows; the group is drawn from the row's id, content and stored number.
        seeds = [zlib.crc32(x, i & 0xFFFFFFFF) for i, x in zip(batch.column("number").to_pylist(), coded)]
        doc = batch.column(0).fill_null(-1).to_numpy().astype(np.uint64)
        mixed = (doc + np.array(seeds, np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        return {"part": (mixed % np.uint64(groups)).astype(np.int32), "doc_id": batch.column(0), "order": mixed.astype(np.int64),
                "ids": [np.frombuffer(x, "<u4").astype(width).tobytes() for x in coded]}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("order", "ascending")])
        part = table.column("part")[0].as_py()
        doc_ids = table.column("doc_id").to_pylist()
        ids = [np.frombuffer(x.as_buffer(), width) for x in table.column("ids").combine_chunks()]
        rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        kept: list[np.ndarray | None] = []
        for number, sequence in enumerate(pack([len(x) for x in ids], length)):
            offset = 0
            for doc, start, size in sequence:
                piece = ids[doc][start:start + size]
                values = (doc_ids[doc], start, size, zlib.crc32(piece.astype("<u4").tobytes()), len(ids[doc]), part << 32 | number, offset)
                for column, value in zip(rows.values(), values):
                    column.append(value)
                kept.append(piece.astype(np.int32) if with_ids else None)
                offset += size
        packed = pa.table({**{k: pa.array(v, pa.int64()) for k, v in rows.items()}, "ids": pa.array(kept, pa.list_(pa.int32()))})
        del rows, kept, ids, table
        give_back()  # the next group comes to the same worker
        return packed

    ship(spark)
    dealt = map_arrow(base, tokens, "part int, doc_id bigint, order bigint, ids binary")
    packed = dealt.groupBy("part").applyInArrow(run, SCHEMA)
    return packed if with_ids else packed.drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids; at most ``LENGTH`` ids each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # the pieces of one sequence
    return (pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
            .select("sequence_id", "length", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids")))
