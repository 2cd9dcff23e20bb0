"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

A document's set is its distinct word shingles. One hash per shingle gives the bin (upper bits) and the
value; a bin's minimum is its signature, an empty bin borrows from the first filled one in an order drawn
for that bin, the same for all documents. ``ROWS`` bins make a band; at similarity 0.8, ``BANDS`` bands
miss a pair with a chance below one in a million.

Documents with equal sets are one class and travel once. A bucket of classes is not paired up: the class
that meets most others is its centre and the others are its candidates, one edge each. Confirmed edges
give components. A bucket whose classes then lie in several components may hide a link between two
non-centres: the classes outside the bucket's largest component are joined with all others of such
buckets by an exact prefix filter. No bucket is cut or skipped. Candidates are confirmed on full sets,
which are made again from the texts of the classes that share a bucket at all.

What several steps read is a table in the shared folder; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.sources.folders import stored

from .common import LOWER, id_and_text, map_arrow, map_partition, texts

PERCENT = 80
ROWS, BANDS = 6, 48
BINS = ROWS * BANDS
_COUNTER_BITS = 20  # size of the frequency table of the late pairs
_MOST_WORDS = 200_000  # words in a task's hash table before it starts anew

_random = np.random.default_rng(20)
# Place of bin b in the order in which bin j looks for a filled one: _ORDER[j, b].
_ORDER = np.argsort(np.argsort(_random.random((BINS, BINS)), axis=1), axis=1).astype(np.uint16)
_EDGES = (np.arange(BINS, dtype=np.float64) / BINS * 2.0**64).astype(np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """Word -> 64-bit hash, filled as words come."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _MOST_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found

    def shingles(self, text: bytes, size: int) -> np.ndarray:
        """Sorted distinct hashes of the shingles; a shorter text is one shingle, one without words none."""
        words = text.translate(LOWER).split()
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        hashes = np.fromiter(map(self.__getitem__, words), np.uint64, n)
        size = min(size, n)
        code = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            code = _scramble(code * _MIX[k % len(_MIX)] + hashes[k:k + n - size + 1])
        return np.unique(code)


def signature(shingles: np.ndarray) -> np.ndarray:
    """``BINS`` minima of a sorted non-empty set, empty bins filled by optimal densification."""
    first = np.searchsorted(shingles, _EDGES)
    last = np.append(first[1:], len(shingles))
    filled = np.flatnonzero(first < last)
    values = shingles[np.minimum(first, len(shingles) - 1)]
    if len(filled) < BINS:
        empty = np.flatnonzero(first >= last)
        values[empty] = values[filled[_ORDER[np.ix_(empty, filled)].argmin(axis=1)]]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    """One key per band of the signature; the band's number is part of it."""
    rows = values.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _scramble(key * _MIX[0] + rows[:, k])
    return key.view(np.int64)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, the set's 128-bit name (a, b) and band keys; without words n is 0 and the rest null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        words = Words()
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("n", "a", "b", "bands")}
            for text in texts(batch.column(1)):
                found = words.shingles(text, size)
                name = xxhash.xxh3_128_digest(found.tobytes())
                rows["n"].append(len(found))
                rows["a"].append(int.from_bytes(name[:8], "little", signed=True) if len(found) else None)
                rows["b"].append(int.from_bytes(name[8:], "little", signed=True) if len(found) else None)
                rows["bands"].append(band_keys(signature(found)) if len(found) else None)
            yield {"doc_id": batch.column(0), **rows}

    return map_partition(docs, run, "doc_id bigint, n bigint, a bigint, b bigint, bands array<bigint>")


def _may_link(n: Column, m: Column) -> Column:
    """Sets of these sizes can be similar enough at all."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _full_sets(docs: DataFrame, wanted: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """node and sorted shingles of the wanted classes (nodes), made again from the texts of their least ids."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        words = Words()
        for batch in batches:
            found = [words.shingles(t, size) for t in texts(batch.column(1))]
            names = [xxhash.xxh3_128_digest(f.tobytes()) for f in found]
            yield {"doc_id": batch.column(0), "a": [int.from_bytes(n[:8], "little", signed=True) for n in names],
                   "b": [int.from_bytes(n[8:], "little", signed=True) for n in names], "shingles": [f.tobytes() for f in found]}

    sought = classes.join(wanted, "node", "left_semi").select("node", "doc_id", "a", "b")
    made = map_partition(docs.join(sought, "doc_id", "left_semi"), make, "doc_id bigint, a bigint, b bigint, shingles binary")
    return made.join(sought, ["doc_id", "a", "b"]).select("node", "shingles")


def _measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (x, y) of nodes with the size of their full sets' intersection and whether that links them."""
    left = sets.select(F.col("node").alias("x"), F.col("shingles").alias("sx"))
    right = sets.select(F.col("node").alias("y"), F.col("shingles").alias("sy"))

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        found, linked = [], []
        for a, b in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            at = np.searchsorted(large, small)
            found.append(int((large[np.minimum(at, len(large) - 1)] == small).sum()))
            linked.append(100 * found[-1] >= PERCENT * (len(a) + len(b) - found[-1]))
        return {"x": batch.column(0), "y": batch.column(1), "shared": found, "linked": linked}

    both = pairs.join(left, "x").join(right, "y").select("x", "y", "sx", "sy")
    return map_arrow(both, step, "x bigint, y bigint, shared bigint, linked boolean").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least reachable node) for all nodes of ``edges`` (x, y).

    Each round a node takes the least label among its neighbours and then its label's label, so labels
    travel twice as far each time. Labels are minima combined before the shuffle; a hub is a plain join
    key the engine can split.
    """
    both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).filter("x <> y").distinct()
    both = stored(both, "near-edges")
    labels = stored(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")), "near-labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("y"), F.col("label").alias("other")), "y")
                .groupBy("x").agg(F.min("other").alias("other")))
        moved = labels.join(near, labels["node"] == near["x"]).select("node", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = stored(moved.join(further, "label", "left").select("node", "old", F.least("label", "further").alias("label")), "near-labels")
        labels = after.select("node", "label")
        if after.filter("old <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))


def _late_pairs(open_docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (x < y) of classes in different components, one of them outside, that may still be similar enough.

    A set join by prefixes: shingles are ordered from rare to frequent among these classes. Sets of n and m
    shingles that share enough have a common shingle among the first n - o + 1 of one and m - o + 1 of the
    other, where o is the intersection they need. What a class has of its own is rare and comes first, so
    variants of one original hardly meet. Frequencies are kept in a table of fixed size; clashes in it
    only make the order worse, any order gives the same links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        total = np.zeros(1 << _COUNTER_BITS, np.int64)
        for batch in batches:
            for data in batch.column(1):
                np.add.at(total, np.frombuffer(data.as_buffer(), np.uint64) >> np.uint64(64 - _COUNTER_BITS), 1)
        yield {"total": [total.tobytes()]}

    tables = map_partition(sets.join(open_docs.select("node"), "node", "left_semi"), count, "total binary").rdd.map(lambda row: bytes(row[0]))
    add = lambda a, b: (np.frombuffer(a, np.int64) + np.frombuffer(b, np.int64)).tobytes()
    counts = sets.sparkSession.sparkContext.broadcast(np.frombuffer(tables.treeReduce(add, depth=3), np.int64))  # 8 MB

    def prefix(batch: pa.RecordBatch) -> dict[str, object]:
        found = []
        for data in batch.column(4):
            own = np.frombuffer(data.as_buffer(), np.uint64)
            order = np.lexsort((own, counts.value[own >> np.uint64(64 - _COUNTER_BITS)]))
            found.append(own[order[:len(own) - -(-PERCENT * len(own) // 100) + 1]].view(np.int64))
        return {"node": batch.column(0), "n": batch.column(1), "component": batch.column(2), "outside": batch.column(3), "tokens": found}

    rows = map_arrow(open_docs.join(sets, "node").select("node", "n", "component", "outside", "shingles"), prefix,
                     "node bigint, n bigint, component bigint, outside boolean, tokens array<bigint>")
    rows = rows.select("node", "n", "component", "outside", F.posexplode("tokens").alias("at", "token"))
    other = rows.filter("outside").select(F.col("node").alias("x"), F.col("n").alias("m"), F.col("component").alias("cx"), F.col("at").alias("ax"), "token")
    need = F.ceil(PERCENT * (F.col("n") + F.col("m")) / (100 + PERCENT))
    reach = (F.col("at") <= F.col("n") - need) & (F.col("ax") <= F.col("m") - need)
    return (rows.drop("outside").join(other, "token").filter("component <> cx").filter(_may_link(F.col("n"), F.col("m"))).filter(reach)
            .select(F.least("x", "node").alias("x"), F.greatest("x", "node").alias("y")).distinct())


def link_classes(docs: DataFrame, sets: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(classes, components): a, b -> node and least id, and node -> component for the classes with links.

    A node is one set; its number is unique also where a repeated id is the least of several sets.
    """
    named = (sets.filter("n > 0 and doc_id is not null").groupBy("a", "b")
             .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    classes = stored(named.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    members = classes.select("node", "n", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    # Only classes that share a bucket go on. The one that meets most others is the likeliest original: the centre.
    met = stored(members.join(buckets, "key"), "near-members")
    drawn = met.join(met.groupBy("node").agg(F.sum("k").alias("weight")), "node")
    centres = drawn.groupBy("key").agg(F.min(F.struct(-F.col("weight"), "node", "n")).alias("c")).select("key", F.col("c.node").alias("centre"), F.col("c.n").alias("m"))
    shared = stored(met.join(centres, "key").select("key", "node", "n", "centre", "m"), "near-stars")
    pairs = (shared.filter("node <> centre").filter(_may_link(F.col("n"), F.col("m")))
             .select(F.col("centre").alias("x"), F.col("node").alias("y")).distinct())
    full = stored(_full_sets(docs, shared.select("node").distinct(), classes, size), "near-full")
    edges = stored(_measure(pairs, full).filter("linked").select("x", "y"), "near-links")
    found = components(edges)
    placed = (shared.select("key", "node", "n").join(found, "node", "left")
              .withColumn("component", F.coalesce("component", "node")))
    # Buckets in several components: what lies outside the largest may still be linked to another member.
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    open_docs = stored(placed.join(largest, "key").groupBy("node").agg(
        F.first("n").alias("n"), F.first("component").alias("component"), F.bool_or(F.col("component") != F.col("largest")).alias("outside")), "near-open")
    if open_docs.isEmpty():
        return classes, found
    tested = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    more = _late_pairs(open_docs, full).join(tested, ["x", "y"], "left_anti")
    late = stored(_measure(more, full).filter("linked").select("x", "y"), "near-links")
    return classes, found if late.isEmpty() else components(edges.union(late))


def _judged(base: DataFrame, size: int) -> DataFrame:
    """doc_id, n, a, b, component_id of all rows, and whether the row's set is the one its component keeps (``head``)."""
    sets = stored(_sets(base, size), "near-sets")
    classes, found = link_classes(base.filter("doc_id is not null"), sets, size)
    least = classes.join(found, "node").groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("least"))
    heads = found.join(least, "component").select("node", F.col("least.doc_id").alias("component_id"), (F.col("node") == F.col("least.node")).alias("head"))
    named = (classes.select("a", "b", "node", "doc_id").join(heads, "node", "left")
             .select("a", "b", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("head", F.lit(True)).alias("head")))
    rows = sets.select("doc_id", "n", "a", "b").join(named, ["a", "b"], "left")
    return rows.select("doc_id", "n", "a", "b", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
                       F.coalesce("head", F.lit(True)).alias("head"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Null and empty texts have no shingles and are linked with nothing. Rows without an id are not linked:
    their component is null and they are kept. Rows that repeat an id each follow their own set. An empty
    table gives no rows; other columns are not read.
    """
    rows = _judged(id_and_text(docs, id_col, text_col), size)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                       F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """The rows of ``docs``, with all columns, of which one per component stays: that of its least id.

    Of rows that repeat an id and a set one stays; rows that repeat an id with another set follow that set.
    The ids that go wholly are found first and the rows meet them in one join; only rows of repeated ids
    are named by their sets again.
    """
    key = F.col(f"`{id_col}`").cast("bigint")
    judged = _judged(id_and_text(docs, id_col, text_col), size).filter("doc_id is not null")
    found = stored(judged.withColumn("kept", F.col("head") & (F.col("doc_id") == F.col("component_id"))).select("doc_id", "a", "b", "kept"), "near-verdicts")
    kept = found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    name = "gone"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    gone = kept.filter("not kept").select(F.col("doc_id").alias(name))
    repeated = kept.filter("kept and rows > 1").select(F.col("doc_id").alias(name))
    left = docs.join(gone, key == F.col(name), "left_anti")
    once = left.join(repeated, key == F.col(name), "left_anti")
    again = left.join(repeated, key == F.col(name), "left_semi")
    if repeated.isEmpty():
        return once

    @F.pandas_udf("binary")
    def set_name(text):  # type: ignore[no-untyped-def]
        import pandas as pd

        words = Words()
        sets = (words.shingles((t or "").encode(), size) for t in text)
        return pd.Series([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else b"" for x in sets], dtype=object)

    stay = map_arrow(found.filter("kept").join(repeated, F.col("doc_id") == F.col(name), "left_semi").select("doc_id", "a", "b").distinct(), _name,
                     "doc_id bigint, name binary").select(F.col("doc_id").alias(f"{name}id"), F.col("name").alias(f"{name}set"))
    again = again.withColumn(name, set_name(F.col(f"`{text_col}`").cast("string")))
    again = again.join(stay, (key == F.col(f"{name}id")) & (F.col(name) == F.col(f"{name}set")), "left_semi")
    return once.unionByName(again.dropDuplicates([id_col, name]).drop(name))


def _name(batch: pa.RecordBatch) -> dict[str, object]:
    """A set's 128-bit name as bytes; the empty one for the set without shingles."""
    both = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
    return {"doc_id": batch.column(0), "name": [b"" if a is None else b"".join(x.to_bytes(8, "little", signed=True) for x in (a, b)) for a, b in both]}
