"""Exact substring dedup over a logarithmic family of sparse suffix arrays.

A byte goes if it lies in a 100-byte string that also starts earlier (smaller document id, or the same
document further left). Suffixes are taken at content-defined places only: in every 100-byte window the
24-byte gram with the least hash (the leftmost) is its anchor. Consecutive windows with one anchor are a
*span*; a span's extent depends on nothing but the bytes around it, so equal passages fall into equal
spans. One suffix per span, about one in 35 bytes, stands in the arrays, ordered by the anchor gram's
and then the span's fingerprints (two of 64 bits, both must agree for a match): what matters of the order is that equal beginnings lie together.

* Documents come in batches of ascending ids. A batch's array is cut into ranges of that order (a gram
  on a third of all documents spreads over several), sorted, and merge-scanned together with the levels
  of equal size before it; the outcome is the merged level, twice as large. A span met before is a match.
* Tasks drop spans they have seen themselves before anything is moved, so a passage that is everywhere
  moves once per task.
* Spans that differ but share their anchor can still have windows in common: the ends of long matches.
  These few are fetched as bytes, ordered by anchor, and compared window by window in blocks. Windows of
  an anchor that goes on in another block are dealt by their fingerprint, packed, and compared once more.
* A text is known by its document id, a 64-bit hash and 20 bits of a checksum of it, so that rows under one
  id, or under none, are told apart. Intervals to remove are grouped per text and meet the texts once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.sources.folders import shared_folder, stored
from reviewlake.sources.manifest import Files

from .common import id_and_text, map_arrow, map_partition, texts

LENGTH = 100
GRAM = 24
BATCHES = 4  # at least, and always a power of two, so that the family ends as one level
BATCH_BYTES = 64 << 30  # more text than this many bytes a batch makes for more batches
PART_BYTES = 64 << 20  # text whose suffixes one part of an array holds
SAMPLE_DOCS = 1000  # documents whose anchors place the range bounds; balance only, no result depends on them
_CHUNK = 1 << 18  # bytes hashed at once: the arrays of a step stay within a few MB
_WINDOWS = 400_000  # windows compared at once
_FLUSH = 1_500_000  # anchors after which a task sorts and passes on what it holds
_TAG = 20  # bits of a text's checksum beside its 64-bit hash
_WIDTH = 7  # bits of the number of windows of a span
_FIRST = -(2**63)

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BASE2 = _U(0xC2B2AE3D27D4EB4F)
_BACK2 = _U(pow(0xC2B2AE3D27D4EB4F, -1, 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


class Hasher:
    """Gram hashes of a byte array and fingerprints of its stretches, all by whole-array steps."""

    def __init__(self) -> None:
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []

    def load(self, data: np.ndarray, twice: bool = False) -> np.ndarray:
        """Gram hash at every place; ``twice`` prepares a second, independent fingerprint."""
        n = len(data) - GRAM + 1
        code = np.zeros(n, _U)
        for k in range(GRAM):
            code = code * _U(0x100000001B3) + data[k:k + n] + _U(1)
        self.grams = _mix(code)
        bases = [(_BASE, _BACK), (_BASE2, _BACK2)][:2 if twice else 1]
        if len(self.tables) < len(bases) or len(self.tables[0][0]) < n + 1:
            size = max(n + 1, _CHUNK + 1)
            self.tables = [(_powers(b, size), _powers(i, size)) for b, i in bases]
        self.sums = []
        for k, (up, _) in enumerate(self.tables[:len(bases)]):
            sums = np.zeros(n + 1, _U)
            np.cumsum((self.grams if not k else _mix(self.grams + _BASE2)) * up[:n], out=sums[1:])
            self.sums.append(sums)
        return self.grams

    def stretch(self, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """Fingerprint of the grams that start in [begin, end)."""
        sums, (_, down) = self.sums[which], self.tables[which]
        return _mix((sums[end] - sums[begin]) * down[begin])


def window_anchors(grams: np.ndarray) -> np.ndarray:
    """For each window of ``LENGTH`` bytes the place of its leftmost least gram."""
    wide = LENGTH - GRAM + 1
    value, place, span = grams, np.arange(len(grams), dtype=np.int64), 1
    while span * 2 <= wide:
        less = value[span:] < value[:-span]
        place = np.where(less, place[span:], place[:-span])
        value = np.where(less, value[span:], value[:-span])
        span *= 2
    rest = wide - span
    if rest:
        less = value[rest:] < value[:-rest]
        place = np.where(less, place[rest:], place[:-rest])
    return place


def text_tag(text: bytes) -> int:
    return zlib.crc32(text) & ((1 << _TAG) - 1)


def spans_of(batch: list[tuple[int, int, bytes]], hasher: Hasher) -> tuple[np.ndarray, ...]:
    """(gram hash, span hash, second span hash, document, text hash, place) of all spans; a place holds start, number of windows and text tag."""
    batch = [row for row in batch if len(row[2]) >= LENGTH]
    if not batch:
        return np.empty(0, _U), *(np.empty(0, np.int64) for _ in range(5))
    sizes = np.array([len(t) for *_, t in batch], np.int64)
    begins = np.cumsum(sizes) - sizes
    grams = hasher.load(np.frombuffer(b"".join(t for *_, t in batch), np.uint8).astype(_U), twice=True)
    anchor = window_anchors(grams)
    owner = np.repeat(np.arange(len(batch)), sizes)
    start = np.flatnonzero(owner[:len(anchor)] == owner[LENGTH - 1:LENGTH - 1 + len(anchor)])  # windows inside one text
    anchor = anchor[start]
    cut = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))
    low, high = start[cut], start[np.append(cut[1:], len(start)) - 1]
    at, windows = anchor[cut], high - low + 1
    shape = (at - low).astype(_U) * _BASE + windows.astype(_U) * _BASE2
    span, second = (_mix(hasher.stretch(low, high + LENGTH - GRAM + 1, k) + shape).view(np.int64) for k in (0, 1))
    text = owner[low]
    tags = np.array([text_tag(t) for *_, t in batch], np.int64)
    place = ((low - begins[text]) << (_WIDTH + _TAG)) | (windows << _TAG) | tags[text]
    doc, name = (np.array([row[k] for row in batch], np.int64)[text] for k in (0, 1))
    return _mix(grams[at] + _BASE), span, second, doc, name, place


def intervals(doc: np.ndarray, name: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, text hash, tag, start, end) of the bytes of spans, neighbours joined."""
    tag, start = place & ((1 << _TAG) - 1), place >> (_WIDTH + _TAG)
    end = start + ((place >> _TAG) & ((1 << _WIDTH) - 1)) + LENGTH - 1
    order = np.lexsort((start, tag, name, doc))
    doc, name, tag, start, end = (x[order] for x in (doc, name, tag, start, end))
    if not len(doc):
        return doc, name, tag, start, end
    # Spans of one text end in the order they start, so each only meets the one before.
    new = np.append(True, (doc[1:] != doc[:-1]) | (name[1:] != name[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > end[:-1]))
    first = np.flatnonzero(new)
    return doc[first], name[first], tag[first], start[first], end[np.append(first[1:], len(doc)) - 1]


def _new(g: np.ndarray, f: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of sorted rows: those whose span differs from the one before, by anchor or either fingerprint."""
    return np.append(True, (g[1:] != g[:-1]) | (f[1:] != f[:-1]) | (second[1:] != second[:-1]))[:len(g)]


def _later(new_key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of rows sorted by key, document, place: those that start after the first row of their key."""
    first = np.flatnonzero(new_key)
    head = np.repeat(first, np.diff(np.append(first, len(new_key))))
    shift = _WIDTH + _TAG
    return (doc != doc[head]) | ((place >> shift) != (place[head] >> shift))


# kind 0: span (g, f, doc, name, place, b = its second fingerprint); 1: bytes to remove (doc, name, g = tag, place = start, b = end).
_ROWS = "kind int, part int, g bigint, f bigint, doc bigint, name bigint, place bigint, b bigint"


def _rows(kind: int, part: object, g: np.ndarray, f: np.ndarray, doc: np.ndarray, name: np.ndarray, place: np.ndarray, b: np.ndarray) -> dict[str, object]:
    n = len(doc)
    return {"kind": np.full(n, kind, np.int32), "part": np.broadcast_to(part, n).astype(np.int32), "g": g.view(np.int64), "f": f, "doc": doc,
            "name": name, "place": place, "b": b}


def _gone(part: object, doc: np.ndarray, name: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, object]:
    return _rows(1, part, tag, np.zeros(len(doc), np.int64), doc, name, start, end)


def _texts_of(batch: pa.RecordBatch) -> list[tuple[int, int, bytes]]:
    return list(zip(batch.column("doc").to_pylist(), batch.column("name").to_pylist(), texts(batch.column("text"))))


def _bounds(docs: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Range bounds of (g, f) from the anchors of a bounded sample of documents."""
    count = docs.count()
    sample = docs.filter(F.pmod(F.xxhash64("doc", F.lit(3)), F.lit(max(1, count // SAMPLE_DOCS))) == 0).limit(4 * SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        hasher = Hasher()
        for batch in batches:
            g, f, *_ = spans_of(_texts_of(batch), hasher)
            yield {"g": g[::8].view(np.int64), "f": f[::8]}

    found = map_partition(sample, run, "g bigint, f bigint").toPandas()
    g, f = found["g"].to_numpy(np.int64), found["f"].to_numpy(np.int64)
    order = np.lexsort((f, g))
    at = order[np.linspace(0, len(order), parts + 1)[1:-1].astype(np.int64)] if len(order) else np.empty(0, np.int64)
    return g[at], f[at]


def _part(bounds: tuple[np.ndarray, np.ndarray], g: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Range of each row; rows of a gram that is a bound itself are placed by their span hash as well."""
    signed = g.view(np.int64)
    part, above = np.searchsorted(bounds[0], signed, "left"), np.searchsorted(bounds[0], signed, "right")
    split = np.flatnonzero(part < above)
    for low in np.unique(part[split]):
        rows = split[part[split] == low]
        high = above[rows[0]]
        part[rows] = low + np.searchsorted(bounds[1][low:high], f[rows], "left")
    return part


def _batch_array(docs: DataFrame, bounds: tuple[np.ndarray, np.ndarray], parts: int) -> DataFrame:
    """The suffixes of a batch, without those a task has met before in its own documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        hasher = Hasher()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[dict[str, object]]:
            g, f, second, doc, name, place = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((place, doc, second, f, g.view(np.int64)))
            g, f, second, doc, name, place = (x[order] for x in (g, f, second, doc, name, place))
            new = _new(g, f, second)
            later = _later(new, doc, place)
            yield _rows(0, _part(bounds, g[new], f[new]), g[new], f[new], doc[new], name[new], place[new], second[new])
            found = intervals(doc[later], name[later], place[later])
            yield _gone(found[0] % parts, *found)

        pending: list[tuple[int, int, bytes]] = []
        waiting = 0
        for batch in batches:
            for row in _texts_of(batch):
                pending.append(row)
                waiting += len(row[2])
                if waiting >= _CHUNK:
                    held.append(spans_of(pending, hasher))
                    size += len(held[-1][0])
                    pending, waiting = [], 0
                    if size >= _FLUSH:
                        yield from flush()
                        held, size = [], 0
        held.append(spans_of(pending, hasher))
        yield from flush()

    return map_partition(docs, run, _ROWS)


def _merge_scan(rows: DataFrame, parts: int, last: bool) -> DataFrame:
    """Sort suffixes into ranges and scan them: the distinct spans (kind 0), matched bytes (1).

    In the last scan of a family only those distinct spans are passed on whose anchor has a different
    span as well, or may have one in the next range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        # Rows come in order, so only the first place of the span in hand and the last distinct span are carried on.
        head: tuple[np.ndarray, ...] | None = None
        pending: tuple[np.ndarray, ...] | None = None
        first_gram, shared = None, False  # is the pending span's anchor also that of the span before it?
        for batch in batches:
            kind, _, *rows = [c.to_numpy() for c in batch.columns]
            through = kind == 1
            if through.any():
                yield _rows(1, 0, *(x[through] for x in rows))
            rows = [x[~through] for x in rows]
            if not len(rows[0]):
                continue
            if head is not None:
                rows = [np.concatenate((h, x)) for h, x in zip(head, rows)]
            g, f, doc, name, place, b = rows
            new = _new(g, f, b)
            later = _later(new, doc, place)
            yield _gone(0, *intervals(doc[later], name[later], place[later]))
            last_head = int(np.flatnonzero(new)[-1])
            if head is not None:
                new[0] = False  # the carried row was passed on before
            head = tuple(x[last_head:last_head + 1] for x in rows)
            fresh = [x[new] for x in rows]
            if not last:
                yield _rows(0, 0, *fresh)
                continue
            if pending is not None:
                fresh = [np.concatenate((p, x)) for p, x in zip(pending, fresh)]
            grams = fresh[0]
            if not len(grams):
                continue
            first_gram = grams[0] if first_gram is None else first_gram
            same = grams[1:] == grams[:-1]
            near = np.append(same, False) | np.append(shared, same) | (grams == first_gram)
            yield _rows(0, 0, *(x[:-1][near[:-1]] for x in fresh))
            pending, shared = tuple(x[-1:] for x in fresh), bool(np.append(shared, same)[-1])
        if pending is not None:  # its anchor may go on in the next range
            yield _rows(0, 0, *pending)

    dealt = rows.repartitionById(parts, "part").sortWithinPartitions("kind", "g", "f", "b", "doc", "place")
    return map_partition(dealt, run, _ROWS)


def _sizes(docs: DataFrame, batches: int | None) -> tuple[int, int]:
    """Number of parts of an array and of batches, from the bytes there are."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    return parts, batches or max(BATCHES, 1 << (total // BATCH_BYTES).bit_length())


def _write_level(rows: DataFrame) -> tuple[str, DataFrame]:
    """A level as a table whose suffixes (kind 0) and matches (kind 1) lie in folders of their own."""
    spark = rows.sparkSession
    path = shared_folder(spark, "suffix-level")
    rows.write.partitionBy("kind").parquet(path)
    columns = [c.split()[0] for c in _ROWS.split(", ")]
    return path, spark.read.schema(_ROWS).parquet(path).select(*columns)


def _family(docs: DataFrame, parts: int, batches: int) -> tuple[DataFrame, DataFrame]:
    """(bytes to remove as doc, name, tag, start, end; spans to compare as doc, name, g, place) over all batches."""
    if batches & (batches - 1) or batches < 1:
        raise ValueError("the number of batches must be a power of two")
    bounds = _bounds(docs, parts)
    cuts = docs.approxQuantile("doc", [i / batches for i in range(1, batches)], 0.001) if batches > 1 else []
    cuts = [int(c) for c in cuts]
    levels: list[tuple[int, DataFrame, str]] = []  # (batches inside, suffixes, folder), largest first
    removed: DataFrame | None = None
    for i in range(batches):
        mine = docs
        if i and cuts:
            mine = mine.filter(F.col("doc") > cuts[i - 1])
        if i < len(cuts):
            mine = mine.filter(F.col("doc") <= cuts[i])
        rows, size, merged = _batch_array(mine, bounds, parts), 1, []
        while levels and levels[-1][0] == size:  # equal sizes merge; the others are larger
            size *= 2
            _, level, folder = levels.pop()
            rows = rows.union(level)
            merged.append(folder)
        # Levels that stay are scanned as well. They are larger, so they are not written again.
        path, scanned = _write_level(_merge_scan(rows, parts, i == batches - 1))
        gone = scanned.filter("kind = 1").select("doc", "name", F.col("g").alias("tag"), F.col("place").alias("start"), F.col("b").alias("end"))
        removed = gone if removed is None else removed.union(gone)
        if levels:
            removed = removed.union(stored(_against(scanned, [t for _, t, _ in levels], i), "suffix-matches"))
        for folder in merged:  # their suffixes are in the new level; their matches stay
            Files(docs.sparkSession, folder).delete(["kind=0"])
        part = _part_column(bounds)
        levels.append((size, scanned.filter("kind = 0").withColumn("part", part("g", "f")), path))
        if not cuts:
            break
    return removed, levels[-1][1].select("doc", "name", "g", "place")


_GONE = "doc bigint, name bigint, tag bigint, start bigint, end bigint"


def _against(scanned: DataFrame, levels: list[DataFrame], batch: int) -> DataFrame:
    """Bytes of a batch's distinct spans that stand in larger levels, which hold smaller ids only."""
    spans = scanned.filter("kind = 0").select("g", "f", "b", "doc", "name", "place")
    found = spans
    for k, level in enumerate(levels):
        hit = level.select("g", "f", "b").distinct()
        found_k = spans.join(hit, ["g", "f", "b"], "left_semi")
        found = found_k if not k else found.union(found_k)

    def step(b: pa.RecordBatch) -> dict[str, object]:
        return dict(zip(("doc", "name", "tag", "start", "end"), intervals(*(c.to_numpy() for c in b.columns))))

    return map_arrow(found.select("doc", "name", "place"), step, _GONE)


def _part_column(bounds: tuple[np.ndarray, np.ndarray]):
    @F.pandas_udf("int")
    def part(g, f):  # type: ignore[no-untyped-def]
        import pandas as pd

        return pd.Series(_part(bounds, g.to_numpy(np.int64).view(_U), f.to_numpy(np.int64)).astype(np.int32))

    return part


def _compare(docs: DataFrame, spans: DataFrame, parts: int) -> DataFrame:
    """Bytes to remove among spans that share an anchor, window by window: doc, name, tag, start, end."""
    per_text = spans.groupBy("doc", "name").agg(F.collect_list(F.struct("g", "place")).alias("spans"))  # at most one per 35 bytes of text

    def cut(batch: pa.RecordBatch) -> dict[str, object]:
        rows: dict[str, list] = {k: [] for k in ("g", "doc", "name", "place", "data")}
        for (doc, name, text), found in zip(_texts_of(batch), batch.column("spans").to_pylist()):
            tag = text_tag(text)
            for s in found:
                if s["place"] & ((1 << _TAG) - 1) == tag:
                    start = s["place"] >> (_WIDTH + _TAG)
                    piece = text[start:start + ((s["place"] >> _TAG) & ((1 << _WIDTH) - 1)) + LENGTH - 1]
                    for column, value in zip(rows.values(), (s["g"], doc, name, s["place"], piece)):
                        column.append(value)
        return rows

    pieces = map_arrow(docs.join(per_text, ["doc", "name"]).select("doc", "name", "text", "spans"), cut,
                       "g bigint, doc bigint, name bigint, place bigint, data binary")
    ordered = pieces.repartitionByRange(parts, "g", F.xxhash64("data")).sortWithinPartitions("g")

    def met(one: np.ndarray, two: np.ndarray, doc: np.ndarray, name: np.ndarray, tag: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of windows by content and place, and which of them start after the first of their content."""
        order = np.lexsort((start, doc, two, one))
        one, two, doc, start = (x[order] for x in (one, two, doc, start))
        return order, _later(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[:len(one)], doc, start << (_WIDTH + _TAG))

    def matched(doc: np.ndarray, name: np.ndarray, tag: np.ndarray, start: np.ndarray) -> dict[str, object]:
        found = intervals(doc, name, (start << (_WIDTH + _TAG)) | (1 << _TAG) | tag)
        n = len(found[0])
        return {"part": (found[0] % parts).astype(np.int32), "windows": [None] * n, **dict(zip(("doc", "name", "tag", "start", "end"), found))}

    def settle(held: list[np.ndarray]) -> Iterator[dict[str, object]]:
        g, *window = np.concatenate(held, axis=1)
        order, later = met(*window)
        window = [x[order] for x in window]
        yield matched(*(x[later] for x in window[2:]))
        # Anchors that may go on in the blocks before or after: their distinct windows meet those of the other blocks.
        edge = ((g == g[0]) | (g == g[-1]))[order] & ~later
        window = [x[edge] for x in window]
        part = ((window[0].view(_U) >> _U(20)) % _U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        packed = np.stack([x[order] for x in window])
        held_parts, first = np.unique(part[order], return_index=True)
        ends = np.append(first[1:], len(part))
        none = [None] * len(held_parts)
        yield {"part": held_parts, "windows": [packed[:, a:b].tobytes() for a, b in zip(first, ends)], "doc": none, "name": none, "tag": none, "start": none, "end": none}

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        hasher = Hasher()
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            data = [x.as_buffer() for x in batch.column("data")]
            sizes = np.array([len(x) for x in data], np.int64)
            hasher.load(np.frombuffer(b"".join(data), np.uint8).astype(_U), twice=True)
            begins, n = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
            at = np.repeat(begins - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            inside = at - np.repeat(begins, n)
            end = at + LENGTH - GRAM + 1
            g, doc, name, place = (np.repeat(batch.column(k).to_numpy(), n) for k in ("g", "doc", "name", "place"))
            held.append(np.stack([g, hasher.stretch(at, end).view(np.int64), hasher.stretch(at, end, 1).view(np.int64), doc, name,
                                  place & ((1 << _TAG) - 1), (place >> (_WIDTH + _TAG)) + inside]))
            size += len(at)
            if size >= _WINDOWS:
                yield from settle(held)
                held, size = [], 0
        if held:
            yield from settle(held)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        held: list[np.ndarray] = []
        for batch in batches:
            packed = batch.column("windows")
            done = packed.is_null().to_numpy(zero_copy_only=False)
            yield {k: batch.column(k).filter(pa.array(done)) for k in ("doc", "name", "tag", "start", "end")}
            held += [np.frombuffer(x.as_buffer(), np.int64).reshape(6, -1) for x in packed if x.is_valid]
        if held:
            window = list(np.concatenate(held, axis=1))
            order, later = met(*window)
            found = matched(*(x[order][later] for x in window[2:]))
            yield {k: found[k] for k in ("doc", "name", "tag", "start", "end")}

    found = map_partition(ordered, windows, f"part int, windows binary, {_GONE}")
    return map_partition(found.repartition(parts, "part"), across, _GONE)


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int | None = None) -> DataFrame:
    """One row per document row: doc_id, text, spans (array of start, end in bytes, maximal and ascending).

    Null and empty texts have nothing to remove. ``batches``, a power of two, is derived from the amount of text
    unless it is given. A null id comes before all others; rows that repeat an
    id (or have none) share their place in the order, so equal places in them are not earlier or later.
    An empty table gives no rows; other columns are not read.
    """
    base = id_and_text(docs, id_col, text_col)
    keyed = base.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("doc"), F.xxhash64("text").alias("name"), "text")
    parts, batches = _sizes(keyed, batches)
    removed, near = _family(keyed, parts, batches)
    gone = removed.union(_compare(keyed, near, parts))
    per_text = gone.groupBy("doc", "name").agg(F.collect_list(F.struct("tag", "start", "end")).alias("gone"))  # bounded by the text's length

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        out = []
        for text, found in zip(texts(batch.column("text")), batch.column("gone").to_pylist()):
            merged: list[list[int]] = []
            tag = text_tag(text) if found else 0
            for start, end in sorted((s["start"], s["end"]) for s in found or () if s["tag"] == tag):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            out.append([{"start": a, "end": b} for a, b in merged])
        ids = [None if x == _FIRST else x for x in batch.column("doc").to_pylist()]
        return {"doc_id": ids, "text": batch.column("text"), "spans": out}

    return map_arrow(keyed.join(per_text, ["doc", "name"], "left").select("doc", "text", "gone"), step,
                     "doc_id bigint, text string, spans array<struct<start: bigint, end: bigint>>")


def cut_out(text: bytes, spans: list[dict[str, int]]) -> bytes:
    """The bytes outside the spans."""
    kept, at = [], 0
    for s in spans:
        kept.append(text[at:s["start"]])
        at = s["end"]
    return b"".join([*kept, text[at:]])


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of :func:`removed_spans`."""

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        rows = list(zip(texts(batch.column(1)), batch.column(2).to_pylist()))
        return {"doc_id": batch.column(0), "n_bytes": [len(t) for t, _ in rows], "n_spans": [len(s) for _, s in rows],
                "n_removed": [sum(x["end"] - x["start"] for x in s) for _, s in rows],
                "kept_sha256": [hashlib.sha256(cut_out(t, s)).hexdigest() for t, s in rows]}

    return map_arrow(found, step, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
