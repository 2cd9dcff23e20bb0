"""Cross-tokenizer alignment: where two tokenizers' tokens end together, and how the ids meet there.

Two tokenizers cut the same bytes. The places where tokens of both end are the intersection of two
ascending lists of ends, found by galloping: the shorter list drives an exponential and then a binary
search into the longer. Between two such places lies a group, whose tokens overlap; the differences of
ranks are the overlap's lengths on either side. The two tokens that end together are linked.

How often a pair of ids is linked is counted over the whole corpus and handed back. A task does not send
one row per link: about ``BATCH_BYTES`` of text share one list of distinct pairs, which is counted and
answered by plain joins on the pair.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.sources.folders import stored

from .common import id_and_text, map_partition, texts
from .tokens import piece_model, tokenizer

BATCH_BYTES = 2 << 20  # text whose distinct pairs are asked for together
_LEADERS = (64, 8, 1)  # strides of the search: every 64th end first, then those between


def _first_not_below(sought: np.ndarray, start: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each sought value the first place from ``start`` on whose end is not below it (there is one)."""
    low, high, step = start.copy(), start.copy(), 1
    going = np.flatnonzero(ends[start] < sought)
    while len(going):  # exponential: 1, 2, 4, ... places further
        probe = np.minimum(start[going] + step, len(ends) - 1)
        there = ends[probe] >= sought[going]
        high[going[there]] = probe[there]
        low[going[~there]] = probe[~there]
        going, step = going[~there], 2 * step
    going = np.flatnonzero(high - low > 1)
    while len(going):  # binary between the last two probes
        middle = (low[going] + high[going]) >> 1
        there = ends[middle] >= sought[going]
        high[going[there]] = middle[there]
        low[going[~there]] = middle[~there]
        going = going[high[going] - low[going] > 1]
    return high


def gallop(short: np.ndarray, start: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where each value of ``short`` would stand in ``ends``, not before ``start``; both ascend.

    All searches of one stride advance together; each begins where its leader of the stride before ended.
    """
    found = np.empty(len(short), np.int64)
    done = 0
    for stride in _LEADERS:
        at = np.arange(0, len(short), stride)
        begin = start[at]
        if done:
            begin = np.maximum(begin, found[at // done * done])
        found[at] = _first_not_below(short[at], begin, ends)
        done = stride
    return found


def common_ends(a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in ``a`` and ``b`` of the ends that both hold, for many texts that follow each other.

    ``a_first`` and ``b_first`` are the texts' first ranks and, last, the lengths; each text's shorter list drives.
    """
    left, right = [], []
    n_a, n_b = np.diff(a_first), np.diff(b_first)
    for drives, own, own_first, n, other, other_first in ((n_a <= n_b, a, a_first, n_a, b, b_first), (n_a > n_b, b, b_first, n_b, a, a_first)):
        text = np.repeat(np.arange(len(n)), n)
        rank = np.flatnonzero(drives[text])
        if len(rank):
            at = gallop(own[rank], other_first[:-1][text[rank]], other)
            hit = other[at] == own[rank]
            (left if own is a else right).append(rank[hit])
            (right if own is a else left).append(at[hit])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left_ranks, right_ranks = np.concatenate(left), np.concatenate(right)
    order = np.argsort(left_ranks, kind="stable")
    return left_ranks[order], right_ranks[order]


class Side:
    """One tokenizer: its ids for texts that begin with a blank, and the bytes of its ids."""

    def __init__(self, coder):
        self.encode = coder.encode
        self.bytes = coder.token_bytes()
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)

    def ids(self, data: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4").astype(np.int64) for x in self.encode(data)]

    def spells(self, ids: np.ndarray, data: bytes) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())) == data


class Aligner:
    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        most = max(len(a.bytes), len(b.bytes))
        self.words = [f"{i}{mark}".encode() for i in range(most) for mark in ",|;"]

    def align(self, data: list[bytes]) -> dict[str, object]:
        """Counts, group digests and links of texts; a text that either side does not spell again has no tokens."""
        full = [b" " + x if x else b"" for x in data]
        left, right = self.a.ids(full), self.b.ids(full)
        for i, text in enumerate(full):
            if text and not (self.a.spells(left[i], text) and self.b.spells(right[i], text)):
                left[i] = right[i] = np.empty(0, np.int64)
        n_a, n_b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
        a, b = np.concatenate(left), np.concatenate(right)
        a_first, b_first = (np.concatenate(([0], np.cumsum(n))).astype(np.int64) for n in (n_a, n_b))
        in_a, in_b = common_ends(np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b]), a_first, b_first)
        group_first = np.searchsorted(in_a, a_first)
        # A token's place in the digest: its own rank and, before it, the other side's tokens of earlier (A) or also this (B) group.
        ends_a, ends_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        ends_a[in_a], ends_b[in_b] = True, True
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.concatenate(([0], in_b + 1))[group_a]] = a * 3 + ends_a
        codes[np.arange(len(b)) + in_a[group_b] + 1] = b * 3 + 2 * ends_b
        texts_first = a_first + b_first
        digests = ["" if s == e else hashlib.sha256(b"".join(map(self.words.__getitem__, codes[s:e].tolist()))[:-1]).hexdigest()
                   for s, e in zip(texts_first[:-1].tolist(), texts_first[1:].tolist())]
        return {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(group_first), "digests": digests, "first": group_first,
                "pairs": a[in_a] << 32 | b[in_b],
                "spans": (in_a, in_b)}


def groups(aligner: Aligner, text: bytes) -> list[tuple[int, int, int, int]]:
    """(first A rank, A tokens, first B rank, B tokens) of each group of a text, from the rank differences."""
    in_a, in_b = aligner.align([text])["spans"]
    starts = [np.concatenate(([0], x[:-1] + 1)) if len(x) else x for x in (in_a, in_b)]
    return list(zip(starts[0].tolist(), (in_a + 1 - starts[0]).tolist(), starts[1].tolist(), (in_b + 1 - starts[1]).tolist()))


def load(a_name: str, b_name: str) -> Aligner:
    return Aligner(Side(tokenizer(a_name, special_as_text=True)), Side(piece_model(b_name)))


_ROWS = ("batch string, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, digests array<string>, "
         "pairs array<bigint>, times array<bigint>, which binary, often binary, first array<bigint>")


def _aligned(docs: DataFrame, a_name: str, b_name: str) -> DataFrame:
    """One row per batch of texts: counts per text, the batch's distinct pairs, and which of them each text holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        aligner, ids, waiting, size = load(a_name, b_name), [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                ids.append(doc)
                waiting.append(text)
                size += len(text) + 64
                if size >= BATCH_BYTES:
                    yield _row(aligner, ids, waiting)
                    ids, waiting, size = [], [], 0
        if ids:
            yield _row(aligner, ids, waiting)

    return map_partition(docs, run, _ROWS)


def _row(aligner: Aligner, ids: list, data: list[bytes]) -> dict[str, object]:
    found = aligner.align(data)
    pairs, code, times = np.unique(found["pairs"], return_inverse=True, return_counts=True)
    # The same pair of one text is kept once: sort by (text, pair) and count runs.
    text = np.repeat(np.arange(len(ids)), np.diff(found["first"]))
    own, often = np.unique(text * max(1, len(pairs)) + code, return_counts=True)
    first = np.searchsorted(own, np.arange(len(ids) + 1) * max(1, len(pairs)))
    return {"batch": [uuid.uuid4().hex], "doc_id": [ids], "n_a": [found["n_a"]], "n_b": [found["n_b"]], "n_groups": [found["n_groups"]],
            "digests": [found["digests"]], "pairs": [pairs], "times": [times], "which": [(own % max(1, len(pairs))).astype("<u4").tobytes()],
            "often": [often.astype("<u4").tobytes()], "first": [first]}


def _numbers(row: pa.Scalar) -> np.ndarray:
    return row.values.to_numpy(zero_copy_only=False)


def _answered(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                which, often = (np.frombuffer(row[k].as_buffer(), "<u4").astype(np.int64) for k in ("which", "often"))
                first, pairs = _numbers(row["first"]), _numbers(row["pairs"])
                totals, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
                if row["answers"].is_valid:
                    answers = row["answers"].values
                    at = np.searchsorted(pairs, answers.field(0).to_numpy())
                    totals[at] = answers.field(1).to_numpy()
                    best[at] = answers.field(2).to_numpy(zero_copy_only=False)
                sums = [np.concatenate(([0], np.cumsum(x))) for x in (often, often * best[which], often * totals[which])]
                n_links, n_best, count_sum = (x[first[1:]] - x[first[:-1]] for x in sums)
                yield {"doc_id": row["doc_id"].values, **{k: row[k].values for k in ("n_a", "n_b", "n_groups")}, "n_links": n_links,
                       "n_best": n_best, "count_sum": count_sum, "groups_sha256": row["digests"].values}

    return map_partition(rows, run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, total, best): links of each pair of ids, and whether no other A id is linked more often with its B id."""
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    top = totals.groupBy(b.alias("b")).agg(F.max("total").alias("top"))
    return totals.withColumn("b", b).join(top, "b").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))


def align_tokenizers(docs: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model",
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: tokens, groups and links, how many links are their B id's most frequent, the links' counts.

    Null and empty texts, and texts whose tokens do not spell blank and text again, have zeros and an empty
    digest; they add no links. Repeated rows count each; null ids stay; an empty table gives no rows. Other
    columns are not read. A text of any length is one text; equal counts are all the most frequent.
    """
    rows = stored(_aligned(id_and_text(docs, id_col, text_col), a_name, b_name), "alignment")
    links = rows.select("batch", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("batch", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    counts = stored(pair_counts(links), "pair-counts")
    answers = (links.join(counts, "pair").groupBy("batch")  # at most the batch's distinct pairs
               .agg(F.collect_list(F.struct("pair", "total", "best")).alias("answers")))
    return _answered(rows.drop("times").join(answers, "batch", "left"))


def pair_table(docs: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model") -> DataFrame:
    """The id map itself: A id, B id, links, best; from a table of texts."""
    found = _aligned(id_and_text(docs), a_name, b_name)
    links = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    return pair_counts(links).select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "total", "best")
