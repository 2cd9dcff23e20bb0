"""Quality rules: gradient-boosted trees over document statistics, flattened into numpy node arrays.

The statistics are counted over whole texts in one narrow pass. The trees are fitted here on a bounded
number of labelled documents (``TRAIN_ROWS``), with constraints that make the chance of good quality
never rise with the share of symbols, of repeated lines or of repeated words. A batch is scored by
moving all its rows down all trees at once through the node arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, id_and_text, map_arrow, texts

TRAIN_ROWS = 6000  # labelled documents the trees are fitted on, chosen by a hash of the id
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share",
            "digit_share", "mark_share", "line_words", "top_word_share")
# -1: the chance of good quality never rises with the feature; 0: free.
MONOTONE = np.array([0, 0, -1, -1, -1, 0, 0, 0, 0, 0, 0], np.int8)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"!\"'()+,-./:;=?@[\\]^_`{}~"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside a window of that many words that stands twice or more in the text."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    code = np.zeros(n, np.uint64)
    for k in range(window):
        code = (code ^ (ids[k:k + n].astype(np.uint64) + np.uint64(1))) * _MIX
        code ^= code >> np.uint64(31)
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    equal = ranked[1:] == ranked[:-1]
    if not equal.any():
        return 0
    twice = np.zeros(n, bool)
    twice[1:] = equal
    twice[:-1] |= equal
    covered = np.zeros(len(ids) + 1, np.int64)
    at = order[twice]
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """:data:`COUNTS` and :data:`FEATURES` of one text."""
    words = text.split()
    n = len(words)
    first: dict[bytes, int] = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, n)
    chars = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, BLANKS)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeated = repeated_words(ids)
    size = max(1, chars)
    upper, digits, marks = (len(text) - len(text.translate(None, x)) for x in (_UPPER, _DIGITS, _MARKS))
    top = int(np.bincount(ids).max()) if n else 0
    return ([n, chars, symbols, dup, repeated],
            [np.log1p(n), chars / max(1, n), symbols / size, dup / max(1, lines), repeated / max(1, n), len(first) / max(1, n),
             upper / size, digits / size, marks / size, n / max(1, lines), top / max(1, n)])


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Fewer than ten words, or over a fifth of the words inside repeated windows."""
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


@dataclass
class Trees:
    """All trees as flat node arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.start)
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.start + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3,
              bins: int = 64, smooth: float = 1.0, least: float = 2.0) -> Trees:
    """Boosted trees on the logistic loss (Newton steps over histograms of quantile bins).

    A split on a constrained feature is taken only if its two values are in the allowed order, and
    the middle of the two bounds all values below it, so the whole tree is monotone.
    """
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    start = float(np.log(share / (1 - share))) if len(y) else 5.0
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if len(y) < 50 or y.min() == y.max():
        return Trees(*(np.empty(0, k) for k in (np.int64, float, np.int64, np.int64, float, np.int64)), 0, max(start, 0.0))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), start)

    def grow(rows: np.ndarray, level: int, low: float, high: float, g: np.ndarray, h: np.ndarray) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        me = len(nodes)
        value = float(np.clip(-gs / (hs + smooth), low, high))
        nodes.append([0, 0.0, me, me, rate * value])
        best = (1e-6, -1, -1, 0.0, 0.0)
        if level < depth and len(rows) >= 2 * least:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))[:-1]
                vl = np.clip(-gl / (hl + smooth), low, high)
                vr = np.clip(-(gs - gl) / (hs - hl + smooth), low, high)
                gain = gl**2 / (hl + smooth) + (gs - gl) ** 2 / (hs - hl + smooth) - gs**2 / (hs + smooth)
                allowed = (hl > 1e-3) & (hs - hl > 1e-3) & ((monotone[f] == 0) | (monotone[f] * (vr - vl) >= 0))
                gain = np.where(allowed, gain, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
        _, f, k, vl, vr = best
        if f >= 0:
            goes = binned[rows, f] <= k
            bound = (vl + vr) / 2
            bounds = ((low, high), (low, high)) if monotone[f] == 0 else ((low, bound), (bound, high)) if monotone[f] > 0 else ((bound, high), (low, bound))
            nodes[me][:2] = [f, float(edges[f][k])]
            nodes[me][2] = grow(rows[goes], level + 1, *bounds[0], g, h)
            nodes[me][3] = grow(rows[~goes], level + 1, *bounds[1], g, h)
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), 0, -4.0, 4.0, p - y, np.maximum(p * (1 - p), 1e-6)))
        tree = _flat(nodes, [first], depth, 0.0)
        margin = margin + tree.margin(x)
    return _flat(nodes, roots, depth, start)


def _flat(nodes: list[list[float]], roots: list[int], depth: int, start: float) -> Trees:
    table = np.array(nodes, float)
    return Trees(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4],
                 np.array(roots, np.int64), depth, start)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most ``rows`` labelled ids, chosen by a hash of the id; without labels every margin is good.

    An id with several texts gives them all, but of ids that repeat so often that there are more than
    2 * ``rows`` texts, those of the highest ids are left out: the fit never takes more than that.
    """
    wanted = (labels.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{target}`").cast("int").alias("y"))
              .filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
              .orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows))
    texts_of = id_and_text(docs, id_col, text_col).join(F.broadcast(wanted), "doc_id")  # at most ``rows`` small rows

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        return {"doc_id": batch.column(0), "y": batch.column(2), "x": [statistics(t)[1] for t in texts(batch.column(1))]}

    sample = map_arrow(texts_of, step, "doc_id bigint, y int, x array<double>").orderBy("doc_id").limit(2 * rows).toPandas()
    x = np.array(sample["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit_trees(x, (sample["y"].to_numpy() > 0).astype(float), MONOTONE)


SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, quality double, kept boolean"


def _judge(trees: Trees, threshold: float, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = [statistics(t) for t in rows]
    counts = np.array([c for c, _ in both], np.int64).reshape(-1, len(COUNTS))
    score = trees.probability(np.array([x for _, x in both], float).reshape(-1, len(FEATURES)))
    return counts, score, ~base_failed(counts) & (score >= threshold)


def judge(docs: DataFrame, trees: Trees, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: the counts, the base rule, the trees' chance of good quality, the verdict.

    Null or empty texts have zero counts and fail the base rule; null ids stay, repeated rows repeat,
    an empty table gives an empty result; other columns are not read.
    """

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        counts, score, kept = _judge(trees, threshold, texts(batch.column(1)))
        return {"doc_id": batch.column(0), **{c: counts[:, i] for i, c in enumerate(COUNTS)},
                "base_failed": base_failed(counts), "quality": score, "kept": kept}

    return map_arrow(id_and_text(docs, id_col, text_col), step, SCHEMA)


def keep_good(docs: DataFrame, trees: Trees, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The document rows that :func:`judge` keeps, with all their columns."""
    return filter_rows(docs, _keeper(trees, threshold, docs.columns.index(text_col)))


def _keeper(trees: Trees, threshold: float, place: int) -> Callable[[pa.RecordBatch], np.ndarray]:
    return lambda batch: _judge(trees, threshold, texts(batch.column(place)))[2]

