"""Phrase collocation mining: Misra-Gries summaries per hash partition, then an exact count of what survives.

Two scans find the n-grams that may be frequent, words and pairs first, then triples and quadruples whose
pairs all survived. A task cuts its n-gram hashes into hash partitions; each partition's summaries are
merged one after the other in bounded room. The survivors of all partitions become one bit field of a
fixed largest size. The last scan counts the n-grams in it exactly, by their words; the rest are joins
and aggregates over the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.sources.folders import stored

from .common import LOWER, map_partition, ship, texts
from .frequent import MisraGries, counted

THRESHOLD = 30  # occurrences of a candidate
LONGEST = 4  # words of a candidate
TOP = 2000  # phrases reported per language
COVERED = 80  # per cent of its occurrences inside one longer phrase that make a phrase redundant
CAPACITY = 1 << 19  # counters of one hash partition's summary
CHUNK_BYTES = 2 << 20  # text counted at a time in a task: its words and hashes take some 60 MB
MOST_BITS = 30  # the bit field of survivors never passes 2^30 bits (128 MB)

_END = 0xFF  # no byte of UTF-8
_ENDS = set(b".,;:!?\n\x0b\x0c\r")
_TABLE = bytes(_END if b in _ENDS else 32 if b == 9 else LOWER[b] for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Words of some text of one language: ``ids`` into ``vocabulary``; pieces are kept apart by an end mark."""

    def __init__(self, lang: str, blobs: list[bytes]):
        self.lang = lang
        self.tokens = (b"\xff".join(blobs).translate(_TABLE).replace(b"\xff", b" \xff ")).split()
        self.vocabulary = list(dict.fromkeys([b"\xff", *self.tokens]))
        index = {w: i for i, w in enumerate(self.vocabulary)}
        self.ids = np.fromiter(map(index.__getitem__, self.tokens), np.int64, len(self.tokens))
        self.words = int(np.count_nonzero(self.ids))

    def hashes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For n = 1, 2, ...: a hash at every place an n-gram may start, and whether it lies in one piece."""
        seed = xxhash.xxh3_64_intdigest(self.lang.encode("utf-8", "surrogatepass"))
        word = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.vocabulary), np.uint64, len(self.vocabulary))[self.ids]
        whole, inside = word, self.ids != 0
        yield whole, inside
        for n in range(2, LONGEST + 1):
            if len(word) < n:
                return
            whole = _mix(whole[:-1] * _STEP + word[n - 1:])
            inside = inside[:-1] & (self.ids[n - 1:] != 0)
            yield whole, inside


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Texts of a task by language, about ``CHUNK_BYTES`` at a time; a longer text is cut between pieces."""
    waiting: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch.column("text"))):
            for part in _sections(text):
                waiting.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part)
                if size[lang] >= CHUNK_BYTES:
                    yield Chunk(lang, waiting.pop(lang))
                    size[lang] = 0
    for lang in sorted(waiting):
        yield Chunk(lang, waiting[lang])


def _sections(text: bytes) -> Iterator[bytes]:
    """The text, in parts of more than ``CHUNK_BYTES`` that end with a piece."""
    start = 0
    while len(text) - start > CHUNK_BYTES:
        rest = text[start + CHUNK_BYTES:]
        at = len(rest) - len(rest.translate(_TABLE).partition(b"\xff")[2])
        yield text[start:start + CHUNK_BYTES + at]
        start += CHUNK_BYTES + at
    yield text[start:]


class BitField:
    """Which hashes may be among the survivors: one bit per value of the upper ``bits`` bits."""

    def __init__(self, bits: int, field: np.ndarray | None = None):
        self.bits = bits
        self.field = np.zeros(1 << (bits - 3), np.uint8) if field is None else field

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.field[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def summaries(docs: DataFrame, lengths: tuple[int, ...], parts: int, known: BitField | None) -> DataFrame:
    """(part, keys, counts): per chunk and hash partition, the n-grams of these lengths and their capped counts.

    With ``known`` only n-grams whose word pairs all are in that field are taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known.field) if known else None
    bits = known.bits if known else 0
    shift = np.uint64(64 - (parts.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        field = BitField(bits, shared.value) if shared else None
        for chunk in chunks(batches):
            found, pair = [], None
            for n, (hashes, inside) in enumerate(chunk.hashes(), 1):
                if field and n == 2:
                    pair = field.has(hashes)
                if n in lengths:
                    if field:
                        inside = inside.copy()
                        for k in range(n - 1):
                            inside &= pair[k:k + len(inside)]
                    found.append(hashes[inside])
            keys, counts = counted(np.concatenate(found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            small = np.minimum(counts, THRESHOLD).astype(np.uint8)
            cuts = np.searchsorted(keys >> shift, np.arange(parts + 1, dtype=np.uint64)) if parts > 1 else np.array([0, len(keys)])
            held = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            yield {"part": held, "keys": [keys[cuts[p]:cuts[p + 1]].tobytes() for p in held],
                   "counts": [small[cuts[p]:cuts[p + 1]].tobytes() for p in held]}

    return map_partition(docs, run, "part int, keys binary, counts binary")


def survivors(found: DataFrame, parts: int, bits: int, capacity: int = CAPACITY) -> BitField:
    """Merge each partition's summaries; the bits of its survivors are that partition's stretch of the field.

    Only the field itself reaches the driver: 2^``bits`` bits, whatever the number of survivors.
    """
    stretch = 1 << (bits - 3 - (parts.bit_length() - 1))  # bytes

    def close(part: int, summary: MisraGries) -> tuple[int, bytes]:
        at = (summary.survivors() >> np.uint64(64 - bits)).astype(np.int64) - part * stretch * 8
        marks = np.zeros(stretch * 8, np.uint8)
        marks[at] = 1
        return part, np.packbits(marks, bitorder="little").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        part, summary = -1, None
        for batch in batches:  # rows of one partition follow each other
            for p, keys, counts in zip(*(batch.column(k).to_pylist() for k in ("part", "keys", "counts"))):
                if p != part:
                    if summary:
                        done = close(part, summary)
                        yield {"part": [done[0]], "field": [done[1]]}
                    part, summary = p, MisraGries(capacity, THRESHOLD)
                summary.add(np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint8).astype(np.int64))
        if summary:
            done = close(part, summary)
            yield {"part": [done[0]], "field": [done[1]]}

    dealt = found.repartition(parts, "part").sortWithinPartitions("part")
    out = BitField(bits)
    for row in map_partition(dealt, run, "part int, field binary").collect():
        out.field[row.part * stretch:(row.part + 1) * stretch] = np.frombuffer(row.field, np.uint8)
    return out


def phrase_counts(docs: DataFrame, field: BitField) -> DataFrame:
    """(lang, phrase, words, a): exact counts of the n-grams in the field; phrase '' counts all words."""
    shared, bits = docs.sparkSession.sparkContext.broadcast(field.field), field.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        known = BitField(bits, shared.value)
        for chunk in chunks(batches):
            tokens, size = chunk.tokens, len(chunk.vocabulary)
            phrases, counts, lengths = [b""], [chunk.words], [0]
            place = codes = None
            for n, (hashes, inside) in enumerate(chunk.hashes(), 1):
                kept = inside & known.has(hashes)
                if n == 1:
                    place = np.flatnonzero(kept)
                    keys = chunk.ids[place]
                else:  # a frequent phrase begins with a frequent phrase, whose code is exact
                    going = place < len(kept)
                    going[going] = kept[place[going]]
                    place, codes = place[going], codes[going]
                    keys = codes * size + chunk.ids[place + n - 1]
                _, first, codes, times = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
                phrases += [b" ".join(tokens[p:p + n]) for p in place[first].tolist()]
                counts += times.tolist()
                lengths += [n] * len(times)
            yield {"lang": [chunk.lang] * len(phrases), "phrase": phrases, "words": lengths, "a": counts}

    found = map_partition(docs, run, "lang string, phrase binary, words int, a bigint")
    found = found.select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "a")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where((F.col("a") >= THRESHOLD) | (F.col("words") == 0))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", capacity: int = CAPACITY) -> DataFrame:
    """All phrases of one to ``LONGEST`` words that come ``THRESHOLD`` times or more in a language, with exact counts."""
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ship(spark)
    mass = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # more bytes than words and pairs
    parts = 1
    while parts < 2 * mass / (THRESHOLD * capacity) or parts < min(16, mass >> 16):
        parts *= 2
    bits = min(MOST_BITS, max(12, (mass // THRESHOLD).bit_length() + 4, parts.bit_length() + 3))
    short = survivors(summaries(base, (1, 2), parts, None), parts, bits, capacity)
    long = survivors(summaries(base, tuple(range(3, LONGEST + 1)), parts, short), parts, bits, capacity)
    return phrase_counts(base, BitField(bits, short.field | long.field))


def collocations(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The best phrases of two words or more per language, from a table of frequent phrases.

    A phrase's score is that of its worst cut (the first of equal ones); a phrase is left out if one longer
    phrase holds ``COVERED`` per cent of it.
    """
    totals = phrases.where("words = 0").select("lang", F.col("a").alias("n"))
    parts = phrases.where("words > 0").select("lang", F.col("phrase").alias("part"), F.col("a").alias("times"))
    cuts = (phrases.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
            .withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
            .withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)")))
    left, right = parts.toDF("lang", "first", "l"), parts.toDF("lang", "rest", "r")
    product = F.lit(2_000_000).cast("decimal(20,0)") * F.col("a")
    scored = (cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("product", product)
              .withColumn("score", F.expr("product div (l + r)"))
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    words = F.split("phrase", " ")
    inner = F.expr("flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), s -> array_join(slice(w, s, n), ' '))))")
    longer = (phrases.where("words > 2").withColumn("w", words).select("lang", "a", F.explode(inner).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * longer < {COVERED} * a"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = (kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
              .withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", capacity: int = CAPACITY) -> DataFrame:
    """Collocations of a table of texts; counts are exact and cover every text.

    A null text is empty and a null language counts as ``und``. Repeated rows count each; an empty table
    gives no rows. Other columns are not read, so none can clash. A phrase never crosses a mark, a line or
    a text. Ties are settled by the count and then by the phrase.
    """
    return collocations(stored(frequent_phrases(docs, text_col, lang_col, capacity), "phrases"))


def sql() -> str:
    """The same rows, counted with joins over all n-grams."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = " UNION ALL ".join(
        f"SELECT lang, {n} AS words, array_to_string(w[i:i + {n - 1}], ' ') AS phrase "
        f"FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM pieces WHERE len(w) >= {n})" for n in range(1, LONGEST + 1))
    return f"""
    WITH cut AS (SELECT coalesce(lang, 'und') AS lang,
                        unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM cut),
    grams AS ({grams}),
    totals AS (SELECT lang, count(*) AS n FROM grams WHERE words = 1 GROUP BY lang),
    f AS (SELECT lang, words, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM grams GROUP BY ALL HAVING count(*) >= {THRESHOLD}),
    cuts AS (SELECT lang, words, phrase, a, w, unnest(range(1, words)) AS k FROM f WHERE words > 1),
    scored AS (SELECT c.lang, c.words, c.phrase, c.a, c.k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
               FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
               JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
    worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_phrases AS (SELECT lang, a, w, words, n, unnest(range(1, words - n + 2)) AS s
                      FROM (SELECT lang, a, w, words, unnest(range(2, words)) AS n FROM f WHERE words > 2)),
    longer AS (SELECT lang, array_to_string(w[s:s + n - 1], ' ') AS phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL),
    kept AS (SELECT worst.* FROM worst LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {COVERED} * a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
    """
