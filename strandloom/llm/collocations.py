"""Phrase collocations by hash-bucket counts and Apriori pruning.

1. Each task cuts its texts into pieces and words and writes them as chunks: the distinct words of
   some megabytes of text, and the texts as numbers of them. Later passes read chunks, not texts.
2. Pass k counts phrases of k words, and meanwhile hashes those of k + 1 words into 2^BUCKET_BITS
   counters. A phrase of k words is counted only if both phrases of k - 1 words in it are frequent
   and its bucket reached the threshold in the pass before. Both are looked up in bitmaps of as many
   bits that are broadcast, one of the frequent phrases and one of the full buckets. Bitmaps let too
   much through, never too little; the exact counts decide.
3. A phrase is counted by its words, not by a hash: within a chunk by their numbers, then by
   language and text. A frequent phrase is one row a chunk.

Counters of buckets travel in 2^SLOT_BITS ranges of buckets; a range is summed as its parts stream by, so
no task holds more than the counters of its ranges.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm import _words
from strandloom.llm._pack import from_gaps, gaps, narrow, pack, unpack
from strandloom.workspace import materialize, shuffle_width

MIN_COUNT, LONGEST, TOP, SHARE = 30, 4, 2000, 80
SCALE = 2_000_000
CHUNK_BYTES = 12_000_000
BUCKET_BITS, SLOT_BITS = 24, 9
ROW = "lang string, phrase string, n long, slot int, blob binary"
#: A-Z become a-z, a tab white space, and what ends a piece the byte 255, which stands in no text.
_END = b"\xff"
_FOLD = bytes(b + 32 if 65 <= b < 91 else 255 if b in b".,;:!?\n\v\f\r" else 32 if b == 9 else b for b in range(256))


class _Numbers(dict):
    """Number of each word, in order of first use; 0 ends a piece."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _strings(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([len(p) for p in parts], np.uint32), np.frombuffer(b"".join(parts), np.uint8)


def _flush(held: dict[bytes, tuple[_Numbers, list[np.ndarray]]]) -> pa.RecordBatch:
    words, owner, seqs = [b""], [0], []
    for i, (numbers, parts) in enumerate(held.values()):
        seq = np.concatenate(parts).astype(np.int64)
        seqs.append(np.where(seq > 0, seq + (len(words) - 1), 0))
        mine = list(numbers)[1:]
        words += mine
        owner += [i] * len(mine)
    blob = pack(narrow(np.concatenate(seqs)), *_strings(words), np.array(owner, np.uint32), *_strings(list(held)))
    return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["blob"])


def _cut(chunk_bytes: int):
    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[_Numbers, list[np.ndarray]]] = {}
        size = 0
        for batch in batches:
            langs, texts = (c.cast(pa.large_binary()) for c in batch.columns)
            for lang, text in zip(langs.to_pylist(), texts):
                raw = text.as_py()
                words = raw.translate(_FOLD).replace(_END, b" \xff ").split() + [_END]
                numbers, parts = held.setdefault(lang, (_Numbers(), []))
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                size += len(raw) + 8
                if size >= chunk_bytes:
                    yield _flush(held)
                    held, size = {}, 0
        if held:
            yield _flush(held)

    return run


def _word_hashes(lengths: np.ndarray, raw: np.ndarray, langs: list[bytes], owner: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word and its language."""
    ends = np.cumsum(lengths, dtype=np.int64)
    seeds = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in langs], np.uint64)
    return _words.mix(_words.span_hash(_words.prefix_hash(raw, fold=False), ends - lengths, ends) ^ seeds[owner])


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _has(bits: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bits[buckets >> 3] >> (buckets & 7).astype(np.uint8)) & 1 == 1


def _counters(buckets: np.ndarray, most: int) -> pa.RecordBatch | None:
    """Rows of how often buckets occur, up to ``most`` each, by slot."""
    if not len(buckets):
        return None
    found, n = np.unique(buckets, return_counts=True)
    width = BUCKET_BITS - SLOT_BITS
    cuts = np.searchsorted(found, np.arange((1 << SLOT_BITS) + 1) << width)
    slots = np.flatnonzero(cuts[1:] > cuts[:-1])
    n = narrow(np.minimum(n, most))
    blobs = [pack(gaps((found[a:b] & ((1 << width) - 1)).astype(np.uint16 if width <= 16 else np.uint32)), n[a:b]) for a, b in zip(cuts[slots], cuts[slots + 1])]
    none = pa.nulls(len(slots), pa.string())
    return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(slots), pa.int64()), pa.array(slots, pa.int32()), pa.array(blobs, pa.binary())], names=["lang", "phrase", "n", "slot", "blob"])


def _texts(lengths: np.ndarray, raw: np.ndarray) -> pa.Array:
    """Strings of a chunk as a large binary array."""
    off = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(raw.tobytes())])


def _pass(k: int, longest: int, least: int, frequent, full):
    """Counts of phrases of ``k`` words in a chunk, and counters of the next length's buckets.

    ``frequent``: bitmap of the frequent phrases one word shorter, ``full``: of the buckets of this length; both broadcast.
    """

    def count(blob: pa.Buffer) -> Iterator[pa.RecordBatch]:
        seq, lengths, raw, owner, lang_lengths, lang_raw = unpack(blob)
        seq = seq.astype(np.int64)
        langs, words = _texts(lang_lengths, lang_raw), _texts(lengths, raw)
        hashes = _word_hashes(lengths, raw, langs.to_pylist(), owner)[seq]
        # alive[i]: the phrase of k words that begins at i may be frequent
        alive = seq > 0
        for _ in range(k - 1):
            alive = alive[:-1] & (seq[len(seq) - len(alive) + 1 :] > 0)
        if k > 1 and len(alive):
            shorter = _has(frequent.value, _buckets(_words.grams(hashes, k - 1)))
            alive &= shorter[:-1] & shorter[1:]
            at = np.flatnonzero(alive)
            alive[at] = _has(full.value, _buckets(_words.grams(hashes, k)[at]))
        at = np.flatnonzero(alive)
        if not len(at):
            return
        code = seq[at]
        for j in range(1, k):
            if j > 1:
                code = np.unique(code, return_inverse=True)[1]
            code = code * len(lengths) + seq[at + j]
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        first = at[first]
        phrase = pc.binary_join_element_wise(*(words.take(pa.array(seq[first + j])) for j in range(k)), pa.scalar(b" ", pa.large_binary())) if k > 1 else words.take(pa.array(seq[first]))
        lang = langs.take(pa.array(owner[seq[first]].astype(np.int64)))
        for i in range(0, len(first), 100_000):
            some = [c.slice(i, 100_000).cast(pa.binary()).cast(pa.string()) for c in (lang, phrase)]
            size = len(some[0])
            yield pa.RecordBatch.from_arrays([*some, pa.array(n[i : i + size], pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names=["lang", "phrase", "n", "slot", "blob"])
        if k < longest:
            after = np.flatnonzero(alive[:-1] & alive[1:])
            rows = _counters(_buckets(_words.grams(hashes, k + 1)[after]), least)
            if rows is not None:
                yield rows

    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                yield from count(blob.as_buffer())

    return run


def _marks(k: int):
    """Counters of the buckets of frequent phrases of ``k`` words."""

    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b" ".join(p.encode() for p in batch.column(1).to_pylist()) + b" ", np.uint8)
            ends = np.flatnonzero(raw == 32)
            lengths = np.diff(ends, prepend=-1) - 1
            keep = raw != 32
            codes = pc.dictionary_encode(batch.column(0))
            owner = np.repeat(codes.indices.to_numpy(), k)
            hashes = _word_hashes(lengths, raw[keep], [x.encode() for x in codes.dictionary.to_pylist()], owner)
            yield _counters(_buckets(_words.grams(hashes, k)[::k]), 1)

    return run


def _full(least: int):
    """Slots as bitmaps of the buckets that reach ``least``; counters are added up as they stream by."""

    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                places, n = unpack(blob.as_buffer())
                total = sums.setdefault(slot, np.zeros(1 << (BUCKET_BITS - SLOT_BITS), np.uint32))
                at = from_gaps(places)
                total[at] = np.minimum(total[at] + n, least)
        bits = [np.packbits(t >= least, bitorder="little").tobytes() for t in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], names=["slot", "bits"])

    return run


def _bitmap(counters: DataFrame, least: int) -> np.ndarray:
    """A bit a bucket; what reaches the driver is one row a slot, 2 MB in all."""
    spark = counters.sparkSession
    rows = counters.repartition(min(1 << SLOT_BITS, shuffle_width(spark)), "slot").mapInArrow(_full(least), "slot int, bits binary")
    bits = np.zeros(1 << (BUCKET_BITS - 3), np.uint8)
    width = len(bits) >> SLOT_BITS
    for slot, found in rows.collect():
        bits[slot * width : (slot + 1) * width] = np.frombuffer(found, np.uint8)
    return bits


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words that occur ``min_count`` times in their language, ``(lang, phrase, k, f)``, and
    ``(lang, n)``, all word occurrences; ``docs`` has the columns lang and text without nulls."""
    spark = docs.sparkSession
    chunks = materialize(docs.select("lang", "text").mapInArrow(_cut(chunk_bytes), "blob binary"), "word_chunks")
    found, frequent, full, words = [], None, None, None
    for k in range(1, longest + 1):
        counted = materialize(chunks.mapInArrow(_pass(k, longest, min_count, frequent, full), ROW), f"phrases_{k}")
        exact = counted.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if k == 1:
            words = counted.where("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n"))
        found.append(materialize(exact.where(F.col("f") >= min_count).select("lang", "phrase", F.lit(k).alias("k"), "f"), f"frequent_{k}"))
        if k < longest:
            full = spark.sparkContext.broadcast(_bitmap(counted.where("slot is not null").select("slot", "blob"), min_count))
            marks = found[-1].select("lang", "phrase").mapInArrow(_marks(k), ROW).select("slot", "blob")
            frequent = spark.sparkContext.broadcast(_bitmap(marks, 1))
    return reduce(DataFrame.unionByName, found), words


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, share: int = SHARE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language by score, a, and text.

    A null text is empty, a null language ``und``; the empty language is one like others. Repeated
    rows count as often as they stand; a very long text is one chunk of one task. A word may be of any length and hold
    any characters but white space. Other columns are ignored; an empty table, or one without frequent phrases, gives no rows.
    """
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counts, words = frequent_phrases(docs, min_count, longest, chunk_bytes)
    phrases = counts.where("k > 1").withColumnRenamed("f", "a")
    cuts = phrases.withColumn("word", F.split("phrase", " ")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    joined = lambda begin, size: F.array_join(F.slice("word", begin, size), " ")
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("head"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    parts = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    cuts = cuts.join(parts, ["lang", "head"]).join(parts.select("lang", F.col("head").alias("tail"), F.col("l").alias("r")), ["lang", "tail"])
    wide = lambda c: c.cast("decimal(20,0)")
    cuts = cuts.withColumn("score", F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(F.col("a")), wide(F.col("l") + F.col("r"))))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("least"))

    # phrases within longer ones: every run of two words or more that is shorter than the whole
    longer = phrases.where("k > 2").withColumn("word", F.split("phrase", " ")).withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    longer = longer.select("lang", joined(F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * wide(F.col("longer")) < share * wide(F.col("a"))))
    kept = kept.select("lang", "phrase", "a", "least.l", "least.r", "least.score")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce("text", ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM places, (SELECT unnest(range(1, {LONGEST} + 1)) AS k) WHERE i + k - 1 <= len(w)
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE k > 1 AND f >= {MIN_COUNT}
), cuts AS (
  SELECT lang, k, phrase, w, a, unnest(range(1, k)) AS cut FROM candidates
), scored AS (
  SELECT c.lang, c.phrase, c.a, cut, h.f AS l, t.f AS r, ({SCALE}::HUGEINT * c.a) // (h.f + t.f) AS score FROM cuts c
  JOIN counts h ON h.lang = c.lang AND h.k = cut AND h.phrase = array_to_string(w[1 : cut], ' ')
  JOIN counts t ON t.lang = c.lang AND t.k = c.k - cut AND t.phrase = array_to_string(w[cut + 1 : c.k], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), sizes AS (
  SELECT lang, k, w, a, unnest(range(2, k)) AS size FROM candidates WHERE k > 2
), starts AS (
  SELECT lang, w, a, size, unnest(range(1, k - size + 2)) AS p FROM sizes
), longer AS (
  SELECT lang, array_to_string(w[p : p + size - 1], ' ') AS phrase, max(a) AS f FROM starts GROUP BY ALL
), ranked AS (
  SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN longer x ON x.lang = b.lang AND x.phrase = b.phrase WHERE x.f IS NULL OR 100::HUGEINT * x.f < {SHARE}::HUGEINT * b.a
)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, t.n::BIGINT AS n, r.score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= {TOP}
"""
