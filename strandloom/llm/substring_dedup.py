"""Repeated passages: longest-previous-factor arrays over the passages that texts share.

A byte goes if it lies in a string of ``length`` bytes that also starts in a text with a smaller
key. Whether one does is read off suffix arrays: of the suffixes in order (ties by key), the
previous and the next one with a smaller key give the longest earlier match.

The suffix array of a whole corpus fits no task, so suffixes are first dealt to where their matches
must be. Each window of ``length`` bytes has an anchor: its gram of GRAM bytes with the least hash.
Equal windows have equal anchors at equal places, and neighbouring windows mostly share one.

Grams of a repeated pattern (rules of blanks, dashes and the like) are anchors only of windows that
hold nothing else, so that what stands beside a rule is not dealt to one bucket.

1. Texts are dealt to chunks of about CHUNK_BYTES by key, however wide the shuffle. A chunk sends its distinct anchors' hashes to hash buckets and
   hears which of them other texts hold too.
2. For those, it sends the run of windows of each anchor as one string, equal strings once with
   their smallest key. The bucket builds the suffix array of its strings, takes the previous
   factors and answers one bit a window.
3. The chunk joins covered windows to spans and cuts them out.

So a passage that a third of all texts hold costs one string a chunk. The exchange of texts is one
for all three steps. Anchors are found by 48-bit hashes, which only decide what is compared.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import _words
from strandloom.llm._pack import from_gaps, gaps, pack, unpack
from strandloom.workspace import shuffle_width

LENGTH, GRAM = 50, 16
PIECE = 64 << 20
CHUNK_BYTES = 8 << 20
#: a bucket is worked off in so many parts of its hash range
PARTS = 32
ROW = "bucket int, chunk int, kind string, blob binary"
NO_KEY = np.iinfo(np.int64).max


def _rows(rows: list[tuple]) -> pa.Table:
    b, c, k, v = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"bucket": pa.array(b, pa.int32()), "chunk": pa.array(c, pa.int32()), "kind": pa.array(k, pa.string()), "blob": pa.array(v, pa.binary())})


def words8(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one big-endian number (zeros past the end)."""
    b = np.concatenate((buf, np.zeros(8, np.uint8)))
    w = b[:-1].astype(np.uint16) << 8 | b[1:]
    w = w[:-2].astype(np.uint32) << 16 | w[2:]
    return (w[:-4].astype(np.uint64) << np.uint64(32) | w[4:])[: len(buf)]


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """min(a[i : i + width]) for each i."""
    done = 1
    while 2 * done <= width:
        a = np.minimum(a[:-done], a[done:])
        done *= 2
    return np.minimum(a[: len(a) - (width - done)], a[width - done :]) if done < width else a


def anchor_runs(buf: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window start, number of windows, 48-bit anchor hash."""
    none = np.empty(0, np.int64)
    n = len(buf) - length + 1
    if n <= 0:
        return none, none, np.empty(0, np.uint64)
    w = words8(buf)
    h = _words.mix(w[: len(buf) - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15) ^ _words.mix(w[8 : len(buf) - GRAM + 9] + np.uint64(1)))
    # a gram whose halves are equal has a period of 8 bytes or less: it comes last
    h[w[: len(h)] == w[8 : len(h) + 8]] |= np.uint64(0xFFFFFF << 40)
    low = np.uint64((1 << 27) - 1)
    # place in the low bits: of equal hashes the leftmost is the least
    place = np.arange(len(h), dtype=np.uint64) & low
    anchor = sliding_min(h & ~low | place, length - GRAM + 1) & low
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    whole = text[:n] == text[length - 1 :]
    head = np.flatnonzero(whole & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~whole[:-1] | (text[1:n] != text[: n - 1]))))
    last = np.flatnonzero(whole & np.concatenate(((anchor[1:] != anchor[:-1]) | ~whole[1:] | (text[1:n] != text[: n - 1]), [True])))
    # least hashes crowd near zero; mixed again they spread evenly over buckets
    return head, last - head + 1, _words.mix(h[anchor[head].astype(np.int64)]) >> np.uint64(16)


def _home(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class _Chunk:
    """Texts of a chunk in key order, in slices that bound the working arrays."""

    def __init__(self, table: pa.Table):
        keys = table["doc_id"].fill_null(NO_KEY).to_numpy()
        order = np.argsort(keys, kind="stable")
        table = table.take(pa.array(order))
        self.keys, self.nulls = keys[order], table["doc_id"].is_null()
        self.buf, self.off = _words.utf8(table["text"])
        start, count, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for i, j in _words.slices(self.off):
            # a very long text is cut where windows start
            for p in range(self.off[i], self.off[j], PIECE):
                q = min(int(self.off[j]), p + PIECE + LENGTH - 1)
                s, c, h = anchor_runs(self.buf[p:q], np.clip(self.off[i : j + 1], p, q) - p)
                start.append(s + p), count.append(c), hashes.append(h)
        self.start, self.count, self.hash = map(np.concatenate, (start, count, hashes))
        self.text = np.searchsorted(self.off, self.start, "right") - 1

    def anchors(self, buckets: int):
        uniq, inv = np.unique(self.hash, return_inverse=True)
        first, last = np.full(len(uniq), NO_KEY), np.full(len(uniq), -1)
        np.minimum.at(first, inv, self.text)
        np.maximum.at(last, inv, self.text)
        return uniq, inv, first != last, np.searchsorted(_home(uniq, buckets), np.arange(buckets + 1))

    def shared(self, answers: dict[int, bytes], buckets: int):
        """Runs whose anchor other texts hold too, ordered by hash, with the number of each distinct string."""
        uniq, inv, _, cuts = self.anchors(buckets)
        held = np.zeros(len(uniq), bool)
        for b, bits in answers.items():
            held[cuts[b] : cuts[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=cuts[b + 1] - cuts[b])
        run = np.flatnonzero(held[inv])
        c = _words.prefix_hash(self.buf, fold=False)
        same = _words.span_hash(c, self.start[run], self.start[run] + self.count[run] + (LENGTH - 1))
        order = np.lexsort((self.text[run], same, self.hash[run]))
        run, same = run[order], same[order]
        head = np.concatenate(([True], (same[1:] != same[:-1]) | (self.hash[run][1:] != self.hash[run][:-1]))) if len(run) else np.empty(0, bool)
        return run, head


def _ask_anchors(buckets: int):
    @_words.lean
    def run(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table)
        uniq, _, several, cuts = chunk.anchors(buckets)
        c = table["chunk"][0].as_py()
        return _rows([(b, c, "anchors", pack(gaps(uniq[x:y]), np.packbits(several[x:y]))) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if x < y])

    return run


@_words.lean
def _tell_shared(table: pa.Table) -> pa.Table:
    b = table["bucket"][0].as_py()
    chunks = table["chunk"].to_pylist()
    hashes, several = [], []
    for v in table["blob"]:
        g, bits = unpack(v.as_buffer())
        hashes.append(from_gaps(g))
        several.append(np.unpackbits(bits, count=len(g)).astype(bool))
    uniq, inv, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    held = n > 1
    held[inv[np.concatenate(several)]] = True
    cuts = np.cumsum([0, *map(len, hashes)])
    return _rows([(b, c, "shared", np.packbits(held[inv[x:y]]).tobytes()) for c, x, y in zip(chunks, cuts[:-1], cuts[1:])])


def _answers(table: pa.Table, kind: str) -> dict[int, bytes]:
    return {b: v for b, k, v in zip(table["bucket"].to_pylist(), table["kind"].to_pylist(), table["blob"].to_pylist()) if k == kind}


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] of them, then the same for the others."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


def _ask_strings(buckets: int):
    @_words.lean
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _rows([])
        chunk = _Chunk(texts)
        runs, head = chunk.shared(_answers(told, "shared"), buckets)
        first = runs[head]
        cuts = np.searchsorted(_home(chunk.hash[first], buckets), np.arange(buckets + 1))
        out = []
        for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            if x < y:
                r = first[x:y]
                part = np.bincount(_home(chunk.hash[r], buckets * PARTS) - b * PARTS, minlength=PARTS).astype(np.uint32)
                out.append((b, texts["chunk"][0].as_py(), "strings", pack(part, chunk.keys[chunk.text[r]], chunk.count[r].astype(np.uint8), chunk.buf[spread(chunk.start[r], chunk.count[r] + LENGTH - 1)])))
        return _rows(out)

    return run


def suffix_order(buf: np.ndarray, at: np.ndarray, length: int, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start at ``at``, ordered by their first ``length`` (16 to 64) bytes and then by ``tie``; and,
    for each in that order, whether it shares those bytes with the one before.

    Prefix doubling: ranks of 8 bytes give ranks of 16, then 32, then of ``length``.
    """
    rank, depth = words8(buf), 8
    _, rank = np.unique(rank, return_inverse=True)
    rank = rank.astype(np.int64)
    while depth < length:
        step = min(depth, length - depth)
        ahead = np.concatenate((rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)))[: len(rank)]
        depth += step
        key = rank << 32 | ahead
        if depth < length:
            _, rank = np.unique(key, return_inverse=True)
    key = key[at]
    order = np.lexsort((tie, key))
    key = key[order]
    return order, np.concatenate(([False], key[1:] == key[:-1])) if len(key) else np.empty(0, bool)


def previous_smaller(values: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier place with a smaller value that is reached by ``same`` links, or -1."""
    j = np.where(same, np.arange(len(values)) - 1, -1)
    todo = np.flatnonzero(j >= 0)
    todo = todo[values[j[todo]] >= values[todo]]
    while len(todo):
        j[todo] = j[j[todo]]
        todo = todo[j[todo] >= 0]
        todo = todo[values[j[todo]] >= values[todo]]
    return j


def has_previous_factor(order: np.ndarray, same: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Per suffix (in the order of ``keys``): does a suffix with a smaller key share its first bytes?

    ``same`` says where the longest common prefix with the one before reaches the length asked for,
    so the longest previous factor reaches it if a previous or a next smaller key is so linked.
    """
    k = keys[order]
    back = previous_smaller(k, same) >= 0
    forth = previous_smaller(k[::-1], np.concatenate((same[1:], [False]))[::-1])[::-1] >= 0 if len(k) else back
    out = np.empty(len(order), bool)
    out[order] = back | forth
    return out


@_words.lean
def _tell_covered(table: pa.Table) -> pa.Table:
    b, chunks = table["bucket"][0].as_py(), table["chunk"].to_pylist()
    held = [unpack(v.as_buffer()) for v in table["blob"]]
    ends = [np.concatenate(([0], np.cumsum(count.astype(np.int64) + LENGTH - 1))) for _, _, count, _ in held]
    cuts = [np.concatenate(([0], np.cumsum(part, dtype=np.int64))) for part, _, _, _ in held]
    bits: list[list[np.ndarray]] = [[] for _ in held]
    for p in range(PARTS):
        # windows of different anchors never match, so each part has a suffix array of its own
        of = [slice(c[p], c[p + 1]) for c in cuts]
        key = np.concatenate([h[1][o] for h, o in zip(held, of)])
        count = np.concatenate([h[2][o] for h, o in zip(held, of)]).astype(np.int64)
        buf = np.concatenate([h[3][e[o.start] : e[o.stop]] for h, e, o in zip(held, ends, of)])
        size = count + LENGTH - 1
        owner = np.repeat(key, count)
        order, same = suffix_order(buf, spread(np.cumsum(size) - size, count), LENGTH, owner)
        covered = has_previous_factor(order, same, owner)
        n = np.cumsum([0, *(int(h[2][o].sum(dtype=np.int64)) for h, o in zip(held, of))])
        for out, x, y in zip(bits, n[:-1], n[1:]):
            out.append(covered[x:y])
    return _rows([(b, c, "covered", np.packbits(np.concatenate(x)).tobytes()) for c, x in zip(chunks, bits)])


def _cut(buckets: int):
    @_words.lean
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "starts": pa.array([], pa.list_(pa.int64())), "ends": pa.array([], pa.list_(pa.int64())), "kept": pa.array([], pa.binary())})
        chunk = _Chunk(texts)
        runs, head = chunk.shared(_answers(told, "shared"), buckets)
        answers = _answers(told, "covered")
        first = runs[head]
        cuts = np.searchsorted(_home(chunk.hash[first], buckets), np.arange(buckets + 1))
        sizes = chunk.count[first]
        bits = [np.empty(0, bool)]
        for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            if x < y:
                bits.append(np.unpackbits(np.frombuffer(answers[b], np.uint8), count=int(sizes[x:y].sum())).astype(bool))
        bits = np.concatenate(bits)
        which = np.cumsum(head) - 1
        begin = np.cumsum(sizes) - sizes
        # the text with the smallest key has the bucket's answer; texts after it in the chunk are covered by it
        windows = spread(chunk.start[runs], chunk.count[runs])
        from_first = bits[spread(begin[which], chunk.count[runs])] if len(runs) else bits
        least = chunk.keys[chunk.text[first]][which] if len(runs) else np.empty(0, np.int64)
        later = np.repeat(chunk.keys[chunk.text[runs]] > least, chunk.count[runs])
        hit = windows[from_first | later]
        edge = np.zeros(len(chunk.buf) + 1, np.int32)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + LENGTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        starts, ends, kept = [], [], []
        for a, z in zip(chunk.off[:-1].tolist(), chunk.off[1:].tolist()):
            g = np.diff(gone[a:z].astype(np.int8), prepend=0, append=0)
            starts.append(np.flatnonzero(g == 1).tolist()), ends.append(np.flatnonzero(g == -1).tolist())
            kept.append(chunk.buf[a:z][~gone[a:z]].tobytes())
        spans = pa.list_(pa.int64())
        return pa.table({
            "doc_id": pa.array(chunk.keys, mask=np.asarray(chunk.nulls.to_numpy(zero_copy_only=False) if isinstance(chunk.nulls, pa.Array) else chunk.nulls.combine_chunks().to_numpy(zero_copy_only=False), bool)),
            "n_bytes": pa.array(np.diff(chunk.off)), "starts": pa.array(starts, spans), "ends": pa.array(ends, spans), "kept": pa.array(kept, pa.binary()),
        })

    return run


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(doc_id, n_bytes, starts, ends, kept)``, one row per input row: the removed byte spans and the bytes left.

    A null or empty text has no bytes. A row with a null key comes after all others; rows with one
    key (null too) do not cover each other. Other columns are ignored; an empty table gives an
    empty result. ``kept`` may cut a character in two.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    buckets = max(16, width)
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    texts = (
        docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        .withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))
        .repartition(width, "chunk")
    )
    told = texts.groupBy("chunk").applyInArrow(_ask_anchors(buckets), ROW).groupBy("bucket").applyInArrow(_tell_shared, ROW).repartition(width, "chunk")
    asked = texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_ask_strings(buckets), ROW)
    covered = asked.groupBy("bucket").applyInArrow(_tell_covered, ROW)
    answers = told.unionByName(covered.repartition(width, "chunk")).repartition(width, "chunk")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cut(buckets), "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda t, x: t + x)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
