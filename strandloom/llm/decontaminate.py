"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are pairs of words that stand next to each other or with one word between, in the item and in
the text. An alignment of M matches and E edits that reaches a share s of an exact copy of an item of L
words has E <= 2M - 2sL. Of its M - 1 pairs of consecutive matches those with two edits or more in between
number E / 2 at most, so at least sL - 1 have one edit or none: they are seeds, whatever the edits. One
of them is enough to find the copy, so each item leaves out its most frequent ceil(sL - 1) - 1 seeds,
counted over all texts in a scan of their own, and is found by the rare ones that remain.

Benchmark items are taken in blocks of bounded size; each block's seeds are broadcast. One scan finds
seeds in whole texts; around every cluster of seeds of an item a window of words, long enough for
any accepted copy, is aligned with the item. The normalised score is the alignment's share of that of an
exact copy, so that copies with replaced, added or dropped words score in proportion. It cannot exceed
the share of the item's words that the text, or the window, holds at all: common phrases are dropped
by that bound before any alignment.

Texts are never shuffled; per text only its own hits are held.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import _words

BLOCK_BYTES = 8 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
FILTER_BITS = 20


@dataclass(frozen=True)
class Block:
    """Items of a block: word hashes, and for each distinct seed hash its places in items."""

    ids: np.ndarray
    words: list[np.ndarray]
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray

    def bitmap(self) -> np.ndarray:
        out = np.zeros(1 << FILTER_BITS, bool)
        out[self.grams >> np.uint64(64 - FILTER_BITS)] = True
        return out

    def rare(self, counts: np.ndarray, least: float) -> "Block":
        """The block without each item's most frequent seeds, as many as any accepted copy can spare."""
        entry = np.repeat(np.arange(len(self.grams)), np.diff(self.first))
        order = np.lexsort((self.place, -counts[entry], self.item))
        item = self.item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        spare = np.array([max(0, math.ceil(least * len(w) - 1) - 1) for w in self.words], np.int64)
        kept = np.sort(order[rank >= spare[item]])
        seeds, first = np.unique(entry[kept], return_index=True)
        return Block(self.ids, self.words, self.grams[seeds], np.append(first, len(kept)), self.item[kept], self.place[kept])


def seeds_of(h: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Distance, and the hash of the pair that begins at each place, for the distances of seeds; 0: the word alone."""
    two = lambda d: _words.mix(h[:-d] * _words._GRAM[0] + h[d:] * _words._GRAM[1] + np.uint64(2)) if len(h) > d else np.empty(0, np.uint64)
    return [(0, _words.grams(h, 1)), (1, two(1)), (2, two(2))]


def index_block(ids: np.ndarray, texts: pa.Array) -> Block:
    """Items with at least one word and all their seeds; an item of one word has that word as seed."""
    buf, off = _words.utf8(texts)
    h, _, _, first = _words.words(buf, off)
    words, keep, item, place, gram = [], [], [], [], []
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if a == b:
            continue
        w = h[a:b]
        for _, g in seeds_of(w)[1:] if b - a > 1 else seeds_of(w)[:1]:
            item.append(np.full(len(g), len(words))), place.append(np.arange(len(g))), gram.append(g)
        words.append(w), keep.append(i)
    cat = lambda v, t: np.concatenate(v) if v else np.empty(0, t)
    gram, item, place = cat(gram, np.uint64), cat(item, np.int64), cat(place, np.int64)
    order = np.argsort(gram, kind="stable")
    uniq, start = np.unique(gram[order], return_index=True)
    return Block(ids[keep], words, uniq, np.append(start, len(order)), item[order], place[order])


def lookup(h: np.ndarray, block: Block, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``h`` that hold one of the block's grams, and which."""
    at = np.flatnonzero(bitmap[h >> np.uint64(64 - FILTER_BITS)])
    i = np.searchsorted(block.grams, h[at])
    hit = i < len(block.grams)
    hit[hit] = block.grams[i[hit]] == h[at[hit]]
    return at[hit], i[hit]


def _hits(batches: Iterator[pa.RecordBatch], block: Block, text: int = 1):
    """(batch row, word hashes, starts, ends, hit words, hit seeds) of each text with a hit."""
    bitmap = block.bitmap()
    alone = any(len(w) == 1 for w in block.words)
    for batch in batches:
        buf, off = _words.utf8(batch.column(text))
        for i, j in _words.slices(off):
            h, start, end, first = _words.words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            doc = np.repeat(np.arange(j - i), np.diff(first))
            at, gram = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for d, seeds in seeds_of(h)[not alone :]:
                a, g = lookup(seeds, block, bitmap)
                inside = doc[a] == doc[a + d]
                at.append(a[inside]), gram.append(g[inside])
            at, gram = np.concatenate(at), np.concatenate(gram)
            order = np.argsort(at, kind="stable")
            at, gram = at[order], gram[order]
            cuts = np.searchsorted(at, first)
            for d in np.flatnonzero(np.diff(cuts)).tolist():
                x, y, a, b = cuts[d], cuts[d + 1], first[d], first[d + 1]
                yield batch, i + d, h[a:b], start[a:b] - (off[i + d] - off[i]), end[a:b] - (off[i + d] - off[i]), at[x:y] - a, gram[x:y]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, and the words [start, end) of ``b`` it covers."""
    score, end = _best_end(a, b)
    if not score:
        return 0, 0, 0
    back, rev = _best_end(a[::-1], b[:end][::-1])
    return score, end - rev, end


def _best_end(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Score of the best local alignment and where it first ends in ``b`` (exclusive)."""
    ramp = np.arange(len(b) + 1) * -GAP
    h = np.zeros(len(b) + 1, np.int64)
    top, at = 0, 0
    for w in a:
        d = np.maximum(h + GAP, 0)
        np.maximum(d[1:], h[:-1] + np.where(b == w, MATCH, MISMATCH), out=d[1:])
        h = np.maximum.accumulate(d + ramp) - ramp
        k = int(h.argmax())
        if h[k] > top:
            top, at = int(h[k]), k
    return top, at


def held(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which of ``words`` occur in the sorted ``text``."""
    return text[np.minimum(np.searchsorted(text, words), len(text) - 1)] == words


def _copies(batches: Iterator[pa.RecordBatch], block: Block, least: float, text: int = 1):
    """(batch, row, {item: (score, start byte, end byte)}) of each text with a copy."""
    sizes = np.array([len(w) for w in block.words])
    flat, begin = np.concatenate(block.words), np.cumsum(sizes) - sizes
    for batch, row, h, start, end, at, gram in _hits(batches, block, text):
        size = block.first[gram + 1] - block.first[gram]
        ends = np.cumsum(size)
        entry = np.repeat(block.first[gram] - (ends - size), size) + np.arange(int(ends[-1]))
        item, place, pos = block.item[entry], block.place[entry], np.repeat(at, size)
        # no alignment scores more than the item's words that the text holds
        mine, which = np.unique(item, return_inverse=True)
        start_of = np.cumsum(sizes[mine]) - sizes[mine]
        word = np.repeat(begin[mine] - start_of, sizes[mine]) + np.arange(int(sizes[mine].sum()))
        on = (np.add.reduceat(held(flat[word], np.sort(h)), start_of, dtype=np.int64) / sizes[mine] >= least)[which]
        if not on.any():
            continue
        item, place, pos = item[on], place[on], pos[on]
        order = np.lexsort((pos, item))
        item, place, pos = item[order], place[order], pos[order]
        length = sizes[item]
        cut = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (pos[1:] - pos[:-1] > length[1:]), [True])))
        best: dict[int, tuple] = {}
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
            i, words = int(item[x]), block.words[int(item[x])]
            # an accepted alignment has at most as many edits as the item has words
            slack = len(words) + 4
            lo = max(0, int((pos[x:y] - place[x:y]).min()) - slack)
            hi = min(len(h), int((pos[x:y] - place[x:y]).max()) + len(words) + slack)
            if held(words, np.sort(h[lo:hi])).sum() / len(words) < least:
                continue
            score, s, e = align(words, h[lo:hi])
            share = score / (MATCH * len(words))
            if share >= least and (i not in best or share > best[i][0]):
                best[i] = (share, int(start[lo + s]), int(end[lo + e - 1]))
        if best:
            yield batch, row, best


def _match(shared, least: float):
    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch, row, best in _copies(batches, block, least):
            share, s, e = zip(*best.values())
            yield pa.RecordBatch.from_arrays([
                pa.array([batch.column(0)[row].as_py()] * len(best), pa.int64()), pa.array(block.ids[list(best)], pa.int64()),
                pa.array(share, pa.float64()), pa.array(s, pa.int64()), pa.array(e, pa.int64()),
            ], names=["doc_id", "item_id", "score", "start_byte", "end_byte"])

    return run


def _drop(shared, least: float, text: int):
    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[row for _, row, _ in _copies(iter([batch]), shared.value, least, text)]] = False
            yield batch.filter(pa.array(clean))

    return run


FOUND = "doc_id long, item_id long, score double, start_byte long, end_byte long"


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", least: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, item_id, score, start_byte, end_byte)``: the best copy of each item in each text, where the score reaches ``least``.

    Every alignment that reaches ``least`` is found, but those of one word of an item of two. Null or empty texts
    and items without words match nothing; a very long text is one row of one task. Rows with a null key are compared
    and reported with a null doc_id; items with a null id are left out. Repeated rows are reported
    once each. Other columns are ignored; empty tables give an empty result.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for seeds in seed_blocks(rows, benchmark, item_key, item_text, least, block_bytes):
        found = rows.mapInArrow(_match(seeds, least), FOUND)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], FOUND) if out is None else out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", least: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that ``contaminated`` reports; all columns stay, no row is shuffled."""
    out = docs
    for seeds in seed_blocks(docs.select(F.lit(None), F.col(text).cast("string")), benchmark, item_key, item_text, least, block_bytes):
        out = out.mapInArrow(_drop(seeds, least, docs.columns.index(text)), docs.schema)
    return out


def _count(shared):
    """How often each seed of a block occurs in a task's texts."""

    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        counts = np.zeros(len(block.grams), np.int64)
        for *_, gram in _hits(batches, block):
            counts += np.bincount(gram, minlength=len(counts)) if len(gram) > len(counts) // 8 else 0
            if len(gram) <= len(counts) // 8:
                np.add.at(counts, gram, 1)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["seed", "n"])

    return run


def seed_blocks(rows: DataFrame, benchmark: DataFrame, item_key: str, item_text: str, least: float, block_bytes: int) -> list:
    """Broadcast rare seeds of each block of items; ``rows`` has the texts in its second column.

    Counts of a block's seeds, one row a seed, pass through the driver, as the block does."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null and text is not null")
    blocks = int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) + 1
    out = []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").toArrow()
        block = index_block(part["item_id"].to_numpy(), part["text"])
        if not len(block.grams):
            continue
        whole = spark.sparkContext.broadcast(block)
        found = rows.mapInArrow(_count(whole), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
        whole.unpersist()
        counts = np.zeros(len(block.grams), np.int64)
        counts[found["seed"].to_numpy()] = found["n"].to_numpy()
        out.append(spark.sparkContext.broadcast(block.rare(counts, least)))
    return out


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
