"""Line dedup: an exact set-similarity join of all lines of all texts.

A line is the set of its words. A line is removed if an earlier line (by key, then place in the
text) has a Jaccard similarity of at least ``num / den`` with it, whether or not that earlier line
stays itself. Lines with fewer than ``min_words`` distinct words are left alone; by default every line
with a word takes part.

Texts are dealt to chunks of about CHUNK_BYTES by key, however wide the shuffle; that exchange serves
all steps. Messages between chunks and buckets hold one entry at least, so they are never more rows than
the plain form of one row an entry.

1. A chunk sends its distinct words with counts, and the hashes of its lines with their first place.
   Buckets answer with the words' total counts and with which lines are the first of their kind;
   later equal lines are settled by that, so a line that a third of all texts repeat is one entry a chunk.
2. In each remaining line words are ordered by rarity (total count, then hash). Its first
   s - ceil(t s) + 1 words are its prefix: similar lines share a word there. The chunk sends a
   posting for each prefix word that occurs twice at least.
3. A bucket pairs the postings of a word under the length filter, the positional filter and a filter
   on parity bitmaps, wider for longer lines (each differing bit needs a word in one line only, so
   their Hamming distance bounds the symmetric difference from below).
4. The earlier line's words go to the later one's chunk, where Jaccard is verified and lines cut.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandloom.llm import _words
from strandloom.llm._pack import from_gaps, gaps, narrow, pack, unpack
from strandloom.llm.substring_dedup import NO_KEY, ROW, _rows, spread
from strandloom.workspace import shuffle_width

NUM, DEN, MIN_WORDS = 80, 100, 1
PAIRS = 1 << 20
BLOCK = 1 << 21
TOKEN_BITS = 40
CHUNK_BYTES = 8 << 20
MIDDLE, LONG = 80, 200


class _Lines:
    """Texts of a chunk by key, their lines, and the hashes of the words of each line."""

    def __init__(self, table: pa.Table):
        keys = table["doc_id"].fill_null(NO_KEY)
        order = pc.sort_indices(pa.table({"k": keys, "t": table["text"].fill_null("")}), [("k", "ascending"), ("t", "ascending")])
        table = table.take(order)
        self.table, self.keys = table, keys.take(order).to_numpy()
        self.buf, self.off = _words.utf8(table["text"])
        # a line starts at a text's start and after each line end
        breaks = np.flatnonzero(self.buf == 10) + 1
        lines = np.bincount(np.searchsorted(self.off, breaks - 1, "right") - 1, minlength=len(self.keys)) + 1
        self.doc = np.repeat(np.arange(len(self.keys)), lines)
        first = np.cumsum(lines) - lines
        begin = np.empty(len(self.doc), np.int64)
        begin[first] = self.off[:-1]
        rest = np.ones(len(self.doc), bool)
        rest[first] = False
        begin[rest] = breaks
        self.start = begin
        self.end = np.empty(len(begin), np.int64)
        self.end[:-1] = begin[1:] - 1
        last = first + lines - 1
        self.end[last] = self.off[1:]
        self.key = self.keys[self.doc]
        # rows with one key are numbered on, so that every line has a place of its own
        fresh = np.concatenate(([True], self.key[1:] != self.key[:-1])) if len(self.key) else np.empty(0, bool)
        origin = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
        self.number = np.arange(len(fresh)) - origin

    @functools.cached_property
    def _hashed(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [_words.words(self.buf[self.off[i] : self.off[j]], self.off[i : j + 1] - self.off[i])[:2] for i, j in _words.slices(self.off)]
        cuts = [self.off[i] for i, _ in _words.slices(self.off)]
        h = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.uint64)
        at = np.concatenate([p[1] + c for p, c in zip(parts, cuts)]) if parts else np.empty(0, np.int64)
        return h, np.concatenate((np.searchsorted(at, self.start), [len(at)]))

    @property
    def h(self) -> np.ndarray:
        """Hashes of all words."""
        return self._hashed[0]

    @property
    def cut(self) -> np.ndarray:
        """Places of the words of each line."""
        return self._hashed[1]

    def sets(self, lines: np.ndarray) -> list[np.ndarray]:
        """The distinct words of some lines, of which alone words are taken."""
        size = (self.end - self.start)[lines]
        off = np.concatenate(([0], np.cumsum(size)))
        buf, out = self.buf[spread(self.start[lines], size)], []
        for i, j in _words.slices(off):
            h, _, _, first = _words.words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            out += [_words.distinct(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        return out

    def marks(self) -> np.ndarray:
        """128-bit hash of each line's word sequence, as two columns."""
        p, inv = _words.powers(len(self.h) + 1)
        n = np.diff(self.cut)
        out = []
        for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
            c = np.zeros(len(self.h) + 1, np.uint64)
            np.cumsum(_words.mix(self.h ^ np.uint64(salt)) * p[: len(self.h)], out=c[1:])
            out.append(_words.mix((c[self.cut[1:]] - c[self.cut[:-1]]) * inv[np.minimum(self.cut[:-1], len(inv) - 1)] + n.astype(np.uint64) * np.uint64(salt)))
        return np.stack(out, axis=1)

    def kinds(self, buckets: int):
        """Lines with words: (first line of each distinct mark in order of bucket and mark, mark, number of the mark of each such line, lines, bucket cuts)."""
        lines = np.flatnonzero(np.diff(self.cut))
        m = self.marks()[lines]
        order = _words.sort_order(m[:, 1])
        order = order[_words.sort_order(m[order, 0])]
        order = order[_words.order_of((m[order, 0] % np.uint64(buckets)).astype(np.int64))[0]]
        s = m[order]
        head = np.concatenate(([True], (s[1:] != s[:-1]).any(axis=1))) if len(s) else np.empty(0, bool)
        number = np.empty(len(lines), np.int64)
        number[order] = np.cumsum(head) - 1
        return lines[order][head], s[head], number, lines, np.searchsorted(s[head][:, 0] % np.uint64(buckets), np.arange(buckets + 1))

    def vocabulary(self, buckets: int):
        uniq, number, n = _words.codes(self.h)
        order, _ = _words.order_of((uniq % np.uint64(buckets)).astype(np.int64))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        return uniq[order], place[number], n[order], np.searchsorted(uniq[order] % np.uint64(buckets), np.arange(buckets + 1))

    def find(self, key: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Lines by key and number."""
        first = np.searchsorted(self.key, key, "left")
        return first + number.astype(np.int64)


def _ask(buckets: int):
    @_words.lean
    def run(table: pa.Table) -> pa.Table:
        c, x = table["chunk"][0].as_py(), _Lines(table)
        uniq, _, n, cuts = x.vocabulary(buckets)
        out = [(b, c, "words", pack(gaps(uniq[i:j]), narrow(n[i:j]))) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j]
        first, mark, _, _, cuts = x.kinds(buckets)
        out += [(b, c, "lines", pack(mark[i:j, 0], mark[i:j, 1], x.key[first[i:j]], narrow(x.number[first[i:j]]))) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j]
        return _rows(out)

    return run


@_words.lean
def _tell(table: pa.Table) -> pa.Table:
    b, out = table["bucket"][0].as_py(), []
    rows = list(zip(table["chunk"].to_pylist(), table["kind"].to_pylist(), table["blob"]))
    words = [(c, *unpack(v.as_buffer())) for c, k, v in rows if k == "words"]
    if words:
        h = [from_gaps(g) for _, g, _ in words]
        _, inv, _ = _words.codes(np.concatenate(h))
        total = np.bincount(inv, weights=np.concatenate([n for _, _, n in words])).astype(np.int64)[inv]
        cuts = np.cumsum([0, *map(len, h)])
        out += [(b, c, "counts", pack(narrow(total[i:j]))) for (c, _, _), i, j in zip(words, cuts[:-1], cuts[1:])]
    lines = [(c, *unpack(v.as_buffer())) for c, k, v in rows if k == "lines"]
    if lines:
        m0, m1, key, number = (np.concatenate([x[k] for x in lines]) for k in (1, 2, 3, 4))
        order = np.lexsort((number, key, m1, m0))
        head = np.concatenate(([True], (m0[order][1:] != m0[order][:-1]) | (m1[order][1:] != m1[order][:-1])))
        first = np.zeros(len(m0), bool)
        first[order[head]] = True
        cuts = np.cumsum([0, *(len(x[1]) for x in lines)])
        out += [(b, x[0], "firsts", np.packbits(first[i:j]).tobytes()) for x, i, j in zip(lines, cuts[:-1], cuts[1:])]
    return _rows(out)


def _firsts(x: _Lines, told: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines with words, and whether each is the first of its kind anywhere."""
    first, _, number, lines, cuts = x.kinds(buckets)
    held = np.zeros(len(first), bool)
    for b, k, v in zip(told["bucket"].to_pylist(), told["kind"].to_pylist(), told["blob"].to_pylist()):
        if k == "firsts":
            held[cuts[b] : cuts[b + 1]] = np.unpackbits(np.frombuffer(v, np.uint8), count=cuts[b + 1] - cuts[b])
    return lines, held[number] & (first[number] == lines)


def needed(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap of sets of sizes a and b whose Jaccard similarity reaches num / den."""
    return -(-num * (a + b) // (num + den))


def _postings(buckets: int, num: int, den: int, min_words: int):
    @_words.lean
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _rows([])
        c, x = texts["chunk"][0].as_py(), _Lines(texts)
        lines, first = _firsts(x, told, buckets)
        uniq, word, _, cuts = x.vocabulary(buckets)
        count = np.zeros(len(uniq), np.int64)
        for b, k, v in zip(told["bucket"].to_pylist(), told["kind"].to_pylist(), told["blob"]):
            if k == "counts":
                count[cuts[b] : cuts[b + 1]] = unpack(v.as_buffer())[0]
        by_rarity = _words.sort_order(uniq)
        by_rarity = by_rarity[_words.order_of(count[by_rarity])[0]]
        rank = np.empty(len(uniq), np.int64)
        rank[by_rarity] = np.arange(len(uniq))
        mine = lines[first]
        n = np.diff(x.cut)[mine]
        key = _words.distinct(np.repeat(np.arange(len(mine)), n) << 32 | rank[word[spread(x.cut[mine], n)]])
        line, token = key >> 32, by_rarity[key & 0xFFFFFFFF]
        size = np.bincount(line, minlength=len(mine))
        start = np.cumsum(size) - size
        pos = np.arange(len(line)) - start[line]
        spot = _words.mix(uniq[token] + np.uint64(7)) >> np.uint64(56)
        bit = np.uint64(1) << (spot & np.uint64(63))
        maps = np.zeros((4, len(mine)), np.uint64)
        if len(line):
            maps[0] = np.bitwise_xor.reduceat(bit, start)
        # only longer lines have more than one
        longer = np.flatnonzero(size > MIDDLE)
        if len(longer):
            n = size[longer]
            at = spread(start[longer], n)
            quarter, bit, first = spot[at] >> np.uint64(6), bit[at], np.cumsum(n) - n
            wide = [np.bitwise_xor.reduceat(np.where(quarter == q, bit, np.uint64(0)), first) for q in range(3)]
            maps[1:, longer] = wide[0] ^ wide[2], wide[0], wide[1]
        prefix = size - -(-num * size // den) + 1
        on = (pos < prefix[line]) & (count[token] > 1) & (size[line] >= min_words)
        line, token, pos = line[on], token[on], pos[on]
        t = uniq[token] >> np.uint64(64 - TOKEN_BITS)
        home = (_words.mix(t) % np.uint64(buckets)).astype(np.int64)
        order, _ = _words.order_of(t.astype(np.int64))
        order = order[_words.order_of(home[order])[0]]
        line, t, pos, home = line[order], t[order], pos[order], home[order]
        cuts = np.searchsorted(home, np.arange(buckets + 1))
        where = mine[line]
        return _rows([
            (b, c, "postings", pack(gaps(t[i:j]), x.key[where[i:j]], narrow(x.number[where[i:j]]), narrow(size[line[i:j]]), narrow(pos[i:j]), *_bitmaps(size[line[i:j]], line[i:j], maps)))
            for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j
        ])

    return run


def _bitmaps(size: np.ndarray, line: np.ndarray, maps: np.ndarray) -> list[np.ndarray]:
    """Parity bitmaps of postings: 64 bits each; 64 more for lines above MIDDLE words; 128 more for those above LONG."""
    middle, long = line[size > MIDDLE], line[size > LONG]
    return [maps[0][line], maps[1][middle], maps[2][long], maps[3][long]]


def _unfold(size: np.ndarray, one: np.ndarray, two: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 64-, 128- and 256-bit bitmaps (n x 1, 2 and 4; zeros where a line is too short to have one)."""
    n = len(size)
    two_all, four = np.zeros((n, 2), np.uint64), np.zeros((n, 4), np.uint64)
    m, k = size > MIDDLE, size > LONG
    two_all[m, 0], two_all[m, 1] = two, two ^ one[m]
    four[k, 0], four[k, 1] = w0, w1
    four[k, 2], four[k, 3] = w0 ^ two_all[k, 0], w1 ^ two_all[k, 1]
    return one[:, None], two_all, four


def _pair_rows(b: int, chunk: np.ndarray, key: np.ndarray, number: np.ndarray, a: np.ndarray, z: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of places as messages to the chunk of the earlier line."""
    swap = (key[z] < key[a]) | ((key[z] == key[a]) & (number[z] < number[a]))
    a, z = np.where(swap, z, a), np.where(swap, a, z)
    order = np.argsort(chunk[a], kind="stable")
    a, z = a[order], z[order]
    cuts = np.flatnonzero(np.concatenate(([True], chunk[a][1:] != chunk[a][:-1], [True]))) if len(a) else []
    yield from _rows([(b, int(chunk[a[i]]), "pairs", pack(key[a[i:j]], narrow(number[a[i:j]]), narrow(chunk[z[i:j]]), key[z[i:j]], narrow(number[z[i:j]]))) for i, j in zip(cuts[:-1], cuts[1:])]).to_batches()


def _candidates(num: int, den: int):
    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        b = table["bucket"][0].as_py()
        parts = [unpack(v.as_buffer()) for v in table["blob"]]
        chunk = np.repeat(table["chunk"].to_numpy(), [len(p[0]) for p in parts])
        t = np.concatenate([from_gaps(p[0]) for p in parts])
        key, number, size, pos, *maps = (np.concatenate([p[k] for p in parts]) for k in range(1, 9))
        del table, parts
        size, pos = size.astype(np.int64), pos.astype(np.int64)
        order, _ = _words.order_of(size)
        order = order[_words.order_of(t[order].astype(np.int64))[0]]
        t, chunk, key, number, size, pos, *maps = (v[order] for v in (t, chunk, key, number, size, pos, *_unfold(size, *maps)))
        # partners of i: later places of its word with sizes up to size_i * den / num
        group = np.cumsum(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.empty(0, np.int64)
        # wider than any size looked for, and far from the end of 64 bits with any number of words
        span = np.int64(int(size.max()) * den // num + 2 if len(size) else 1)
        many = np.maximum(np.searchsorted(group * span + size, group * span + size * den // num, "right") - np.arange(len(t)) - 1, 0)
        total = np.cumsum(many)
        left, right, held, i = [], [], 0, 0
        while i < len(t):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
            # a place with very many partners is taken in steps of its own
            for lo in range(0, int(many[i : i + 1].sum()) if j == i + 1 else 1, PAIRS):
                n = np.minimum(many[i:j] - lo, PAIRS) if j == i + 1 else many[i:j]
                a = np.repeat(np.arange(i, j), n)
                z = spread(np.arange(i, j) + 1 + (lo if j == i + 1 else 0), n)
                need = needed(size[a], size[z], num, den)
                ok = 1 + np.minimum(size[a] - pos[a], size[z] - pos[z]) - 1 >= need
                a, z, need = a[ok], z[ok], need[ok]
                for m, least in zip(maps, (0, MIDDLE, LONG)):
                    # size[a] <= size[z], so both have the bitmap if a has it
                    apart = np.bitwise_count(m[a] ^ m[z]).sum(axis=1, dtype=np.int64)
                    ok = (apart <= size[a] + size[z] - 2 * need) | (size[a] <= least)
                    a, z, need = a[ok], z[ok], need[ok]
                left.append(a), right.append(z)
                held += len(a)
                if held >= PAIRS:
                    yield from _pair_rows(b, chunk, key, number, np.concatenate(left), np.concatenate(right))
                    left, right, held = [], [], 0
            i = j
        if held:
            yield from _pair_rows(b, chunk, key, number, np.concatenate(left), np.concatenate(right))

    return run


@_words.lean
def _send(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """The words of each earlier line of a pair, to the chunk of the later line."""
    if not texts.num_rows or not pairs.num_rows:
        return _rows([])
    c, x = texts["chunk"][0].as_py(), _Lines(texts)
    key, number, chunk, key2, number2 = (np.concatenate(v) for v in zip(*(unpack(v.as_buffer()) for v in pairs["blob"])))
    line = x.find(key, number).astype(np.int64)
    del key, number
    # a pair is one code: the earlier line, and the number of the later one
    keys, rank = np.unique(key2, return_inverse=True)
    wide = int(number2.max()) + 1
    later, first, rank = np.unique(rank * wide + number2, return_index=True, return_inverse=True)
    to, number2 = chunk[first].astype(np.int64), later % wide
    key2 = keys[later // wide]
    code = _words.distinct(line * len(later) + rank)
    line, rank = code // len(later), code % len(later)
    out = []
    order = np.argsort(to[rank], kind="stable")
    line, rank = line[order], rank[order]
    cuts = np.flatnonzero(np.concatenate(([True], to[rank][1:] != to[rank][:-1], [True])))
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        r = rank[a:z]
        lines, which = np.unique(line[a:z], return_inverse=True)
        sets = x.sets(lines)
        out.append((c, int(to[r[0]]), "sets", pack(narrow(np.array([len(s) for s in sets])), np.concatenate(sets), narrow(which), key2[r], narrow(number2[r]))))
    return _rows(out)


def _similar(x: _Lines, size: np.ndarray, flat: np.ndarray, which: np.ndarray, line: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs (set ``which`` of those in ``flat``, a line of the chunk) reach num / den.

    Words become codes of pair and word; after a sort of about BLOCK of them at once, the equal
    neighbours of a pair are its shared words.
    """
    lines, mine = np.unique(line, return_inverse=True)
    n = np.diff(x.cut)[lines]
    words = x.h[spread(x.cut[lines], n)]
    code = np.unique(np.concatenate((flat, words)), return_inverse=True)[1]
    left, right = code[: len(flat)], _words.distinct(np.repeat(np.arange(len(lines)), n) << 32 | code[len(flat) :])
    size2 = np.bincount(right >> 32, minlength=len(lines))
    right &= 0xFFFFFFFF
    start, start2 = np.cumsum(size) - size, np.cumsum(size2) - size2
    na, nb = size[which], size2[mine]
    total = np.cumsum(na + nb)
    out, i = np.empty(len(which), bool), 0
    while i < len(which):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + BLOCK, "right")))
        a, b, pair = na[i:j], nb[i:j], np.arange(j - i)
        both = np.concatenate((np.repeat(pair, a) << 32 | left[spread(start[which[i:j]], a)], np.repeat(pair, b) << 32 | right[spread(start2[mine[i:j]], b)]))
        both.sort()
        shared = np.bincount(both[1:][both[1:] == both[:-1]] >> 32, minlength=j - i)
        out[i:j] = den * shared >= num * (a + b - shared)
        i = j
    return out


def _remove(buckets: int, num: int, den: int, min_words: int, carry: list[str]):
    @_words.lean
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        spans = pa.list_(pa.int64())
        if not texts.num_rows:
            return pa.table({"doc_id": texts["doc_id"], "n_lines": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64()), "removed": pa.array([], spans), "kept": pa.array([], pa.string())} | {c: texts[f"_{c}"] for c in carry})
        x = _Lines(texts)
        lines, first = _firsts(x, told, buckets)
        gone, links = np.zeros(len(x.start), bool), np.zeros(len(x.start), np.int64)
        again = lines[~first]
        gone[again] = True if min_words <= 1 else [len(_words.distinct(x.h[x.cut[i] : x.cut[i + 1]])) >= min_words for i in again.tolist()]
        for k, v in zip(told["kind"].to_pylist(), told["blob"]):
            if k == "sets":
                size, flat, which, key, number = unpack(v.as_buffer())
                i = x.find(key, number)
                np.add.at(links, i[_similar(x, size.astype(np.int64), flat, which.astype(np.int64), i, num, den)], 1)
        links[again] += gone[again]
        gone |= links > 0
        per = np.bincount(x.doc, minlength=len(x.keys))
        ends = np.cumsum(per)
        raw, removed, kept = x.buf.tobytes(), [], []
        for i, j in zip((ends - per).tolist(), ends.tolist()):
            g = gone[i:j]
            removed.append(np.flatnonzero(g).tolist())
            if g.any():
                kept.append(b"\n".join(raw[s:e] for s, e in zip(x.start[i:j][~g].tolist(), x.end[i:j][~g].tolist())).decode())
            else:
                kept.append(raw[x.start[i] : x.end[j - 1]].decode())
        return pa.table({"doc_id": x.table["doc_id"], "n_lines": pa.array(per), "n_links": pa.array(np.bincount(x.doc, weights=links, minlength=len(x.keys)).astype(np.int64)), "removed": pa.array(removed, spans), "kept": pa.array(kept, pa.string())} | {c: x.table[f"_{c}"] for c in carry})

    return run


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", num: int = NUM, den: int = DEN, min_words: int = MIN_WORDS, carry: tuple[str, ...] = (), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(doc_id, n_lines, n_links, removed, kept)``, one row per input row: numbers of the removed lines (from 0) and the text of the others.

    ``n_links`` counts, over the lines of the row, the different earlier lines that each is similar to;
    a line with the words of an earlier one in the same order has that one link.

    Lines end at line feeds. A null or empty text is one empty line, which stays. Lines without
    words stay. A row with a null key comes after all others; rows with one key come in the order of
    their texts, and their lines count on. An empty table stays empty. Of the other columns those in
    ``carry`` (none named like the five above) are handed through.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    buckets = max(32, width)
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    texts = (
        docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"_{c}") for c in carry))
        .withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))
        .repartition(width, "chunk")
    )
    told = texts.groupBy("chunk").applyInArrow(_ask(buckets), ROW).groupBy("bucket").applyInArrow(_tell, ROW).repartition(width, "chunk")
    posted = texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_postings(buckets, num, den, min_words), ROW)
    pairs = posted.groupBy("bucket").applyInArrow(_candidates(num, den), ROW)
    sets = texts.groupBy("chunk").cogroup(pairs.groupBy("chunk")).applyInArrow(_send, ROW)
    answers = told.where("kind = 'firsts'").unionByName(sets).repartition(width, "chunk")
    out = StructType.fromDDL("doc_id long, n_lines long, n_links long, removed array<long>, kept string")
    for c in carry:
        out.add(docs.schema[c])
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_remove(buckets, num, den, min_words, list(carry)), out)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_words=1)
    return found.select("doc_id", "n_lines", "n_links", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"), F.sha2("kept", 256).alias("kept_sha256"))
