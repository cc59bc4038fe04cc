"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights.

Tokens are words (A-Z folded) and one end token a text. The history of a token are the tokens before
it in its text, up to ``order`` - 1, and one start mark before the first. The model is
P(w | h) = d(c) c(h, w) / c(h) for seen n-grams and alpha(h) P(w | h') for the rest, h' being h
without its first token; a history not seen in training is left out. P(w) is the same recursion one
level down: seen words d(c) c / N, and one unknown type that gets what the discounts leave. alpha(h)
is what the n-grams of h leave, divided by the lower probability of the words not seen after h, so
every distribution sums to one.

How it runs. Chunks of a task's texts hold token sequences as numbers of the chunk's distinct words.
Counts meet in hash buckets, level by level: words by word, n-grams by history. A bucket answers each
chunk with what its own entries need (ids and counts; for n-grams also the history's total, and,
where one of them is unseen, its count classes and seen mass), so a frequent n-gram costs one entry a
chunk. Its id is the history one level up. Discounts come from global counts of counts, one row a
level. Words are 64-bit hashes.

An n-gram that occurs once, in a training text, is closed: as a history it has one successor, known
where it stands, and nobody else asks for it. So it gets no id, and what follows it is not sent but
only counted.

A frequent history (more than an average bucket's share of the training tokens) is split by its
words into parts, each in a bucket of its own. A chunk that has it asks all its parts, and adds up
what they say of the history, so no bucket holds more than a few such shares.

``save`` stores the model as tables: words, n-grams with their probability, and histories with their
backoff weight, partitioned by level and bucket. ``score_saved`` evaluates any other corpus from them
by joins, recursively for each token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm import _words
from strandloom.llm._pack import from_gaps, gaps, narrow, pack, unpack
from strandloom.workspace import as_scan, materialize, shuffle_width

CHUNK_BYTES = 12 << 20
ORDER = 3
K = 5
#: floor of the probability not seen after a history, against rounding
LEAST = 1e-12
END, START = np.uint64(0x0E0D0E0D0E0D0E0D), np.uint64(0x57A2757A2757A275)
ROW = "bucket int, chunk long, kind string, blob binary"
CLASSES = ", ".join(f"n{r} long" for r in range(1, K + 2))


def _rows(rows: list[tuple]) -> pa.Table:
    b, c, k, v = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"bucket": pa.array(b, pa.int32()), "chunk": pa.array(c, pa.int64()), "kind": pa.array(k, pa.string()), "blob": pa.array(v, pa.binary())})


def _good_turing(n: np.ndarray) -> np.ndarray:
    d = np.ones(K + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        top = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top)
    return d


def discounts(n: np.ndarray) -> np.ndarray:
    """d[1..K] from counts of counts n[1..K+1] (index 0 unused); d[r] = 1 above K.

    Where copied texts make the counts of counts too rough for numbers in (0, 1), they are first
    smoothed by the line log n = a + b log r (simple Good-Turing); where that fails too, as on
    tiny corpora, each class gives up one half of a count.
    """
    n = n.astype(float)
    d = _good_turing(n)
    valid = lambda: bool(np.all((d[1:] > 0) & (d[1:] < 1)))
    if not valid() and np.all(n[1 : K + 2] > 0):
        r = np.arange(1, K + 2)
        b, a = np.polyfit(np.log(r), np.log(n[1 : K + 2]), 1)
        d = _good_turing(np.concatenate(([0.0], np.exp(a + b * np.log(r)))))
    if not valid():
        d[1:] = (np.arange(1, K + 1) - 0.5) / np.arange(1, K + 1)
    return d


def unigram(c: np.ndarray, total: int, n: np.ndarray, types: int) -> tuple[np.ndarray, float]:
    """P of words with training counts c (0: the unknown type) and the unknown type's P."""
    if total == 0:
        return np.ones(len(c)), 1.0
    d = np.append(discounts(n), 1.0)
    seen = c * d[np.minimum(c, K + 1).astype(np.int64)]
    left = float(sum(n[r] * r * (1 - d[r]) for r in range(1, K + 1)))
    denom = float(total)
    if left <= 0:
        left, denom = 1.0, total + 1.0
    return np.where(c > 0, seen, left) / denom, left / denom


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """(chunk, keys, train flags, lengths, token hashes) of a task's texts."""
    chunk = TaskContext.get().partitionId() << 32
    held, size = [], 0
    for batch in batches:
        buf, off = _words.utf8(batch.column(1))
        for i, j in _words.slices(off):
            h, _, _, first = _words.words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            n = np.diff(first)
            held.append((batch.column(0).slice(i, j - i), np.asarray(batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False), bool), n + 1, np.insert(h, first[1:], END)))
            size += int(off[j] - off[i]) + 64 * (j - i)
            if size >= most:
                yield (chunk, *_joined(held))
                chunk, held, size = chunk + 1, [], 0
    if held:
        yield (chunk, *_joined(held))


def _joined(held: list[tuple]) -> tuple:
    keys, train, n, h = zip(*held)
    return pa.chunked_array(keys).combine_chunks(), np.concatenate(train), np.concatenate(n), np.concatenate(h)


def _numbered(train: np.ndarray, n: np.ndarray, h: np.ndarray, buckets: int):
    """Distinct hashes by (bucket, hash), each token's number among them, and training counts."""
    uniq, inv, _ = _words.codes(h)
    count = np.bincount(inv[np.repeat(train, n)], minlength=len(uniq))
    order, _ = _words.order_of((uniq % np.uint64(buckets)).astype(np.int64))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return uniq[order], place[inv], count[order]


def _word_requests(buckets: int, most: int):
    @_words.lean
    def run(batches):
        for chunk, _, train, n, h in _chunks(batches, most):
            uniq, _, count = _numbered(train, n, h, buckets)
            cuts = np.searchsorted(uniq % np.uint64(buckets), np.arange(buckets + 1))
            yield from _rows([(b, chunk, "words", pack(gaps(uniq[x:y]), narrow(count[x:y]))) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if x < y]).to_batches()

    return run


def _word_bucket(buckets: int):
    @_words.lean
    def run(table: pa.Table) -> pa.Table:
        b = table["bucket"][0].as_py()
        asked = [(c.as_py(), *unpack(v.as_buffer())) for c, v in zip(table["chunk"], table["blob"])]
        hashes = [from_gaps(g) for _, g, _ in asked]
        uniq, inv, _ = _words.codes(np.concatenate(hashes))
        count = np.bincount(inv, weights=np.concatenate([c for _, _, c in asked]), minlength=len(uniq)).astype(np.int64)
        ident = _idents(count, b, buckets)
        out, at = [], 0
        for (chunk, _, _), h in zip(asked, hashes):
            i = inv[at : at + len(h)]
            out.append((b, chunk, "ids", pack(narrow((ident[i] + buckets - 1) // buckets), narrow(count[i]))))
            at += len(h)
        seen = count > 0
        out.append((b, None, "table", pack(uniq[seen], narrow(count[seen]))))
        stats = np.concatenate(([seen.sum(), count.sum()], np.bincount(np.minimum(count, K + 2), minlength=K + 3)[1 : K + 2])).astype(np.int64)
        out.append((b, None, "stats", stats.tobytes()))
        return _rows(out)

    return run


def _doc_rows(buckets: int, most: int):
    @_words.lean
    def run(batches):
        for chunk, keys, train, n, h in _chunks(batches, most):
            uniq, number, _ = _numbered(train, n, h, buckets)
            times = np.bincount(number, minlength=len(uniq))
            freq, _ = _words.order_of(times.max(initial=0) - times)
            rank = np.empty(len(freq), np.uint32)
            rank[freq] = np.arange(len(freq))
            cuts = np.searchsorted(uniq % np.uint64(buckets), np.arange(buckets + 1))
            nulls = np.asarray(keys.is_null().to_numpy(zero_copy_only=False), np.uint8)
            yield from _rows([(-1, chunk, "docs", pack(keys.fill_null(0).to_numpy(), nulls, train.astype(np.uint8), narrow(n), narrow(rank[number]), narrow(freq), narrow(np.diff(cuts))))]).to_batches()

    return run


def _restore(table: pa.Table, buckets: int):
    """Keys, training flags, lengths, each token's word (its number among those of the chunk), and the words' ids and counts (0: not in training)."""
    kinds = table["kind"].to_pylist()
    keys, nulls, train, n, seq, freq, sizes = unpack(table["blob"][kinds.index("docs")].as_buffer())
    start = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    ident, count = np.zeros(len(freq), np.int64), np.zeros(len(freq), np.int64)
    for kind, b, v in zip(kinds, table["bucket"].to_pylist(), table["blob"]):
        if kind == "ids":
            rank, c = unpack(v.as_buffer())
            rank = rank.astype(np.int64)
            ident[start[b] : start[b + 1]] = np.where(rank > 0, (rank - 1) * buckets + b + 1, 0)
            count[start[b] : start[b + 1]] = c
    return keys, nulls, train.astype(bool), n.astype(np.int64), freq.astype(np.int32)[seq], ident, count


class _Level:
    """Distinct n-grams (history, word) of a chunk in order of bucket, history and word.

    Of histories and words each token gives a number (of histories -1 where there is none to ask for) of
    those in ``histories`` and ``words``, which hold their ids. ``token``: each token's place among the
    n-grams, or -1. ``rep``: a token of each n-gram. ``seen``: training counts, ``open``: whether texts
    that are not trained on have it.
    """

    def __init__(self, history: np.ndarray, histories: np.ndarray, word: np.ndarray, words: np.ndarray, train: np.ndarray, parts: np.ndarray, step: int, buckets: int):
        tokens, split = len(history), np.flatnonzero((history >= 0) & (parts > 1))
        # every part of a split history is asked, if only for the unknown word
        base, first, which = np.unique(history[split], return_index=True, return_inverse=True)
        many = parts[split][first]
        before = np.cumsum(many) - many
        whole = np.repeat(np.arange(len(base)), many)
        extra = _part_id(histories[base][whole], np.arange(int(many.sum())) - before[whole], step)
        history = np.concatenate((history, len(histories) + np.arange(len(extra))))
        history[split] = len(histories) + before[which] + words[word[split]] % many[which]
        histories = np.concatenate((histories, extra))
        # the unknown word stands after all others
        word, words, train = np.append(word, np.full(len(extra), len(words), word.dtype)), np.append(words, 0), np.append(train, np.zeros(len(extra), bool))
        at = np.flatnonzero(history >= 0)
        history_rank, word_rank = np.zeros(len(histories), np.int64), np.zeros(len(words), np.int64)
        on = np.flatnonzero(histories >= 0)
        place, home = np.divmod(histories[on], buckets)
        by_place, _ = _words.order_of(place)
        history_rank[on[by_place[_words.order_of(home[by_place])[0]]]] = np.arange(len(on))
        on = np.flatnonzero(words)
        word_rank[on[_words.order_of(words[on])[0]]] = np.arange(1, len(on) + 1)
        key = history_rank[history[at]]
        key *= len(words) + 1
        key += word_rank[word[at]]
        # stable, so that a token of the chunk stands for an n-gram wherever there is one
        order, key = _words.order_of(key)
        at = at[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        size = np.diff(np.append(start, len(key)))
        rep = at[start]
        code = history[rep]
        self.history, self.word = histories[code], words[word[rep]]
        self.rep = np.minimum(rep, max(tokens - 1, 0))
        self.token = np.full(len(history), -1, np.int32)
        self.token[at] = np.repeat(np.arange(len(start), dtype=np.int32), size)
        self.token = self.token[:tokens]
        self.seen = np.add.reduceat(train[at], start, dtype=np.int64) if len(start) else start
        self.open = self.seen < size
        self.head = np.concatenate(([True], code[1:] != code[:-1])) if len(rep) else np.empty(0, bool)
        self.group = np.cumsum(self.head) - 1
        self.heads = np.flatnonzero(self.head)
        self.cuts = np.append(self.heads, len(rep))[np.searchsorted(self.history[self.heads] % buckets, np.arange(buckets + 1))]
        #: the parts of split histories among the histories, and the number of the whole one of each
        code = code[self.heads] - (len(histories) - len(extra))
        self.parts = np.flatnonzero(code >= 0)
        self.whole = whole[code[self.parts]]

    def requests(self, chunk: int, counts: np.ndarray, totals: np.ndarray, closed: int, buckets: int) -> list[tuple]:
        """One message a bucket; ``counts`` and ``totals``: each token's n-gram and history one level down; ``closed``: n-grams not sent."""
        out, heads = [], self.heads
        step = self.word.copy()
        step[1:] -= np.where(self.head[1:], 0, self.word[:-1])
        below = np.where(self.seen > 0, counts[self.rep], 0)
        under = np.maximum.reduceat(np.where(below > 0, totals[self.rep], 0), heads) if len(heads) else heads
        place, many, bits = self.history[heads] // buckets, np.diff(np.append(heads, len(self.rep))), self.open
        for b, (x, y) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
            if x < y or (closed and b == buckets - 1):
                g, k = np.searchsorted(heads, (x, y))
                out.append((b, chunk, "grams", pack(narrow(gaps(place[g:k])), narrow(many[g:k]), narrow(step[x:y]), narrow(self.seen[x:y]), np.packbits(bits[x:y]), narrow(below[x:y]), narrow(under[g:k]), np.array([closed]))))
                closed = 0
        return out

    def answered(self, answers: list[tuple[int, bytes]]):
        """Total, id, and by history: total, whether counts are discounted, what remains by class, mass of seen words."""
        total, ident = np.zeros(len(self.rep), np.int64), np.zeros(len(self.rep), np.int64)
        size, mass = np.zeros(len(self.heads), np.int64), np.zeros(len(self.heads))
        left = np.zeros((K + 1, len(size)))
        keeps = np.ones(len(size), bool)
        for b, v in answers:
            x, y = self.cuts[b], self.cuts[b + 1]
            if x == y:
                continue
            t, ids, sized, m, *classes = unpack(v)
            total[x:y], ident[x:y] = t, ids
            g = self.group[x]
            size[g : g + len(sized)], keeps[g : g + len(sized)] = sized >> 1, sized & 1
            open_ = g + _open(t.astype(np.int64), self.group[x:y] - g, len(sized))
            mass[open_] = m
            for r, c in enumerate(classes, 1):
                left[r, open_] = c
        if len(self.parts):
            add = lambda x: np.bincount(self.whole, weights=x[self.parts])[self.whole]
            size[self.parts], keeps[self.parts], mass[self.parts] = add(size).astype(np.int64), add(keeps) > 0, add(mass)
            for x in left:
                x[self.parts] = add(x)
        return total, ident, size, keeps, left, mass


def _part_id(history: np.ndarray, part: np.ndarray, step: int) -> np.ndarray:
    """The id of a part of a history; ids of histories are below ``step``, and parts follow one another over the buckets."""
    return history + part * (step + 1)


def _whole_id(history: np.ndarray, step: int) -> np.ndarray:
    return history - history // step * (step + 1)


def _step(buckets: int, words_total: int) -> int:
    """A multiple of ``buckets`` above all ids, of which a bucket gives one for each n-gram it has seen."""
    return buckets * (words_total + 1025)


def _open(total: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Histories with an unseen n-gram among those asked for."""
    return np.flatnonzero(np.bincount(group[total == 0], minlength=groups))


class _Chunk:
    """Tokens of a chunk's texts, and what is known of their n-grams as far as levels are answered.

    For each token: ``p``, its probability; ``grams``, its n-gram's number among those in ``ids``, which
    holds their ids (0: none); ``closed``, whether that n-gram is closed; ``counts`` and ``totals``,
    training counts of the n-gram and of its history.
    """

    def __init__(self, table: pa.Table, buckets: int, words_total: int, types: int, n1: list[int]):
        self.keys, self.nulls, train, self.n, self.word, self.words, self.known = _restore(table, buckets)
        self.train, self.buckets = np.repeat(train, self.n), buckets
        self.doc_train = train
        self.first = np.zeros(len(self.word), bool)
        self.first[(np.cumsum(self.n) - self.n)[self.n > 0]] = True
        self.p = unigram(self.known, words_total, np.array(n1), types)[0][self.word]
        self.grams, self.ids, self.level, self.closed = self.word, self.words, 1, np.zeros(len(self.word), bool)
        self.counts, self.totals = self.known[self.word], np.full(len(self.word), words_total + (not _discounted(n1)))
        self.share, self.step = max(1, words_total // buckets), _step(buckets, words_total)
        # as many texts begin as end
        self.texts = int(self.counts[np.cumsum(self.n)[self.n > 0][-1:] - 1].sum())

    def next(self) -> _Level:
        """The n-grams one level up; the first token's only history is the start mark."""
        after = lambda x, start: np.concatenate(([start], x[:-1])).astype(x.dtype) if len(x) else x
        self.closed = ~self.first & after(self.closed, False)
        self.level += 1
        # numbers of histories: the n-grams', then the start mark
        histories = np.append(np.where(self.ids > 0, self.ids, -1), 0)
        history = after(self.grams, -1).astype(np.int64)
        history[(histories[history] < 0) | self.closed] = -1
        history[self.first] = len(self.ids) if self.level == 2 else -1
        uses = np.where(self.first, self.texts, after(self.counts, 0))
        return _Level(history, histories, self.word, self.words, self.train, np.minimum(1 + uses // self.share, min(self.buckets, 1024)), self.step, self.buckets)

    def requests(self, chunk: int) -> pa.Table:
        grams = self.next()
        return _rows(grams.requests(chunk, self.counts, self.totals, int(self.closed.sum()), self.buckets))

    def climb(self, answers: pa.Table | None, order: int, scored: bool) -> None:
        """Evaluate the levels 2 to ``order`` from their answers: with ``scored`` the probabilities and
        what the levels in between need, else all but the probabilities, for requests of the next level."""
        kinds = answers["kind"].to_pylist() if answers is not None else []
        for level in range(2, order + 1):
            grams = self.next()
            rows = [i for i, k in enumerate(kinds) if k == f"answer{level}"]
            if not rows:
                self.grams = np.full(len(self.word), -1, np.int32)
                continue
            d = np.append(discounts(np.array([0, *(answers[f"n{r}"][rows[0]].as_py() or 0 for r in range(1, K + 2))])), 1.0)
            total, ident, size, keeps, left, mass = grams.answered([(answers["bucket"][i].as_py(), answers["blob"][i].as_buffer()) for i in rows])
            denom = np.maximum(size + ~keeps, 1)
            of = lambda x: x[grams.group] if len(grams.rep) else x[:0]
            # tokens without an n-gram, number -1, take what is appended
            fill = lambda x, rest: np.append(x, np.array([rest], x.dtype))[grams.token]
            if scored:
                over = sum(left[r] * r * (1 - d[r]) for r in range(1, K + 1))
                alpha = np.where(keeps, over, 1.0) / denom / np.maximum(1 - mass, LEAST)
                # a history that starts no n-gram in training (size 0) leaves all to the lower level
                value = np.where(total > 0, total * d[np.minimum(total, K + 1)] / of(denom), of(np.where(size > 0, alpha, 1.0)) * self.p[grams.rep])
                self.p = np.where(grams.token >= 0, fill(value, 0.0), np.where(self.closed, d[1], self.p))
            if scored and level == order:
                break
            if not scored:
                self.totals = fill(of(denom), 1)
            self.grams, self.ids = grams.token, ident
            self.counts = fill(total, 0)
            self.counts[self.closed] = 1
            self.closed = np.where(grams.token >= 0, fill((total == 1) & (ident == 0), False), self.closed)


def _discounted(n: list[int]) -> bool:
    """Whether any of the counts that are discounted occurs."""
    return any(n[1 : K + 1])


def _requests(buckets: int, words: tuple):
    """Messages of the bigrams."""

    @_words.lean
    def run(table: pa.Table) -> pa.Table:
        return _Chunk(table, buckets, *words).requests(table["chunk"][0].as_py())

    return run


def _requests_above(order: int, buckets: int, words: tuple):
    """Messages of the n-grams of level ``order`` + 1, once those up to ``order`` are answered."""

    @_words.lean
    def run(table: pa.Table, answered: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([])
        chunk = _Chunk(table, buckets, *words)
        chunk.climb(answered if answered.num_rows else None, order, scored=False)
        return chunk.requests(table["chunk"][0].as_py())

    return run


def _entries(table: pa.Table):
    """All chunks' requests of a bucket: their chunks, the number of histories of each; of the histories asked
    for the number among the distinct ones, the number of words, the lower total; the distinct histories
    (// buckets); the words; the other columns; the entries in order of history and word, and where each
    n-gram starts in it; and the number of n-grams not sent."""
    asked = [unpack(v.as_buffer()) for v in table["blob"]]
    histories, rank = np.unique(np.concatenate([from_gaps(g[0]) for g in asked]).astype(np.int64), return_inverse=True)
    sizes, step, seen, below, under = (np.concatenate([g[k] for g in asked]).astype(np.int64) for k in (1, 2, 3, 5, 6))
    opened = np.concatenate([np.unpackbits(g[4], count=len(g[3])) for g in asked]).astype(bool)
    first = np.cumsum(sizes) - sizes
    word = np.cumsum(step)
    word -= np.repeat(word[first] - step[first], sizes)
    wide = int(word.max(initial=0)) + 1
    number = word
    if wide * len(histories) >= 1 << 62:
        number = np.unique(word, return_inverse=True)[1]
        wide = len(word)
    order, key = _words.order_of(np.repeat(rank * wide, sizes) + number)
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return table["chunk"].to_pylist(), [len(g[0]) for g in asked], rank, sizes, under, histories, word, seen, opened, below, order, start, sum(int(g[7][0]) for g in asked)


def _sums(x: np.ndarray, order: np.ndarray, start: np.ndarray, add=np.add) -> np.ndarray:
    """Totals (or what ``add`` makes) of the entries of each n-gram."""
    return add.reduceat(x[order], start) if len(start) else x[:0]


def _merge(table: pa.Table, n_lower: list[int]):
    """All chunks' requests of a bucket: per request (chunk, histories, sizes), each entry's n-gram, the distinct
    histories (// buckets); and of the distinct n-grams, in order of history and word: number of the history,
    word, total count, lower probability, whether they are open."""
    chunks, many, rank, sizes, under, histories, word, seen, opened, below, order, start, _ = _entries(table)
    ends = np.cumsum(many).tolist()
    asked = [(c, rank[j - n : j], sizes[j - n : j]) for c, n, j in zip(chunks, many, ends)]
    group = np.empty(len(word), np.int64)
    group[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(word))))
    rep = order[start]
    at = np.repeat(rank, sizes)[rep]
    # the lower total depends on the history alone
    of = np.ones(len(histories), np.int64)
    np.maximum.at(of, rank, under)
    count = _sums(below, order, start, np.maximum)
    d = np.append(discounts(np.array(n_lower)), 1.0)
    return asked, group, histories, at, word[rep], _sums(seen, order, start), count * d[np.minimum(count, K + 1)] / of[at], _sums(opened, order, start, np.logical_or)


def _lower_classes(table: pa.Table, n1: list[int]) -> list[int]:
    """Counts of counts one level down: those that came with the requests, or the words'."""
    return [0, *(table[f"n{r}"][0].as_py() or 0 for r in range(1, K + 2))] if "n1" in table.column_names else n1


def _idents(total: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """Ids of seen n-grams, smaller for more frequent ones; 0 for unseen ones."""
    rank = np.empty(len(total), np.int64)
    rank[_words.order_of(total.max(initial=0) - total)[0]] = np.arange(len(total))
    return np.where(total > 0, rank * buckets + bucket + 1, 0)


@_words.lean
def _gram_stats(table: pa.Table) -> pa.Table:
    *_, seen, _, _, order, start, closed = _entries(table)
    n = np.bincount(np.minimum(_sums(seen, order, start), K + 2), minlength=K + 3)
    n[1] += closed
    return pa.table({f"n{r}": pa.array([int(n[r])], pa.int64()) for r in range(1, K + 2)})


def _gram_bucket(level: int, buckets: int, last: bool, n1: list[int], whole: bool):
    @_words.lean
    def run(table: pa.Table) -> pa.Table:
        b = table["bucket"][0].as_py()
        asked, group, history, at, _, total, lower, is_open = _merge(table, _lower_classes(table, n1))
        size = np.bincount(at, weights=total, minlength=len(history)).astype(np.int64)
        mass = np.bincount(at, weights=np.where(total > 0, lower, 0.0), minlength=len(history))
        classes = [np.bincount(at[total == r], minlength=len(history)) for r in range(1, K + 1)]
        # where no count is discounted, one unseen event is added to the history's total
        keeps = np.sum(classes, axis=0) > 0
        ident = np.zeros(len(total), np.int64) if last else np.where((total == 1) & ~is_open & (not whole), 0, _idents(total, b, buckets))
        out, start = [], 0
        for chunk, mine, sizes in asked:
            g = group[start : start + int(sizes.sum())]
            start += len(g)
            o = mine[_open(total[g], np.repeat(np.arange(len(mine)), sizes), len(mine))]
            out.append((b, chunk, f"answer{level}", pack(narrow(total[g]), narrow(ident[g]), narrow(size[mine] << 1 | keeps[mine]), mass[o], *(narrow(c[o]) for c in classes))))
        return _rows(out)

    return run


def _score(order: int, buckets: int, words: tuple):
    words_total, types, _ = words

    @_words.lean
    def run(table: pa.Table, answered: pa.Table) -> pa.Table:
        chunk = _Chunk(table, buckets, *words)
        chunk.climb(answered if answered.num_rows else None, order, scored=True)
        doc = np.repeat(np.arange(len(chunk.n)), chunk.n)
        base = np.log10((chunk.known + 0.5) / (words_total + 0.5 * (types + 1)))[chunk.word]
        add = lambda x: np.bincount(doc, weights=x, minlength=len(chunk.n))
        return pa.table({
            "doc_id": pa.array(chunk.keys, mask=chunk.nulls.astype(bool)), "held_out": pa.array(~chunk.doc_train), "n_tokens": pa.array(chunk.n),
            "n_known": pa.array(add((chunk.known > 0)[chunk.word]).astype(np.int64)), "train_tokens": pa.array(np.full(len(chunk.n), words_total, np.int64)),
            "base_score": pa.array(add(base)), "score": pa.array(add(np.log10(chunk.p))),
        })

    return run


class _Counts:
    """The plan of all levels' counts: chunks, per level the requests by bucket and the counts of counts."""

    def __init__(self, docs: DataFrame, held_out: Column, text: str, key: str, order: int, chunk_bytes: int, whole: bool = False):
        spark = docs.sparkSession
        width = shuffle_width(spark)
        self.order, self.buckets = order, max(16, 2 * width)
        rows = as_scan(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("train")), "texts")
        self.table = materialize(rows.mapInArrow(_word_requests(self.buckets, chunk_bytes), ROW).groupBy("bucket").applyInArrow(_word_bucket(self.buckets), ROW), "words")
        stats = [np.frombuffer(r.blob, np.int64) for r in self.table.where("kind = 'stats'").select("blob").toLocalIterator()]
        total = np.sum(stats, axis=0) if stats else np.zeros(K + 3, np.int64)
        self.words = (int(total[1]), int(total[0]), [0, *total[2:].tolist()])
        self.chunks = rows.mapInArrow(_doc_rows(self.buckets, chunk_bytes), ROW).unionByName(self.table.where("kind = 'ids'")).repartition(width, "chunk")
        self.asked, self.classes, self.answers = {}, {}, None
        for level in range(2, order + 1):
            grouped = self.chunks.groupBy("chunk")
            asked = grouped.applyInArrow(_requests(self.buckets, self.words), ROW) if level == 2 else grouped.cogroup(self.answers.groupBy("chunk")).applyInArrow(_requests_above(level - 1, self.buckets, self.words), ROW)
            if level > 2:
                asked = asked.join(F.broadcast(self.classes[level - 1]))  # one row
            asked = self.asked[level] = asked.repartition(width, "bucket")
            self.classes[level] = asked.groupBy("bucket").applyInArrow(_gram_stats, CLASSES).agg(*(F.sum(f"n{r}").alias(f"n{r}") for r in range(1, K + 2)))
            answers = asked.groupBy("bucket").applyInArrow(_gram_bucket(level, self.buckets, level == order, self.words[2], whole), ROW).join(F.broadcast(self.classes[level]))  # one row
            answers = answers.repartition(width, "chunk")
            self.answers = answers if self.answers is None else self.answers.unionByName(answers)


def score(docs: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Fit on the rows where ``held_out`` is not true and score all rows.

    ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per input
    row; scores are log10 probabilities. A null or empty text is one end token. A null ``held_out``
    counts as training. With no training rows every token is the unknown type, of probability one.
    Texts are cut twice, in a task's order of rows, so shuffled rows are written first.
    """
    c = _Counts(docs, held_out, text, key, order, chunk_bytes)
    empty = docs.sparkSession.createDataFrame([], f"{ROW}, {CLASSES}")
    answers = (c.answers if c.answers is not None else empty).groupBy("chunk")
    return c.chunks.groupBy("chunk").cogroup(answers).applyInArrow(
        _score(order, c.buckets, c.words), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def _word_table(words_total: int, types: int, n1: list[int], buckets: int):
    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, v in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
                h, c = unpack(v.as_buffer())
                c = c.astype(np.int64)
                # ids as the bucket gave them: by count, equal counts by hash
                ident = _idents(c, b, buckets)
                p, _ = unigram(c, words_total, np.array(n1), types)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), b, np.int32)), pa.array(h.view(np.int64)), pa.array(ident), pa.array(c), pa.array(p)], names=["bucket", "hash", "id", "n", "p"])

    return run


COUNTED = "history long, word long, id long, n long, below double"


def _counted(buckets: int, step: int, n1: list[int]):
    """The n-grams of a bucket that occur in training, with their probability one level down."""

    @_words.lean
    def run(table: pa.Table) -> pa.Table:
        b = table["bucket"][0].as_py()
        _, _, history, at, w, total, lower, _ = _merge(table, _lower_classes(table, n1))
        h, on = history[at], total > 0
        return pa.table({"history": pa.array(_whole_id(h[on] * buckets + b, step)), "word": pa.array(w[on]), "id": pa.array(_idents(total, b, buckets)[on]), "n": pa.array(total[on]), "below": pa.array(lower[on])})

    return run


def save(docs: DataFrame, path: str, held_out: Column | None = None, text: str = "text", key: str = "doc_id", order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Fit on the rows where ``held_out`` is not true and store the model below ``path``.

    ``words`` (hash, id, n, p), and for each level ``grams`` (history, word, id, n, p) and
    ``histories`` (history, backoff), partitioned by level and bucket; ``model``: one row of totals.
    """
    c = _Counts(docs, F.lit(False) if held_out is None else held_out, text, key, order, chunk_bytes, whole=True)
    total, types, n1 = c.words
    unknown = unigram(np.zeros(1, np.int64), total, np.array(n1), types)[1]
    c.table.where("kind = 'table'").select("bucket", "blob").mapInArrow(_word_table(*c.words, c.buckets), "bucket int, hash long, id long, n long, p double").repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/words")
    for level in range(2, order + 1):
        row = c.classes[level].first()
        d = np.append(discounts(np.array([0, *(row[f"n{r}"] or 0 for r in range(1, K + 2))])), 1.0)
        grams = materialize(c.asked[level].groupBy("bucket").applyInArrow(_counted(c.buckets, _step(c.buckets, total), n1), COUNTED), "grams")
        cut = F.element_at(F.lit(d[1:].tolist()), F.least("n", F.lit(K + 1)).cast("int"))
        left = F.sum(F.when(F.col("n") <= K, F.col("n") * (1 - cut)).otherwise(0.0))
        keeps = F.bool_or(F.col("n") <= K)
        total_of = F.sum("n") + F.when(keeps, 0).otherwise(1)
        bucket = F.pmod("history", F.lit(c.buckets)).cast("int").alias("bucket")
        histories = grams.groupBy("history").agg(total_of.alias("size"), (F.when(keeps, left).otherwise(1.0) / total_of / F.greatest(1 - F.sum("below"), F.lit(LEAST))).alias("backoff"))
        histories = materialize(histories, "histories")
        histories.select(bucket, "history", "backoff").repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/histories/level={level}")
        sized = grams.join(histories.select("history", "size"), "history").select(bucket, "history", "word", "id", "n", (F.col("n") * cut / F.col("size")).alias("p"))
        sized.repartition("bucket", F.pmod("word", F.lit(8))).write.partitionBy("bucket").parquet(f"{path}/grams/level={level}")
    docs.sparkSession.range(1).select(F.lit(order).alias("order"), F.lit(total).alias("tokens"), F.lit(types).alias("types"), F.lit(float(unknown)).alias("unknown")).write.parquet(f"{path}/model")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = _words.utf8(batch.column(1))
        for i, j in _words.slices(off):
            h, _, _, first = _words.words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            n = np.diff(first) + 1
            row = np.repeat(np.asarray(batch.column(0).slice(i, j - i)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(place), pa.array(np.insert(h, first[1:], END).view(np.int64))], names=["row", "place", "hash"])


def score_saved(spark: SparkSession, docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, n_tokens, n_known, score)`` of any corpus under a model that ``save`` stored; one row per input row.

    Tokens meet the tables by joins, one level after the other; a null or empty text is one end token.
    """
    model = spark.read.parquet(f"{path}/model").first()
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "rows")
    words = spark.read.parquet(f"{path}/words").select("hash", F.col("id").alias("word"), "p")
    x = rows.select("row", "text").mapInArrow(_tokens, "row long, place long, hash long").join(words, "hash", "left")
    x = x.select("row", "place", F.coalesce("word", F.lit(0)).alias("word"), F.coalesce("p", F.lit(model.unknown)).alias("p")).withColumns({"id": F.col("word"), "known": F.col("word") > 0})
    before = Window.partitionBy("row").orderBy("place")
    for level in range(2, model.order + 1):
        start = F.lit(0 if level == 2 else None).cast("long")
        lag = F.lag("id").over(before)
        x = x.withColumn("history", F.when(F.col("place") == 0, start).when(lag > 0, lag)).drop("id")
        grams = spark.read.parquet(f"{path}/grams/level={level}").select("history", "word", "id", F.col("p").alias("seen"))
        histories = spark.read.parquet(f"{path}/histories/level={level}").select("history", "backoff")
        x = x.join(grams, ["history", "word"], "left").join(histories, "history", "left")
        x = x.select("row", "place", "word", "known", F.coalesce("seen", F.coalesce("backoff", F.lit(1.0)) * F.col("p")).alias("p"), F.coalesce("id", F.lit(0)).alias("id"))
    scored = x.groupBy("row").agg(F.count("*").alias("n_tokens"), F.count_if("known").alias("n_known"), F.sum(F.log10("p")).alias("score"))
    return rows.select("row", "doc_id").join(scored, "row").drop("row")


def op10_katz(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
