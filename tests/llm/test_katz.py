"""The model against a plain one: scores, counts and sums to one."""

import math
import random
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import _words, katz
from strandloom.llm._pack import pack, unpack


def valid(d):
    return all(0 < x < 1 for x in d)


def good_turing(n, k=5):
    """Discounts of the counts 1 to k from the counts of counts n[1], n[2], ... by the textbook formula."""
    if not n[1]:
        return [0.0] * k
    top = (k + 1) * n[k + 1] / n[1]
    return [((r + 1) * n[r + 1] / n[r] / r - top) / (1 - top) if n[r] and top != 1 else 0.0 for r in range(1, k + 1)]


def discounts(counts, k=5):
    of = Counter(counts)
    n = [0] + [of[r] for r in range(1, k + 2)]
    d = good_turing(n)
    if not valid(d) and all(n[1:]):
        slope, start = statistics.linear_regression([math.log(r) for r in range(1, k + 2)], [math.log(x) for x in n[1:]])
        d = good_turing([0] + [math.exp(start + slope * math.log(r)) for r in range(1, k + 2)])
    return [1.0] + (d if valid(d) else [(r - 0.5) / r for r in range(1, k + 1)]) + [1.0]


class Plain:
    """The model of any order by dictionaries: histories are tuples, the first token's is the start mark."""

    def __init__(self, texts, order):
        self.order = order
        self.grams = [Counter() for _ in range(order + 1)]
        for t in texts:
            tokens = ["<s>", *self.tokens(t)]
            for i in range(1, len(tokens)):
                for n in range(1, min(order, i + 1) + 1):
                    self.grams[n][tuple(tokens[i - n + 1 : i + 1])] += 1
        self.one = {g[0]: c for g, c in self.grams[1].items()}
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.d = [None] + [discounts(self.grams[n].values()) for n in range(1, order + 1)]
        left = sum(c * (1 - self.d[1][min(c, 6)]) for c in self.one.values())
        self.left, self.total = (left, self.n) if left > 0 else (1.0, self.n + 1.0)
        self.after = defaultdict(list)
        for n in range(2, order + 1):
            for g, c in self.grams[n].items():
                self.after[g[:-1]].append((g[-1], c))

    @staticmethod
    def tokens(t):
        return [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"]

    def p(self, history, w):
        if not history:
            c = self.one.get(w, 0)
            return c * self.d[1][min(c, 6)] / self.total if c else self.left / self.total
        if history not in self.after:
            return self.p(history[1:], w)
        d, after = self.d[len(history) + 1], self.after[history]
        total, left = sum(c for _, c in after), sum(c * (1 - d[min(c, 6)]) for _, c in after)
        left, total = (left, total) if left > 1e-12 else (1.0, total + 1)
        c = self.grams[len(history) + 1].get((*history, w), 0)
        return c * d[min(c, 6)] / total if c else left / total / (1 - sum(self.p(history[1:], x) for x, _ in after)) * self.p(history[1:], w)

    def score(self, t):
        tokens = ["<s>", *self.tokens(t)]
        return sum(math.log10(self.p(tuple(tokens[max(0, i - self.order + 1) : i]), tokens[i])) for i in range(1, len(tokens)))


def check(df, pairs, held, order=3):
    model = Plain([t for d, t in pairs if not held(d)], order)
    got = katz.score(df, F.col("doc_id") % 5 == 1, order=order).collect()
    assert len(got) == len(pairs)
    texts = defaultdict(list)
    for d, t in pairs:
        texts[d].append(t)
    for r in got:
        tokens = [Plain.tokens(t) for t in texts[r.doc_id]]
        assert any(
            r.n_tokens == len(k) and r.n_known == sum(w in model.one for w in k) and r.score == pytest.approx(model.score(t), rel=1e-8)
            and r.base_score == pytest.approx(sum(math.log10((model.one.get(w, 0) + 0.5) / (model.n + 0.5 * (model.v + 1))) for w in k), rel=1e-9)
            for k, t in zip(tokens, texts[r.doc_id])
        )
        assert r.train_tokens == model.n and r.held_out == held(r.doc_id)
    return model


def test_documents(rows, documents):
    texts = [(d, (t or "")[:900]) for d, t in documents]
    model = check(rows(texts), texts, lambda d: d % 5 == 1)
    some = ["<s>", *list(model.one)[:6]]
    for history in [(h,) for h in some] + [g[:-1] for g in list(model.grams[3])[:6]]:
        assert sum(model.p(history, w) for w in model.one) + model.p(history, "\0") == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_other_orders(rows, documents, order):
    texts = [(d, (t or "")[:300]) for d, t in documents[:80]]
    check(rows(texts), texts, lambda d: d % 5 == 1, order)


def test_odd_rows(rows):
    pairs = [(1, None), (2, ""), (None, "A b"), (2, "a a b c d"), (6, "zz a")] + [(10 * i, "a b " * 30) for i in range(1, 5)]
    check(rows(pairs), pairs, lambda d: d is not None and d % 5 == 1)
    assert katz.score(rows(pairs).limit(0), F.lit(False)).count() == 0
    assert {(r.score, r.base_score) for r in katz.score(rows(pairs), F.lit(True)).collect()} == {(0.0, 0.0)}


def test_stored_tables_score_another_corpus(spark, rows, documents, tmp_path):
    texts = [(d, (t or "")[:300]) for d, t in documents]
    old, new = texts[:120], [*texts[120:], (9000, None), (9001, "words never seen anywhere before"), (None, texts[0][1])]
    katz.save(rows(old), f"{tmp_path}/model")
    model = Plain([t for _, t in old], 3)
    got = {r.doc_id: r for r in katz.score_saved(spark, rows(new), f"{tmp_path}/model").collect()}
    assert len(got) == len(new)
    for d, t in new:
        assert got[d].score == pytest.approx(model.score(t), rel=1e-8)
        assert (got[d].n_tokens, got[d].n_known) == (len(Plain.tokens(t)), sum(w in model.one for w in Plain.tokens(t)))
    stored = spark.read.parquet(f"{tmp_path}/model/grams/level=3")
    assert stored.agg(F.sum("n")).first()[0] == sum(model.grams[3].values())
    assert {r.bucket for r in stored.select("bucket").distinct().collect()} > {0}


def test_unknown_words_after_frequent_histories(rows):
    """Frequent histories are asked in parts; an unknown word after one keeps its own lower probability."""
    rng = random.Random(3)
    pairs = [(10 * i, " ".join(rng.choice("abcdefgh") for _ in range(400))) for i in range(12)]
    pairs += [(10 * i + 1, " ".join(f"{w} new{i}{w}" for w in "abcdefgh") + " a b" * 20) for i in range(2)]
    check(rows(pairs).coalesce(1), pairs, lambda d: d % 5 == 1)


def test_orders_are_stable():
    for a in ([], [5], [3, 1, 3, 0, 1], [1 << 61, 7, 1 << 61], list(range(3000, 0, -1)) + [4] * 3000):
        a = np.array(a, np.int64)
        order, ordered = _words.order_of(a)
        assert order.tolist() == np.argsort(a, kind="stable").tolist() and ordered.tolist() == sorted(a.tolist())


def test_packed_numbers_come_back():
    for dtype in (np.uint8, np.uint32, np.int64, np.uint64, np.float64):
        arrays = [np.array(x, np.float64).astype(dtype) for x in ([], [0, 0], [1, 255, 3], [70000 % (256 if dtype is np.uint8 else 10**6), 1])]
        back = unpack(pack(*arrays))
        assert [(x.dtype, x.tolist()) for x in back] == [(x.dtype, x.tolist()) for x in arrays]
    odd = [np.array([-1, 5]), np.array([-0.5, np.inf, 1e-300]), np.array([2**64 - 1, 0], np.uint64)]
    assert [x.tolist() for x in unpack(pack(*odd))] == [x.tolist() for x in odd]
