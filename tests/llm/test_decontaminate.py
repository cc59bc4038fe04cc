"""Decontamination against full alignments."""

import numpy as np
import pyarrow as pa

from strandloom.llm import _words, decontaminate
from strandloom.llm.decontaminate import align, contaminated, without_contaminated


def hashes(text):
    return _words.words(*_words.utf8(pa.array([text])))[0]


def plain(a, b):
    """Smith-Waterman score by the textbook."""
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h.max())


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (rng.integers(0, 6, n).astype(np.uint64) for n in rng.integers(1, 25, 2))
        score, s, e = align(a, b)
        assert score == plain(a, b)
        assert not score or plain(a, b[s:e]) == score


def test_all_strong_copies_are_found(spark, small, documents):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    texts = {d: hashes(t) for d, t in documents}
    for r in items.collect():
        w = hashes(r.text)
        for d, h in texts.items():
            if len(np.intersect1d(w, h)) >= 0.5 * len(np.unique(w)):
                assert (decontaminate._best_end(w, h)[0] >= len(w)) == ((d, r.item_id) in got)


def test_edited_copies_and_odd_rows(spark, rows):
    words = [f"word{i}" for i in range(40)]
    item = " ".join(words)
    edited = " ".join(w if i % 9 else "other" for i, w in enumerate(words) if i % 13)
    docs = rows([(1, None), (2, ""), (None, "pre " + item + " post"), (4, "a b"), (4, "a b"), (5, "x y " * 50 + edited + " z" * 60), (6, "word0 word1 word2 and nothing else")])
    items = spark.createDataFrame([(3, item), (None, "a"), (5, "a b"), (6, None), (7, " ")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.score == 1.0) for r in contaminated(docs, items).collect())
    assert got == [("4", 5, True), ("4", 5, True), ("5", 3, False), ("None", 3, True)]
    assert sorted(r.doc_id for r in without_contaminated(docs, items).collect()) == [1, 2, 6]
    assert contaminated(docs.limit(0), items).count() == contaminated(docs, items.limit(0)).count() == 0


def test_item_in_most_texts_is_still_found(spark, rows):
    item = " ".join(f"w{i}" for i in range(30))
    docs = rows([(i, f"intro {i} {item} outro {i}" if i % 4 else f"clean text {i}") for i in range(80)])
    got = contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [i for i in range(80) if i % 4]


def test_one_copy_with_every_sixth_word_replaced(spark, rows):
    words = [f"w{i}" for i in range(59)]
    edited = [w if i % 6 != 1 else f"other{i}" for i, w in enumerate(words)]
    got = contaminated(rows([(1, "intro " + " ".join(edited) + " outro"), (2, "w0 w1 w2 and nothing else")]), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"))
    assert [(r.doc_id, r.item_id, r.score) for r in got.collect()] == [(1, 1, (2 * 49 - 10) / 118)]


def test_no_run_of_three_words_is_left(spark, rows):
    """Every third word is replaced, or a word stands between all others: no 3-gram, or no 2-gram, of the item survives."""
    words = [f"w{i}" for i in range(59)]
    replaced = [w if i % 3 != 2 else f"other{i}" for i, w in enumerate(words)]
    spread_out = [x for i, w in enumerate(words) for x in (w, f"new{i}")][:-1]
    filler = " ".join(f"f{i}" for i in range(40))
    docs = rows([(1, f"{filler} {' '.join(replaced)} {filler}"), (2, f"{filler} {' '.join(spread_out)} {filler}"), (3, filler)])
    got = {r.doc_id: r.score for r in contaminated(docs, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()}
    assert got == {1: 61 / 118, 2: (2 * 59 - 58) / 118}


def test_random_edits_against_full_alignments(spark, rows):
    """Whatever the edits, a copy is found if and only if its best alignment reaches the share, also where seeds are common."""
    rng = np.random.default_rng(7)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [[str(rng.choice(vocabulary)) for _ in range(int(rng.integers(3, 40)))] for _ in range(12)]
    texts = []
    for k in range(240):
        words, rate, out = items[k % 12], rng.uniform(0, 0.6), []
        for w in words:
            edit = rng.random()
            if edit < rate / 3:
                out += [str(rng.choice(vocabulary))]
            elif edit < 2 * rate / 3:
                out += [w, str(rng.choice(vocabulary))]
            elif edit >= rate:
                out += [w]
        around = lambda: [str(rng.choice(vocabulary)) for _ in range(int(rng.integers(0, 60)))]
        texts.append((k, " ".join(around() + out + around())))
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(rows(texts), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()}
    wanted = {}
    for k, t in texts:
        for i, w in enumerate(items):
            score = decontaminate._best_end(hashes(" ".join(w)), hashes(t))[0]
            if score >= len(w):
                wanted[k, i] = score / (2 * len(w))
    assert got == wanted and 100 < len(wanted) < len(texts) * len(items)


def test_frequent_seeds_are_left_out():
    block = decontaminate.index_block(np.array([1, 2]), pa.array(["a b c d e f g h", "a b c x y z u v"]))
    common = np.where(np.isin(block.grams, [decontaminate.seeds_of(hashes("a b c"))[1][1][0]]), 1000, 1)
    rare = block.rare(common, 0.5)
    # eight words: of at least three seeds that a copy holds two are spared
    assert len(rare.item) == len(block.item) - 4
    assert decontaminate.seeds_of(hashes("a b c"))[1][1][0] not in rare.grams
