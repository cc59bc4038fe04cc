"""Line dedup against a plain join over an inverted index."""

from collections import defaultdict

import numpy as np
import pyarrow as pa

import corpus_pipeline
from strandloom.llm import _words, line_dedup
from strandloom.llm.line_dedup import dedup_lines, op1_line_dedup


def brute(pairs, num=80, den=100, min_words=3):
    pairs = sorted(pairs, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    words = [tuple(line.encode().lower().split()) for _, t in pairs for line in (t or "").split("\n")]
    lines = [frozenset(w) for w in words]
    index, kinds, links = defaultdict(list), set(), [0] * len(lines)
    for i, s in enumerate(lines):
        if len(s) >= min_words:
            if words[i] in kinds:
                links[i] = 1
                continue
            kinds.add(words[i])
            shared = defaultdict(int)
            for w in s:
                for j in index[w]:
                    shared[j] += 1
                index[w].append(i)
            links[i] = sum(den * n >= num * (len(s) + len(lines[j]) - n) for j, n in shared.items())
    out, i = [], 0
    for d, t in pairs:
        own = (t or "").split("\n")
        mine = links[i : i + len(own)]
        out.append((d, len(own), sum(mine), [k for k, n in enumerate(mine) if n], "\n".join(x for x, n in zip(own, mine) if not n)))
        i += len(own)
    return out


def order(x):
    return (x[0] is None, x[0] or 0, x[4], x[1:4])


def result(df):
    return sorted(map(tuple, dedup_lines(df, min_words=3).collect()), key=order)


def test_documents(rows, documents):
    assert result(rows(documents)) == sorted(brute(documents), key=order)


def test_odd_cases(rows):
    long = " ".join(f"w{i}" for i in range(300))
    pairs = [
        (1, "a b c d e\n\na b c d e f\nx"), (2, "A B C D E"), (None, "a b c d e"), (3, None), (4, ""), (5, "\n\n"), (6, "p q r s\nu v w"), (6, "p q r s\nu v w"), (7, "w v u\n"),
        (8, "a b d e f g h i j"), (9, "a b d e f g h i k"), (None, "a b d e f g h i k\nq"), (10, long), (11, long + " y z"), (12, long.replace("w1", "v1")), (13, " ".join(f"w{i}" for i in range(100))), (14, " ".join(f"w{i}" for i in range(110))),
    ]
    assert result(rows(pairs)) == sorted(brute(pairs), key=order)


def test_frequent_line(rows):
    pairs = [(i, f"this line is everywhere\nown {i} words of {i * 7} document") for i in range(400)]
    assert result(rows(pairs)) == sorted(brute(pairs), key=order)


def test_empty_table(rows):
    assert result(rows([(1, "a")]).limit(0)) == []


def test_short_lines_take_part_in_the_query_and_the_pipeline(spark, tmp_path):
    chars = "\u4e00\u4e8c\u4e09" * 20
    pairs = [(1, f"And ornd.\nx x\n\n{chars}"), (2, "And ornd.\nx\n\nonly here"), (3, f"ornd. and\n \nx y\n{chars}\nand ornd. more"), (4, "z z y " * 30 + "\ny z\nx y z")]
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in pairs], "doc_id long, text string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(pairs, min_words=1)
    assert [w[3] for w in want] == [[], [0, 1], [0, 3], [1]]
    got = op1_line_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_lines, r.n_links, r.removed_lines) for r in got] == [(d, n, links, ",".join(map(str, gone))) for d, n, links, gone, _ in want]
    assert [r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path)).orderBy("doc_id").collect()] == [w[4] for w in want]


def test_documents_with_short_lines(rows, documents):
    got = sorted(map(tuple, dedup_lines(rows(documents)).collect()), key=order)
    assert got == sorted(brute(documents, min_words=1), key=order)


def test_lines_of_one_template(rows):
    pairs = [(i, f"licence of the year {i} by all the many authors of this work\nlicence of year {i % 9} {i} by all the many authors") for i in range(300)]
    assert result(rows(pairs)) == sorted(brute(pairs), key=order)


def test_pairs_are_verified_alike_in_blocks_of_any_size(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["\n".join(" ".join(f"w{w}" for w in rng.integers(0, 12, rng.integers(1, 30))) for _ in range(40)) for _ in range(2)]
    x = line_dedup._Lines(pa.table({"doc_id": pa.array([1, 2]), "text": pa.array(texts)}))
    which, line = (v.ravel() for v in np.meshgrid(np.arange(40), np.arange(40, 80)))
    sets = x.sets(np.arange(40))
    size, flat = np.array([len(s) for s in sets]), np.concatenate(sets)
    words = [set(t.split()) for text in texts for t in text.split("\n")]
    want = [100 * len(words[a] & words[b]) >= 80 * len(words[a] | words[b]) for a, b in zip(which.tolist(), line.tolist())]
    assert 0 < sum(want) < len(want)
    for block in (1, 50, 1 << 21):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        assert line_dedup._similar(x, size, flat, which, line, 80, 100).tolist() == want


def test_order_of_hashes():
    rng = np.random.default_rng(5)
    for a in (np.empty(0, np.uint64), rng.integers(0, 2**63, 1000).astype(np.uint64), rng.integers(0, 5, 1000).astype(np.uint64), rng.integers(0, 300, 1000).astype(np.uint64) << np.uint64(56)):
        assert _words.sort_order(a).tolist() == np.argsort(a, kind="stable").tolist()
        uniq, number, n = _words.codes(a)
        assert (uniq[number] == a).all() and n.sum() == len(a) and (uniq[1:] > uniq[:-1]).all() if len(a) else not len(uniq)


def test_long_lines_near_the_threshold(rows):
    """Lines that have one, two and four bitmaps, with as many words changed as 0.8 allows, and one more."""
    rng = np.random.default_rng(9)
    pairs, key = [], 0
    for n in (20, 79, 80, 81, 150, 200, 201, 260):
        words = [f"w{w}" for w in rng.choice(5000, n, replace=False)]
        for change in (0, n // 9, n // 9 + 1):
            pairs.append((key, " ".join([f"c{key}x{i}" for i in range(change)] + words[change:])))
            key += 1
    assert result(rows(pairs)) == sorted(brute(pairs), key=order)
