"""Encoding equals the tokenizer library's; decoding gives the text back."""

import random
import time

import numpy as np
import pyarrow as pa
import regex

from strandloom.llm import _words, bpe


def test_documents(spark, rows, documents):
    path, pattern = bpe.default_ranks()
    encoder = bpe._encoder(bpe.read_ranks(path), pattern)
    texts = dict(documents)
    got = bpe.decode(bpe.encode(rows(documents), path, pattern, chunk_chars=100_000), path).collect()
    assert len(got) == len(documents)
    for r in got:
        assert list(r.ids) == encoder.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded).decode() == texts[r.doc_id]


def test_odd_cases(rows):
    path, pattern = bpe.default_ranks()
    encoder = bpe._encoder(bpe.read_ranks(path), pattern)
    texts = [None, "", "it's  a\n\n test é 12", "<|endoftext|>", "​\x00 \t\r\n", "x" * 5000, "'ll 're''s", "日本語のテキスト 😀"]
    got = bpe.decode(bpe.encode(rows([(None if i == 2 else i, t) for i, t in enumerate(texts)]), path, pattern), path).collect()
    assert {(r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got} == {(None if i == 2 else i, tuple(encoder.encode_ordinary(t or "")), (t or "").encode()) for i, t in enumerate(texts)}
    assert bpe.encode(rows([(1, "a")]).limit(0), path, pattern).count() == 0


def test_shuffled_rows_and_a_column_named_decoded(rows, documents):
    path, pattern = bpe.default_ranks()
    texts = dict(documents)
    coded = bpe.encode(rows(documents).repartition(5, "text").dropDuplicates(["text"]), path, pattern, chunk_chars=50_000)
    got = bpe.decode(coded.selectExpr("*", "'old' AS decoded"), path).collect()
    assert len(got) == len(set(texts.values()))
    assert all(bytes(r.decoded).decode() == texts[r.doc_id] for r in got)


def test_cuts_are_the_matches_of_the_pattern():
    find = regex.compile(bpe.CLASS_PATTERN).findall
    draw = random.Random(7)
    signs = ["'\u2019strevmldAB09\u00bd \t\n\r\x0b\x1c\x85\xa0\u3000.,!\"\u00e9\u65e5\U0001f600\x00_\u0301", "'strevmld", "' \ns", "'  \tll a"]
    for _ in range(3000):
        texts = ["".join(draw.choices(draw.choice(signs), k=draw.randint(0, 12))) for _ in range(draw.randint(0, 6))] + [None]
        buf, off = _words.utf8(pa.array(texts, pa.string()))
        start, end, counts = bpe._cut_by_classes(buf, off)
        assert [buf[a:b].tobytes().decode() for a, b in zip(start, end)] == [w for t in texts for w in find(t or "")], texts
        assert counts.tolist() == [len(find(t or "")) for t in texts]


def test_a_split_costs_less_than_the_matches_of_its_pattern(documents, monkeypatch):
    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = classmethod(lambda cls: 0)

    monkeypatch.setattr(bpe, "TaskContext", Task)
    pattern = bpe.default_ranks()[1]
    find = regex.compile(pattern).findall
    texts = [t or "" for _, t in documents]
    texts *= 1 + 2_000_000 // sum(map(len, texts))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    taken = {"split": [], "find": []}
    for _ in range(4):  # the first is a warm-up
        for name, work in (("split", lambda: list(bpe._split(pattern, 16, 8_000_000, "docs")(iter([batch])))), ("find", lambda: [find(t) for t in texts])):
            begun = time.process_time()
            work()
            taken[name].append(time.process_time() - begun)
    assert min(taken["split"][1:]) < min(taken["find"][1:])


def test_different_words_of_one_hash(rows):
    path, pattern = bpe.default_ranks()
    # the words of Thue and Morse agree under every polynomial modulo 2^64
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = word.translate({97: "b", 98: "a"})
    assert len({int(bpe._hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in (word, other)}) == 1
    encoder = bpe._encoder(bpe.read_ranks(path), pattern)
    texts = [word, f"{other}.{word}", other, "long text, " * 50_000]
    got = {r.doc_id: list(r.ids) for r in bpe.encode(rows(list(enumerate(texts))), path, pattern).collect()}
    assert got == {i: encoder.encode_ordinary(t) for i, t in enumerate(texts)}


def test_other_patterns(rows):
    path, _ = bpe.default_ranks()
    texts = ["ab caf\u00e9 12, ab", "\u65e5\u672c 7x", "", None, "...", "abab ba"]
    for pattern in (r"\w+", r"(a|b)+|\S", r"\s+|\S+"):
        encoder = bpe._encoder(bpe.read_ranks(path), pattern)
        got = {r.doc_id: list(r.ids) for r in bpe.encode(rows(list(enumerate(texts))), path, pattern).collect()}
        assert got == {i: encoder.encode_ordinary(t or "") for i, t in enumerate(texts)}
