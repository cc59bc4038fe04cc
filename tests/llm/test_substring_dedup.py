"""Repeated passages against all windows in a dictionary."""

import numpy as np

from strandloom.llm.substring_dedup import anchor_runs, has_previous_factor, remove_repeats, suffix_order

LENGTH = 50


def brute(pairs):
    key = lambda d: 1 << 62 if d is None else d
    first = {}
    for d, t in pairs:
        b = (t or "").encode()
        for i in range(len(b) - LENGTH + 1):
            first[b[i : i + LENGTH]] = min(first.get(b[i : i + LENGTH], 1 << 63), key(d))
    out = []
    for d, t in pairs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - LENGTH + 1):
            if first[b[i : i + LENGTH]] < key(d):
                gone[i : i + LENGTH] = b"\1" * LENGTH
        out.append((d, len(b), bytes(c for c, g in zip(b, gone) if not g)))
    return out


def order(x):
    return (x[0] is None, x[0] or 0, x[1:])


def result(df):
    return sorted(((r.doc_id, r.n_bytes, bytes(r.kept)) for r in remove_repeats(df).collect()), key=order)


def test_documents(rows, documents):
    assert result(rows(documents)) == sorted(brute(documents), key=order)


def test_odd_cases(rows):
    pairs = [(1, "a" * 200), (2, "a" * 120), (None, "a" * 60), (3, None), (4, ""), (5, "é" * 40), (6, "x" + "é" * 40), (6, "x" + "é" * 40), (7, "ab" * 30 + "z" * 49), (8, "q" + "ab" * 30), (9, "z" * 49), (10, "z" * 5000)]
    assert result(rows(pairs)) == sorted(brute(pairs), key=order)
    assert result(rows(pairs).limit(0)) == []


def test_previous_factors():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 99, 400).astype(np.uint8)
    at, keys = np.arange(0, 380), rng.integers(0, 5, 380)
    order_, same = suffix_order(buf, at, 16, keys)
    got = has_previous_factor(order_, same, keys)
    text = buf.tobytes()
    for i in range(380):
        assert got[i] == any(keys[j] < keys[i] and text[j : j + 16] == text[i : i + 16] for j in range(380))


def test_rules_beside_own_text(rows):
    pairs = [(i, f"text number {i} begins {i * 7919}" + "-" * 30 + f" and goes on with {i * 104729} of its own" + " " * (40 + i % 3) + "=-" * 20) for i in range(200)]
    assert result(rows(pairs)) == sorted(brute(pairs), key=order)
    # a rule is the anchor of windows that hold nothing else only
    raw = np.frombuffer(b"some words stand before " + b"-" * 40 + b" and after the rule there are others", np.uint8)
    start, count, _ = anchor_runs(raw, np.array([0, len(raw)]))
    rule = np.concatenate([anchor_runs(np.frombuffer(b"-" * 60, np.uint8), np.array([0, 60]))[2]])
    assert not set(anchor_runs(raw, np.array([0, len(raw)]))[2].tolist()) & set(rule.tolist())
    assert count.sum() == len(raw) - LENGTH + 1 and start[0] == 0


def test_small_chunks(rows, documents):
    few = documents[:60]
    got = sorted(((r.doc_id, r.n_bytes, bytes(r.kept)) for r in remove_repeats(rows(few), chunk_bytes=5000).collect()), key=order)
    assert got == sorted(brute(few), key=order)


def test_case_counts(rows):
    head = "The and attion to thanedble the, anea. Eriner thanea. "
    pairs = [(7, head + "The end"), (66, head + "THE end"), (80, head + "The end")]
    assert result(rows(pairs)) == sorted(brute(pairs), key=order)
