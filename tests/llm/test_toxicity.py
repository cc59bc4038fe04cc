"""Toxicity: held-out accuracy, and defined scores for odd rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import toxicity


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    clean = got[got.toxic == 0]
    assert (clean.predicted == 0).mean() > 0.95
    assert got[got.toxic == 1].score.mean() > 5 * clean.score.mean()


def test_odd_rows(spark, rows):
    df = rows([(1, None), (2, ""), (None, "idiot"), (2, "x" * 200_000)])
    none = toxicity.fit(df, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"), F.lit(True))
    assert [r.score for r in toxicity.score(df, none).collect()] == [0.5] * 4
    assert toxicity.score(df.limit(0), none).count() == 0


def test_separates_planted_words(spark):
    pairs = [(i, f"plain words number {i} go here" + (" you clown" if i % 3 == 0 else "")) for i in range(120)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in pairs], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, F.col("doc_id") % 2 == 0)
    assert all((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in toxicity.score(df, model).collect())


def one_hash(gram):
    raw = np.frombuffer(gram.encode(), np.uint8)
    return int(next(toxicity.gram_hashes(raw, np.array([0, len(raw)]), (len(gram),)))[1][0])


def test_scores_by_plain_sets_of_characters(spark, documents):
    """Counts, log-count ratios and scores against sets of code point n-grams of short texts."""
    pairs = [(d, (t or "")[:300]) for d, t in documents[:60]] + [(10_000, "Ünïcödé ÜNÏ 漢字漢字 you clown"), (10_001, "é"), (10_002, "漢字")]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    toxic = {d: int(d % 3 == 0) for d, _ in pairs}
    model = toxicity.fit(df, spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"), F.lit(True), features=10**6)
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sets = {d: {fold(t)[i : i + n] for n in toxicity.SIZES for i in range(len(t) - n + 1)} for d, t in pairs}
    held = {}
    for d, grams in sets.items():
        for g in grams:
            held.setdefault(g, [0, 0])[toxic[d]] += 1
    kept = sorted(one_hash(g) for g, n in held.items() if sum(n) >= toxicity.MIN_DF)
    assert model.grams.tolist() == kept
    weight = dict(zip(model.grams.tolist(), model.weight.tolist()))
    for r in toxicity.score(df, model).collect():
        z = model.bias + sum(weight.get(one_hash(g), 0.0) for g in sets[r.doc_id])
        assert abs(r.score - 1 / (1 + math.exp(-max(min(z, 500), -500)))) < 1e-9


def test_repeated_rows_and_clashing_columns(spark):
    pairs = [(1, "you clown you clown", "a", 0.1)] * 2 + [(2, "a friendly line", "b", 0.2), (3, "you clown again", "c", 0.3), (4, "friendly line again", "d", 0.4)]
    df = spark.createDataFrame(pairs, "doc_id long, text string, y string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1), (4, 0)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit(df, labels, F.lit(True), min_df=1)).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 3, 4]
    assert all((r.score > 0.5) == (r.doc_id in (1, 3)) for r in got)


def test_passages():
    rng = np.random.default_rng(5)
    texts = ["", "short", "x" * 95, "é" * 50, "word " * 40, "日本語 " * 30, "a" * 30 + " " + "b" * 200, ""] + ["".join(rng.choice(list("ab é日\n"), int(rng.integers(0, 300)))) for _ in range(60)]
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    cut, first = toxicity.passages(np.frombuffer(b"".join(raw), np.uint8), off, 40)
    begins = [*first.tolist(), len(cut) - 1]
    joined = b"".join(raw)
    for t, a, b in zip(raw, begins[:-1], begins[1:]):
        parts = [joined[cut[k] : cut[k + 1]] for k in range(a, b)]
        assert b"".join(parts) == t and len(parts) >= 1
        assert all(len(p) <= 43 and p.decode() is not None for p in parts)
        assert len(t) <= 40 or all(parts)


def test_clean_text_does_not_bury_a_toxic_passage(spark):
    """Held-out toxic texts stay caught with twenty clean ones behind them, long clean ones stay clean; accuracy by length."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.fit(docs, labels, ~held_out)
    held = docs.where(held_out).join(labels, "doc_id").select("doc_id", "text", "toxic").toPandas()
    rng = np.random.default_rng(1)
    clean, toxic = held[held.toxic == 0].text.tolist(), held[held.toxic == 1].text.tolist()
    more = lambda k: "\n".join(clean[i] for i in rng.integers(0, len(clean), k))
    rows = [(i, t) for i, t in enumerate(held.text)] + [(10_000 + i, f"{t}\n{more(20)}") for i, t in enumerate(toxic)] + [(20_000 + i, more(21)) for i in range(100)]
    got = {r.doc_id: r.score >= 0.3 for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    alone = np.array([got[i] for i, y in enumerate(held.toxic) if y])
    buried = np.array([got[10_000 + i] for i in range(len(toxic))])
    assert alone.mean() > 0.8 and buried[alone].mean() > 0.97
    assert np.mean([got[20_000 + i] for i in range(100)]) < 0.1
    right = np.array([got[i] == bool(y) for i, y in enumerate(held.toxic)])
    for part in np.array_split(np.argsort(held.text.str.len().to_numpy()), 4):
        assert right[part].mean() > 0.95
