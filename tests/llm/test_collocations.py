"""Phrases equal those of a plain count of all n-grams, and the SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from strandloom.llm import collocations

SCHEMA = "doc_id long, text string, lang string, n long, phrase string"


def brute(rows, least=30, longest=4, top=2000, share=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    covered = set()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            covered |= {(lang, w[i : i + k]) for i in range(len(w) - k + 1) if 100 * a >= share * f[lang, w[i : i + k]]}
    found = defaultdict(list)
    for (lang, w), a in candidates.items():
        if (lang, w) not in covered:
            score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            found[lang].append((" ".join(w), a, left, right, score))
    out = []
    for lang, mine in found.items():
        mine.sort(key=lambda x: (-x[4], -x[1], x[0].encode()))
        out += [(lang, i + 1, phrase, a, left, right, n[lang], score) for i, (phrase, a, left, right, score) in enumerate(mine[:top])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, *r, 1, "old") for i, r in enumerate(rows)], SCHEMA)


def random_rows(n=250):
    rng = random.Random(11)
    words = ["the", "The", "a", "of", "É", "日本", "x'y", "\x00", " ", "\xff", "ÿ", "w" * 300] + [f"v{i}" for i in range(12)]
    rows = []
    for _ in range(n):
        text = " ".join(rng.choice(words[: rng.randint(2, len(words))]) + rng.choice(["", "", "", ".", ", ", "\n", "\t ", "!"]) for _ in range(rng.randint(0, 60)))
        rows.append((text if rng.random() > 0.05 else rng.choice([None, "", " \t.;"]), rng.choice(["en", "en", "en", "EN", None, ""])))
    return rows + [("New York City hall. ", "xx")] * 40 + [("of the new york times", "xx")] * 30 + [("a a a a a a", "yy")] * 10 + [("one two. three", "zz")] * 29


@pytest.mark.parametrize("size", [collocations.CHUNK_BYTES, 3000])
def test_against_plain_counts(spark, size):
    rows = random_rows()
    got = sorted(tuple(r) for r in collocations.collocations(table(spark, rows).repartition(3), chunk_bytes=size).collect())
    assert got == brute(rows)
    assert {r[0] for r in got} >= {"en", "und", "", "xx", "yy"} and "zz" not in {r[0] for r in got}


def test_parameters_few_buckets_and_empty_table(spark, monkeypatch):
    rows = random_rows(80)
    got = sorted(tuple(r) for r in collocations.collocations(table(spark, rows), min_count=4, longest=3, top=7, share=50).collect())
    assert got == brute(rows, 4, 3, 7, 50)
    assert collocations.collocations(table(spark, rows).limit(0)).count() == 0
    assert collocations.collocations(table(spark, [(None, "en"), ("a b", None)])).count() == 0


def test_passes_count_only_what_may_be_frequent(spark):
    """Phrases outside full buckets, or with a rare part, are not counted in later passes."""
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(" ".join(f"r{rng.randrange(10**9)}" for _ in range(200)) + " once upon a time", "en") for _ in range(40)]
    docs = table(spark, rows).select("lang", "text")
    chunks = docs.mapInArrow(collocations._cut(10**6), "blob binary")
    first = chunks.mapInArrow(collocations._pass(1, 4, 30, None, None), collocations.ROW).cache()
    full = spark.sparkContext.broadcast(collocations._bitmap(first.where("slot is not null").select("slot", "blob"), 30))
    words = first.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where("f >= 30")
    frequent = spark.sparkContext.broadcast(collocations._bitmap(words.select("lang", "phrase").mapInArrow(collocations._marks(1), collocations.ROW).select("slot", "blob"), 1))
    assert np.unpackbits(full.value).sum() == 3 and np.unpackbits(frequent.value).sum() == 4
    second = chunks.mapInArrow(collocations._pass(2, 4, 30, frequent, full), collocations.ROW).where("phrase is not null")
    assert {r.phrase for r in second.collect()} == {"once upon", "upon a", "a time"}


def test_query_equals_its_sql(spark, small):
    rows = collocations.op11_collocations(spark, small)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    cur = c.execute(collocations.ORACLE_SQL)
    assert [d[0] for d in cur.description] == rows.columns
    assert sorted(tuple(r) for r in rows.collect()) == sorted(cur.fetchall())
