"""The audit equals sums over all terms of all pairs, and its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from strandloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, rank int"


def brute(rows, min_docs=3, top=200):
    counts, holders, groups = defaultdict(Counter), Counter(), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", folded)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        holders.update((lang, t) for t in set(terms))
    out = []
    for lang, source in groups:
        kept = [t for (g, t), n in holders.items() if g == lang and n >= min_docs]
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(counts[g])

        def prices(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        mine, everyone = prices(counts[lang, source]), prices(whole)
        pairs = [(sum((mine[t] - q[t]) ** 2 // q[t] for t in kept), g[1]) for g in groups if g[0] == lang and g[1] != source for q in [prices(counts[g])]]
        marked = [((mine[t] - everyone[t]) ** 2 // everyone[t], t) for t in kept if counts[lang, source][t] and mine[t] > everyone[t]]
        for part, found, most in (("pair", pairs, None), ("term", marked, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "old", 7) for i, r in enumerate(rows)], SCHEMA)


def random_rows(n=300):
    rng = random.Random(3)
    words = ["the", "The", "a'b", "é", "ÉÉ", "x1y", "日本", "zz", "\x00q", "long" * 50] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 5 + ["s1", "s2", "s3", None, ""])
        rows.append((rng.choice([None, ""]) if i % 17 == 0 else " ".join(rng.choice(words[: rng.randint(2, len(words))]) for _ in range(rng.randint(1, 40))), rng.choice(["en", "en", "de", None]), source))
    return rows + [("only here", "xx", "s1"), ("", "yy", "s1"), (None, "yy", "s2"), ("lone lone", "yy", "s3")] + [("same words again", "zz", "s1")] * 4


@pytest.mark.parametrize("max_groups", [divergence.MAX_GROUPS, 0])
def test_against_all_terms(spark, monkeypatch, max_groups):
    monkeypatch.setattr(divergence, "HELD", 40)
    rows = random_rows()
    got = sorted(tuple(r) for r in divergence.audit(table(spark, rows), max_groups=max_groups).collect())
    assert got == brute(rows)


def test_parameters_and_empty_table(spark):
    rows = random_rows(60)
    got = sorted(tuple(r) for r in divergence.audit(table(spark, rows), min_docs=1, top=3).collect())
    assert got == brute(rows, 1, 3)
    assert divergence.audit(table(spark, rows).limit(0)).count() == 0


def test_shared_terms_are_joined_and_others_priced(spark):
    """Two groups with one term in common and many of their own: values of both orders differ and are exact."""
    rows = [("common " + " ".join(f"a{chr(97 + i)}" for i in range(20)), "en", "a")] * 3 + [("common common " + " ".join(f"b{chr(97 + i)}" for i in range(5)), "en", "b")] * 3
    got = sorted(tuple(r) for r in divergence.audit(table(spark, rows)).collect())
    assert got == brute(rows)
    pairs = {r[1]: r[4] for r in got if r[2] == "pair"}
    assert pairs["a"] != pairs["b"]


def test_query_equals_its_sql(spark, small):
    rows = divergence.op12_divergence(spark, small)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    cur = c.execute(divergence.ORACLE_SQL)
    assert [d[0] for d in cur.description] == rows.columns
    assert sorted(tuple(r) for r in rows.collect()) == sorted(cur.fetchall())
