"""Base spans against Python's patterns; long runs stay linear; trees equal their expression."""

import re

from pyspark.sql import functions as F

from strandloom.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(q) <= 255 for q in m[0].split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]():
                out.append((m.start(), k, m.end()))
    return sorted(out)


def check(df, pairs):
    expected = sorted((str(d), brute(t)) for d, t in pairs)
    got = pii.detect(df).collect()
    assert sorted((str(r.doc_id), [tuple(x) for x in r.base]) for r in got) == expected
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in got)


def test_documents(rows, documents):
    check(rows(documents), documents)


def test_odd_texts(rows):
    texts = [
        "a@b.c+x@d.e", "a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "01.0255.3.4 000001.2.3.4", "+1 (23) 456-78-90 12", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "é😀x@y.zz 😀 +49 30 1234567", "9" * 30000, "1 " * 20000,
        "a." * 20000 + "@x" + ".b" * 20000, "x" * 50000, "+" * 5000 + "1234567890", None, "", "@" * 1000, "a@b..c", "me (at) example (dot) com call 030 1234 5678",
    ]
    pairs = list(enumerate(texts))
    check(rows(pairs), pairs)
    assert pii.detect(rows(pairs).limit(0)).count() == 0


def test_trees_as_expression(spark):
    vectors = [(0, 4, 0, 0, 0, 2, 0, 2, 0, 1), (2, 4, 1, 0, 0, 5, 1, 5, 1, 2), (1, 2, 0, 1, 1, 0, 0, 0, 2, 3), (2, 6, 2, 0, 2, 1, 0, 3, 3, 5)]
    cells = [(x, n, p) for x, (n, p) in zip(vectors, ((90.0, 88.0), (70.0, 1.0), (30.0, 15.0), (5.0, 5.0)))]
    model = pii.Boosted.fit(cells)
    df = spark.createDataFrame(vectors, list(pii.FEATURES)).select(F.struct(*pii.FEATURES).alias("x"))
    got = [r[0] for r in df.select(model.column(F.col("x"))).collect()]
    assert all(abs(a - model.predict(c[0])) < 1e-12 for a, c in zip(got, cells))
    assert got[0] > 0.9 > 0.1 > got[1]
    assert model.predict(cells[2][0]) < pii.threshold(model, cells, 0.9) <= model.predict(cells[0][0])


def added(rows):
    return {r.doc_id: [tuple(x) for x in r.spans if x not in r.base] for r in rows}


def test_precision_and_recall_of_additions(spark):
    fresh = pii.examples(spark, 1200, seed=31)
    got = {r.doc_id: r for r in pii.detect(fresh.withColumnRenamed("place", "doc_id")).collect()}
    new = added(got.values())
    true, right, wrong = [0] * 5, [0] * 5, [0] * 5
    for r in fresh.collect():
        covers = lambda x, r=r: x[1] == r.kind and x[0] <= r.s and x[2] >= r.e
        for x in new[r.place]:
            wrong[x[1]] += not covers(x)
        if r.kind >= 0 and not any((b.s < r.e) and (r.s < b.e) for b in got[r.place].base):
            true[r.kind] += 1
            right[r.kind] += any(map(covers, new[r.place]))
    for t, k, w in zip(true, right, wrong):
        assert k >= 0.9 * t > 20
        assert k >= 0.9 * (k + w)


def test_planted_forms(rows):
    texts = {
        "write to jane.doe (at) example (dot) org today": "jane.doe (at) example (dot) org", "host 192[.]168[.]1[.]77 is up": "192[.]168[.]1[.]77", "card 4111.1111.1111.1111 expired": "4111.1111.1111.1111",
        "ref 12 4111111111111111 2024 paid": "4111111111111111", "phone: (030) 555-0123 after six": "(030) 555-0123", 'token = "0123456789abcdef0123456789abcdef01234567"': "0123456789abcdef0123456789abcdef01234567",
        "released on 2021-03-04 as planned": None, "order 4111.1111.1111.1112 shipped": None, "commit 0123456789abcdef0123456789abcdef01234567 is good": None, "3 @ 4.99 each": None, "isbn 978-3-16-148410-0": None,
    }
    got = added(pii.detect(rows(list(enumerate(texts)))).collect())
    for i, (text, want) in enumerate(texts.items()):
        assert [text[s:e] for s, _, e in got[i]] == ([want] if want else []), text


def test_additions_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    new = [(texts[d][max(0, s - 20) : s], k, texts[d][s:e]) for d, spans in added(pii.detect(docs).collect()).items() for s, k, e in spans]
    assert len(new) > 5
    assert all((k == 4 and "token" in before) or (k == 2 and luhn(item)) for before, k, item in new)
