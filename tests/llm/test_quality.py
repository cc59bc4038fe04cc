"""Quality: labels are met, sites shrink, odd rows are defined."""

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from strandloom.llm import quality


def test_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 0)
    judged = quality.judge(docs, model, *quality.sites_of_documents()).select("doc_id", (F.col("quality") >= 0.5).cast("int").alias("kept"))
    held = judged.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 3 = 0").toPandas()
    assert (held.kept == held.quality)[held.quality == 1].mean() > 0.99
    assert (held.kept == held.quality)[held.quality == 0].mean() > 0.8


def test_sparse_sites_stay_near_the_global_share(spark):
    good, bad = "these are quiet words in a row", "BUY!! NOW!! $$$ ###"
    pairs = [(i, bad if i % 2 else good, "good" if i % 2 == 0 else "bad") for i in range(200)] + [(1000, bad, "single")]
    df = spark.createDataFrame(pairs, "doc_id long, text string, host string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(200)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(df, quality.fit(df, labels), F.col("host"), F.col("host")).collect()}
    assert got[0].site_p > 0.9 > 0.1 > got[1].site_p
    assert got[1].site_p < got[1000].site_p < got[0].site_p
    assert got[0].quality > 0.5 > got[1].quality


def strength(groups):
    groups = [(n, s, m) for n, s, m in groups if n > 1]
    total = sum(n for n, _, _ in groups)
    if not total:
        return 100.0
    between = sum(n * (s / n - m) ** 2 for n, s, m in groups)
    v = sum(n * m * (1 - m) for n, _, m in groups) / total
    tau = (between - len(groups) * v) / total
    return min(max(v / tau - 1 if tau > 0 else 1e4, 1.0), 1e4)


def posteriors(rows):
    """The combined quality of (host, path, p) by plain loops."""
    sites, hosts = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for h, path, p in rows:
        for group in (sites[h, path], hosts[h]):
            group[0] += 1
            group[1] += p
    mean = sum(p for _, _, p in rows) / len(rows)
    k = strength([(n, s, mean) for n, s in hosts.values()])
    of_host = {h: (s + k * mean) / (n + k) for h, (n, s) in hosts.items()}
    kp = strength([(n, s, of_host[h]) for (h, _), (n, s) in sites.items()])
    logit = lambda x: math.log(x / (1 - x))
    for h, path, p in rows:
        n, s = sites[h, path]
        site = (s - p + kp * of_host[h]) / (n - 1 + kp)
        yield 1 / (1 + math.exp(-(logit(min(max(p, 1e-9), 1 - 1e-9)) + logit(min(max(site, 1e-6), 1 - 1e-6)) - logit(mean))))


def test_posteriors_by_plain_loops_and_with_salted_sites(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumn("host", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("source")))
    model = quality.fit(docs, labels)
    got = quality.judge(docs, model, F.col("host"), F.col("lang")).orderBy("doc_id").collect()
    want = list(posteriors([(r.host, r.lang, r.quality_p) for r in got]))
    assert all(abs(r.quality - w) < 1e-9 for r, w in zip(got, want))
    salted = quality.judge(docs, model, F.col("host"), F.col("lang"), keep=["doc_id"], max_sites=0).orderBy("doc_id").collect()
    assert [(r.doc_id, round(r.quality, 12)) for r in salted] == [(r.doc_id, round(r.quality, 12)) for r in got]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (2, "", "a", None), (None, "text", "a", "b"), (2, "w " * 50_000, "a", "b")], "doc_id long, text string, source string, lang string").withColumn("quality", F.lit("old"))
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    got = quality.judge(df, model, *quality.sites_of_documents())
    assert [r.quality > 0.5 for r in got.collect()] == [True] * 4
    assert quality.judge(df.limit(0), model, *quality.sites_of_documents()).count() == 0


def test_sites_of_addresses(spark):
    urls = ["http://Ththre.example.com/fr/825?page=2&ref=x", "https://u:p@m.host.example.net:8080/en/a/25#top", "https://www.example.org", "https://www.example.org/one.html", "ftp://m.org/x/", "https://h.org?q=a/b/", "no address", "", None]
    host, path = quality.sites_of_urls(F.col("url"))
    got = [tuple(r) for r in spark.createDataFrame([(u,) for u in urls], "url string").select(host, path).collect()]
    assert got == [("ththre.example.com", "ththre.example.com/fr"), ("host.example.net", "host.example.net/en"), ("example.org", "example.org"), ("example.org", "example.org"), ("m.org", "m.org/x"), ("h.org", "h.org"), (None, None), (None, None), (None, None)]


def test_pages_by_their_hosts(spark, small):
    docs, labels, pages = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels", "pages"))
    host, path = quality.sites_of_urls(F.col("url"))
    judged = quality.judge(pages, quality.fit(docs, labels), host, path, text="html").withColumn("host", host).withColumn("path", path).collect()
    assert len(judged) == pages.count() and all(0 < r.quality < 1 for r in judged)
    of_path = Counter(r.path for r in judged)
    alone = defaultdict(set)
    for r in judged:
        if of_path[r.path] == 1:
            alone[r.host].add(round(r.site_p, 9))
    # a page without others beside it is judged by its host alone
    assert alone and all(len(v) == 1 for v in alone.values())
