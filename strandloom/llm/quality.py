"""Quality: a document classifier under hierarchical empirical Bayes over hosts and paths.

1. A logistic classifier on binned surface features (letter case, symbols, digits, repetition,
   word and line lengths) gives each document p, its share of good. It is fitted on a bounded sample
   of labelled rows: at most ``per_class`` of each label, those with the smallest hash of the key.
2. Grouped sums of p give each host a posterior share, shrunk towards the global one, and each path
   of a host one shrunk towards its host. The strengths of both priors are estimated by moments
   from how much hosts, and paths within hosts, differ. Sparse sites so stay near their parent.
3. The path's share (without the document itself) replaces the global prior in the odds of p.

Only group sums are shuffled, pre-aggregated, so a host with a third of all rows is one partial sum
a task. Texts stay where they are read: the evidence is written once beside the columns asked for, and
site posteriors are looked up by broadcast as long as their counted number is at most MAX_SITES. Beyond
that they are joined by site and a salt, so that a hot site is SALTS tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandloom.llm import _words
from strandloom.llm.toxicity import logistic
from strandloom.workspace import materialize

PER_CLASS = 4000
BINS = 8
MAX_SITES, SALTS = 50_000, 32
_SETS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r\n\v\f", "line": b"\n", "stop": b".,;:?", "bang": b"!", "symbol": b"#$%&*|<>{}[]=~^\\_@+/"}
FEATURES = ("upper", "digit", "space", "stop", "bang", "symbol", "word_length", "words", "line_length", "repeated")


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of surface features a text."""
    size = np.diff(off).astype(float)
    n = {}
    for name, chars in _SETS.items():
        table = np.zeros(256, bool)
        table[list(chars)] = True
        n[name] = np.diff(np.concatenate(([0], np.cumsum(table[buf], dtype=np.int64)))[off])
    h, _, _, first = _words.words(buf, off)
    words = np.diff(first)
    doc = np.repeat(np.arange(len(words)), words)
    order = np.lexsort((h, doc))
    new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1]))) if len(h) else np.empty(0, bool)
    distinct = np.bincount(doc[order][new], minlength=len(words))
    full = np.maximum(size, 1)
    return np.stack([
        n["upper"] / np.maximum(n["upper"] + n["lower"], 1), *(n[k] / full for k in ("digit", "space", "stop", "bang", "symbol")),
        (size - n["space"]) / np.maximum(words, 1), np.log1p(words), np.log1p(size / (n["line"] + 1)), 1 - distinct / np.maximum(words, 1),
    ], axis=1)


class Classifier:
    """Logistic weights on one-hot bins of each feature."""

    def __init__(self, edges: np.ndarray, weight: np.ndarray, bias: float):
        self.edges, self.weight, self.bias = edges, weight, bias

    def columns(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") + k * BINS for k, e in enumerate(self.edges)], axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.weight[self.columns(x)].sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _each(batches: Iterator[pa.RecordBatch], at: int, of) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        buf, off = _words.utf8(batch.column(at))
        out = [of(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in _words.slices(off)]
        if out:
            yield batch, np.concatenate(out)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, text: str = "text", key: str = "doc_id", label: str = "quality", per_class: int = PER_CLASS, penalty: float = 1e-3) -> Classifier:
    """Fit on labelled rows; rows with a null key or label are not used. Without both labels the
    classifier gives every document the share of label 1 (nearly 1 without labels: nothing is rejected)."""
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if usable is not None:
        known = known.where(usable)
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    share = (counts.pos + 1) / (counts.n + 1.01)
    pick = lambda v: known.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    ids = F.broadcast(pick(0).unionByName(pick(1)))  # at most 2 * per_class rows of two numbers

    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _each(batches, 0, features):
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(ids, "doc_id").select("text", "y").mapInArrow(run, "x array<double>, y int").collect()
    x, y = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r.y for r in rows], float)
    flat = Classifier(np.zeros((len(FEATURES), BINS - 1)), np.zeros(len(FEATURES) * BINS), float(np.log(share / max(1 - share, 1e-3))))
    if not len(y) or y.min() == y.max():
        return flat
    # edges at quantiles of both labels taken alike, so that the rarer one is resolved too
    edges = np.mean([np.quantile(x[y == v], np.linspace(0, 1, BINS + 1)[1:-1], axis=0) for v in (0, 1)], axis=0).T
    model = Classifier(np.ascontiguousarray(edges), flat.weight, flat.bias)
    cols = model.columns(x)
    rows_at = np.repeat(np.arange(len(y)), cols.shape[1])
    w, b = logistic(rows_at, cols.ravel(), np.ones(cols.size), y, len(flat.weight), penalty, 600)
    drawn = y.mean()
    return Classifier(model.edges, w, float(b + np.log(share / max(1 - share, 1e-3)) - np.log(drawn / (1 - drawn))))


def with_evidence(docs: DataFrame, model: Classifier, text: str = "text", out: str = "quality_p") -> DataFrame:
    """``docs`` and ``out``: the classifier's share of good for each text (null: empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in _each(batches, at, lambda buf, off: shared.value.predict(features(buf, off))):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def _strength(groups: DataFrame, parent: str) -> float:
    """Prior strength by moments: how far the groups' shares spread beyond what their sizes explain."""
    n, s, m = F.col("n"), F.col("s"), F.col(parent)
    r = groups.where("n > 1").agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(n * n).alias("nn"),
        F.sum(n * (s / n - m) * (s / n - m)).alias("between"), F.sum(n * m * (1 - m)).alias("within"),
    ).first()
    if not r.g or not r["n"]:
        return 100.0
    v = r.within / r["n"]
    tau = (r.between - r.g * v) / max(r["n"], 1)
    return float(min(max(v / tau - 1 if tau > 0 else 1e4, 1.0), 1e4))


def judge(docs: DataFrame, model: Classifier, host: Column, path: Column, text: str = "text", keep: list[str] | None = None, max_sites: int = MAX_SITES) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``quality_p`` (document alone), ``site_p`` (its path's posterior) and ``quality`` (combined).

    A null host or path is a site of its own. Columns of these names in ``docs`` are replaced.
    Null and empty texts are judged by their (empty) features; an empty table stays empty.
    """
    keep = [c for c in docs.columns if (keep is None or c in keep) and c not in ("quality_p", "site_p", "quality")]
    sited = docs.select(*keep, host.cast("string").alias("_host"), path.cast("string").alias("_path"), F.col(text).alias("_text"))
    judged = with_evidence(sited.drop("_text") if text in keep else sited, model, text if text in keep else "_text").drop("_text")
    judged = materialize(judged, "evidence")
    paths = materialize(judged.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("quality_p").alias("s")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("sites")).first()
    mean = float(min(max((total.s or 0.5) / (total.n or 1), 1e-6), 1 - 1e-6))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("m", F.lit(mean))
    k = _strength(hosts, "m")
    hosts = hosts.select(F.col("_host").alias("_h"), ((F.col("s") + k * mean) / (F.col("n") + k)).alias("host_p"))
    paths = paths.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    kp = _strength(paths, "host_p")
    sites = paths.select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), F.col("n").alias("_n"), F.col("s").alias("_s"), F.col("host_p").alias("_m"))
    on = F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p"))
    if total.sites <= max_sites:
        joined = judged.join(F.broadcast(sites), on, "left")
    else:
        salted = sites.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = judged.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), on & (F.col("_salt") == F.col("_t")), "left").drop("_salt", "_t")
    logit = lambda x: F.log(x / (1 - x))
    p = F.least(F.greatest("quality_p", F.lit(1e-9)), F.lit(1 - 1e-9))
    # the document's own share is taken out of its path's sum
    prior = (F.greatest(F.col("_s") - F.col("quality_p"), F.lit(0.0)) + kp * F.col("_m")) / (F.col("_n") - 1 + kp)
    prior = F.least(F.greatest(prior, F.lit(1e-6)), F.lit(1 - 1e-6))
    joined = joined.withColumn("site_p", prior)
    z = logit(p) + logit(F.col("site_p")) - logit(F.lit(mean))
    return joined.withColumn("quality", 1 / (1 + F.exp(-z))).drop("_host", "_path", "_h", "_p", "_n", "_s", "_m")


def sites_of_documents() -> tuple[Column, Column]:
    """Host and path of ``documents``: the source, and its section by language."""
    return F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang"))


def sites_of_urls(url: Column, depth: int = 1) -> tuple[Column, Column]:
    """Host and path of web addresses: the host in lower case without user, port and a leading ``www.`` or ``m.``,
    and the host with its first ``depth`` folders. A text that is no address (null too) has a null host and path.
    """
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(""))
    host = F.regexp_replace(host, r"^(?:www|m)\.(?=[^.]+\.)", "")
    folders = F.regexp_extract(url, r"^[^:/]+://[^/?#]*((?:/[^/?#]+){0,%d})/" % depth, 1)
    return host, F.concat(host, folders)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    judged = judge(docs.select("doc_id", "text", "source", "lang"), fit(docs, labels), *sites_of_documents(), keep=["doc_id"])
    return judged.select("doc_id", "quality_p", "site_p", "quality", (F.col("quality") >= 0.5).alias("kept"))
