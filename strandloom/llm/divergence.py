"""Audit of how the sources of a language differ in their terms.

A group (language and source) gives each kept term a price, its smoothed share in billionths. The
distance of two groups sums, over all kept terms of the language, the squared difference of their
prices by the other's price. Most terms occur in neither or in one of two groups, so the sum is
taken by inclusion and exclusion over the supports:

* every term at the price of both-zero terms: one constant a pair;
* for each group's own terms, the change against that constant if the other had none of them: from
  the histogram of the group's prices, one row a distinct price;
* for terms that both hold, a correction of the two changes: from a join of the sparse postings.

Work beside the postings grows with the pairs of groups, which are result rows, and with distinct
prices, never with terms by pairs. Counts are summed where texts are read, then by (language, term):
a frequent term is one entry a task and group, a hot source is spread over its terms.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm import _words
from strandloom.workspace import materialize

MIN_DOCS, TOP = 3, 200
SCALE = 1_000_000_000
HELD = 300_000
MAX_GROUPS, SALTS = 50_000, 32
ROW = "lang string, source string, term string, count long, docs long"
#: A-Z become a-z; what stands in no term becomes white space.
_LETTERS = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or 97 <= b < 123 else 32 for b in range(256))


def _flush(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
    lang, source, term, count, docs = [], [], [], [], []
    for (group_lang, group_source), (counts, holders) in held.items():
        lang += [group_lang] * len(counts)
        source += [group_source] * len(counts)
        term += counts.keys()
        count += counts.values()
        docs += map(holders.__getitem__, counts)
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(count, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "count", "docs"])


@_words.lean
def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term in a group, and documents that hold it, of a task's rows."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary())):
            terms = text.as_py().translate(_LETTERS).split()
            counts, holders = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(counts)
            counts.update(terms)
            holders.update(set(terms))
            size += len(counts)
            if size >= HELD:
                yield _flush(held)
                held, size = {}, 0
    if held:
        yield _flush(held)


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, term, source, count, lang_count, leads)`` of terms that at least ``min_docs`` documents of a language hold;
    ``docs`` has the columns lang, source and text without nulls. One row a term of a language has ``leads`` 1."""
    # groups of a term meet by (lang, term), where their number is the number of sources
    counted = docs.select("lang", "source", "text").mapInArrow(_tally, ROW).repartition("lang", "term")
    counted = counted.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    by_term = Window.partitionBy("lang", "term").orderBy("source")
    whole = by_term.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = counted.select(
        "lang", "term", "source", "count", F.sum("docs").over(whole).alias("holders"), F.sum("count").over(whole).alias("lang_count"),
        (F.row_number().over(by_term) == 1).cast("int").alias("leads"),
    )
    return counted.where(F.col("holders") >= min_docs).drop("holders")


def _price(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + 1) / (total + terms)), in decimals."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + 1), wide(total + terms)) + 1


def _gap(p: str | Column, q: str | Column) -> Column:
    """floor((p - q)^2 / q); prices stay near SCALE, so squares fit 64 bits."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def _with_groups(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """Rows by (lang, source) with the columns of their group; a hot group is SALTS tasks where groups are too many to send."""
    if few:
        return rows.join(F.broadcast(groups), ["lang", "source"])
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "source", "_salt"]).drop("_salt")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, max_groups: int = MAX_GROUPS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` has the distance of each group to each other source of its
    language, part ``term`` the ``top`` kept terms that a group uses more than its language, by the same measure.

    A null text, lang or source is the empty string; an empty one is a group like others. Repeated
    rows are documents of their own. A very long text is one row of one task. A group without terms
    has pairs and no terms; a language without kept terms has pairs of value 0; one source alone has
    no pairs. Ties rank by item in UTF-8 order. Other columns are ignored; an empty table gives no rows.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).alias("text"))
    kept = materialize(kept_terms(docs, min_docs), "kept_terms")

    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.sum("leads").alias("led"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["total", "led"])
    by_lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", "total", F.sum("led").over(by_lang).alias("terms"), F.sum("total").over(by_lang).alias("lang_total"))
    groups = groups.withColumn("zero", F.when(F.col("terms") > 0, _price(F.lit(0), F.col("total"), F.col("terms"))))
    groups = materialize(groups, "groups")
    few = groups.count() <= max_groups
    priced = _with_groups(kept, groups, few)
    priced = priced.select("lang", "term", "source", "zero", _price(F.col("count"), F.col("total"), F.col("terms")).alias("price"), _price(F.col("lang_count"), F.col("lang_total"), F.col("terms")).alias("lang_price"))
    priced = materialize(priced, "priced")

    one = groups.select("lang", "source", F.col("zero").alias("p0"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("q0"), "terms")
    pairs = one.join(other, "lang").where("source <> item")
    wide = lambda c: c.cast("decimal(38,0)")
    none = _gap("p0", "q0")
    both_zero = pairs.select("lang", "source", "item", F.coalesce(wide(F.col("terms")) * none.cast("decimal(19,0)"), F.lit(0)).cast("decimal(38,0)").alias("value"))

    histogram = materialize(priced.groupBy("lang", "source", "price").agg(F.count("*").alias("n"), F.first("zero").alias("zero")), "price_histogram")
    times = lambda change: (F.col("n").cast("decimal(18,0)") * change.cast("decimal(19,0)")).cast("decimal(38,0)")
    own = histogram.select("lang", "source", F.col("price").alias("p"), "n", F.col("zero").alias("p0")).join(other.drop("terms"), "lang").where("source <> item")
    own = own.select("lang", "source", "item", times(_gap("p", "q0") - none).alias("value"))
    theirs = histogram.select("lang", F.col("source").alias("item"), F.col("price").alias("q"), "n", F.col("zero").alias("q0")).join(one, "lang").where("source <> item")
    theirs = theirs.select("lang", "source", "item", times(_gap("p0", "q") - none).alias("value"))

    left = priced.select("lang", "term", "source", F.col("price").alias("p"), F.col("zero").alias("p0"))
    right = priced.select("lang", "term", F.col("source").alias("item"), F.col("price").alias("q"), F.col("zero").alias("q0"))
    shared = left.join(right.hint("merge"), ["lang", "term"]).where("source <> item")
    shared = shared.select("lang", "source", "item", wide(_gap("p", "q") - _gap("p", "q0") - _gap("p0", "q") + none).alias("value"))

    distance = both_zero.unionByName(own).unionByName(theirs).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    distance = distance.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    marked = priced.where("price > lang_price").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap("price", "lang_price").alias("value"))
    marked = marked.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return distance.unionByName(marked)


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce("text", ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS body FROM documents
), words AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS lang_count FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= {MIN_DOCS}
), counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), parts AS (
  SELECT DISTINCT lang, source FROM docs
), sizes AS (
  SELECT p.lang, p.source, coalesce(sum(c.n), 0)::HUGEINT AS total, (SELECT count(*) FROM kept k WHERE k.lang = p.lang)::HUGEINT AS terms
  FROM parts p LEFT JOIN counts c ON c.lang = p.lang AND c.source = p.source GROUP BY p.lang, p.source
), prices AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + s.terms) AS price,
    1 + ({SCALE}::HUGEINT * (k.lang_count + 1)) // ((SELECT sum(lang_count) FROM kept x WHERE x.lang = k.lang)::HUGEINT + s.terms) AS lang_price
  FROM sizes s JOIN kept k ON k.lang = s.lang LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.price - b.price) * (a.price - b.price)) // b.price) AS value
  FROM prices a JOIN prices b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM parts a JOIN parts b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((price - lang_price) * (price - lang_price)) // lang_price)::BIGINT FROM prices WHERE n > 0 AND price > lang_price
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
