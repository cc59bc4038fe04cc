"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, stars.

Documents are linked when the Jaccard similarity of their sets of distinct word shingles reaches
a threshold; a group is a connected component of links.

How a link is found. Equal sets collapse first (one representative a set). Each representative is
hashed once into ``bands * rows`` bins; an empty bin borrows from the first filled bin of a fixed
random probing order. Bins are joined to band keys. In each bucket every member is tied to the
smallest representative only (a star), so candidates grow with the members, not with their square.
Sketches of 8 bits a bin discard hopeless candidates; the rest are confirmed on full sets.
A bucket that still holds several components is completed exactly: members outside its centre's
component are compared with all others, block by block on sketches. First only their closest
partners are confirmed, which joins most of a large group. What is still apart is then compared on
sketches of FINE undensified bins (nearly a census of a short text), each pair in its first common
band only, and confirmed where the estimate comes within six standard deviations of the threshold.

With 40 bands of 4 rows a pair at similarity 0.75 shares no bucket with probability 3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm import _words
from strandloom.operators.graph import connected_components
from strandloom.workspace import materialize

BANDS, ROWS, BLOCK, FINE = 40, 4, 512, 1024
_rank: dict[int, np.ndarray] = {}


def _probe_rank(k: int) -> np.ndarray:
    """rank[i, s]: when bin i, if empty, probes bin s."""
    if k not in _rank:
        rng = np.random.default_rng(77)
        _rank[k] = np.argsort(np.stack([rng.permutation(k) for _ in range(k)]), axis=1).astype(np.int32)
    return _rank[k]


def one_permutation(hashes: np.ndarray, k: int) -> np.ndarray:
    """k bin minima of an ascending non-empty hash set, empty bins filled by densification."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    head = np.flatnonzero(np.diff(bins, prepend=-1))
    filled = bins[head]
    out = np.empty(k, np.uint64)
    out[filled] = hashes[head]
    if len(filled) < k:
        empty = np.setdiff1d(np.arange(k), filled, assume_unique=True)
        out[empty] = out[filled[_probe_rank(k)[np.ix_(empty, filled)].argmin(axis=1)]]
    return out


def signatures(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, n_shingles, fp, sketch, bands)``; an empty set has no fp, sketch and bands."""
    k = bands * rows
    salt = _words.mix(np.arange(1, bands + 1, dtype=np.uint64))

    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = _words.utf8(batch.column(1))
            n, fps, sketches, keys = [], [], [], []
            for i, j in _words.slices(off):
                for s in _words.shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], shingle):
                    n.append(len(s))
                    if not len(s):
                        fps.append(None), sketches.append(None), keys.append(None)
                        continue
                    v = one_permutation(s, k)
                    g = v.reshape(bands, rows)
                    b = g[:, 0] * np.uint64(0x9DDFEA08EB382D69)
                    for c in range(1, rows):
                        b = _words.mix(b + g[:, c])
                    fps.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sketches.append(v.astype(np.uint8).tobytes())
                    keys.append((_words.mix(b ^ salt)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "fp", "sketch", "bands"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, fp binary, sketch binary, bands array<long>"
    )


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = _words.utf8(batch.column(1))
            out = []
            for i, j in _words.slices(off):
                out += [s.tobytes() for s in _words.shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def _close(pairs: DataFrame, least: float, left: str = "sa", right: str = "sb") -> DataFrame:
    """Pairs whose sketches agree in at least the share ``least`` of bins."""

    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            keep = (a == b).mean(axis=1) >= least
            yield batch.filter(pa.array(keep)).select([0, 1])

    return pairs.select("a", "b", left, right).mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` with den * |A & B| >= num * |A | B| on full sets; texts travel once."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = _sets(docs.join(ids.hint("merge"), "doc_id", "left_semi").select("doc_id", "text"), shingle)
    both = (
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")).hint("merge"), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")).hint("merge"), "b")
        .select("a", "b", "sa", "sb")
    )

    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(x), len(y)) * den < num * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate((x, y))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(den * shared >= num * (len(both) - shared))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return both.mapInArrow(run, "a long, b long")


def fine_sketch(hashes: np.ndarray) -> np.ndarray:
    """One byte of each bin's minimum; 0 is an empty bin."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(FINE) >> np.uint64(32)).astype(np.int64)
    head = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(FINE, np.uint8)
    out[bins[head]] = hashes[head] % np.uint64(255) + np.uint64(1)
    return out


def may_link(one: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray, t: float) -> np.ndarray:
    """Whether the estimate from fine sketches comes within six standard deviations of similarity t."""
    used = ((others != 0) | (one != 0)).sum(axis=1)
    same = ((others == one) & (one != 0)).sum(axis=1)
    union = np.maximum((size + sizes) / (1 + t), used)
    # bins are drawn without replacement: a sketch that holds all hashes has no error
    sd = np.sqrt(t * (1 - t) / np.maximum(used, 1) * (1 - used / union + 0.02))
    return same >= (t - 6 * sd) * used


def _fine(texts: DataFrame, shingle: int) -> DataFrame:
    @_words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = _words.utf8(batch.column(1))
            n, out = [], []
            for i, j in _words.slices(off):
                for h in _words.shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], shingle):
                    n.append(len(h)), out.append(fine_sketch(h).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(out, pa.binary())], names=["rep", "size", "sketch"])

    return texts.select("doc_id", "text").mapInArrow(run, "rep long, size long, sketch binary")


def _dealt(members: DataFrame) -> DataFrame:
    """Cells (key, x, y) of unresolved buckets: loose members (left) meet all members.

    Both sides are dealt into blocks of about BLOCK rows, so no task holds a whole bucket.
    """
    sized = members.groupBy("key").agg(F.count("*").alias("n"), F.count_if("loose").alias("nl"))
    cell = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")
    m = members.join(sized, "key").withColumn("mb", cell("n")).withColumn("lb", cell("nl"))
    h = lambda s: F.xxhash64("rep", F.lit(s))
    rest = [c for c in members.columns if c != "loose"]
    rows = m.select(*rest, F.lit(False).alias("left"), F.pmod(h(1), "mb").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.col("lb") - 1)).alias("x"))
    loose = m.where("loose").select(*rest, F.lit(True).alias("left"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("y"), F.pmod(h(2), "lb").cast("int").alias("x"))
    return rows.unionByName(loose)


def _closest(members: DataFrame, least: float, best: int) -> DataFrame:
    """For each loose member the ``best`` closest others by sketch, of other components."""

    @_words.lean
    def run(table: pa.Table) -> pa.Table:
        left = np.asarray(table["left"].combine_chunks().to_numpy(zero_copy_only=False), bool)
        rep, comp = (table[c].to_numpy() for c in ("rep", "comp"))
        sk = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(rep), -1)
        r, s = np.flatnonzero(~left), np.flatnonzero(left)
        a, b, c = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for i in s:
            like = (sk[r] == sk[i]).mean(axis=1)
            near = np.flatnonzero((like >= least) & (comp[r] != comp[i]))
            if len(near) > best:
                near = near[np.lexsort((rep[r[near]], -like[near]))[:best]]
            a.append(np.full(len(near), rep[i])), b.append(rep[r[near]]), c.append(like[near])
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64()), "like": pa.array(np.concatenate(c))})

    found = _dealt(members).groupBy("key", "x", "y").applyInArrow(run, "a long, b long, like double").distinct()
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("like"), "b"))).where(F.col("r") <= best)
    return ranked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _remaining(members: DataFrame, t: float) -> DataFrame:
    """All pairs of different components that may be linked, each from its first common band."""

    @_words.lean
    def run(table: pa.Table) -> pa.Table:
        left = np.asarray(table["left"].combine_chunks().to_numpy(zero_copy_only=False), bool)
        rep, comp, size = (table[c].to_numpy() for c in ("rep", "comp", "size"))
        sk = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(rep), -1)
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        # an id with several texts comes with the bands of each; those of another bucket do not count
        mine_here = bands == table["key"][0].as_py()
        held = mine_here.any(axis=1)
        here = int(mine_here[held][0].argmax()) if held.any() else 0
        left &= held
        r = np.flatnonzero(~left & held)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in np.flatnonzero(left):
            mine = r[comp[r] != comp[i]]
            if here:
                mine = mine[~(bands[mine, :here] == bands[i, :here]).any(axis=1)]
            near = mine[may_link(sk[i], size[i], sk[mine], size[mine], t)]
            a.append(np.minimum(rep[near], rep[i])), b.append(np.maximum(rep[near], rep[i]))
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    return _dealt(members).groupBy("key", "x", "y").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, num: int = 75, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    Null or empty texts and texts without words have an empty set, are linked with nothing and are
    kept. Rows with a null key are kept under a null component. Rows of one key are one document,
    which has the links of all their texts. An empty table gives an empty result. Other columns are
    ignored.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    k = bands * rows
    # agreement of 8-bit bins six standard deviations below what the threshold gives
    t = num / den
    least = max(0.0, t - 6 * (t * (1 - t) / k) ** 0.5)
    signed = materialize(signatures(docs, shingle=shingle, bands=bands, rows=rows), "sign")
    reps = materialize(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("sketch", "bands"), "doc_id").alias("s")).select("fp", "rep", "s.*"),
        "reps",
    )
    # joins that carry much are merged at every size: a side is broadcast only if Spark has checked its size
    banded = reps.select("rep", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1").select("key", "centre")
    members = materialize(banded.join(buckets.hint("merge"), "key"), "members")
    shared = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = materialize(docs.join(shared.hint("merge"), "doc_id", "left_semi"), "texts")
    sketch = materialize(reps.select("rep", "sketch").join(shared.select(F.col("doc_id").alias("rep")), "rep", "left_semi"), "sketch")

    def with_sketches(pairs: DataFrame) -> DataFrame:
        a, b = (sketch.select(F.col("rep").alias(x), F.col("sketch").alias(f"s{x}")).hint("merge") for x in "ab")
        return pairs.join(a, "a").join(b, "b")

    stars = members.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    tested = materialize(_close(with_sketches(stars), least), "near")
    links = materialize(confirm(tested, texts, shingle, num, den), "links")
    comp = materialize(connected_components(links, "a", "b"), "comp")
    for best in (3, None):
        label = lambda col, out, comp=comp: comp.select(F.col("node").alias(col), F.col("component").alias(out))
        named = members.join(label("rep", "c"), "rep", "left").join(label("centre", "cc"), "centre", "left").select("key", "rep", F.coalesce("c", "rep").alias("comp"), F.coalesce("cc", "centre").alias("centre_comp"))
        mixed = named.where("comp <> centre_comp").select("key").distinct()
        unresolved = named.join(mixed, "key", "left_semi").select("key", "rep", "comp", (F.col("comp") != F.col("centre_comp")).alias("loose"))
        if best is None:
            wanted = materialize(unresolved, "unresolved")
            few = wanted.select("rep").distinct()
            fine = _fine(texts.join(few.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi"), shingle).join(reps.select("rep", "bands").hint("merge"), "rep")
            found = _remaining(wanted.join(fine.hint("merge"), "rep"), t)
        else:
            found = _closest(unresolved.join(sketch.hint("merge"), "rep"), least, best)
        more = materialize(found.join(tested, ["a", "b"], "left_anti"), "more")
        if more.isEmpty():
            continue  # closest partners all tested: the exact completion still follows
        tested = tested.unionByName(more)
        links = links.unionByName(materialize(confirm(more, texts, shingle, num, den), "links"))
        comp = materialize(connected_components(links, "a", "b"), "comp")
    final = reps.select("fp", "rep").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return (
        signed.select("doc_id", "n_shingles", "fp")
        .join(final.hint("merge"), "fp", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
