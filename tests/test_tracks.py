"""BAM written and read by region, files from a store, checks of inputs, splice scores, peaks."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandloom.functions.dna import consensus_score
from strandloom.operators import classify, cutsites
from strandloom.sources import bam, binary, text
from tests.test_sources import write_twobit

CHROMS = {"chr1": 2_000_000, "chr2": 90_000}
RECORDS = [
    ("a", 0, "chr1", 100, 60, "10S30=5N20=", "A" * 60), ("b", 16, "chr1", 20_000, 7, "7=1X", "ACGTACGN"), ("c", 0, "chr1", 70_000, 60, "3=", "ACG"),
    ("d", 0, "chr2", 5, 60, "9=", "ACGTTTGCA"), ("e", 0, "chr2", 40_000, 60, "2=1I4=", "ACGTACG"),
]
SCHEMA = "name string, flag int, chrom string, start long, mapq int, cigar string, seq string"


def test_bam_round_trip(spark, tmp_path):
    binary.register(spark)
    reads = spark.createDataFrame([(*r, "accept" if r[0] in "abd" else "reject") for r in RECORDS] * 300, SCHEMA + ", verdict string").coalesce(2)
    binary.write_bams(reads, str(tmp_path), CHROMS)
    for folder, names in (("good", "abd"), ("bad", "ce")):
        files = ",".join(str(p) for p in sorted((tmp_path / folder).glob("*.bam")))
        got = spark.read.format("bam").load(files).drop("record").collect()
        assert sorted(map(tuple, got)) == sorted([r for r in RECORDS if r[0] in names] * 300)
        assert sorted(map(tuple, binary.read_store(spark, "bam", f"{tmp_path}/{folder}/*.bam").drop("record").collect())) == sorted(map(tuple, got))


def indexed(path):
    """Each record in a member of its own, and an index by sequence and 16 kb window."""
    places = {c: i for i, c in enumerate(CHROMS)}
    head = b"BAM\1" + struct.pack("<ii", 0, len(CHROMS)) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in CHROMS.items())
    data, offsets = binary._block(head), []
    for r in RECORDS:
        offsets.append(len(data) << 16)
        data += binary._block(binary.bam_record(Row(**dict(zip("name flag chrom start mapq cigar seq".split(), r))), places))
    path.write_bytes(data + binary._block(b""))
    out = b"BAI\1" + struct.pack("<i", len(CHROMS))
    for c in CHROMS:
        mine = [(r[3], o) for r, o in zip(RECORDS, offsets) if r[2] == c]
        chunks = [(bam.bin_of(*bam.where(binary.bam_record(Row(**dict(zip("name flag chrom start mapq cigar seq".split(), r))), places))[1:]), o, after) for r, o, after in zip(RECORDS, offsets, [*offsets[1:], len(data) << 16]) if r[2] == c]
        bins = {b: [x[1:] for x in chunks if x[0] == b] for b in sorted({x[0] for x in chunks})}
        windows = [min([o for s, o in mine if s >> 14 >= w]) for w in range((mine[-1][0] >> 14) + 1)]
        out += struct.pack("<i", len(bins) + 1) + b"".join(struct.pack(f"<Ii{2 * len(x)}Q", b, len(x), *(v for pair in x for v in pair)) for b, x in bins.items()) + struct.pack("<Ii4Q", 37450, 2, 0, 0, 3, 0) + struct.pack(f"<i{len(windows)}Q", len(windows), *windows)
    (path.parent / (path.name + ".bai")).write_bytes(out)


@pytest.mark.parametrize("with_index", [True, False])
def test_bam_regions(spark, tmp_path, with_index):
    indexed(tmp_path / "r.bam")
    if not with_index:
        (tmp_path / "r.bam.bai").unlink()
    binary.register(spark)
    source = lambda regions=None: spark.read.format("bam").options(**{"regions": regions} if regions else {}).load(str(tmp_path / "r.bam"))
    assert source().rdd.getNumPartitions() == (2 if with_index else 1)
    assert sorted(r.name for r in source().collect()) == list("abcde")
    for regions, names in (("chr2", "de"), ("chr1:0-100", ""), ("chr1:154-155", "a"), ("chr1:20007-70001", "bc"), ("chr1:20008-70000", ""), ("chr1:60000-80000,chr2:0-6", "cd"), ("chr9", "")):
        assert sorted(r.name for r in source(regions).collect()) == list(names)


def test_stores(spark, tmp_path):
    binary.register(spark)
    seqs = {"chr1": "ACGTNNacgtA" * 7, "chrB": "GATTACA"}
    write_twobit(tmp_path / "g.2bit", seqs)
    path = f"file://{tmp_path}/g.2bit"
    plain = spark.read.format("twobit").option("tile", 20).load(str(tmp_path / "g.2bit"))
    assert sorted(map(tuple, binary.read_store(spark, "twobit", path, tile=20).collect())) == sorted(map(tuple, plain.collect()))


def test_input_checks(spark, tmp_path):
    (tmp_path / "ok.bed").write_text("chr1\t1\t2\n")
    (tmp_path / "empty.bed").write_text("")
    (tmp_path / "x.txt").write_text("x")
    (tmp_path / "folder.bed").mkdir()
    assert text.check_input(spark, str(tmp_path / "ok.bed")).endswith("ok.bed")
    for name, why in (("none.bed", "exist"), ("empty.bed", "empty"), ("x.txt", "end in"), ("folder.bed", "not a file")):
        with pytest.raises(ValueError, match=why):
            text.check_input(spark, str(tmp_path / name))


def test_max_entropy_scores(spark, tmp_path):
    rng = random.Random(3)
    acceptor = "".join(rng.choices("ACGT", k=18)) + "AG" + "".join(rng.choices("ACGT", k=3))
    s = acceptor[:18] + acceptor[20:]
    ups, downs = [s[0:7], s[7:14], s[14:21], s[4:11], s[11:18]], ["AAAA" + s[4:7], "AAA" + s[7:11], "AAAA" + s[11:14], "AAA" + s[14:18]]
    table = {k: [0.0] * 9 for k in [*ups, *downs]}
    for i, k in enumerate([*ups, *downs]):
        table[k][i] = 1.5 + i
    (tmp_path / "a.tsv").write_text("".join(f"{k}\t" + "\t".join(map(str, v)) + "\n" for k, v in table.items()))
    (tmp_path / "d.tsv").write_text("CAGGTAAGT\t8.5\n")
    acceptors, donors = text.read_max_entropy(spark, str(tmp_path / "a.tsv")), text.read_max_entropy(spark, str(tmp_path / "d.tsv"), text.MAXENT_DONOR)
    introns = spark.createDataFrame([(1, "AAAAAAAA" + "CAGGTAAGT", acceptor), (2, "T" * 17, "C" * 23)], "k long, donor string, acceptor string")
    got = {r.k: r for r in classify.with_max_entropy(introns, donors, acceptors).withColumn("c", consensus_score(F.col("acceptor"))).collect()}
    up = np.prod([table[k][i] for i, k in enumerate(ups)])
    down = np.prod([table[k][5 + i] for i, k in enumerate(downs)])
    assert (got[1].me_donor, got[2].me_donor, got[2].me_acceptor) == (8.5, 0.0, 0.0)
    assert got[1].me_acceptor == pytest.approx(np.log2(got[1].c * up / down))


def slow_peaks(p, height, distance, prominence):
    found = []
    for i in range(1, len(p) - 1):
        j = i
        while j + 1 < len(p) and p[j + 1] == p[i]:
            j += 1
        if p[i - 1] < p[i] and j + 1 < len(p) and p[j + 1] < p[i] and p[i] >= height:
            found.append((i + j) // 2)
    kept = []
    for i in sorted(found, key=lambda i: (-p[i], -i)):
        if all(abs(i - k) >= distance for k in kept):
            kept.append(i)
    out = []
    for i in kept:
        lows = []
        for step in (-1, 1):
            low, j = p[i], i
            while 0 <= j < len(p) and p[j] <= p[i]:
                low = min(low, p[j])
                j += step
            lows.append(low)
        if p[i] - max(lows) >= prominence:
            out.append(i)
    return sorted(out)


def test_peaks():
    rng = np.random.default_rng(2)
    for _ in range(40):
        p = np.round(np.abs(np.cumsum(rng.normal(size=400))) / 40, 2)
        for height, distance, prominence in ((0.01, 50, 0.01), (0.1, 5, 0.05), (0, 1, 0)):
            assert cutsites.peaks(p, height, distance, prominence) == slow_peaks(p.tolist(), height, distance, prominence)
    assert cutsites.peaks(np.array([1.0, 1.0])) == []


def test_window_peaks_and_slices(spark):
    model = lambda slices: np.stack([cutsites.one_hot(s)[:, 2] for s in slices])
    seq = "A" * 60 + "GGG" + "T" * 150 + "G" + "C" * 86
    windows = spark.createDataFrame([("c", 1000, 1000 + len(seq), "w", s, seq) for s in "+-"], "chrom string, start long, end long, name string, strand string, seq string")
    got = cutsites.window_peaks(windows, lambda: model).collect()
    best = cutsites.window_peaks(windows, lambda: model, best_only=True).collect()
    assert sorted(r.place for r in got) == [61, 61, 213, 213]
    assert {(r.strand, r.position) for r in best} == {("+", 1060), ("-", 1000 + len(seq) - 62)}
    assert cutsites.one_hot("ACGTN", 6).tolist() == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [0, 0, 0, 0], [0, 0, 0, 0]]


def test_bedgraph_by_strand(spark, tmp_path):
    rows = [("c2", 5, 6, 0.25, "+"), ("c1", 9, 10, 0.5, "+"), ("c1", 3, 4, 1.0, "-")]
    text.write_bedgraph(spark.createDataFrame(rows, "chrom string, start long, end long, score double, strand string"), str(tmp_path / "bg"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "bg" / "strand=+")).collect()) == ["c1\t9\t10\t0.5", "c2\t5\t6\t0.25"]
    assert [r.value for r in spark.read.text(str(tmp_path / "bg" / "strand=-")).collect()] == ["c1\t3\t4\t1.0"]


def test_islands_of_a_long_chromosome(spark):
    from strandloom.operators.intervals import islands

    rng = random.Random(9)
    rows = [(i, "a", s := rng.randrange(300_000), s + rng.randrange(1, 900)) for i in range(500)] + [(900, "a", 1_000, 150_000)]
    df = spark.createDataFrame(rows, "id long, chrom string, start long, end long")
    got = {r.id: r.island for r in islands(df, ["chrom"], tile=4096).collect()}
    want, reach, n = {}, -1, 0
    for i, _, s, e in sorted(rows, key=lambda r: (r[2], -r[3])):
        n += s >= reach
        reach = max(reach, e)
        want[i] = n
    assert got == want
    plan = islands(df, ["chrom"], tile=4096)._jdf.queryExecution().executedPlan().toString()
    assert "_tile" in plan
