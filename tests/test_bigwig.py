"""bigWig files: written by many tasks, read back by base, region and filter; parts of 2bit genomes."""

import random
import struct
import zlib

import numpy as np
import pytest

from strandloom.sources import bigwig, binary
from tests.test_sources import write_twobit

CHROMS = {f"chr{i}": 400_000 for i in range(1, 4)} | {"chrUn": 50}
SCHEMA = "chrom string, start long, end long, score double, strand string"


@pytest.fixture(scope="module")
def signal():
    rng, rows = random.Random(6), []
    for strand in "+-":
        for chrom in ("chr1", "chr3", "chr2"):
            at = 0
            for _ in range(4_000):
                at += rng.choice([0, 0, 1, 40])
                n = rng.choice([1, 1, 3, 30])
                rows.append((chrom, at, at + n, rng.randrange(1, 400) / 8, strand))
                at += n
    return rows


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory, signal):
    binary.register(spark)
    path = str(tmp_path_factory.mktemp("bw"))
    shuffled = random.Random(1).sample(signal, len(signal))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    bigwig.write_bigwig(spark.createDataFrame(shuffled, SCHEMA), path, CHROMS)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return path


def bases(rows, strand, least=0.01, chrom=None, begin=0, end=1 << 40):
    return sorted((c, p, x) for c, s, e, x, t in rows if t == strand and x >= least and chrom in (None, c) for p in range(max(s, begin), min(e, end)))


def test_round_trip(spark, written, signal):
    for folder, strand in (("plus", "+"), ("minus", "-")):
        files = binary.files_below(f"{written}/{folder}")
        assert files.count(",") >= 1
        got = spark.read.format("bigwig").load(files)
        assert sorted(map(tuple, got.collect())) == bases(signal, strand)
        assert sorted(map(tuple, binary.read_store(spark, "bigwig", f"{written}/{folder}/*.bw").collect())) == bases(signal, strand)
        least = spark.read.format("bigwig").option("min_score", "25").option("chroms", "chr2").load(f"file://{files.split(',')[0]}" if "," not in files else files)
        assert sorted(map(tuple, least.collect())) == bases(signal, strand, 25, "chr2")


def test_regions_read_their_sections_only(spark, written, signal):
    files = binary.files_below(f"{written}/plus")
    got = spark.read.format("bigwig").option("regions", "chr1:1000-1500,chr3:90000-90001").load(files)
    assert sorted(map(tuple, got.collect())) == sorted(bases(signal, "+", chrom="chr1", begin=1000, end=1500) + bases(signal, "+", chrom="chr3", begin=90_000, end=90_001))
    read = whole = 0
    for f in files.split(","):
        track = bigwig.Track(f)
        list(track.intervals(track.chroms["chr1"][0], 1000, 1500))
        read += track.blocks_read
        whole += sum(len(track.blocks(i)) for i, _ in track.chroms.values())
    assert 0 < read <= 2 < whole / 3


def test_filters_reach_the_index(spark, written, signal):
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    files = binary.files_below(f"{written}/plus")
    reader = bigwig.BigWig({"path": files, "pushdown": "true"}).reader(None)
    list(reader.pushFilters([EqualTo(("chrom",), "chr2"), GreaterThan(("pos",), 99), LessThanOrEqual(("pos",), 300)]))
    assert {(p.chrom, p.begin, p.end) for p in reader.partitions()} == {("chr2", 100, 301)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = spark.read.format("bigwig").option("pushdown", "true").load(files).where("chrom = 'chr2' and pos >= 100 and pos < 301 and score > 3")
        assert sorted(map(tuple, got.collect())) == [b for b in bases(signal, "+", chrom="chr2", begin=100, end=301) if b[2] > 3]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_zoom_levels_and_summary(written, signal):
    total = np.zeros(4)
    for f in binary.files_below(f"{written}/plus").split(","):
        data = open(f, "rb").read()
        zooms, summary_at = struct.unpack("<H", data[6:8])[0], struct.unpack("<Q", data[44:52])[0]
        covered, low, high, added, squared = struct.unpack("<Qdddd", data[summary_at : summary_at + 40])
        total += (covered, added, squared, 0)
        track = bigwig.Track(f)
        assert zooms == track.zooms and 1 <= zooms <= len(bigwig.ZOOMS)
        for i in range(zooms):
            step, _, _, index_at = struct.unpack("<IIQQ", data[64 + 24 * i : 88 + 24 * i])
            bins = [struct.unpack_from("<IIIIffff", raw, k) for ident, _ in track.chroms.values() for place, size in track.blocks(ident, index_at=index_at) for raw in [zlib.decompress(data[place : place + size])] for k in range(0, len(raw), 32)]
            assert all(b[1] // step == (b[2] - 1) // step for b in set(bins))
            assert sum(b[3] for b in set(bins)) == covered and sum(b[6] for b in set(bins)) == pytest.approx(added, rel=1e-5)
            assert min(b[4] for b in bins) == low and max(b[5] for b in bins) == high
        assert struct.unpack("<I", data[-4:])[0] == bigwig.MAGIC
    plus = [(e - s, x) for _, s, e, x, t in signal if t == "+"]
    assert total[:3] == pytest.approx([sum(n for n, _ in plus), sum(n * x for n, x in plus), sum(n * x * x for n, x in plus)])


def test_many_chromosomes_and_bad_order(tmp_path):
    names = [(f"scaffold_{i:05d}", 1000) for i in range(3000)]
    f = bigwig.File(str(tmp_path / "m.bw"), names)
    for name, _ in names[::7]:
        f.add(name, 5, 9, 1.5)
        f.add(name, 9, 10, 2.5)
    f.close()
    track = bigwig.Track(str(tmp_path / "m.bw"))
    assert track.chroms == {n: (i, s) for i, (n, s) in enumerate(names)}
    for name in ("scaffold_00007", "scaffold_00008", "scaffold_02996"):
        got = [(p, x) for pos, xs in track.positions(track.chroms[name][0], 0.0) for p, x in zip(pos.tolist(), xs.tolist())]
        assert got == ([(5, 1.5), (6, 1.5), (7, 1.5), (8, 1.5), (9, 2.5)] if int(name[-5:]) % 7 == 0 else [])
    f = bigwig.File(str(tmp_path / "b.bw"), names)
    f.add("scaffold_00001", 5, 9, 1.0)
    for bad in (("scaffold_00001", 8, 10), ("scaffold_00000", 1, 2), ("scaffold_00002", 990, 1001), ("scaffold_00002", 7, 7)):
        with pytest.raises(ValueError):
            f.add(*bad, 1.0)


def test_stretches_of_a_genome(spark, tmp_path):
    rng = random.Random(3)
    seqs = {"chr1": "".join(rng.choice("ACGTacgtN") for _ in range(1003)), "chrB": "GATTACA"}
    write_twobit(tmp_path / "g.2bit", seqs)
    order, places = binary.twobit_index(str(tmp_path / "g.2bit"))
    for begin, end in ((0, 1003), (1, 2), (37, 501), (998, 2000), (1003, 1003)):
        assert binary.twobit_part(str(tmp_path / "g.2bit"), order, places["chr1"], begin, end) == (seqs["chr1"][begin:end], 1003)
    binary.register(spark)
    source = lambda **o: spark.read.format("twobit").options(tile=20, span=100, **o).load(f"file://{tmp_path}/g.2bit")
    assert source().rdd.getNumPartitions() == 12
    for k, s in seqs.items():
        assert "".join(r.seq for r in source().where(f"chrom = '{k}'").orderBy("tile").collect()) == s
    some = source(regions="chr1:45-61,chrB").orderBy("chrom", "tile").collect()
    assert [(r.chrom, r.tile, r.seq) for r in some] == [("chr1", 2, seqs["chr1"][40:60]), ("chr1", 3, seqs["chr1"][60:80]), ("chrB", 0, "GATTACA")]
    from pyspark.sql.datasource import EqualTo, LessThan

    reader = binary.TwoBit({"path": str(tmp_path / "g.2bit"), "tile": "20", "pushdown": "true"}).reader(None)
    list(reader.pushFilters([EqualTo(("chrom",), "chr1"), LessThan(("tile",), 2)]))
    assert [(p.name, p.begin, p.end) for p in reader.partitions()] == [("chr1", 0, 40)]


def test_long_chromosomes(spark, tmp_path):
    """Positions beyond 32 bits."""
    binary.register(spark)
    places = sorted({k * 7_000_001 for k in range(1_200)} | {(1 << n) + d for n in (30, 31, 32) for d in (-2, 0, 1)} | {10 * (1 << 30) - 1})
    rows = [("chr1", p, p + 1 + (p % 3 == 0), (p % 50 + 1) / 64, "+") for p in places if p + 1 not in places] + [("chr10", 5, 9, 0.5, "+")]
    write = spark.createDataFrame(rows, "chrom string, start long, end long, score double, strand string").repartition(2)
    binary.write_bigwig(write, str(tmp_path), {"chr1": 11_000_000_000, "chr10": 100})
    files = binary.files_below(f"{tmp_path}/plus")
    wanted = sorted((c, p, x) for c, s, e, x, _ in rows for p in range(s, e))
    assert sorted(map(tuple, spark.read.format("bigwig").load(files).collect())) == wanted
    assert sorted(map(tuple, binary.read_store(spark, "bigwig", files.split(",")).collect())) == wanted
    for region in ("chr1:1073741820-1073741826", "chr1:4200000000-8500000000", "chr10", "chr1"):
        chrom, _, ends = region.partition(":")
        a, b = map(int, (ends or f"0-{1 << 40}").split("-"))
        got = spark.read.format("bigwig").option("regions", region).load(files).collect()
        assert sorted(map(tuple, got)) == [w for w in wanted if w[0] == chrom and a <= w[1] < b]
