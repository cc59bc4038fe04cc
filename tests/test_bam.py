"""BAM files in ranges: the same rows whatever the cuts, from any reader; sorted output with indexes."""

import random
import struct

import pytest
from pyspark.sql import Row

from strandloom.sources import bam, binary

CHROMS = {"chr1": 3_000_000, "chr2": 100_000, "chrEmpty": 10}
NAMES = "name flag chrom start mapq cigar seq".split()
SCHEMA = "name string, flag int, chrom string, start long, mapq int, cigar string, seq string, verdict string"


def some_records(n=3000, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.choice([1, 20, 150, 150, 1000, 4000])
        chrom = rng.choice(["chr1", "chr1", "chr1", "chr2"])
        gap = rng.choice(["", f"{rng.randint(1, 90000)}N{3}M"]) if chrom == "chr1" else ""
        rows.append((f"r{i}", rng.choice([0, 16]), chrom, rng.randrange(2_900_000 if chrom == "chr1" else 90_000), 60, f"{size}M{gap}", "".join(rng.choice("ACGTN") for _ in range(size + 3 * bool(gap)))))
    rows.sort(key=lambda r: (r[2], r[3], r[0], r[1], r[5]))
    return rows + [(f"u{i}", 4, None, -1, 0, "", "ACGT") for i in range(5)]


def write(path, rows, block=bam.BLOCK):
    """Records straddle blocks of ``block`` bytes."""
    places = {c: i for i, c in enumerate(CHROMS)}
    raw = b"BAM\1" + struct.pack("<ii", 0, len(CHROMS)) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in CHROMS.items())
    raw += b"".join(bam.record_of(Row(**dict(zip(NAMES, r))), places) for r in rows)
    path.write_bytes(b"".join(bam.block_of(raw[i : i + block]) for i in range(0, len(raw), block)) + bam.block_of(b""))


@pytest.fixture(scope="module")
def rows():
    return some_records()


@pytest.fixture(scope="module")
def straddling(tmp_path_factory, rows):
    path = tmp_path_factory.mktemp("bam") / "s.bam"
    write(path, rows, 7_001)
    return str(path)


def plain(df):
    return [tuple(r[c] for c in NAMES) for r in df.orderBy("record").collect()]


@pytest.mark.parametrize("split", [5_000, 60_000, 1 << 30])
def test_ranges_of_one_file(spark, straddling, rows, split):
    binary.register(spark)
    got = spark.read.format("bam").option("split", split).load(f"file://{straddling}")
    assert got.rdd.getNumPartitions() > 20 if split < 10_000 else True
    assert plain(got) == rows
    for region in ("chr1:1000000-1200000", "chr2", "chrEmpty"):
        chrom, begin, end = bam.parse_region(region)
        inside = {r[0] for r in plain(spark.read.format("bam").option("split", split).option("regions", region).load(straddling))}
        assert inside == {r[0] for r in rows if r[2] == chrom and (end is None or r[3] < end) and bam.where(bam.record_of(Row(**dict(zip(NAMES, r))), {c: i for i, c in enumerate(CHROMS)}))[2] > begin}


@pytest.mark.parametrize("split", ["9000b", "100000b", "64m"])
def test_splits_of_any_store(spark, straddling, rows, split):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        got = binary.read_bam(spark, straddling)
        assert plain(got) == rows
        binary.register(spark)
        places = [r.record for r in got.orderBy("record").collect()]
        if split != "9000b":
            assert places == [r.record for r in spark.read.format("bam").load(straddling).orderBy("record").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_record_longer_than_splits(spark, tmp_path):
    rows = [("short", 0, "chr1", 5, 60, "4M", "ACGT"), ("long", 0, "chr1", 6, 60, "90000M", "".join(random.Random(1).choice("ACGT") for _ in range(90_000))), *some_records(50)]
    write(tmp_path / "l.bam", rows, 3_000)
    binary.register(spark)
    assert plain(spark.read.format("bam").option("split", 2_000).load(str(tmp_path / "l.bam"))) == rows
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        assert plain(binary.read_store(spark, "bam", str(tmp_path / "l.bam"))) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_damage_is_an_error(spark, tmp_path, straddling):
    data = open(straddling, "rb").read()
    (tmp_path / "cut.bam").write_bytes(data[: len(data) // 2])
    binary.register(spark)
    for read in (lambda: spark.read.format("bam").load(str(tmp_path / "cut.bam")).count(), lambda: binary.read_bam(spark, str(tmp_path / "cut.bam")).count()):
        with pytest.raises(Exception, match="truncated|broken"):
            read()


def test_sorted_output_with_index(spark, tmp_path, rows):
    binary.register(spark)
    shuffled = random.Random(2).sample(rows, len(rows))
    reads = spark.createDataFrame([(*r, "reject" if r[1] == 16 else "accept") for r in shuffled], SCHEMA).repartition(3)
    bam.write_bams(reads, str(tmp_path), CHROMS, indexed=True)
    for folder, flag in (("good", {0, 4}), ("bad", {16})):
        files = sorted((tmp_path / folder).glob("*.bam"))
        assert files and all((f.parent / f"{f.name}.bai").exists() for f in files)
        wanted = [r for r in rows if r[1] in flag]
        assert [r for f in files for r in plain(spark.read.format("bam").load(str(f)))] == wanted
        source = lambda: spark.read.format("bam").option("split", 4_000)
        for region in ("chr1:1000000-1200000", "chr1:1234567-1234568", "chr2:5-50000", "chr2", "chrEmpty"):
            with_index = sorted(plain(source().option("regions", region).load(",".join(map(str, files)))))
            for f in files:
                (f.parent / f"{f.name}.bai").rename(f.parent / f"{f.name}.off")
            assert with_index == sorted(plain(source().option("regions", region).load(",".join(map(str, files))))), region
            for f in files:
                (f.parent / f"{f.name}.off").rename(f.parent / f"{f.name}.bai")
        bytes_of = lambda regions: sum((p.end >> 16) - (p.begin >> 16) for f in files for p in bam.ranges(str(f), regions))
        assert bytes_of(["chr1:1000000-1000100"]) < bytes_of([]) / 4


def test_filters_reach_the_index(spark, tmp_path, rows):
    from strandloom.sources.bam import Bam

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        binary.register(spark)
        reads = spark.createDataFrame([(*r, "accept") for r in rows], SCHEMA).coalesce(1)
        bam.write_bams(reads, str(tmp_path), CHROMS, indexed=True)
        files = ",".join(map(str, sorted((tmp_path / "good").glob("*.bam"))))
        source = spark.read.format("bam").option("pushdown", "true").load(files)
        assert sorted(r.name for r in source.where("chrom = 'chr2' and start < 5000").collect()) == sorted(r[0] for r in rows if r[2] == "chr2" and r[3] < 5000)
        assert source.where("chrom is null").count() == 5
        from pyspark.sql.datasource import EqualTo, LessThan

        reader = Bam({"path": files, "pushdown": "true"}).reader(None)
        list(reader.pushFilters([EqualTo(("chrom",), "chr1"), LessThan(("start",), 1000)]))
        assert {p.region for p in reader.partitions()} == {("chr1", 0, 1000)}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_long_chromosomes(spark, tmp_path):
    """Beyond 2^29, the reach of a BAI index, and beyond 2^31, that of a position."""
    binary.register(spark)
    rng = random.Random(5)
    places = [rng.randrange(9_000_000_000) for _ in range(400)] + [(1 << n) + d for n in (29, 30, 31, 32) for d in (-5, -1, 0, 1)]
    rows = [(f"r{i}", 0, "long", at, 60, "4M3000N4M" if i % 2 else "8M", "ACGTACGT") for i, at in enumerate(places)]
    rows += [(f"m{i}", 16, "middle", i * 1_300_000, 60, "8M", "ACGTACGT") for i in range(1000)] + [("u", 4, None, -1, 0, "", "ACGT"), ("e", 0, "even@5", 7, 60, "4M", "ACGT")]
    reads = spark.createDataFrame([(*r, "accept") for r in rows], SCHEMA).repartition(3)
    for indexed in (True, False):
        bam.write_bams(reads, str(tmp_path / str(indexed)), {"long": 9_000_010_000, "middle": 1_300_000_000, "even@5": 100}, indexed)
        files = sorted((tmp_path / str(indexed) / "good").glob("*.bam"))
        assert sorted(map(str, (x for f in files for x in plain(spark.read.format("bam").load(str(f)))))) == sorted(map(str, plain(binary.read_bam(spark, [str(f) for f in files])))) == sorted(map(str, rows))
    files = sorted((tmp_path / "True" / "good").glob("*.bam"))
    assert all((f.parent / f"{f.name}.csi").exists() for f in files)
    length = {"8M": 8, "4M3000N4M": 3008, "4M": 4}
    for region in ("long", "long:0-1073741824", "long:1073741824-1073741830", "long:2147483640-2147483649", "long:4294967200-8800000000", "middle:536870000-600000000", "middle", "even@5"):
        chrom, begin, end = bam.parse_region(region)
        wanted = sorted(r for r in rows if r[2] == chrom and (end is None or r[3] < end) and r[3] + length[r[5]] > begin)
        assert wanted and sorted(plain(spark.read.format("bam").option("regions", region).load(",".join(map(str, files))))) == wanted, region
