"""Sources read back what the tests write."""

import gzip
import struct
import zlib

from pyspark.sql import functions as F

from strandloom.operators import alignments
from strandloom.sources import binary, sequences, text


def write_twobit(path, seqs):
    def body(seq):
        size, up = len(seq), seq.upper().replace("N", "T")
        n = [i for i, c in enumerate(seq) if c in "Nn"]
        low = [i for i, c in enumerate(seq) if c.islower()]
        out = struct.pack("<I", size)
        for places in (n, low):
            out += struct.pack(f"<I{len(places)}I{len(places)}I", len(places), *places, *[1] * len(places))
        out += struct.pack("<I", 0)
        up += "T" * (-size % 4)
        return out + bytes(sum("TCAG".index(up[i + j]) << (6 - 2 * j) for j in range(4)) for i in range(0, len(up), 4))

    at = 16 + sum(1 + len(k) + 4 for k in seqs)
    head = struct.pack("<IIII", 0x1A412743, 0, len(seqs), 0)
    data = b""
    for k, s in seqs.items():
        head += bytes([len(k)]) + k.encode() + struct.pack("<I", at + len(data))
        data += body(s)
    path.write_bytes(head + data)


def test_twobit(spark, tmp_path):
    seqs = {"chr1": "ACGTNNacgtA" * 7, "chrB": "GATTACA"}
    write_twobit(tmp_path / "g.2bit", seqs)
    binary.register(spark)
    got = spark.read.format("twobit").option("tile", 20).load(str(tmp_path / "g.2bit")).orderBy("chrom", "tile").collect()
    for k, s in seqs.items():
        assert "".join(r.seq for r in got if r.chrom == k) == s
    assert {(r.chrom, r.chrom_size) for r in got} == {(k, len(s)) for k, s in seqs.items()}


def test_bigwig(spark, tmp_path):
    sections = [struct.pack("<IIIIIBBH", 0, 10, 40, 0, 0, 1, 0, 2) + struct.pack("<IIfIIf", 10, 13, 0.5, 30, 31, 0.001), struct.pack("<IIIIIBBH", 1, 5, 9, 2, 1, 3, 0, 2) + struct.pack("<ff", 0.25, float("nan"))]
    packed = [zlib.compress(s) for s in sections]
    tree_at = 64
    tree = struct.pack("<IIIIQQ", 0x78CA8C91, 2, 4, 8, 2, 0) + struct.pack("<BBH", 1, 0, 2) + b"chr1" + struct.pack("<II", 0, 100) + b"chr2" + struct.pack("<II", 1, 50)
    data_at = tree_at + len(tree)
    index_at = data_at + sum(map(len, packed))
    leaves = struct.pack("<BBH", 1, 0, 2)
    at = data_at
    for c, (s, e), p in zip((0, 1), ((10, 40), (5, 9)), packed):
        leaves += struct.pack("<IIIIQQ", c, s, c, e, at, len(p))
        at += len(p)
    head = struct.pack("<IHHQQQHHQQIQ", 0x888FFC26, 4, 0, tree_at, data_at, index_at, 0, 0, 0, 0, 4096, 0)
    (tmp_path / "s.bw").write_bytes(head + tree + b"".join(packed) + struct.pack("<IIQIIIIQII", 0x2468ACE0, 2, 2, 0, 0, 1, 9, 0, 1, 0) + leaves)
    binary.register(spark)
    got = spark.read.format("bigwig").load(str(tmp_path / "s.bw")).orderBy("chrom", "pos").collect()
    assert [(r.chrom, r.pos, r.score) for r in got] == [("chr1", 10, 0.5), ("chr1", 11, 0.5), ("chr1", 12, 0.5), ("chr2", 5, 0.25)]


def write_bam(path, records):
    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    for name, flag, start, cigar, seq in records:
        ops = [(int(n), o) for n, o in cigar]
        body = struct.pack("<iiBBHHHiiii", 0, start, len(name) + 1, 60, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops)
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        body += bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2)) + b"\xff" * len(seq)
        raw += struct.pack("<i", len(body)) + body
    half = len(raw) // 2
    path.write_bytes(gzip.compress(raw[:half]) + gzip.compress(raw[half:]))


def test_bam_to_tagged_bed(spark, tmp_path):
    records = [
        ("r1", 0, 100, [(50, "="), (10, "N"), (40, "="), (30, "S")], "C" * 90 + "A" * 30),
        ("r2", 16, 200, [(5, "S"), (100, "=")], "T" * 5 + "G" * 100),
        ("r3", 0, 300, [(50, "="), (60, "X")], "C" * 110),
        ("r4", 0, 300, [(60, "M")], "C" * 60),
    ]
    write_bam(tmp_path / "a.bam", records)
    binary.register(spark)
    raw = spark.read.format("bam").load(str(tmp_path / "a.bam"))
    assert [(r.name, r.start, r.seq) for r in raw.orderBy("record").collect()] == [(n, s, q) for n, _, s, _, q in records]
    got = {r.name.split("__")[0]: r for r in alignments.segment(raw).collect()}
    assert set(got) == {"r1", "r2"}
    assert (got["r1"].polya_len, got["r1"].three_clip, got["r1"].verdict) == (30, 0, "accept")
    assert got["r1"].name == "r1__FC0#TC0#PA30#PR30#IY1000"
    assert (got["r2"].strand, got["r2"].polya_len) == ("-", 5)
    bed = {r.name.split("__")[0]: r for r in alignments.to_bed12(alignments.segment(raw)).collect()}
    assert (bed["r1"].end, bed["r1"].block_sizes, bed["r1"].block_starts) == (200, "50,40,", "0,60,")


def test_bed12_round_trip(spark, tmp_path):
    lines = ["chr1\t10\t100\tR1__TC1#PA2#PR3\t0\t-\t30\t80\t0,0,0\t3\t10,10,20,\t0,40,70,", "chr2\t5\t50\tR2\t0\t+\t5\t50\t0,0,0\t1\t45,\t0,"]
    (tmp_path / "a.bed").write_text("# comment\n" + "\n".join(lines) + "\n")
    back = text.bed12_lines(text.read_bed12(spark, str(tmp_path / "a.bed")))
    assert sorted(r.line for r in back.collect()) == sorted(lines)
    text.write_lines(back.union(back), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_blacklist_acts_on_both_strands(spark, tmp_path):
    (tmp_path / "b.bed").write_text("chr1\t10\t20\tx\nbroken\n")
    got = sorted((r.start, r.end) for r in text.read_bed4(spark, str(tmp_path / "b.bed")).collect())
    assert got == [(11, 19), (100_000_000_000 - 19, 100_000_000_000 - 11)]


def test_sequences(spark, tmp_path):
    (tmp_path / "a.fa").write_text("".join(f">s{i}\nACGT\nGG{'A' * i}\n" for i in range(7)))
    fa = sequences.read_fasta(spark, str(tmp_path / "a.fa"))
    assert {(r.name, r.seq) for r in fa.collect()} == {(f"s{i}", "ACGTGG" + "A" * i) for i in range(7)}
    sizes = sorted(r["count"] for r in sequences.split(fa, ["name"], files=3).groupBy("chunk").count().collect())
    assert sizes == [1, 3, 3]
    with gzip.open(tmp_path / "a.fq.gz", "wt") as f:
        f.write("".join(f"@q{i}\nACGT\n+\nIIII\n" for i in range(5)))
    fq = sequences.read_fastq(spark, str(tmp_path / "a.fq.gz")).orderBy("record").collect()
    assert [(r.record, r.name, r.seq, r.quality) for r in fq] == [(i, f"q{i}", "ACGT", "IIII") for i in range(5)]
    assert [sequences.kind(p) for p in ("x.fasta.gz", "x.fastq.gz")] == ["fasta", "fastq"]


def test_whole_pipeline(spark, small):
    from strandloom.plans import fixtures, pipeline, registry

    tx = fixtures.transcripts(spark, small).select("k", "name", "chrom", "strand", "start", "end", "cds_start", "cds_end", "exons", "introns", "is_ref")
    splice = spark.createDataFrame([("chr0", "+", "donor", 1, 0.5)], "chrom string, strand string, site string, pos long, score double")
    got = pipeline.run(tx.where("not is_ref").drop("is_ref"), tx.where("is_ref").drop("is_ref"), registry.score_track(spark, small), splice)
    counts = {r.category: r.n for r in got.groupBy("category").agg(F.count("*").alias("n")).collect()}
    assert counts.get("clean", 0) > 0 and sum(counts.values()) == got.select("id").distinct().count()
