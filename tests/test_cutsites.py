"""Window sequences over tile borders, profiles with a toy model, simulated reads."""

import numpy as np

from strandloom.operators import cutsites


def test_window_sequences(spark):
    seq = "".join("ACGT"[i * 7 % 4] for i in range(60))
    genome = spark.createDataFrame([("c", t, seq[t * 25 : t * 25 + 25], 60) for t in range(3)], "chrom string, tile long, seq string, chrom_size long")
    windows = spark.createDataFrame([("c", 20, 40, "a", "+"), ("c", 20, 40, "b", "-"), ("c", 50, 61, "late", "+")], "chrom string, start long, end long, name string, strand string")
    got = {r.name: r.seq for r in cutsites.window_sequences(windows, genome, tile=25).collect()}
    turned = seq[20:40][::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert got == {"a": seq[20:40], "b": turned}


def test_profile():
    flat = cutsites.profile("A" * 300, lambda slices: np.ones((len(slices), 206)))
    assert len(flat) == 300
    assert np.allclose(flat[100:200], 1.0, atol=0.2)


def test_score_windows(spark):
    windows = spark.createDataFrame([("c", 100, 400, "w", "+", "A" * 300), ("c", 100, 400, "v", "-", "A" * 300)], "chrom string, start long, end long, name string, strand string, seq string")

    def load():
        def model(slices):
            out = np.zeros((len(slices), 206))
            out[:, 0] = 1.0
            return out

        return model

    got = cutsites.score_windows(windows, load).collect()
    assert got and all(r.end - r.start == 1 and r.score >= 0.01 for r in got)
    assert min(r.start for r in got if r.strand == "+") == 99
    assert max(r.end for r in got if r.strand == "-") == 400


def test_simulated_reads(spark):
    reads = cutsites.simulate_reads(spark, 40, 100, 30, {"chr1": 1000, "tiny": 50}).collect()
    assert len(reads) == 40 and all(r.chrom == "chr1" and len(r.seq) == 100 and r.end - r.start == 100 and 0 <= r.start < 900 for r in reads)
    assert all("A" * int(r.name.split("_")[2]) in r.seq for r in reads)


def test_profiles_of_a_batch_take_one_call():
    """Equal to slices placed, smoothed and averaged one by one."""
    rng = np.random.default_rng(4)
    seqs = ["".join(rng.choice(list("ACGT"), n)) for n in (300, 300, 5, 0, 13, 204, 205, 206, 214, 215, 216, 301, 1000)]
    calls = []

    def model(slices):
        calls.append(len(slices))
        return np.stack([cutsites.one_hot(s) @ np.array([0.1, 0.2, 0.3, 0.9]) for s in slices])

    got = cutsites.profiles(seqs, model)
    assert len(calls) == 1
    for seq, p in zip(seqs, got):
        starts = [0]
        while starts[-1] + cutsites.WIDTH < len(seq):
            starts.append(starts[-1] + cutsites.STRIDE)
        total, count = np.zeros(len(seq)), np.zeros(len(seq))
        for s in starts:
            n = min(cutsites.WIDTH, len(seq) - s)
            line = np.zeros(len(seq))
            line[s : s + n] = model([seq[s : s + cutsites.WIDTH].ljust(cutsites.WIDTH, "X")])[0][:n]
            if len(seq) >= len(cutsites.SMOOTHING):
                line = np.array([sum(w * line[i + k - 6] for k, w in enumerate(cutsites.SMOOTHING) if 0 <= i + k - 6 < len(seq)) for i in range(len(seq))])
            total, count[s : s + n] = total + line, count[s : s + n] + 1
        assert np.allclose(p, total / np.maximum(count, 1))
    assert cutsites.profiles([], model) == []


def test_splice_contexts_join_the_genome_twice(spark):
    import random

    from strandloom.config import SCALE
    from strandloom.operators import classify

    rng = random.Random(5)
    seq = "".join(rng.choice("ACGTacgt") for _ in range(500))
    genome = spark.createDataFrame([("c", t, seq[t * 64 : t * 64 + 64]) for t in range(8)], "chrom string, tile long, seq string")
    rows = []
    for i in range(120):
        a = rng.randrange(0, 440)
        z = a + rng.randrange(4, 60)
        strand = rng.choice("+-")
        rows.append((i, "c", strand, a if strand == "+" else SCALE - z, z if strand == "+" else SCALE - a))
    df = classify.splice_contexts(spark.createDataFrame(rows, "i long, chrom string, strand string, istart long, iend long"), genome, tile=64)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2
    cut = lambda a, b: seq[max(a, 0) : max(b, 0)].upper()
    turned = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for r, (_, _, strand, istart, iend) in zip(df.orderBy("i").collect(), rows):
        s, e = (istart - 1, iend + 1) if strand == "+" else (SCALE - iend - 1, SCALE - istart + 1)
        if strand == "+":
            wanted = cut(s - 8, s + 9), cut(e - 20, e + 3), cut(s - 6, s + 6), cut(e - 6, e + 6)
        else:
            wanted = tuple(map(turned, (cut(e - 9, e + 8), cut(s - 3, s + 20), cut(e - 6, e + 6), cut(s - 6, s + 6))))
        assert (r.donor, r.acceptor, r.donor_rt, r.acceptor_rt) == wanted


def test_numbers_follow_files_of_unequal_length(spark, tmp_path):
    from strandloom.sources import sequences

    want = []
    for name, n in (("a", 40), ("b", 4_000), ("c", 7)):
        records = [(f"{name}{i}", "ACGT" * (1 + i % 5), "IIII" * (1 + i % 5)) for i in range(n)]
        (tmp_path / f"{name}.fastq").write_text("".join(f"@{a}\n{s}\n+\n{q}\n" for a, s, q in records))
        want += records
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("20000b", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            got = sequences.read_fastq(spark, [str(tmp_path / f"{x}.fastq") for x in "bca"]).orderBy("record").collect()
            assert [(r.name, r.seq, r.quality) for r in got] == want and [r.record for r in got] == list(range(len(want)))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
