"""Components against a union-find model; verdict folds against plain loops."""

import random

from pyspark.sql import functions as F

from strandloom.operators import intervals, polya, truncation
from strandloom.operators.graph import connected_components


def labels(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in range(n)}


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(100, 180)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    expected = labels(300, edges)
    assert got == {x: expected[x] for e in edges for x in e if e[0] != e[1]}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_touching_intervals_are_separate_islands(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("a", 15, 17), ("b", 0, 99)], "c string, start long, end long")
    got = intervals.islands(rows, ["c"]).orderBy("c", "start").select("island").collect()
    assert [r.island for r in got] == [1, 2, 2, 1]


def test_overlap_join_equals_nested_loop(spark):
    rng = random.Random(2)
    make = lambda: [(i, "x", s := rng.randrange(20000), s + rng.randrange(1, 9000)) for i in range(60)]
    a, b = make(), make()
    df = lambda v: spark.createDataFrame(v, "id long, chrom string, start long, end long")
    got = sorted((r.id, r.r_id) for r in intervals.overlap_join(df(a), df(b), ["chrom"]).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[2] < y[3] and y[2] < x[3])


def test_tail_equals_viterbi(spark):
    import math

    def viterbi(s):
        n, best = len(s), (math.log(0.5) + len(s) * math.log(0.25), 0)
        for k in range(1, n + 1):
            v = math.log(0.5) + (k - 1) * math.log(0.9) + sum(math.log(0.99 if c == "A" else 0.01 / 3) for c in s[:k]) + (math.log(0.1) + (n - k) * math.log(0.25) if k < n else 0)
            best = best if best[0] >= v else (v, k)
        return best[1]

    rng = random.Random(3)
    seqs = ["A" * rng.randrange(30) + "".join(rng.choices("ACGT", k=rng.randrange(1, 40))) for _ in range(60)]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    assert [r[0] for r in df.select(polya.tail_length(F.col("s"))).collect()] == [viterbi(s) for s in seqs]


def test_consensus_starts(spark):
    r = spark.sql("""SELECT array(
        struct(struct(0L AS start, 10L AS end) AS first, array(struct(20L AS start, 30L AS end)) AS middles),
        struct(struct(22L AS start, 28L AS end) AS first, array(struct(50L AS start, 60L AS end)) AS middles),
        struct(struct(5L AS start, 25L AS end) AS first, array(struct(70L AS start, 80L AS end)) AS middles)) r""")
    got = r.select(truncation.consensus_starts(F.col("r")).alias("c")).first().c
    # the second lies in a middle exon and in no start; the third overlaps a middle but begins in the first start
    assert [tuple(x) for x in got.starts] == [(0, 10), (5, 25)]
    assert [tuple(x) for x in got.middles] == [(20, 30), (50, 60), (70, 80)]


def test_intrapriming_sweeps(spark):
    rows = [(1, 7, 0, 100, "a", 0, 0, 0.0, "CDS"), (2, 7, 1, 104, "b", 9, 0, 0.0, "CDS"), (3, 7, 2, 109, "c", 9, 0, 0.0, "CDS"), (4, 7, -1, 103, "d", 9, 0, 0.0, "CDS")]
    df = spark.createDataFrame(rows, "k long, comp long, start long, end long, name string, gpa long, poly_a long, score double, location string")
    got = {r.k: (r.is_supported, r.forced, r.is_intrapriming) for r in polya.intrapriming(df).collect()}
    # d comes first and finds nothing; b is 4 from a, so within two wiggles; c is 5 from b; d stays odd
    assert got == {1: (True, False, False), 2: (True, False, False), 3: (False, False, True), 4: (False, False, True)}


def test_only_shuffled_rows_are_written_for_a_scan(spark, small):
    from strandloom.workspace import as_scan

    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id > 3").select("doc_id", F.upper("text").alias("text"))
    assert as_scan(docs, "docs") is docs
    for shuffled in (docs.repartition(3), docs.orderBy("text"), docs.dropDuplicates(["text"]), docs.join(docs.select("doc_id"), "doc_id"), docs.limit(50)):
        again = as_scan(shuffled, "docs")
        assert again is not shuffled and again.count() == shuffled.count()


def test_tiles_and_bounds_do_not_change_components(spark):
    from strandloom.operators import components

    rng = random.Random(8)
    rows, intervals_of = [], {}
    for k in range(400):
        at, exons = rng.randrange(40_000), []
        for _ in range(rng.randint(1, 5)):
            exons.append((at, at + rng.choice([1, 30, 200, 3_000])))
            at = exons[-1][1] + rng.randint(2, 900)
        intervals_of[k] = exons
        rows.append((k, rng.choice("ab"), "+", exons[0][0], exons[-1][1], exons))
    tx = spark.createDataFrame(rows, "k long, chrom string, strand string, start long, end long, exons array<struct<start:long,end:long>>").withColumns({"cds_start": F.col("start"), "cds_end": F.col("end")})
    chrom = {r[0]: r[1] for r in rows}
    meets = lambda x, y: any(a < d and c < b for a, b in x for c, d in y)
    for overlap, of in ((components.Overlap.EXON, intervals_of), (components.Overlap.BOUNDARY, {k: [(x[0][0], x[-1][1])] for k, x in intervals_of.items()})):
        wanted = labels(400, [(i, j) for i in range(400) for j in range(i) if chrom[i] == chrom[j] and meets(of[i], of[j])])
        for tile, most in ((1 << 20, 1 << 20), (1 << 20, 7), (256, 1 << 20), (1000, 50)):
            assert {r.k: r.comp for r in components.components(tx, overlap, tile=tile, most=most).collect()} == wanted


def test_a_deep_place_is_held_in_parts(spark):
    """Many transcripts at one place: one component, of parts that are tied by the open island's first key."""
    from strandloom.operators import components

    tx = spark.range(5_000).selectExpr("id AS k", "'c' AS chrom", "'+' AS strand", "100 + id % 10 AS start", "200 + id % 10 AS end", "array(struct(100 + id % 10 AS start, 200 + id % 10 AS end)) AS exons")
    got = components.components(tx, most=300)
    assert {r.comp for r in got.collect()} == {0} and got.count() == 5_000


def test_joins_of_short_and_long_intervals(spark):
    rng = random.Random(12)
    make = lambda: [(i, "xy"[i % 2], s := rng.randrange(3_000_000), s + rng.choice([0, 1, 50, 5_000, 300_000, 2_000_000])) for i in range(150)] + [(900, "x", 5, 90_000_000)]
    a, b = make(), make()
    df = lambda v: spark.createDataFrame(v, "id long, chrom string, start long, end long")
    for closed, hit in ((False, lambda x, y: x[2] < y[3] and y[2] < x[3]), (True, lambda x, y: x[2] <= y[3] and y[2] <= x[3])):
        got = sorted((r.id, r.r_id) for r in intervals.overlap_join(df(a), df(b), ["chrom"], closed=closed).collect())
        assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and hit(x, y))
    points = df(b).select(F.col("id").alias("p"), "chrom", F.col("start").alias("at"))
    got = sorted((r.id, r.p) for r in intervals.point_join(df(a), points, ["chrom"], "start", "end", "at").collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[2] <= x[3])


def test_one_deep_component_spreads(spark):
    """A component of 10^5 reads and some long ones: rows of the join stand in many tasks, long spans in few bins."""
    reads = spark.range(100_000).selectExpr("id AS k", "1L AS comp", "id * 37 % 1900000 AS rs", "id * 37 % 1900000 + 900 + if(id % 10000 = 0, 2000000, 0) AS re")
    points = spark.range(2_000).selectExpr("id AS i", "1L AS comp", "id * 1000 AS at")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = intervals.point_join(reads, points.hint("merge"), ["comp"], "rs", "re", "at")
        by_task = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    starts = [(i * 37 % 1_900_000, i * 37 % 1_900_000 + 900 + (2_000_000 if i % 10_000 == 0 else 0)) for i in range(100_000)]
    assert sum(by_task) == sum(min(e // 1000, 1999) - (s + 999) // 1000 + 1 for s, e in starts)
    assert len(by_task) == 4 and max(by_task) < 0.6 * sum(by_task)


def test_consensus_of_components_equals_the_fold(spark):
    rng = random.Random(21)
    rows = []
    for k in range(300):
        at, exons = rng.randrange(600), []
        for _ in range(rng.randint(1, 4)):
            exons.append((at, at + rng.choice([0, 5, 20, 90])))
            at = exons[-1][1] + rng.randint(1, 60)
        rows.append((k, rng.randrange(4), exons[0][0], exons[-1][1], f"n{k}", exons))
    refs = spark.createDataFrame(rows, "k long, comp long, start long, end long, name string, exons array<struct<start:long,end:long>>")
    from strandloom.functions.coords import first_exon, middle_exons

    got = {}
    for r in truncation.component_starts(refs).collect():
        got.setdefault(r.comp, []).append((r.start, r.end))
    order = F.struct(F.col("start").alias("o1"), (-F.col("end")).alias("o2"), F.col("name").alias("o3"), first_exon(F.col("exons")).alias("first"), middle_exons(F.col("exons")).alias("middles"))
    folded = refs.groupBy("comp").agg(F.array_sort(F.collect_list(order)).alias("r")).select("comp", truncation.consensus_starts(F.col("r")).alias("c"))
    assert {c: sorted(v) for c, v in got.items()} == {r.comp: sorted(map(tuple, r.c.starts)) for r in folded.collect()}


def test_chains_of_ends_do_not_change_the_sweeps(spark):
    rng = random.Random(17)
    for wiggle in (1, 2, 3):
        rows = [(k, rng.randrange(3), rng.randrange(50), 100 + rng.randrange(60), f"n{rng.randrange(40)}", rng.choice([0, 9, 9, 9]), 0, 0.0, "CDS") for k in range(200)]
        df = spark.createDataFrame(rows, "k long, comp long, start long, end long, name string, gpa long, poly_a long, score double, location string")
        state = {}
        for comp in range(3):
            mine, seen = sorted((r for r in rows if r[1] == comp), key=lambda r: (r[2], -r[3], r[4], r[0])), set()
            for turn in (1, 2):
                for r in mine:
                    near = {r[3], r[3] - wiggle, r[3] + wiggle}
                    if not state.get(r[0]) and ((turn == 1 and r[5] < 5) or seen & near):
                        seen |= near
                        state[r[0]] = turn
        got = {r.k: r for r in polya.intrapriming(df, wiggle=wiggle, recover=True).collect()}
        assert {k: 1 if r.is_supported else 2 if r.forced else 0 for k, r in got.items()} == {r[0]: state.get(r[0], 0) for r in rows}
        for comp in range(3):
            mine = [r[0] for r in rows if r[1] == comp]
            ratio = sum(k not in state for k in mine) / len(mine)
            assert all(abs(got[k].ratio - ratio) < 1e-6 and (got[k].category == "review") == (ratio > 0.5) for k in mine)
        chained = polya.end_chains(df.select("k", "comp", "end"), wiggle).collect()
        by = {}
        for r in chained:
            by.setdefault((r.comp, r.chain), []).append(r.end)
        assert len(by) > 3 and all(e % wiggle == c % wiggle for (_, c), ends in by.items() for e in ends)


def test_growing_tail_equals_a_pass_for_every_length(spark):
    rng = random.Random(23)
    seqs = ["A" * rng.choice([0, 3, 40, 90, 300]) + "".join(rng.choices("ACGT", weights=rng.choice([(1, 1, 1, 1), (9, 1, 1, 1)]), k=rng.choice([0, 1, 30, 200]))) for _ in range(60)]
    df = spark.createDataFrame([(i, s, rng.choice([1, 30, 47])) for i, s in enumerate(seqs)], "i long, s string, first int").cache()
    got = {r.i: r.t for r in df.select("i", polya.growing_tail(F.col("s"), F.col("first")).alias("t")).collect()}
    lengths = df.select("i", "s", F.explode(F.expr("transform(sequence(first, first + length(s) + 50, 50), n -> least(n, length(s)))")).alias("n"))
    each = lengths.select("i", "n", F.length("s").alias("size"), polya.tail_length(F.expr("left(s, n)")).alias("t")).where("n > 0")
    wanted = {i: 0 for i, s in enumerate(seqs)}
    rows = sorted(map(tuple, each.collect()))
    for i, s in enumerate(seqs):
        open_ = [t for k, n, _, t in rows if k == i and t < n]
        wanted[i] = open_[0] if open_ else len(s)
    assert got == wanted


def test_short_intervals_do_not_meet_by_wide_bins(spark):
    import time

    # 100,000 intervals, each over the next one, in one bin of the last level, and two long ones
    rows = spark.range(100_000).select(F.lit("c").alias("chrom"), "id", (F.col("id") * 100).alias("start"), (F.col("id") * 100 + 150).alias("end"))
    long = spark.createDataFrame([("c", -1, 1_000, 900_000), ("c", -2, 5_000, 9_000_000)], "chrom string, id long, start long, end long")
    x = rows.unionByName(long)
    began = time.time()
    got = intervals.overlap_join(x, x, ["chrom"]).groupBy((F.col("id") < 0).alias("a"), (F.col("r_id") < 0).alias("b")).count().collect()
    assert time.time() - began < 25
    over = sum(sum(i * 100 < e and s < i * 100 + 150 for i in range(100_000)) for s, e in ((1_000, 900_000), (5_000, 9_000_000)))
    assert {(r.a, r.b): r["count"] for r in got} == {(False, False): 299_998, (False, True): over, (True, False): over, (True, True): 4}
