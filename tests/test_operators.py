"""Operators on literal rows, against plain-Python definitions, and under repartitioning."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from locusframe.functions import prob, seq, udfs
from locusframe.operators import cluster, evaluate, greedy, intervals, islands, kmers, ranks, signal, stats


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def points(seed=1, n=400, span=20_000, keys=2):
    r = random.Random(seed)
    return [(i, f"k{r.randrange(keys)}", r.randrange(span)) for i in range(n)]


@pytest.mark.parametrize("bucket", [None, 50, 1000])
def test_islands_are_the_same_in_buckets(spark, bucket):
    data = points()
    df = spark.createDataFrame(data, "id bigint, k string, p bigint")
    got = {r.id: r.island for r in islands.assign_islands(df, ["k"], "p", 30, ["id"], bucket).collect()}
    for key in ("k0", "k1"):
        last, island = None, 0
        for i, _, p in sorted((x for x in data if x[1] == key), key=lambda x: (x[2], x[0])):
            island += last is None or p - last > 30
            last = p
            assert got[i] == island


@pytest.mark.parametrize("bucket", [None, 100, 3000])
def test_merged_intervals(spark, bucket):
    r = random.Random(2)
    data = [("a", s, s + r.randrange(400)) for s in (r.randrange(30_000) for _ in range(150))] + [("a", 0, 25_000)] * (bucket == 3000)
    got = rows(islands.merge_intervals(spark.createDataFrame(data, "k string, s bigint, e bigint"), ["k"], "s", "e", 128, bucket))
    want = []
    for _, s, e in sorted(data):
        if want and s <= want[-1][1] + 128:
            want[-1] = (want[-1][0], max(want[-1][1], e), want[-1][2] + 1)
        else:
            want.append((s, e, 1))
    assert got == [("a", *w) for w in want]
    covered = islands.union_length(spark.createDataFrame(data, "k string, s bigint, e bigint"), ["k"], "s", "e", F.lit(100), F.lit(20_000), bucket).first().covered
    assert covered == len({x for _, s, e in data for x in range(max(s, 100), min(e, 20_000))})


def test_capped_blocks_and_runs(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("a", 100)], "k string, p bigint")
    got = islands.capped_blocks(df, ["k"], "p", 5, 4).groupBy("island", "block").count()
    assert rows(got) == [(1, 0, 4), (1, 1, 4), (1, 2, 2), (2, 0, 1)]
    assert rows(islands.consecutive_runs(df, ["k"], "p")) == [("a", 0, 10), ("a", 100, 1)]


def test_interval_joins_against_nested_loops(spark):
    r = random.Random(3)
    a = [(i, "c", s, s + r.randrange(1, 900)) for i, s in enumerate(r.randrange(9000) for _ in range(60))]
    b = [(i, "c", s, s + r.randrange(1, 2500)) for i, s in enumerate(r.randrange(9000) for _ in range(60))]
    left, right = (spark.createDataFrame(x, "id bigint, c string, start bigint, end bigint") for x in (a, b))
    for width in (37, 500, 100_000):
        got = rows(intervals.overlap_join(left, right, ["c"], width=width).select("id", "r_id"))
        assert got == sorted((x[0], y[0]) for x in a for y in b if x[3] > y[2] and x[2] < y[3])
        got = rows(intervals.containment_join(left, right, ["c"], width=width).select("id", "r_id"))
        assert got == sorted((x[0], y[0]) for x in a for y in b if y[2] <= x[2] and y[3] >= x[3])
        pts = left.select("id", "c", F.col("start").alias("p"))
        got = rows(intervals.points_in_intervals(pts, right, ["c"], "p", width=width).select("id", "r_id"))
        assert got == sorted((x[0], y[0]) for x in a for y in b if y[2] <= x[2] < y[3])
        assert rows(intervals.in_spans(pts, right, ["c"], "p", width=width).select("id")) == sorted({(x,) for x, _ in got})
    near = rows(intervals.near_pairs(pts, pts, ["c"], "p", "p", 250).select("id", "r_id"))
    assert near == sorted((x[0], y[0]) for x in a for y in a if abs(x[2] - y[2]) <= 250)


def test_bins_include_the_end(spark):
    reads = spark.createDataFrame([("a", 5, 25_005), ("b", 10_005, 10_015)], "q string, start bigint, end bigint")
    got = rows(intervals.bins_of(reads, "start", "end", 10_000).select("q", "bin"))
    assert got == [("a", 0), ("a", 1), ("a", 2), ("b", 1)]


def test_matching_is_greedy_and_one_to_one(spark):
    r = random.Random(5)
    a, b = [(i, "c", r.randrange(3000)) for i in range(40)], [(i, "c", r.randrange(3000)) for i in range(40)]
    left, right = (spark.createDataFrame(x, "id bigint, c string, p bigint") for x in (a, b))
    want, ua, ub = [], set(), set()
    for d, i, j in sorted((abs(x[2] - y[2]), x[0], y[0]) for x in a for y in b if abs(x[2] - y[2]) <= 100):
        if i not in ua and j not in ub:
            ua.add(i)
            ub.add(j)
            want.append((i, j, d))
    assert rows(greedy.match_one_to_one(left, right, ["c"], "p", 100)) == sorted(want)


def test_step_up_selection(spark):
    r = random.Random(7)
    data = [(i, math.exp(r.gauss(0, 4)) if i % 5 else 0.0) for i in range(300)]
    for q in (0.05, 0.5, 3.0, 0.0):
        got = ranks.select_by_evalue(spark.createDataFrame(data, "i int, e double"), "e", q, ["i"]).collect()
        order = sorted(data, key=lambda x: (-x[1], x[0]))
        qq = min(1.0, q)
        cut = max((k for k, (_, e) in enumerate(order, 1) if qq > 0 and e >= len(data) / (qq * k)), default=0)
        assert {x.i for x in got if x.selected} == {i for i, _ in order[:cut]}
        if q > 0:
            assert sorted(x["rank"] for x in got) == list(range(1, 301))


def test_false_discoveries_stay_under_control(spark):
    r = random.Random(20)
    runs = [(run, i, i < 10, math.exp(r.gauss(6, 1)) if i < 10 else math.exp(r.gauss(-0.5, 1))) for run in range(60) for i in range(60)]
    share = []
    for run in range(60):
        part = [(i, e, t) for g, i, t, e in runs if g == run]
        order = sorted(part, key=lambda x: (-x[1], x[0]))
        cut = max((k for k, x in enumerate(order, 1) if x[1] >= len(part) / (0.2 * k)), default=0)
        share.append(sum(not x[2] for x in order[:cut]) / max(1, cut))
    assert sum(share) / len(share) <= 0.2
    one = spark.createDataFrame([(i, e, t) for g, i, t, e in runs if g == 0], "i int, e double, t boolean")
    assert ranks.select_by_evalue(one, "e", 0.2, ["i"]).filter("selected").count() > 0


def test_medians_and_tails(spark):
    r = random.Random(8)
    data = [(f"k{i % 3}", r.randrange(20), r.randrange(4)) for i in range(101)]
    df = spark.createDataFrame(data, "k string, v bigint, w bigint")
    by = defaultdict(list)
    for k, v, w in data:
        by[k].append((v, w))
    up = {k: sorted(v for v, _ in x)[len(x) // 2] for k, x in by.items()}
    assert {r_.k: r_.upper_median for r_ in stats.upper_median(df, ["k"], "v").collect()} == up
    mad = {k: sorted(abs(v - up[k]) for v, _ in x)[len(x) // 2] for k, x in by.items()}
    assert {r_.k: r_.mad for r_ in stats.median_absolute_deviation(df, ["k"], "v").collect()} == mad
    for r_ in stats.weighted_median(df, ["k"], "v", "w").collect():
        total, run = sum(w for _, w in by[r_.k]), 0
        for v, w in sorted(by[r_.k]):
            run += w
            if 2 * run >= total:
                assert r_.weighted_median == v
                break
    for r_ in stats.empirical_tail(df, ["k"], "v").collect():
        assert math.isclose(r_.tail_p, (1 + sum(v >= r_.v for v, _ in by[r_.k])) / (2 + len(by[r_.k])))


def test_overdispersion_falls_back_and_estimates(spark):
    few = spark.createDataFrame([(5, 10)] * 5, "x int, n int")
    assert stats.overdispersion(few, "x", "n").first().rho == 0.02
    r = random.Random(9)
    data = [(sum(r.random() < p for _ in range(20)), 20) for p in (r.betavariate(4, 4) for _ in range(600))]
    assert 0.02 < stats.overdispersion(spark.createDataFrame(data, "x int, n int"), "x", "n").first().rho < 0.2


def test_decoy_bounds(spark):
    data = [("A", 10, 1.0 + 0.1 * i) for i in range(12)] + [("B", 5, 9.0)] + [("NonTE", 5, 50.0)] * 3 + [("C", 0, 4.0)]
    got = {r.te_class: r for r in stats.decoy_checks(spark.createDataFrame(data, "c string, n int, m double"), "c", "n", "m", ~F.col("c").isin("NA", "NonTE", "")).collect()}
    assert got["A"].loci == 12 and math.isclose(got["A"].mean, 1.55) and got["A"].factor > 1.55
    assert got["B"].upper == got["ALL"].upper and got["C"].decoys == 0 and got["C"].factor == got["ALL"].factor
    assert got["ALL"].loci == 13


def test_genotypes_and_likelihoods(spark):
    df = spark.createDataFrame([(3, 3), (1, 9), (2, 0), (0, 0)], "a int, r int")
    got = [tuple(x.g)[:2] for x in df.select(prob.genotype("a", "r").alias("g")).collect()]
    assert got == [("0/1", 26), ("0/0", 0), ("1/1", 5), ("./.", 0)]
    lg = math.lgamma
    cases = [(k, n) for n in (1, 7, 40) for k in (0, 1, n // 2, n)]
    out = spark.createDataFrame(cases, "k int, n int").select("k", "n", prob.beta_binomial_log_pmf("k", "n", 0.7, 2.5).alias("b"), prob.binomial_log_pmf("k", "n", 0.3).alias("p")).collect()
    for x in out:
        choose = lg(x.n + 1) - lg(x.k + 1) - lg(x.n - x.k + 1)
        assert math.isclose(x.b, choose + lg(x.k + 0.7) + lg(x.n - x.k + 2.5) - lg(x.n + 3.2) + lg(3.2) - lg(0.7) - lg(2.5), abs_tol=1e-10)
        assert math.isclose(x.p, choose + x.k * math.log(0.3) + (x.n - x.k) * math.log(0.7), abs_tol=1e-10)
    assert 0 < prob.spanning_sensitivity(6000) < prob.spanning_sensitivity(300) < 1


def test_range_counts_and_peaks(spark):
    data = points(4, 300, 5000)
    df = spark.createDataFrame(data, "id bigint, k string, p bigint")
    for half in (40, 700):
        got = {r.id: r.near for r in signal.range_count(df, ["k"], "p", half, F.col("id") % 2 == 0).collect()}
        assert got == {i: sum(j % 2 == 0 and q == k and abs(x - p) <= half for j, q, x in data) for i, k, p in data}
    h = signal.smooth(signal.histogram(spark.createDataFrame([("a", 5)] * 3 + [("a", 95)], "k string, p bigint"), ["k"], "p", 10), ["k"])
    assert h.count() == 10 and [r.cell for r in signal.peaks(h, ["k"], 1.2).collect()] == [0]


def test_range_counts_add_every_row_once(spark):
    data = [(i, k, p) for i, (k, p) in enumerate((k, p) for k in "ab" for p in (-801, -800, -799, -90, -89, 0, 0, 100, 101, 799, 800, 801, 900, 1700))]
    for kind, by in (("bigint", 1), ("int", 1), ("double", 0.5)):
        df = spark.createDataFrame([(i, k, p * by) for i, k, p in data], f"id int, k string, p {kind}")
        near = signal.range_count(df, ["k"], "p", 100, F.col("id") % 3 > 0)
        assert {r.id: r.near for r in near.collect()} == {i: sum(j % 3 > 0 and q == k and abs(x - p) * by <= 100 for j, q, x in data) for i, k, p in data}
        # A frame with two moving ends adds up all its rows for each of them.
        assert "RangeFrame, -100, 100" not in near._jdf.queryExecution().optimizedPlan().toString()


def test_position_posterior(spark):
    df = spark.createDataFrame([("a", 100, 2.0), ("a", 101, 2.0), ("a", 140, 8.0), ("b", 7, 2.0)], "k string, p bigint, s double")
    got = {r.k: r for r in signal.position_posterior(df, ["k"], "p", "s").collect()}
    assert got["a"].mode in (100, 101) and got["a"].ci_lo < 101 < got["a"].ci_hi and got["b"].mode == 0


def test_position_posterior_equals_the_grid_without_making_it_rows(spark):
    r, data, want = random.Random(4), [], {}
    for k in range(60):
        n = 90 if k == 0 else r.randrange(2, 9)
        data += [(k, r.randrange(r.choice((10, 90, 3000))), r.choice((2.0, 3.0, 6.0))) for _ in range(n)]
    data += [(60, 5, 2.0), (60, 5, 2.0), (60, 900, 2.0), (60, 900, 2.0), (61, None, 2.0), (61, 50, 3.0), (62, None, 2.0), (None, 1, 2.0), (None, 2, 2.0)]
    for k in range(62):
        own = [(p, s) for q, p, s in data if q == k and p is not None]
        a, b = min(p for p, _ in own), max(p for p, _ in own)
        xs = range(a - 20, min(b + 20, a + 1980) + 1)
        h = [sum(math.exp(-(((x - p) / s) ** 2) / 2) / s for p, s in own) for x in xs]
        q, cum = [v / sum(h) for v in h], 0.0
        bounds = []
        for x, v in zip(xs, q, strict=True):
            cum += v
            bounds += [x] if (len(bounds) == 0 and cum >= 0.05) or (len(bounds) == 1 and cum >= 0.95) else []
        want[k] = (max(xs, key=lambda x: (round(q[x - xs[0]], 12), -x)), *bounds, -sum(v * math.log(v) for v in q if v > 0) / math.log(len(q)))
    want[62] = (0, 0, 0, 0.0)
    df = spark.createDataFrame(data, "k int, p bigint, s double")
    full, plain = (signal.position_posterior(df, ["k"], "p", "s", entropy=e) for e in (True, False))
    assert {x.k: (x.mode, x.ci_lo, x.ci_hi, pytest.approx(x.entropy)) for x in full.collect()} == want
    assert {x.k: (x.mode, x.ci_lo, x.ci_hi) for x in plain.collect()} == {k: v[:3] for k, v in want.items()}
    assert "Generate" not in plain._jdf.queryExecution().executedPlan().toString()


def _dbscan(pts, near, least):
    """Sequential definition: points in order, clusters grow from cores, border labels are overwritten by later clusters."""
    adj = {a: [b for b in pts if b != a and near(pts[a], pts[b])] for a in pts}
    core = {a for a in pts if len(adj[a]) + 1 >= least}
    label, seen = {}, set()
    for a in sorted(core):
        if a in seen:
            continue
        todo = [a]
        seen.add(a)
        while todo:
            x = todo.pop()
            label[x] = a
            for y in adj[x]:
                if y in core and y not in seen:
                    seen.add(y)
                    todo.append(y)
                elif y not in core:
                    label[y] = a
    return label


def test_density_clusters_equal_the_sequential_ones(spark):
    for seed in (1, 2):
        r = random.Random(seed)
        pts = {i: (r.randrange(900), r.randrange(60)) for i in range(70)}
        df = spark.createDataFrame([(i, "k", p, v) for i, (p, v) in pts.items()], "id bigint, k string, p bigint, v bigint")
        pairs = cluster.neighbour_pairs(df, ["k"], "p", 25, cluster.euclid(F.lit(25.0), "p", "v"))
        got = {x.id: x.cluster for x in cluster.density_clusters(df, pairs, 5).collect() if x.cluster is not None}
        assert got == _dbscan(pts, lambda a, b: math.dist(a, b) < 25, 5)
        both = cluster.strong_weak_clusters(df, pairs, 5).collect()
        assert len(both) == 70 and all(x.cluster is not None for x in both)


def test_folds(spark):
    loci = spark.createDataFrame([("c", 1, 0, 10, 300.0), ("c", 2, 5, 20, 320.0), ("c", 3, 15, 30, 600.0), ("c", 4, None, None, None), ("c", 5, 18, 40, 310.0)], "k string, o bigint, lo bigint, hi bigint, n double")
    assert {r.o: r.allele for r in greedy.merge_alleles(loci, ["k"], "o", "lo", "hi", "n").collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    hyp = spark.createDataFrame([("c", 1, 100, 110, ["a", "b"]), ("c", 2, 110, 120, ["a", "b"]), ("c", 3, 200, 210, ["a", "b"]), ("c", 4, 115, 118, ["x"])], "k string, o bigint, l bigint, r bigint, names array<string>")
    assert {r.o: r.kept_as for r in greedy.collapse_similar(hyp, ["k"], "l", "r", "names", "o").collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    sl = spark.createDataFrame([("c", 1, 100, ["a"], 9.0), ("c", 2, 120, ["a"], 8.0), ("c", 3, 300, ["b"], 7.0), ("c", 4, 2000, ["a"], 1.0)], "k string, o bigint, p bigint, names array<string>, s double")
    assert sorted((r.o, r.rescued) for r in greedy.shortlist(sl, ["k"], "p", "names", "s", "o", 2).collect()) == [(1, False), (3, False), (4, True)]
    g = spark.createDataFrame([("c", p, p == 500) for p in (300, 420, 450, 500, 560, 640, 800)], "k string, p bigint, seed boolean")
    assert sorted(r.p for r in greedy.grow_single_linkage(g, ["k"], "p", "seed").collect() if r.reached) == [420, 450, 500, 560, 640]


def test_sequences(spark):
    df = spark.createDataFrame([("ACGTN",), ("AAAA",), ("",), ("ATATATGC",)], "s string")
    got = df.select(seq.reverse_complement("s").alias("rc"), seq.longest_run("s").alias("run"), F.round(seq.entropy("s"), 6).alias("h"), F.size(seq.kmers("s", 3)).alias("k"), seq.letter_fraction("s", "AT").alias("at")).collect()
    assert [tuple(r) for r in got] == [("NACGT", 1, 2.0, 2, 0.5), ("TTTT", 4, 0.0, 2, 1.0), ("", 0, 0.0, 0, None), ("GCATATAT", 1, round(-(2 * 3 / 8 * math.log2(3 / 8) + 2 * 1 / 8 * math.log2(1 / 8)), 6), 6, 0.75)]
    key = spark.createDataFrame([("ACG",)], "k string").select(seq.kmer_key("k"), seq.canonical("k"), seq.canonical(F.lit("CGT"))).first()
    assert tuple(key) == (6, "ACG", "ACG")
    c = spark.createDataFrame([("10S20M5I20M3D10M7H",), ("5Q",), ("*",)], "c string").select(seq.parse_cigar("c").alias("c")).select(seq.reference_end(F.lit(100), F.col("c")), seq.longest_match(F.col("c"))).collect()
    assert tuple(c[0]) == (153, 20) and c[1][1] is None
    sa = spark.createDataFrame([("chr1,101,+,50M10S,60,1;bad;chr2,5,-,10S20M,3,0;",)], "t string").select(seq.parse_sa("t").alias("x")).first().x
    assert [(x.chrom, x.pos, x.strand, x.mapq) for x in sa] == [("chr1", 100, "+", 60), ("chr2", 4, "-", 3)]
    names = spark.createDataFrame([("AluY#SINE/Alu x",), ("L1:L1HS",), ("HERVK",)], "n string").select(seq.repeat_name_parts("n").alias("p")).collect()
    assert [tuple(r.p) for r in names] == [("AluY", "AluY", "Alu"), ("L1:L1HS", "L1HS", "L1"), ("HERVK", "HERVK", "HERVK")]


def test_masks_and_duplications(spark):
    assert udfs.tandem_mask("ACACACAC").all() and not udfs.tandem_mask("ACGTTGCA" * 1)[:3].any()
    assert udfs.semiglobal_distance("ACGT", "TTACGTTT") == 0 and udfs.semiglobal_distance("ACGT", "TTAGTTT") == 1
    assert udfs.find_duplication("CCCCAAGTTC", "AAGTTCGGGG") == (6, 0) and udfs.find_duplication("ACGT", "TTTT") == (0, 0)
    df = spark.createDataFrame([("GGGACGTACGTAC", "ACGTACGTACGGG", "ACGT" * 30)], "l string, r string, b string")
    x = df.select(udfs.target_site_duplication("l", "r", "b").alias("t"), udfs.tandem_fraction("b").alias("f"), udfs.semiglobal_identity("l", "r").alias("i")).first()
    assert x.t.length == 10 and x.f == 1.0 and 0 < x.i < 1 and 0 < x.t.null_fraction < 1


def test_kmer_votes_and_prefixes(spark):
    lib = kmers.explode_windows(spark.createDataFrame([(1, "ACGTACCA"), (2, "TTTTGGGA")], "id int, s string"), "id", "s", 4).select("id", "kmer")
    q = kmers.explode_windows(spark.createDataFrame([(9, "CGTACC"), (8, "CCCCC")], "id int, s string"), "id", "s", 4).select("id", "kmer")
    assert [(r.id, r.entry, r.hits, r.total) for r in kmers.votes(q, lib).collect()] == [(9, 1, 3, 3)]
    t = spark.createDataFrame([("SINE", "a"), ("SINE/Alu", "b")], "k string, v string")
    got = kmers.prefix_lookup(spark.createDataFrame([("SINE/AluY",), ("SINE/B2",), ("LINE",)], "x string"), "x", t, "k", "v", F.lit("none"))
    assert rows(got.select("x", "v")) == [("LINE", "none"), ("SINE/AluY", "b"), ("SINE/B2", "a")]


def test_scoring(spark):
    calls = spark.createDataFrame([(1, "c", 100), (2, "c", 5000), (3, "d", 5)], "id bigint, chrom string, pos bigint")
    truth = spark.createDataFrame([(1, "c", 150), (2, "c", 9000)], "id bigint, chrom string, pos bigint")
    bed = spark.createDataFrame([("c", 0, 20_000)], "chrom string, start bigint, end bigint")
    r = evaluate.score_calls(calls, truth, bed).first()
    assert (r.tp, r.fp, r.fn) == (1, 1, 1)


def test_votes_and_containment_of_texts_equal_those_of_their_windows(spark, monkeypatch):
    r = random.Random(3)
    texts = [(i, "".join(r.choice("abé😀") for _ in range(r.randrange(40)))) for i in range(40)] + [(5, "abab"), (5, "abé"), (None, "abab"), (None, "ababa"), (50, None)]
    items = [(j, "".join(r.choice("abé😀") for _ in range(9))) for j in range(12)] + [(None, "😀éaaaab")]
    docs, bench = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(items, "id int, t string")
    cut = lambda rows: {(i, t[j : j + 4]) for i, t in rows for j in range(len(t or "") - 3)}
    of, own = defaultdict(set), defaultdict(set)
    for i, w in cut(items):
        of[w].add(i)
    for i, w in cut(texts):
        own[i].add(w)
    held = {(i, sum(w in of for w in ws), len(ws)) for i, ws in own.items()}
    votes = {(i, e, sum(of.get(w) == {e} for w in ws), len(ws)) for i, ws in own.items() if i is not None for e in {i for i, _ in items} if any(of.get(w) == {e} for w in ws)}
    for name, value in (("LONG_TEXT", 2_000_000), ("LONG_TEXT", 30), ("CARRIED", 5)):
        monkeypatch.setattr(kmers, name, value)
        library = kmers.distinct_windows(bench, "id", "t", 4)
        assert {(x.id, x.held, x.total) for x in kmers.text_containment(docs, "id", "t", 4, library).collect()} == held
        assert {(x.id, x.entry, x.hits, x.total) for x in kmers.text_votes(docs, "id", "t", 4, library).collect()} == votes
    monkeypatch.setattr(kmers, "_hashes", lambda points, k: points[: len(points) - k + 1].astype("uint64"))
    assert {"abcabcabd"[j : j + 3] for j in kmers.distinct_starts("abcabcabd", 3)[1]} == {"abc", "bca", "cab", "abd"}


def test_planar_clusters_equal_the_sequential_ones_without_pairs(spark):
    r = random.Random(5)
    pts = {i: (r.randrange(2500), r.randrange(60)) for i in range(250)} | {i: (900, 20) for i in range(250, 320)}
    rows = [(i, "k", p, float(v)) for i, (p, v) in pts.items()]
    df = spark.createDataFrame(rows + [(400, "k", 5, math.nan), (401, None, 5, 1.0), (402, "k", None, 1.0), (403, "k", 5, math.inf)], "id bigint, k string, p bigint, v double")
    got = {x.id: x.cluster for x in cluster.planar_clusters(df, ["k"], "p", "v", 25.0, 5).collect() if x.cluster is not None}
    want = _dbscan(pts, lambda a, b: math.dist(a, b) < 25, 5)
    assert got == want
    rest = {i: p for i, p in pts.items() if i not in want}
    weak = _dbscan(rest, lambda a, b: math.dist(a, b) < 25, 1) | {i: i for i in (400, 401, 402, 403)}
    both = {(x.id, x.cluster, x.strong) for x in cluster.planar_strong_weak(df, ["k"], "p", "v", 25.0, 5).collect()}
    assert both == {(i, c, True) for i, c in want.items()} | {(i, c, False) for i, c in weak.items()}
