"""Statistics against plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

import runframe as rf

PLACES = {
    "lower": lambda n: int(0.95 * (n - 1)), "round": lambda n: max(0, round(0.95 * n) - 1),
    "floor": lambda n: min(n - 1, int(0.95 * n)), "trunc": lambda n: min(n - 1, int(n * 0.95)),
    "pct": lambda n: min(n * 95 // 100, n - 1)}


def values(spark):
    rng = random.Random(4)
    data = [(g, float(rng.randrange(30))) for g, n in (("a", 1), ("b", 10), ("c", 57), ("d", 200)) for _ in range(n)]
    return data, spark.createDataFrame(data, "g string, x double")


@pytest.mark.parametrize("rule", PLACES)
def test_percentile_rules(hot, rule):
    data, df = values(hot)
    got = {r.g: r.percentile for r in rf.nearest_rank(df, "g", "x", 0.95, rule).collect()}
    for g in "abcd":
        ordered = sorted(x for k, x in data if k == g)
        assert got[g] == ordered[PLACES[rule](len(ordered))]


def test_linear_and_cell_stats(hot):
    data, df = values(hot)
    linear = {r.g: r.percentile for r in rf.nearest_rank(df, "g", "x", 0.3, "linear").collect()}
    stats = {r.g: r for r in rf.cell_stats(df, "g", "x").collect()}
    for g in "abcd":
        xs = [x for k, x in data if k == g]
        assert linear[g] == pytest.approx(np.percentile(xs, 30))
        assert (stats[g].n, stats[g].mean) == (len(xs), pytest.approx(statistics.mean(xs)))
        assert stats[g]["std"] == pytest.approx(statistics.pstdev(xs))
    overall = rf.cell_stats(df, [], "x").first()
    assert overall.n == len(data)


def test_percentiles_of_any_distribution(spark, monkeypatch):
    """Large groups are narrowed bucket by bucket: outliers, ties, infinities and both signs, for several ranks at once."""
    rng = random.Random(9)
    shapes = {
        "normal": [rng.gauss(0, 1) for _ in range(700)], "ties": [float(rng.randrange(3)) for _ in range(700)], "one": [7.0] * 500,
        "far": [10.0 ** rng.randrange(-300, 300) for _ in range(400)], "signs": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-9, 9) for _ in range(400)],
        "ends": [float("-inf")] * 30 + [float("inf")] * 30 + [rng.random() for _ in range(40)], "few": [3.0, 1.0, 2.0], None: [0.0, 5.0] * 300}
    data = [(g, x) for g, xs in shapes.items() for x in xs] + [("few", None), ("empty", None)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    wanted = {"p0": (0.0, "lower"), "p5": (0.05, "floor"), "p50": (0.5, "round"), "p99": (0.99, "trunc"), "p100": (1.0, "pct"), "med": (0.5, "linear")}
    want = {}
    for g, xs in shapes.items():
        xs, n = sorted(xs), len(xs)
        want[g] = (xs[0], xs[min(n - 1, int(0.05 * n))], xs[max(0, round(0.5 * n) - 1)], xs[min(n - 1, int(0.99 * n))], xs[-1],
                   xs[(n - 1) // 2] + (xs[n // 2] - xs[(n - 1) // 2]) * (((n - 1) * 0.5) % 1))
    for buckets, few in ((1024, 100), (32, 0), (1024, 2_000_000)):
        monkeypatch.setattr("runframe.operators.stats.BUCKETS", buckets)
        spark.conf.set("spark.runframe.hotGroupRows", str(few))
        try:
            got = {r.g: tuple(r)[1:] for r in rf.percentiles(df, "g", "x", wanted).collect()}
            whole = rf.percentiles(df, None, "x", wanted).first()
        finally:
            spark.conf.unset("spark.runframe.hotGroupRows")
        assert set(got) == set(want)
        for g in want:
            assert got[g] == pytest.approx(want[g], nan_ok=True), g
        every = sorted(x for xs in shapes.values() for x in xs)
        assert whole.p50 == every[round(0.5 * len(every)) - 1] and whole.p0 == float("-inf")
    assert rf.percentiles(df.limit(0), "g", "x", wanted).count() == 0


def test_ema_equals_fold(hot):
    rng = random.Random(1)
    data = [(rng.choice("ppq"), i, rng.random() * 9, rng.choice([0.0, rng.random() * 100])) for i in range(160)]
    df = hot.createDataFrame(data, "k string, at long, runtime double, data_bytes double")
    got = {r.k: r for r in rf.ema_profile(df, "k", "at", max_samples=50).collect()}
    for k in "pq":
        old = None
        for _, _, x, d in sorted((r for r in data if r[0] == k), key=lambda r: r[1]):
            if old is None:
                old = [x, d, 1]
            else:
                old = [0.3 * x + 0.7 * old[0], 0.3 * d + 0.7 * old[1] if d > 0 else old[1], min(50, old[2] + 1)]
        assert got[k].runtime_ema == pytest.approx(old[0])
        assert got[k].data_ema == pytest.approx(old[1])
        assert got[k].samples == old[2]


def test_bootstrap_paths_agree_and_match_theory(spark):
    rng = np.random.default_rng(9)
    sample = rng.normal(3.0, 2.0, 60)
    df = spark.createDataFrame([("c", i, float(x)) for i, x in enumerate(sample)], "cell string, rep long, delta double")
    base = spark.createDataFrame([("c", 10.0), ("c", 30.0)], "cell string, makespan_s double")
    by_array = rf.paired_bootstrap(df, base, "cell", "rep", resamples=2000).first()
    by_join = rf.paired_bootstrap(df, base, "cell", "rep", resamples=2000, array_rows=0).first()
    assert by_array.ci_lo == pytest.approx(by_join.ci_lo) and by_array.ci_hi == pytest.approx(by_join.ci_hi)
    means = np.sort([rng.choice(sample, len(sample)).mean() for _ in range(20_000)])
    spread = means.std()
    assert by_array.ci_lo == pytest.approx(means[500], abs=0.25 * spread)
    assert by_array.ci_hi == pytest.approx(means[19_500], abs=0.25 * spread)
    assert by_array.speedup_pct == pytest.approx(sample.mean() / 20 * 100)


def test_histogram_edges(spark):
    flat = spark.createDataFrame([("f", 2.0)] * 3 + [("g", float(x)) for x in range(11)], "g string, x double")
    got = {(r.g, r.bin): r["count"] for r in rf.histogram(flat, "g", "x", 5).collect()}
    assert [got["f", b] for b in range(5)] == [3, 0, 0, 0, 0]
    assert [got["g", b] for b in range(5)] == [2, 2, 2, 2, 3]


def test_verdict_without_rows(spark):
    none = spark.createDataFrame([], "speedup double")
    assert rf.verdict(none).first().verdict == "DEFERRED"


def test_lanes(hot):
    rng = random.Random(8)
    data = [("g" if i % 3 else "h", f"t{i:03d}", float(rng.randrange(200)), 0.0) for i in range(150)]
    data = [(g, t, s, s + rng.randrange(0, 25)) for g, t, s, _ in data]
    df = hot.createDataFrame(data, "g string, task string, start double, end double")
    got = {r.task: r.lane for r in rf.assign_lanes(df, "g").collect()}
    for g in "gh":
        ends = []
        for _, t, s, e in sorted((r for r in data if r[0] == g), key=lambda r: (r[2], r[1])):
            lane = next((i for i, x in enumerate(ends) if s >= x), len(ends))
            ends[lane:lane + 1] = [e]
            assert got[t] == lane


def test_overlap_special_cases(spark):
    df = spark.createDataFrame([("one", "a", 5.0, 5.0), ("touch", "a", 0.0, 1.0), ("touch", "b", 1.0, 2.0),
                                ("zero", "a", 1.0, 1.0), ("zero", "b", 1.0, 1.0)],
                               "g string, task string, start double, end double")
    assert {r.g: r.max_overlap for r in rf.max_overlap(df, "g").collect()} == {"one": 1, "touch": 1, "zero": 0}


def test_busy_time_never_exceeds_span(spark):
    rng = random.Random(6)
    data = [("g", f"t{i}", s := rng.random() * 50, s + rng.random() * 9) for i in range(80)]
    df = spark.createDataFrame(data, "g string, task string, start double, end double")
    row = rf.busy_time(df, "g").first()
    edges = sorted({x for r in data for x in r[2:]})
    union = sum(b - a for a, b in zip(edges, edges[1:]) if any(s <= a and b <= e for _, _, s, e in data))
    assert row.busy == pytest.approx(union) and row.busy <= row.span + 1e-9


def test_stages(spark):
    flow = rf.Stages()
    flow.source("in", spark.range(10))
    flow.stage("even", ["in"], lambda x: x["in"].where("id % 2 = 0"))
    assert flow.result("even").count() == 5
    with pytest.raises(ValueError):
        flow.stage("orphan", [], lambda x: None)
    with pytest.raises(ValueError):
        flow.stage("late", ["nothing"], lambda x: None)
    assert F.col("id") is not None
