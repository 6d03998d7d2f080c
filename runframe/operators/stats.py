"""Experiment statistics: cell statistics, percentiles, histograms, ratios, bootstrap."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runframe.functions.runtime import HOT_GROUP_CONF, HOT_GROUP_ROWS, cut, int_conf, names, same
from runframe.operators.scan import largest_group, scan

RULES = ("lower", "round", "floor", "trunc", "pct", "linear")


def _rank_of(p: float, n: Column, rule: str) -> Column:
    """Zero-based position of the percentile among ``n`` sorted values."""
    if rule == "lower":
        place = F.floor((n - 1) * p)
    elif rule == "round":
        place = F.greatest(F.bround(n * p).cast("long") - 1, F.lit(0))
    elif rule in ("floor", "trunc"):
        place = F.least(F.floor(n * p), n - 1)
    elif rule == "pct":
        place = F.least(F.floor(n * F.lit(int(round(p * 100))) / 100), n - 1)
    else:
        raise ValueError(f"unknown percentile rule {rule!r}")
    return place.cast("long")


#: Buckets that an interval of values is split into, once per pass.
BUCKETS = 1024


def percentiles(df: DataFrame, by: str | Sequence[str], value: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """Exact percentiles per group, all from the same passes. ``wanted`` maps a column name to (p, rule).

    A group that one task can order is: its equal values are counted map-side and numbered by a running count. A larger
    group is narrowed instead. Each pass counts its values in BUCKETS buckets of the interval that holds a wanted rank, and goes on with
    the least and the greatest value of the one bucket that holds it, until the values left are few or equal. Only bucket counts are
    shuffled then, never the group's values. Every pass sets the interval's two ends apart, so it ends for any distribution.
    """
    keys, spark = names(by), df.sparkSession
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"))
    few = int_conf(spark, HOT_GROUP_CONF, HOT_GROUP_ROWS)
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    largest = groups.agg(F.max("_n")).first()[0] or 0
    places = _places(wanted)
    small = rows
    if largest > few:
        own = [F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]
        match = reduce(lambda m, i: m & F.col(keys[i]).eqNullSafe(F.col(f"_g{i}")), range(len(keys)), F.lit(True))
        small = rows.join(groups.where(F.col("_n") > few).select(*own), match, "left_anti") if keys else rows.where(F.lit(False))
    counts = small.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*keys)
    upto = counts.withColumns({"_cum": F.sum("_c").over(group.orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)),
                               "_n": F.sum("_c").over(group)})
    ranked = upto.withColumn("_t", F.explode(places)).select(*keys, "_n", "_cum", "_c", "_x", "_t.*")
    found = ranked.where(_holds("_cum", "_c")).select(*keys, "_n", "_name", F.col("_x").alias("_v"))
    if largest > few:
        found = found.unionByName(_narrowed(rows, groups.where(F.col("_n") > few), keys, places, few))
    picked = found.groupBy(*keys).agg(F.max("_n").alias("_n"), *[
        F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(f"_v_{i}") for i, n in enumerate(_targets(wanted))])
    at = {n: f"_v_{i}" for i, n in enumerate(_targets(wanted))}
    out = {}
    for name, (p, rule) in wanted.items():
        if rule == "linear":
            exact = (F.col("_n") - 1) * F.lit(float(p))
            low, high = F.col(at[name + " low"]), F.col(at[name + " high"])
            out[name] = (low + (high - low) * (exact - F.floor(exact))).cast("double")
        else:
            out[name] = F.col(at[name]).cast("double")
    return picked.select(*keys, *[c.alias(n) for n, c in out.items()])


def _targets(wanted: dict[str, tuple[float, str]]) -> list[str]:
    return [t for n, (_, rule) in wanted.items() for t in ([n + " low", n + " high"] if rule == "linear" else [n])]


def _places(wanted: dict[str, tuple[float, str]]) -> Column:
    """The zero-based ranks of a group of ``_n`` values that are asked for, by name."""
    n, out = F.col("_n"), []
    for name, (p, rule) in wanted.items():
        if rule == "linear":
            low = F.floor((n - 1) * F.lit(float(p))).cast("long")
            out += [(name + " low", low), (name + " high", F.least(low + 1, n - 1))]
        else:
            out.append((name, _rank_of(p, n, rule)))
    return F.array(*[F.struct(F.lit(name).alias("_name"), place.alias("_k")) for name, place in out])


def _holds(cum: str, count: str) -> Column:
    return (F.col(cum) > F.col("_k")) & (F.col(cum) - F.col(count) <= F.col("_k"))


def _narrowed(rows: DataFrame, groups: DataFrame, keys: list[str], places: Column, few: int) -> DataFrame:
    """(keys, _n, _name, _v) of the large ``groups``."""
    state = cut(groups.withColumn("_t", F.explode(places)).select(
        *keys, "_n", "_t.*", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_in")))
    wide = (F.col("_in") > few) & (F.col("_lo") < F.col("_hi"))

    def inside(targets: DataFrame) -> DataFrame:
        """Rows beside each wanted rank of their group whose interval holds them."""
        own = targets.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], "_n", "_name", "_k", "_lo", "_hi", "_below")
        match = F.col("_x").between(F.col("_lo"), F.col("_hi"))
        match = reduce(lambda m, i: m & F.col(keys[i]).eqNullSafe(F.col(f"_g{i}")), range(len(keys)), match)
        return rows.join(own if keys else F.broadcast(own), match).drop(*[f"_g{i}" for i in range(len(keys))])  # without keys: a row per rank

    def bucket(turn: int) -> Column:
        """Bucket of a value in its interval, rising with the value; the two ends have buckets of their own.

        Every other pass splits by roots (halvings of the exponent), which spreads values of many magnitudes. Differences of
        halves do not overflow, and every step is rounded correctly, so larger values never get smaller buckets.
        """
        def place(c: str) -> Column:
            x = F.col(c).cast("double")
            if turn % 2 == 0:
                return x / 2
            return F.signum(x) * reduce(lambda y, _: F.sqrt(y), range(6), F.abs(x))

        share = F.nanvl((place("_x") - place("_lo")) / (place("_hi") - place("_lo")), F.lit(0.5))
        middle = F.greatest(F.lit(1), F.least(F.lit(BUCKETS - 2), F.floor(share * BUCKETS)))
        return F.when(F.col("_x") == F.col("_lo"), 0).when(F.col("_x") == F.col("_hi"), BUCKETS - 1).otherwise(middle)

    facts = [F.max(c).alias(c) for c in ("_n", "_k", "_below")]
    upto = Window.partitionBy(*keys, "_name").rowsBetween(Window.unboundedPreceding, 0)  # at most BUCKETS rows
    turn = 0
    while not state.where(wide).isEmpty():
        counted = inside(state.where(wide)).groupBy(*keys, "_name", bucket(turn).alias("_b")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), *facts)
        summed = counted.withColumn("_cum", F.sum("_c").over(upto.orderBy("_b")) + F.col("_below")).where(_holds("_cum", "_c"))
        state = cut(state.where(~wide).unionByName(summed.select(
            *keys, "_n", "_name", "_k", "_lo", "_hi", (F.col("_cum") - F.col("_c")).alias("_below"), F.col("_c").alias("_in"))))
        turn += 1
    settled = state.where(F.col("_lo") == F.col("_hi")).select(*keys, "_n", "_name", F.col("_lo").alias("_v"))
    counts = inside(state.where(F.col("_lo") < F.col("_hi"))).groupBy(*keys, "_name", "_x").agg(F.count(F.lit(1)).alias("_c"), *facts)
    summed = counts.withColumn("_cum", F.sum("_c").over(upto.orderBy("_x")) + F.col("_below"))  # at most ``few`` rows
    return settled.unionByName(summed.where(_holds("_cum", "_c")).select(*keys, "_n", "_name", F.col("_x").alias("_v")))


def nearest_rank(df: DataFrame, by: str | Sequence[str], value: str, p: float, rule: str,
                 name: str = "percentile") -> DataFrame:
    """Exact percentile per group by one of ``lower round floor trunc pct linear``; see ``percentiles``."""
    return percentiles(df, by, value, {name: (p, rule)})


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not keys:
        return left.withColumns({c: right.select(c).scalar() for c in right.columns})  # one row
    own = {f"_beside_{k}": k for k in keys}  # names of its own, since both sides may come from one frame
    met = right.select(*[F.col(k).alias(n) for n, k in own.items()], *[c for c in right.columns if c not in keys])
    match = reduce(lambda m, n: m & F.col(own[n]).eqNullSafe(F.col(n)), own, F.lit(True))
    return left.join(met, match, "left").drop(*own)


def cell_stats(df: DataFrame, by: str | Sequence[str], value: str, pctl: str = "lower") -> DataFrame:
    """Count, mean, population standard deviation and 95th percentile of each cell."""
    keys = names(by)
    base = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return _beside(base, nearest_rank(df, keys, value, 0.95, pctl, "p95"), keys)


def history_stats(runs: DataFrame, by: str | Sequence[str], value: str = "makespan_s") -> DataFrame:
    """Statistics over positive makespans: n, mean, median, min, max, p95 (floor rule), std."""
    keys = names(by)
    good = runs.where(F.col(value) > 0)
    base = good.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.stddev_pop(value).alias("std"))
    return _beside(base, percentiles(good, keys, value, {"median": (0.5, "linear"), "p95": (0.95, "floor")}), keys)


def histogram(df: DataFrame, by: str | Sequence[str], value: str, bins: int, zero_span: float = 1.0) -> DataFrame:
    """Equal-width bins per group with empty bins kept; the last bin is closed."""
    keys = names(by)
    clean = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"))
    span = clean.groupBy(*keys).agg(F.min("_x").cast("double").alias("_lo"), F.max("_x").cast("double").alias("_hi"))
    range_ = F.when(F.col("_hi") - F.col("_lo") < 1e-9, F.lit(float(zero_span))).otherwise(F.col("_hi") - F.col("_lo"))
    span = span.withColumn("_w", range_ / bins)
    place = F.floor((F.col("_x") - F.col("_lo")) / F.col("_w"))
    # a row meets its group's span and falls into a bin before anything is shuffled for the counts
    counts = (_beside(clean, span, keys)
              .withColumn("bin", F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("int"))
              .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("_count")))
    every = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    joined = every.join(counts, same(every, counts, [*keys, "bin"]), "left")
    return joined.select(*[every[k] for k in keys], every["bin"],
                         (F.col("_lo") + every["bin"] * F.col("_w")).alias("lo"),
                         F.coalesce("_count", F.lit(0)).cast("long").alias("count"))


def speedup(stats: DataFrame, base: str, other: str, by: str | Sequence[str], system: str = "system") -> DataFrame:
    """Per cell: mean of ``other`` over mean of ``base`` and the ratio of their deviations."""
    def side(label: str, col: str) -> Column:
        return F.max(F.when(F.col(system) == label, F.col(col)))

    wide = stats.where(F.col(system).isin(base, other)).groupBy(*names(by)).agg(
        side(base, "mean").alias("base_mean"), side(other, "mean").alias("other_mean"),
        side(base, "std").alias("base_std"), side(other, "std").alias("other_std"))
    return wide.where(F.col("base_mean") > 0).withColumns({
        "speedup": F.col("other_mean") / F.col("base_mean"),
        "std_ratio": F.when(F.col("base_std") > 0, F.col("other_std") / F.col("base_std")),
    }).where(F.col("speedup").isNotNull())


def verdict(ratios: DataFrame, pass_at: float = 2.0, cond_at: float = 1.5, ratio: str = "speedup",
            by: str | Sequence[str] = ()) -> DataFrame:
    """PASS, CONDITIONAL or FAIL from the smallest ratio; DEFERRED without any."""
    low = F.min(ratio)
    label = (F.when(low.isNull(), "DEFERRED").when(low >= pass_at, "PASS").when(low >= cond_at, "CONDITIONAL")
             .otherwise("FAIL"))
    return ratios.groupBy(*names(by)).agg(low.alias("min_ratio"), label.alias("verdict"))


def seed_speedup_median(runs: DataFrame, base: str, other: str, by: str | Sequence[str] = "cell",
                        seed: str = "seed", value: str = "makespan_s") -> DataFrame:
    """Mean ratio per seed, then the median over seeds and the seeds that won."""
    keys = names(by)

    def mean_of(label: str) -> Column:
        return F.avg(F.when(F.col("system") == label, F.col(value)))

    ratios = (runs.groupBy(*keys, seed).agg((mean_of(other) / mean_of(base)).alias("ratio"))
              .where("ratio IS NOT NULL"))
    facts = ratios.groupBy(*keys).agg(F.count(F.lit(1)).alias("seeds"), F.count_if(F.col("ratio") > 1).alias("wins"))
    return _beside(facts, nearest_rank(ratios, keys, "ratio", 0.5, "linear", "median_ratio"), keys)


def grouped_means(runs: DataFrame, by: str | Sequence[str], pivot: str, systems: Sequence[str],
                  value: str = "makespan_s") -> DataFrame:
    """Mean per group with one column per system."""
    return runs.groupBy(*names(by)).agg(*[
        F.avg(F.when(F.col(pivot) == s, F.col(value))).alias(f"mean_{s}") for s in systems])


def sensitivity(runs: DataFrame, axis: str, fixed: dict[str, object], value: str = "makespan_s",
                by: str | Sequence[str] = "system") -> DataFrame:
    """Mean and deviation along one axis with the other axes held fixed."""
    held = runs
    for name, wanted in fixed.items():
        held = held.where(F.col(name) == wanted)
    return held.groupBy(*names(by), axis).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def prediction_error(pairs: DataFrame, by: str | Sequence[str], iteration: str = "iteration",
                     warm_after: int = 4) -> DataFrame:
    """Mean absolute percentage error of predicted against actual after the warm-up."""
    warm = pairs.where((F.col(iteration) > warm_after) & (F.col("actual") != 0))
    error = F.abs(F.col("actual") - F.col("predicted")) / F.col("actual") * 100
    return warm.groupBy(*names(by)).agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mean_error_pct"))


def paired_bootstrap(deltas: DataFrame, baseline: DataFrame, by: str | Sequence[str], order: str | Sequence[str],
                     resamples: int = 10_000, alpha: float = 0.05, seed: int = 42,
                     array_rows: int = 200_000) -> DataFrame:
    """Mean paired delta per cell with a percentile bootstrap interval and relative forms.

    ``baseline``: cell keys and ``makespan_s`` of every valid baseline run. Draw i of resample r is a
    hash of (seed, cell, r, i), so results repeat. Cells up to ``array_rows`` deltas travel as one array to
    blocks of resamples; when a cell is larger every draw is joined to its delta instead, with
    the same draws and thus the same interval.
    """
    keys = names(by)
    base = deltas.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("delta").alias("mean_delta"),
        F.count_if(F.col("delta") > 0).alias("wins"))
    means = (_means_by_array if largest_group(deltas, keys)[1] <= array_rows else _means_by_join)(
        deltas, keys, order, resamples, seed)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("mean", "r"))  # ``resamples`` rows per cell
    ranked = means.withColumn("_k", place - 1)
    low, high = int(resamples * alpha / 2), int(resamples * (1 - alpha / 2))
    interval = ranked.where(F.col("_k").isin(low, high)).groupBy(*keys).agg(
        F.min("mean").alias("ci_lo"), F.max("mean").alias("ci_hi"))
    reference = baseline.groupBy(*keys).agg(F.avg("makespan_s").alias("baseline_mean"))
    out = _beside(_beside(base, interval, keys), reference, keys)

    def share(col: str) -> Column:
        return F.when(F.col("baseline_mean") != 0, F.col(col) / F.col("baseline_mean") * 100).otherwise(0.0)

    return out.withColumns({"speedup_pct": share("mean_delta"), "ci_lo_pct": share("ci_lo"),
                            "ci_hi_pct": share("ci_hi")})


# fixed value: prime modulus of the draw arithmetic (2^31 - 1)
PRIME = 2_147_483_647


def _seeds(seed: int, keys: Sequence[str], r: Column) -> tuple[Column, Column]:
    """Two numbers below ``PRIME`` per (cell, resample)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], r.cast("string")))
    first = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % PRIME
    second = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long") % PRIME
    return first, second


def _draw(a: Column, b: Column, i: Column, n: Column) -> Column:
    """Position (from 0) of draw ``i``: two squaring steps modulo a prime are the halves of one number of 62 bits,
    taken modulo ``n``.

    ``i`` enters by its remainder and its quotient, so draws and cells beyond the prime are covered alike.
    """
    i = i.cast("long")
    x = (a + i * 69_621) % PRIME
    x = (x * x + b + ((i - i % PRIME) / PRIME).cast("long")) % PRIME
    return (x * PRIME + (x * x + a) % PRIME) % n


def _means_by_array(deltas: DataFrame, keys: list[str], order, resamples: int, seed: int) -> DataFrame:
    block = 100
    order = names(order)
    sample = F.transform(F.sort_array(F.collect_list(F.struct(*order, "delta"))), lambda s: s["delta"])
    cells = deltas.groupBy(*keys).agg(sample.alias("_d"))
    blocks = (cells.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // block))))
              .repartition(-(-resamples // block), *keys, "_b"))
    rows = (blocks.withColumn("r", F.explode(F.sequence(F.col("_b") * block, (F.col("_b") + 1) * block - 1)))
            .where(F.col("r") < resamples))
    a, b = _seeds(seed, keys, F.col("r"))
    n = F.size("_d")
    draws = (rows.withColumns({"_s1": a, "_s2": b})
             .select(*keys, "r", "_d", "_s1", "_s2", F.explode(F.sequence(F.lit(0), n - 1)).alias("_i")))
    drawn = F.element_at("_d", (_draw(F.col("_s1"), F.col("_s2"), F.col("_i"), n) + 1).cast("int"))
    # draws are generated and summed inside one stage; only one sum per resample is shuffled
    return (draws.select(*keys, F.col("r").cast("long").alias("r"), drawn.alias("_x"))
            .groupBy(*keys, "r").agg(F.avg("_x").alias("mean")))


def _means_by_join(deltas: DataFrame, keys: list[str], order, resamples: int, seed: int) -> DataFrame:
    numbered = scan(deltas, keys, order, {"_i": ("row_number",), "_n": ("total", F.lit(1).cast("long"))})
    sample = numbered.select(*keys, (F.col("_i") - 1).alias("_j"), "delta")
    a, b = _seeds(seed, keys, F.col("r"))
    draws = (numbered.select(*keys, "_n", (F.col("_i") - 1).alias("_i"))
             .withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
             .withColumn("_j", _draw(a, b, F.col("_i"), F.col("_n"))))
    drawn = draws.join(sample, [*keys, "_j"])
    return drawn.groupBy(*keys, "r").agg(F.avg("delta").alias("mean")).withColumn("r", F.col("r").cast("long"))
