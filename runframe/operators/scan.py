"""Ordered running values per group, safe for groups of any size.

A plain window sends one group to one task. ``scan`` first draws a sample of the group and order columns: every task keeps its
i-th row with probability SAMPLE / i and weight i / SAMPLE, so a task adds a few thousand rows at most whatever its size, and
neither file sizes nor plan estimates are asked. If no group's weight exceeds the limit, a plain window it is.

A group beyond the limit is split into chunks at places of its order taken from the sample. The totals of its
chunks are aggregated first (map-side combined, needed columns only), summed up in order, and added
to the running values inside each chunk. At most PARTS groups are beyond the limit and at most 2 x PARTS chunks exist, because the
limit grows with the input; so both broadcasts are bounded. The sample decides only where the work is done, not the result. The input
is read once more for the sample and, if a group is split, once more for the totals; it must give the same rows each time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runframe.functions.runtime import (
    HOT_GROUP_CONF, HOT_GROUP_ROWS, HOT_PARTS, HOT_PARTS_CONF, int_conf, names, order_columns)

CHUNK = "_chunk"
SAMPLE = 256
#: Sampled rows that place one chunk border.
PER_BORDER = 32

Spec = tuple[str] | tuple[str, Column]


def weighted_sample(df: DataFrame, columns: Sequence[str], seed: int = 7) -> DataFrame:
    """``columns`` and ``_w``: a sample whose weights add up to about the number of rows; small tasks are taken whole."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's place in its task
    drawn = df.select(*columns, F.greatest(F.lit(1.0), place / SAMPLE).alias("_w"), F.rand(seed).alias("_r"))
    return drawn.where(F.col("_r") * F.col("_w") < 1).drop("_r")


def largest_group(df: DataFrame, by: str | Sequence[str] | None) -> tuple[float, float]:
    """Estimates of all rows and of the rows of the largest group, from a sample."""
    sizes = weighted_sample(df, names(by)).groupBy(*names(by)).agg(F.sum("_w").alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    return total or 0.0, most or 0.0


def has_hot_group(df: DataFrame, by: str | Sequence[str] | None, hot_rows: int | None = None) -> bool:
    """Whether some group has more than about ``hot_rows`` rows."""
    limit = int_conf(df.sparkSession, HOT_GROUP_CONF, HOT_GROUP_ROWS) if hot_rows is None else hot_rows
    return largest_group(df, by)[1] > limit


def scan(df: DataFrame, by: str | Sequence[str] | None, order: str | Sequence[str],
         outputs: dict[str, Spec], hot: bool | None = None) -> DataFrame:
    """Add running columns. ``outputs`` maps a new name to one of

    ``("row_number",)``, ``("sum", x)``, ``("sum_before", x)``, ``("max_before", x)``,
    ``("lag", x)``, ``("last_before", x)`` (last non-null), ``("total", x)`` (whole group).
    ``order`` must be unique within a group for a repeatable result. ``hot=False`` passes on that no group of these is
    too large, and saves the sample.
    """
    by = names(by)
    borders = None if hot is False else _borders(df, by, names(order))
    if borders is not None:
        return _chunked(df, by, names(order), outputs, borders)
    ordered = Window.partitionBy(*by).orderBy(*order_columns(order))
    return df.withColumns({name: _local(spec, ordered, Window.partitionBy(*by))
                           for name, spec in outputs.items()})


def _value(spec: Spec) -> Column:
    return F.lit(1).cast("long") if spec[0] == "row_number" else spec[1]


def _local(spec: Spec, ordered, whole) -> Column:
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    kind, value = spec[0], _value(spec)
    if kind in ("row_number", "sum"):
        return F.sum(value).over(upto)
    if kind == "sum_before":
        running = F.sum(value).over(before)
        return F.coalesce(running, F.sum(value).over(whole) * 0)
    if kind == "max_before":
        return F.max(value).over(before)
    if kind == "lag":
        return F.lag(value).over(ordered)
    if kind == "last_before":
        return F.last(value, ignorenulls=True).over(before)
    if kind == "total":
        return F.sum(value).over(whole)
    raise ValueError(f"unknown running value {kind!r}")


# --- groups in chunks -------------------------------------------------------------------------

def _plain(order: list[str]) -> list[str]:
    return [o.removeprefix("-") for o in order]


def _borders(df: DataFrame, by: list[str], order: list[str]) -> DataFrame | None:
    """One row per group beyond the limit: its key columns ``_k0``… and its chunk borders, in two levels; None without such a group."""
    spark = df.sparkSession
    columns = list(dict.fromkeys([*by, *_plain(order)]))
    sample = weighted_sample(df, columns).persist()
    try:
        sizes = sample.groupBy(*by).agg(F.sum("_w").alias("_n"))
        total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
        parts = int_conf(spark, HOT_PARTS_CONF, HOT_PARTS)
        limit = max(int_conf(spark, HOT_GROUP_CONF, HOT_GROUP_ROWS), (total or 0.0) / parts)
        if not most or most <= limit:
            return None
        step = limit / 2
        keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
        places = [F.col(c).alias(f"_o{i}") for i, c in enumerate(_plain(order))]
        keep = F.least(F.lit(1.0), F.lit(PER_BORDER / step) * F.col("_w"))
        thin = sample.where(F.rand(11) < keep).select(*keys, *places, (F.col("_w") / keep).alias("_w"))
        wide = sizes.where(F.col("_n") > limit).select(*keys)
        same = F.lit(True)
        for i in range(len(by)):
            same = same & thin[f"_k{i}"].eqNullSafe(wide[f"_k{i}"])
        kept = thin.join(F.broadcast(wide), same, "left_semi") if by else thin
        names_k, names_o = [f"_k{i}" for i in range(len(by))], [f"_o{i}" for i in range(len(order))]
        running = Window.partitionBy(*names_k).orderBy(*order_columns(
            [("-" if o.startswith("-") else "") + f"_o{i}" for i, o in enumerate(order)])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = kept.withColumn("_c", F.sum("_w").over(running))
        # at most two borders per step of all rows
        found = (upto.where(F.floor(F.col("_c") / step) > F.floor((F.col("_c") - F.col("_w")) / step))
                 .orderBy(*names_k, "_c").select(*names_k, *names_o).collect())
    finally:
        sample.unpersist()
    groups: dict[tuple, list[tuple]] = {}
    for row in found:
        groups.setdefault(tuple(row[k] for k in names_k), []).append(tuple(row[o] for o in names_o))
    if not groups:
        return None
    border = T.StructType([T.StructField(o, df.schema[c].dataType) for o, c in zip(names_o, _plain(order))])
    schema = T.StructType([*[T.StructField(k, df.schema[c].dataType) for k, c in zip(names_k, by)],
                           T.StructField("_wide", T.IntegerType()), T.StructField("_outer", T.ArrayType(border)),
                           T.StructField("_inner", T.ArrayType(T.ArrayType(border)))])
    rows = []
    for key, places in groups.items():
        width = max(1, int(len(places) ** 0.5))
        inner = [places[i:i + width] for i in range(0, len(places), width)]
        rows.append((*key, width, [part[0] for part in inner[1:]], inner))
    return spark.createDataFrame(rows, schema)


def _passed(order: list[str], border: Column) -> Column:
    """Whether a row comes after ``border`` in the order (nulls last, as in ``order_columns``)."""
    out, tied = F.lit(False), F.lit(True)
    for i, item in enumerate(order):
        own, other = F.col(item.removeprefix("-")), border[f"_o{i}"]
        after = own < other if item.startswith("-") else own > other
        out = out | (tied & F.coalesce(after, own.isNull() & other.isNotNull()))
        tied = tied & own.eqNullSafe(other)
    return out


def _with_chunk(df: DataFrame, by: list[str], order: list[str], borders: DataFrame) -> DataFrame:
    """``df`` with its chunk's number inside the group (0 for groups that are not split) and whether the group is split."""
    same = F.lit(True)  # without keys: one row
    for i, name in enumerate(by):
        same = same & df[name].eqNullSafe(borders[f"_k{i}"])
    met = df.join(F.broadcast(borders), same, "left")
    outer = F.size(F.filter("_outer", lambda b: _passed(order, b)))
    inner = F.size(F.filter(F.get("_inner", F.col(CHUNK)), lambda b: _passed(order, b)))
    split = F.col("_outer").isNotNull()
    return (met.withColumn(CHUNK, F.when(split, outer))
            .withColumn(CHUNK, F.when(split, F.col(CHUNK) * (F.col("_wide") + 1) + inner).otherwise(F.lit(0)))
            .withColumn("_split", split).select(*df.columns, CHUNK, "_split"))


def _chunked(df: DataFrame, by: list[str], order: list[str], outputs: dict[str, Spec], borders: DataFrame) -> DataFrame:
    valued = df.withColumns({f"_x_{n}": _value(s) for n, s in outputs.items()})
    base = _with_chunk(valued, by, order, borders)
    specs = {n: (s[0], F.col(f"_x_{n}")) for n, s in outputs.items()}
    ordered, whole = Window.partitionBy(*by, CHUNK).orderBy(*order_columns(order)), Window.partitionBy(*by, CHUNK)
    local = base.withColumns({**{f"_v_{n}": _local(s, ordered, whole) for n, s in specs.items()}, "_head": F.row_number().over(ordered) == 1})
    carry = _carry(_totals(base.where("_split"), by, order, specs), by, specs)
    match = local[CHUNK] == carry["_c_chunk"]
    for name in by:
        match = match & local[name].eqNullSafe(carry[f"_c_key_{name}"])
    joined = local.join(F.broadcast(carry), match, "left")
    return joined.select(*[local[c] for c in df.columns], *[_combine(n, s).alias(n) for n, s in specs.items()])


def _totals(rows: DataFrame, by: list[str], order: list[str], specs: dict[str, Spec]) -> DataFrame:
    """(by, chunk, one total per output). Sums and maxima are combined per task; last values need their chunk's order."""
    sums = {n: s for n, s in specs.items() if s[0] not in ("lag", "last_before")}
    lasts = {n: s for n, s in specs.items() if n not in sums}
    reduced = rows.groupBy(*by, CHUNK).agg(F.count(F.lit(1)).alias("_rows"), *[
        (F.max(x) if kind == "max_before" else F.sum(x)).alias(f"_i_{n}") for n, (kind, x) in sums.items()])
    if not lasts:
        return reduced
    ordered = Window.partitionBy(*by, CHUNK).orderBy(*order_columns(order))
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    narrow = rows.select(*dict.fromkeys([*by, *_plain(order)]), CHUNK, *[f"_x_{n}" for n in lasts])
    tails = narrow.withColumns({**{f"_i_{n}": x if kind == "lag" else F.last(x, ignorenulls=True).over(upto) for n, (kind, x) in lasts.items()},
                                "_tail": F.lead(F.lit(1)).over(ordered).isNull()}).where("_tail")
    tails = tails.select(*[F.col(c).alias(f"_t_{c}") for c in (*by, CHUNK)], *[f"_i_{n}" for n in lasts])
    match = reduced[CHUNK] == tails[f"_t_{CHUNK}"]
    for name in by:
        match = match & reduced[name].eqNullSafe(tails[f"_t_{name}"])
    return reduced.join(tails, match).drop(*[f"_t_{c}" for c in (*by, CHUNK)])


def _carry(totals: DataFrame, by: list[str], specs: dict[str, Spec]) -> DataFrame:
    """What the chunks before add to each chunk's values; a row per chunk of the split groups."""
    chunks = Window.partitionBy(*by).orderBy(CHUNK)
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    columns = {}
    for name, (kind, *_) in specs.items():
        value = F.col(f"_i_{name}")
        if kind == "max_before":
            columns[f"_c_{name}"] = F.max(value).over(earlier)
        elif kind == "lag":
            columns[f"_c_{name}"] = F.lag(value).over(chunks)
        elif kind == "last_before":
            columns[f"_c_{name}"] = F.last(value, ignorenulls=True).over(earlier)
        elif kind == "total":
            columns[f"_c_{name}"] = F.sum(value).over(group)
        else:
            columns[f"_c_{name}"] = F.sum(value).over(earlier)
    return totals.withColumns(columns).select(F.col(CHUNK).alias("_c_chunk"), *[F.col(n).alias(f"_c_key_{n}") for n in by], *columns)


def _combine(name: str, spec: Spec) -> Column:
    here, carried = F.col(f"_v_{name}"), F.col(f"_c_{name}")
    kind = spec[0]
    if kind == "max_before":
        return F.greatest(here, carried)
    if kind == "lag":
        return F.when(F.col("_head"), carried).otherwise(here)
    if kind == "last_before":
        return F.coalesce(here, carried)
    if kind == "total":
        return F.coalesce(carried, here)
    return F.coalesce(here + carried, here, carried)
