"""Column-level jobs over tables of specs, runs and names."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runframe.functions.runtime import names

# fixed values: unit multipliers of the three size dialects and of memory quantities
SIZE_UNITS = {
    "a": {"GIB": 1 << 30, "MIB": 1 << 20, "KIB": 1 << 10,
          "GB": 1_000_000_000, "MB": 1_000_000, "KB": 1_000, "B": 1},
    "b": {"GB": 1_000_000_000, "MB": 1_000_000, "KB": 1_000},
    "c": {"TB": 1_000_000_000_000, "GB": 1_000_000_000, "MB": 1_000_000, "KB": 1_000, "B": 1},
}
MEMORY_UNITS = {"Ki": 1 << 10, "Mi": 1 << 20, "Gi": 1 << 30, "Ti": 1 << 40,
                "K": 10**3, "M": 10**6, "G": 10**9, "T": 10**12}
NULL_MARKERS = ("", "?", "NA")


def numeric_or_null(col: Column, type_name: str = "double") -> Column:
    """Null markers and unparsable text become null."""
    text = F.trim(col.cast("string"))
    return F.when(~text.isin(*NULL_MARKERS), text.try_cast(type_name))


def valid_runs(runs: DataFrame, numeric: str = "double", value: str = "makespan_s",
               phase: str = "phase") -> DataFrame:
    """Succeeded runs whose ``value`` parses as ``numeric`` (``"double"`` or ``"int"``)."""
    text = F.trim(F.col(value).cast("string"))
    shape = r"^[+-]?\d+$" if numeric == "int" else r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    parsed = F.when(text.rlike(shape), text.try_cast("bigint" if numeric == "int" else "double"))
    return runs.where(F.col(phase) == "Succeeded").withColumn(value, parsed).where(F.col(value).isNotNull())


def search(df: DataFrame, query: str, cols: Sequence[str]) -> DataFrame:
    """Case-insensitive substring match over ``cols``; a blank query keeps every row."""
    needle = query.strip().lower()
    if not needle:
        return df
    hit = F.lit(False)
    for name in cols:
        hit = hit | F.coalesce(F.lower(F.col(name)).contains(needle), F.lit(False))
    return df.where(hit)


def _unit(text: Column, units: dict[str, int], test: str) -> Column:
    out = None
    for unit, factor in units.items():
        hit = getattr(text, test)(unit)
        value = F.lit(factor).cast("long")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def size_bytes(col: Column, dialect: str = "a") -> Column:
    """Bytes of a size text such as ``100MB``.

    ``a``: decimal and binary units, fractions allowed, bad text is 0.
    ``b``: leading integer times the unit found anywhere in the text.
    ``c``: decimal units up to TB, bad text is null.
    """
    text = F.upper(F.trim(col))
    factor = _unit(text, SIZE_UNITS[dialect], "contains" if dialect == "b" else "endswith")
    if dialect == "b":
        lead = F.regexp_extract(text, r"^([+-]?\d+)", 1)
        number = F.coalesce(F.nullif(lead, F.lit("")).try_cast("bigint"), F.lit(0))
        return F.coalesce(number * F.coalesce(factor, F.lit(1)), F.lit(0))
    head = F.trim(F.regexp_replace(text, "[A-Z]+$", ""))
    number = F.when(head.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(E[+-]?\d+)?$"), head.try_cast("double"))
    tail = F.regexp_extract(text, "([A-Z]+)$", 1)
    known = F.coalesce(tail.isin(*SIZE_UNITS[dialect]), F.lit(False))
    scaled = F.when(known, (number * factor).try_cast("bigint"))
    plain = F.when(tail == "", head.try_cast("bigint") if dialect == "a" else number.try_cast("bigint"))
    if dialect == "a":
        return F.coalesce(scaled, plain, F.lit(0).cast("long"))
    return F.when((col.isNull()) | (col == ""), F.lit(0).cast("long")).otherwise(F.coalesce(scaled, plain))


def normalize_sizes(specs: DataFrame, cols: str | Sequence[str], dialect: str = "a") -> DataFrame:
    """Add ``<col>_bytes`` for each size column."""
    return specs.withColumns({f"{c}_bytes": size_bytes(F.col(c), dialect) for c in names(cols)})


def cpu_millicores(col: Column) -> Column:
    whole = F.coalesce(F.regexp_extract(col, r"^([+-]?\d+)[num]$", 1).try_cast("bigint"), F.lit(0))
    unit = F.substring(col, -1, 1)
    cores = F.coalesce((col.try_cast("double") * 1000).try_cast("bigint"), F.lit(0))
    divisor = F.when(unit == "n", 1_000_000).when(unit == "u", 1_000)
    return (F.when(col.isNull() | (col == ""), F.lit(0))
            .when(unit == "m", whole)
            .when(divisor.isNotNull(), (whole / divisor).cast("bigint"))
            .otherwise(cores).cast("long"))


def memory_bytes(col: Column) -> Column:
    digits = F.regexp_extract(col, r"^([+-]?\d+)(Ki|Mi|Gi|Ti|K|M|G|T)?$", 1)
    number = F.coalesce(F.nullif(digits, F.lit("")).try_cast("bigint"), F.lit(0))
    factor = F.coalesce(_unit(col, MEMORY_UNITS, "endswith"), F.lit(1))
    return F.coalesce(number * factor, F.lit(0)).cast("long")


def normalize_resources(specs: DataFrame, cpu: str = "cpu", mem: str = "mem") -> DataFrame:
    """Add ``<cpu>_millis`` and ``<mem>_bytes`` parsed from resource quantities."""
    return specs.withColumns({f"{cpu}_millis": cpu_millicores(F.col(cpu)),
                              f"{mem}_bytes": memory_bytes(F.col(mem))})


def two_hop_phases(df: DataFrame) -> DataFrame:
    """Split a producer/consumer record into its time phases; a missing stamp gives null.

    Input: ``t0 t1 t1p t2 t3 t3_api t_found t4`` (epoch seconds).
    """
    seen = F.coalesce("t3", "t3_api")
    hold = F.col("t2") - F.col("t1")
    return df.withColumns({
        "e2e": F.col("t4") - F.col("t0"),
        "compute": F.col("t1") - F.col("t0"),
        "upload": F.col("t1p") - F.col("t1"),
        "hold": F.when(hold.isNotNull(), F.greatest(hold, F.lit(0.0))),
        "wait": seen - F.col("t2"),
        "poll": F.col("t_found") - seen,
        "download": F.col("t4") - F.col("t_found"),
        "visible": F.col("t4") - seen,
    })


def map_values(df: DataFrame, col: str, fn: Callable[[Column], Column],
               round_to: int | None = None) -> DataFrame:
    """Apply ``fn`` to a value column or to every element of an array column."""
    def one(value: Column) -> Column:
        mapped = fn(value)
        return mapped if round_to is None else F.round(mapped, round_to)

    if df.schema[col].dataType.typeName() == "array":
        return df.withColumn(col, F.transform(col, one))
    return df.withColumn(col, one(F.col(col)))


def parse_names(df: DataFrame, col: str, swap: tuple[str, str] = ("infer-", "capture-")) -> DataFrame:
    """Split ``stage-part-3`` style names: trailing index, camera label, partner name."""
    tail = F.substring_index(F.col(col), "-", -1)
    index = F.when(tail.rlike(r"^\d+$"), tail.try_cast("int"))
    partner = F.when(F.col(col).startswith(swap[0]),
                     F.concat(F.lit(swap[1]), F.substr(F.col(col), F.lit(len(swap[0]) + 1)))
                     ).otherwise(F.col(col))
    return df.withColumns({
        "name_index": index,
        "camera": F.when(index.isNotNull(), F.concat(F.lit("cam-"), index.cast("string"))),
        "partner": partner,
    })


def runs_of(df: DataFrame, template: str, name: str = "run_name") -> DataFrame:
    """Runs whose name starts with the template's prefix (literal, no wildcards)."""
    return df.where(F.col(name).startswith(template + "-"))


def backfill_start(df: DataFrame, start: str = "start_time", completion: str = "completion_time",
                   makespan: str = "makespan_s", created: str = "created_at") -> DataFrame:
    """Missing start: completion minus a positive makespan, else the creation time."""
    micros = F.unix_micros(F.col(completion)) - (F.col(makespan) * 1_000_000).cast("long")
    derived = F.when(F.col(makespan) > 0, F.timestamp_micros(micros))
    return df.withColumn(start, F.coalesce(start, derived, created))


def pct(num: Column, den: Column) -> Column:
    """Percentage, 0 when the denominator is 0."""
    return F.when(den > 0, num / den * 100).otherwise(F.lit(0.0))


def run_diff(left: DataFrame, right: DataFrame, key: str, value: str = "makespan_s") -> DataFrame:
    """Difference and percent change of ``value`` for rows present on both sides."""
    l = left.select(key, F.col(value).alias("left_value"))
    r = right.select(key, F.col(value).alias("right_value"))
    return l.join(r, key).withColumns({
        "diff": F.col("right_value") - F.col("left_value"),
        "diff_pct": pct(F.col("right_value") - F.col("left_value"), F.col("left_value")),
    })
