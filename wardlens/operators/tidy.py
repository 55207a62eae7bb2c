"""Tidy long form ``[encounter_id, time_s, name, value]`` and its reshapes (PRJ-04..15, AGG-03..06, WIN-05..08)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions.scalar import DAY_S, HOUR_S, hms_to_seconds, to_numeric
from wardlens.session import materialize

TIDY_COLS = ["encounter_id", "time_s", "name", "value"]


def whole_rows(df: DataFrame) -> DataFrame:
    """Rows without a null, told on columns that are computed once.

    A plain ``dropna`` would be moved below the projections and into the joins under them, with the expression of every
    column copied into it; it does not move past a column that depends on the task.
    """
    return df.withColumn("_part", F.spark_partition_id()).dropna("any").drop("_part")


def _tidy(df: DataFrame, name: str, value, day_col: str, time_col: str | None) -> DataFrame:
    t = F.col(day_col).cast("bigint") * DAY_S
    if time_col is not None:
        t = t + hms_to_seconds(time_col)
    cols = [F.col(c) for c in df.columns if c not in (name, day_col, time_col)]
    out = df.select(*cols, F.col(name).alias("name"), value.alias("value"), t.alias("time_s"))
    # a null anywhere drops the row, before the projection to four columns
    return whole_rows(out).select(*TIDY_COLS)


def tidy_labs(df: DataFrame) -> DataFrame:
    """PRJ-04: labs to tidy form, numeric values, time = day * 86400 + time of day."""
    return _tidy(df.withColumn("lab_result_value", to_numeric("lab_result_value")), "lab_component_name",
                 F.col("lab_result_value"), "lab_collection_days_since_birth", "lab_collection_time")


def tidy_flow(df: DataFrame, to_numeric_values: bool = True) -> DataFrame:
    """PRJ-05: flowsheet to tidy form; ``value`` double, or text when ``to_numeric_values`` is False."""
    v = to_numeric("flowsheet_value") if to_numeric_values else F.col("flowsheet_value")
    return _tidy(df.withColumn("flowsheet_value", v), "display_name", F.col("flowsheet_value"),
                 "flowsheet_days_since_birth", "flowsheet_time")


def tidy_meds(df: DataFrame) -> DataFrame:
    """PRJ-06: medications to tidy form; dose is the value."""
    df = df.withColumn("dose", to_numeric("dose")).withColumn(
        "administered_days_since_birth", F.col("administered_days_since_birth").try_cast("bigint"))
    return _tidy(df, "medication_name", F.col("dose"), "administered_days_since_birth", "administered_time")


def tidy_procs(df: DataFrame) -> DataFrame:
    """PRJ-07: procedures to tidy form; value = day number, time = that day."""
    d = F.col("days_from_dob_procstart").try_cast("bigint")
    df = df.withColumn("days_from_dob_procstart", d)
    return _tidy(df.withColumn("_v", d.cast("double")), "order_name", F.col("_v"),
                 "days_from_dob_procstart", None).select(*TIDY_COLS)


def enc_variable(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """PRJ-08: distinct ``(encounter_id, col AS name)``."""
    return df.select("encounter_id", F.col(col).alias(name or col)).distinct()


def recode(col: str, mapping: dict, keep_other: bool = True):
    """PRJ-09/10: map values through a small fixed dictionary."""
    expr = None
    for k, v in mapping.items():
        cond = F.col(col) == F.lit(k)
        val = F.lit(v)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    if keep_other:
        return expr.otherwise(F.col(col).cast("string") if mapping and isinstance(next(iter(mapping.values())), str) else F.col(col))
    return expr


def pivot_tidy(df: DataFrame, names, t: str = "time_s", agg: str = "avg", value: str = "value") -> DataFrame:
    """AGG-03/05/06: wide frame, one column per name, aggregated per ``(encounter_id, t)``.

    Names are explicit, so no extra job collects the distinct names first.
    """
    fn = {"avg": F.avg, "mean": F.avg, "max": F.max, "min": F.min, "count": F.count, "sum": F.sum}[agg]
    return df.groupBy("encounter_id", t).pivot("name", list(names)).agg(fn(value))


def melt_tidy(df: DataFrame, t: str = "hour", id_cols=("encounter_id",), value_cols=None) -> DataFrame:
    """PRJ-15: wide -> long, nulls kept."""
    ids = list(id_cols) + [t]
    value_cols = value_cols or [c for c in df.columns if c not in ids]
    cast = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in value_cols])
    return cast.unpivot(ids, list(value_cols), "name", "value")


# Accepted rebinning widths in hours.
REBIN_HOURS = {"hour": 1, "q4h": 4, "q8h": 8, "q12h": 12, "day": 24}


def rebin_time(df: DataFrame, on: str, time_col: str = "time_s", out: str = "btime") -> DataFrame:
    """WIN-05: floor time to fixed-width bins, labelled by the bin start hour."""
    if on not in REBIN_HOURS:
        raise ValueError(f"binning must be one of {list(REBIN_HOURS)}")
    w = REBIN_HOURS[on]
    return df.withColumn(out, (F.floor(F.col(time_col) / float(HOUR_S * w)) * w).cast("bigint"))


def cut_right_closed(df: DataFrame, col: str, width: float, start: float = -1.0, out: str = "bin") -> DataFrame:
    """WIN-06: right-closed bins ``(start + k*w, start + (k+1)*w]`` labelled by ``(k+1)*w``."""
    x = F.col(col)
    k = F.ceil((x - F.lit(start)) / F.lit(width))
    return df.withColumn(out, F.when(x > F.lit(start), k * F.lit(width)))


def cut_half_days(df: DataFrame, col: str, upper=None, out: str = "bin") -> DataFrame:
    """WIN-07: right-closed half-day bins from -0.5, labelled by index; null above the last edge.

    The last edge is the largest ``-0.5 + 0.5*j`` below ``upper`` (default: the column's
    maximum, a scalar subquery evaluated once, no join, over rows written once for both readers).
    """
    x = F.col(col)
    df = materialize(df) if upper is None else df
    up = df.select(F.max(col)).scalar() if upper is None else F.lit(float(upper))
    last_edge = F.ceil((up + 0.5) / 0.5) * 0.5 - 1.0  # largest -0.5 + 0.5j strictly below up
    idx = F.ceil((x + 0.5) / 0.5) - 1
    return df.withColumn(out, F.when((x > -0.5) & (x <= last_edge), idx.cast("bigint")))


def round_hours(df: DataFrame, time_col: str = "time_s", scale: int = 0, out: str = "hour") -> DataFrame:
    """WIN-08: hours, rounded half to even (to whole or tenth hours)."""
    return df.withColumn(out, F.bround(F.col(time_col) / float(HOUR_S), scale))
