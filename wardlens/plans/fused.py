"""Encounter variables declared as (table, names, expression, aggregate) and computed in one pass over each table.

Every variable of a table becomes one conditional aggregate of the same grouped scan. Tables are not joined with the
cohort first: raw rows never move, only their partial aggregates do, and other encounters go at the join with the cohort. The
cohort itself comes from the pass over the procedures, so that each source table is read once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions import codesets as CS
from wardlens.functions.scalar import DAY_S, hms_to_seconds, safe_div, to_numeric

#: Aggregates that give the same result when partial results are aggregated again.
REPEATABLE = (F.max, F.min, F.bool_or)


@dataclass(frozen=True)
class Variable:
    """``fn`` over ``expr`` of the rows of ``table`` whose search column is one of ``names`` (None: all rows)."""

    name: str
    table: str
    names: tuple[str, ...] | None
    expr: Callable[[], Column]
    fn: Callable[[Column], Column] = F.max


@dataclass(frozen=True)
class DailyMean:
    """Mean over distinct days of the numeric mean of ``names`` on a day; days that agree in all daily means count once."""

    name: str
    table: str
    names: tuple[str, ...]
    expr: Callable[[], Column]
    day: str


def _where(v: Variable | DailyMean, search_col: str) -> Column:
    return v.expr() if v.names is None else F.when(F.col(search_col).isin(list(v.names)), v.expr())


def fuse(table, key: str, variables: list, **filters) -> DataFrame:
    """(key, one column per variable): all variables of one table in one scan.

    Only rows of names that some variable reads are kept, unless one reads all. Keys whose rows meet no variable's
    condition have nulls; null keys are left out. Rows of a key are reduced in the map tasks, so a key with very
    many rows is as many partial rows as there are tasks (or days, for daily means).
    """
    plain = [v for v in variables if isinstance(v, Variable)]
    daily = [v for v in variables if isinstance(v, DailyMean)]
    names = None if any(v.names is None for v in variables) else sorted({n for v in variables for n in v.names})
    rows = table.sel(names, **filters).where(F.col(key).isNotNull())
    own = [v.fn(_where(v, table.search_col)).alias(v.name) for v in plain]
    if not daily:
        return rows.groupBy(key).agg(*own)
    days = {v.day for v in daily}
    if len(days) > 1 or any(v.fn not in REPEATABLE for v in plain):
        raise ValueError("daily means need one day column, and beside them only max, min and bool_or")
    again = [v.fn(v.name).alias(v.name) for v in plain]
    per_day = rows.groupBy(key, *days).agg(*[F.avg(_where(v, table.search_col)).alias(v.name) for v in daily], *own)
    distinct = per_day.groupBy(key, *[v.name for v in daily]).agg(F.lit(1).alias("_day"), *again).drop("_day")
    return distinct.groupBy(key).agg(*[F.avg(v.name).alias(v.name) for v in daily], *again)


def _flow_time() -> Column:
    return F.when(F.col("flowsheet_value").isNotNull(), F.col("flowsheet_days_since_birth").cast("bigint") * DAY_S + hms_to_seconds("flowsheet_time"))


def _proc_day() -> Column:
    return F.col("days_from_dob_procstart")


def _dx(cond: Callable[[], Column], code_type: str = "ICD-10-CM") -> Callable[[], Column]:
    return lambda: F.when(F.col("CodeType") == code_type, cond())


# Delirium assessment texts.
DELIRIOUS, NOT_ASSESSED = "Delirious- CAM+", ["Unable to assess", ""]

_FLOW_DAY = "flowsheet_days_since_birth"
_number = lambda: to_numeric("flowsheet_value")
PARTS = {v.name: v for v in (
    Variable("_icu_last", "procedures", tuple(CS.ICU_CODES), _proc_day),
    DailyMean("_height", "flowsheet", ("HEIGHT",), _number, _FLOW_DAY),
    DailyMean("_weight", "flowsheet", ("WEIGHT",), _number, _FLOW_DAY),
    Variable("_vent_last", "flowsheet", tuple(CS.VENT_MODE_NAMES), _flow_time),
    Variable("_assessed_last", "flowsheet", ("CAM ICU",), lambda: F.when(~F.col("flowsheet_value").isin(NOT_ASSESSED), _flow_time())),
    Variable("_delirious_last", "flowsheet", ("CAM ICU",), lambda: F.when(F.col("flowsheet_value") == DELIRIOUS, _flow_time())),
    Variable("dm", "diagnosis", None, _dx(lambda: F.col("CodeDescription").contains("DIABETES")), F.bool_or),
    Variable("chf", "diagnosis", None, _dx(lambda: F.col("CodeDescription").contains("HEART FAILURE")), F.bool_or),
    Variable("osa", "diagnosis", None, _dx(lambda: F.col("CodeDescription").isin(CS.OSA_DESCRIPTIONS)), F.bool_or),
)}


def _gender() -> Column:
    return F.when(F.col("gender") == 1, "Male").when(F.col("gender") == 2, "Female").otherwise(F.col("gender").cast("string"))


def _delirium() -> Column:
    after = lambda c: F.col(c) >= F.col("_day0")
    return F.when(after("_delirious_last"), "Delirium").when(after("_assessed_last"), "No Delirium")


#: Output variable -> (parts it needs, expression over them, the encounter's columns and ``_offset``/``_day0``).
OUTPUTS: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "age": ((), lambda: F.col("age")), "gender": ((), _gender), "death": ((), lambda: F.col("death_during_encounter")),
    "bmi": (("_height", "_weight"), lambda: safe_div("_weight", "_height")),
    "icu_los": (("_icu_last",), lambda: F.col("_icu_last") - F.col("_offset")),
    "vent_days": (("_vent_last",), lambda: (F.col("_vent_last") - F.col("_day0")) / float(DAY_S)),
    "post_op_delirium": (("_assessed_last", "_delirious_last"), _delirium),
    "dm": (("dm",), lambda: F.col("dm")), "chf": (("chf",), lambda: F.col("chf")), "osa": (("osa",), lambda: F.col("osa")),
}


def encounter_variables(co, wanted: list[str]) -> DataFrame:
    """(encounter_id, surgeries, the wanted variables): distinct rows, one for each row of the cohort's encounters.

    Days count from the first procedure day (or event of ``set_offset``) of an encounter: the last row on or after some event is
    on or after the first, and the longest distance to an event is that to the first. ``surgeries`` are the distinct cohort procedures.
    """
    unknown = [w for w in wanted if w not in OUTPUTS]
    if unknown:
        raise ValueError(f"unknown variables {unknown}: there are {sorted(OUTPUTS)}")
    need = [PARTS[p] for p in dict.fromkeys(p for w in wanted for p in OUTPUTS[w][0])]
    of = {t: [v for v in need if v.table == t] for t in ("procedures", "flowsheet", "diagnosis")}
    ops = (Variable("_offset", "procedures", tuple(co.procedures), _proc_day, F.min),
           Variable("surgeries", "procedures", tuple(co.procedures), lambda: F.col("order_name"), F.collect_set))
    base = fuse(co.db.procedures, "encounter_id", [*ops, *of["procedures"]], encounter_id=co.encounter_filter).where("size(surgeries) > 0")
    enc = co.db.encounters.sel(person_id=co.person_filter).dropna("any").distinct()
    out = base.join(enc, "encounter_id")
    if co.anchored:
        out = out.drop("_offset").join(co.offset.groupBy("encounter_id").agg(F.min("offset").alias("_offset")), "encounter_id", "left")
    if of["flowsheet"]:
        out = out.join(fuse(co.db.flowsheet, "encounter_id", of["flowsheet"]), "encounter_id", "left")
    if of["diagnosis"]:
        out = out.join(fuse(co.db.diagnosis, "person_id", of["diagnosis"]), "person_id", "left")
    out = out.withColumn("_day0", F.col("_offset").cast("bigint") * DAY_S)
    return out.select("encounter_id", "surgeries", *[OUTPUTS[w][1]().alias(w) for w in wanted])


#: Variables of the analysis table beside the outcome and the surgery label.
ANALYSIS = ["age", "gender", "bmi", "dm", "chf", "osa", "death", "vent_days", "icu_los"]


def analysis_table(co) -> DataFrame:
    """CL-27: delirium outcome, surgery label and nine variables per assessed encounter, distinct rows."""
    t = encounter_variables(co, ["post_op_delirium", *ANALYSIS]).where(F.col("post_op_delirium").isNotNull())
    label = lambda s: F.when(s.isin(CS.CABG_NAMES), "CABG").otherwise(s)
    return t.select("encounter_id", "post_op_delirium", F.explode(F.array_distinct(F.transform("surgeries", label))).alias("surgery"), *ANALYSIS).distinct()
