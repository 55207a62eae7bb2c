"""Encounter variables and outcomes of a procedure cohort (CL-01..27).

Each function takes the cohort and returns a lazy ``[encounter_id, ...]`` DataFrame.
Per-encounter logic is one grouped aggregate (partial aggregation on the map side), not a
loop or a window over a whole encounter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions import codesets as CS
from wardlens.functions.scalar import DAY_S, first_token, safe_div
from wardlens.operators.timeseries import peak_rows
from wardlens.operators.tidy import enc_variable, tidy_flow, tidy_labs


def _any(cond) -> F.Column:
    return F.coalesce(F.bool_or(cond), F.lit(False))


# --- CL-01..04 -------------------------------------------------------------------------------
def age(co) -> DataFrame:
    return enc_variable(co.encounter_info, "age")


def mortality(co) -> DataFrame:
    return enc_variable(co.encounter_info, "death_during_encounter", "death")


def gender(co) -> DataFrame:
    g = F.when(F.col("gender") == 1, "Male").when(F.col("gender") == 2, "Female").otherwise(F.col("gender").cast("string"))
    return co.encounter_info.select("encounter_id", g.alias("gender")).distinct()


def male_gender(co) -> DataFrame:
    g = F.when(F.col("gender") == 1, "Male").when(F.col("gender") == 2, F.lit(None)).otherwise(F.col("gender").cast("string"))
    return co.encounter_info.select("encounter_id", g.alias("male_gender")).distinct()


# --- CL-05/06 kidney injury ------------------------------------------------------------------
def aki_stage(aligned: DataFrame, value: str = "value", t: str = "time_s") -> DataFrame:
    """Kidney-injury stage per encounter from creatinine aligned on the procedure day.

    -3 no value at or before day 0; -1 none from day 1; else baseline = mean at or before
    day 0 and 3 / 2 / 1 / 0 by the 7-day and 2-day post-operative maxima.
    """
    x, v = F.col(t), F.col(value)
    g = aligned.groupBy("encounter_id").agg(
        _any(x <= 0).alias("_pre"), _any(x >= DAY_S).alias("_post"),
        F.avg(F.when(x <= 0, v)).alias("_b"),
        F.max(F.when((x > 0) & (x <= 7 * DAY_S), v)).alias("_c7"),
        F.max(F.when((x > 0) & (x <= 2 * DAY_S), v)).alias("_c2"))
    b, c7, c2 = F.col("_b"), F.col("_c7"), F.col("_c2")
    code = (F.when(~F.col("_pre"), -3).when(~F.col("_post"), -1)
             .when((c7 >= 3 * b) | (c7 > 4), 3).when(c7 >= 2 * b, 2)
             .when((c7 >= 1.5 * b) | (c2 > b + 0.3), 1).otherwise(0))
    label = reduce(lambda acc, kv: acc.when(F.col("value") == kv[0], kv[1]),
                   CS.AKI_LABELS.items(), F.when(F.lit(False), F.lit(None).cast("string")))
    return g.select("encounter_id", code.alias("value")).withColumn("desc", label)


def postop_aki(co, method: str = "mpog") -> DataFrame:
    if method != "mpog":
        raise ValueError("only the 'mpog' rule is defined")
    scr = co.labs(["CREATININE SERUM"]).where(F.col("value").between(0.2, 25))  # FIL-06
    return aki_stage(co.align_metric(scr))


# --- CL-07 / CL-08 / CL-10 -----------------------------------------------------------------------
def postop_troponin(co, max_days: int = 3) -> DataFrame:
    """Peak troponin within (0, max_days) after each procedure day, ties kept; every offset kept."""
    trp = co.align_metric(co.labs(["TROPONIN I"]))
    trp = trp.where((F.col("time_s") > 0) & (F.col("time_s") < max_days * DAY_S))
    hi = peak_rows(trp, "value", ("encounter_id", "offset")).select(
        "encounter_id", "offset", (F.col("time_s") / float(DAY_S)).alias("day"), "value")
    return co.offset.join(hi, ["encounter_id", "offset"], "left")


def _room_rows(co, codes) -> DataFrame:
    return co.db.procedures.sel(order_name=codes, encounter_id=co.eid)


def room_changes(co) -> DataFrame:
    """CL-11: room charges per encounter-day, one count column per room code (AGG-05)."""
    return (_room_rows(co, CS.ROOM_CODES).groupBy("encounter_id", "days_from_dob_procstart")
            .pivot("order_name", CS.ROOM_CODES).agg(F.count("person_id")))


def postop_los(co) -> DataFrame:
    last = _room_rows(co, CS.ROOM_CODES).groupBy("encounter_id").agg(
        F.max("days_from_dob_procstart").alias("last_day"))
    c = co.offset.join(last, "encounter_id", "left")
    return c.select("encounter_id", (F.col("last_day") - F.col("offset")).alias("postop_los")).distinct()


def delirium(co) -> DataFrame:
    return co.flowsheet(["CAM ICU"], to_numeric=False)


# Delirium assessment texts.
DELIRIOUS = "Delirious- CAM+"
NOT_ASSESSED = ["Unable to assess", ""]


def post_op_delirium(co, detail: str = "full", clean: bool = True) -> DataFrame:
    c = co.align_metric(delirium(co)).withColumn("days", F.col("time_s") / float(DAY_S))
    c = c.where(F.col("time_s") >= 0)
    if clean:
        c = c.where(~F.col("value").isin(NOT_ASSESSED))
    if detail == "encounter":
        return c.groupBy("encounter_id").agg(_any(F.col("value") == DELIRIOUS).alias("post_op_delirium"))
    if detail == "72hr":
        return c.groupBy("encounter_id").agg(
            _any((F.col("value") == DELIRIOUS) & (F.col("time_s") <= 3 * DAY_S)).alias("post_op_delirium"))
    if detail == "full":
        return c.withColumn("value", first_token("value", "-"))
    raise ValueError(f"unknown detail {detail!r}: encounter, 72hr and full exist")


# --- CL-12..20 -------------------------------------------------------------------------------------
def or_days(co) -> DataFrame:
    return _room_rows(co, CS.OR_ROOM_CODES).select(
        "encounter_id", F.col("days_from_dob_procstart").alias("or_day"), "order_name").orderBy("encounter_id", "or_day", "order_name")


def reexploration_for_bleed(co) -> DataFrame:
    """CL-14: more than one operating-room charge and a bleeding re-operation."""
    rooms = _room_rows(co, CS.ROOM_CODES).groupBy("encounter_id").agg(
        F.count(F.when(F.col("order_name").contains("OPERATING ROOM"), F.col("person_id"))).alias("_n_or"))
    re = (co.db.procedures.sel(order_name=CS.REEXPLORATION_PROCEDURES)
          .select("encounter_id").distinct().withColumn("_re", F.lit(True)))
    flag = (F.col("_n_or") > 1) & F.col("_re").isNotNull()
    return rooms.join(re, "encounter_id", "left").select("encounter_id", flag.alias("reexploration_for_bleed"))


def bmi(co, height_unit: str | None = None) -> DataFrame:
    """CL-13: mean weight over mean height of distinct daily means (not squared unless a
    height unit, ``'cm'`` or ``'m'``, is given)."""
    day = co.db.flowsheet.sel(display_name=["HEIGHT", "WEIGHT"], encounter_id=co.eid, pivot=True)
    m = (day.select("encounter_id", "HEIGHT", "WEIGHT").distinct()
         .groupBy("encounter_id").agg(F.avg("HEIGHT").alias("_h"), F.avg("WEIGHT").alias("_w")))
    h = F.col("_h")
    if height_unit == "cm":
        h = (h / 100.0) * (h / 100.0)
    elif height_unit == "m":
        h = h * h
    m = m.select("encounter_id", safe_div(F.col("_w"), h).alias("bmi"))
    return co.eid.join(m, "encounter_id", "left").select("encounter_id", "bmi").distinct()


def post_op_icu_days(co, all_columns: bool = False) -> DataFrame:
    """CL-15: intensive-care charges per encounter-day; ``all_columns`` counts the known values of every other column instead."""
    rows = _room_rows(co, CS.ICU_CODES)
    keys = ["encounter_id", "days_from_dob_procstart"]
    counts = [F.count(c).alias(c) for c in rows.columns if c not in keys] if all_columns else [F.count("person_id").alias("icu_rows")]
    return rows.groupBy(*keys).agg(*counts)


def ckd(co) -> DataFrame:
    """CL-16: any GFR below 60 between 3 days before and 1 day after the procedure day."""
    l = tidy_labs(co.db.labs.sel(contains="GFR", encounter_id=co.eid))
    l = co.align_metric(l).where((F.col("time_s") > -3 * DAY_S) & (F.col("time_s") < DAY_S))
    return l.groupBy("encounter_id").agg(_any(F.col("value") < 60).alias("ckd"))


def _icu_aligned(co) -> DataFrame:
    icu = _room_rows(co, CS.ICU_CODES).select("encounter_id", "days_from_dob_procstart")
    return icu.join(co.offset, "encounter_id", "left").withColumn(
        "day", F.col("days_from_dob_procstart") - F.col("offset"))


def icu_start(co) -> DataFrame:
    """CL-17: the smallest procedure offset among ICU charges on or after it (kept as is)."""
    c = _icu_aligned(co).where(F.col("day") >= 0)  # the charges are the cohort's already
    return c.groupBy("encounter_id").agg(F.min("offset").alias("offset"),
                                         F.min("days_from_dob_procstart").alias("first_icu_day"))


def icu_los(co) -> DataFrame:
    c = _icu_aligned(co).groupBy("encounter_id").agg(F.max("day").alias("icu_los"))
    return co.eid.join(c, "encounter_id", "left")


def blood_products(co, kind: str = "RBC", total: bool = False) -> DataFrame:
    """CL-19: units of one product kind per encounter (distinct values, or their sum)."""
    bp = co.db.transfusion.sel(contains=f"TRANSFUSE {kind}:", encounter_id=co.eid)
    col = f"units_{kind.lower()}"
    units = first_token("number_of_units", " ").try_cast("int")
    if total:
        return bp.groupBy("encounter_id").agg(F.sum(units).alias(col))
    return bp.select("encounter_id", units.alias(col)).distinct()


def vent_duration(co) -> DataFrame:
    """CL-20: last aligned day with a ventilator-mode row."""
    c = co.db.flowsheet.sel(display_name=CS.VENT_MODE_NAMES, encounter_id=co.eid).withColumn(
        "display_name", F.lit("VENT MODE"))
    c = co.align_metric(tidy_flow(c, False))
    return c.groupBy("encounter_id").agg(F.max(F.col("time_s") / float(DAY_S)).alias("vent_days"))


# --- CL-21..26 diagnosis flags -------------------------------------------------------------------------
def _dx_flag(co, cond, name: str, code_type: str | None = None, as_int: bool = False) -> DataFrame:
    dx = co.db.diagnosis.sel(person_id=co.pid, CodeType=[code_type] if code_type else None)
    per = dx.groupBy("person_id").agg(F.bool_or(cond).alias(name))
    c = co.encounter_info.select("encounter_id", "person_id").join(per, "person_id", "left")
    v = F.coalesce(F.col(name), F.lit(False)).cast("int") if as_int else F.col(name)
    return c.select("encounter_id", v.alias(name)).distinct()


def osa(co, code_type: str = "ICD-10") -> DataFrame:
    return _dx_flag(co, F.col("CodeDescription").isin(CS.OSA_DESCRIPTIONS), "osa", code_type + "-CM")


def chf(co, code_type: str = "ICD-10") -> DataFrame:
    return _dx_flag(co, F.col("CodeDescription").contains("HEART FAILURE"), "chf", code_type + "-CM")


def dm(co, code_type: str = "ICD-10") -> DataFrame:
    return _dx_flag(co, F.col("CodeDescription").contains("DIABETES"), "dm", code_type + "-CM")


def cad(co) -> DataFrame:
    return _dx_flag(co, F.col("Code").isin(CS.CAD_ICD10), "cad", as_int=True)


def stroke(co) -> DataFrame:
    return _dx_flag(co, F.col("Code").isin(CS.STROKE_ICD10), "stroke", as_int=True)


def comorbidity(co, set_name: str = "liver_disease") -> DataFrame:
    """CL-26: any ICD-10 code starting with one of the set's prefixes, as 0/1."""
    _, _, prefixes = CS.CODE_SETS[set_name]
    cond = reduce(lambda a, b: a | b, [F.col("Code").startswith(p) for p in prefixes])
    return _dx_flag(co, cond, set_name, as_int=True)
