"""Registered queries over the driver's tables, each paired with its DuckDB oracle.

Every query reads whole tables through the adapter views; the cohort is the coronary
bypass procedure group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.functions import codesets as CS
from wardlens.operators import tidy as TD
from wardlens.plans.oracle_sql import _lst, tidy_flow_sql, tidy_labs_sql, tidy_meds_sql, with_ctes
from wardlens.sources.dataset import Dataset, Table

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    """Round floating outputs in both engines (sums differ in the last bits)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def ds(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset.from_driver_tables(spark, sf_dir)


def cohort(spark: SparkSession, sf_dir: str):
    return ds(spark, sf_dir).create_procedure_cohort(CS.CABG_NAMES)


# Signal lists used by the registered queries.
SEL_LABS = ["CREATININE SERUM", "HEMOGLOBIN"]
EXTRACT_LABS = ["CREATININE SERUM", "TROPONIN I"]
EXTRACT_FLOW = ["CCO", "CCI"]

# --- sources, filters, projections -------------------------------------------------------------------

register("sel_isin", with_ctes(f"SELECT * FROM labs_c WHERE lab_component_name IN {_lst(SEL_LABS)}", "labs_c"))(
    lambda spark, sf: ds(spark, sf).labs.sel(SEL_LABS))

register("sel_days_clean", with_ctes("SELECT * FROM proc", "proc"))(
    lambda spark, sf: ds(spark, sf).procedures.sel())

register("search_substring", with_ctes(
    "SELECT DISTINCT upper(lab_component_name) AS lab_component_name FROM labs_v WHERE upper(lab_component_name) LIKE '%O2%'",
    extra={"__views__": ["labs"]}))(lambda spark, sf: ds(spark, sf).labs.search("O2"))

register("value_counts", with_ctes(
    "SELECT upper(order_name) AS order_name, CAST(count(*) AS BIGINT) AS count FROM procedures_v "
    "WHERE order_name IS NOT NULL GROUP BY 1", extra={"__views__": ["procedures"]}))(
    lambda spark, sf: ds(spark, sf).procedures.unique(count=True))

register("distinct_values", with_ctes(
    "SELECT DISTINCT upper(display_name) AS display_name FROM flowsheet_v WHERE display_name IS NOT NULL",
    extra={"__views__": ["flowsheet"]}))(lambda spark, sf: ds(spark, sf).flowsheet.unique(count=False))

register("tidy_labs", with_ctes(tidy_labs_sql("labs_c"), "labs_c"))(
    lambda spark, sf: TD.tidy_labs(ds(spark, sf).labs.sel()))

register("tidy_flow_text", with_ctes(tidy_flow_sql("flow_c", numeric=False), "flow_c"))(
    lambda spark, sf: TD.tidy_flow(ds(spark, sf).flowsheet.sel(), to_numeric_values=False))

register("tidy_meds", with_ctes(tidy_meds_sql("meds_c"), "meds_c"))(
    lambda spark, sf: TD.tidy_meds(ds(spark, sf).medications.sel()))

register("tidy_procs", with_ctes(
    "SELECT encounter_id, CAST(days_from_dob_procstart AS BIGINT) * 86400 AS time_s, order_name AS name, "
    "CAST(days_from_dob_procstart AS DOUBLE) AS value FROM proc WHERE person_id IS NOT NULL AND order_name IS NOT NULL",
    "proc"))(lambda spark, sf: TD.tidy_procs(ds(spark, sf).procedures.sel()))

register("enc_variable", with_ctes("SELECT DISTINCT encounter_id, age FROM einfo", "einfo"))(
    lambda spark, sf: cohort(spark, sf).age)

register("recode_gender", with_ctes(
    "SELECT DISTINCT encounter_id, CASE gender WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE CAST(gender AS VARCHAR) END AS gender FROM einfo",
    "einfo"))(lambda spark, sf: cohort(spark, sf).gender)

register("male_gender", with_ctes(
    "SELECT DISTINCT encounter_id, CASE gender WHEN 1 THEN 'Male' WHEN 2 THEN NULL ELSE CAST(gender AS VARCHAR) END AS male_gender FROM einfo",
    "einfo"))(lambda spark, sf: cohort(spark, sf).male_gender)

register("mortality", with_ctes("SELECT DISTINCT encounter_id, death_during_encounter AS death FROM einfo", "einfo"))(
    lambda spark, sf: cohort(spark, sf).mortality)

# --- cohort -------------------------------------------------------------------------------------------------

register("proc_obs_extract", with_ctes(f"""
SELECT p.person_id, l.encounter_id, p.order_name AS procedure, p.days_from_dob_procstart,
  l.lab_collection_days_since_birth AS days_from_dob, l.lab_collection_days_since_birth - p.days_from_dob_procstart AS day,
  l.lab_collection_time AS time, l.lab_component_name AS name, l.lab_result_value AS value
FROM labs_c l JOIN pinfo p ON l.encounter_id = p.encounter_id WHERE l.lab_component_name IN {_lst(EXTRACT_LABS)}
UNION ALL
SELECT p.person_id, f.encounter_id, p.order_name AS procedure, p.days_from_dob_procstart,
  f.flowsheet_days_since_birth AS days_from_dob, f.flowsheet_days_since_birth - p.days_from_dob_procstart AS day,
  f.flowsheet_time AS time, f.display_name AS name, f.flowsheet_value AS value
FROM flow_c f JOIN pinfo p ON f.encounter_id = p.encounter_id WHERE f.display_name IN {_lst(EXTRACT_FLOW)}""",
    "pinfo", "labs_c", "flow_c"))(
    lambda spark, sf: ds(spark, sf).sel(CS.CABG_NAMES, labs=EXTRACT_LABS, flowsheet=EXTRACT_FLOW))

register("cohort_info", with_ctes("SELECT * FROM einfo", "einfo"))(lambda spark, sf: cohort(spark, sf).encounter_info)

register("cohort_offset", with_ctes("SELECT * FROM offs", "offs"))(lambda spark, sf: cohort(spark, sf).offset)

register("preop_labs", with_ctes("""
SELECT t.encounter_id, t.time_s - CAST(o."offset" AS BIGINT) * 86400 AS time_s, t.name, t.value, o."offset"
FROM tl t JOIN offs o ON t.encounter_id = o.encounter_id
WHERE t.time_s - CAST(o."offset" AS BIGINT) * 86400 <= 0""", "offs", "labs_c",
    extra={"tl": tidy_labs_sql("(SELECT * FROM labs_c WHERE lab_component_name IN ('CREATININE SERUM'))")}))(
    lambda spark, sf: cohort(spark, sf).preop_labs(["CREATININE SERUM"]))

_COHORT_LABS = lambda names: tidy_labs_sql(
    f"(SELECT * FROM labs_c WHERE lab_component_name IN {_lst(names)} AND encounter_id IN (SELECT encounter_id FROM eid))")
_COHORT_FLOW = lambda names, numeric=True: tidy_flow_sql(
    f"(SELECT * FROM flow_c WHERE display_name IN {_lst(names)} AND encounter_id IN (SELECT encounter_id FROM eid))", numeric)

register("align_labs", with_ctes("""
SELECT t.encounter_id, t.time_s - CAST(o."offset" AS BIGINT) * 86400 AS time_s, t.name, t.value, o."offset"
FROM tl t LEFT JOIN offs o ON t.encounter_id = o.encounter_id""", "offs", "eid", "labs_c",
    extra={"tl": _COHORT_LABS(["HEMOGLOBIN"])}))(
    lambda spark, sf: (lambda co: co.align_metric(co.labs(["HEMOGLOBIN"])))(cohort(spark, sf)))

# --- outcomes -------------------------------------------------------------------------------------------------

register("aki", with_ctes("""
SELECT encounter_id, value, CASE value WHEN -3 THEN 'No preoperative creatinine' WHEN -1 THEN 'No postoperative creatinine'
  WHEN 3 THEN 'Stage 3 AKI' WHEN 2 THEN 'Stage 2 AKI' WHEN 1 THEN 'Stage 1 AKI' WHEN 0 THEN 'No AKI' END AS "desc"
FROM (SELECT encounter_id, CASE WHEN NOT pre THEN -3 WHEN NOT post THEN -1
    WHEN c7 >= 3 * b OR c7 > 4 THEN 3 WHEN c7 >= 2 * b THEN 2 WHEN c7 >= 1.5 * b OR c2 > b + 0.3 THEN 1 ELSE 0 END AS value
  FROM (SELECT encounter_id, coalesce(bool_or(t <= 0), false) AS pre, coalesce(bool_or(t >= 86400), false) AS post,
      avg(CASE WHEN t <= 0 THEN value END) AS b, max(CASE WHEN t > 0 AND t <= 7 * 86400 THEN value END) AS c7,
      max(CASE WHEN t > 0 AND t <= 2 * 86400 THEN value END) AS c2
    FROM (SELECT s.encounter_id, s.time_s - CAST(o."offset" AS BIGINT) * 86400 AS t, s.value
      FROM scr s LEFT JOIN offs o ON s.encounter_id = o.encounter_id) a GROUP BY encounter_id) g) z""",
    "offs", "eid", "labs_c",
    extra={"scr": f"SELECT * FROM ({_COHORT_LABS(['CREATININE SERUM'])}) WHERE value BETWEEN 0.2 AND 25"}))(
    lambda spark, sf: cohort(spark, sf).postop_aki())

# --- encounter variables (CL-07..27) ---------------------------------------------------------------------------

_ALIGNED = lambda src: (
    f'SELECT s.*, s.time_s - CAST(o."offset" AS BIGINT) * 86400 AS t, o."offset" FROM ({src}) s '
    f'LEFT JOIN offs o ON s.encounter_id = o.encounter_id')
_ROOMS = lambda codes: f"SELECT * FROM proc WHERE order_name IN {_lst(codes)} AND encounter_id IN (SELECT encounter_id FROM eid)"

_DEL = f"""SELECT encounter_id, t AS time_s, name, value, "offset", t / 86400.0 AS days
FROM ({_ALIGNED(_COHORT_FLOW(['CAM ICU'], False))}) a WHERE t >= 0 AND value NOT IN ('Unable to assess', '')"""

_VAR_SQL = {
    "v_age": "SELECT DISTINCT encounter_id, age FROM einfo",
    "v_gender": "SELECT DISTINCT encounter_id, CASE gender WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE CAST(gender AS VARCHAR) END AS gender FROM einfo",
    "v_death": "SELECT DISTINCT encounter_id, death_during_encounter AS death FROM einfo",
    "v_bmi": """SELECT DISTINCT e.encounter_id, m.bmi FROM eid e LEFT JOIN (
  SELECT encounter_id, CASE WHEN avg(h) = 0 THEN NULL ELSE avg(w) / avg(h) END AS bmi FROM (
    SELECT DISTINCT encounter_id, h, w FROM (
      SELECT encounter_id, flowsheet_days_since_birth,
        avg(CASE WHEN display_name = 'HEIGHT' THEN TRY_CAST(flowsheet_value AS DOUBLE) END) AS h,
        avg(CASE WHEN display_name = 'WEIGHT' THEN TRY_CAST(flowsheet_value AS DOUBLE) END) AS w
      FROM flow_c WHERE display_name IN ('HEIGHT', 'WEIGHT') AND encounter_id IN (SELECT encounter_id FROM eid)
      GROUP BY 1, 2) d) x GROUP BY 1) m ON e.encounter_id = m.encounter_id""",
    "v_vent": f"""SELECT encounter_id, max(t / 86400.0) AS vent_days FROM ({_ALIGNED(tidy_flow_sql(
        "(SELECT encounter_id, flowsheet_days_since_birth, flowsheet_time, 'VENT MODE' AS display_name, flowsheet_value FROM flow_c "
        f"WHERE display_name IN {_lst(CS.VENT_MODE_NAMES)} AND encounter_id IN (SELECT encounter_id FROM eid))", False))}) a GROUP BY 1""",
    "v_icu": f"""SELECT e.encounter_id, m.icu_los FROM eid e LEFT JOIN (
  SELECT i.encounter_id, max(i.days_from_dob_procstart - o."offset") AS icu_los
  FROM ({_ROOMS(CS.ICU_CODES)}) i LEFT JOIN offs o ON i.encounter_id = o.encounter_id GROUP BY 1) m ON e.encounter_id = m.encounter_id""",
}


def _dx_sql(name: str, cond: str, code_type: str | None = None, as_int: bool = False) -> str:
    ct = f" AND CodeType = '{code_type}'" if code_type else ""
    v = f"CAST(coalesce(p.{name}, false) AS INT)" if as_int else f"p.{name}"
    return (f"SELECT DISTINCT e.encounter_id, {v} AS {name} FROM einfo e LEFT JOIN ("
            f"SELECT person_id, bool_or({cond}) AS {name} FROM dx_c WHERE person_id IN (SELECT person_id FROM pid){ct} "
            f"GROUP BY 1) p ON e.person_id = p.person_id")


_VAR_SQL["v_osa"] = _dx_sql("osa", f"CodeDescription IN {_lst(CS.OSA_DESCRIPTIONS)}", "ICD-10-CM")
_VAR_SQL["v_chf"] = _dx_sql("chf", "CodeDescription LIKE '%HEART FAILURE%'", "ICD-10-CM")
_VAR_SQL["v_dm"] = _dx_sql("dm", "CodeDescription LIKE '%DIABETES%'", "ICD-10-CM")
_VAR_ALL = ("einfo", "eid", "pid", "offs", "flow_c", "proc", "dx_c")


def _var(name: str) -> str:
    return with_ctes(f"SELECT * FROM {name}", *_VAR_ALL, extra=_VAR_SQL)


register("bmi", _var("v_bmi"))(lambda spark, sf: cohort(spark, sf).bmi)
register("vent_days", _var("v_vent"))(lambda spark, sf: cohort(spark, sf).mechanical_ventilation_duration)
register("icu_los", _var("v_icu"))(lambda spark, sf: cohort(spark, sf).icu_los)
register("dx_osa", _var("v_osa"))(lambda spark, sf: cohort(spark, sf).osa)
register("dx_chf", _var("v_chf"))(lambda spark, sf: cohort(spark, sf).chf)
register("dx_dm", _var("v_dm"))(lambda spark, sf: cohort(spark, sf).dm)

register("dx_cad", with_ctes(_dx_sql("cad", f"Code IN {_lst(CS.CAD_ICD10)}", as_int=True), "einfo", "pid", "dx_c"))(
    lambda spark, sf: cohort(spark, sf).cad)
register("dx_stroke", with_ctes(_dx_sql("stroke", f"Code IN {_lst(CS.STROKE_ICD10)}", as_int=True), "einfo", "pid", "dx_c"))(
    lambda spark, sf: cohort(spark, sf).stroke)
register("dx_prefix", with_ctes(_dx_sql(
    "liver_disease", " OR ".join(f"Code LIKE '{p}%'" for p in CS.LIVER_DISEASE_PREFIXES), as_int=True),
    "einfo", "pid", "dx_c"))(lambda spark, sf: cohort(spark, sf).comorbidity("liver_disease"))

register("delirium_encounter", with_ctes(
    f"SELECT encounter_id, coalesce(bool_or(value = 'Delirious- CAM+'), false) AS post_op_delirium FROM ({_DEL}) d GROUP BY 1",
    "offs", "eid", "flow_c"))(lambda spark, sf: cohort(spark, sf).get_post_op_delirium("encounter"))

register("delirium_72hr", with_ctes(
    "SELECT encounter_id, coalesce(bool_or(value = 'Delirious- CAM+' AND time_s <= 3 * 86400), false) AS post_op_delirium "
    f"FROM ({_DEL}) d GROUP BY 1", "offs", "eid", "flow_c"))(
    lambda spark, sf: cohort(spark, sf).get_post_op_delirium("72hr"))

register("delirium_full", with_ctes(
    f"""SELECT encounter_id, time_s, name, split_part(value, '-', 1) AS value, "offset", days FROM ({_DEL}) d""",
    "offs", "eid", "flow_c"))(lambda spark, sf: cohort(spark, sf).get_post_op_delirium("full"))

register("los", with_ctes(f"""
SELECT DISTINCT o.encounter_id, l.last_day - o."offset" AS postop_los FROM offs o LEFT JOIN (
  SELECT encounter_id, max(days_from_dob_procstart) AS last_day FROM ({_ROOMS(CS.ROOM_CODES)}) r GROUP BY 1) l
ON o.encounter_id = l.encounter_id""", "offs", "eid", "proc"))(lambda spark, sf: cohort(spark, sf).postop_los())

register("icu_start", with_ctes(f"""
SELECT i.encounter_id, min(o."offset") AS "offset", min(i.days_from_dob_procstart) AS first_icu_day
FROM ({_ROOMS(CS.ICU_CODES)}) i LEFT JOIN offs o ON i.encounter_id = o.encounter_id
WHERE i.days_from_dob_procstart - o."offset" >= 0 GROUP BY 1""", "offs", "eid", "proc"))(
    lambda spark, sf: cohort(spark, sf).icu_start)

register("icu_days", with_ctes(f"""
SELECT encounter_id, days_from_dob_procstart, CAST(count(person_id) AS BIGINT) AS icu_rows
FROM ({_ROOMS(CS.ICU_CODES)}) i GROUP BY 1, 2""", "eid", "proc"))(lambda spark, sf: cohort(spark, sf).post_op_icu_days())

register("icu_days_columns", with_ctes(f"""
SELECT encounter_id, days_from_dob_procstart, CAST(count(person_id) AS BIGINT) AS person_id, CAST(count(order_name) AS BIGINT) AS order_name
FROM ({_ROOMS(CS.ICU_CODES)}) i GROUP BY 1, 2""", "eid", "proc"))(lambda spark, sf: cohort(spark, sf).post_op_icu_days(all_columns=True))

register("or_days", with_ctes(
    f"SELECT encounter_id, days_from_dob_procstart AS or_day, order_name FROM ({_ROOMS(CS.OR_ROOM_CODES)}) r",
    "eid", "proc"))(lambda spark, sf: cohort(spark, sf).or_days())


def _pivot_count_sql(codes) -> str:
    cols = []
    for c in codes:
        q = c.replace("'", "''")
        cols.append(f"CASE WHEN count(CASE WHEN order_name = '{q}' THEN 1 END) > 0 "
                    f"THEN count(CASE WHEN order_name = '{q}' THEN person_id END) END AS \"{c}\"")
    return ("SELECT encounter_id, days_from_dob_procstart, " + ", ".join(cols)
            + f" FROM ({_ROOMS(codes)}) r GROUP BY 1, 2")


register("pivot_count_rooms", with_ctes(_pivot_count_sql(CS.ROOM_CODES), "eid", "proc"))(
    lambda spark, sf: cohort(spark, sf).room_changes)

register("reexplore", with_ctes(f"""
SELECT DISTINCT r.encounter_id, coalesce(x.flag, false) AS reexploration_for_bleed
FROM ({_ROOMS(CS.ROOM_CODES)}) r LEFT JOIN (
  SELECT DISTINCT encounter_id, true AS flag FROM proc WHERE order_name IN {_lst(CS.REEXPLORATION_PROCEDURES)}
    AND encounter_id IN (SELECT encounter_id FROM ({_ROOMS(CS.ROOM_CODES)}) q GROUP BY 1
      HAVING count(CASE WHEN order_name LIKE '%OPERATING ROOM%' THEN person_id END) > 1)) x
ON r.encounter_id = x.encounter_id""", "eid", "proc"))(lambda spark, sf: cohort(spark, sf).reexploration_for_bleed)

register("ckd", with_ctes(f"""
SELECT encounter_id, coalesce(bool_or(value < 60), false) AS ckd FROM ({_ALIGNED(tidy_labs_sql(
    "(SELECT * FROM labs_c WHERE lab_component_name IN (SELECT DISTINCT upper(lab_component_name) FROM labs_v "
    "WHERE upper(lab_component_name) LIKE '%GFR%') AND encounter_id IN (SELECT encounter_id FROM eid))"))}) a
WHERE t > -3 * 86400 AND t < 86400 GROUP BY 1""", "offs", "eid", "labs_c"))(lambda spark, sf: cohort(spark, sf).ckd)

register("troponin_peak", with_ctes("""
SELECT o.encounter_id, o."offset", p.day, p.value FROM offs o LEFT JOIN (
  SELECT a.encounter_id, a."offset", a.t / 86400.0 AS day, a.value FROM trp a JOIN (
    SELECT encounter_id, "offset", max(value) AS mx FROM trp GROUP BY 1, 2) m
  ON a.encounter_id = m.encounter_id AND a."offset" = m."offset" AND a.value = m.mx) p
ON o.encounter_id = p.encounter_id AND o."offset" = p."offset\"""", "offs", "eid", "labs_c",
    extra={"trp": f"SELECT * FROM ({_ALIGNED(_COHORT_LABS(['TROPONIN I']))}) a WHERE t > 0 AND t < 3 * 86400"}))(
    lambda spark, sf: cohort(spark, sf).postop_troponin())

register("blood_products", with_ctes("""
SELECT DISTINCT encounter_id, TRY_CAST(split_part(number_of_units, ' ', 1) AS INT) AS units_rbc FROM tr_c
WHERE transfusion_name IN (SELECT DISTINCT upper(transfusion_name) FROM transfusion_v WHERE upper(transfusion_name) LIKE '%TRANSFUSE RBC:%')
  AND encounter_id IN (SELECT encounter_id FROM eid)""", "eid", "tr_c"))(lambda spark, sf: cohort(spark, sf).blood_products("RBC"))

register("blood_products_total", with_ctes("""
SELECT encounter_id, sum(TRY_CAST(split_part(number_of_units, ' ', 1) AS INT)) AS units_plasma FROM tr_c
WHERE transfusion_name IN (SELECT DISTINCT upper(transfusion_name) FROM transfusion_v WHERE upper(transfusion_name) LIKE '%TRANSFUSE PLASMA:%')
  AND encounter_id IN (SELECT encounter_id FROM eid) GROUP BY 1""", "eid", "tr_c"))(
    lambda spark, sf: cohort(spark, sf).blood_products("PLASMA", total=True))

_AT_EXTRA = dict(_VAR_SQL)
_AT_EXTRA["root"] = f"""SELECT encounter_id, CASE WHEN coalesce(bool_or(value = 'Delirious- CAM+'), false) THEN 'Delirium'
  ELSE 'No Delirium' END AS post_op_delirium FROM ({_DEL}) d GROUP BY 1"""
register("analysis_table", with_ctes(f"""
SELECT DISTINCT r.encounter_id, r.post_op_delirium, p.surgery, a.age, g.gender, b.bmi, d.dm, c.chf, s.osa, m.death, v.vent_days, i.icu_los
FROM root r JOIN (SELECT encounter_id, CASE WHEN order_name IN {_lst(CS.CABG_NAMES)} THEN 'CABG' ELSE order_name END AS surgery FROM pinfo) p
  ON r.encounter_id = p.encounter_id
LEFT JOIN v_age a ON r.encounter_id = a.encounter_id LEFT JOIN v_gender g ON r.encounter_id = g.encounter_id
LEFT JOIN v_bmi b ON r.encounter_id = b.encounter_id LEFT JOIN v_dm d ON r.encounter_id = d.encounter_id
LEFT JOIN v_chf c ON r.encounter_id = c.encounter_id LEFT JOIN v_osa s ON r.encounter_id = s.encounter_id
LEFT JOIN v_death m ON r.encounter_id = m.encounter_id LEFT JOIN v_vent v ON r.encounter_id = v.encounter_id
LEFT JOIN v_icu i ON r.encounter_id = i.encounter_id""", *_VAR_ALL, extra=_AT_EXTRA))(
    lambda spark, sf: cohort(spark, sf).table1())

# --- code sets as a table (CL-26, SETD-01..08) ------------------------------------------------------------------

from wardlens.plans import comorbidity as CM  # noqa: E402


def _code_test(kind: str, codes) -> str:
    return " OR ".join(f"starts_with(Code, '{c}')" if kind == "prefix" else f"Code = '{c}'" for c in codes)


_DX_SETS = {n: (m, codes) for n, (k, m, codes) in CS.CODE_SETS.items() if k == "diagnosis"}
register("comorbidity_all", with_ctes(
    "SELECT encounter_id, set_name, max(flag) AS flag FROM (" + " UNION ALL ".join(
        f"SELECT e.encounter_id, '{n}' AS set_name, CASE WHEN e.person_id IN (SELECT person_id FROM dx_c WHERE {_code_test(*v)}) THEN 1 ELSE 0 END AS flag FROM einfo e"
        for n, v in _DX_SETS.items()) + ") f GROUP BY 1, 2", "einfo", "dx_c"))(
    lambda spark, sf: CM.comorbidity_all(cohort(spark, sf)))


def _dictionary_sets(spark, sf):
    """A large user table: every part, by its first type and size, names a code set of the codes' leading parts."""
    db = ds(spark, sf)
    own = db.diagnosis.df.select(F.concat(F.lit("group "), F.left("Code", F.lit(1))).alias("set_name"), F.left("Code", F.lit(3)).alias("code"), F.lit("prefix").alias("match"))
    exact = db.diagnosis.df.select(F.concat(F.lit("code "), "Code").alias("set_name"), F.col("Code").alias("code"), F.lit("exact").alias("match"))
    return CM.match_codes(db.diagnosis.sel(), own.union(exact).distinct())


register("dx_user_sets", with_ctes(
    "SELECT DISTINCT person_id, 'group ' || left(Code, 1) AS set_name FROM dx_c WHERE Code <> '' UNION SELECT DISTINCT person_id, 'code ' || Code FROM dx_c WHERE Code <> ''",
    "dx_c"))(_dictionary_sets)

_MONITOR_SETS = {n: codes for n, (k, _, codes) in CS.CODE_SETS.items() if k == "flowsheet"}
register("monitor_groups", with_ctes(" UNION ALL ".join(
    f"SELECT encounter_id, '{n}' AS set_name, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT display_name) AS BIGINT) AS names "
    f"FROM flow_c WHERE display_name IN {_lst(sorted({c.upper() for c in codes}))} GROUP BY 1" for n, codes in _MONITOR_SETS.items()), "flow_c"))(
    lambda spark, sf: CM.name_group_counts(ds(spark, sf).flowsheet, CS.code_sets(spark, "flowsheet")))

# --- pivots, melts, binning (AGG-03..06, PRJ-15, WIN-04..08) ------------------------------------------------------

from wardlens.operators import summary as SM  # noqa: E402
from wardlens.operators import timeseries as TS  # noqa: E402

PIVOT_NAMES = ["CCO", "CCI", "CVP (MMHG)", "PULSE"]
GAS_LABS = ["O2SAT ARTERIAL MEASURED", "PO2 ARTERIAL", "O2SAT VENOUS MEASURED", "PO2 VENOUS"]


def _pivot_sql(src: str, names, t: str = "time_s", fn: str = "avg", rnd: bool = True) -> str:
    cols = []
    for n in names:
        e = f"{fn}(CASE WHEN name = '{n}' THEN value END)"
        cols.append(f"{'round(' + e + ', 6)' if rnd else e} AS \"{n}\"")
    return f"SELECT encounter_id, {t}, {', '.join(cols)} FROM ({src}) s GROUP BY 1, 2"


def _pivot_mean(spark, sf):
    co = cohort(spark, sf)
    p = TD.pivot_tidy(co.flowsheet(PIVOT_NAMES), PIVOT_NAMES)
    return p.select("encounter_id", "time_s", *[r6(F.col(f"`{n}`")).alias(n) for n in PIVOT_NAMES])


register("pivot_mean", with_ctes(_pivot_sql(_COHORT_FLOW(PIVOT_NAMES), PIVOT_NAMES), "eid", "flow_c"))(_pivot_mean)


def _pivot_max(spark, sf):
    co = cohort(spark, sf)
    a = co.align_metric(co.flowsheet(["CCO", "CCI"])).withColumn("day", F.bround(F.col("time_s") / 86400.0, 0) + 0.0)
    return TD.pivot_tidy(a, ["CCO", "CCI"], t="day", agg="max")


register("pivot_max", with_ctes(_pivot_sql(
    f"SELECT encounter_id, round_even(t / 86400.0, 0) + 0.0 AS day, name, value FROM ({_ALIGNED(_COHORT_FLOW(['CCO', 'CCI']))}) a",
    ["CCO", "CCI"], t="day", fn="max", rnd=False), "offs", "eid", "flow_c"))(_pivot_max)


def _melt(spark, sf):
    return TD.melt_tidy(_pivot_mean(spark, sf), t="time_s")


register("melt_wide", with_ctes(" UNION ALL ".join(
    f"SELECT encounter_id, time_s, '{n}' AS name, CAST(\"{n}\" AS DOUBLE) AS value FROM pm" for n in PIVOT_NAMES),
    "eid", "flow_c", extra={"pm": _pivot_sql(_COHORT_FLOW(PIVOT_NAMES), PIVOT_NAMES)}))(_melt)


def _rebin(spark, sf):
    co = cohort(spark, sf)
    return TD.rebin_time(co.align_metric(co.labs(["HEMOGLOBIN"])), "q8h")


register("rebin_q8h", with_ctes(
    f"""SELECT encounter_id, t AS time_s, name, value, "offset", CAST(floor(t / 28800.0) * 8 AS BIGINT) AS btime
FROM ({_ALIGNED(_COHORT_LABS(['HEMOGLOBIN']))}) a""", "offs", "eid", "labs_c"))(_rebin)


def _rebase(spark, sf):
    co = cohort(spark, sf)
    h = TD.round_hours(co.labs(GAS_LABS), scale=0).withColumn("hour", F.col("hour").cast("bigint"))
    return TS.rebase(h, "hour", out="rhour")


_REBASE_SQL = f"""SELECT g.*, g.hour - m.mh AS rhour FROM (
  SELECT encounter_id, time_s, name, value, CAST(round_even(time_s / 3600.0, 0) AS BIGINT) AS hour FROM ({_COHORT_LABS(GAS_LABS)}) x) g
JOIN (SELECT encounter_id, min(CAST(round_even(time_s / 3600.0, 0) AS BIGINT)) AS mh FROM ({_COHORT_LABS(GAS_LABS)}) y GROUP BY 1) m
ON g.encounter_id = m.encounter_id"""

register("rebase_hours", with_ctes(_REBASE_SQL, "eid", "labs_c"))(_rebase)

register("cut_hours", with_ctes(
    "SELECT *, CASE WHEN rhour > -1 THEN CAST(ceil((rhour + 1) / 8.0) * 8 AS DOUBLE) END AS bin FROM rb",
    "eid", "labs_c", extra={"rb": _REBASE_SQL}))(
    lambda spark, sf: TD.cut_right_closed(_rebase(spark, sf), "rhour", 8.0, -1.0).withColumn("bin", F.col("bin").cast("double")))


def _half_days(spark, sf):
    d = _rebase(spark, sf).withColumn("rday", F.col("rhour") / 24.0)
    return TD.cut_half_days(d, "rday")


register("cut_half_days", with_ctes("""
SELECT rb2.*, CASE WHEN rday > -0.5 AND rday <= ceil((mx + 0.5) / 0.5) * 0.5 - 1.0 THEN CAST(ceil((rday + 0.5) / 0.5) - 1 AS BIGINT) END AS bin
FROM (SELECT *, rhour / 24.0 AS rday FROM rb) rb2, (SELECT max(rhour / 24.0) AS mx FROM rb) m""",
    "eid", "labs_c", extra={"rb": _REBASE_SQL}))(_half_days)

register("round_hours", with_ctes(
    f"SELECT encounter_id, time_s, name, value, round_even(time_s / 3600.0, 1) AS hour FROM ({_COHORT_FLOW(['CCO'])}) f",
    "eid", "flow_c"))(lambda spark, sf: TD.round_hours(cohort(spark, sf).flowsheet(["CCO"]), scale=1))

# --- interpolation and as-of join (WIN-01/02, JOIN-08) ------------------------------------------------------------


def _interp_sql(forward: bool) -> str:
    cols = []
    for c in ("CCO", "CCI"):
        w = "PARTITION BY encounter_id ORDER BY time_s ROWS BETWEEN {} "
        pv = f"last_value({c} IGNORE NULLS) OVER ({w.format('UNBOUNDED PRECEDING AND CURRENT ROW')})"
        pi = f"last_value(CASE WHEN {c} IS NOT NULL THEN idx END IGNORE NULLS) OVER ({w.format('UNBOUNDED PRECEDING AND CURRENT ROW')})"
        nv = f"first_value({c} IGNORE NULLS) OVER ({w.format('CURRENT ROW AND UNBOUNDED FOLLOWING')})"
        ni = f"first_value(CASE WHEN {c} IS NOT NULL THEN idx END IGNORE NULLS) OVER ({w.format('CURRENT ROW AND UNBOUNDED FOLLOWING')})"
        cols.append(f"{pv} AS {c}_pv, {pi} AS {c}_pi, {nv} AS {c}_nv, {ni} AS {c}_ni")
    body = []
    for c in ("CCO", "CCI"):
        e = (f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_pi IS NOT NULL AND {c}_ni IS NOT NULL THEN "
             f"CASE WHEN {c}_ni = {c}_pi THEN {c}_pv ELSE {c}_pv + ({c}_nv - {c}_pv) * (idx - {c}_pi) / ({c}_ni - {c}_pi) END END")
        if forward:
            e = f"coalesce({e}, {c}_pv)"
        body.append(f"round({e}, 6) AS {c}")
    return f"""SELECT encounter_id, time_s, {', '.join(body)} FROM (
  SELECT *, {', '.join(cols)} FROM (
    SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY time_s) - 1 AS idx FROM pv) a) b"""


def _interp(forward: bool):
    def q(spark, sf):
        co = cohort(spark, sf)
        p = TD.pivot_tidy(co.flowsheet(["CCO", "CCI"]), ["CCO", "CCI"])
        out = TS.interpolate(p, ["CCO", "CCI"], forward=forward)
        return out.select("encounter_id", "time_s", r6("CCO").alias("CCO"), r6("CCI").alias("CCI"))
    return q


_PV = _pivot_sql(_COHORT_FLOW(["CCO", "CCI"]), ["CCO", "CCI"], rnd=False)
register("interp_inside", with_ctes(_interp_sql(False), "eid", "flow_c", extra={"pv": _PV}))(_interp(False))
register("interp_forward", with_ctes(_interp_sql(True), "eid", "flow_c", extra={"pv": _PV}))(_interp(True))


def asof_sql(targets: str, reference: str, out: str = "interp", cols: str = "encounter_id, time_s, name, value") -> str:
    """Oracle for JOIN-08 over a union and RANGE frames."""
    return f"""SELECT {cols}, CASE WHEN n IS NULL OR n = 0 THEN NULL WHEN n = 1 OR pt IS NULL THEN lo WHEN nt IS NULL THEN hi
  WHEN nt = pt THEN py ELSE py + (ny - py) * (time_s - pt) / (nt - pt) END AS {out}
FROM (
  SELECT u.*,
    last_value(y IGNORE NULLS) OVER (PARTITION BY u.encounter_id ORDER BY u.time_s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS py,
    last_value(CASE WHEN y IS NOT NULL THEN u.time_s END IGNORE NULLS) OVER (PARTITION BY u.encounter_id ORDER BY u.time_s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
    first_value(y IGNORE NULLS) OVER (PARTITION BY u.encounter_id ORDER BY u.time_s RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ny,
    first_value(CASE WHEN y IS NOT NULL THEN u.time_s END IGNORE NULLS) OVER (PARTITION BY u.encounter_id ORDER BY u.time_s RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt
  FROM (SELECT {cols}, true AS tgt, CAST(NULL AS DOUBLE) AS y FROM ({targets}) t0
        UNION ALL SELECT encounter_id, time_s, {', '.join('NULL' for _ in cols.split(',')[2:])}, false, y FROM (
          SELECT encounter_id, time_s, avg(value) AS y FROM ({reference}) r0 GROUP BY 1, 2) r1) u) w
LEFT JOIN (SELECT encounter_id AS e2, min(y) AS lo, max(y) AS hi, count(y) AS n FROM (
  SELECT encounter_id, time_s, avg(value) AS y FROM ({reference}) r2 GROUP BY 1, 2) r3 GROUP BY 1) s ON w.encounter_id = s.e2
WHERE tgt"""


def _asof(spark, sf):
    co = cohort(spark, sf)
    out = TS.asof_interpolate(co.labs(["O2SAT ARTERIAL MEASURED"]), co.labs(["HEMOGLOBIN"]))
    return out.withColumn("interp", r6("interp"))


register("interp_asof", with_ctes(
    f"SELECT encounter_id, time_s, name, value, round(interp, 6) AS interp FROM ({asof_sql(_COHORT_LABS(['O2SAT ARTERIAL MEASURED']), _COHORT_LABS(['HEMOGLOBIN']))}) z",
    "eid", "labs_c"))(_asof)

# --- dose curves, first values, peaks (AGG-13, AGG-17..19) ---------------------------------------------------------

MEDS = ["PROPOFOL INFUSION", "FENTANYL INJECTION", "MIDAZOLAM INJECTION"]
_COHORT_MEDS = tidy_meds_sql(
    f"(SELECT * FROM meds_c WHERE medication_name IN {_lst(MEDS)} AND encounter_id IN (SELECT encounter_id FROM eid))")


def _aligned_meds(spark, sf):
    co = cohort(spark, sf)
    return co.align_metric(co.meds(MEDS))


def _dose_auc(spark, sf):
    a = _aligned_meds(spark, sf).withColumn("hours", F.col("time_s") / 3600.0).where(F.col("hours").between(12, 36))
    return TS.trapezoid(a, "hours", "value", ("encounter_id", "offset", "name")).withColumn("auc", r6("auc"))


register("dose_auc", with_ctes("""
SELECT encounter_id, "offset", name, round(coalesce(sum((hours - ph) * (value + pv) / 2.0), 0.0), 6) AS auc FROM (
  SELECT *, lag(hours) OVER w AS ph, lag(value) OVER w AS pv FROM (
    SELECT encounter_id, "offset", name, value, t / 3600.0 AS hours FROM am WHERE t / 3600.0 BETWEEN 12 AND 36) x
  WINDOW w AS (PARTITION BY encounter_id, "offset", name ORDER BY hours, value)) y GROUP BY 1, 2, 3""",
    "offs", "eid", "meds_c", extra={"am": _ALIGNED(_COHORT_MEDS)}))(_dose_auc)

register("dose_total", with_ctes(
    "SELECT encounter_id, name, round(sum(value), 6) AS total_dose FROM am WHERE t BETWEEN 0 AND 86400 GROUP BY 1, 2",
    "offs", "eid", "meds_c", extra={"am": _ALIGNED(_COHORT_MEDS)}))(
    lambda spark, sf: _aligned_meds(spark, sf).where(F.col("time_s").between(0, 86400))
    .groupBy("encounter_id", "name").agg(r6(F.sum("value")).alias("total_dose")))

register("first_value", with_ctes("""
SELECT m.encounter_id, m.name, min(m.value) AS first_value FROM cm m JOIN (
  SELECT encounter_id, name, min(time_s) AS mt FROM cm GROUP BY 1, 2) f
ON m.encounter_id = f.encounter_id AND m.name = f.name AND m.time_s = f.mt GROUP BY 1, 2""",
    "eid", "meds_c", extra={"cm": _COHORT_MEDS}))(
    lambda spark, sf: TS.first_value(cohort(spark, sf).meds(MEDS), keys=("encounter_id", "name")))

register("peak_ties", with_ctes("""
SELECT t.* FROM tr t JOIN (SELECT encounter_id, max(value) AS mx FROM tr GROUP BY 1) m
ON t.encounter_id = m.encounter_id AND t.value = m.mx""", "eid", "labs_c", extra={"tr": _COHORT_LABS(["TROPONIN I"])}))(
    lambda spark, sf: TS.peak_rows(cohort(spark, sf).labs(["TROPONIN I"])))

# --- summaries (AGG-11/12/14/16/20, SRT-03, SMP-01) ---------------------------------------------------------------

register("signal_counts", with_ctes(
    f"SELECT encounter_id, name, count(*) AS n FROM ({_COHORT_FLOW(PIVOT_NAMES + ['HEIGHT', 'WEIGHT'])}) f GROUP BY 1, 2",
    "eid", "flow_c"))(lambda spark, sf: SM.value_counts(cohort(spark, sf).flowsheet(PIVOT_NAMES + ["HEIGHT", "WEIGHT"]),
                                                     ["encounter_id", "name"]))


def _bin_nunique(spark, sf):
    return SM.distinct_counts(_rebin_q12(spark, sf), ["btime", "name"], "encounter_id", "n_encounters")


def _rebin_q12(spark, sf):
    co = cohort(spark, sf)
    return TD.rebin_time(co.align_metric(co.labs(GAS_LABS)), "q12h")


register("bin_nunique", with_ctes(
    f"SELECT CAST(floor(t / 43200.0) * 12 AS BIGINT) AS btime, name, count(DISTINCT encounter_id) AS n_encounters "
    f"FROM ({_ALIGNED(_COHORT_LABS(GAS_LABS))}) a GROUP BY 1, 2", "offs", "eid", "labs_c"))(_bin_nunique)

register("histogram", with_ctes(f"""
SELECT CAST(CASE WHEN value < 5 THEN 0 WHEN value >= 15 THEN 11 ELSE floor((value - 5) * 10 / (15 - 5)) + 1 END AS BIGINT) AS bucket,
  count(*) AS n FROM ({_COHORT_LABS(['HEMOGLOBIN'])}) h GROUP BY 1""", "eid", "labs_c"))(
    lambda spark, sf: SM.histogram(cohort(spark, sf).labs(["HEMOGLOBIN"]), "value", 5.0, 15.0, 10))

register("top_counts", with_ctes("""
SELECT lab_component_name, loinc_code, count(*) AS n FROM labs_c GROUP BY 1, 2
ORDER BY n DESC, lab_component_name, loinc_code LIMIT 50""", "labs_c"))(
    lambda spark, sf: SM.top_counts(ds(spark, sf).labs.sel(), ["lab_component_name", "loinc_code"], 50))

_SAMPLE_SQL = _COHORT_LABS(["CREATININE SERUM"])
register("sample_encounters", with_ctes(f"""SELECT * FROM ({_SAMPLE_SQL}) x WHERE encounter_id IN (
  SELECT encounter_id FROM (SELECT DISTINCT encounter_id FROM ({_SAMPLE_SQL}) y) z ORDER BY md5(encounter_id || '|42'), encounter_id LIMIT 20)""", "eid", "labs_c"))(
    lambda spark, sf: SM.sample_ids(cohort(spark, sf).labs(["CREATININE SERUM"]), 20, seed=42))


def _spine(spark, sf):
    co = cohort(spark, sf)
    return SM.spine_join([co.age, co.gender, co.bmi, co.mortality, co.icu_los]).withColumn("bmi", r6("bmi"))


def _table_one(spark, sf, categorical=("gender", "death"), group=None):
    co = cohort(spark, sf)
    t = SM.table_one(co.variables(["age", "gender", "bmi", "death", "icu_los"]), ["age", "bmi", "icu_los"], list(categorical), group=group)
    return t.select("group", "variable", "level", "n", "missing", r6("mean").alias("mean"), r6("sd").alias("sd"),
                    r6("pct").alias("pct"))


_T1_SQL = """SELECT s.encounter_id, a.age, g.gender, b.bmi, d.death, i.icu_los FROM (
  SELECT encounter_id FROM v_age UNION SELECT encounter_id FROM v_gender UNION SELECT encounter_id FROM v_bmi
  UNION SELECT encounter_id FROM v_death UNION SELECT encounter_id FROM v_icu) s
LEFT JOIN v_age a ON s.encounter_id = a.encounter_id LEFT JOIN v_gender g ON s.encounter_id = g.encounter_id
LEFT JOIN v_bmi b ON s.encounter_id = b.encounter_id LEFT JOIN v_death d ON s.encounter_id = d.encounter_id
LEFT JOIN v_icu i ON s.encounter_id = i.encounter_id"""
register("spine_join", with_ctes("SELECT encounter_id, age, gender, round(bmi, 6) AS bmi, death, icu_los FROM t1", *_VAR_ALL, extra={**_VAR_SQL, "t1": _T1_SQL}))(_spine)

register("table_one", with_ctes("""
SELECT 'overall' AS "group", variable, CAST(NULL AS VARCHAR) AS level, count(v) AS n, count(*) - count(v) AS missing,
  round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, CAST(NULL AS DOUBLE) AS pct FROM (
  SELECT 'age' AS variable, CAST(age AS DOUBLE) AS v FROM t1 UNION ALL SELECT 'bmi', bmi FROM t1
  UNION ALL SELECT 'icu_los', CAST(icu_los AS DOUBLE) FROM t1) n GROUP BY 2
UNION ALL
SELECT 'overall', c.variable, c.level, c.n, t.missing, NULL, NULL, round(c.n * 100.0 / t.tot, 6) FROM (
  SELECT variable, level, count(*) AS n FROM cat WHERE level IS NOT NULL GROUP BY 1, 2) c
JOIN (SELECT variable, count(level) AS tot, count(*) - count(level) AS missing FROM cat GROUP BY 1) t ON c.variable = t.variable""",
    *_VAR_ALL, extra={**_VAR_SQL, "t1": _T1_SQL,
    "cat": "SELECT 'gender' AS variable, gender AS level FROM t1 UNION ALL SELECT 'death', CAST(death AS VARCHAR) FROM t1"}))(
    _table_one)

register("table_one_by_death", with_ctes("""
SELECT "group", variable, CAST(NULL AS VARCHAR) AS level, count(v) AS n, count(*) - count(v) AS missing,
  round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, CAST(NULL AS DOUBLE) AS pct FROM (
  SELECT CAST(death AS VARCHAR) AS "group", 'age' AS variable, CAST(age AS DOUBLE) AS v FROM t1
  UNION ALL SELECT CAST(death AS VARCHAR), 'bmi', bmi FROM t1
  UNION ALL SELECT CAST(death AS VARCHAR), 'icu_los', CAST(icu_los AS DOUBLE) FROM t1) n GROUP BY 1, 2
UNION ALL
SELECT g, 'gender', gender, count(*), any_value(missing), NULL, NULL, round(count(*) * 100.0 / any_value(tot), 6) FROM (
  SELECT CAST(death AS VARCHAR) AS g, gender, count(gender) OVER (PARTITION BY death) AS tot,
    count(*) OVER (PARTITION BY death) - count(gender) OVER (PARTITION BY death) AS missing FROM t1) c
WHERE gender IS NOT NULL GROUP BY 1, 3""", *_VAR_ALL, extra={**_VAR_SQL, "t1": _T1_SQL}))(
    lambda spark, sf: _table_one(spark, sf, ["gender"], "death"))

# --- continuous metrics (MET-01..11) -----------------------------------------------------------------------------

from wardlens.plans import metrics as MT  # noqa: E402


def interp_sql(src: str, cols, t: str, forward=(), keep=()) -> str:
    """Positional per-encounter fill of ``cols`` (interior; ``forward`` ones also carry the tail)."""
    win = []
    for i, c in enumerate(cols):
        q = f'"{c}"'
        w = "PARTITION BY encounter_id ORDER BY {t} ROWS BETWEEN {f}"
        pre = w.format(t=t, f="UNBOUNDED PRECEDING AND CURRENT ROW")
        fol = w.format(t=t, f="CURRENT ROW AND UNBOUNDED FOLLOWING")
        win.append(f"last_value({q} IGNORE NULLS) OVER ({pre}) AS pv{i}, "
                   f"last_value(CASE WHEN {q} IS NOT NULL THEN idx END IGNORE NULLS) OVER ({pre}) AS pi{i}, "
                   f"first_value({q} IGNORE NULLS) OVER ({fol}) AS nv{i}, "
                   f"first_value(CASE WHEN {q} IS NOT NULL THEN idx END IGNORE NULLS) OVER ({fol}) AS ni{i}")
    sel = []
    for i, c in enumerate(cols):
        q = f'"{c}"'
        e = (f"CASE WHEN {q} IS NOT NULL THEN {q} WHEN pi{i} IS NOT NULL AND ni{i} IS NOT NULL THEN "
             f"CASE WHEN ni{i} = pi{i} THEN pv{i} ELSE pv{i} + (nv{i} - pv{i}) * (idx - pi{i}) / (ni{i} - pi{i}) END END")
        if c in forward:
            e = f"coalesce({e}, pv{i})"
        sel.append(f"{e} AS {q}")
    other = ", ".join(f'"{k}"' for k in keep)
    return f"""SELECT encounter_id, {t}{', ' + other if other else ''}, {', '.join(sel)} FROM (
  SELECT *, {', '.join(win)} FROM (
    SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY {t}) - 1 AS idx FROM ({src}) s0) s1) s2"""


def o2_sql(targets: str, hgb: str, po2: str, label: str) -> str:
    t0 = f"SELECT encounter_id, time_s, value AS sat FROM ({targets}) x"
    h = asof_sql(t0, hgb, "h", "encounter_id, time_s, sat")
    p = asof_sql(h, po2, "p", "encounter_id, time_s, sat, h")
    return (f"SELECT encounter_id, time_s, '{label}' AS name, 1.34 * sat / 100.0 * h + 0.003 * coalesce(p, 0.0) AS value "
            f"FROM ({p}) y")


def _metric_comp_sql(labs=None, flow=None, rename=None) -> str:
    parts = []
    if labs:
        parts.append(_COHORT_LABS(labs))
    if flow:
        parts.append(_COHORT_FLOW(flow))
    u = " UNION ALL ".join(f"SELECT * FROM ({p}) p{i}" for i, p in enumerate(parts))
    if len(parts) > 1:
        ids = " INTERSECT ".join(f"SELECT encounter_id FROM ({p}) q{i}" for i, p in enumerate(parts))
        u = f"SELECT * FROM ({u}) u WHERE encounter_id IN ({ids})"
    if rename:
        case = "CASE " + " ".join(f"WHEN name = '{k}' THEN '{v}'" for k, v in rename.items()) + " ELSE name END"
        u = f"SELECT encounter_id, time_s, {case} AS name, value FROM ({u}) r"
    return u


def _met(metric_cls, spark, sf):
    co = cohort(spark, sf)
    return MT.add_continuous_metric(co, metric_cls)


def _o2content(spark, sf):
    g = _met(MT.OxygenContent, spark, sf).compute()
    return g.select("encounter_id", "hour", r6("CaO2").alias("CaO2"), r6("CvO2").alias("CvO2"))


_OC = MT.OxygenContent
_OC_COMP = _metric_comp_sql(labs=_OC.REQUIRES["labs"])
_HGB = f"SELECT * FROM comp WHERE name IN {_lst(MT.HGB_NAMES)}"
register("o2_content", with_ctes("""
SELECT encounter_id, hour, round(avg(CASE WHEN name = 'CaO2' THEN value END), 6) AS "CaO2",
  round(avg(CASE WHEN name = 'CvO2' THEN value END), 6) AS "CvO2" FROM (
  SELECT r.encounter_id, r.name, r.value, r.hour - m.mh AS hour FROM hr r JOIN (SELECT encounter_id, min(hour) AS mh FROM hr GROUP BY 1) m
  ON r.encounter_id = m.encounter_id) z GROUP BY 1, 2""", "eid", "labs_c", extra={
    "comp": _OC_COMP,
    "o2": o2_sql("SELECT * FROM comp WHERE name LIKE '%O2SAT ARTERIAL%'", _HGB, "SELECT * FROM comp WHERE name LIKE '%PO2 ARTERIAL%'", "CaO2")
    + " UNION ALL " + o2_sql("SELECT * FROM comp WHERE name LIKE '%O2SAT VENOUS%'", _HGB, "SELECT * FROM comp WHERE name LIKE '%PO2 VENOUS%'", "CvO2"),
    "hr": "SELECT encounter_id, name, value, CAST(round_even((time_s / 86400.0) * 24.0, 0) AS BIGINT) AS hour FROM o2 WHERE value IS NOT NULL"}))(
    _o2content)


def _long_sql(src: str, cols, t: str = "hour", extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT encounter_id, {t}, '{c}' AS name, round(CAST(\"{c}\" AS DOUBLE), 6) AS value{extra} FROM ({src}) l{i}"
                              for i, c in enumerate(cols))


def _do2(spark, sf):
    return _met(MT.OxygenDelivery, spark, sf).compute().withColumn("value", r6("value"))


_DO = MT.OxygenDelivery
_DO_CTES = {
    "comp": _metric_comp_sql(_DO.REQUIRES["labs"], _DO.REQUIRES["flowsheet"], _DO.RENAME),
    "ca": o2_sql("SELECT * FROM comp WHERE name LIKE '%O2SAT ARTERIAL%'", _HGB, "SELECT * FROM comp WHERE name LIKE '%PO2 ARTERIAL%'", "CaO2"),
    "rw": "SELECT encounter_id, time_s, name, value FROM ca UNION ALL SELECT encounter_id, time_s, name, value FROM comp WHERE name IN ('CCO', 'CCI')",
    "kp": "SELECT encounter_id FROM rw GROUP BY 1 HAVING bool_or(name LIKE '%CC%') AND bool_or(name = 'CaO2')",
    "grid": _pivot_sql("SELECT encounter_id, round_even((time_s / 86400.0) * 24.0, 1) AS hour, name, value FROM rw "
                       "WHERE value IS NOT NULL AND encounter_id IN (SELECT encounter_id FROM kp)", ["CCO", "CCI", "CaO2"], t="hour", rnd=False),
    "f1": interp_sql("SELECT * FROM grid", ["CCO", "CCI", "CaO2"], "hour", forward=("CaO2",)),
    "f2": 'SELECT encounter_id, hour, 10 * "CCO" * "CaO2" AS "DO2", 10 * "CCI" * "CaO2" AS "DO2_I" FROM f1',
    "f3": interp_sql("SELECT * FROM f2", ["DO2", "DO2_I"], "hour", forward=("DO2", "DO2_I")),
}
register("do2", with_ctes(
    _long_sql("SELECT * FROM f3", ["DO2", "DO2_I"], extra=", CAST(round(hour * 3600) AS BIGINT) AS time_s"),
    "eid", "labs_c", "flow_c", extra=_DO_CTES))(_do2)


def _vo2(spark, sf):
    return _met(MT.OxygenConsumption, spark, sf).compute().withColumn("value", r6("value"))


_VO = MT.OxygenConsumption
_VO_CTES = {
    "comp": _metric_comp_sql(_VO.REQUIRES["labs"], _VO.REQUIRES["flowsheet"], _VO.RENAME),
    "ca": o2_sql("SELECT * FROM comp WHERE name LIKE '%O2SAT ARTERIAL%'", _HGB, "SELECT * FROM comp WHERE name LIKE '%PO2 ARTERIAL%'", "CaO2"),
    "cv": o2_sql("SELECT * FROM comp WHERE name IN ('O2SAT VENOUS MEASURED', 'SVO2 (%)')", _HGB, "SELECT * FROM comp WHERE name LIKE '%PO2 VENOUS%'", "CvO2"),
    "rw": "SELECT encounter_id, time_s, name, value FROM ca UNION ALL SELECT encounter_id, time_s, name, value FROM cv "
          "UNION ALL SELECT encounter_id, time_s, name, value FROM comp WHERE name IN ('CCO', 'CCI')",
    "kp": "SELECT encounter_id FROM rw GROUP BY 1 HAVING bool_or(name LIKE '%CC%') AND bool_or(name = 'CaO2') AND bool_or(name = 'CvO2')",
    "grid": _pivot_sql("SELECT encounter_id, CAST(round_even((time_s / 86400.0) * 24.0, 0) AS BIGINT) AS hour, name, value FROM rw "
                       "WHERE value IS NOT NULL AND encounter_id IN (SELECT encounter_id FROM kp)", ["CCO", "CCI", "CaO2", "CvO2"], t="hour", rnd=False),
    "f1": interp_sql("SELECT * FROM grid", ["CCO", "CCI", "CaO2", "CvO2"], "hour"),
    "f2": 'SELECT encounter_id, hour, 10 * "CCO" * ("CaO2" - "CvO2") AS "VO2", 10 * "CCI" * ("CaO2" - "CvO2") AS "VO2_I" FROM f1',
    "f3": interp_sql("SELECT * FROM f2", ["VO2", "VO2_I"], "hour", forward=("VO2", "VO2_I")),
}
register("vo2", with_ctes(
    _long_sql("SELECT * FROM f3", ["VO2", "VO2_I"], extra=", CAST(hour * 3600 AS BIGINT) AS time_s"),
    "eid", "labs_c", "flow_c", extra=_VO_CTES))(_vo2)

_CP = MT.CardiacPower
_CP_CTES = {
    "cpc": _metric_comp_sql(flow=_CP.REQUIRES["flowsheet"], rename=_CP.RENAME),
    "cpg": _pivot_sql("SELECT * FROM cpc WHERE name <> 'CVP' OR value <= 27.12", _CP.GRID, rnd=False),
    "cp1": interp_sql("SELECT * FROM cpg", ["A-LINE MAP", "CVP"], "time_s", keep=("CCO",)),
    "cp2": 'SELECT encounter_id, time_s, ("A-LINE MAP" - "CVP") * "CCO" / 451.0 AS "Cardiac Power" FROM cp1',
    "cp3": interp_sql("SELECT * FROM cp2", ["Cardiac Power"], "time_s"),
    "cpo": "SELECT encounter_id, time_s, round(\"Cardiac Power\", 6) AS value, 'Cardiac Power' AS name FROM cp3",
}
_RV = MT.VentricularStrokeWorkIndex
_RV_CTES = {
    "rvc": _metric_comp_sql(flow=_RV.REQUIRES["flowsheet"], rename=_RV.RENAME),
    "rvg": _pivot_sql("SELECT * FROM rvc WHERE name <> 'CVP' OR value <= 27.12", _RV.GRID, rnd=False),
    "rv1": interp_sql("SELECT * FROM rvg", ["CCI", "PULSE", "PAP (MEAN)"], "time_s", keep=("CVP",)),
    "rv2": 'SELECT encounter_id, time_s, ("PAP (MEAN)" - "CVP") * (CASE WHEN "PULSE" = 0 THEN NULL ELSE "CCI" / "PULSE" END) AS "RVSWI" FROM rv1',
    "rv3": interp_sql("SELECT * FROM rv2", ["RVSWI"], "time_s"),
    "rvo": "SELECT encounter_id, time_s, round(\"RVSWI\", 6) AS value, 'RVSWI' AS name FROM rv3",
}


def _cp(spark, sf):
    return _met(MT.CardiacPower, spark, sf).compute().withColumn("value", r6("value"))


def _rv(spark, sf):
    return _met(MT.VentricularStrokeWorkIndex, spark, sf).compute().withColumn("value", r6("value"))


register("cardiac_power", with_ctes("SELECT * FROM cpo", "eid", "flow_c", extra=_CP_CTES))(_cp)
register("rvswi", with_ctes("SELECT * FROM rvo", "eid", "flow_c", extra=_RV_CTES))(_rv)


def _pulsatility(spark, sf):
    return _met(MT.Pulsatility, spark, sf).compute()


register("pulsatility", with_ctes("""
SELECT encounter_id, time_s, avg(CASE WHEN name = 'SBP' THEN value END) - avg(CASE WHEN name = 'DBP' THEN value END) AS value
FROM bp GROUP BY 1, 2""", "eid", "flow_c", extra={"bp": tidy_flow_sql(
    "(SELECT encounter_id, flowsheet_days_since_birth, flowsheet_time, 'SBP' AS display_name, split_part(flowsheet_value, '/', 1) AS flowsheet_value "
    "FROM flow_c WHERE display_name = 'BP' AND flowsheet_value LIKE '%/%' AND encounter_id IN (SELECT encounter_id FROM eid) "
    "UNION ALL SELECT encounter_id, flowsheet_days_since_birth, flowsheet_time, 'DBP', split_part(flowsheet_value, '/', 2) "
    "FROM flow_c WHERE display_name = 'BP' AND flowsheet_value LIKE '%/%' AND encounter_id IN (SELECT encounter_id FROM eid))")}))(
    _pulsatility)


def _blood_gas(spark, sf):
    g = MT.blood_gas_bins(cohort(spark, sf))
    return g.select("encounter_id", "rhour_b", *[r6(F.col(f"`{n}`")).alias(n) for n in MT.BLOOD_GAS_LABS])


register("blood_gas_bins", with_ctes(_pivot_sql(
    "SELECT encounter_id, CAST(ceil((rhour + 1) / 8.0) * 8 AS BIGINT) AS rhour_b, name, value FROM rb",
    MT.BLOOD_GAS_LABS, t="rhour_b"), "eid", "labs_c", extra={"rb": _REBASE_SQL}))(_blood_gas)


def _report(spark, sf, lo=None, hi=None):
    co = cohort(spark, sf)
    for m in (MT.CardiacPower, MT.VentricularStrokeWorkIndex):
        MT.add_continuous_metric(co, m)
    return MT.metric_report(co, MT.compute_metrics(co).values(), lo=lo, hi=hi).withColumn("value", r6("value"))


_REPORT_SQL = """
SELECT m.death, a.encounter_id, a.btime, a.name, round(avg(a.value), 6) AS value FROM (
  SELECT s.encounter_id, s.name, s.value, CAST(floor((s.time_s - CAST(o."offset" AS BIGINT) * 86400) / 43200.0) * 12 AS BIGINT) AS btime,
    s.time_s - CAST(o."offset" AS BIGINT) * 86400 AS t
  FROM (SELECT encounter_id, time_s, name, value FROM cp3x UNION ALL SELECT encounter_id, time_s, name, value FROM rv3x) s
  LEFT JOIN offs o ON s.encounter_id = o.encounter_id) a
LEFT JOIN (SELECT DISTINCT encounter_id, death_during_encounter AS death FROM einfo) m ON a.encounter_id = m.encounter_id
WHERE a.value IS NOT NULL AND a.t IS NOT NULL
GROUP BY 1, 2, 3, 4"""
_REPORT_CTES = {**_CP_CTES, **_RV_CTES,
    "cp3x": "SELECT encounter_id, time_s, 'Cardiac Power' AS name, \"Cardiac Power\" AS value FROM cp3",
    "rv3x": "SELECT encounter_id, time_s, 'RVSWI' AS name, \"RVSWI\" AS value FROM rv3"}
register("metric_report", with_ctes(_REPORT_SQL, "eid", "einfo", "offs", "flow_c", extra=_REPORT_CTES))(_report)
register("metric_report_range", with_ctes(_REPORT_SQL + " HAVING a.btime BETWEEN -1 AND 200", "eid", "einfo", "offs", "flow_c", extra=_REPORT_CTES))(
    lambda spark, sf: _report(spark, sf, -1, 200))



def _report_all(spark, sf):
    """Mean per half-day bin of oxygen consumption and delivery, cardiac power, stroke work and base excess."""
    co = cohort(spark, sf)
    for m in (MT.OxygenConsumption, MT.OxygenDelivery, MT.CardiacPower, MT.VentricularStrokeWorkIndex, MT.BaseExcess):
        MT.add_continuous_metric(co, m)
    return MT.metric_report(co, MT.compute_metrics(co).values()).withColumn("value", r6("value"))


def _nested(body: str, ctes: dict) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in ctes.items()) + " " + body


def _series_sql(cols, time_s: str) -> str:
    return " UNION ALL ".join(f"SELECT encounter_id, {time_s} AS time_s, '{c}' AS name, \"{c}\" AS value FROM f3" for c in cols)


_ALL_SERIES = {**_REPORT_CTES,
    "dox": _nested(_series_sql(["DO2", "DO2_I"], "CAST(round(hour * 3600) AS BIGINT)"), _DO_CTES),
    "vox": _nested(_series_sql(["VO2", "VO2_I"], "CAST(hour * 3600 AS BIGINT)"), _VO_CTES),
    "bex": _COHORT_LABS(["BASE EXCESS VENOUS"])}
register("metric_report_all", with_ctes(
    _REPORT_SQL.replace("FROM rv3x)", "FROM rv3x UNION ALL " + " UNION ALL ".join(
        f"SELECT encounter_id, time_s, name, value FROM {t}" for t in ("dox", "vox", "bex")) + ")"),
    "eid", "einfo", "offs", "flow_c", "labs_c", extra=_ALL_SERIES))(_report_all)

# --- metrics with their measured components, all metrics at once, samples, limits (MET-02, MET-05..07, MET-12) --------


def _long_components(metric_cls, spark, sf):
    return _met(metric_cls, spark, sf).compute(with_components=True).withColumn("value", r6("value"))


def _components_sql(raw, filled, time_s: str) -> str:
    cols = ", ".join([f'g."{c}"' for c in raw] + [f'f3."{c}"' for c in filled])
    src = f"SELECT g.encounter_id, g.hour, {cols} FROM grid g JOIN f3 ON g.encounter_id = f3.encounter_id AND g.hour = f3.hour"
    return _long_sql(src, [*raw, *filled], extra=f", {time_s} AS time_s")


register("do2_components", with_ctes(_components_sql(
    ["CCO", "CCI", "CaO2"], ["DO2", "DO2_I"], "CAST(round(hour * 3600) AS BIGINT)"), "eid", "labs_c", "flow_c", extra=_DO_CTES))(
    lambda spark, sf: _long_components(MT.OxygenDelivery, spark, sf))
register("vo2_components", with_ctes(_components_sql(
    ["CCO", "CCI", "CaO2", "CvO2"], ["VO2", "VO2_I"], "CAST(hour * 3600 AS BIGINT)"), "eid", "labs_c", "flow_c", extra=_VO_CTES))(
    lambda spark, sf: _long_components(MT.OxygenConsumption, spark, sf))


def _cp_components(spark, sf):
    g = _met(MT.CardiacPower, spark, sf).compute(with_components=True)
    return g.select("encounter_id", "time_s", *[r6(F.col(f"`{c}`")).alias(c) for c in (*MT.CardiacPower.GRID, "Cardiac Power")])


register("cpo_components", with_ctes("""
SELECT g.encounter_id, g.time_s, round(g."A-LINE MAP", 6) AS "A-LINE MAP", round(g."CVP", 6) AS "CVP", round(g."CCO", 6) AS "CCO",
  round(c."Cardiac Power", 6) AS "Cardiac Power" FROM cpg g JOIN cp3 c ON g.encounter_id = c.encounter_id AND g.time_s = c.time_s""",
    "eid", "flow_c", extra=_CP_CTES))(_cp_components)


def _metric_set(spark, sf):
    co = cohort(spark, sf)
    for m in (MT.CardiacPower, MT.VentricularStrokeWorkIndex):
        co.add_continuous_metric(m)
    a, b = MT.compute_metrics(co).values()
    return a.unionByName(b).withColumn("value", r6("value"))


register("metric_set", with_ctes("SELECT * FROM cpo UNION ALL SELECT * FROM rvo", "eid", "flow_c",
                                 extra={**_CP_CTES, **_RV_CTES}))(_metric_set)

register("metric_sample", with_ctes("""SELECT * FROM comp WHERE encounter_id IN (
  SELECT encounter_id FROM (SELECT DISTINCT encounter_id FROM comp) z ORDER BY md5(encounter_id || '|42'), encounter_id LIMIT 20)""",
    "eid", "labs_c", extra={"comp": _OC_COMP}))(lambda spark, sf: _met(MT.OxygenContent, spark, sf).db_sample(20))
register("sample_one_encounter", with_ctes("""SELECT * FROM comp WHERE encounter_id = (
  SELECT encounter_id FROM (SELECT DISTINCT encounter_id FROM comp) z ORDER BY md5(encounter_id || '|42'), encounter_id LIMIT 1)""",
    "eid", "labs_c", extra={"comp": _OC_COMP}))(lambda spark, sf: _met(MT.OxygenContent, spark, sf).db_sample(1))

register("flag_out_of_range", with_ctes(
    f"SELECT *, (name = 'CCI' AND value NOT BETWEEN 0 AND 20) AS out_of_range FROM ({_COHORT_FLOW(['CCI', 'CCO'])}) f", "eid", "flow_c"))(
    lambda spark, sf: _met(MT.OxygenDelivery, spark, sf).flag_out_of_range(cohort(spark, sf).flowsheet(["CCI", "CCO"])))

# --- other anchors and cohorts (CO-03, CO-04, JOIN-03), totals on rows (WIN-03), fill by time (WIN-01) -----------------

_FIRST_PROC = "SELECT encounter_id, min(days_from_dob_procstart) AS ev FROM proc WHERE encounter_id IN (SELECT encounter_id FROM eid) GROUP BY 1"


def _set_offset(spark, sf):
    co = cohort(spark, sf)
    first = co.db.procedures.sel(encounter_id=co.eid).groupBy("encounter_id").agg(F.min("days_from_dob_procstart").alias("offset"))
    co = co.set_offset(first)
    return co.align_metric(co.labs(["HEMOGLOBIN"]))


register("set_offset", with_ctes(f"""
SELECT t.encounter_id, t.time_s - CAST(o.ev AS BIGINT) * 86400 AS time_s, t.name, t.value, o.ev AS "offset"
FROM ({_COHORT_LABS(['HEMOGLOBIN'])}) t LEFT JOIN ({_FIRST_PROC}) o ON t.encounter_id = o.encounter_id""", "eid", "labs_c", "proc"))(_set_offset)


def _anchored(anchor):
    def query(spark, sf):
        co = cohort(spark, sf)
        return co.align_metric(co.labs(["HEMOGLOBIN"]), anchor=anchor)
    return query


for _anchor, _fn in (("first", "min"), ("last", "max")):
    register(f"align_{_anchor}", with_ctes(f"""
SELECT t.encounter_id, t.time_s - CAST(o.ev AS BIGINT) * 86400 AS time_s, t.name, t.value, o.ev AS "offset"
FROM ({_COHORT_LABS(['HEMOGLOBIN'])}) t LEFT JOIN (SELECT encounter_id, {_fn}("offset") AS ev FROM offs GROUP BY 1) o
ON t.encounter_id = o.encounter_id""", "eid", "labs_c", "offs"))(_anchored(_anchor))


def _encounter_cohort(spark, sf):
    from wardlens.plans.cohort import EncounterCohort
    db = ds(spark, sf)
    ids = db.procedures.sel(order_name=CS.CABG_NAMES).select("encounter_id")
    return EncounterCohort(db, ids).labs(["HEMOGLOBIN"])


register("encounter_cohort", with_ctes(tidy_labs_sql(
    "(SELECT * FROM labs_c WHERE lab_component_name = 'HEMOGLOBIN' AND encounter_id IN (SELECT encounter_id FROM enc))"), "enc", "labs_c"))(
    _encounter_cohort)

register("group_total", with_ctes(
    f"SELECT m.*, t.total FROM cm m JOIN (SELECT encounter_id, round(sum(value), 6) AS total FROM cm GROUP BY 1) t ON m.encounter_id = t.encounter_id",
    "eid", "meds_c", extra={"cm": _COHORT_MEDS}))(
    lambda spark, sf: TS.group_total(cohort(spark, sf).meds(MEDS), "value").withColumn("total", r6("total")))


def _interp_time(spark, sf):
    g = TD.pivot_tidy(cohort(spark, sf).flowsheet(["CCI", "CCO"]), ["CCI", "CCO"])
    g = TS.interpolate(g, ["CCI", "CCO"], by="time")
    return g.select("encounter_id", "time_s", r6("CCI").alias("CCI"), r6("CCO").alias("CCO"))


def _interp_time_sql(cols) -> str:
    """Linear in time between the neighbouring values, found by a join on the next and the previous time."""
    out, joins = [], []
    for i, c in enumerate(cols):
        out.append(f"round(coalesce(g.\"{c}\", p{i}.v + (n{i}.v - p{i}.v) * (g.time_s - p{i}.time_s) / (n{i}.time_s - p{i}.time_s)), 6) AS \"{c}\"")
        known = f'(SELECT encounter_id, time_s, "{c}" AS v FROM g WHERE "{c}" IS NOT NULL)'
        joins.append(f"ASOF LEFT JOIN {known} p{i} ON g.encounter_id = p{i}.encounter_id AND g.time_s > p{i}.time_s")
        joins.append(f"ASOF LEFT JOIN {known} n{i} ON g.encounter_id = n{i}.encounter_id AND g.time_s < n{i}.time_s")
    return f"SELECT g.encounter_id, g.time_s, {', '.join(out)} FROM g {' '.join(joins)}"


register("interp_time", with_ctes(_interp_time_sql(["CCI", "CCO"]), "eid", "flow_c", extra={
    "g": _pivot_sql(_COHORT_FLOW(["CCI", "CCO"]), ["CCI", "CCO"], rnd=False)}))(_interp_time)

# --- sources and sinks round trips (SRC-02/03/07, SNK-01..05) ---------------------------------------------------

import uuid  # noqa: E402

from wardlens.session import checkpoint_dir  # noqa: E402
from wardlens.sources import sinks as SK  # noqa: E402
from wardlens.sources.dataset import load_table  # noqa: E402
from wardlens.sources.loader import register_parquet_loader  # noqa: E402
from wardlens.streaming.flowsheet_etl import read_flowsheet_stream, run_flowsheet_stream  # noqa: E402


def _scratch(spark, tag: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local path on a cluster)."""
    return os.path.join(checkpoint_dir(spark), f"wardlens-{tag}-{uuid.uuid4().hex}")


import os  # noqa: E402


def root_of_csv(spark, sf, tables=("labs",)) -> str:
    """A folder of raw extracts under their original names, as hospitals deliver them: names in mixed case, all columns text."""
    root = _scratch(spark, "root")
    for name in tables:
        t = ds(spark, sf).table(name)
        raw = t.df.withColumn(t.search_col, F.initcap(t.search_col)) if t.meta.sanitize else t.df
        SK.csv_writer(raw).csv(os.path.join(root, SK.LAYOUTS["swan"][name]))
    return root


def _cached_root(spark, sf, partitioned: bool, table: str = "labs") -> Dataset:
    root = root_of_csv(spark, sf, (table,))
    Dataset.from_root(spark, root).write_cache([table], partitioned=partitioned)
    return Dataset.from_root(spark, root)


_SEL_LABS_SQL = with_ctes(f"SELECT * FROM labs_c WHERE lab_component_name IN {_lst(SEL_LABS)}", "labs_c")
register("csv_sel", _SEL_LABS_SQL)(lambda spark, sf: Dataset.from_root(spark, root_of_csv(spark, sf)).labs.sel(SEL_LABS))
register("cached_sel", _SEL_LABS_SQL)(lambda spark, sf: _cached_root(spark, sf, False).labs.sel(SEL_LABS))
register("part_sel", _SEL_LABS_SQL)(lambda spark, sf: _cached_root(spark, sf, True).labs.sel(SEL_LABS))

_NAME_COUNTS_SQL = "SELECT upper(display_name) AS display_name, CAST(count(*) AS BIGINT) AS count FROM flowsheet_v WHERE display_name IS NOT NULL GROUP BY 1"
register("root_value_counts", with_ctes(_NAME_COUNTS_SQL, extra={"__views__": ["flowsheet"]}))(
    lambda spark, sf: _cached_root(spark, sf, True, "flowsheet").flowsheet.unique())
register("root_search", with_ctes("SELECT DISTINCT upper(display_name) AS display_name FROM flowsheet_v WHERE upper(display_name) LIKE '%CC%'",
    extra={"__views__": ["flowsheet"]}))(lambda spark, sf: Dataset.from_root(spark, root_of_csv(spark, sf, ("flowsheet",))).flowsheet.search("CC"))


def _partition_refresh(spark, sf):
    """A copy of an older extract, in which one name is brought up to date."""
    root = root_of_csv(spark, sf)
    new = Dataset.from_root(spark, root, cached=False).labs
    old = Table(new.meta, new.df.withColumn("lab_result_unit", F.lit("OLD")), new.source, new.stem)
    old.partition()
    new.refresh(["Hemoglobin"])
    return Dataset.from_root(spark, root).labs.df


register("partition_refresh", with_ctes("""
SELECT encounter_id, upper(lab_component_name) AS lab_component_name, lab_result_value,
  CASE WHEN lab_component_name = 'HEMOGLOBIN' THEN lab_result_unit ELSE 'OLD' END AS lab_result_unit,
  lab_collection_days_since_birth, lab_collection_time, loinc_code FROM labs_v""", extra={"__views__": ["labs"]}))(_partition_refresh)


def _partition_roundtrip(spark, sf):
    p = ds(spark, sf).labs.partition(_scratch(spark, "part"))
    return spark.read.parquet(p)


register("partition_roundtrip", with_ctes("""
SELECT encounter_id, lab_result_value, lab_result_unit, lab_collection_days_since_birth, lab_collection_time, loinc_code,
  upper(lab_component_name) AS lab_component_name FROM labs_v""",
    extra={"__views__": ["labs"]}))(_partition_roundtrip)


def _dumped(table: str):
    """The export of one table of the cohort, read back."""
    def run(spark, sf):
        co = cohort(spark, sf)
        d = _scratch(spark, "dump")
        SK.dump_tables(co, d, tables=[table])
        schema = (co.encounter_info if table == "encounters" else co.db.table(table).sel()).schema
        return spark.read.schema(schema).option("header", True).csv(os.path.join(d, SK.LAYOUTS["swan"][table]))
    return run


register("dump_cohort", with_ctes(
    "SELECT * FROM labs_c WHERE lab_component_name IN ('CREATININE SERUM', 'TROPONIN I') AND encounter_id IN (SELECT encounter_id FROM eid)",
    "eid", "labs_c"))(_dumped("labs"))
register("dump_cohort_encounters", with_ctes("SELECT * FROM einfo", "einfo"))(_dumped("encounters"))
register("dump_cohort_procedures", with_ctes(
    f"SELECT * FROM proc WHERE order_name IN {_lst(CS.ICU_CODES + CS.ROOM_CODES + CS.CABG_NAMES)} AND encounter_id IN (SELECT encounter_id FROM eid)",
    "eid", "proc"))(_dumped("procedures"))

def _export_manifest(spark, sf):
    """Rows per required name of the cohort's export, with the names of an attached metric."""
    co = cohort(spark, sf)
    co.add_continuous_metric(MT.CardiacPower)
    d = _scratch(spark, "export")
    SK.dump_tables(co, d)
    return SK.read_manifest(spark, d)


_MANIFEST_NAMES = {"labs": ("labs_c", "lab_component_name", ["CREATININE SERUM", "TROPONIN I"]),
                   "flowsheet": ("flow_c", "display_name", MT.CardiacPower.REQUIRES["flowsheet"]),
                   "procedures": ("proc", "order_name", list(dict.fromkeys(CS.ICU_CODES + CS.ROOM_CODES + CS.CABG_NAMES)))}
register("export_manifest", with_ctes(
    "SELECT 'encounters' AS \"table\", '' AS name, CAST(count(*) AS BIGINT) AS rows FROM einfo" + "".join(f"""
UNION ALL SELECT '{t}', n.name, CAST(count(c.encounter_id) AS BIGINT) FROM (SELECT unnest([{_lst(names)[1:-1]}]) AS name) n
LEFT JOIN (SELECT * FROM {cte} WHERE encounter_id IN (SELECT encounter_id FROM eid)) c ON c.{col} = n.name GROUP BY n.name"""
    for t, (cte, col, names) in _MANIFEST_NAMES.items()), "eid", "labs_c", "flow_c", "proc"))(_export_manifest)

_ETL_SQL = with_ctes("""
SELECT encounter_id, CAST(flowsheet_days_since_birth AS INT) AS flowsheet_days_since_birth, flowsheet_time, flowsheet_value,
  upper(display_name) AS display_name FROM flowsheet_v
WHERE encounter_id IS NOT NULL AND TRY_CAST(flowsheet_days_since_birth AS INT) IS NOT NULL""", extra={"__views__": ["flowsheet"]})


def _raw_flowsheet_csv(spark, sf) -> str:
    src = _scratch(spark, "flow-csv")
    SK.csv_writer(ds(spark, sf).flowsheet.df).csv(src)
    return src


def _etl(spark, sf):
    out = SK.preprocess_flowsheet(spark, _raw_flowsheet_csv(spark, sf), _scratch(spark, "flow-etl"))
    return spark.read.parquet(out)


def _etl_stream(spark, sf):
    """Two deliveries of the extract, one with its columns in reverse order."""
    src, rows = _scratch(spark, "flow-csv"), ds(spark, sf).flowsheet.df
    odd = F.col("encounter_id") % 2 == 1
    SK.csv_writer(rows.where(odd)).csv(src)
    SK.csv_writer(rows.where(~odd | F.col("encounter_id").isNull()).select(*reversed(rows.columns))).mode("append").csv(src)
    out = run_flowsheet_stream(spark, src, _scratch(spark, "flow-stream"), _scratch(spark, "flow-stream-ckpt"))
    return read_flowsheet_stream(spark, out)


register("flowsheet_etl", _ETL_SQL)(_etl)
register("flowsheet_stream_etl", _ETL_SQL)(_etl_stream)


def _loaded(spark, sf):
    """A driver table through a registered loader: row groups as partitions, equality on the status handed to the loader."""
    register_parquet_loader(spark, "wardlens_parquet", "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string")
    return load_table(spark, sf, "orders.parquet", fmt="wardlens_parquet").where("o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")


register("loader_read", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' "
         "AND o_orderpriority IN ('1-URGENT', '2-HIGH')")(_loaded)


def _aki_outcome(spark, sf):
    co = cohort(spark, sf)
    return MT.PostOpAKI(co.db, encounter_id=co.eid, offset=co.offset).compute()


register("aki_outcome", ORACLE["aki"])(_aki_outcome)
