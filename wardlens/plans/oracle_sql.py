"""Independent DuckDB SQL for every registered query (the correctness oracle).

Built from the adapter views plus plain SQL CTEs; shares no code path with the Spark side
except the adapter text itself.
"""

from __future__ import annotations

from wardlens.functions import codesets as CS
from wardlens.sources.adapter import duckdb_view_sql


def _lst(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


DIGITS = "regexp_matches(CAST({c} AS VARCHAR), '^[0-9]+$')"


def _hms(c: str) -> str:
    return (f"CASE WHEN regexp_matches({c}, '^[0-9]+:[0-9]+:[0-9]+$') THEN "
            f"TRY_CAST(split_part({c}, ':', 1) AS BIGINT) * 3600 + TRY_CAST(split_part({c}, ':', 2) AS BIGINT) * 60 "
            f"+ TRY_CAST(split_part({c}, ':', 3) AS BIGINT) END")


# Reusable CTE bodies (DuckDB dialect).
CTE = {
    "proc": f"""SELECT encounter_id, person_id, upper(order_name) AS order_name,
  CAST(days_from_dob_procstart AS INT) AS days_from_dob_procstart
FROM procedures_v WHERE {DIGITS.format(c='days_from_dob_procstart')} AND encounter_id IS NOT NULL""",
    "pinfo": f"SELECT * FROM proc WHERE order_name IN {_lst(CS.CABG_NAMES)}",
    "enc": "SELECT * FROM encounters_v WHERE encounter_id IS NOT NULL AND encounter_id IN (SELECT encounter_id FROM pinfo)",
    "einfo": """SELECT p.encounter_id, p.order_name, e.person_id, e.gender, e.age, e.financial_class, e.death_during_encounter
FROM pinfo p LEFT JOIN enc e ON p.encounter_id = e.encounter_id
WHERE e.person_id IS NOT NULL AND e.gender IS NOT NULL AND e.age IS NOT NULL AND e.financial_class IS NOT NULL
  AND e.death_during_encounter IS NOT NULL AND p.order_name IS NOT NULL""",
    "eid": "SELECT DISTINCT encounter_id FROM einfo",
    "pid": "SELECT DISTINCT person_id FROM einfo",
    "offs": 'SELECT DISTINCT encounter_id, days_from_dob_procstart AS "offset" FROM pinfo',
    "labs_c": f"""SELECT encounter_id, upper(lab_component_name) AS lab_component_name, lab_result_value, lab_result_unit,
  CAST(lab_collection_days_since_birth AS INT) AS lab_collection_days_since_birth, lab_collection_time, loinc_code
FROM labs_v WHERE {DIGITS.format(c='lab_collection_days_since_birth')} AND encounter_id IS NOT NULL""",
    "flow_c": f"""SELECT encounter_id, CAST(flowsheet_days_since_birth AS INT) AS flowsheet_days_since_birth, flowsheet_time,
  upper(display_name) AS display_name, flowsheet_value
FROM flowsheet_v WHERE {DIGITS.format(c='flowsheet_days_since_birth')} AND encounter_id IS NOT NULL""",
    "meds_c": f"""SELECT encounter_id, CAST(administered_days_since_birth AS INT) AS administered_days_since_birth, administered_time,
  upper(medication_name) AS medication_name, dose
FROM medications_v WHERE {DIGITS.format(c='administered_days_since_birth')} AND encounter_id IS NOT NULL""",
    "tr_c": "SELECT encounter_id, upper(transfusion_name) AS transfusion_name, number_of_units FROM transfusion_v WHERE encounter_id IS NOT NULL",
    "dx_c": "SELECT person_id, upper(CodeDescription) AS CodeDescription, Code, CodeType, Provenance FROM diagnosis_v",
}


def tidy_labs_sql(src: str) -> str:
    return f"""SELECT encounter_id, time_s, name, value FROM (
  SELECT encounter_id, lab_component_name AS name, TRY_CAST(lab_result_value AS DOUBLE) AS value,
    CAST(lab_collection_days_since_birth AS BIGINT) * 86400 + {_hms('lab_collection_time')} AS time_s,
    lab_result_unit, loinc_code FROM {src}) x
WHERE encounter_id IS NOT NULL AND time_s IS NOT NULL AND name IS NOT NULL AND value IS NOT NULL
  AND lab_result_unit IS NOT NULL AND loinc_code IS NOT NULL"""


def tidy_flow_sql(src: str, numeric: bool = True) -> str:
    v = "TRY_CAST(flowsheet_value AS DOUBLE)" if numeric else "flowsheet_value"
    return f"""SELECT encounter_id, time_s, name, value FROM (
  SELECT encounter_id, display_name AS name, {v} AS value,
    CAST(flowsheet_days_since_birth AS BIGINT) * 86400 + {_hms('flowsheet_time')} AS time_s FROM {src}) x
WHERE encounter_id IS NOT NULL AND time_s IS NOT NULL AND name IS NOT NULL AND value IS NOT NULL"""


def tidy_meds_sql(src: str) -> str:
    return f"""SELECT encounter_id, time_s, name, value FROM (
  SELECT encounter_id, medication_name AS name, TRY_CAST(dose AS DOUBLE) AS value,
    CAST(administered_days_since_birth AS BIGINT) * 86400 + {_hms('administered_time')} AS time_s FROM {src}) x
WHERE encounter_id IS NOT NULL AND time_s IS NOT NULL AND name IS NOT NULL AND value IS NOT NULL"""


def with_ctes(body: str, *names: str, extra: dict | None = None) -> str:
    """``WITH`` clause holding the adapter views (suffixed ``_v``), the named shared CTEs
    (with their dependencies) and ``extra`` query-specific CTEs, then ``body``."""
    deps = {"pinfo": ["proc"], "enc": ["pinfo"], "einfo": ["pinfo", "enc"], "eid": ["einfo"], "pid": ["einfo"],
            "offs": ["pinfo"]}
    views = {"proc": "procedures", "enc": "encounters", "labs_c": "labs", "flow_c": "flowsheet",
             "meds_c": "medications", "tr_c": "transfusion", "dx_c": "diagnosis"}
    order: list[str] = []

    def add(n):
        for d in deps.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    need_views = []
    for n in order:
        if n in views and views[n] not in need_views:
            need_views.append(views[n])
    for v in (extra or {}).get("__views__", []):
        if v not in need_views:
            need_views.append(v)
    parts = [f"{v}_v AS ({duckdb_view_sql(v)}\n)" for v in need_views]
    parts += [f"{n} AS ({CTE[n]})" for n in order]
    parts += [f"{k} AS ({v})" for k, v in (extra or {}).items() if k != "__views__"]
    return "WITH " + ",\n".join(parts) + "\n" + body
