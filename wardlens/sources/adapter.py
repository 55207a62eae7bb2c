"""Clinical views over the driver's TPC-H-like tables.

The same SQL text runs in Spark and in the DuckDB oracle; only the day difference and
the table references are rendered per engine. encounters <- customer, procedures <-
orders, labs and transfusion <- lineitem x orders, flowsheet and medications <- events,
diagnosis <- lineitem x orders x part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = ("customer", "orders", "lineitem", "part", "events")

# The adapter view definitions. {days(a, b)} is a placeholder for a - b in days.
VIEWS = {
    "encounters": """
SELECT c_custkey AS encounter_id, CAST(FLOOR(c_custkey / 2) AS BIGINT) AS person_id,
  CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 2 END AS gender, CAST(20 + c_custkey % 70 AS SMALLINT) AS age,
  c_mktsegment AS financial_class, c_acctbal < 0 AS death_during_encounter
FROM {customer}""",
    "procedures": """
SELECT o_custkey AS encounter_id, CAST(FLOOR(o_custkey / 2) AS BIGINT) AS person_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'CORONARY ARTERY BYPASS GRAFT TIMES 1-5 (CABG)'
    WHEN '2-HIGH' THEN 'HB CT ICU INTENSIVE ROOM CHG' WHEN '3-MEDIUM' THEN 'HB OR-MINUTES OPERATING ROOM COMPLEX'
    WHEN '4-NOT SPECIFIED' THEN 'HB REHAB ROOM CHG' ELSE 'CONTROL BLEEDING IN MEDIASTINUM, OPEN APPROACH' END AS order_name,
  CASE WHEN o_orderkey % 97 = 0 THEN '>32850' ELSE CAST({days(o_orderdate, DATE '1995-01-01')} % 30 AS STRING) END AS days_from_dob_procstart
FROM {orders}""",
    "labs": """
SELECT o_custkey AS encounter_id,
  CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'CREATININE SERUM' WHEN 'AO' THEN 'HEMOGLOBIN'
    WHEN 'NF' THEN 'O2SAT ARTERIAL MEASURED' WHEN 'NO' THEN 'PO2 ARTERIAL' WHEN 'RF' THEN 'O2SAT VENOUS MEASURED'
    ELSE CASE l_linenumber % 3 WHEN 0 THEN 'PO2 VENOUS' WHEN 1 THEN 'TROPONIN I' ELSE 'GFR' END END AS lab_component_name,
  CASE WHEN l_orderkey % 53 = 0 THEN 'HEMOLYZED' ELSE CAST(CAST(CASE concat(l_returnflag, l_linestatus)
    WHEN 'AF' THEN l_quantity / 10 WHEN 'AO' THEN 5 + l_quantity / 5 WHEN 'NF' THEN 50 + l_quantity
    WHEN 'NO' THEN 40 + l_quantity WHEN 'RF' THEN 30 + l_quantity ELSE 35 + l_quantity END AS DECIMAL(10,2)) AS STRING) END AS lab_result_value,
  'U' AS lab_result_unit, CAST({days(l_shipdate, DATE '1995-01-02')} % 30 AS STRING) AS lab_collection_days_since_birth,
  concat(lpad(CAST(l_orderkey % 24 AS STRING), 2, '0'), ':', lpad(CAST(l_partkey % 60 AS STRING), 2, '0'), ':', lpad(CAST(l_linenumber % 60 AS STRING), 2, '0')) AS lab_collection_time,
  CAST(l_partkey AS STRING) AS loinc_code
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "flowsheet": """
SELECT user_id AS encounter_id, CAST({days(ts, DATE '2024-01-01')} AS STRING) AS flowsheet_days_since_birth,
  substring(CAST(ts AS STRING), 12, 8) AS flowsheet_time,
  CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'CCO' WHEN event_type = 'click' THEN 'CCI'
    WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'CVP (MMHG)' WHEN event_type = 'error' THEN 'A-LINE MAP '
    WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'PULSE' WHEN event_type = 'purchase' THEN 'PAP (MEAN)'
    WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'BP' WHEN event_type = 'signup' THEN 'CAM ICU'
    WHEN event_id % 4 = 0 THEN 'HEIGHT' WHEN event_id % 4 = 2 THEN 'WEIGHT' ELSE 'VENT MODE' END AS display_name,
  CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN CAST(CAST(2 + FLOOR(value) % 7 AS INT) AS STRING)
    WHEN event_type = 'click' THEN CAST(CAST(1 + FLOOR(value) % 5 AS INT) AS STRING)
    WHEN event_type = 'error' AND event_id % 2 = 0 THEN CAST(CAST(FLOOR(value) % 40 AS INT) AS STRING)
    WHEN event_type = 'error' THEN CAST(CAST(60 + FLOOR(value) % 40 AS INT) AS STRING)
    WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN CAST(CAST(60 + FLOOR(value) % 50 AS INT) AS STRING)
    WHEN event_type = 'purchase' THEN CAST(CAST(15 + FLOOR(value) % 25 AS INT) AS STRING)
    WHEN event_type = 'signup' AND event_id % 2 = 0 THEN concat(CAST(CAST(100 + FLOOR(value) % 60 AS INT) AS STRING), '/', CAST(CAST(50 + FLOOR(value) % 35 AS INT) AS STRING))
    WHEN event_type = 'signup' THEN CASE CAST(FLOOR(value) % 4 AS INT) WHEN 0 THEN 'Delirious- CAM+' WHEN 1 THEN 'Not delirious- CAM-' WHEN 2 THEN 'Unable to assess' ELSE '' END
    WHEN event_id % 4 = 0 THEN CAST(CAST(58 + FLOOR(value) % 18 AS INT) AS STRING)
    WHEN event_id % 4 = 2 THEN CAST(CAST(100 + FLOOR(value) % 120 AS INT) AS STRING) ELSE 'AC/VC' END AS flowsheet_value
FROM {events}""",
    "medications": """
SELECT user_id AS encounter_id, CAST({days(ts, DATE '2024-01-01')} AS STRING) AS administered_days_since_birth,
  substring(CAST(ts AS STRING), 12, 8) AS administered_time,
  CASE event_id % 3 WHEN 0 THEN 'PROPOFOL INFUSION' WHEN 1 THEN 'FENTANYL INJECTION' ELSE 'MIDAZOLAM INJECTION' END AS medication_name,
  CAST(CAST(FLOOR(value) AS INT) AS STRING) AS dose
FROM {events}""",
    "transfusion": """
SELECT o_custkey AS encounter_id, concat('TRANSFUSE ', CASE l_returnflag WHEN 'A' THEN 'RBC' WHEN 'N' THEN 'PLASMA' ELSE 'PLATELETS' END,
  ': ', CAST(CAST(1 + l_quantity % 4 AS INT) AS STRING), ' UNITS') AS transfusion_name,
  concat(CAST(CAST(1 + l_quantity % 4 AS INT) AS STRING), ' UNITS') AS number_of_units
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_partkey % 11 = 0""",
    "diagnosis": """
SELECT DISTINCT CAST(FLOOR(o_custkey / 2) AS BIGINT) AS person_id,
  CASE p_type WHEN 'MEDIUM' THEN 'Type 2 diabetes mellitus' WHEN 'STANDARD' THEN 'Acute systolic heart failure'
    WHEN 'LARGE' THEN 'Sleep apnea, unspecified' WHEN 'PROMO' THEN 'Coronary atherosclerosis'
    WHEN 'ECONOMY' THEN 'Cerebral infarction, unspecified' ELSE 'Alcoholic cirrhosis' END AS CodeDescription,
  CASE p_type WHEN 'MEDIUM' THEN 'E11.9' WHEN 'STANDARD' THEN 'I50.21' WHEN 'LARGE' THEN 'G47.30' WHEN 'PROMO' THEN 'I25.10'
    WHEN 'ECONOMY' THEN 'I63.9' ELSE 'K70.30' END AS Code,
  CASE WHEN p_size % 4 = 0 THEN 'ICD-9-CM' ELSE 'ICD-10-CM' END AS CodeType, 'Billing' AS Provenance
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
WHERE (l_orderkey + l_linenumber) % 37 = 0""",
}


def _render(sql: str, days_fmt: str, tables: dict[str, str]) -> str:
    out = sql
    while "{days(" in out:
        i = out.index("{days(")
        j = out.index(")}", i)
        a, b = [s.strip() for s in out[i + 6:j].split(",", 1)]
        out = out[:i] + days_fmt.format(a=a, b=b) + out[j + 2:]
    for name, ref in tables.items():
        out = out.replace("{" + name + "}", ref)
    return out


def spark_view_sql(view: str, sf_dir: str) -> str:
    tables = {t: f"parquet.`{sf_dir.rstrip('/')}/{t}.parquet`" for t in RAW_TABLES}
    return _render(VIEWS[view], "datediff({a}, {b})", tables)


def duckdb_view_sql(view: str) -> str:
    return _render(VIEWS[view], "datediff('day', {b}, {a})", {t: t for t in RAW_TABLES})


def duckdb_with(*views: str) -> str:
    """A ``WITH`` prefix defining the named adapter views for an oracle query."""
    parts = [f"{v} AS ({duckdb_view_sql(v)}\n)" for v in views]
    return "WITH " + ",\n".join(parts)


def spark_views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Lazy adapter DataFrames keyed by logical table name."""
    return {v: spark.sql(spark_view_sql(v, sf_dir)) for v in VIEWS}
