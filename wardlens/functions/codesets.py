"""Code sets used by cohort variables.

Small fixed dimension tables: a broadcast of them has a proven size bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Room-charge order names.
ROOM_CODES = [
    "HB MED/SURG/GYN W/ MONITOR ROOM CHG",
    "HB MED/SURG/GYN ROOM CHG",
    "HB CT ICU INTENSIVE ROOM CHG RN 1:1",
    "HB SURGICAL INTENSIVE ROOM CHG",
    "HB INTERMEDIATE ROOM CHG",
    "HB CT ICU INTENSIVE ROOM CHG",
    "HB TRANSPLANT OR POST TX ROOM CHG",
    "HB REHAB ROOM CHG",
    "HB MEDICAL INTENSIVE ROOM CHG",
    "HB BMT TRANSPLANT ROOM CHG",
    "HB ONCOLOGY ROOM CHG",
    "HB MEDICAL INTENSIVE ROOM CHG RN 1:1",
    "HB SURGICAL INTENSIVE ROOM CHG RN 1:1",
    "HB BURN INTENSIVE ROOM CHG",
    "HB GENERAL INTENSIVE ROOM CHG",
    "HB OB W MONITOR ROOM CHG",
    "HB CT ICU INTENSIVE ROOM CHG RN 2:1",
    "HB BURN INTENSIVE ROOM CHG RN 1:1",
    "HB SURGICAL INTENSIVE ROOM CHG RN 2:1",
    "HB BURN INTENSIVE ROOM CHG RN 2:1",
    "HB MEDICAL INTENSIVE ROOM CHG RN 2:1",
    "HB HIGH RISK OB (INTERMEDIATE) ROOM CHG",
    "HB OR-MINUTES OPERATING ROOM COMPLEX",
]

# Intensive-care room charges.
ICU_CODES = [
    "HB CT ICU INTENSIVE ROOM CHG RN 1:1",
    "HB SURGICAL INTENSIVE ROOM CHG",
    "HB CT ICU INTENSIVE ROOM CHG",
    "HB MEDICAL INTENSIVE ROOM CHG",
    "HB MEDICAL INTENSIVE ROOM CHG RN 1:1",
    "HB SURGICAL INTENSIVE ROOM CHG RN 1:1",
    "HB BURN INTENSIVE ROOM CHG",
    "HB GENERAL INTENSIVE ROOM CHG",
    "HB CT ICU INTENSIVE ROOM CHG RN 2:1",
    "HB BURN INTENSIVE ROOM CHG RN 1:1",
    "HB SURGICAL INTENSIVE ROOM CHG RN 2:1",
    "HB BURN INTENSIVE ROOM CHG RN 2:1",
    "HB MEDICAL INTENSIVE ROOM CHG RN 2:1",
]

# Operating-room minute charges.
OR_ROOM_CODES = [
    "HB OR-MINUTES OPERATING ROOM COMPLEX",
    "HB OR-MINUTES OR ORGAN TRANSPL",
    "HB OR-MINUTES OR KIDNEY TRANSPL",
    "HB OR-MINUTES OPERATING ROOM",
    "HB OR-MINUTES LEVEL 5",
]

# Procedure groups defining cohorts.
CABG_NAMES = [
    "CORONARY ARTERY BYPASS GRAFT TIMES 1-5 (CABG)",
    "CORONARY ARTERY BYPASS GRAFT TIMES 1-5 (CABG) REDO",
    "CORONARY ARTERY BYPASS GRAFT TIMES 1-5 (CABG) WITH TRANSMYOCARDIAL REVASCULIZATION (TMR) LASER",
    "CORONARY ARTERY BYPASS GRAFT TIMES 1-5 (CABG) OFF PUMP",
]
AORTIC_NAMES = [
    "AORTIC ROOT REPLACEMENT, MECHANICAL",
    "AORTIC ROOT REPLACEMENT",
    "AORTIC ARCH REPAIR",
    "THORACIC AORTIC ANEURYSM REPAIR",
    "ABDOMINAL AORTIC ANEURYSM REPAIR",
    "AORTIC ROOT REPLACEMENT REDO",
    "ASCENDING AORTIC ANEURYSM REPAIR",
    "ASCENDING AORTIC ANEURYSM REPAIR REDO",
]
VALVE_SURGERIES = [
    "TRICUSPID VALVE REPLACEMENT/REPAIR",
    "PULMONARY VALVE REPLACEMENT/REPAIR",
    "MITRAL VALVE REPLACEMENT/REPAIR",
    "AORTIC VALVE REPLACEMENT/REPAIR",
]

# Return-to-theatre-for-bleeding procedures.
REEXPLORATION_PROCEDURES = [
    "CONTROL BLEEDING IN MEDIASTINUM, OPEN APPROACH",
    "CONTROL BLEEDING IN CHEST WALL, OPEN APPROACH",
    "POST OPERATIVE BLEEDING HEART  NO BYPASS",
    "POST OP BLEEDING HEART ON BYPASS",
]

# Ventilator-mode flowsheet rows and sleep-apnoea descriptions.
VENT_MODE_NAMES = ["VENT MODE", "$ VENT MODE **REQUIRED** "]
OSA_DESCRIPTIONS = ["UNSPECIFIED SLEEP APNEA", "SLEEP APNEA, UNSPECIFIED"]

# ICD-10 coronary artery disease codes.
CAD_ICD10 = [
    "I25.10", "I25.110", "I25.111", "I25.118", "I25.119", "I25.2", "I25.5", "I25.6",
    "I25.700", "I25.701", "I25.708", "I25.709", "I25.710", "I25.711", "I25.718", "I25.719",
    "I25.720", "I25.721", "I25.728", "I25.729", "I25.730", "I25.731", "I25.738", "I25.739",
    "I25.750", "I25.751", "I25.758", "I25.759", "I25.760", "I25.761", "I25.768", "I25.769",
    "I25.790", "I25.791", "I25.798", "I25.799", "I25.810", "I25.811", "I25.812", "I25.82",
]

# ICD-10 stroke codes.
STROKE_ICD10 = [
    "I63.9", "I63.10", "I63.132", "I63.231", "I63.239", "I63.8", "I63.031", "I63.032",
    "I63.131", "I63.232", "I63.00", "I63.039", "I65.21", "I65.22", "I65.23", "I65.29",
]

# Comorbidity ICD-10 prefixes (liver disease, renal failure).
LIVER_DISEASE_PREFIXES = ["Z94.4", "K70", "K72", "K73", "K74", "B18", "I98.2", "K76.02", "K76.03", "K71.1"]
RENAL_FAILURE_PREFIXES = ["Z99.2", "Z94.0", "N25.9", "Z49.0", "Z49.1", "Z49.2", "I13.1", "I12.0"]

# Kidney-injury stage labels.
AKI_LABELS = {
    -3: "No preoperative creatinine",
    -1: "No postoperative creatinine",
    3: "Stage 3 AKI",
    2: "Stage 2 AKI",
    1: "Stage 1 AKI",
    0: "No AKI",
}

# Monitor, ventilator and infusion name groups of the flowsheet and the laboratory.
CIRCULATORY = ["Pulse", "CVP", "MAP (mmHg)", "A-line MAP ", "A-line 2 MAP ", "Cardiac Output", "PAP (Mean)"]
ICU_MONITORS = ["Cardiac Output", "SVO2 (%)", "SVR (dyne*sec)/cm5", "SVRI (dyne*sec)/cm5", "PVRI (dyne*sec)/cm5", "PVR (dyne*sec)/cm5"]
SWAN_MONITORS = ["SVO2 (%)", "CCI", "CCO", "SQI", "SVI"]
FLOW_OXYGENATION = ["SPO2", "SVO2 (%)"]
VENTILATION = ["ETCO2", "Resp", "Vital Capacity (mls)", " Vt (mL/kg)", "Set Ve (L/min)", "Ve (L/min)"]
VENTILATOR_SETTINGS = ["SET VE (L/MIN)", "SET INSP PRESS (CMH2O)", "I:E RATIO"]
BASIC_MONITORS = ["SPO2", "TEMP", "PULSE", "HR (ECG)"]
LAB_OXYGENATION = ["O2SAT Arterial Measured", "PCO2 ARTERIAL", "PO2 ARTERIAL", "PO2 Venous", "O2SAT Venous Measured"]
PARALYTICS = ["VOLUME (ML) CISATRACURIUM", "VOLUME (ML) VECURONIUM", "VOLUME (ML) ROCURONIUM"]
NARCOTICS = ["VOLUME (ML) HYDROMORPHONE", "VOLUME (ML) FENTANYL", "VOLUME (ML) MORPHINE"]
ANXIOLYTICS = ["VOLUME (ML) MIDAZOLAM", "VOLUME (ML) LORAZEPAM"]

# set -> (table whose codes or names it lists, exact or prefix, values)
CODE_SETS = {
    "room_codes": ("procedures", "exact", ROOM_CODES),
    "icu_codes": ("procedures", "exact", ICU_CODES),
    "or_room_codes": ("procedures", "exact", OR_ROOM_CODES),
    "cabg_names": ("procedures", "exact", CABG_NAMES),
    "aortic_names": ("procedures", "exact", AORTIC_NAMES),
    "valve_surgeries": ("procedures", "exact", VALVE_SURGERIES),
    "cad": ("diagnosis", "exact", CAD_ICD10),
    "stroke": ("diagnosis", "exact", STROKE_ICD10),
    "liver_disease": ("diagnosis", "prefix", LIVER_DISEASE_PREFIXES),
    "renal_failure": ("diagnosis", "prefix", RENAL_FAILURE_PREFIXES),
    "circulatory": ("flowsheet", "exact", CIRCULATORY),
    "icu_monitors": ("flowsheet", "exact", ICU_MONITORS),
    "swan_monitors": ("flowsheet", "exact", SWAN_MONITORS),
    "flow_oxygenation": ("flowsheet", "exact", FLOW_OXYGENATION),
    "ventilation": ("flowsheet", "exact", VENTILATION),
    "ventilator_mode": ("flowsheet", "exact", VENT_MODE_NAMES),
    "ventilator_settings": ("flowsheet", "exact", VENTILATOR_SETTINGS),
    "basic_monitors": ("flowsheet", "exact", BASIC_MONITORS),
    "paralytics": ("flowsheet", "exact", PARALYTICS),
    "narcotics": ("flowsheet", "exact", NARCOTICS),
    "anxiolytics": ("flowsheet", "exact", ANXIOLYTICS),
    "lab_oxygenation": ("labs", "exact", LAB_OXYGENATION),
}


def code_sets(spark: SparkSession, kind: str | None = None) -> DataFrame:
    """The library's sets as one small table ``(set_name, code, match, kind)``, or those of one kind of table."""
    rows = [(name, code, match, k) for name, (k, match, codes) in CODE_SETS.items() for code in codes if kind in (None, k)]
    return spark.createDataFrame(rows, "set_name string, code string, match string, kind string")
