"""Declared schemas and per-table metadata of the seven clinical extracts.

Raw day columns are read as text: de-identified extracts write ages above the cap as
``>NNN``, so they are cleaned (FIL-02) before any numeric cast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Logical table -> file name, per dataset layout.
LAYOUTS = {
    "swan": {
        "encounters": "Table1_Encounter_Info.csv",
        "flowsheet": "Table2_Flowsheet.csv",
        "labs": "Table3_Lab.csv",
        "medications": "Table4_Administered_Medication.csv",
        "transfusion": "Table5_Blood_Transfusion.csv",
        "procedures": "Table6_Procedures.csv",
        "diagnosis": "Table7_DX.csv",
    },
    "tavr": {
        "encounters": "Table1_Encounter_Info.csv",
        "flowsheet": "Table2_Flowsheet.csv",
        "labs": "Table3_Lab.csv",
        "medications": "Table4_Administered_Medications.csv",
        "transfusion": "Table5_Blood_Transfusion.csv",
        "procedures": "Table6_Procedures.csv",
        "diagnosis": "Table7_DX.csv",
    },
}

TABLE_NAMES = ("encounters", "flowsheet", "labs", "medications", "transfusion", "procedures", "diagnosis")


@dataclass(frozen=True)
class TableMeta:
    name: str
    schema: T.StructType
    search_col: str
    sanitize: bool  # upper-case the search column on scan
    rename: dict = field(default_factory=dict)  # raw -> common column names (CO-01)


_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()


def _st(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


# Search column, sanitize flag and common-name map per logical table.
META = {
    "encounters": TableMeta(
        "encounters",
        _st(("encounter_id", _L), ("person_id", _L), ("gender", _I), ("age", T.ShortType()),
            ("financial_class", _S), ("death_during_encounter", T.BooleanType())),
        "encounter_id", False),
    "flowsheet": TableMeta(
        "flowsheet",
        _st(("encounter_id", _L), ("flowsheet_days_since_birth", _S), ("flowsheet_time", _S),
            ("display_name", _S), ("flowsheet_value", _S)),
        "display_name", True,
        {"flowsheet_days_since_birth": "days_from_dob", "display_name": "name",
         "flowsheet_value": "value", "flowsheet_time": "time"}),
    "labs": TableMeta(
        "labs",
        _st(("encounter_id", _L), ("lab_component_name", _S), ("lab_result_value", _S),
            ("lab_result_unit", _S), ("lab_collection_days_since_birth", _S),
            ("lab_collection_time", _S), ("loinc_code", _S)),
        "lab_component_name", True,
        {"lab_collection_days_since_birth": "days_from_dob", "lab_component_name": "name",
         "lab_result_value": "value", "lab_result_unit": "unit", "lab_collection_time": "time"}),
    "medications": TableMeta(
        "medications",
        _st(("encounter_id", _L), ("administered_days_since_birth", _S), ("administered_time", _S),
            ("medication_name", _S), ("dose", _S)),
        "medication_name", True),
    "transfusion": TableMeta(
        "transfusion",
        _st(("encounter_id", _L), ("transfusion_name", _S), ("number_of_units", _S)),
        "transfusion_name", True),
    "procedures": TableMeta(
        "procedures",
        _st(("encounter_id", _L), ("person_id", _L), ("order_name", _S), ("days_from_dob_procstart", _S)),
        "order_name", True, {"order_name": "procedure"}),
    "diagnosis": TableMeta(
        "diagnosis",
        _st(("person_id", _L), ("CodeDescription", _S), ("Code", _S), ("CodeType", _S), ("Provenance", _S)),
        "CodeDescription", True),
}


def day_columns(columns) -> list[str]:
    """Columns holding de-identified day counts (cleaned by FIL-02)."""
    return [c for c in columns if "days_from" in c or "days_since" in c]
