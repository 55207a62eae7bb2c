"""Procedure- and encounter-anchored cohorts (CO-02..06, JOIN-02/03/05)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions.scalar import DAY_S
from wardlens.operators.tidy import tidy_flow, tidy_labs, tidy_meds, tidy_procs
from wardlens.plans import variables as V
from wardlens.plans.fused import analysis_table, encounter_variables


def align(df: DataFrame, events: DataFrame, time_col: str = "time_s", how: str = "left",
          anchor: str = "all") -> DataFrame:
    """JOIN-03: re-base ``time_col`` on each encounter's event day (``offset``, in days).

    ``anchor='all'`` keeps one row per event (an encounter with two procedure days fans
    out); ``'first'``/``'last'`` keep the earliest/latest event only.
    """
    ev = events.select("encounter_id", "offset")
    if anchor in ("first", "last"):
        fn = F.min if anchor == "first" else F.max
        ev = ev.groupBy("encounter_id").agg(fn("offset").alias("offset"))
    elif anchor != "all":
        raise ValueError("anchor must be 'all', 'first' or 'last'")
    cols = [c for c in df.columns if c != "offset"]
    return (df.select(*cols).join(ev, "encounter_id", how)
              .withColumn(time_col, F.col(time_col) - F.col("offset").cast("bigint") * DAY_S))


class _CohortBase:
    db = None
    eid: DataFrame
    pid: DataFrame

    # --- CO-05: cohort slices in tidy form --------------------------------------------------
    def labs(self, names) -> DataFrame:
        return tidy_labs(self.db.labs.sel(lab_component_name=names, encounter_id=self.eid))

    def flowsheet(self, names, to_numeric: bool = True) -> DataFrame:
        return tidy_flow(self.db.flowsheet.sel(display_name=names, encounter_id=self.eid), to_numeric)

    def procs(self, names) -> DataFrame:
        return tidy_procs(self.db.procedures.sel(order_name=names, encounter_id=self.eid))

    def meds(self, names) -> DataFrame:
        return tidy_meds(self.db.medications.sel(medication_name=names, encounter_id=self.eid))


class ProcedureCohort(_CohortBase):
    """Encounters with one of ``procedures``; ``offset`` is the procedure day (CO-02)."""

    def __init__(self, db, procedures, person_id=None, encounter_id=None, persist: bool = False):
        self.db = db
        self.procedures = list(procedures)
        self.person_filter, self.encounter_filter, self.anchored = person_id, encounter_id, False
        self.procedure_info = db.procedures.sel(order_name=self.procedures, encounter_id=encounter_id)
        enc = db.encounters.sel(encounter_id=self.procedure_info.select("encounter_id"), person_id=person_id)
        # JOIN-02: procedures left-joined to encounter info, then rows with any null dropped
        self.encounter_info = (self.procedure_info.drop("days_from_dob_procstart", "person_id")
                               .join(enc, "encounter_id", "left").dropna("any"))
        self.offset = (self.procedure_info.select("encounter_id", F.col("days_from_dob_procstart").alias("offset"))
                       .distinct())
        if persist:
            self.persist()
        self._refresh_ids()

    def _refresh_ids(self):
        self.eid = self.encounter_info.select("encounter_id").distinct()
        self.pid = self.encounter_info.select("person_id").distinct()
        self.encounters = self.eid

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        """Keep the three cohort frames for repeated variable queries (recomputed from
        lineage if an executor is lost)."""
        self.procedure_info = self.procedure_info.persist(level)
        self.encounter_info = self.encounter_info.persist(level)
        self.offset = self.offset.persist(level)
        self._refresh_ids()
        return self

    def set_offset(self, df: DataFrame) -> "ProcedureCohort":
        """CO-04: a cohort anchored on another event table ``(encounter_id, offset)``."""
        if not {"encounter_id", "offset"} <= set(df.columns):
            raise ValueError("events need encounter_id and offset columns")
        other = object.__new__(ProcedureCohort)
        other.__dict__.update(self.__dict__)
        other.offset, other.anchored = df.select("encounter_id", "offset"), True
        return other

    def align_metric(self, df: DataFrame, time_column: str = "time_s", events: DataFrame | None = None,
                     how: str = "left", anchor: str = "all") -> DataFrame:
        return align(df, self.offset if events is None else events, time_column, how, anchor)

    def preop_labs(self, names) -> DataFrame:
        """CO-06: labs (any encounter) aligned on the cohort's procedure day, time <= 0."""
        labs = tidy_labs(self.db.labs.sel(lab_component_name=names))
        return self.align_metric(labs, how="inner").where(F.col("time_s") <= 0)

    # --- encounter variables (CL-*) ------------------------------------------------------------
    age = property(V.age)
    mortality = property(V.mortality)
    gender = property(V.gender)
    male_gender = property(V.male_gender)
    delirium = property(V.delirium)
    room_changes = property(V.room_changes)
    reexploration_for_bleed = property(V.reexploration_for_bleed)
    bmi = property(V.bmi)
    ckd = property(V.ckd)
    icu_start = property(V.icu_start)
    icu_los = property(V.icu_los)
    mechanical_ventilation_duration = property(V.vent_duration)
    osa = property(V.osa)
    chf = property(V.chf)
    dm = property(V.dm)
    cad = property(V.cad)
    stroke = property(V.stroke)
    postop_aki = V.postop_aki
    postop_troponin = V.postop_troponin
    postop_los = V.postop_los
    get_post_op_delirium = V.post_op_delirium
    or_days = V.or_days
    post_op_icu_days = V.post_op_icu_days
    blood_products = V.blood_products
    comorbidity = V.comorbidity
    table1 = analysis_table
    variables = encounter_variables


class EncounterCohort(_CohortBase):
    """A cohort of given encounters (CO-03); ``ids`` is a list or a DataFrame of ids."""

    def __init__(self, db, encounter_id, person_id=None):
        self.db = db
        self.encounter_info = db.encounters.sel(encounter_id=encounter_id, person_id=person_id)
        self.eid = self.encounter_info.select("encounter_id").distinct()
        self.pid = self.encounter_info.select("person_id").distinct()
        self.encounters = self.eid


def _add_metric(self, metric_cls):
    from wardlens.plans.metrics import add_continuous_metric
    return add_continuous_metric(self, metric_cls)


ProcedureCohort.add_continuous_metric = _add_metric
