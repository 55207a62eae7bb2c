"""Continuous physiologic metrics of a cohort (MET-01..12, UDF-01..03).

A metric fetches its required signals (MET-01), builds a per-encounter grid with grouped
pivots, fills it with the segmented interpolation operators and returns a long frame.
There is no per-encounter loop: every step is a join, an aggregate or a segmented window
keyed by ``encounter_id``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions.scalar import DAY_S, HOUR_S, o2_content, safe_div
from wardlens.session import materialize
from wardlens.operators import summary as SM
from wardlens.operators import tidy as TD
from wardlens.operators import timeseries as TS
from wardlens.sources.dataset import filter_isin

HGB_NAMES = ["HEMOGLOBIN", "HEMOGLOBIN ARTERIAL", "HEMOGLOBIN VENOUS"]


class Metric:
    """A metric needs named signals per source and turns them into a tidy result.

    Subclasses set ``REQUIRES`` (source -> names), optionally ``RENAME`` and the
    ``after_*_sel`` hooks (DataFrame -> DataFrame on the raw selection), and implement
    ``compute``.
    """

    REQUIRES: dict = {}
    RENAME: dict = {}
    classname = "Metric"
    shortname = "_default_"
    units: dict = {}
    limits: dict = {}
    normal_range: dict = {}

    def __init__(self, db, encounter_id=None):
        self.db = db
        self.encounter_id = encounter_id  # list or DataFrame of ids; None = every encounter
        self.shared: dict[str, DataFrame] = {}  # source -> rows fetched for several metrics at once

    def __repr__(self):
        return self.classname

    def __attach__(self, obj):
        setattr(obj, self.classname, self)

    # UDF-02 hooks
    def after_labs_sel(self, df: DataFrame) -> DataFrame:
        return df

    def after_flowsheet_sel(self, df: DataFrame) -> DataFrame:
        return df

    def after_medications_sel(self, df: DataFrame) -> DataFrame:
        return df

    def db_fetch(self, encounter_id=None) -> DataFrame:
        """MET-01: required signals in tidy form, only encounters present in every source."""
        ids = self.encounter_id if encounter_id is None else encounter_id
        parts = []
        for source in self.REQUIRES:
            raw = self.selection(source, ids)
            if source == "labs":
                parts.append(TD.tidy_labs(self.after_labs_sel(raw)))
            elif source == "flowsheet":
                parts.append(TD.tidy_flow(self.after_flowsheet_sel(raw)))
            elif source == "medications":
                parts.append(TD.tidy_meds(self.after_medications_sel(raw)))
        df = reduce(lambda a, b: a.unionByName(b), parts)
        if len(parts) > 1:  # JOIN-06: encounters present in all components
            keep = reduce(lambda a, b: a.join(b, "encounter_id", "left_semi"),
                          [p.select("encounter_id").distinct() for p in parts])
            df = df.join(keep, "encounter_id", "left_semi")
        if self.RENAME:
            df = df.withColumn("name", TD.recode("name", self.RENAME))
        return df

    def selection(self, source: str, ids) -> DataFrame:
        """Rows of a source with this metric's names: out of the shared fetch if there is one, else from the source."""
        t, names = self.db.table(source), self.REQUIRES[source]
        if source not in self.shared:
            return t.sel(**{t.search_col: names, "encounter_id": ids})
        rows = self.shared[source].where(F.col(t.search_col).isin(list(names)))
        return rows if ids is self.encounter_id else filter_isin(rows, encounter_id=ids)

    def db_sample(self, n: int, seed: int = 42) -> DataFrame:
        """SMP-01: all fetched rows of ``n`` encounters chosen by a seeded hash."""
        return SM.sample_ids(self.db_fetch(), n, seed)

    def components(self, sample=None, reread: bool = True) -> DataFrame:
        """Fetched signals. Where later steps read them several times (targets, references, grid) they are
        written once to the shared checkpoint folder; ``reread=False`` leaves them lazy."""
        c = self.db_sample(sample) if isinstance(sample, int) else self.db_fetch(encounter_id=sample)
        return materialize(c) if reread else c

    def compute(self, sample=None, with_components: bool = False) -> DataFrame:
        raise NotImplementedError

    def flag_out_of_range(self, df: DataFrame, name_col: str = "name", value_col: str = "value") -> DataFrame:
        """MET-12: flag values outside the metric's plausible limits."""
        flag = F.lit(False)
        for n, (lo, hi) in self.limits.items():
            flag = F.when((F.col(name_col) == n) & ~F.col(value_col).between(lo, hi), True).otherwise(flag)
        return df.withColumn("out_of_range", flag)


# --- MET-03 ------------------------------------------------------------------------------------------
def o2_content_at(targets: DataFrame, hgb: DataFrame, po2: DataFrame, label: str) -> DataFrame:
    """Oxygen content at each saturation row: haemoglobin and PO2 interpolated to its time
    (as-of join); no PO2 counts as 0, no haemoglobin gives null."""
    t = targets.select("encounter_id", "time_s", F.col("value").alias("_sat"))
    p = TS.asof_interpolate(t, {"_h": hgb, "_p": po2})
    return p.select("encounter_id", "time_s", F.lit(label).alias("name"),
                    o2_content("_sat", "_h", F.coalesce(F.col("_p"), F.lit(0.0))).alias("value"))


def o2_content_on(grid: DataFrame, sat: DataFrame, hgb: DataFrame, label: str, po2: DataFrame | None = None) -> DataFrame:
    """Oxygen content at the times of ``grid`` (encounter_id, time_s): saturation too is interpolated."""
    refs = {"_sat": sat, "_h": hgb} | ({"_p": po2} if po2 is not None else {})
    p = TS.asof_interpolate(grid.select("encounter_id", "time_s"), refs)
    pressure = F.coalesce(F.col("_p"), F.lit(0.0)) if po2 is not None else F.lit(0.0)
    return p.select("encounter_id", "time_s", F.lit(label).alias("name"), o2_content("_sat", "_h", pressure).alias("value"))


def o2_contents(c: DataFrame, arterial_sat, venous_sat) -> DataFrame:
    """CaO2 and CvO2 rows in one as-of pass: both saturation kinds are targets, and
    haemoglobin, arterial and venous PO2 are three reference series of the same union."""
    kinds = F.array_compact(F.array(F.when(arterial_sat, "CaO2"), F.when(venous_sat, "CvO2")))
    t = c.where(arterial_sat | venous_sat).select("encounter_id", "time_s", F.col("value").alias("_sat"), F.explode(kinds).alias("name"))
    p = TS.asof_interpolate(t, (c, {"_h": F.col("name").isin(HGB_NAMES), "_pa": F.col("name").contains("PO2 ARTERIAL"),
                                    "_pv": F.col("name").contains("PO2 VENOUS")}))
    po2 = F.when(F.col("name") == "CaO2", F.col("_pa")).otherwise(F.col("_pv"))
    return p.select("encounter_id", "time_s", "name",
                    o2_content("_sat", "_h", F.coalesce(po2, F.lit(0.0))).alias("value"))


def _hours(t="time_s"):
    # (days * 24) as the reference computes it, so half-hour ties round the same way
    return (F.col(t) / float(DAY_S)) * 24.0


def _has(df: DataFrame, conds: dict) -> DataFrame:
    """Encounters where every condition holds on at least one row (one aggregate)."""
    g = df.groupBy("encounter_id").agg(*[F.bool_or(c).alias(a) for a, c in conds.items()])
    return g.where(reduce(lambda a, b: a & b, [F.col(a) for a in conds])).select("encounter_id")


def _long(df: DataFrame, cols, t: str = "hour") -> DataFrame:
    return TD.melt_tidy(df.select("encounter_id", t, *cols), t=t)


#: Segment width of interpolation on hour grids: one day, as on second grids.
GRID_SEGMENT_H = 24.0


def _filled(g: DataFrame, cols: list[str], forward=()) -> DataFrame:
    """``f_<col>``: the columns with interior gaps filled on the hour grid; the raw ones stay as they are."""
    for c in cols:
        g = g.withColumn(f"f_{c}", F.col(c))
    return TS.interpolate(g, [f"f_{c}" for c in cols], t="hour", forward=list(forward), seg_width=GRID_SEGMENT_H,
                          keep_places=True)


class OxygenContent(Metric):
    classname, shortname = "OxygenContent", "O2_content"
    # Required lab names.
    REQUIRES = {"labs": ["HEMOGLOBIN", "HEMOGLOBIN ARTERIAL", "HEMOGLOBIN VENOUS", "O2SAT ARTERIAL MEASURED",
                         "PO2 ARTERIAL", "O2SAT VENOUS MEASURED", "PO2 VENOUS"]}

    def compute(self, sample=None, with_components: bool = False) -> DataFrame:
        """MET-04: CaO2 / CvO2 per whole hour, hours re-based on each encounter's first."""
        c = self.components(sample)
        out = o2_contents(c, F.col("name").contains("O2SAT ARTERIAL"), F.col("name").contains("O2SAT VENOUS"))
        out = out.where(F.col("value").isNotNull())
        out = out.withColumn("hour", F.bround(_hours(), 0).cast("bigint"))
        out = TS.rebase(out, "hour")
        return TD.pivot_tidy(out, ["CaO2", "CvO2"], t="hour")


class OxygenDelivery(Metric):
    classname, shortname = "OxygenDelivery", "DO2"
    # Units, plausible limits and normal ranges.
    units = {"CCI": "L/min/m^2", "CCO": "L/min", "DO2": "mL/min", "DO2_I": "mL/min/m^2", "CaO2": "mL/dL"}
    limits = {"CCI": (0, 20), "DO2_I": (0, 2500)}
    normal_range = {"DO2_I": (550, 650), "CCI": (2.5, 3.6)}
    REQUIRES = {"labs": ["HEMOGLOBIN", "HEMOGLOBIN ARTERIAL", "HEMOGLOBIN VENOUS", "O2 SAT ARTERIAL POC",
                         "O2SAT ARTERIAL MEASURED", "PO2 ARTERIAL"],
                "flowsheet": ["CARDIAC OUTPUT", "CCO", "CCI"]}
    RENAME = {"CARDIAC OUTPUT": "CCO", "O2 SAT ARTERIAL POC": "O2SAT ARTERIAL POC"}

    def get_components(self, sample=None) -> DataFrame:
        """Grid on 0.1 h: mean CCO, CCI and CaO2 per (encounter, hour)."""
        c = self.components(sample)
        ca = o2_contents(c, F.col("name").contains("O2SAT ARTERIAL"), F.lit(False))
        co = c.where(F.col("name").isin("CCO", "CCI"))
        rows = ca.unionByName(co)
        keep = _has(rows, {"_cc": F.col("name").contains("CC"), "_ca": F.col("name") == "CaO2"})
        rows = rows.join(keep, "encounter_id", "left_semi").where(F.col("value").isNotNull())
        rows = rows.withColumn("hour", F.bround(_hours(), 1))
        return materialize(TD.pivot_tidy(rows, ["CCO", "CCI", "CaO2"], t="hour"))

    def compute(self, sample=None, with_components: bool = False) -> DataFrame:
        """MET-05: DO2 = 10 * CCO * CaO2 and DO2_I = 10 * CCI * CaO2, long form."""
        g = self.get_components(sample)
        g = _filled(g, ["CCO", "CCI", "CaO2"], forward=["f_CaO2"])  # rows stay dealt out for the fill of the products
        g = g.withColumn("DO2", 10 * F.col("f_CCO") * F.col("f_CaO2")).withColumn("DO2_I", 10 * F.col("f_CCI") * F.col("f_CaO2"))
        g = TS.refill(g, ["DO2", "DO2_I"], forward=True)
        cols = ["CCO", "CCI", "CaO2", "DO2", "DO2_I"] if with_components else ["DO2", "DO2_I"]
        return _long(g, cols).withColumn("time_s", F.round(F.col("hour") * HOUR_S).cast("bigint"))


class OxygenConsumption(Metric):
    classname, shortname = "OxygenConsumption", "VO2"
    REQUIRES = {"labs": ["HEMOGLOBIN", "HEMOGLOBIN ARTERIAL", "HEMOGLOBIN VENOUS", "O2SAT ARTERIAL MEASURED",
                         "PO2 ARTERIAL", "O2SAT VENOUS MEASURED", "PO2 VENOUS"],
                "flowsheet": ["CARDIAC OUTPUT", "CCO", "CCI", "SCVO2 (%)", "SVO2 (%)"]}
    RENAME = {"CARDIAC OUTPUT": "CCO"}

    def prep(self, sample=None) -> DataFrame:
        c = self.components(sample)
        o2 = o2_contents(c, F.col("name").contains("O2SAT ARTERIAL"), F.col("name").isin("O2SAT VENOUS MEASURED", "SVO2 (%)"))
        rows = o2.unionByName(c.where(F.col("name").isin("CCO", "CCI")))
        keep = _has(rows, {"_cc": F.col("name").contains("CC"), "_ca": F.col("name") == "CaO2",
                           "_cv": F.col("name") == "CvO2"})
        rows = rows.join(keep, "encounter_id", "left_semi").where(F.col("value").isNotNull())
        rows = rows.withColumn("hour", F.bround(_hours(), 0).cast("bigint"))
        return materialize(TD.pivot_tidy(rows, ["CCO", "CCI", "CaO2", "CvO2"], t="hour"))

    def compute(self, sample=None, with_components: bool = False) -> DataFrame:
        """MET-06: VO2 = 10 * CCO * (CaO2 - CvO2), VO2_I with CCI, 1 h grid."""
        g = _filled(self.prep(sample), ["CCO", "CCI", "CaO2", "CvO2"])
        cd = F.col("f_CaO2") - F.col("f_CvO2")
        g = g.withColumn("VO2", 10 * F.col("f_CCO") * cd).withColumn("VO2_I", 10 * F.col("f_CCI") * cd)
        g = TS.refill(g, ["VO2", "VO2_I"], forward=True)
        cols = ["CCO", "CCI", "CaO2", "CvO2", "VO2", "VO2_I"] if with_components else ["VO2", "VO2_I"]
        return _long(g, cols).withColumn("time_s", (F.col("hour") * HOUR_S).cast("bigint"))


class CardiacPower(Metric):
    classname, shortname = "CardiacPower", "CPO"
    limits = {"CVP": (0, 27.12)}
    REQUIRES = {"flowsheet": ["A-LINE MAP ", "A-LINE 2 MAP ", "CVP (MMHG)", "CCO", "CARDIAC OUTPUT"]}
    RENAME = {"CARDIAC OUTPUT": "CCO", "A-LINE MAP ": "A-LINE MAP", "A-LINE 2 MAP ": "A-LINE MAP", "CVP (MMHG)": "CVP"}
    GRID = ["A-LINE MAP", "CVP", "CCO"]

    def prep(self, sample=None) -> DataFrame:
        """Renamed signals on their own time grid; CVP above its upper limit dropped (FIL-07)."""
        c = self.components(sample, reread=False)
        c = c.where((F.col("name") != "CVP") | (F.col("value") <= self.limits["CVP"][1]))
        return TD.pivot_tidy(c, self.GRID)

    def compute(self, sample=None, with_components: bool = False) -> DataFrame:
        """MET-07: (MAP - CVP) * CCO / 451, MAP and CVP interior-filled, result interior-filled."""
        g = self.prep(sample).withColumn("f_map", F.col("`A-LINE MAP`")).withColumn("f_cvp", F.col("CVP"))
        g = TS.interpolate(g, ["f_map", "f_cvp"], keep_places=True)
        g = g.withColumn("Cardiac Power", (F.col("f_map") - F.col("f_cvp")) * F.col("CCO") / 451.0)
        g = TS.refill(g, ["Cardiac Power"]).drop("f_map", "f_cvp")
        if with_components:
            return g
        return g.select("encounter_id", "time_s", F.col("`Cardiac Power`").alias("value"),
                        F.lit("Cardiac Power").alias("name"))


class VentricularStrokeWorkIndex(CardiacPower):
    classname, shortname = "VentricularStrokeWorkIndex", "VSWi"
    REQUIRES = {"flowsheet": ["A-LINE MAP ", "A-LINE 2 MAP ", "CVP (MMHG)", "PULSE", "CCI", "CARDIAC OUTPUT",
                              "LVSWI", "RVSWI", "PAP (MEAN)"]}
    GRID = ["A-LINE MAP", "CVP", "PULSE", "CCI", "CCO", "LVSWI", "RVSWI", "PAP (MEAN)"]

    def compute(self, sample=None, with_components: bool = False) -> DataFrame:
        """MET-08: (PAP mean - CVP) * CCI / PULSE; PAP, CCI, PULSE interior-filled, CVP not."""
        g = self.prep(sample).withColumnRenamed("RVSWI", "_rvswi_in")
        f = TS.interpolate(g.select("encounter_id", "time_s", "CCI", "PULSE", "`PAP (MEAN)`", "CVP")
                           .withColumnsRenamed({"CCI": "_cci", "PULSE": "_pulse", "PAP (MEAN)": "_pap"}),
                           ["_cci", "_pulse", "_pap"], keep_places=True)
        f = f.withColumn("SVi", safe_div("_cci", "_pulse")).withColumn("RVSWI", (F.col("_pap") - F.col("CVP")) * F.col("SVi"))
        f = TS.refill(f.select("encounter_id", "time_s", "SVi", "RVSWI", "_seg", "_pos"), ["RVSWI"])
        if with_components:
            return g.join(f, ["encounter_id", "time_s"], "left")
        return f.select("encounter_id", "time_s", F.col("RVSWI").alias("value"), F.lit("RVSWI").alias("name"))


class Pulsatility(Metric):
    classname, shortname = "Pulsatility", "Pulsatility"
    REQUIRES = {"flowsheet": ["BP"]}

    def after_flowsheet_sel(self, df: DataFrame) -> DataFrame:
        """PRJ-13: each ``SBP/DBP`` reading becomes an SBP row and a DBP row."""
        df = df.where(F.col("flowsheet_value").contains("/"))
        parts = F.array(
            F.struct(F.lit("SBP").alias("display_name"), F.split_part("flowsheet_value", F.lit("/"), F.lit(1)).alias("flowsheet_value")),
            F.struct(F.lit("DBP").alias("display_name"), F.split_part("flowsheet_value", F.lit("/"), F.lit(2)).alias("flowsheet_value")))
        keep = [c for c in df.columns if c not in ("display_name", "flowsheet_value")]
        return df.select(*keep, F.inline(parts))

    def compute(self, sample=None, with_components: bool = False) -> DataFrame:
        """MET-09: SBP - DBP per reading time."""
        g = TD.pivot_tidy(self.components(sample, reread=False), ["SBP", "DBP"]).withColumn("pulsatility", F.col("SBP") - F.col("DBP"))
        if with_components:
            return g
        return g.select("encounter_id", "time_s", F.col("pulsatility").alias("value"))


class Outcome(Metric):
    """A per-encounter outcome: like a metric, plus a code -> description map (UDF-03)."""

    CODE_DESCRIPTION: dict = {}


class PostOpAKI(Outcome):
    """CL-06: kidney-injury stage from the fetched creatinine, aligned on the cohort's offsets."""

    classname, shortname = "PostOpAKI", "AKI"
    REQUIRES = {"labs": ["CREATININE SERUM"]}

    def __init__(self, db, encounter_id=None, offset: DataFrame | None = None):
        super().__init__(db, encounter_id)
        self.offset = offset

    @property
    def CODE_DESCRIPTION(self):  # noqa: N802
        from wardlens.functions.codesets import AKI_LABELS
        return AKI_LABELS

    def compute(self, sample=None, with_components: bool = False) -> DataFrame:
        from wardlens.plans.cohort import align
        from wardlens.plans.variables import aki_stage
        c = self.db_fetch() if sample is None else self.components(sample)
        c = c.where(F.col("value").between(0.2, 25))
        return aki_stage(align(c, self.offset))


# Blood-gas lab names of the binned table.
BLOOD_GAS_LABS = ["O2SAT ARTERIAL MEASURED", "PO2 ARTERIAL", "O2SAT VENOUS MEASURED", "PO2 VENOUS"]


def blood_gas_bins(co, names=BLOOD_GAS_LABS, freq_h: int = 8) -> DataFrame:
    """MET-10: gas labs per encounter on right-closed ``freq_h`` bins of re-based hours, mean per bin."""
    g = co.labs(list(names)).withColumn("hour", F.bround(_hours(), 0).cast("bigint"))
    g = TS.rebase(g, "hour", out="rhour")
    g = TD.cut_right_closed(g, "rhour", float(freq_h), -1.0, out="rhour_b").withColumn("rhour_b", F.col("rhour_b").cast("bigint"))
    return TD.pivot_tidy(g, list(names), t="rhour_b")


def metric_report(co, frames, on: str = "q12h", lo: int | None = None, hi: int | None = None) -> DataFrame:
    """MET-11: align metrics on the procedure day, union, rebin, join the outcome, mean per
    (death, encounter, bin, name). All bins are kept unless ``lo`` or ``hi`` is given."""
    al = [co.align_metric(f.select("encounter_id", "time_s", "name", "value")) for f in frames]
    u = reduce(lambda a, b: a.unionByName(b), al)
    u = TD.rebin_time(u, on).dropna("any")
    u = u.join(co.mortality, "encounter_id", "left")
    m = u.groupBy("death", "encounter_id", "btime", "name").agg(F.avg("value").alias("value"))
    for bound, test in ((lo, F.col("btime") >= F.lit(lo)), (hi, F.col("btime") <= F.lit(hi))):
        m = m if bound is None else m.where(test)
    return m


def add_continuous_metric(co, metric_cls) -> Metric:
    """MET-02: attach a metric bound to the cohort's encounters."""
    m = metric_cls(co.db, encounter_id=co.eid)  # the very frame, by which a shared fetch knows the cohort
    if not hasattr(co, "metrics"):
        co.metrics = type("CohortMetrics", (), {"metrics": []})()
    co.metrics.metrics.append(m)
    m.__attach__(co.metrics)
    return m


class BaseExcess(Metric):
    """The measured venous base excess as a series of its own."""

    classname, shortname = "BaseExcess", "BE"
    REQUIRES = {"labs": ["BASE EXCESS VENOUS"]}

    def compute(self, sample=None, with_components: bool = False) -> DataFrame:
        return self.components(sample, reread=False)


def share_fetch(metrics: list[Metric]) -> None:
    """MET-01: one selection per source for all metrics of a cohort, written once and masked by each metric.

    Metrics must be bound to the same encounters. The rows are sorted by name within their files, so that a metric's mask
    skips the row groups of other names.
    """
    if len({id(m.encounter_id) for m in metrics}) > 1:
        raise ValueError("metrics of one fetch need the same encounters")
    names: dict[str, list[str]] = {}
    for m in metrics:
        for source, wanted in m.REQUIRES.items():
            names.setdefault(source, []).extend(wanted)
    shared = {}
    for source, wanted in names.items():
        t = metrics[0].db.table(source)
        rows = t.sel(**{t.search_col: list(dict.fromkeys(wanted)), "encounter_id": metrics[0].encounter_id})
        shared[source] = materialize(rows.sortWithinPartitions(t.search_col))
    for m in metrics:
        m.shared = shared


def compute_metrics(co, sample=None, shared: bool = True) -> dict[str, DataFrame]:
    """MET-02: the result of every metric attached to the cohort, by class name, in the order of attaching.

    Each source is read once for all of them; ``shared=False`` lets every metric fetch for itself.
    """
    metrics = co.metrics.metrics
    if shared and len(metrics) > 1:
        share_fetch(metrics)
    return {m.classname: m.compute(sample) for m in metrics}
