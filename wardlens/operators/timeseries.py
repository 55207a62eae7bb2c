"""Order-dependent per-encounter operators (WIN-01..04, JOIN-08, AGG-17..19).

Skew: one encounter may hold a large share of all rows, so no operator here runs a window
over a whole encounter. Rows are cut into (encounter, time segment) pieces; windows run per
piece, and a small per-piece summary (one row per encounter-segment) carries values, counts
and end points across pieces. Per-encounter totals are grouped aggregates (map-side
partial aggregation) joined back, never windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from wardlens.functions.scalar import DAY_S
from wardlens.session import materialize

SEGMENT_S = DAY_S  # default piece width: one day of a stay


def _seg(df: DataFrame, t: str, seg_width: float) -> DataFrame:
    return df.withColumn("_seg", F.floor(F.col(t) / F.lit(float(seg_width))).cast("bigint"))


def _scan(d: DataFrame, keys: list[str], t: str, cols: list[str], positional: bool, dealt: bool = False, totals: bool = False) -> DataFrame:
    """One pass over (key, segment) pieces plus one small summary join.

    For each column ``c`` adds ``c__pv``/``c__pp`` (last non-null value at or before the
    row and its position) and ``c__nv``/``c__np`` (first non-null at or after). Positions
    are ``t`` or, when ``positional``, the 1-based row number within the key (``_pos``).
    ``totals`` adds ``c__lo``/``c__hi``/``c__n``, the smallest and largest value of the key and how many it has.
    Needs ``_seg``; ``dealt`` says that an earlier scan has dealt the rows out by key and segment.
    """
    part = [*keys, "_seg"]
    # An input dealt out by the key alone would satisfy the windows below and keep a hot key in one task.
    d = d if dealt else d.repartition(*part)
    if positional:
        d = d.withColumn("_rn", F.row_number().over(W.partitionBy(*part).orderBy(t)))
        pos = F.col("_rn")
        frame = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)
        wf = frame(W.partitionBy(*part).orderBy(F.col(t).asc()))
        wb = frame(W.partitionBy(*part).orderBy(F.col(t).desc()))
    else:
        pos = F.col(t)
        wf = W.partitionBy(*part).orderBy(F.col(t).asc()).rangeBetween(W.unboundedPreceding, W.currentRow)
        wb = W.partitionBy(*part).orderBy(F.col(t).desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    aggs = [F.count(F.lit(1)).alias("_n")] if positional else []
    at = {c: F.when(F.col(c).isNotNull(), pos) for c in cols}
    # All columns of one direction in one step, so that they share one window and one sort.
    for w, v, p in ((wf, "pv", "pp"), (wb, "nv", "np")):
        d = d.withColumns({f"{c}__{v}": F.last(c, True).over(w) for c in cols} | {f"{c}__{p}": F.last(at[c], True).over(w) for c in cols})
    for c in cols:
        aggs += [F.max_by(c, at[c]).alias(f"{c}__lv"), F.max(at[c]).alias(f"{c}__lp"),
                 F.min_by(c, at[c]).alias(f"{c}__fv"), F.min(at[c]).alias(f"{c}__fp")]
        aggs += [F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"), F.count(c).alias(f"{c}__n")] if totals else []
    summary = d.groupBy(*part).agg(*aggs)
    sf = W.partitionBy(*keys).orderBy(F.col("_seg").asc()).rowsBetween(W.unboundedPreceding, -1)
    sb = W.partitionBy(*keys).orderBy(F.col("_seg").desc()).rowsBetween(W.unboundedPreceding, -1)
    if positional:  # rows before this piece, so local positions become positions in the key
        summary = summary.withColumn("_off", F.coalesce(F.sum("_n").over(sf), F.lit(0)))
        for c in cols:
            summary = (summary.withColumn(f"{c}__lp", F.col(f"{c}__lp") + F.col("_off"))
                              .withColumn(f"{c}__fp", F.col(f"{c}__fp") + F.col("_off")))
    carry = [*part] + (["_off"] if positional else [])
    whole = W.partitionBy(*keys)
    for c in cols if totals else []:
        carry += [F.min(f"{c}__lo").over(whole).alias(f"{c}__lo"), F.max(f"{c}__hi").over(whole).alias(f"{c}__hi"), F.sum(f"{c}__n").over(whole).alias(f"{c}__n")]
    for c in cols:
        carry += [F.last(f"{c}__lv", True).over(sf).alias(f"{c}__cpv"), F.last(f"{c}__lp", True).over(sf).alias(f"{c}__cpp"),
                  F.last(f"{c}__fv", True).over(sb).alias(f"{c}__cnv"), F.last(f"{c}__fp", True).over(sb).alias(f"{c}__cnp")]
    d = d.join(summary.select(*carry), part, "left")
    shift = F.col("_off") if positional else F.lit(0)
    for c in cols:
        has_p, has_n = F.col(f"{c}__pp").isNotNull(), F.col(f"{c}__np").isNotNull()
        d = (d.withColumn(f"{c}__pv", F.when(has_p, F.col(f"{c}__pv")).otherwise(F.col(f"{c}__cpv")))
              .withColumn(f"{c}__pp", F.when(has_p, F.col(f"{c}__pp") + shift).otherwise(F.col(f"{c}__cpp")))
              .withColumn(f"{c}__nv", F.when(has_n, F.col(f"{c}__nv")).otherwise(F.col(f"{c}__cnv")))
              .withColumn(f"{c}__np", F.when(has_n, F.col(f"{c}__np") + shift).otherwise(F.col(f"{c}__cnp")))
              .drop(f"{c}__cpv", f"{c}__cpp", f"{c}__cnv", f"{c}__cnp"))
    if positional:
        d = d.withColumn("_pos", F.col("_rn") + F.col("_off")).drop("_rn", "_off")
    return d


def _blend(c: str, x) -> F.Column:
    pv, pp, nv, np_ = (F.col(f"{c}__{s}") for s in ("pv", "pp", "nv", "np"))
    lin = F.when(np_ == pp, pv).otherwise(pv + (nv - pv) * (x - pp) / (np_ - pp))
    return F.when(F.col(c).isNotNull(), F.col(c)).when(pp.isNotNull() & np_.isNotNull(), lin)


def interpolate(df: DataFrame, cols, t: str = "time_s", key: str = "encounter_id", forward=False,
                by: str = "position", seg_width: float = SEGMENT_S, keep_places: bool = False) -> DataFrame:
    """WIN-01/02: linear fill of interior gaps per encounter, in row order (``by='position'``,
    pandas' default) or by time (``by='time'``). ``forward`` (True, or the columns it applies
    to) also carries the last value to the tail; leading gaps stay null. Never crosses
    encounters. All columns are filled in one pass. ``keep_places`` leaves each row's segment and position
    for a further fill of the same rows by ``refill``.
    """
    d = _seg(df, t, seg_width)
    cols = [cols] if isinstance(cols, str) else list(cols)
    positional = by == "position"
    d = _filled_in(_scan(d, [key], t, cols, positional), cols, "_pos" if positional else t, forward)
    if keep_places:
        return d if positional else d.withColumn("_pos", F.col(t))
    return d.drop("_seg", "_pos")


def refill(d: DataFrame, cols: list[str], key: str = "encounter_id", forward=False) -> DataFrame:
    """A second fill of rows that ``interpolate(..., keep_places=True)`` returned: they are dealt out and numbered
    already, so only the summary of the new columns is made anew."""
    return _filled_in(_scan(d, [key], "_pos", list(cols), False, dealt=True), list(cols), "_pos", forward).drop("_seg", "_pos")


def _filled_in(d: DataFrame, cols: list[str], pos: str, forward) -> DataFrame:
    fwd = set(cols) if forward is True else set(forward or ())
    for c in cols:
        v = _blend(c, F.col(pos))
        d = d.withColumn(c, F.coalesce(v, F.col(f"{c}__pv")) if c in fwd else v)
    return d.drop(*[f"{c}__{s}" for c in cols for s in ("pv", "pp", "nv", "np")])


def asof_interpolate(targets: DataFrame, reference, t: str = "time_s", key: str = "encounter_id",
                     value: str = "value", out: str = "interp", seg_width: float = SEGMENT_S) -> DataFrame:
    """JOIN-08: evaluate irregular series at each target row's time.

    ``reference`` is one DataFrame (result column ``out``), a dict ``{out: DataFrame}``, or a pair of one DataFrame and
    ``{out: condition}`` for series that are rows of the same frame, which is then read once for all of them. Linear in time between the
    neighbouring points; before the first point the series' minimum, after the last its
    maximum; a single point is a constant; no point gives null. Points at one time are averaged first.

    Points and target times meet in one aggregate by (encounter, time); one scan over its segments gives neighbours and
    totals of every series; the targets then take the values of their times.
    """
    rows = lambda df, ys: df.select(key, t, *ys)
    times = lambda n: targets.select(key, t, *[F.lit(None).cast("double").alias(f"_y{i}") for i in range(n)])
    if isinstance(reference, tuple):
        frame, conditions = reference
        outs = list(conditions)
        used = reduce(lambda a, b: a | b, conditions.values())
        points = rows(frame.where(used), [F.when(c, F.col(value)).cast("double").alias(f"_y{i}") for i, c in enumerate(conditions.values())])
    else:
        refs = reference if isinstance(reference, dict) else {out: reference}
        outs = list(refs)
        points = reduce(lambda a, b: a.unionByName(b), [
            rows(r, [(F.col(value) if i == j else F.lit(None)).cast("double").alias(f"_y{j}") for j in range(len(refs))]) for i, r in enumerate(refs.values())])
    ys = [f"_y{i}" for i in range(len(outs))]
    grid = points.unionByName(times(len(outs))).groupBy(key, t).agg(*[F.avg(y).alias(y) for y in ys])
    d = _scan(_seg(grid, t, seg_width), [key], t, ys, False, totals=True)
    found = []
    for o, y in zip(outs, ys, strict=True):
        pv, pp, nv, np_, n, lo, hi = (F.col(f"{y}__{s}") for s in ("pv", "pp", "nv", "np", "n", "lo", "hi"))
        found.append(F.when(n == 0, F.lit(None).cast("double"))
                     .when((n == 1) | pp.isNull(), lo)
                     .when(np_.isNull(), hi)
                     .when(np_ == pp, pv)
                     .otherwise(pv + (nv - pv) * (F.col(t) - pp) / (np_ - pp)).alias(o))
    return targets.join(d.select(key, t, *found), [key, t], "left").select(*targets.columns, *outs)


def rebase(df: DataFrame, col: str = "hour", key: str = "encounter_id", out: str | None = None) -> DataFrame:
    """WIN-04: subtract the encounter's minimum (aggregate + join, not a window).

    Both read the rows, which are therefore written once to the shared checkpoint folder."""
    df = materialize(df)
    m = df.groupBy(key).agg(F.min(col).alias("_min"))
    return df.join(m, key, "left").withColumn(out or col, F.col(col) - F.col("_min")).drop("_min")


def group_total(df: DataFrame, col: str, key: str = "encounter_id", out: str = "total") -> DataFrame:
    """WIN-03: group total on every row (aggregate + join)."""
    s = df.groupBy(key).agg(F.sum(F.coalesce(F.col(col), F.lit(0))).alias(out))
    return df.join(s, key, "left")


def trapezoid(df: DataFrame, x: str = "hours", y: str = "value", keys=("encounter_id", "name"),
              out: str = "auc", seg_width: float = 24.0) -> DataFrame:
    """AGG-17: area under ``y`` over ``x`` per group by the trapezoid rule; one point gives 0.

    Consecutive pairs are found per (group, x-segment); the pair that straddles a segment
    border uses the previous segment's last point from the small segment summary.
    """
    keys = list(keys)
    d = _seg(df.select(*keys, x, y), x, seg_width)
    part = [*keys, "_seg"]
    d = d.repartition(*part)  # not by the keys alone, which would keep a hot one in one task
    w = W.partitionBy(*part).orderBy(x, y)  # ties in x are ordered by y, so pairs are deterministic
    d = d.withColumn("_rn", F.row_number().over(w)).withColumn("_px", F.lag(x).over(w)).withColumn("_py", F.lag(y).over(w))
    last = d.groupBy(*part).agg(F.max_by(F.struct(x, y), F.col("_rn")).alias("_l"))
    sf = W.partitionBy(*keys).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    carry = last.select(*part, F.last("_l", True).over(sf).alias("_cl"))
    d = d.join(carry, part, "left")
    px = F.when(F.col("_rn") == 1, F.col("_cl")[x]).otherwise(F.col("_px"))
    py = F.when(F.col("_rn") == 1, F.col("_cl")[y]).otherwise(F.col("_py"))
    area = (F.col(x) - px) * (F.col(y) + py) / 2.0
    return d.groupBy(*keys).agg(F.coalesce(F.sum(area), F.lit(0.0)).alias(out))


def first_value(df: DataFrame, value: str = "value", t: str = "time_s", keys=("encounter_id",), out: str = "first_value") -> DataFrame:
    """AGG-18: value at the earliest time per group (the smallest one on a tie)."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(t, value)).alias(out))


def peak_rows(df: DataFrame, value: str = "value", keys=("encounter_id",)) -> DataFrame:
    """AGG-19: rows equal to their group's maximum, ties kept (aggregate + join)."""
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.max(value).alias("_max"))
    return df.join(m, keys, "inner").where(F.col(value) == F.col("_max")).drop("_max")
