"""Code sets as a table: every set of a patient's diagnoses in one scan, by a join on code prefixes.

A row of the table is (set_name, code, match): ``exact`` codes and ``prefix`` ones. A diagnosis meets a row if one of its leading parts, cut
at the lengths that occur in the table, equals the row's code. So sets of any number and size are one equality join, and
no predicate grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions.codesets import code_sets

#: Longest code that is looked for; ICD-10-CM codes with their dot have at most 8 characters.
MAX_CODE = 64


def code_lengths(sets: DataFrame) -> list[int]:
    """The distinct lengths of the table's codes: at most ``MAX_CODE`` numbers, whatever the table's size."""
    found = sorted(r[0] for r in sets.select(F.length("code").alias("n")).where("n > 0").distinct().collect())
    if found and found[-1] > MAX_CODE:
        raise ValueError(f"codes of more than {MAX_CODE} characters")
    return found


def match_codes(rows: DataFrame, sets: DataFrame, column: str = "Code", keys: tuple[str, ...] = ("person_id",)) -> DataFrame:
    """Distinct (keys, set_name): the sets that any of a key's codes belongs to.

    ``rows`` are first reduced to distinct (keys, code), so repeated diagnoses of one person move once. Empty and
    null codes match nothing; the comparison is case-sensitive; an empty table of sets gives no rows.
    """
    lengths = code_lengths(sets)
    code = rows.where(F.col(column) != "").select(*keys, F.col(column).alias("_full")).distinct()
    size = F.length("_full")
    parts = F.array(*[F.when(size >= n, F.left("_full", F.lit(n))) for n in lengths]) if lengths else F.array().cast("array<string>")
    parts = code.select(*keys, size.alias("_size"), F.explode(F.array_compact(parts)).alias("_part"))
    wanted = sets.select("set_name", F.col("code").alias("_part"), F.col("match").alias("_match")).distinct()
    hit = parts.join(wanted, "_part").where((F.col("_match") == "prefix") | (F.length("_part") == F.col("_size")))
    return hit.select(*keys, "set_name").distinct()


def comorbidity_all(co, sets: DataFrame | None = None, code_type: str | None = None) -> DataFrame:
    """CL-26 for all sets: one row per (encounter, set) with the flag 0 or 1, from one scan of the diagnoses.

    ``sets`` defaults to the library's diagnosis sets; any user table (set_name, code, match) can be given.
    """
    table = code_sets(co.db.spark).where(F.col("kind") == "diagnosis").drop("kind") if sets is None else sets
    dx = co.db.diagnosis.sel(CodeType=[code_type + "-CM"] if code_type else None)
    met = match_codes(dx, table).withColumn("flag", F.lit(1))
    people = co.encounter_info.select("encounter_id", "person_id").distinct()
    # The names of the sets ride along as one array, so no pairs of encounters and sets are joined.
    names = F.lit(sorted(r[0] for r in table.select("set_name").distinct().collect()))
    each = people.select("encounter_id", "person_id", F.explode(names.cast("array<string>")).alias("set_name"))
    return each.join(met, ["person_id", "set_name"], "left").groupBy("encounter_id", "set_name").agg(F.max(F.coalesce("flag", F.lit(0))).alias("flag"))


def name_group_counts(table, sets: DataFrame, key: str = "encounter_id", **filters) -> DataFrame:
    """(key, set_name, rows, names): rows of a clinical table per group of names, and how many names of the group occur.

    Names are compared in upper case; a name in several groups counts in each. Rows are counted per name first, so that the
    join moves one row per key and name.
    """
    c = table.search_col
    per_name = table.sel(**filters).groupBy(key, F.col(c).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    wanted = sets.select("set_name", F.upper("code").alias("code")).distinct()
    return per_name.join(wanted, "code").groupBy(key, "set_name").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("names"))
