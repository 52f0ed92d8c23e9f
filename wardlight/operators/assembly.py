"""Wide encounter rows from the normalised clinical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.operators.ordered import PatientOrder
from wardlight.session import collect_bounded

# Every test name becomes a column; more than this is an error, never a cut: take the map form.
MAX_TESTS = 2_000


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, right_row: str,
          columns: list[str], left_row: str, max_rows: int | None = None) -> DataFrame:
    """For each left row, the latest right row of its key at or before its time.

    Both sides are stacked and forward-filled in time order; a right row at the
    same instant counts, and the highest ``right_row`` wins among equals. Row
    ids may be of any type that has an order; the two sides' ids may differ in
    type. Only ids and times go through the windows, the left row is joined
    back by its id, which has to be unique.
    """
    held = F.struct(*[F.col(c) for c in columns])
    left_kind, right_kind = left.schema[left_row].dataType, right.schema[right_row].dataType
    # right rows first at an instant, then by id: fields of a struct compare in turn
    seq = lambda side, l, r: F.struct(
        F.lit(side).alias("side"), l.cast(left_kind).alias("l"), r.cast(right_kind).alias("r")).alias("_seq")
    nothing = F.lit(None)
    stacked = left.select(
        F.col(key), F.col(left_time).cast("timestamp").alias("_at"), seq(1, F.col(left_row), nothing),
    ).unionByName(right.select(
        F.col(key), F.col(right_time).cast("timestamp").alias("_at"), seq(0, nothing, F.col(right_row)),
        held.alias("_r")), allowMissingColumns=True)
    order = PatientOrder(stacked, key=key, time="_at", row="_seq", max_rows=max_rows)
    filled = order.last_known(["_r"], ["_found"]).df.where("_seq.side = 1").select(
        F.col("_seq.l").alias(left_row), *[F.col("_found")[c].alias(c) for c in columns])
    return left.join(filled, left_row, "left").select(*left.columns, *columns)


def assemble(encounters: DataFrame, patients: DataFrame, vitals: DataFrame | None = None,
             lab_results: DataFrame | None = None, comorbidities: DataFrame | None = None,
             medications: DataFrame | None = None, environment: DataFrame | None = None,
             lab_names: list[str] | None = None, lab_map: str | None = None) -> DataFrame:
    """Join the normalised tables on their keys; lists hold active entries only.

    Child tables are reduced to one row per parent before they are joined, so
    the encounter side is shuffled once per key and never multiplied. Lab tests
    become a column each, or with ``lab_map`` one column of that name that maps
    test names to values and has no bound on the names.
    """
    out = encounters.join(patients, "patient_id", "left")
    if vitals is not None:
        out = out.join(vitals, "encounter_id", "left")
    if lab_results is not None and lab_map:
        best = (lab_results.where("test_name IS NOT NULL").groupBy("encounter_id", "test_name")
                .agg(F.max("result_value").alias("_v")))
        out = out.join(best.groupBy("encounter_id").agg(F.map_from_entries(F.array_sort(F.collect_list(
            F.struct("test_name", "_v")))).alias(lab_map)), "encounter_id", "left")
    elif lab_results is not None:
        names = lab_names or sorted(
            r[0] for r in collect_bounded(lab_results.select("test_name").distinct(), MAX_TESTS) if r[0] is not None)
        wide = lab_results.groupBy("encounter_id").pivot("test_name", names).agg(F.max("result_value"))
        out = out.join(wide, "encounter_id", "left")
    for table, name in ((comorbidities, "comorbidities"), (medications, "current_medications")):
        if table is not None:
            lists = (table.where("is_active").groupBy("patient_id")
                     .agg(F.array_sort(F.collect_set("name")).alias(name)))
            out = out.join(lists, "patient_id", "left")
    if environment is not None:
        out = out.join(environment, "encounter_id", "left")
    return out
