"""Ingest cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.schema import LIST_NUMERIC_FEATURES, MULTI_VALUE_FEATURES, NUMERIC_FEATURES, TIME_COLUMNS

# Cell texts that mean "missing".
NULL_WORDS = ["", "none", "null", "nan"]
# Reviewer words for a true / false positive.
TRUE_WORDS = ["1", "true", "yes", "y", "tp", "true_positive"]
FALSE_WORDS = ["0", "false", "no", "n", "fp", "false_positive"]


def clean_text(c: Column) -> Column:
    """Trimmed text, null for missing-value words."""
    text = F.trim(c, F.lit(" \t\r\n"))
    return F.when(~F.lower(text).isin(NULL_WORDS), text)


def to_number(c: Column) -> Column:
    """Double, null where the text does not parse or is NaN."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def to_time(c: Column, dtype: T.DataType | None = None) -> Column:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    return c.try_cast("timestamp")


def text_list(c: Column, keep_empty: bool = False) -> Column:
    """List cell as array<string>: JSON or bracketed text, comma text, or a single value.

    Missing cells give null, or an empty array with ``keep_empty``. Null items
    and blank parts are dropped.
    """
    text = clean_text(c)
    bracketed = text.startswith("[") & text.endswith("]")
    as_json = F.from_json(text, "array<string>")
    swapped = F.from_json(
        F.regexp_replace(F.regexp_replace(text, "'", '"'), r"\bNone\b", "null"), "array<string>")
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    out = F.when(bracketed, F.coalesce(as_json, swapped, parts)).otherwise(parts)
    out = F.filter(out, lambda x: x.isNotNull())
    return F.coalesce(out, F.array().cast("array<string>")) if keep_empty else out


def number_list(c: Column, keep_empty: bool = False) -> Column:
    return F.filter(F.transform(text_list(c, keep_empty), lambda x: to_number(x)), lambda x: x.isNotNull())


def clean_frame(df: DataFrame, numeric: list[str] | None = None) -> DataFrame:
    """Header trim, null words, typed numbers, times and list cells for any encounter table."""
    names = [c.strip() for c in df.columns]
    df = df.toDF(*names)
    numeric = set(NUMERIC_FEATURES if numeric is None else numeric)
    out = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        is_text = isinstance(f.dataType, T.StringType)
        if f.name in TIME_COLUMNS:
            out[f.name] = to_time(c, f.dataType)
        elif f.name in MULTI_VALUE_FEATURES and is_text:
            out[f.name] = text_list(c)
        elif f.name in LIST_NUMERIC_FEATURES and is_text:
            out[f.name] = number_list(c)
        elif f.name in LIST_NUMERIC_FEATURES and isinstance(f.dataType, T.ArrayType):
            out[f.name] = F.filter(F.transform(c, lambda x: x.try_cast("double")), lambda x: x.isNotNull())
        elif f.name in numeric:
            out[f.name] = to_number(clean_text(c) if is_text else c)
        elif is_text:
            out[f.name] = clean_text(c)
    return df.withColumns(out)


def align(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Select the fitted columns in order; missing ones become typed nulls."""
    have = set(df.columns)
    return df.select(*[
        F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in columns.items()])


class Fields:
    """Alias look-ups against one frame; the schema is read once."""

    def __init__(self, df: DataFrame):
        self.schema = df.schema
        self.types = {f.name: f.dataType for f in self.schema.fields}

    def kind(self, name: str) -> T.DataType | None:
        if name in self.types:
            return self.types[name]
        node: T.DataType = self.schema
        for part in name.split("."):
            if not isinstance(node, T.StructType) or part not in node.names:
                return None
            node = node[part].dataType
        return node

    def get(self, name: str) -> Column | None:
        """A flat column, a literally dotted column, or a nested struct field."""
        if name in self.types:
            return F.col(f"`{name}`")
        return F.col(name) if "." in name and self.kind(name) is not None else None

    def present(self, names) -> list[str]:
        return [n for n in names if self.get(n) is not None]

    def pick(self, *names: str) -> Column | None:
        """First non-null value among the aliases present, as text when types differ."""
        found = self.present(names)
        if not found:
            return None
        cols = [self.get(n) for n in found]
        if len({self.kind(n).simpleString() for n in found}) > 1:
            cols = [c.cast("string") for c in cols]
        return F.coalesce(*cols) if len(cols) > 1 else cols[0]

    def number(self, *names: str) -> Column:
        """First alias that parses as a number."""
        found = self.present(names)
        return F.coalesce(*[self.as_number(n) for n in found]) if found else F.lit(None).cast("double")

    def as_number(self, name: str) -> Column:
        c = self.get(name)
        if isinstance(self.kind(name), (T.IntegerType, T.LongType, T.ShortType)):
            return c.cast("double")
        return to_number(c)

    def reading(self, *names: str) -> Column:
        """First non-null alias, then read as a number."""
        found = self.present(names)
        if len(found) == 1:
            return self.as_number(found[0])
        c = self.pick(*names)
        return to_number(c) if c is not None else F.lit(None).cast("double")


def feedback_label(c: Column, strict: bool = False) -> Column:
    """Reviewer verdict as 1 / 0; anything else is null, or an error when ``strict``."""
    text = F.lower(F.trim(c.cast("string")))
    number = text.try_cast("double")
    out = (F.when(text.isin(TRUE_WORDS), 1).when(text.isin(FALSE_WORDS), 0)
           .when(number.isNotNull() & ~F.isnan(number), (number != 0).cast("int")))
    if strict:
        return F.coalesce(out, F.raise_error(F.lit("feedback needs a true/false positive label")).cast("int"))
    return out


def body_mass_index(weight: Column, height_cm: Column) -> Column:
    h = height_cm / 100.0
    return F.when((weight > 0) & (h > 0), weight / (h * h))


# Allowed words per coded column.
VOCABULARY = {
    "gender": ["female", "male", "other", "prefer_not_to_say"],
    "malaria_prevalence_level": ["low", "moderate", "high", "outbreak"],
    "dengue_prevalence_level": ["low", "moderate", "high", "outbreak"],
    "location_type": ["triage", "home_visit", "clinic", "telehealth"],
    "source_type": ["manual", "device", "imported"],
    "measurement_posture": ["sitting", "standing", "lying"],
    "data_quality_flag": ["ok", "missing", "suspect", "repeat_required"],
}
POSITIVE = ["heart_rate_bpm", "systolic_bp_mmhg", "diastolic_bp_mmhg", "respiratory_rate_bpm"]
NOT_NEGATIVE = ["age_years", "visits_last_90_days", "symptom_duration_days",
                "distance_to_nearest_facility_km", "readmission_frequency"]
REQUIRED = ["patient_id", "recorded_at"]


def quality_rules(df: DataFrame) -> DataFrame:
    """List the failed rules per row and mark such rows ``suspect``; values stay as they are."""
    have = set(df.columns)
    rules: list[tuple[str, Column]] = []
    rules += [(f"{c} is required", F.col(c).isNull()) for c in REQUIRED if c in have]
    rules += [(f"{c} must be positive", F.col(c) <= 0) for c in POSITIVE if c in have]
    rules += [(f"{c} must not be negative", F.col(c) < 0) for c in NOT_NEGATIVE if c in have]
    if "spo2_percent" in have:
        rules.append(("spo2_percent must be within 0-100", (F.col("spo2_percent") < 0) | (F.col("spo2_percent") > 100)))
    if {"systolic_bp_mmhg", "diastolic_bp_mmhg"} <= have:
        rules.append(("systolic must not be below diastolic", F.col("systolic_bp_mmhg") < F.col("diastolic_bp_mmhg")))
    rules += [(f"{c} has an unknown word", ~F.lower(F.col(c)).isin(words))
              for c, words in VOCABULARY.items() if c in have]
    failed = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    out = df.withColumn("failed_rules", failed)
    suspect = F.size("failed_rules") > 0
    if "data_quality_flag" in have:
        return out.withColumn("data_quality_flag", F.when(suspect, "suspect").otherwise(F.col("data_quality_flag")))
    return out.withColumn("data_quality_flag", F.when(suspect, "suspect").otherwise("ok"))
