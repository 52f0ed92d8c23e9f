"""Lab reports: field names, free text, range findings and composite features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.cleaning import Fields, body_mass_index, to_number
from wardlight.functions.numeric import add_all, clamp01
from wardlight.operators.risk import (
    HIGH_RISK, MODERATE_RISK, condition_tokens, risk_category)
from wardlight.session import compiled_methods

# Lab fields, their label and other names.
ALIASES = {
    "fastingGlucose": ["fasting glucose", "fbg", "fasting sugar"],
    "postprandialGlucose": ["postprandial glucose", "pp glucose", "ppbs", "post meal glucose"],
    "hba1c": ["hba1c", "a1c", "glycated hemoglobin"],
    "hemoglobin": ["hemoglobin", "hb"],
    "wbcCount": ["wbc count", "white blood cell count", "wbc"],
    "plateletCount": ["platelet count", "platelets", "plt"],
    "ldl": ["ldl", "ldl cholesterol"],
    "hdl": ["hdl", "hdl cholesterol"],
    "triglycerides": ["triglycerides", "tg"],
    "ast": ["ast", "sgot"],
    "alt": ["alt", "sgpt"],
    "bilirubin": ["bilirubin", "total bilirubin"],
    "albumin": ["albumin"],
    "creatinine": ["creatinine", "serum creatinine", "scr"],
    "urea": ["urea", "blood urea nitrogen", "bun"],
    "egfr": ["egfr", "gfr"],
    "sodium": ["sodium", "na"],
    "potassium": ["potassium", "k"],
    "chloride": ["chloride", "cl"],
    "bicarbonate": ["bicarbonate", "co2", "hco3"],
}
# Usual range per field; None is open.
RANGES = {
    "fastingGlucose": (70.0, 99.0), "postprandialGlucose": (0.0, 140.0), "hba1c": (4.0, 5.6),
    "hemoglobin": (12.0, 17.5), "wbcCount": (4.0, 11.0), "plateletCount": (150.0, 450.0),
    "ldl": (0.0, 100.0), "hdl": (40.0, None), "triglycerides": (0.0, 150.0), "ast": (10.0, 40.0),
    "alt": (7.0, 56.0), "bilirubin": (0.1, 1.2), "albumin": (3.5, 5.0), "creatinine": (0.6, 1.3),
    "urea": (7.0, 20.0), "egfr": (90.0, None), "sodium": (135.0, 145.0), "potassium": (3.5, 5.1),
    "chloride": (98.0, 107.0), "bicarbonate": (22.0, 29.0), "heartRate": (60.0, 100.0),
    "systolicBp": (90.0, 140.0), "diastolicBp": (60.0, 90.0), "spo2": (95.0, 100.0),
    "temperature": (36.1, 37.2), "respiratoryRate": (12.0, 20.0), "bmi": (18.5, 24.9),
}
INTAKE, LAB = "Clinical intake & vitals", "Laboratory results"
# Findings in check order (source, domain, label, field, required).
CHECKS = [
    (INTAKE, "Intake", "Age", "age", True),
    (INTAKE, "Intake", "Symptom duration", "symptomOnset", True),
    (INTAKE, "Intake", "Comorbidities", "comorbidities", True),
    (INTAKE, "Vitals", "Heart rate", "heartRate", True),
    (INTAKE, "Vitals", "Blood pressure", "systolicBp", True),
    (INTAKE, "Vitals", "SpO2", "spo2", True),
    (INTAKE, "Vitals", "Body temperature", "temperature", True),
    (INTAKE, "Vitals", "Respiratory rate", "respiratoryRate", True),
    (INTAKE, "Vitals", "Body size", "bmi", False),
    (LAB, "Blood sugar", "Fasting glucose", "fastingGlucose", True),
    (LAB, "Blood sugar", "After-meal glucose", "postprandialGlucose", True),
    (LAB, "Blood sugar", "HbA1c", "hba1c", False),
    (LAB, "Blood", "Hemoglobin", "hemoglobin", True),
    (LAB, "Blood", "White cell count", "wbcCount", False),
    (LAB, "Blood", "Platelets", "plateletCount", False),
    (LAB, "Lipids", "LDL", "ldl", False),
    (LAB, "Lipids", "HDL", "hdl", False),
    (LAB, "Lipids", "Triglycerides", "triglycerides", False),
    (LAB, "Liver", "AST", "ast", False),
    (LAB, "Liver", "ALT", "alt", False),
    (LAB, "Liver", "Bilirubin", "bilirubin", False),
    (LAB, "Kidney", "Creatinine", "creatinine", False),
    (LAB, "Kidney", "Urea", "urea", False),
    (LAB, "Kidney", "eGFR", "egfr", False),
    (LAB, "Electrolytes", "Sodium", "sodium", False),
    (LAB, "Electrolytes", "Potassium", "potassium", False),
    (LAB, "Electrolytes", "Chloride", "chloride", False),
    (LAB, "Electrolytes", "Bicarbonate", "bicarbonate", False),
]
DOMAINS = ["Vitals", "Blood sugar", "Blood", "Lipids", "Liver", "Kidney", "Electrolytes"]
MISSING_SEVERITY, ATTENTION_AT = 0.72, 0.45


# -- fields ---------------------------------------------------------------


def alias_rows() -> list[tuple[str, str]]:
    rows = []
    for name, others in ALIASES.items():
        rows += [(a, name) for a in dict.fromkeys([name.lower(), *others])]
    return rows


def resolve_fields(df: DataFrame, key: str = "key") -> DataFrame:
    """Attach the canonical field of each key; unknown keys drop out. The alias map is fixed and small."""
    aliases = df.sparkSession.createDataFrame(alias_rows(), "_alias string, field string")
    clean = df.withColumn("_alias", F.lower(F.trim(F.col(key))))
    return clean.join(F.broadcast(aliases), "_alias").drop("_alias")


def pivot_fields(df: DataFrame, by: list[str], value: str = "value", order: str | None = None) -> DataFrame:
    """One row per report with a column per lab field; the last given value wins."""
    number = to_number(F.col(value).cast("string"))
    # A value that does not parse leaves an earlier one in place.
    pick = (F.max_by(number, F.when(number.isNotNull(), F.col(order))) if order
            else F.max(number))
    return df.groupBy(*by).pivot("field", list(ALIASES)).agg(pick)


def field_pattern(field: str, word_start: bool = True) -> str:
    """Alias, an optional separator word, then a number.

    ``word_start`` keeps short names such as ``k`` from matching inside words.
    """
    lead = "(?:^|[^A-Za-z0-9_])" if word_start else ""
    names = "|".join(ALIASES[field])
    return rf"(?i){lead}(?:{names})\s*(?:[:=\-]|is|value)?\s*([-+]?\d+(?:\.\d+)?)"


def extract_fields(df: DataFrame, text: str = "text", word_start: bool = True) -> DataFrame:
    """First number per lab field in free text: one native regex per field over the whole text."""
    return df.withColumns({
        f: F.regexp_extract(F.col(text), field_pattern(f, word_start), 1).try_cast("double") for f in ALIASES})


# -- findings ---------------------------------------------------------------


def _blank(fields: Fields, name: str) -> Column:
    c = fields.get(name)
    if c is None:
        return F.lit(True)
    kind = fields.kind(name).simpleString()
    if kind.startswith("array"):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull() | (F.trim(c) == "") if kind == "string" else c.isNull()


def excursion(x: Column, low: float | None, high: float | None) -> Column:
    """How far outside the range, relative to the bound crossed; 0 inside."""
    below = (F.lit(low) - x) / max(low, 1.0) if low is not None else F.lit(0.0)
    above = (x - F.lit(high)) / max(high, 1.0) if high is not None else F.lit(0.0)
    return F.when(x.isNotNull(), clamp01(F.greatest(below, above, F.lit(0.0))))


def _plain(v: float) -> str:
    return f"{v:g}"


def _range_text(low: float | None, high: float | None) -> str:
    return f"Usually over {_plain(low)}" if high is None else f"Usually {_plain(low)} to {_plain(high)}"


def check_severities(df: DataFrame) -> DataFrame:
    """One severity column per check (``_s0`` ...), 0 where nothing is wrong.

    ``_m<i>`` marks a blank field and ``_h<i>`` a value above its range. Rows
    lacking any intake value or any lab value score 0 throughout.
    """
    compiled_methods(df.sparkSession)
    have = Fields(df)
    if have.get("bmi") is None:
        bmi = body_mass_index(have.number("weight"), have.number("height"))
        df = df.withColumn("bmi", F.round(bmi, 6))
        have = Fields(df)
    intake = ["patient_id", "age", "comorbidities", "heartRate", "systolicBp", "diastolicBp", "spo2",
              "temperature", "respiratoryRate", "weight", "height"]
    usable = (reduce(lambda a, b: a | b, [~_blank(have, c) for c in intake])
              & reduce(lambda a, b: a | b, [~_blank(have, c) for c in ALIASES]))
    first, marks, severity = {"_usable": usable}, {}, {}
    for i, (_, _, _, field, required) in enumerate(CHECKS):
        blank = _blank(have, field)
        if field == "systolicBp":
            blank = blank | _blank(have, "diastolicBp")
        size = F.lit(0.0)
        marks[f"_h{i}"] = F.lit(False)
        if field in RANGES:
            low, high = RANGES[field]
            first[f"_v{i}"] = have.number(field)
            size = F.coalesce(excursion(F.col(f"_v{i}"), low, high), F.lit(0.0))
            if high is not None:
                marks[f"_h{i}"] = F.coalesce(F.col(f"_v{i}") > high, F.lit(False))
        first[f"_m{i}"] = blank
        severity[f"_s{i}"] = F.when(~F.col("_usable"), 0.0).when(
            F.col(f"_m{i}"), MISSING_SEVERITY if required else 0.0).otherwise(size)
    out = df.withColumns(first).withColumns({**marks, **severity})
    return out.drop("_usable", *[c for c in first if c.startswith("_v")])


CHECK_SCRATCH = [f"_{k}{i}" for k in "smh" for i in range(len(CHECKS))]


def finding_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per finding, most severe first within its report.

    Each report expands to at most one row per check; ranks are array positions,
    so nothing is shuffled.
    """
    scored = check_severities(df)
    state = [F.when(F.col(f"_m{i}"), 0).when(F.col(f"_h{i}"), 1).otherwise(2) for i in range(len(CHECKS))]
    none = F.array().cast("array<struct<order:double,check:int,state:int>>")
    # Short lists joined: array_compact would have Spark interpret every entry instead of compiling it.
    listed = F.concat(*[
        F.when(F.col(f"_s{i}") > 0, F.array(F.struct((-F.col(f"_s{i}")).alias("order"), F.lit(i).alias("check"),
                                                     s.alias("state")))).otherwise(none) for i, s in enumerate(state)])
    rows = scored.select(*keys, F.sort_array(listed).alias("_f"))
    # The outer form keeps Spark from copying the whole array expression into a filter.
    rows = rows.select(*keys, F.posexplode_outer("_f").alias("_p", "_e")).where("_e IS NOT NULL")
    rows = rows.select(*keys, (F.col("_p") + 1).alias("rank"), F.col("_e.check").alias("check"),
                       (-F.col("_e.order")).alias("severity"), F.col("_e.state").alias("state"))
    texts = df.sparkSession.createDataFrame(check_texts(), (
        "check int, state int, source string, domain string, label string, note string"))
    # One row per check and state: a fixed table.
    out = rows.join(F.broadcast(texts), ["check", "state"])
    status = F.when((F.col("state") == 0) | (F.col("severity") >= ATTENTION_AT), "needs attention").otherwise("watch")
    return out.withColumn("status", status).drop("check", "state")


def check_texts() -> list[tuple]:
    rows = []
    for i, (source, domain, label, field, _) in enumerate(CHECKS):
        usual = _range_text(*RANGES[field]) if field in RANGES else ""
        notes = ["This field is still blank.", f"Higher than the usual range of {usual}.",
                 f"Lower than the usual range of {usual}."]
        rows += [(i, state, source, domain, label, note) for state, note in enumerate(notes)]
    return rows


def care_summary(df: DataFrame) -> DataFrame:
    """Domain scores, mean severity, risk band and counts per source, all per row."""
    scored = check_severities(df)

    def total(ids):
        return add_all([F.col(f"_s{i}") for i in ids])

    def hits(ids):
        return add_all([(F.col(f"_s{i}") > 0).cast("int") for i in ids])

    def mean(ids):
        n = hits(ids)
        return F.when(n > 0, total(ids) / n).otherwise(0.0)

    def ids_of(at, value):
        return [i for i, check in enumerate(CHECKS) if check[at] == value]

    everything = list(range(len(CHECKS)))
    cols = {"findings": hits(everything), "total_severity": mean(everything),
            "intake_findings": hits(ids_of(0, INTAKE)), "lab_findings": hits(ids_of(0, LAB))}
    for d in DOMAINS:
        name = d.lower().replace(" ", "_")
        cols[f"{name}_score"] = mean(ids_of(1, d))
        cols[f"{name}_count"] = hits(ids_of(1, d))
    out = scored.withColumns(cols).drop(*CHECK_SCRATCH)
    t = F.col("total_severity")
    return out.withColumn("care_risk", F.when(t >= 0.55, "High").when(t >= 0.28, "Medium").otherwise("Low"))


def heat_cells(findings: DataFrame) -> DataFrame:
    """The nine most severe findings per row with their tone; the first eight form the trend."""
    r = F.col("rank")
    tone = F.when(r <= 3, "critical").when(r <= 6, "elevated").otherwise("moderate")
    return findings.where(r <= 9).withColumns({"tone": tone, "in_trend": r <= 8})


# -- composites ---------------------------------------------------------------


def composite_features(df: DataFrame) -> DataFrame:
    """Nine clinical composites in [0, 1]; a missing input leaves its composite null."""
    have = Fields(df)
    v = {n: have.number(n) for n in [*ALIASES, "systolicBp", "diastolicBp", "spo2", "weight", "height"]}
    return df.withColumns({k: clamp01(e) for k, e in {
        "glycemic_pressure": ((v["fastingGlucose"] - 70) / 60 + (v["postprandialGlucose"] - 140) / 120
                              + (v["hba1c"] - 5.6) / 4) / 3 + 0.25,
        "glucose_gap": F.abs(v["postprandialGlucose"] - v["fastingGlucose"]) / 180,
        "blood_pressure_strain": ((v["systolicBp"] - 120) / 40 + (v["diastolicBp"] - 80) / 20) / 2 + 0.25,
        "oxygen_reserve": (100 - v["spo2"]) / 10,
        "renal_burden": ((v["creatinine"] - 0.9) / 1.5 + (v["urea"] - 20) / 40 + (90 - v["egfr"]) / 60) / 3 + 0.15,
        "electrolyte_drift": (F.abs(v["sodium"] - 140) / 10 + F.abs(v["potassium"] - 4.2) / 2
                              + F.abs(v["chloride"] - 103) / 8 + F.abs(v["bicarbonate"] - 25) / 8) / 4,
        "hematology_stress": ((14 - v["hemoglobin"]) / 4 + (v["wbcCount"] - 7) / 8
                              + (v["plateletCount"] - 250) / 250) / 3 + 0.2,
        "liver_load": ((v["ast"] - 25) / 25 + (v["alt"] - 30) / 35 + (v["bilirubin"] - 0.8) / 1.2
                       + (4.2 - v["albumin"]) / 1.2) / 4 + 0.2,
        "body_size": v["weight"] / F.when(v["height"] > 1, v["height"]).otherwise(
            F.when(v["height"].isNotNull(), F.lit(1.0))) / 2,
    }.items()})


def coded_features(df: DataFrame, sex: str = "sex", location: str = "locationType",
                   triage: str = "triagePriority", age: str = "age") -> DataFrame:
    """Ordinal codes for sex, place, triage and age band."""
    years = F.coalesce(Fields(df).number(age), F.lit(0.0))
    return df.withColumns({
        "sex_code": F.when(F.col(sex) == "Female", 1.0).when(F.col(sex) == "Male", 0.82).otherwise(0.5),
        "location_code": F.when(F.col(location) == "Clinic", 0.68).when(F.col(location) == "Home", 0.4).otherwise(0.85),
        "triage_code": F.when(F.col(triage) == "Urgent", 1.0).when(F.col(triage) == "Priority", 0.8)
        .when(F.col(triage) == "Routine", 0.45).otherwise(0.2),
        "age_code": clamp01(years / 100.0),
        "age_band": F.when(years >= 60, "senior").when(years >= 35, "adult").otherwise("young"),
    })


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """Filled and missing counts over ``fields`` and a ready / warning status."""
    have = Fields(df)
    missing = add_all([_blank(have, f).cast("int") for f in fields])
    return df.withColumns({
        "filled_count": F.lit(len(fields)) - missing, "missing_count": missing,
        "completeness_status": F.when(missing == 0, "ready").otherwise("warning")})


# Fields of each radar domain.
RADAR = {
    "diabetes": ["fastingGlucose", "postprandialGlucose", "hba1c"],
    "blood": ["hemoglobin", "wbcCount", "plateletCount"],
    "lipid": ["ldl", "hdl", "triglycerides"],
    "liver": ["ast", "alt", "bilirubin", "albumin"],
    "kidney": ["creatinine", "urea", "egfr"],
    "vitals": ["spo2", "temperature", "heartRate", "systolicBp"],
}
DEVIATION_FIELDS = [
    "postprandialGlucose", "hba1c", "hemoglobin", "wbcCount", "plateletCount", "ldl", "hdl",
    "triglycerides", "ast", "alt", "bilirubin", "albumin", "creatinine", "urea", "egfr", "sodium",
    "potassium", "chloride", "bicarbonate", "spo2", "temperature", "heartRate", "systolicBp", "diastolicBp",
]


def _deviation(have: Fields, field: str, x: Column | None = None) -> Column:
    """Excursion with missing read as 0, as the screening form does."""
    value = F.coalesce(x if x is not None else have.number(field), F.lit(0.0))
    return excursion(value, *RANGES[field])


def radar_scores(df: DataFrame) -> DataFrame:
    have = Fields(df)
    return df.withColumns({
        f"radar_{d}": clamp01(add_all([_deviation(have, f) for f in fs]) / float(len(fs))) for d, fs in RADAR.items()})


def screening_risk(df: DataFrame) -> DataFrame:
    """Alternate risk of the intake form: summed range deviations, boost, floors and limits."""
    have = Fields(df)
    v = {n: F.coalesce(have.number(n), F.lit(0.0)) for n in
         ("bloodGlucose", "fastingGlucose", "hba1c", "creatinine", "urea", "systolicBp", "spo2")}
    glucose = F.greatest(v["bloodGlucose"], v["fastingGlucose"])
    x = df.withColumn("_cond", condition_tokens(have, ("comorbidities",)))
    count = F.size("_cond")
    high = F.size(F.array_intersect("_cond", F.array(*[F.lit(t) for t in HIGH_RISK])))
    moderate = F.size(F.array_intersect("_cond", F.array(*[F.lit(t) for t in MODERATE_RISK])))
    critical = (
        ((glucose > 0) & ((glucose < 50) | (glucose > 400))) | (v["creatinine"] > 2.0) | (v["urea"] > 40.0)
        | ((v["systolicBp"] > 0) & ((v["systolicBp"] > 180) | (v["systolicBp"] < 80)))
        | ((v["spo2"] > 0) & (v["spo2"] < 90)) | (v["hba1c"] > 9.0))
    deviations = [_deviation(have, "fastingGlucose", glucose), *[_deviation(have, f) for f in DEVIATION_FIELDS]]
    base = clamp01(F.lit(0.22) + add_all(deviations) / 18.0)
    floor = F.when(count >= 8, 0.65).when(count >= 5, 0.55).when(count >= 3, 0.4).otherwise(0.0)
    floor = F.when(critical, F.greatest(floor, F.lit(0.75))).otherwise(floor)
    boost = F.least(high * 0.08 + moderate * 0.04, F.lit(0.4))
    x = x.withColumns({
        "screening_base": base, "screening_critical": critical,
        "screening_score": clamp01(F.greatest(base + boost, floor))})
    return x.withColumn("screening_level", risk_category(F.col("screening_score"))).drop("_cond")


# -- model consensus ---------------------------------------------------------------


def consensus(df: DataFrame, models: list[str]) -> DataFrame:
    """Mean, spread and dominant band of the four highest model scores per row."""
    ordered = F.sort_array(F.array(*[clamp01(F.coalesce(F.col(m), F.lit(0.0))) for m in models]), asc=False)
    top = F.slice(ordered, 1, 4)
    n = min(4, len(models))
    high = F.size(F.filter(top, lambda s: s >= 0.7))
    medium = F.size(F.filter(top, lambda s: (s >= 0.4) & (s < 0.7)))
    return df.withColumns({
        "consensus_score": F.aggregate(top, F.lit(0.0), lambda a, s: a + s) / float(n),
        "consensus_spread": top[0] - top[n - 1],
        "consensus_band": F.when(high >= 2, "High").when(medium >= 2, "Medium").otherwise("Low"),
    })


def band_averages(df: DataFrame, models: list[str]) -> DataFrame:
    """Models per band and their mean score, over the whole table."""
    long = df.select(*[F.col(m).cast("double").alias(m) for m in models]).unpivot([], models, "model", "score")
    s = clamp01(F.coalesce(F.col("score"), F.lit(0.0)))
    band = F.when(s >= 0.7, "High").when(s >= 0.4, "Medium").otherwise("Low")
    return long.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("scores"), F.avg(s).alias("mean_score"))
