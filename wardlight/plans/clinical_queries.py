"""Registered queries for cleaning, clinical rules and lab reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.functions.cleaning import (
    body_mass_index, clean_text, feedback_label, quality_rules, text_list, to_number, to_time)
from wardlight.operators import labs
from wardlight.operators.risk import clinical_risk, risk_actions
from wardlight.plans.evaluation_queries import MODELS, SCORED, rounded, scored
from wardlight.session import spread
from wardlight.sources.standins import CONDITIONS, encounters, line_key, table

KEY_SQL = ", ".join(line_key())


def risk(spark, d):
    df = encounters(spark, d).withColumn("anomaly_score", F.ln("glucose_fasting_mg_dl") / 7.0)
    out = clinical_risk(df)
    return out.select(
        *line_key(), "risk_score_normalized", "risk_category", "alert_triggered",
        "critical_override_triggered", F.size("critical_override_reasons").alias("critical_reasons"),
        "comorbidity_count", "high_risk_comorbidity_count", "moderate_comorbidity_count",
        "comorbidity_boost", "risk_floor", F.size("risk_warnings").alias("warnings"),
        F.size("risk_drivers").alias("drivers"))


def action_counts(spark, d):
    df = encounters(spark, d).withColumn("anomaly_score", F.lit(0.3))
    out = risk_actions(clinical_risk(df))
    return out.groupBy("risk_level", "action_title", F.size("follow_up").alias("steps")).agg(
        F.count(F.lit(1)).alias("rows"))


def cleaned_cells(spark, d):
    """Event payloads as dirty cells: blanks, sentinels, bad numbers and list texts."""
    ev = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    raw = (F.when(k % 5 == 0, " None ").when(k % 5 == 1, "nan").when(k % 5 == 2, F.concat(F.lit(" "), k.cast("string"), F.lit(" ")))
           .when(k % 5 == 3, F.concat(F.lit("x"), k.cast("string"))).otherwise(""))
    cells = (F.when(k % 4 == 0, F.concat(F.lit('["a", "b'), k.cast("string"), F.lit('"]')))
             .when(k % 4 == 1, F.concat(F.lit("a, b,, c"), k.cast("string"))).when(k % 4 == 2, " NULL ")
             .otherwise(F.concat(F.lit("['p', 'q"), k.cast("string"), F.lit("']"))))
    stamp = F.when(k % 3 == 0, "2026-06-01T09:00:00+05:30").when(k % 3 == 1, "not a time").otherwise("2026-06-02 10:00:00")
    return ev.select(
        "event_id", clean_text(raw).alias("text"), to_number(clean_text(raw)).alias("number"),
        F.array_join(text_list(cells), "|").alias("items"),
        F.date_format(to_time(stamp), "yyyy-MM-dd HH:mm:ss").alias("stamp"))


def quality(spark, d):
    df = encounters(spark, d).withColumns({
        "age_years": F.col("systolic_bp_mmhg") - 75.0,
        "gender": F.when(F.col("sodium_mmol_l") > 150, "robot").otherwise("Female"),
        "diastolic_bp_mmhg": F.col("respiratory_rate_bpm") * 4.5,
    })
    out = quality_rules(df)
    return out.select(*line_key(), F.array_join("failed_rules", "; ").alias("failed"), "data_quality_flag")


def bmi(spark, d):
    p = table(spark, d, "part")
    return rounded(p.select("p_partkey", body_mass_index(
        F.col("p_retailprice") / 20.0, F.col("p_size").cast("double") * 4.0).alias("bmi_kg_m2")))


def reviewer_words(spark, d):
    """Reviewer verdict words made from chat roles and turns."""
    c = table(spark, d, "conversations")
    word = (F.when(F.col("turn") % 4 == 0, " TP ").when(F.col("turn") % 4 == 1, "No")
            .when(F.col("turn") % 4 == 2, F.col("role")).otherwise("1"))
    return c.groupBy(feedback_label(word).alias("feedback_label")).agg(F.count(F.lit(1)).alias("rows"))


# A name for every lab field, as a report may write it, with the separator after it and the lowest value given.
WRITTEN = [
    ("fastingGlucose", "Fasting Glucose:", 80), ("postprandialGlucose", "PPBS =", 120), ("hba1c", "HbA1c is", 5),
    ("hemoglobin", "HB", 12), ("wbcCount", "White Blood Cell Count:", 6), ("plateletCount", "PLT -", 200), ("ldl", "LDL:", 90),
    ("hdl", "hdl =", 45), ("triglycerides", "TG value", 130), ("ast", "SGOT:", 20), ("alt", "ALT", 25), ("bilirubin", "Bilirubin:", 1),
    ("albumin", "albumin:", 4), ("creatinine", "Serum Creatinine =", 1), ("urea", "BUN:", 11), ("egfr", "eGFR:", 95),
    ("sodium", "Sodium is", 138), ("potassium", "K:", 4), ("chloride", "Chloride:", 101), ("bicarbonate", "HCO3 =", 24)]


def _reported(row_id, text):
    """The text with a lab report after it: field i reads its lowest value plus (id + i) mod 10 tenths.

    A field is looked for in the whole text first; what the text itself gives stands.
    """
    lines = [F.concat(F.lit(f"{name} {low}."), F.pmod(F.col(row_id) + i, F.lit(10)).cast("string"), F.lit(" units;"))
             for i, (_, name, low) in enumerate(WRITTEN)]
    return F.concat_ws("\n", F.col(text), *lines).alias(text)


def lab_text(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return labs.extract_fields(docs.select("doc_id", _reported("doc_id", "text"))).select("doc_id", *labs.ALIASES)


def lab_pages(spark, d):
    pages = table(spark, d, "pages").select("page_id", _reported("page_id", "html"))
    return labs.extract_fields(pages, "html", word_start=False).select("page_id", *labs.ALIASES)


NAMES = ["FBG", " sgpt", "Serum Creatinine", "hb", "K", "unknown", "egfr"]


def lab_pivot(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", (F.col("l_quantity") * 2.0).alias("value"),
        F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.col("l_linenumber")).alias("key"))
    out = labs.pivot_fields(labs.resolve_fields(li), ["l_orderkey"])
    return out.select("l_orderkey", "fastingGlucose", "alt", "creatinine", "hemoglobin", "potassium", "egfr")


def lab_reports(spark, d):
    li = spread(table(spark, d, "lineitem"))
    q, price, disc, tax = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return li.select(
        *line_key(), F.when(F.col("l_linenumber") > 1, q + 20).alias("age"),
        F.lit("3 days").alias("symptomOnset"), F.lit("asthma").alias("comorbidities"),
        (q * 2 + 45).alias("heartRate"), (q * 2 + 80).alias("systolicBp"), (q + 45).alias("diastolicBp"),
        (F.lit(100.0) - disc * 100).alias("spo2"), (tax * 50 + 35).alias("temperature"),
        F.when(F.col("l_returnflag") != "N", disc * 200 + 10).alias("respiratoryRate"),
        (q + 40).alias("weight"), F.lit(165.0).alias("height"),
        (price / 500).alias("fastingGlucose"), (price / 400).alias("postprandialGlucose"),
        (tax * 100 + 3).alias("hba1c"), (F.lit(18.0) - q / 5).alias("hemoglobin"),
        F.when(F.col("l_linestatus") == "O", q / 3).alias("wbcCount"), (q * 12).alias("plateletCount"),
        (q * 4).alias("ldl"), (q * 1.5).alias("hdl"), (price / 300).alias("triglycerides"),
        (q * 1.5).alias("ast"), (q * 1.7).alias("alt"), (disc * 20).alias("bilirubin"),
        (F.lit(3.0) + disc * 25).alias("albumin"), (disc * 30).alias("creatinine"), (q / 2 + 3).alias("urea"),
        (F.lit(130.0) - q * 2).alias("egfr"), (q / 3 + 130).alias("sodium"), (tax * 40 + 3).alias("potassium"),
        (q / 2 + 90).alias("chloride"), (F.lit(33.0) - q / 4).alias("bicarbonate"))


def findings(spark, d):
    out = labs.care_summary(lab_reports(spark, d))
    cols = [c for c in out.columns if c.endswith(("_score", "_count"))]
    return rounded(out.select(*line_key(), "findings", *cols, "total_severity",
                              "care_risk", "intake_findings", "lab_findings"), keep=("l_extendedprice",), digits=8)


def finding_cells(spark, d):
    rows = labs.heat_cells(labs.finding_rows(lab_reports(spark, d), line_key()))
    return rounded(rows.groupBy("domain", "tone", "in_trend").agg(
        F.count(F.lit(1)).alias("cells"), F.avg("severity").alias("mean_severity")))


def composites(spark, d):
    out = labs.composite_features(lab_reports(spark, d))
    return rounded(out.select(*line_key(), "glycemic_pressure", "glucose_gap", "blood_pressure_strain",
                              "oxygen_reserve", "renal_burden", "electrolyte_drift", "hematology_stress",
                              "liver_load", "body_size"), keep=("l_extendedprice",), digits=9)


def screening(spark, d):
    out = labs.radar_scores(labs.screening_risk(lab_reports(spark, d)))
    return rounded(out.select(*line_key(), "screening_base", "screening_critical", "screening_score",
                              "screening_level", *[f"radar_{r}" for r in labs.RADAR]), keep=("l_extendedprice",))


def codes(spark, d):
    c = table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_nationkey") % 3 == 0, "Female").when(F.col("c_nationkey") % 3 == 1, "Male").alias("sex"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Home").when(F.col("c_mktsegment") == "MACHINERY", "Clinic").alias("locationType"),
        F.when(F.col("c_nationkey") > 15, "Urgent").when(F.col("c_nationkey") > 8, "Routine").alias("triagePriority"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 100).alias("age"))
    out = labs.completeness(labs.coded_features(c), ["sex", "locationType", "triagePriority", "age"])
    return rounded(out.select("c_custkey", "sex_code", "location_code", "triage_code", "age_code", "age_band",
                              "filled_count", "missing_count", "completeness_status"))


def model_consensus(spark, d):
    out = labs.consensus(scored(spark, d), MODELS)
    return rounded(out.select("row_id", "consensus_score", "consensus_spread", "consensus_band"), digits=9)


def model_bands(spark, d):
    return rounded(labs.band_averages(scored(spark, d), MODELS))


QUERIES = {
    "b1_b4_cleaned_cells": cleaned_cells,
    "b9_reviewer_words": reviewer_words,
    "b16_quality_rules": quality,
    "b17_bmi": bmi,
    "r1_r6_clinical_risk": risk,
    "r9_risk_actions": action_counts,
    "a15_lab_text_fields": lab_text,
    "a15_page_fields": lab_pages,
    "c9_lab_alias_pivot": lab_pivot,
    "r7_d23_range_findings": findings,
    "t8_finding_cells": finding_cells,
    "i12_composite_features": composites,
    "r8_d26_screening_risk": screening,
    "i13_i14_coded_features": codes,
    "d24_model_consensus": model_consensus,
    "d24_band_averages": model_bands,
}

# ---- SQL twins ----


def _sc(x, anchor, span, falling=False):
    away = f"({anchor} - ({x}))" if falling else f"(({x}) - {anchor})"
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest({away} / {span}, 0.0), 1.0) END)"


def _mean(items):
    total = " + ".join(f"coalesce({i}, 0.0)" for i in items)
    count = " + ".join(f"(CASE WHEN {i} IS NOT NULL THEN 1 ELSE 0 END)" for i in items)
    return f"(({total}) / nullif({count}, 0))"


ENC = f"""
enc AS (
  SELECT {KEY_SQL}, l_linenumber, 55.0 + l_quantity AS hr, 70.0 + l_quantity * 2.5 AS sbp, 50.0 + l_quantity AS dbp,
    100.0 - l_discount * 120.0 AS spo2, 36.0 + l_tax * 40.0 AS temp, 12.0 + l_discount * 150.0 AS rr,
    18.0 + l_quantity / 2.0 AS bmi, 45.0 + l_extendedprice / 270.0 AS fast,
    CASE WHEN l_linenumber > 3 THEN 60.0 + l_extendedprice / 400.0 END AS poc,
    4.5 + l_tax * 70.0 AS a1c, 17.0 - l_quantity / 6.0 AS hb, 0.5 + l_discount * 18.0 AS crea,
    5.0 + l_quantity AS bun, CASE WHEN l_returnflag <> 'N' THEN 60.0 + l_quantity * 2.0 END AS ldl,
    130.0 + l_quantity / 2.0 AS na, 3.0 + l_discount * 30.0 AS k, l_quantity / 5.0 AS visits,
    CASE WHEN l_linestatus = 'O' THEN l_discount * 10.0 END AS adherence,
    CASE WHEN l_linenumber > 1 THEN list_slice({CONDITIONS!r}, l_linenumber, l_linenumber + (l_partkey % 9) - 1) END AS cond
  FROM lineitem)"""


def _in(cond, words):
    return f"len(list_intersect({cond}, {words!r}))"


HIGH = ["ckd", "type 2 diabetes", "hypertension", "copd", "t2d", "cad"]
MOD = ["obesity", "asthma", "dyslipidemia", "depression"]


def risk_sql(anomaly):
    vit = [_sc("hr", 75.0, 45.0), _sc("sbp", 120.0, 50.0), _sc("dbp", 80.0, 30.0), _sc("spo2", 97.0, 15.0, True),
           _sc("temp", 37.0, 2.0), _sc("rr", 16.0, 10.0), _sc("bmi", 22.0, 18.0)]
    lab = [_sc("glu", 100.0, 120.0), _sc("CASE WHEN NOT low THEN a1c END", 5.7, 4.3), _sc("crea", 1.0, 1.8),
           _sc("bun", 15.0, 25.0), _sc("hb", 13.5, 5.5, True), _sc("ldl", 100.0, 100.0), _sc("na", 140.0, 12.0),
           _sc("k", 4.2, 2.0)]
    acc = [_sc("visits", 0.0, 8.0), _sc("adherence", 1.0, 1.0, True)]
    return f"""
c1 AS (SELECT *, CASE WHEN cond IS NULL THEN []::VARCHAR[] ELSE
         list_distinct(list_filter(list_transform(cond, lambda x: lower(x)), lambda x: x NOT IN ('none', 'n/a'))) END AS toks,
       coalesce(greatest(poc, fast), fast) AS glu, {anomaly} AS anom FROM enc),
c2 AS (SELECT *, len(toks) AS n, {_in("toks", HIGH)} AS hi, {_in("toks", MOD)} AS mo,
       {_in("toks", ["type 2 diabetes", "t2d"])} > 0 AND a1c < 6.0 AS low,
       coalesce(abs(poc - fast) > 50.0, false) AS conflict,
       (glu < 50 OR glu > 400)::INT + (crea > 2)::INT + (bun > 40)::INT + (sbp > 180 OR sbp < 80)::INT
       + (spo2 < 90)::INT + (a1c > 9)::INT AS crit FROM c1),
c3 AS (SELECT *, {_mean(vit)} AS v, {_mean(lab)} AS l, {_mean(acc)} AS a FROM c2),
c4 AS (SELECT *, least(greatest((0.2 * least(greatest(anom, 0), 1) + 0.35 * v + 0.3 * l + 0.15 * a) / (0.2 + 0.35 + 0.3 + 0.15), 0), 1) AS base,
       least(hi * 0.08 + mo * 0.04, 0.4) AS boost,
       greatest(CASE WHEN n >= 8 THEN 0.65 WHEN n >= 5 THEN 0.55 WHEN n >= 3 THEN 0.4 ELSE 0.0 END,
                CASE WHEN crit > 0 THEN 0.75 ELSE 0.0 END) AS floor_ FROM c3),
risk AS (SELECT *, least(greatest(floor_, least(base + boost, 1.0)), 1.0) AS final FROM c4)"""


CAT = "CASE WHEN round(final, 4) < 0.4 THEN 'Low' WHEN round(final, 4) < 0.65 THEN 'Medium' ELSE 'High' END"
FIELD_SQL = {f: labs.field_pattern(f)[4:] for f in labs.ALIASES}
LOOSE_SQL = {f: labs.field_pattern(f, False)[4:] for f in labs.ALIASES}


def _reported_sql(row_id, text):
    lines = ", ".join(f"'{name} {low}.' || ({row_id} + {i}) % 10 || ' units;'" for i, (_, name, low) in enumerate(WRITTEN))
    return f"concat_ws(chr(10), {text}, {lines})"


def _extract(patterns, column):
    return ", ".join(
        f"TRY_CAST(nullif(regexp_extract({column}, '{p}', 1, 'i'), '') AS DOUBLE) AS {f}" for f, p in patterns.items())


LAB = f"""
lab AS (
  SELECT {KEY_SQL}, CASE WHEN l_linenumber > 1 THEN l_quantity + 20 END AS age,
    l_quantity * 2 + 45 AS heartRate, l_quantity * 2 + 80 AS systolicBp, l_quantity + 45 AS diastolicBp,
    100.0 - l_discount * 100 AS spo2, l_tax * 50 + 35 AS temperature,
    CASE WHEN l_returnflag <> 'N' THEN l_discount * 200 + 10 END AS respiratoryRate,
    l_quantity + 40 AS weight, 165.0 AS height, round((l_quantity + 40) / (1.65 * 1.65), 6) AS bmi,
    l_extendedprice / 500 AS fastingGlucose, l_extendedprice / 400 AS postprandialGlucose, l_tax * 100 + 3 AS hba1c,
    18.0 - l_quantity / 5 AS hemoglobin, CASE WHEN l_linestatus = 'O' THEN l_quantity / 3 END AS wbcCount,
    l_quantity * 12 AS plateletCount, l_quantity * 4 AS ldl, l_quantity * 1.5 AS hdl, l_extendedprice / 300 AS triglycerides,
    l_quantity * 1.5 AS ast, l_quantity * 1.7 AS alt, l_discount * 20 AS bilirubin, 3.0 + l_discount * 25 AS albumin,
    l_discount * 30 AS creatinine, l_quantity / 2 + 3 AS urea, 130.0 - l_quantity * 2 AS egfr,
    l_quantity / 3 + 130 AS sodium, l_tax * 40 + 3 AS potassium, l_quantity / 2 + 90 AS chloride, 33.0 - l_quantity / 4 AS bicarbonate
  FROM lineitem)"""


def _exc(field, x=None):
    low, high = labs.RANGES[field]
    x = x or field
    below = f"({low} - ({x})) / {max(low, 1.0)}"
    above = f"(({x}) - {high}) / {max(high, 1.0)}" if high is not None else "0.0"
    return f"least(greatest({below}, {above}, 0.0), 1.0)"


def _checks():
    for i, (source, domain, label, field, required) in enumerate(labs.CHECKS):
        if field in ("symptomOnset", "comorbidities"):
            continue
        size = _exc(field) if field in labs.RANGES else "0.0"
        sev = f"CASE WHEN {field} IS NULL THEN {0.72 if required else 0.0} ELSE {size} END"
        yield f"SELECT {KEY_SQL}, {i} AS chk, '{source}' AS source, '{domain}' AS domain, {sev} AS severity FROM lab"


FOUND = f"found AS (SELECT * FROM ({' UNION ALL '.join(_checks())}) WHERE severity > 0)"
DOMAIN_COLS = ", ".join(
    f"round(coalesce(avg(severity) FILTER (domain = '{x}'), 0), 8) AS {x.lower().replace(' ', '_')}_score, "
    f"count(severity) FILTER (domain = '{x}') AS {x.lower().replace(' ', '_')}_count" for x in labs.DOMAINS)


def _c01(e):
    return f"round(least(greatest({e}, 0.0), 1.0), 9)"


def _dev(f, x=None):
    return _exc(f, f"coalesce({x or f}, 0.0)")


ORACLE = {
    "b1_b4_cleaned_cells": """
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, CASE WHEN k % 5 = 2 THEN k::VARCHAR WHEN k % 5 = 3 THEN 'x' || k END AS text,
       CASE WHEN k % 5 = 2 THEN k::DOUBLE END AS number,
       CASE k % 4 WHEN 0 THEN 'a|b' || k WHEN 1 THEN 'a|b|c' || k WHEN 3 THEN 'p|q' || k END AS items,
       CASE k % 3 WHEN 0 THEN '2026-06-01 03:30:00' WHEN 2 THEN '2026-06-02 10:00:00' END AS stamp FROM e""",
    "b9_reviewer_words": """
SELECT CASE turn % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 3 THEN 1 END AS feedback_label, count(*) AS rows
FROM conversations GROUP BY 1""",
    "b16_quality_rules": f"""
WITH q AS (
  SELECT {KEY_SQL}, 70.0 + l_quantity * 2.5 AS sbp, 70.0 + l_quantity * 2.5 - 75.0 AS age,
         (12.0 + l_discount * 150.0) * 4.5 AS dbp, 130.0 + l_quantity / 2.0 AS na FROM lineitem),
f AS (SELECT *, concat_ws('; ', CASE WHEN age < 0 THEN 'age_years must not be negative' END,
        CASE WHEN sbp < dbp THEN 'systolic must not be below diastolic' END,
        CASE WHEN na > 150 THEN 'gender has an unknown word' END) AS failed FROM q)
SELECT {KEY_SQL}, failed, CASE WHEN failed = '' THEN 'ok' ELSE 'suspect' END AS data_quality_flag FROM f""",
    "b17_bmi": """
SELECT p_partkey, round((p_retailprice / 20.0) / ((p_size * 4.0 / 100.0) * (p_size * 4.0 / 100.0)), 6) AS bmi_kg_m2 FROM part""",
    "r1_r6_clinical_risk": f"""
WITH {ENC}, {risk_sql("ln(fast) / 7.0")}
SELECT {KEY_SQL}, round(final, 4) AS risk_score_normalized, {CAT} AS risk_category,
       {CAT} = 'High' AS alert_triggered, crit > 0 AS critical_override_triggered, crit AS critical_reasons,
       n AS comorbidity_count, hi AS high_risk_comorbidity_count, mo AS moderate_comorbidity_count,
       round(boost, 4)::DOUBLE AS comorbidity_boost, floor_::DOUBLE AS risk_floor,
       conflict::INT + low::INT + (crit > 0)::INT AS warnings,
       5 + low::INT + (n > 0)::INT + (crit > 0)::INT AS drivers FROM risk""",
    "r9_risk_actions": f"""
WITH {ENC}, {risk_sql("0.3")}
SELECT {CAT} AS risk_level, CASE {CAT} WHEN 'High' THEN 'Immediate escalation' WHEN 'Medium' THEN 'Prompt follow-up'
       ELSE 'Routine monitoring' END AS action_title, 3 AS steps, count(*) AS rows FROM risk GROUP BY ALL""",
    "a15_lab_text_fields": f"""
SELECT doc_id, {_extract(FIELD_SQL, "report")} FROM (SELECT doc_id, {_reported_sql("doc_id", "text")} AS report FROM documents)""",
    "a15_page_fields": f"""
SELECT page_id, {_extract(LOOSE_SQL, "report")} FROM (SELECT page_id, {_reported_sql("page_id", "html")} AS report FROM pages)""",
    "c9_lab_alias_pivot": """
SELECT l_orderkey, max(l_quantity * 2) FILTER (l_linenumber = 1) AS fastingGlucose,
       max(l_quantity * 2) FILTER (l_linenumber = 2) AS alt, max(l_quantity * 2) FILTER (l_linenumber = 3) AS creatinine,
       max(l_quantity * 2) FILTER (l_linenumber = 4) AS hemoglobin, max(l_quantity * 2) FILTER (l_linenumber = 5) AS potassium,
       max(l_quantity * 2) FILTER (l_linenumber = 7) AS egfr
FROM lineitem WHERE l_linenumber <> 6 GROUP BY l_orderkey""",
    "r7_d23_range_findings": f"""
WITH {LAB}, {FOUND},
s AS (SELECT {KEY_SQL}, count(*) AS findings, {DOMAIN_COLS}, avg(severity) AS t,
      count(*) FILTER (source = '{labs.INTAKE}') AS intake_findings,
      count(*) FILTER (source = '{labs.LAB}') AS lab_findings FROM found GROUP BY ALL)
SELECT lab.{", lab.".join(line_key())}, coalesce(findings, 0) AS findings,
       {", ".join(f"coalesce({x.lower().replace(' ', '_')}_{y}, 0) AS {x.lower().replace(' ', '_')}_{y}" for x in labs.DOMAINS for y in ("score", "count"))},
       round(coalesce(t, 0), 8) AS total_severity,
       CASE WHEN t >= 0.55 THEN 'High' WHEN t >= 0.28 THEN 'Medium' ELSE 'Low' END AS care_risk,
       coalesce(intake_findings, 0) AS intake_findings, coalesce(lab_findings, 0) AS lab_findings
FROM lab LEFT JOIN s USING ({KEY_SQL})""",
    "t8_finding_cells": f"""
WITH {LAB}, {FOUND},
r AS (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY severity DESC, chk) AS rk FROM found)
SELECT domain, CASE WHEN rk <= 3 THEN 'critical' WHEN rk <= 6 THEN 'elevated' ELSE 'moderate' END AS tone,
       rk <= 8 AS in_trend, count(*) AS cells, round(avg(severity), 6) AS mean_severity
FROM r WHERE rk <= 9 GROUP BY ALL""",
    "i12_composite_features": f"""
WITH {LAB}
SELECT {KEY_SQL},
  {_c01("((fastingGlucose - 70) / 60 + (postprandialGlucose - 140) / 120 + (hba1c - 5.6) / 4) / 3 + 0.25")} AS glycemic_pressure,
  {_c01("abs(postprandialGlucose - fastingGlucose) / 180")} AS glucose_gap,
  {_c01("((systolicBp - 120) / 40 + (diastolicBp - 80) / 20) / 2 + 0.25")} AS blood_pressure_strain,
  {_c01("(100 - spo2) / 10")} AS oxygen_reserve,
  {_c01("((creatinine - 0.9) / 1.5 + (urea - 20) / 40 + (90 - egfr) / 60) / 3 + 0.15")} AS renal_burden,
  {_c01("(abs(sodium - 140) / 10 + abs(potassium - 4.2) / 2 + abs(chloride - 103) / 8 + abs(bicarbonate - 25) / 8) / 4")} AS electrolyte_drift,
  CASE WHEN wbcCount IS NOT NULL THEN {_c01("((14 - hemoglobin) / 4 + (wbcCount - 7) / 8 + (plateletCount - 250) / 250) / 3 + 0.2")} END AS hematology_stress,
  {_c01("((ast - 25) / 25 + (alt - 30) / 35 + (bilirubin - 0.8) / 1.2 + (4.2 - albumin) / 1.2) / 4 + 0.2")} AS liver_load,
  {_c01("weight / greatest(height, 1) / 2")} AS body_size FROM lab""",
    "r8_d26_screening_risk": f"""
WITH {LAB},
d AS (SELECT *, least(greatest(0.22 + ({" + ".join([_dev("fastingGlucose")] + [_dev(f) for f in labs.DEVIATION_FIELDS])}) / 18.0, 0), 1) AS base,
      (fastingGlucose > 0 AND (fastingGlucose < 50 OR fastingGlucose > 400)) OR creatinine > 2 OR urea > 40
      OR systolicBp > 180 OR systolicBp < 80 OR spo2 < 90 OR hba1c > 9 AS crit FROM lab),
s AS (SELECT *, least(greatest(base + 0.04, CASE WHEN crit THEN 0.75 ELSE 0.0 END), 1.0) AS final FROM d)
SELECT {KEY_SQL}, round(base, 6) AS screening_base, crit AS screening_critical, round(final, 6) AS screening_score,
  CASE WHEN final < 0.4 THEN 'Low' WHEN final < 0.65 THEN 'Medium' ELSE 'High' END AS screening_level,
  {", ".join(f"round(least(({' + '.join(_dev(f) for f in fs)}) / {len(fs)}.0, 1.0), 6) AS radar_{r}" for r, fs in labs.RADAR.items())}
FROM s""",
    "i13_i14_coded_features": """
WITH c AS (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' END AS sex,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Home' WHEN 'MACHINERY' THEN 'Clinic' END AS loc,
  CASE WHEN c_nationkey > 15 THEN 'Urgent' WHEN c_nationkey > 8 THEN 'Routine' END AS tri,
  CASE WHEN c_acctbal > 0 THEN c_acctbal / 100 END AS age FROM customer),
m AS (SELECT *, (sex IS NULL)::INT + (loc IS NULL)::INT + (tri IS NULL)::INT + (age IS NULL)::INT AS miss FROM c)
SELECT c_custkey, CASE sex WHEN 'Female' THEN 1.0 WHEN 'Male' THEN 0.82 ELSE 0.5 END AS sex_code,
  CASE loc WHEN 'Clinic' THEN 0.68 WHEN 'Home' THEN 0.4 ELSE 0.85 END AS location_code,
  CASE tri WHEN 'Urgent' THEN 1.0 WHEN 'Routine' THEN 0.45 ELSE 0.2 END AS triage_code,
  round(least(greatest(coalesce(age, 0) / 100, 0), 1), 6) AS age_code,
  CASE WHEN coalesce(age, 0) >= 60 THEN 'senior' WHEN coalesce(age, 0) >= 35 THEN 'adult' ELSE 'young' END AS age_band,
  4 - miss AS filled_count, miss AS missing_count, CASE WHEN miss = 0 THEN 'ready' ELSE 'warning' END AS completeness_status FROM m""",
    "d24_model_consensus": f"""
WITH {SCORED},
t AS (SELECT row_id, list_sort([least(greatest(isolation_forest_anomaly_score, 0), 1), least(greatest(autoencoder_anomaly_score, 0), 1),
      least(greatest(deep_svdd_anomaly_score, 0), 1), least(greatest(anomaly_score, 0), 1)], 'DESC') AS s FROM scored)
SELECT row_id, round((s[1] + s[2] + s[3] + s[4]) / 4, 9) AS consensus_score, round(s[1] - s[4], 9) AS consensus_spread,
  CASE WHEN s[2] >= 0.7 THEN 'High' WHEN len(list_filter(s, lambda x: x >= 0.4 AND x < 0.7)) >= 2 THEN 'Medium' ELSE 'Low' END
  AS consensus_band FROM t""",
    "d24_band_averages": f"""
WITH {SCORED},
l AS (SELECT unnest([isolation_forest_anomaly_score, autoencoder_anomaly_score, deep_svdd_anomaly_score, anomaly_score]) AS v FROM scored),
c AS (SELECT least(greatest(v, 0), 1) AS v FROM l)
SELECT CASE WHEN v >= 0.7 THEN 'High' WHEN v >= 0.4 THEN 'Medium' ELSE 'Low' END AS band, count(*) AS scores,
       round(avg(v), 6) AS mean_score FROM c GROUP BY 1""",
}
