import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.oracle import rows as comparable
from wardlight.functions.cleaning import Fields, clean_frame, quality_rules
from wardlight.operators import evaluate as ev
from wardlight.operators import labs
from wardlight.operators.risk import clinical_risk, condition_tokens, percent_scale, risk_category, risk_weights
from wardlight.plans import clinical_queries
from wardlight.sources.splits import append_feedback, load_lab_reports, load_ledger, load_splits, save_splits
from wardlight.sources.tabular import load_encounters, with_row_id, write_scored_csv
from wardlight.operators.split import with_split


def one(spark, **values):
    schema = T.StructType([T.StructField(k, T.ArrayType(T.StringType()) if isinstance(v, list) else
                                         T.DoubleType() if isinstance(v, float) else T.StringType()) for k, v in values.items()])
    return spark.createDataFrame([tuple(values.values())], schema)


def test_category_and_percent(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, .39, .4, .64, .65, .99)], "x double")
    assert [r[0] for r in df.select(risk_category(F.col("x"))).collect()] == ["Low", "Low", "Medium", "Medium", "High", "High"]
    df = spark.createDataFrame([(x,) for x in (0.0, .435, 1.0, 1.7)], "x double")
    assert [r[0] for r in df.select(percent_scale(F.col("x"))).collect()] == [0, 43.5, 100, 100]


def test_critical_override(spark):
    df = one(spark, glucose_fasting_mg_dl=425.0, comorbidities=["Type 2 Diabetes"], anomaly_score=0.1)
    r = clinical_risk(df).first()
    assert r["risk_score_normalized"] >= 0.75 and r["risk_category"] == "High" and r["critical_override_triggered"]
    assert r["critical_override_reasons"] == ["Blood glucose 425.0 mg/dL"]
    assert any("Blood glucose" in w for w in r["risk_warnings"]) and "Warnings:" in r["risk_summary"]


def test_condition_floors_and_words(spark):
    r = clinical_risk(one(spark, comorbidities="CKD, hypertension; copd / asthma | gout", anomaly_score=0.05)).first()
    assert r["comorbidity_count"] == 5 and r["risk_score_normalized"] >= 0.55 and r["risk_category"] == "Medium"
    r = clinical_risk(one(spark, comorbidities="n/a", anomaly_score=0.05)).first()
    assert r["comorbidity_count"] == 0
    r = clinical_risk(one(spark, comorbidities="None, N/A ,CKD, ckd", anomaly_score=0.05)).first()
    assert (r["comorbidity_count"], r["high_risk_comorbidity_count"]) == (1, 1)


def test_conflict_and_inconsistency(spark):
    r = clinical_risk(one(spark, glucose_poc_mg_dl="200", fasting_glucose="100", a1c="5.1",
                          comorbidities=["t2d"], anomaly_score=0.2)).first()
    assert "spot glucose of 200.0" in r["lab_conflict_warning"] and "fasting glucose of 100.0" in r["lab_conflict_warning"]
    assert "type 2 diabetes on record" in r["clinical_inconsistency_warning"]
    assert "the larger, 200.0 mg/dL" in r["risk_summary"]


def test_risk_grows_with_the_readings(spark):
    low = dict(heart_rate_bpm=70.0, systolic_bp_mmhg=115.0, spo2_percent=98.0, hba1c_percent=5.0, ldl_mg_dl=80.0)
    high = dict(heart_rate_bpm=110.0, systolic_bp_mmhg=160.0, spo2_percent=91.0, hba1c_percent=8.5, ldl_mg_dl=180.0)
    a = clinical_risk(one(spark, **low, anomaly_score=0.2)).first()["risk_score_normalized"]
    b = clinical_risk(one(spark, **high, anomaly_score=0.2)).first()["risk_score_normalized"]
    assert b > a
    assert sum(risk_weights({"anomaly": 2.0}).values()) == pytest.approx(1.0)


def test_loader_quirks(spark, tmp_path):
    (tmp_path / "data.csv").write_text(
        ' patient_id ,recorded_at,gender,comorbidities,current_medications,days_between_visits_trend,age_years\n'
        'P1,2026-06-01T09:00:00+05:30, none ,"[""diabetes"", ""hypertension""]","metformin, amlodipine","[7, 14, 21]",x\n')
    r = load_encounters(spark, str(tmp_path)).first()
    assert str(r["recorded_at"]).startswith("2026-06-01 03:30") and r["gender"] is None and r["age_years"] is None
    assert r["comorbidities"] == ["diabetes", "hypertension"] and r["current_medications"] == ["metformin", "amlodipine"]
    assert r["days_between_visits_trend"] == [7.0, 14.0, 21.0]
    with pytest.raises(ValueError):
        load_encounters(spark, str(tmp_path / "nothing"))


def test_python_lists_and_quality(spark):
    df = clean_frame(one(spark, comorbidities="['asthma', None, 'copd']", gender=" Female "))
    r = df.first()
    assert r["comorbidities"] == ["asthma", "copd"] and r["gender"] == "Female"
    bad = quality_rules(spark.createDataFrame([("p", None, 80.0, 90.0, 101.0)], (
        "patient_id string, recorded_at timestamp, systolic_bp_mmhg double, diastolic_bp_mmhg double, spo2_percent double"))).first()
    assert len(bad["failed_rules"]) == 3 and bad["data_quality_flag"] == "suspect" and bad["spo2_percent"] == 101.0


def test_splits_ledger_and_csv(spark, tmp_path):
    df = spark.range(40).selectExpr("cast(id as string) row_id", "cast(id % 10 as string) patient_id", "array('a', 'b') tags")
    save_splits(with_split(df), str(tmp_path / "s"))
    parts = load_splits(spark, str(tmp_path / "s"))
    assert sum(p.count() for p in parts.values()) == 40
    groups = [p.select("patient_id").distinct() for p in parts.values()]
    assert groups[0].intersect(groups[1]).isEmpty()
    manifest = spark.read.json(str(tmp_path / "s/manifest"))
    assert manifest.agg(F.sum("rows")).first()[0] == 40
    with pytest.raises(ValueError):
        load_splits(spark, str(tmp_path))
    ledger = str(tmp_path / "ledger")
    assert load_ledger(spark, ledger).count() == 0
    payload = spark.read.json(spark.sparkContext.parallelize([
        '{"patient": {"patient_id": "P1", "age": 3}, "is_true_positive": true, "reviewer": "r"}',
        '{"patient": {"patient_id": "P2", "age": 4}, "feedback_label": "fp", "notes": "n"}']))
    assert append_feedback(payload, ledger) == 2
    rows = {r["patient_id"]: r for r in load_ledger(spark, ledger).collect()}
    assert rows["P1"]["feedback_label"] == 1 and rows["P2"]["feedback_label_text"] == "false_positive"
    assert rows["P2"]["alert_id"] == "P2" and '"age":4' in rows["P2"]["record_json"]
    raw = str(tmp_path / "raw")
    payload.write.json(raw)
    assert load_ledger(spark, raw).where("feedback_label IS NOT NULL").count() == 2
    write_scored_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()["tags"] == '["a","b"]'


def test_row_ids_are_unique(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "x string, y int")
    assert with_row_id(df).select("row_id").distinct().count() == 3


def test_lab_reports_in_both_shapes(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("sampleId,FBG,hba1c,status\ns1,120,6.5,anomaly\n")
    wide = load_lab_reports(spark, str(tmp_path / "wide.csv")).first()
    assert wide["fastingGlucose"] == 120.0 and wide["hba1c"] == 6.5 and wide["status"] == "anomaly"
    (tmp_path / "pairs.csv").write_text("test,result\nHb,13.5\nSGPT,44\nhb,abc\nglucose?,9\n")
    pairs = load_lab_reports(spark, str(tmp_path / "pairs.csv")).first()
    assert pairs["hemoglobin"] == 13.5 and pairs["alt"] == 44.0


def test_lab_text(spark):
    text = "HbA1c: 8.9, SGOT = 68; post meal glucose is 248. fast 12 and K - 4.1"
    r = labs.extract_fields(spark.createDataFrame([(text,)], "text string")).first()
    assert (r["hba1c"], r["ast"], r["postprandialGlucose"], r["potassium"]) == (8.9, 68.0, 248.0, 4.1)
    loose = labs.extract_fields(spark.createDataFrame([("fast 12",)], "text string"), word_start=False).first()
    assert loose["ast"] == 12.0 and labs.extract_fields(
        spark.createDataFrame([("fast 12",)], "text string")).first()["ast"] is None


@pytest.mark.parametrize("name, table, key, column", [
    ("a15_lab_text_fields", "documents", "doc_id", "text"), ("a15_page_fields", "pages", "page_id", "html")])
def test_given_texts_are_searched_whole(spark, tmp_path, name, table, key, column):
    """What stands in a given text counts, in the query and in its SQL; missing texts keep the report alone."""
    texts = [(0, "x " * 5000 + "fasting glucose: 301.5"), (1, None), (2, "Hb 3.5\nHB 9"), (3, "")]
    spark.createDataFrame(texts, f"{key} long, {column} string").write.parquet(str(tmp_path / f"{table}.parquet"))
    got = {r[key]: r for r in clinical_queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got[0]["fastingGlucose"] == 301.5 and got[2]["hemoglobin"] == 3.5
    assert got[1]["fastingGlucose"] == 80.1 and got[3]["fastingGlucose"] == 80.3
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    cur = con.execute(clinical_queries.ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert comparable(columns, cur.fetchall()) == comparable([*got[0].asDict()], [tuple(r) for r in got.values()])


def test_findings(spark):
    df = one(spark, age="50", symptomOnset="2 days", comorbidities="asthma", heartRate="150", systolicBp="120",
             diastolicBp="80", spo2="97", temperature="36.6", respiratoryRate="", fastingGlucose="90",
             postprandialGlucose="120", hemoglobin="13", hdl="20")
    rows = labs.finding_rows(df.withColumn("row_id", F.lit(1)), ["row_id"]).orderBy("rank").collect()
    assert [r["label"] for r in rows] == ["Respiratory rate", "Heart rate", "HDL"]
    assert rows[0]["note"] == "This field is still blank." and rows[1]["note"] == "Higher than the usual range of Usually 60 to 100."
    assert rows[2]["note"] == "Lower than the usual range of Usually over 40." and rows[1]["status"] == "needs attention"
    s = labs.care_summary(df).first()
    assert s["care_risk"] == "High" and s["findings"] == 3 and s["vitals_count"] == 2
    empty = labs.care_summary(one(spark, age="50")).first()
    assert empty["findings"] == 0 and empty["care_risk"] == "Low"


def scores(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_perfect_scores_and_signed_labels(spark):
    df = scores(spark, list(zip([.1, .3, .8, .9], [0, 0, 1, 1])), "score double, label int")
    r = ev.evaluate_scores(df, ["score"], "label").first()
    assert [r[m] for m in ("precision", "recall", "f1", "roc_auc", "auprc")] == [1.0] * 5
    df = scores(spark, list(zip([.9, .8, .2, .1], [-1, -1, 1, 1])), "score double, label int")
    r = ev.evaluate_scores(df, ["score"], "label").first()
    assert r["precision"] == 1.0 and r["recall"] == 1.0
    with pytest.raises(ValueError):
        ev.evaluate_scores(scores(spark, [(0.1, 3)], "score double, label int"), ["score"], "label")


def test_ranking_distribution_and_one_class(spark):
    df = scores(spark, list(zip([.2, .1, .9, .8], [.6, .6, .4, .4], [0, 0, 1, 1])), "model_a double, model_b double, label int")
    ranked = ev.rank_models(ev.evaluate_scores(df, ["model_a", "model_b"], "label")).collect()
    assert ranked[0]["model"] == "model_a"
    d = ev.evaluate_scores(scores(spark, [(x,) for x in (.05, .2, .4, .8, .95)], "score double"), ["score"]).first()
    assert d["above_threshold_rate"] == pytest.approx(0.4) and d["score_median"] == pytest.approx(0.4)
    single = ev.evaluate_scores(scores(spark, [(.1, 0), (.2, 0)], "score double, label int"), ["score"], "label").first()
    assert single["roc_auc"] is None and single["f1"] == 0.0


def test_calibration_and_agreement(spark):
    df = scores(spark, list(zip([.1, .2, .35, .8, .9], [0, 0, 0, 1, 1])), "score double, label int")
    best = ev.calibrate_threshold(df, "score", "label", 21).first()
    assert best["threshold"] >= 0.75 and best["f1"] == 1.0
    df = scores(spark, [(.9, .8, .1), (.2, .7, .9), (.1, .1, .1), (.9, .9, .9)], "a_anomaly_score double, b_anomaly_score double, c_anomaly_score double")
    s = ev.agreement_summary(df, df.columns).first()
    assert s["all_models_flag_count"] == 1 and s["at_least_two_flag_rate"] == pytest.approx(0.75)
    top = ev.top_disagreements(df.withColumn("row_id", F.monotonically_increasing_id()), df.columns, top_n=1).first()
    assert top["disagreement_count"] == 2 and top["flag_pattern"] in ("110", "011")


def test_score_column_rules():
    cols = ["anomaly_score", "x_anomaly_score", "nutritional_score", "distribution_mmd_score", "decision_margin"]
    assert ev.score_columns(cols) == ["anomaly_score", "x_anomaly_score", "distribution_mmd_score"]
    assert "nutritional_score" in ev.score_columns(cols, loose=True)


def test_wide_rules_run_as_compiled_code(spark, sf):
    session = spark.newSession()  # as a driver starts it: fused methods of up to 65,535 bytes
    session.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    session.conf.set("spark.sql.debug.maxToStringFields", "5000")
    session.conf.set("spark.sql.maxPlanStringLength", "10000000")
    for name in ("r1_r6_clinical_risk", "r9_risk_actions", "t8_finding_cells", "r7_d23_range_findings"):
        session.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
        out = clinical_queries.QUERIES[name](session, sf)
        plan = session._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "extended").split("== Optimized")[1]
        assert "lambdafunction" not in plan.lower(), name  # Spark interprets functions over list items
        assert int(session.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000, name


def test_condition_words_of_odd_texts(spark):
    texts = ["CKD", " ckd ;; Type-2  Diabetes/", "n/a", "N/A,gout", "none of the above|nil", "", None, "a.b, a b\nA-B", "/,;", "x\t, x",
             "Ärzte, né", "n/a;n/a|t2d", "no known conditions", "hay  fever (mild), hay fever mild", "n/abc/n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, comorbidities string")
    got = [r[0] for r in df.orderBy("i").select(condition_tokens(Fields(df))).collect()]
    assert got == [["ckd"], ["ckd", "type 2 diabetes"], [], ["gout"], [], [], [], ["a b"], [], ["x"],
                   ["rzte", "n"], ["t2d"], [], ["hay fever mild"], ["n", "abc"]]
