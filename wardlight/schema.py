"""Encounter vocabulary: column lists, schema and default settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Encounter column names.
NUMERIC_FEATURES = [
    "age_years", "visits_last_90_days", "symptom_duration_days", "sanitation_index",
    "nutritional_score", "distance_to_nearest_facility_km", "treatment_response_score",
    "readmission_frequency", "drug_adherence_rate", "heart_rate_bpm", "systolic_bp_mmhg",
    "diastolic_bp_mmhg", "spo2_percent", "body_temperature_c", "respiratory_rate_bpm",
    "weight_kg", "height_cm", "bmi_kg_m2", "glucose_fasting_mg_dl",
    "glucose_postprandial_mg_dl", "hb_g_dl", "wbc_count_10e9_l", "platelets_10e9_l",
    "hba1c_percent", "ldl_mg_dl", "hdl_mg_dl", "triglycerides_mg_dl", "alt_u_l", "ast_u_l",
    "bilirubin_mg_dl", "creatinine_mg_dl", "bun_mg_dl", "egfr_ml_min_1_73m2",
    "sodium_mmol_l", "potassium_mmol_l", "calcium_mg_dl",
]
CATEGORICAL_FEATURES = [
    "gender", "location_type", "source_type", "operator_id", "device_id",
    "measurement_posture", "data_quality_flag", "malaria_prevalence_level",
    "dengue_prevalence_level",
]
MULTI_VALUE_FEATURES = ["comorbidities", "current_medications"]
LIST_NUMERIC_FEATURES = ["days_between_visits_trend"]
TEXT_COLUMNS = ["measurement_context", "notes"]
TIME_COLUMNS = ["recorded_at", "specimen_time"]

KEY = "patient_id"
TIME = "recorded_at"
ROW = "row_id"


def encounter_schema() -> T.StructType:
    fields = [T.StructField(KEY, T.StringType()), T.StructField(TIME, T.TimestampType())]
    fields += [T.StructField(c, T.DoubleType()) for c in NUMERIC_FEATURES]
    fields += [T.StructField(c, T.StringType()) for c in CATEGORICAL_FEATURES]
    fields += [T.StructField(c, T.ArrayType(T.StringType())) for c in MULTI_VALUE_FEATURES]
    fields += [T.StructField(c, T.ArrayType(T.DoubleType())) for c in LIST_NUMERIC_FEATURES]
    fields += [T.StructField(c, T.StringType()) for c in TEXT_COLUMNS]
    return T.StructType(fields)


@dataclass
class Settings:
    """One place for every tunable of the train / score jobs."""

    numeric_features: list[str] = field(default_factory=lambda: list(NUMERIC_FEATURES))
    categorical_features: list[str] = field(default_factory=lambda: list(CATEGORICAL_FEATURES))
    multi_value_features: list[str] = field(default_factory=lambda: list(MULTI_VALUE_FEATURES))
    list_numeric_features: list[str] = field(default_factory=lambda: list(LIST_NUMERIC_FEATURES))
    rolling_windows_days: tuple[int, ...] = (7, 30)
    lag_steps: tuple[int, ...] = (1,)
    interaction_terms: tuple[tuple[str, str], ...] = ()
    scaler: str = "standard"
    imputer: str = "mean"
    knn_neighbors: int = 5
    apply_pca: bool = True
    pca_feature_threshold: int = 50
    pca_variance_threshold: float = 0.95
    detectors: tuple[str, ...] = ("isolation_forest", "pca_reconstruction")
    contamination: float = 0.05
    fusion_strategy: str = "weighted_average"
    fusion_weights: dict[str, float] | None = None
    normalize_weights: bool = True
    max_score_threshold: float = 0.8
    calibrate_threshold: bool = True
    calibration_min_samples: int = 25
    stacking_meta_model: str = "mlp"
    sequence_window: int = 4
    sequence_weight: float = 0.25
    drift_baseline_window: int = 5
    drift_cusum_k: float = 0.25
    drift_cusum_h: float = 5.0
    drift_adwin_delta: float = 0.01
    drift_adwin_min_window: int = 5
    monitor_calibration_batch: int = 32
    monitor_trials: int = 64
    monitor_quantile: float = 0.95
    conformal_alpha: float = 0.05
    risk_weights: dict[str, float] | None = None
    seed: int = 42
