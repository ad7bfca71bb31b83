"""Domain contracts on rows at the limits of each contract."""

import datetime as dt

from clinlake import schema
from clinlake.operators import features

DAY = dt.date(2025, 1, 31)
AT = dt.datetime(2025, 1, 31, 23, 59, 59)
BASE = {"patient_cohort": "site-B", "ingestion_date": DAY}

LIMIT_ROWS = {
    "patients": {"patient_id": "B-17", "sex": None, "birth_year": 1900, "education_years": 30.0, "apoe_e4_count": 2},
    "imaging_sessions": {"imaging_session_id": "scan/9", "patient_id": "B-17", "series_uid": "9.9", "modality": "PT",
                         "field_strength_t": 0.0, "voxel_size_mm": None, "orientation": None, "qc_pass": False,
                         "qc_flags": None, "registered_nifti_uri": "file:///out/9.nii"},
    "connectivity_matrices": {"connectivity_id": "net/9", "imaging_session_id": "scan/9", "patient_id": "B-17",
                              "atlas_name": "own", "n_regions": 1, "matrix_uri": "file:///net/9",
                              "mean_connectivity": None},
    "genomic_variants": {"variant_id": "g/1", "patient_id": "B-17", "chrom": "X", "pos": 1, "ref": "A", "alt": "G",
                         "gene": None, "clinvar_significance": None, "dbsnp_id": None},
    "biomarker_timeseries": {"timeseries_id": "w/1", "patient_id": "B-17", "modality": "accel", "window_start": AT,
                             "window_end": AT, "metric_mean": None, "metric_std": None, "sample_count": 1},
    "clinical_notes": {"note_id": "text/1", "patient_id": "B-17", "encounter_time": None, "note_text": "-",
                       "source_system": None},
    "causal_graphs": {"graph_id": "dag/1", "patient_id": None, "source_node": "left", "target_node": "right",
                      "edge_weight": -1.0, "edge_type": "indirect"},
    "model_predictions": {"prediction_id": "out/1", "patient_id": "B-17", "model_name": "m", "model_version": "0",
                          "prediction_time": AT, "risk_score": 1.0, "risk_label": "High"},
}


def _frame(spark, table, row):
    sch = schema.DOMAIN_TABLES[table]
    full = {**BASE, **row}
    return spark.createDataFrame([tuple(full.get(f.name) for f in sch.fields)], sch)


def test_all_limit_rows_pass(spark):
    for table, row in LIMIT_ROWS.items():
        good, bad = schema.contract_append(_frame(spark, table, row), table)
        assert good.count() == 1 and bad.count() == 0, table
        assert {"schema_version", "updated_at"} <= set(good.columns)


def test_contract_failures_reported(spark):
    bad_row = {**LIMIT_ROWS["genomic_variants"], "pos": 0}
    good, bad = schema.contract_append(_frame(spark, "genomic_variants", bad_row), "genomic_variants")
    assert good.count() == 0 and bad.collect()[0]["violations"] == ["pos:range"]
    p = _frame(spark, "patients", {**LIMIT_ROWS["patients"], "apoe_e4_count": 3, "birth_year": 1800})
    v = schema.contract_append(p, "patients")[1].collect()[0]["violations"]
    assert set(v) == {"apoe_e4_count:range", "birth_year:range"}


def test_feature_matrix_of_one_patient(spark):
    ts = spark.createDataFrame([("B-17", "accel", 1.5), ("B-17", "eeg", 2.0), ("B-17", "eeg", 4.0)],
                               "patient_id string, modality string, metric_mean double")
    conn = spark.createDataFrame([("B-17", 0.25), ("B-17", 0.75)], "patient_id string, mean_connectivity double")
    var = spark.createDataFrame([("B-17", "g/1"), ("B-17", "g/2")], "patient_id string, variant_id string")
    (r,) = features.patient_feature_matrix(ts, conn, var, ["accel", "eeg"]).collect()
    assert (r["patient_id"], r["accel"], r["eeg"], r["connectivity_mean"], r["variant_count"]) == \
        ("B-17", 1.5, 3.0, 0.5, 2)
