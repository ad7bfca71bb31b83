"""Domain table registry: schemas, contracts and partitioning.

Eight clinical domain tables share ``patient_cohort`` and ``ingestion_date``
(the identity partition columns); stored tables add ``schema_version`` and
``updated_at``.  Contracts are rule lists for ``operators.contracts``:
non-null columns, coercible types and value ranges; extra columns pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinlake.operators.contracts import Rule, split_valid, validate
from clinlake.sources.sinks import stamp_audit

PARTITION_COLS = ["patient_cohort", "ingestion_date"]
SCHEMA_VERSION = 1

S, D, L, I, B, TS, DT = (T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType(),
                         T.TimestampType(), T.DateType())


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


_COMMON = [_f("patient_cohort", S, False), _f("ingestion_date", DT, False)]

DOMAIN_TABLES: dict[str, T.StructType] = {
    "patients": T.StructType([_f("patient_id", S, False), *_COMMON, _f("sex", S), _f("birth_year", I),
                              _f("education_years", D), _f("apoe_e4_count", I)]),
    "imaging_sessions": T.StructType([_f("imaging_session_id", S, False), _f("patient_id", S, False), *_COMMON,
                                      _f("series_uid", S, False), _f("modality", S, False), _f("field_strength_t", D),
                                      _f("voxel_size_mm", S), _f("orientation", S), _f("qc_pass", B, False),
                                      _f("qc_flags", S), _f("registered_nifti_uri", S)]),
    "connectivity_matrices": T.StructType([_f("connectivity_id", S, False), _f("imaging_session_id", S, False),
                                           _f("patient_id", S, False), *_COMMON, _f("atlas_name", S, False),
                                           _f("n_regions", I, False), _f("matrix_uri", S, False),
                                           _f("mean_connectivity", D)]),
    "genomic_variants": T.StructType([_f("variant_id", S, False), _f("patient_id", S, False), *_COMMON,
                                      _f("chrom", S, False), _f("pos", L, False), _f("ref", S, False),
                                      _f("alt", S, False), _f("gene", S), _f("clinvar_significance", S),
                                      _f("dbsnp_id", S)]),
    "biomarker_timeseries": T.StructType([_f("timeseries_id", S, False), _f("patient_id", S, False), *_COMMON,
                                          _f("modality", S, False), _f("window_start", TS, False),
                                          _f("window_end", TS, False), _f("metric_mean", D), _f("metric_std", D),
                                          _f("sample_count", I, False)]),
    "clinical_notes": T.StructType([_f("note_id", S, False), _f("patient_id", S, False), *_COMMON,
                                    _f("encounter_time", TS), _f("note_text", S, False), _f("source_system", S)]),
    "causal_graphs": T.StructType([_f("graph_id", S, False), _f("patient_id", S), *_COMMON,
                                   _f("source_node", S, False), _f("target_node", S, False),
                                   _f("edge_weight", D, False), _f("edge_type", S, False)]),
    "model_predictions": T.StructType([_f("prediction_id", S, False), _f("patient_id", S, False), *_COMMON,
                                       _f("model_name", S, False), _f("model_version", S, False),
                                       _f("prediction_time", TS, False), _f("risk_score", D, False),
                                       _f("risk_label", S, False)]),
}

# Value ranges of the domain contracts (inclusive unless noted).
_RANGES = {
    "patients": [Rule("birth_year", "range", lo=1900, hi=2100), Rule("education_years", "range", lo=0, hi=30),
                 Rule("apoe_e4_count", "range", lo=0, hi=2)],
    "imaging_sessions": [Rule("field_strength_t", "range", lo=0.0)],
    "connectivity_matrices": [Rule("n_regions", "range", lo=0, lo_open=True, nullable=False)],
    "genomic_variants": [Rule("pos", "range", lo=0, lo_open=True, nullable=False)],
    "biomarker_timeseries": [Rule("sample_count", "range", lo=1, nullable=False)],
    "clinical_notes": [],
    "causal_graphs": [],
    "model_predictions": [Rule("risk_score", "range", lo=0.0, hi=1.0, nullable=False)],
}


def contract(table: str) -> list[Rule]:
    """Rule list: not-null for required columns, coercible type for typed ones, then ranges."""
    rules = []
    for f in DOMAIN_TABLES[table].fields:
        if not f.nullable:
            rules.append(Rule(f.name, "not_null"))
        if not isinstance(f.dataType, T.StringType):
            rules.append(Rule(f.name, "type", dtype=f.dataType.simpleString()))
    return rules + _RANGES[table]


def contract_append(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Validated append: (valid rows coerced to the schema with audit columns,
    quarantined rows with their violations).  Extra columns are kept."""
    schema = DOMAIN_TABLES[table]
    v = validate(df, contract(table))
    good, bad = split_valid(v)
    cast = good.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
                         else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields],
                       *[c for c in df.columns if c not in schema.fieldNames()])
    return stamp_audit(cast, SCHEMA_VERSION), bad
