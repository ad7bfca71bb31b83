"""Multi-source patient feature matrix (time-series pivot + connectivity + variants).

Semantics: mean metric per (patient, modality) pivoted to one column per
modality, mean connectivity per patient, variant count per patient, all
sources combined on the patient key as a full outer join with missing cells
set to 0.

Plan: instead of three aggregates and two full outer joins (three shuffles
plus join exchanges), every side is projected to a narrow (patient, kind,
value) row, the sides are unioned, and one ``groupBy(patient)`` computes all
columns with conditional aggregates.  The partial aggregate runs before the
single exchange, so the shuffle carries at most one row per patient per map
task and a hot patient is pre-aggregated on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinlake.functions.exprs import nan_to_null


def patient_feature_matrix(timeseries: DataFrame, connectivity: DataFrame, variants: DataFrame,
                           modalities: Sequence[str], *, patient: str = "patient_id",
                           modality: str = "modality", metric: str = "metric_mean",
                           conn_patient: str = "patient_id", conn_value: str = "mean_connectivity",
                           var_patient: str = "patient_id",
                           connectivity_col: str = "connectivity_mean",
                           count_col: str = "variant_count") -> DataFrame:
    ts = timeseries.select(F.col(patient).alias("_pid"), F.col(modality).cast("string").alias("_kind"),
                           nan_to_null(F.col(metric).cast("double")).alias("_v"))
    cn = connectivity.select(F.col(conn_patient).alias("_pid"), F.lit("\u0000conn").alias("_kind"),
                             nan_to_null(F.col(conn_value).cast("double")).alias("_v"))
    vr = variants.select(F.col(var_patient).alias("_pid"), F.lit("\u0000var").alias("_kind"),
                         F.lit(None).cast("double").alias("_v"))
    long = ts.unionByName(cn).unionByName(vr)
    aggs = [F.coalesce(F.avg(F.when(F.col("_kind") == m, F.col("_v"))), F.lit(0.0)).alias(m)
            for m in modalities]
    aggs.append(F.coalesce(F.avg(F.when(F.col("_kind") == "\u0000conn", F.col("_v"))),
                           F.lit(0.0)).alias(connectivity_col))
    aggs.append(F.count(F.when(F.col("_kind") == "\u0000var", F.lit(1))).alias(count_col))
    return long.groupBy(F.col("_pid").alias(patient)).agg(*aggs)
