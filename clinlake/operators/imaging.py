"""Imaging header tables: QC flags, tag de-identification, scan volumes.

Pixel data is not decoded here; these operators work on landed header /
tag tables (one row per scan, or one row per (file, tag)) and voxel-count
tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinlake.functions.exprs import hmac_sha256_hex

# QC limits and orientation codes flagged as unexpected.
VOXEL_MAX_MM = 4.0
UNEXPECTED_ORIENTATIONS = ["100010", "010001"]
# Safe Harbor tags blanked on export (group, element).
SAFE_HARBOR_TAGS = [(0x0010, 0x0010), (0x0010, 0x0020), (0x0010, 0x0030), (0x0010, 0x0040),
                    (0x0008, 0x0080), (0x0008, 0x0090), (0x0008, 0x1010)]
PATIENT_ID_TAG = (0x0010, 0x0020)


def qc_flags(df: DataFrame, pixel_x: str, pixel_y: str, thickness: str, orientation: str, field_strength: str,
             field_bounds: tuple[float, float]) -> DataFrame:
    """Adds ``qc_flags`` (array of failed checks) and ``qc_pass``: any voxel side
    <= 0 or > 4 mm, an unexpected orientation code, field strength outside bounds."""
    sides = [F.col(pixel_x).cast("double"), F.col(pixel_y).cast("double"), F.col(thickness).cast("double")]
    bad_voxel = sum(((s <= 0) | (s > VOXEL_MAX_MM)).cast("int") for s in sides) > 0
    fs = F.col(field_strength).cast("double")
    bad_field = fs.isNotNull() & ((fs < field_bounds[0]) | (fs > field_bounds[1]))
    flags = F.array_compact(F.array(F.when(bad_voxel, F.lit("voxel_size_outlier")),
                                    F.when(F.col(orientation).isin(UNEXPECTED_ORIENTATIONS), F.lit("orientation_unexpected")),
                                    F.when(bad_field, F.lit("field_strength_outlier"))))
    return df.withColumn("qc_flags", flags).withColumn("qc_pass", F.size("qc_flags") == 0)


def deidentify_tags(tags: DataFrame, group: str, element: str, value: str, patient_key: str | Column,
                    secret: str) -> DataFrame:
    """Blank the Safe Harbor tags of a (file, group, element, value) tag table and
    put a keyed pseudonym of the patient into PatientID (repeatable across runs)."""
    key = F.col(patient_key) if isinstance(patient_key, str) else patient_key
    is_pid = (F.col(group) == PATIENT_ID_TAG[0]) & (F.col(element) == PATIENT_ID_TAG[1])
    blank = None
    for g, e in SAFE_HARBOR_TAGS:
        cond = (F.col(group) == g) & (F.col(element) == e)
        blank = cond if blank is None else blank | cond
    new = F.when(is_pid, hmac_sha256_hex(key.cast("string"), secret)).when(blank, F.lit("")).otherwise(F.col(value))
    return tags.withColumn(value, new)


def scan_volumes(voxels: DataFrame, scan: str, value: str, voxel_x: str, voxel_y: str, voxel_z: str) -> DataFrame:
    """Total volume per scan: non-zero voxels x voxel volume (mm^3, 2 decimals)."""
    return voxels.groupBy(scan).agg(
        F.count_if(F.col(value) > 0).alias("nonzero_voxels"),
        F.first(F.col(voxel_x) * F.col(voxel_y) * F.col(voxel_z)).alias("_vv")) \
        .select(scan, "nonzero_voxels", F.round(F.col("nonzero_voxels") * F.col("_vv"), 2).alias("volume_mm3"))
