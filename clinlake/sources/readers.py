"""Readers for the landed source formats.

Every reader takes an explicit schema (no inference on large input), keeps
extra columns, and records lineage (``data_source``) from the file metadata
instead of per-file driver loops.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinlake.plans.broadcast import bounded_broadcast


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, sep: str = ",",
             comment: str | None = None) -> DataFrame:
    r = spark.read.schema(schema).option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
    if comment:
        r = r.option("comment", comment)
    return r.csv(path)


def read_tsv_strings(spark: SparkSession, path: str, columns: Sequence[str], comment: str = "#",
                     header: bool = True) -> DataFrame:
    """TSV with comment lines, every column read as a string (VEP / BIDS style)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return read_csv(spark, path, schema, header=header, sep="\t", comment=comment)


def read_whitespace(spark: SparkSession, path: str, names: Sequence[str], header: bool = True) -> DataFrame:
    """Whitespace-delimited text (PRSice-style): split(trim(line), '\\s+')."""
    lines = spark.read.text(path)
    parts = F.split(F.trim(F.col("value")), r"\s+")
    df = lines.filter(F.trim("value") != "").select(*[parts.getItem(i).alias(n) for i, n in enumerate(names)])
    if header:
        df = df.filter(F.col(names[0]) != names[0])
    return df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, multiline: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def with_source(df: DataFrame, out: str = "data_source") -> DataFrame:
    """Lineage column from the file the row came from (``_metadata.file_name``)."""
    return df.withColumn(out, F.regexp_replace(F.col("_metadata.file_name"), r"\.[A-Za-z0-9]+$", ""))


def discover(spark: SparkSession, folder: str, names: Sequence[str], skip: Sequence[str] = (),
             fmt: str = "parquet", merge_schema: bool = True) -> DataFrame:
    """One multi-path read of ``folder/{a,b,...}.<fmt>`` (Hadoop glob), schemas
    merged by name, lineage from file metadata, skip patterns applied to the
    file name (``rlike``) as a filter on metadata."""
    glob = f"{folder.rstrip('/')}/{{{','.join(names)}}}.{fmt}"
    df = spark.read.option("mergeSchema", merge_schema).format(fmt).load(glob)
    df = with_source(df)
    for pat in skip:
        df = df.filter(~F.col("_metadata.file_name").rlike(pat))
    return df


def drop_sources_without(df: DataFrame, keep_row: F.Column | None = None, source: str = "data_source") -> DataFrame:
    """Drop whole sources that are empty or hold only rows failing ``keep_row``
    (e.g. reference-only sources): decided by one aggregate per source and a
    semi join, never by a driver-side count per file."""
    cond = keep_row if keep_row is not None else F.lit(True)
    good = df.groupBy(source).agg(F.count_if(cond).alias("_n")).filter(F.col("_n") > 0).select(source)
    return df.join(good, source, "left_semi")


def flatten_items(df: DataFrame, subject: str, items: str, item_map: Mapping[str, str],
                  invert: Sequence[str] = (), out_levels: Sequence[str] | None = None) -> DataFrame:
    """Nested questionnaire -> one row per subject, one column per mapped item.

    ``item[]`` is exploded, leading zeros are stripped from ``link_id``, ids are
    mapped through a broadcast rule table, answers become 0/1 (inverted
    features get 1 - value), and ``pivot`` with the fixed feature list
    builds the columns (no extra pass to find pivot values)."""
    spark = df.sparkSession
    dim = spark.createDataFrame(sorted(item_map.items()), "link string, feature string")
    ex = df.select(subject, F.posexplode(items).alias("_at", "_it"))
    link = F.ltrim(F.col("_it.link_id").cast("string"), F.lit("0"))
    ex = ex.select(subject, "_at", F.when(link == "", "0").otherwise(link).alias("link"),
                   F.coalesce(F.col("_it.answer").cast("double"), F.lit(0.0)).alias("val"))
    j = ex.join(bounded_broadcast(dim), "link")
    j = j.withColumn("val", F.when(F.col("feature").isin(list(invert)), 1.0 - F.col("val")).otherwise(F.col("val")))
    levels = list(out_levels or dict.fromkeys(item_map.values()))
    return j.groupBy(subject).pivot("feature", levels).agg(F.max_by("val", "_at"))  # of a repeated item the last answer


def zip_member_lines(spark: SparkSession, path: str, suffixes: Sequence[str] = (".data", ".csv")) -> DataFrame:
    """First member with a wanted suffix of each zip file, as text lines
    (binaryFile source, one zip per row, decoded in ``mapInPandas``)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def lines(batches):
        for pdf in batches:
            out_path, out_line = [], []
            for p, blob in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(blob))) as z:
                    names = [n for n in z.namelist() if n.endswith(tuple(suffixes))]
                    if not names:
                        continue
                    text = z.read(names[0]).decode("utf-8", errors="replace")
                    for ln in text.splitlines():
                        out_path.append(p)
                        out_line.append(ln)
            yield pd.DataFrame({"path": out_path, "value": out_line})

    return raw.mapInPandas(lines, "path string, value string")


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str | None:
    """First candidate path that exists (driver-side path resolution only)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for c in candidates:
        p = jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(conf).exists(p):
            return c
    return None
