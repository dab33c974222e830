"""Sources and sinks.

Readers take explicit options; the format follows the file extension unless given.
Writers are plain DataFrame writes, partitioned by (model_id, version) for run tables.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet", ".pq": "parquet", ".orc": "orc"}


def read_table(spark: SparkSession, path: str | None = None, df: DataFrame | None = None,
               fmt: str | None = None, multi_line: bool | None = None, **options) -> DataFrame:
    """Load a table. An in-memory DataFrame wins over a path (S5). CSV: header and inferred
    types (S1); JSON: array-of-objects or one object per file, multi-line, or JSON lines (S3), as
    ``multi_line`` says or else as the files begin; Parquet (S4)."""
    if df is not None:
        return df
    if path is None:
        raise ValueError("either df or path is required")
    fmt = fmt or FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower(), "parquet")
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", "true").option("inferSchema", "true")
    elif fmt == "json" and "multiline" not in {k.lower() for k in options}:
        whole = _json_whole_files(spark, path) if multi_line is None else multi_line
        reader = reader.option("multiLine", str(whole).lower())      # one array-of-objects / one object per file
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.format(fmt).load(path)


def _json_whole_files(spark: SparkSession, path: str) -> bool:
    """Whether the files' first lines are no records by themselves, so that each file is read whole. Spark reads
    them, so a file, a folder, a URI and a remote path are judged alike, lines of any length too."""
    lines = (spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("line"), "_metadata.file_path",
                                          F.struct(F.col("_metadata.file_block_start").alias("block"),
                                                   F.monotonically_increasing_id().alias("row")).alias("at"))
             .where("line rlike '[^ \\\\t\\\\r]'"))
    first = lines.groupBy("file_path").agg(F.min_by("line", "at").alias("line"))
    record = F.from_json("line", "bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    # a line that is an array by itself is a line of records
    opens = F.col("line").rlike("^\\s*[\\[{]") & record["bad"].isNotNull() & F.json_array_length("line").isNull()
    kinds = {bool(r[0]) for r in first.select(opens).distinct().collect()}
    if len(kinds) > 1:
        raise ValueError(f"{path} holds both JSON lines and files to be read whole; read them apart, or give multi_line")
    return kinds == {True}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write a result table (predictions S14, metrics, profiles)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def report_json(df: DataFrame, max_array: int = 100) -> DataFrame:
    """One JSON text per row with array columns cut to ``max_array`` elements."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "array":
            cols.append(F.slice(F.col(f.name), 1, max_array).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(F.to_json(F.struct(*cols)).alias("json"))
