"""Reading and writing series, forecasts and features.

The long forms are tables on disk: a writer that commits whole jobs, a folder
per model or feature, and readers, batch and stream, whose filters on that
column leave out folders and whose other filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import Series


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None, **options) -> DataFrame:
    """Any of Spark's sources; the format is taken from the path if not given."""
    fmt = fmt or next((f for f in ("parquet", "csv", "json", "orc", "avro") if path.rstrip("/").endswith(f".{f}")), "parquet")
    reader = spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def read_series_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files ``timestamp,value``; ``series_id`` is the file's name without its ending."""
    rows = spark.read.schema("timestamp string, value double").option("header", "true").csv(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.csv)?(?:\.gz)?$", 1)
    return rows.select(name.alias("series_id"), F.to_timestamp("timestamp").alias("ds"), F.col("value").alias("y"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options) -> None:
    w = df.write.format(fmt).mode(mode).options(**({"header": "true"} if fmt == "csv" else {})).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def long_forecasts(f: DataFrame, s: Series) -> DataFrame:
    """``series_type, model, step, forecast`` of those forecasts there are."""
    return f.where("status = 'ok'").select(F.concat_ws("|", *s.keys).alias("series_type"), "model", F.col("h").alias("step"), F.col("yhat").alias("forecast"))


def long_intervals(f: DataFrame, s: Series) -> DataFrame:
    """``series_type, model, step, level, lower, upper``."""
    return f.where("status = 'ok'").select(F.concat_ws("|", *s.keys).alias("series_type"), "model", F.col("h").alias("step"), "level", F.col("lo").alias("lower"), F.col("hi").alias("upper"))


def long_features(f: DataFrame, s: Series) -> DataFrame:
    """``series_type, feature_name, value`` of a wide frame of features."""
    names = [c for c in f.columns if c not in s.keys]
    pairs = F.array(*(F.struct(F.lit(c).alias("feature_name"), F.col(c).cast("double").alias("value")) for c in names))
    return f.select(F.concat_ws("|", *s.keys).alias("series_type"), F.explode(pairs).alias("x")).select("series_type", "x.*")


#: The long forms: columns, and the one whose values are folders.
FORMS = {
    "forecasts": ("series_type string, model string, step int, forecast double", "model"),
    "intervals": ("series_type string, model string, step int, level double, lower double, upper double", "model"),
    "features": ("series_type string, feature_name string, value double", "feature_name"),
}

#: Text survives as it is: quotes are doubled, blanks at the ends kept.
_CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_long(df: DataFrame, path: str, form: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Write a long frame (``forecasts``, ``intervals``, ``features``) below ``path``.

    Columns that the form does not have are left out. Rows are in no folder
    before the job commits; with ``append`` a later job adds to what is there.
    CSV has a row a line, so a series with a line break in its name is an
    error there, and one whose name is empty is read back as NULL; Parquet
    takes any. A model or feature that is NULL has a folder of its own; one
    that is empty is read back as NULL.
    """
    schema, folder = FORMS[form]
    columns = [c.split() for c in schema.split(", ")]
    rows = df.select(*(F.col(c).cast(kind).alias(c) for c, kind in columns))
    if fmt == "csv":
        broken = F.raise_error(F.lit("a name with a line break cannot be written as CSV"))
        rows = rows.withColumn("series_type", F.when(F.col("series_type").rlike(r"[\r\n]"), broken.cast("string")).otherwise(F.col("series_type")))
    rows.write.format(fmt).mode(mode).options(**(_CSV if fmt == "csv" else {})).partitionBy(folder).save(path)


def _long(reader, path: str, form: str, fmt: str) -> DataFrame:
    schema, _ = FORMS[form]
    reader = reader.format(fmt).schema(schema).options(**({**_CSV, "mode": "FAILFAST", "enforceSchema": "false"} if fmt == "csv" else {}))
    return reader.load(path).select(*(c.split()[0] for c in schema.split(", ")))


def read_long(spark: SparkSession, path: str, form: str, fmt: str = "csv") -> DataFrame:
    """What :func:`write_long` wrote. A file with other columns or a value that is
    not of its column's type is an error when it is read."""
    return _long(spark.read, path, form, fmt)


def stream_long(spark: SparkSession, path: str, form: str, fmt: str = "csv", files: int = 1000) -> DataFrame:
    """The same as a stream: ``files`` files a batch, and those that later jobs add."""
    return _long(spark.readStream.option("maxFilesPerTrigger", files), path, form, fmt)
