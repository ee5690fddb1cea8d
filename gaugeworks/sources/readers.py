"""Readers of the formats that the contracts start from. Bad cells stay visible as text until a contract judges them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def matrix(spark: SparkSession, path: str, prefix: str = "feature_") -> DataFrame:
    """A matrix of numbers parted by white space, NaN for missing: file, line (by position in its file) and features array."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("cells"))
    return rows.select("file", "line", F.transform("cells", lambda x: F.nullif(x.try_cast("double"), F.lit(float("nan")))).alias("features"))


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """Digest and length of each file. Spark doesn't list empty files, so the gate counts them as absent."""
    return spark.read.format("binaryFile").load(path).select(F.col("path"), F.sha2("content", 256).alias("sha256"), "length")


def hash_gate(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose hash isn't the expected one. expected: (path, sha256)."""
    return expected.withColumnRenamed("sha256", "wanted").join(found, "path", "left").where(~F.col("wanted").eqNullSafe(F.col("sha256")))


def table_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text."""
    return spark.read.csv(path, header=True, sep=sep, inferSchema=False)


def series_csv(spark: SparkSession, path: str) -> DataFrame:
    """Strict (timestamp, value): the header must be that, empty is null, anything else raises."""
    return spark.read.csv(path, schema="timestamp timestamp, value double", header=True, enforceSchema=False, mode="FAILFAST")


def sensor_parquet(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    df = spark.read.parquet(*paths)
    if sorted(df.columns) != sorted(columns):
        raise ValueError(f"columns {df.columns}; expected {columns}")
    return df.withColumn("file_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))


READING = "asset_code string, user_ts string, ts string, reading map<string,double>"


def readings_json(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold an array of readings or an object with `readings`, or lines of one reading each. A file that is none of these raises."""
    one = "struct<asset_code:string,user_ts:string,ts:string,reading:map<string,double>>"
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    array = F.when(F.col("value").startswith("["), F.from_json("value", f"array<{one}>"))
    inside = F.from_json("value", f"struct<readings:array<{one}>>")["readings"]
    lines = F.transform(F.filter(F.split("value", r"\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, one))
    lines = F.when(~F.exists(lines, lambda r: F.coalesce(r["asset_code"].isNull() & r["reading"].isNull(), F.lit(True))), lines)
    found = F.coalesce(array, inside, F.when(~F.col("value").startswith("["), lines), F.raise_error(F.concat(F.lit("no readings in "), "file")).cast(f"array<{one}>"))
    return text.where("value <> ''").select(F.explode(found).alias("r")).select("r.*")


#: Texts that stand for a missing number.
MISSING = ("", "nan", "NaN", "NAN", "inf", "-inf", "+inf", "Inf", "INF", "Infinity", "-Infinity")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def sensor_csv(spark: SparkSession, path: str, axes: list[str], time: str = "Time") -> DataFrame:
    """Sensor files with exactly the columns time and axes: (file_id, line, t, axes, reasons). Missing tokens are null; a malformed
    number is a reason (`time_nonfinite_or_nonnumeric`, `value_nonnumeric`), and so is a row of another width."""
    names = [time, *axes]
    df = spark.read.csv(path, schema=", ".join(f"`{n}` string" for n in [*names, "_corrupt_record"]), header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    df = df.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file_id"), F.monotonically_increasing_id().alias("line"), *[F.trim(F.coalesce(n, F.lit(""))).alias(n) for n in names], F.col("_corrupt_record").isNotNull().alias("_odd"))
    good = lambda n: F.col(n).rlike(NUMBER)
    bad = F.array_compact(F.array(F.when(F.col("_odd"), "row_shape_invalid"), F.when(~good(time), "time_nonfinite_or_nonnumeric"), *[F.when(~good(a) & ~F.col(a).isin(*MISSING), "value_nonnumeric") for a in axes]))
    return df.select("file_id", "line", F.when(good(time), F.col(time).cast("double")).alias("t"), *[F.when(good(a), F.col(a).cast("double")).alias(a) for a in axes], F.array_distinct(bad).alias("reasons"))


def labelled_csv(spark: SparkSession, path: str, id_col: str, ts: str, label: str, prefix: str, expected: int | None = None) -> DataFrame:
    """A labelled table by its column roles: id as text, ts as text, label, and the features (columns with the prefix, by name) as
    numbers; a cell that is no number is null and named in bad_cells. Another number of features than expected raises."""
    df = table_csv(spark, path)
    features = sorted(c for c in df.columns if c.startswith(prefix))
    if lacking := [c for c in (id_col, ts, label) if c not in df.columns]:
        raise ValueError(f"columns {lacking} are absent")
    if not features or (expected is not None and len(features) != expected):
        raise ValueError(f"{len(features)} feature columns; expected {expected}")
    bad = F.array_compact(F.array(*[F.when((F.trim(c) != "") & F.col(c).try_cast("double").isNull(), F.lit(c)) for c in features]))
    return df.select(id_col, ts, F.col(label).try_cast("int").alias(label), *[F.col(c).try_cast("double").alias(c) for c in features], bad.alias("bad_cells"))


def hourly_json(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Rows (file, time, fields) of objects with outputs.hourly; a file without it raises."""
    row = ",".join(f"`{f}`:double" for f in fields)
    df = spark.read.json(path, multiLine=True, schema=f"outputs struct<hourly:array<struct<time:string,{row}>>>").select(F.col("_metadata.file_path").alias("file"), F.col("outputs.hourly").alias("hourly"))
    return df.select("file", F.explode(F.coalesce("hourly", F.raise_error(F.concat(F.lit("no hourly outputs in "), "file")).cast(f"array<struct<time:string,{row}>>"))).alias("r")).select("file", "r.*")


def station_year(spark: SparkSession, path: str, station: str, year: int, columns: list[str], station_col: str = "NUM_POSTE", time_col: str = "AAAAMMJJHH") -> DataFrame:
    """One station's hours of one year from (gzipped) semicolon files: (station, hour, columns as numbers). Only these columns are read."""
    df = table_csv(spark, path, sep=";").select(station_col, time_col, *columns)
    hour = F.try_to_timestamp(F.trim(time_col), F.lit("yyyyMMddHH"))
    return df.where((F.trim(station_col) == station) & (F.substring(F.trim(time_col), 1, 4) == str(year))).select(F.trim(station_col).alias("station"), hour.alias("hour"), *[F.col(c).try_cast("double").alias(c) for c in columns])


def named_rows(df: DataFrame, json: str) -> DataFrame:
    """Rows of {"meta": [names], "data": [[cells]]} as maps; a row of another length, or a repeated name, raises."""
    parsed = F.from_json(json, "struct<meta:array<string>,data:array<array<string>>>")
    rows = df.select(parsed.alias("p")).select("p.meta", F.explode("p.data").alias("row"))
    ok = (F.size("meta") == F.size("row")) & (F.size(F.array_distinct("meta")) == F.size("meta"))
    return rows.select(F.when(ok, F.map_from_arrays("meta", "row")).otherwise(F.raise_error(F.lit("names and cells don't match"))).alias("row"))


def reading_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files of one reading a line, as they come."""
    return spark.readStream.schema(READING).json(folder)
