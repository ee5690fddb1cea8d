"""Writing results: a target must be absent or empty, and nothing is published before all of it is ready."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def guard_target(spark: SparkSession, path: str) -> None:
    """Raises if there is a file at the path, or a folder that isn't empty."""
    fs, p = _folder(spark, path)
    if fs.exists(p) and (fs.getFileStatus(p).isFile() or len(fs.listStatus(p)) > 0):
        raise ValueError(f"{path} must be absent or empty; results are never overwritten")


def publish(tables: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """Writes the tables beside the target first and moves them there in one step when all of them are written, so that a failure
    leaves no result. kind: parquet or csv (with a header). On an object store, moving a folder is not one step."""
    spark = next(iter(tables.values())).sparkSession
    guard_target(spark, path)
    draft = f"{path.rstrip('/')}.draft-{uuid.uuid4().hex}"
    fs, source = _folder(spark, draft)
    try:
        for name, df in tables.items():
            writer = df.write.option("header", True) if kind == "csv" else df.write
            writer.format(kind).save(f"{draft}/{name}")
        _, target = _folder(spark, path)
        if fs.exists(target):
            fs.delete(target, False)  # empty, as checked; a folder that has been filled since makes this fail
        if not fs.rename(source, target):
            raise OSError(f"{draft} can't be moved to {path}")
    finally:
        if fs.exists(source):
            fs.delete(source, True)


POINTER = "current.json"


def publish_by_pointer(tables: dict[str, DataFrame], path: str, kind: str = "parquet") -> str:
    """publish for object stores: the tables are written to a folder of their own under the path, and a small file that names it is put
    there last, only if there is none, which is the one step that makes them the result. Of several writers the first to put it wins;
    another raises and takes its own folder away, as a failure does. The store has to refuse to create a file that exists."""
    spark = next(iter(tables.values())).sparkSession
    version = f"version-{uuid.uuid4().hex}"
    fs, folder = _folder(spark, f"{path.rstrip('/')}/{version}")
    _, pointer = _folder(spark, f"{path.rstrip('/')}/{POINTER}")
    if fs.exists(pointer):
        raise ValueError(f"{path} has a result; results are never overwritten")
    try:
        for name, df in tables.items():
            writer = df.write.option("header", True) if kind == "csv" else df.write
            writer.format(kind).save(f"{path.rstrip('/')}/{version}/{name}")
        out = fs.create(pointer, False)  # fails if another writer's is there
        try:
            out.write(bytearray(json.dumps({"version": version, "kind": kind, "tables": sorted(tables)}).encode()))
        finally:
            out.close()
    except Exception:
        fs.delete(folder, True)
        raise
    return version


def published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that the pointer at a path names."""
    at = path.rstrip("/")
    named = json.loads(spark.read.text(f"{at}/{POINTER}", wholetext=True).first()[0])
    reader = spark.read.option("header", True) if named["kind"] == "csv" else spark.read
    return {t: reader.format(named["kind"]).load(f"{at}/{named['version']}/{t}") for t in named["tables"]}


def names_digest(features: list[str]) -> str:
    return hashlib.sha256(json.dumps(features).encode()).hexdigest()


def save_model(model: PipelineModel, path: str, features: list[str], train: DataFrame, id_col: str, label: str, candidate: str) -> None:
    """A fitted pipeline in `model` and its contract as one row in `manifest`: the features in order and their digest, the training
    rows' number, positives and order-free digest of ids and labels, and the candidate's name."""
    spark = train.sparkSession
    guard_target(spark, path)
    manifest = train.agg(
        F.lit(candidate).alias("candidate"), F.array(*map(F.lit, features)).alias("features"), F.lit(names_digest(features)).alias("features_sha256"), F.count("*").alias("n_rows"),
        F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("positives"), rows_digest(id_col, label).alias("rows_digest"),
    )
    model.write().save(f"{path}/model")
    manifest.coalesce(1).write.parquet(f"{path}/manifest")


def rows_digest(*columns: str):
    """An aggregate that depends on the rows and how often they occur, not on their order."""
    return F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """The pipeline and its manifest, whose feature names must still have their digest."""
    manifest = spark.read.parquet(f"{path}/manifest").first().asDict()
    if names_digest(list(manifest["features"])) != manifest["features_sha256"]:
        raise ValueError("the manifest's features were changed")
    return PipelineModel.load(f"{path}/model"), manifest
