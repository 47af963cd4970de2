"""A campaign's factors on disk: a table beside a manifest, and the rules by which epochs are let in."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.errors import IngestError
from skyloom.sources.stage import stage

VERSION = 1


def shared_inputs(factors: DataFrame, represents: list[str]) -> DataFrame:
    """product, digest, n: inputs (a map of product to digest) that more than one epoch used and that no parameter represents."""
    used = factors.select("epoch", F.explode("inputs").alias("product", "digest"))
    if represents:
        used = used.where(~F.col("product").isin(*represents))
    return used.groupBy("product", "digest").agg(F.countDistinct("epoch").alias("n")).where("n > 1")


def admit(factors: DataFrame, names: list[str], represents: list[str] = ()) -> DataFrame:
    """factors, if every epoch comes once, is as wide as the names, has finite numbers and shares no input that isn't represented."""
    bad = lambda c: F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    w = len(names)
    wrong = (F.col("width") != w) | (F.size("r") != w * w) | (F.size("z") != w) | bad("r") | bad("z") | F.isnan("log_offset") | F.col("log_offset").isNull() | F.col("epoch").isNull()
    if broken := factors.where(F.coalesce(wrong, F.lit(True))).select("epoch").head():
        raise IngestError(f"epoch {broken[0]} isn't a factor over {names}")
    if twice := factors.groupBy("epoch").count().where("count > 1").head():
        raise IngestError(f"epoch {twice[0]} comes {twice[1]} times")
    if "inputs" in factors.columns and (common := shared_inputs(factors, list(represents)).head()):
        raise IngestError(f"{common[2]} epochs share {common[0]} {common[1]}, so they aren't independent")
    return factors


def save_memory(factors: DataFrame, path: str, names: list[str], represents: list[str] = ()) -> None:
    """Write admitted factors, then the manifest: a folder without one is no archive, so a write that broke off is never read."""
    spark = factors.sparkSession
    with stage(spark) as keep:  # factors are computed once
        admit(keep(factors), names, represents).write.mode("error").parquet(f"{path}/epochs")
    manifest = json.dumps({"version": VERSION, "names": list(names), "represents": list(represents)})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("error").text(f"{path}/manifest")


def load_memory(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    manifest = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest").collect()))
    if manifest.get("version") != VERSION:
        raise IngestError(f"version {manifest.get('version')} of an archive, not {VERSION}")
    if manifest["names"] != list(names):
        raise IngestError(f"an archive over {manifest['names']}, not {list(names)}")
    return admit(spark.read.parquet(f"{path}/epochs"), names, manifest["represents"])
