"""Ingest with exact deduplication: a plan says of each source file whether it is known, a copy, or to be moved, and where."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vireo.operators.review import uniquified


def exact_dupes(files: DataFrame) -> DataFrame:
    """origin, sha256 and exact_dupe_of: the least origin with the same digest, for all files but that one."""
    first = files.groupBy("sha256").agg(F.min("origin").alias("exact_dupe_of"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return files.join(first, "sha256").filter("origin <> exact_dupe_of").select("origin", "sha256", "exact_dupe_of")


def pull_plan(files: DataFrame, manifest: DataFrame, pool: str) -> DataFrame:
    """origin, action (already, exact_dupe or move), dest and exact_dupe_of for every file.

    files: origin, source, rel, sha256, size. manifest: origin, pool_path, sha256 of files moved before. Of new files with one
    digest the least origin moves, unless the pool has that digest.
    """
    known = manifest.filter("pool_path IS NOT NULL")
    seen = known.select("origin").distinct().withColumn("_already", F.lit(True))
    held = known.groupBy("sha256").agg(F.min("pool_path").alias("_pool"))
    rows = files.join(seen, "origin", "left").join(held, "sha256", "left")
    fresh = rows.filter("_already IS NULL AND _pool IS NULL")
    first = fresh.groupBy("sha256").agg(F.min("origin").alias("_first"))
    rows = rows.join(first, "sha256", "left")
    action = F.when(F.col("_already"), "already").when(F.col("_pool").isNotNull() | (F.col("_first") != F.col("origin")), "exact_dupe").otherwise("move")
    rows = rows.withColumn("action", action)
    path = F.concat_ws("/", F.lit(pool), "source", "rel")
    moving = rows.filter("action = 'move'").select("origin", F.regexp_replace(path, "/[^/]*$", "").alias("folder"), F.element_at(F.split("rel", "/"), -1).alias("name"))
    dest = uniquified(moving, manifest.filter("pool_path IS NOT NULL").select(F.col("pool_path").alias("dest"))).select("origin", "dest")
    rows = rows.join(dest, "origin", "left")
    of = F.when(F.col("action") == "exact_dupe", F.coalesce("_pool", "_first"))
    return rows.select("origin", "sha256", "size", "action", "dest", of.alias("exact_dupe_of"))


def summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("n"))


def manifest_rows(done: DataFrame, at: float) -> DataFrame:
    """Rows to append to the manifest after execution: moves that succeeded, and copies (each origin once)."""
    moved = done.filter("action = 'move' AND ok").select(F.lit("moved").alias("kind"), "origin", F.col("dest").alias("pool_path"), F.lit(None).cast("string").alias("exact_dupe_of"), "sha256", "size")
    copies = done.filter("action = 'exact_dupe'").select(F.lit("dupe").alias("kind"), "origin", F.lit(None).cast("string").alias("pool_path"), "exact_dupe_of", "sha256", "size")
    return moved.unionByName(copies).withColumn("at", F.lit(at))
