"""What a pool of images holds: its tables loaded and saved, and a one-row status."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vireo.plans.schema import MANIFEST

VERSION = 1


def load_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """A saved table (hashes, edges, manifest rows); None where there is none, or none that can be read."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return None
    return found.select(*schema.names) if set(schema.names) <= set(found.columns) else None


def save_table(rows: DataFrame, path: str) -> None:
    """rows as the table at path, in the place of what was there. They must not be read from it."""
    rows.write.mode("overwrite").parquet(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The files of a manifest in JSON (one object: version, created_at, sources, files), one row each; None where it is missing or unreadable."""
    try:
        found = spark.read.schema(MANIFEST).option("multiLine", "true").option("mode", "FAILFAST").json(path)
        if not found.filter("files IS NOT NULL").limit(1).count():
            return None
    except Exception as e:  # Spark tells a missing path, and JSON that is none, by errors of several kinds
        if not _is_about_input(e):
            raise
        return None
    return found.select(F.explode("files").alias("f")).select("f.*")


def _is_about_input(e: Exception) -> bool:
    text = str(e)
    return isinstance(e, AnalysisException) or any(x in text for x in ("MALFORMED_RECORD", "FAILED_READ_FILE", "Malformed", "JsonParse"))


def manifest_document(files: DataFrame, created_at: str) -> DataFrame:
    """One row, value: the manifest in JSON. A manifest in this form is one object by its format; manifests of any size are tables of rows, see pull.manifest_rows()."""
    rows = F.array_sort(F.collect_list(F.struct(*files.columns)))
    whole = F.struct(F.lit(VERSION).alias("version"), F.lit(created_at).alias("created_at"), F.array_sort(F.collect_set(F.regexp_extract("origin", "^(.*)/[^/]*$", 1))).alias("sources"), rows.alias("files"))
    return files.agg(F.to_json(whole).alias("value"))


def save_manifest(files: DataFrame, path: str, created_at: str) -> None:
    """The manifest as JSON below path."""
    manifest_document(files, created_at).coalesce(1).write.mode("overwrite").text(path)


def pool_status(listing: DataFrame, manifest: DataFrame | None, hashes: DataFrame | None, edges: DataFrame | None) -> DataFrame:
    """One row: images_on_disk, has_manifest, manifest_files, hashed and has_edges; None stands for a table that isn't there."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    none = lambda name: listing.sparkSession.range(1).select(F.lit(0).cast("long").alias(name))
    out = count(listing, "images_on_disk")
    for df, name in ((manifest, "manifest_files"), (hashes, "hashed")):
        out = out.crossJoin(none(name) if df is None else count(df, name))  # one row with one row
    return out.select("images_on_disk", F.lit(manifest is not None).alias("has_manifest"), "manifest_files", "hashed", F.lit(edges is not None).alias("has_edges"))

