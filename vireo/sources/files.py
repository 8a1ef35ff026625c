"""Listing and reading of image trees. Names that begin with _ are kept, which Spark's own listing hides; dot names are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from vireo.functions.scalar import has_dot_part, is_image
from vireo.sources import tree

def listing(spark: SparkSession, root: str) -> DataFrame:
    """Image files below root: filepath, rel, size, mtime and ctime, by the image_tree source."""
    tree.register(spark)
    return spark.read.format("image_tree").load(root)


def scannable(rel: Column) -> Column:
    """What a listing keeps, as an expression over relative paths."""
    return is_image(rel) & ~has_dot_part(rel)


def with_content(files: DataFrame) -> DataFrame:
    """files with content (binary; null where unreadable) and sha256 of it."""

    def read(batches):
        for pdf in batches:
            content = []
            for path in pdf["filepath"]:
                try:
                    with open(path, "rb") as f:
                        content.append(f.read())
                except OSError:
                    content.append(None)
            yield pdf.assign(content=content)

    out = files.mapInPandas(read, StructType([*files.schema.fields, StructField("content", BinaryType())]))
    return out.withColumn("sha256", F.sha2("content", 256))
