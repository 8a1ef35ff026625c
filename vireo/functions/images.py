"""Arrow functions over image bytes, to be used in select() or registered for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from vireo.functions import kernels, metadata
from vireo.plans.schema import GRAPH_FIELDS, HASH_PAIR, METADATA, METRICS
from vireo.sources import png


@F.pandas_udf(HASH_PAIR)
def image_hashes(content: pd.Series) -> pd.DataFrame:
    rows = []
    for data in content:
        px = png.decode(data) if data is not None else None
        rows.append((None, None, "not a readable PNG") if px is None else (kernels.phash(px), kernels.dhash(px), None))
    return pd.DataFrame(rows, columns=["ph", "dh", "error"]).astype({"ph": "Int64", "dh": "Int64"})


@F.pandas_udf(METRICS)
def image_metrics(content: pd.Series) -> pd.DataFrame:
    found = [kernels.metrics(png.decode(data) if data is not None else None) for data in content]
    out = pd.DataFrame(found, columns=METRICS.names)
    return out.astype({c: "Int32" for c in ("width", "height", "file_corrupt", "is_grayscale", "unique_colors")})


@F.pandas_udf(METADATA)
def png_metadata(content: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([metadata.extract(data) for data in content], columns=["width", "height", "prompt", "model", "seed", "workflow"])
    return out.astype({"width": "Int32", "height": "Int32"})


@F.pandas_udf(BinaryType())
def thumbnail_png(content: pd.Series) -> pd.Series:
    """A PNG of at most 400 pixels a side; null where the image can't be read."""
    out = []
    for data in content:
        px = png.decode(data) if data is not None else None
        out.append(None if px is None else png.encode(kernels.thumbnail(px, 400)))
    return pd.Series(out)


@F.pandas_udf(GRAPH_FIELDS)
def graph_metadata(graph: pd.Series) -> pd.DataFrame:
    """prompt, model and seed of node graphs in JSON; all empty where a graph is malformed."""
    return pd.DataFrame([metadata.graph_text_fields(x) or metadata.EMPTY for x in graph], columns=GRAPH_FIELDS.names)


def _hash_of(kernel):
    @F.pandas_udf(LongType())
    def one(content: pd.Series) -> pd.Series:
        pixels = (png.decode(data) if data is not None else None for data in content)
        return pd.Series([None if px is None else kernel(px) for px in pixels], dtype="Int64")

    return one


phash, dhash = _hash_of(kernels.phash), _hash_of(kernels.dhash)

ARROW_FUNCTIONS = {
    "image_hashes": image_hashes, "image_metrics": image_metrics, "png_metadata": png_metadata, "thumbnail_png": thumbnail_png, "graph_metadata": graph_metadata, "phash": phash, "dhash": dhash,
}

#: SQL functions that Catalyst inlines: the same formulas as in scalar.py.
SQL_FUNCTIONS = (
    "hamming64(a BIGINT, b BIGINT) RETURNS INT RETURN bit_count(a ^ b)",
    "confidence_to_threshold(confidence INT) RETURNS INT RETURN CAST(round((100 - greatest(0, least(100, confidence))) * 0.4D) AS INT)",
    "threshold_to_confidence(threshold INT) RETURNS INT RETURN CAST(100 - threshold / 0.4D AS INT)",
    "quality_score(sharpness DOUBLE, contrast DOUBLE, entropy DOUBLE, saturation DOUBLE) RETURNS DOUBLE RETURN round(least(1.0D, log10(greatest(1.0D, coalesce(sharpness, 0.0D))) / 4.5D) * 35 + coalesce(contrast, 0.0D) * 20 + least(1.0D, coalesce(entropy, 0.0D)) * 25 + least(1.0D, coalesce(saturation, 0.0D) * 2) * 20, 1)",
)


def register(spark: SparkSession) -> None:
    """The functions of this module, and hamming64, quality_score and the confidence functions, for SQL."""
    for name, f in ARROW_FUNCTIONS.items():
        spark.udf.register(name, f)
    for text in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
