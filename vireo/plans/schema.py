"""Schemas of the catalog's tables."""

from pyspark.sql import types as T

_L, _I, _D, _S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()


def _of(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in columns.items()])


IMAGES = _of(
    id=_L, filepath=_S, filename=_S, directory=_S, filesize=_L, width=_I, height=_I, prompt=_S, workflow=_S, model=_S, seed=_S, file_created=_D, file_modified=_D,
    rating=_I, flag=_I, rejected=_I, tags=_S, notes=_S, indexed_at=_D, sharpness=_D, brightness=_D, contrast=_D, saturation=_D, entropy=_D, quality_score=_D,
    is_grayscale=_I, mean_color=_S, unique_colors=_I, file_corrupt=_I, analyzed_at=_D,
)
#: Columns of IMAGES that are measured, by id.
IMAGES_METRICS = T.StructType([f for f in IMAGES.fields if f.name in ("id", "sharpness", "brightness", "contrast", "saturation", "entropy", "quality_score", "is_grayscale", "mean_color", "unique_colors", "file_corrupt", "analyzed_at")])
REVIEW_LOG = _of(id=_L, field=_S, value=_S, at=_D)
SESSION_STATE = _of(key=_S, value=_S)
HASHES = _of(rel=_S, ph=_L, dh=_L, mtime=_D, size=_L, v=_I)
EDGES = _of(a=_L, b=_L, d=_I)
MANIFEST_FILES = _of(kind=_S, origin=_S, pool_path=_S, exact_dupe_of=_S, sha256=_S, size=_L, at=_D)
METRICS = _of(
    width=_I, height=_I, aspect_ratio=_D, file_corrupt=_I, is_grayscale=_I, mean_color=T.ArrayType(_I), sharpness=_D, brightness=_D, contrast=_D, saturation=_D, entropy=_D, unique_colors=_I,
)
HASH_PAIR = _of(ph=_L, dh=_L, error=_S)
GRAPH_FIELDS = _of(prompt=_S, model=_S, seed=_S)
METADATA = _of(width=_I, height=_I, prompt=_S, model=_S, seed=_S, workflow=_S)
#: A manifest in JSON.
MANIFEST = T.StructType([
    T.StructField("version", _I), T.StructField("created_at", _S), T.StructField("sources", T.ArrayType(_S)),
    T.StructField("files", T.ArrayType(_of(origin=_S, pool_path=_S, exact_dupe_of=_S, sha256=_S, size=_L, moved_at=_D, skipped_at=_D))),
])
