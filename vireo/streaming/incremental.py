"""Incremental work as Structured Streaming: files are hashed once, and review events fold into the last state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType

from vireo.functions.pixels import file_hashes
from vireo.operators import dupes
from vireo.plans.schema import _of
from vireo.plans.store import Table
from vireo.plans.tables import materialize
from vireo.sources import tree
from vireo.sources.files import with_content


def append_new(source: DataFrame, target: str, key: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Everything that has come since the last run, once: rows whose key the target table lacks are transformed and appended. Batches that are run again add nothing."""

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.parquet(target).select(key), key, "left_anti")
        (transform(fresh) if transform else fresh).withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(target)

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def image_stream(spark: SparkSession, root: str, log: str) -> DataFrame:
    """A stream of the image files below root, each path once, by the image_tree source. log: a folder that all executors share, for what was given."""
    tree.register(spark)
    return spark.readStream.format("image_tree").option("log", log).load(root)


def hash_new_images(spark: SparkSession, root: str, target: str, checkpoint: str) -> StreamingQuery:
    """Hash what is new below root into the table target: filepath, rel, size, mtime, ph, dh, error and v. Files are read when they are known to be new."""
    hashed = lambda df: file_hashes(with_content(df).drop("sha256")).select("filepath", "rel", "size", "mtime", "ph", "dh", "error", F.lit(2).alias("v"))
    return append_new(image_stream(spark, root, f"{checkpoint}/given"), target, "filepath", checkpoint, hashed)


class FamilyState:
    """Hashes, edges and roots of families that grow with each batch of new hashes: what is known is never compared again.

    Each table changes by whole steps. Hashes are appended last: a step that died before that is done again, and its edges and roots
    are then the same ones once more, which families bear.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: int, columns: list[str]) -> None:
        self.threshold, self.columns = threshold, columns
        self.hashes = Table(spark, f"{path}/hashes", _of(key=LongType(), **dict.fromkeys(columns, LongType())))
        self.edges = Table(spark, f"{path}/edges", _of(a=LongType(), b=LongType(), d=IntegerType()))
        self.roots = Table(spark, f"{path}/roots", _of(node=LongType(), root=LongType()))

    def add(self, hashes: DataFrame) -> None:
        """hashes: key and the columns. Keys that are known are left out."""
        known = self.hashes.read()
        fresh = materialize(hashes.select("key", *self.columns).dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti"))
        if fresh.isEmpty():
            return
        links = materialize(dupes.new_edges(fresh, known, self.threshold, self.columns))
        at = self.roots.number()
        self.edges.append(links)
        self.roots.replace(dupes.merged_roots(self.roots.read(), links), at)
        self.hashes.append(fresh)

    def add_stream(self, hashes: DataFrame, checkpoint: str) -> StreamingQuery:
        """add() each batch of a stream that is there now."""
        return hashes.writeStream.foreachBatch(lambda batch, number: self.add(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def families(self) -> DataFrame:
        """family_id, key and min_dist, as dupes.families() over all hashes."""
        return dupes.members_of(self.roots.read(), self.edges.read())


def fold_review(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The last value of each key over a stream, for output mode update or complete."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def edges_are_stale(edges_batch: int | None, hashes_batch: int | None) -> bool:
    """Whether edges were made before the last batch of hashes: by batch numbers, not clocks."""
    return hashes_batch is not None and (edges_batch is None or edges_batch < hashes_batch)
