"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn

from vireo.operators.components import ONE_TASK, connected_components, roots_of
from vireo.plans.tables import materialize

SHARE = 200_000  # edges of a share, about: some seconds


@udtf
class Families:
    """``SELECT * FROM families(TABLE(edges), 12)``: family_id, key and min_dist of edges (a, b, d) within a threshold.

    A table function sees its table in one task, so it takes ONE_TASK edges within the threshold at most (some 32 MB), and says so
    beyond. A table with a column share is dealt to tasks by it, and what comes back are the families of each share alone, in which
    a key may be more than once; all_families() puts those together, for any number of edges.
    """

    @staticmethod
    def analyze(edges: AnalyzeArgument, threshold: AnalyzeArgument) -> AnalyzeResult:
        names = edges.dataType.fieldNames() if edges.isTable else []
        if not {"a", "b", "d"} <= set(names):
            raise ValueError("families() takes a TABLE with the columns a, b and d, and a threshold")
        if not isinstance(threshold.value, int):
            raise ValueError("the threshold of families() is a whole number")
        schema = StructType([StructField("family_id", LongType()), StructField("key", LongType()), StructField("min_dist", IntegerType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("share")]) if "share" in names else AnalyzeResult(schema, withSinglePartition=True)

    def __init__(self) -> None:
        self.held: list[tuple[int, int, int]] = []

    def eval(self, edge: Row, threshold: int) -> Iterator[tuple]:
        if edge["d"] is not None and edge["d"] <= threshold and edge["a"] != edge["b"]:
            self.held.append((edge["a"], edge["b"], edge["d"]))
            if len(self.held) > ONE_TASK:
                raise ValueError(f"families() takes {ONE_TASK} edges at most; give them a column share, or use all_families()")
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            a, b, d = (np.array(c, dtype=np.int64) for c in zip(*self.held))
            nodes, roots = roots_of(a, b)
            near = np.full(len(nodes), np.iinfo(np.int64).max)
            for ends in (a, b):
                np.minimum.at(near, np.searchsorted(nodes, ends), d)
            yield from zip(roots.tolist(), nodes.tolist(), near.tolist())


def all_families(edges: DataFrame, threshold: int, share: int = SHARE) -> DataFrame:
    """What families() gives of a written table of edges, by families() over shares of it, joined where they have keys in common."""
    register(edges.sparkSession)
    shares = max(1, -(-edges.count() // share))
    dealt = edges.withColumn("share", F.pmod(F.xxhash64("a", "b"), F.lit(shares)).cast("int"))
    found = materialize(edges.sparkSession.sql(f"SELECT * FROM families(TABLE({{dealt}}), {threshold})", dealt=dealt))
    if shares == 1:
        return found
    roots = connected_components(found.select(F.col("family_id").alias("a"), F.col("key").alias("b"))).select(F.col("node").alias("key"), F.col("root").alias("family_id"))
    return roots.join(found.groupBy("key").agg(F.min("min_dist").alias("min_dist")), "key").select("family_id", "key", "min_dist")


def register(spark: SparkSession) -> None:
    spark.udtf.register("families", Families)
