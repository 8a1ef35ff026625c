"""Sharding along a Hilbert curve over several metadata dimensions.

Each document becomes a cell of a grid (one axis per dimension), cells are ordered by the Hilbert curve's index, and the
ordered rows are cut into runs of equal length: law ``rows``, whose shard sizes differ by one at most. Documents that are
close in every dimension come to lie in the same shards, so that a filter on any dimension skips most files. Categories are coded by
their rank among the values that occur: files are pruned by least and greatest values, and hashes would not keep the order of those.

The order is total up to equal rows: curve index, text crc32, size, doc_id. So equal texts with equal metadata are
neighbours. Ranks come from a range partitioning plus one count per partition: no task ever sees all rows.

Defined cases: a null text has no bytes and crc32 0; nulls in a dimension share one cell value; repeated rows take
neighbouring slots, one each; an empty table gives an empty result; other columns of the input are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vireo.llm.common import materialize, read_table, text_bytes

SHARDS = 24
BITS = 8
ROW_OVERHEAD = 8  # bytes of a row beside its text


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve index of integer cells, shape (n, dimensions): Skilling's transform (AIP Conf. Proc. 707, 2004), over all rows at once."""
    x = np.ascontiguousarray(cells.T).astype(np.int64)
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work of each level
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def hilbert_column(dims: Sequence[Column], bits: int = BITS) -> Column:
    """The curve index of columns that already hold 0 to 2^bits - 1; dimensions times bits must stay within 62."""
    if len(dims) * bits > 62:
        raise ValueError("the curve index must fit 62 bits")

    @F.pandas_udf("long")
    def index(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.column_stack([c.to_numpy(np.int64) for c in cols]), bits))

    return index(*[F.coalesce(d.cast("long"), F.lit(0)) for d in dims])


def borders(docs: DataFrame, column: str, bits: int = BITS) -> list[str]:
    """The least values of up to 2^bits runs of a category's distinct values, in the order of strings: so many strings come to the driver at most."""
    values = docs.select(F.col(column).cast("string").alias("value")).filter("value IS NOT NULL").distinct()
    placed, total = ranked(values, ["value"])
    runs = min(total, (1 << bits) - 1)
    run = F.call_function("div", F.col("rank") * F.lit(runs).cast("long"), F.lit(max(total, 1)).cast("long"))
    return sorted((r["least"] for r in placed.groupBy(run.alias("run")).agg(F.min("value").alias("least")).collect()), key=lambda v: v.encode())


def rank_dimension(column: Column, least: list[str], bits: int = BITS) -> Column:
    """A category as a grid axis: the run (see borders) that a value falls in, runs spread over the whole axis. The order is that of strings,
    by which readers prune; null comes first, as it does there."""
    if not least:
        return F.lit(0).cast("long")
    at = F.size(F.filter(F.array(*map(F.lit, least)), lambda v: v <= column.cast("string")))
    return F.coalesce(F.when(column.isNull(), F.lit(0)).otherwise(at), F.lit(0)).cast("long") * ((1 << bits) - 1) / F.lit(len(least))


def log_dimension(column: Column, bits: int = BITS, per_octave: int = 8) -> Column:
    """A size as a grid axis: ``per_octave`` steps for each doubling, the last step open."""
    step = F.floor(F.log2(F.greatest(F.coalesce(column.cast("double"), F.lit(0.0)), F.lit(1.0))) * per_octave)
    return F.least(step, F.lit((1 << bits) - 1))


def ranked(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """df with rank 0 .. n-1 in the given order, and n. Rows that the order holds equal keep any order.

    One range shuffle: a row's place in its partition is the low half of monotonically_increasing_id(), and the partitions'
    offsets are a table of one row per partition.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed)
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    offsets = counts.withColumn("_offset", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    # one row per partition: as many rows as tasks, never as many as documents
    out = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn("rank", F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_offset"), total


def cut(rank: Column, total: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a rank: shard s holds ranks from ceil(s * total / shards) on."""
    n, k = F.lit(max(total, 1)).cast("long"), F.lit(shards).cast("long")
    shard = F.call_function("div", rank * k, n)
    return shard.cast("int"), rank - F.call_function("div", shard * n + k - 1, k)


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, source, lang, curve, shard and slot of every document."""
    text = text_bytes()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
    )
    axes = [rank_dimension(F.col(c), borders(rows, c, bits), bits) for c in ("source", "lang")]
    curve = hilbert_column([*axes, log_dimension(F.col("size"), bits)], bits)
    placed, total = ranked(rows.withColumn("curve", curve), ["curve", "text_crc32", "size", "doc_id"])
    shard, slot = cut(F.col("rank"), total, shards)
    return placed.withColumn("shard", shard).withColumn("slot", slot).drop("rank")


def kept_shards(ranges: DataFrame, column: str, least: object, most: object) -> DataFrame:
    """Shards that a reader opens for values of a column from least to most: those whose range meets it."""
    return ranges.filter((F.col(f"max_{column}") >= F.lit(least)) & (F.col(f"min_{column}") <= F.lit(most))).select("shard")


def shard_ranges(sharded: DataFrame) -> DataFrame:
    """What a reader prunes by: rows, bytes, and the least and greatest value of each dimension in each shard."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("source", "lang", "size", "curve") for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), *ends)


def write_shards(docs: DataFrame, sharded: DataFrame, path: str) -> None:
    """The documents' rows as one folder per shard, rows in slot order. doc_id must be a key of docs here."""
    places = sharded.select("doc_id", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = docs.join(places, "doc_id").repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    rows.drop("_slot").withColumnRenamed("_shard", "shard").write.partitionBy("shard").parquet(path)


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in SHARDS shards of as many rows, one more or less, along the curve. Awkward cases: see the module."""
    out = hilbert_shards(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
