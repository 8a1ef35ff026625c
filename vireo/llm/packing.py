"""Conflict-constrained best-fit packing of documents into training sequences of a fixed token capacity.

Open bins are kept in the order of their residual capacity. Each carries two bitmaps: the sources and the duplicate
clusters that it holds. A document goes to the tightest bin in which it fits and conflicts with nothing: the search starts
at the first residual that is large enough and goes on to its successors until a bin is compatible. No bin ever holds two
pieces of one duplicate cluster, nor two of one source.

Documents are dealt by a hash of their own columns to packing groups of a bounded sum of tokens and rows, longest first within
a group, so one source or cluster may hold any share of the rows, and bins don't depend on where rows lie in the files. Equal
rows are counted first, and told apart by a number. Only ids, lengths, sources and cluster digests are shuffled. A text of more
than ``capacity`` tokens is cut into pieces; the full ones fill a bin each.

Defined cases: a null or empty text has one token (the end mark) and is packed too; null sources conflict with nothing;
empty texts conflict with nothing; repeated rows are packed one by one and, being duplicates, apart; an empty table gives
an empty result; other columns of the input are never read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import SPACE, materialize, read_table

CAPACITY = 2048
GROUP_TOKENS = 2_000_000  # about so many tokens are packed together,
GROUP_ROWS = 20_000  # of about so many documents
BLOCK_BINS = 64

SCHEMA = "doc_id long, piece int, n_tokens long, bin long, bin_offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("n_tokens", pa.int64()), ("bin", pa.int64()), ("bin_offset", pa.int64())])


class _Block:
    """Some open bins in the order of their residuals, and the bits that all of them hold: who has one of those needn't look at any."""

    def __init__(self, residuals: list[int], bins: list[list[int]]) -> None:
        self.residuals, self.bins = residuals, bins
        self.count()

    def count(self) -> None:
        self.sources = self.clusters = -1
        for _, s, c in self.bins:
            self.sources &= s
            self.clusters &= c


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each item (length up to capacity, source bit, cluster bit), taken in the order given.

    The bits are masks with one bit set, or 0 for what conflicts with nothing. The search goes from the first residual that is
    large enough to its successors; blocks of bins that all conflict are passed over as one.
    """
    blocks: list[_Block] = []  # by residual, ascending; a bin of residual 0 leaves
    largest: list[int] = []  # each block's
    out, opened = [], 0

    def take(length: int, source: int, cluster: int) -> tuple[int, list[int]] | None:
        for k in range(bisect_left(largest, length), len(blocks)):
            b = blocks[k]
            if b.sources & source or b.clusters & cluster:
                continue
            for at in range(bisect_left(b.residuals, length), len(b.bins)):
                if not (b.bins[at][1] & source or b.bins[at][2] & cluster):
                    found = b.residuals.pop(at), b.bins.pop(at)
                    if b.bins:
                        largest[k] = b.residuals[-1]
                        b.count()
                    else:
                        del blocks[k], largest[k]
                    return found
        return None

    def put(left: int, bin_: list[int]) -> None:
        k = bisect_left(largest, left)
        if k == len(blocks):
            if not blocks:
                blocks.append(_Block([left], [bin_]))
                largest.append(left)
                return
            k -= 1
        b = blocks[k]
        at = bisect_left(b.residuals, left)
        b.residuals.insert(at, left)
        b.bins.insert(at, bin_)
        b.sources &= bin_[1]
        b.clusters &= bin_[2]
        if len(b.bins) > BLOCK_BINS:
            half = len(b.bins) // 2
            blocks[k : k + 1] = _Block(b.residuals[:half], b.bins[:half]), _Block(b.residuals[half:], b.bins[half:])
            largest[k : k + 1] = b.residuals[half - 1], b.residuals[-1]
        else:
            largest[k] = b.residuals[-1]

    for length, source, cluster in items:
        left, bin_ = take(length, source, cluster) or (capacity, [opened, 0, 0])
        opened += bin_[0] == opened
        out.append((bin_[0], capacity - left))
        left -= length
        if left:
            bin_[1] |= source
            bin_[2] |= cluster
            put(left, bin_)
    return out


def _bit(key, seen: dict) -> int:
    return 0 if key is None else 1 << seen.setdefault(key, len(seen))


def pack_group(rows: list[tuple], group: int, capacity: int) -> Iterator[tuple]:
    """rows: (doc_id, n_tokens, source, cluster) of one group."""
    pieces = []
    for r, (_, n, _, _) in enumerate(rows):
        for k, start in enumerate(range(0, n, capacity)):
            pieces.append((min(capacity, n - start), r, k))
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    sources: dict = {}
    clusters: dict = {}
    items = [(n, _bit(rows[r][2], sources), _bit(rows[r][3], clusters)) for n, r, _ in pieces]
    for (n, r, k), (b, at) in zip(pieces, best_fit(items, capacity), strict=True):
        yield rows[r][0], k, n, (group << 32) | b, at


def pack(rows: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """rows (a written table): doc_id long, n_tokens long (1 or more), source string, cluster binary. One row per piece: doc_id, piece, n_tokens, bin, bin_offset."""
    size = rows.agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).first()
    groups = max(1, -(-(size["tokens"] or 0) // group_tokens), -(-size["n"] // GROUP_ROWS))
    kinds = rows.groupBy("doc_id", "n_tokens", "source", "cluster").agg(F.count("*").alias("_n"))
    one = kinds.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    # the number spreads repeated rows and null ids, which may be any share of all
    dealt = one.withColumn("_group", F.pmod(F.xxhash64("doc_id", "cluster", "source", "n_tokens", "_copy"), F.lit(groups)))
    dealt = dealt.repartition(F.col("_group")).sortWithinPartitions("_group", "doc_id", "cluster", "n_tokens", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                found = list(pack_group(held, now, capacity))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            for doc_id, n, source, cluster, group in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != now:
                    yield from flush()
                    held, now = [], group
                held.append((doc_id, n, source, cluster))
        yield from flush()

    return dealt.select("doc_id", "n_tokens", "source", "cluster", "_group").mapInArrow(run, SCHEMA)


def packable(docs: DataFrame) -> DataFrame:
    """Lengths (words and one end mark), sources and duplicate clusters (equal texts) of documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    n = F.when(words == "", F.lit(1)).otherwise(F.size(F.split(words, f"{SPACE}+")) + 1)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n_tokens"), F.col("source").cast("string").alias("source"),
        F.when(words != "", F.unhex(F.md5(text.cast("binary")))).alias("cluster"),
    )


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_bins, n_tokens and fill (0 to 1) of a packing."""
    bins = packed.agg(F.count_distinct("bin").alias("n_bins"), F.sum("n_tokens").alias("n_tokens"))
    return bins.withColumn("fill", F.col("n_tokens") / (F.col("n_bins") * capacity))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, n_tokens, bin and bin_offset. Awkward cases: see the module."""
    return pack(materialize(packable(read_table(spark, sf_dir, "documents"))))
