"""Pairs of 64-bit hashes within a Hamming distance, in cells: each task holds one block of either side, whatever the tables' size.

Hashes of a cell are looked up by bands. Bands k are given radii r(k) such that the sum of r(k) + 1 is more than the threshold; so
hashes within it are within r(k) bits of each other in one band k at least, and only hashes of such band values are compared, as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BANDS = ((53, 11), (42, 11), (31, 11), (20, 11), (10, 10), (0, 10))  # lowest bit and width
BLOCKS = 8  # of a side at least, so that few hashes are dealt to many tasks too
AT_ONCE = 1 << 16  # pairs that are compared at once
BOTH = 2  # side of a block that meets itself


def radii(threshold: int, bands: int = len(BANDS)) -> list[int]:
    """Radius of each band; -1 for those that need not be looked at."""
    each, more = divmod(threshold + 1, bands)
    return [each - 1 + (k < more) for k in range(bands)]


def _masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for r in range(min(radius, width) + 1) for bits in combinations(range(width), r)], dtype=np.int64)


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in x and in y (uint64) of all pairs within threshold, each once."""
    bits, near = np.empty(AT_ONCE, np.uint64), np.empty(AT_ONCE, np.uint8)
    seen: list[tuple[np.uint64, int]] = []
    for (low, width), radius in zip(BANDS, radii(threshold)):
        if radius < 0:
            break
        value = lambda h: ((h >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)  # noqa: E731, B023
        xv, yv = value(x), value(y)
        xo, yo = np.argsort(xv, kind="stable"), np.argsort(yv, kind="stable")
        xs, ys = x[xo], y[yo]
        xat, yat = (np.concatenate([[0], np.cumsum(np.bincount(v, minlength=1 << width))]) for v in (xv, yv))
        masks = _masks(width, radius)
        for v in np.flatnonzero(np.diff(xat)):
            begin = yat[v ^ masks]
            n = yat[(v ^ masks) + 1] - begin
            ends = np.cumsum(n)
            if not (total := int(ends[-1])):
                continue
            met = np.repeat(begin - (ends - n), n) + np.arange(total)
            of = ys[met]
            for a in range(0, total, AT_ONCE):
                part = of[a : a + AT_ONCE]
                rows = AT_ONCE // len(part)
                for i in range(xat[v], xat[v + 1], rows):
                    own = xs[i : min(i + rows, xat[v + 1])]
                    size = len(own) * len(part)
                    np.bitwise_xor(own[:, None], part, out=bits[:size].reshape(len(own), len(part)))
                    np.bitwise_count(bits[:size], out=near[:size])
                    hits = np.flatnonzero(near[:size] <= threshold)
                    for mask, r in seen:  # found in a band before
                        hits = hits[np.bitwise_count(bits[hits] & mask) > r] if len(hits) else hits
                    if len(hits):
                        yield xo[i + hits // len(part)], yo[met[a + hits % len(part)]]
        seen.append((np.uint64(((1 << width) - 1) << low), radius))


def _links(g: np.ndarray, g2: np.ndarray, hashes: list[tuple], others: list[tuple], threshold: int, same: bool) -> Iterator[pa.RecordBatch]:
    """a < b and d of a cell: pairs that are near by one hash column at least, d being the least distance over those that both have.

    hashes and others: values (uint64) and whether there is one, by column.
    """
    both = list(zip(hashes, others))
    apart = lambda i, j, columns: [np.where(p[1][i] & q[1][j], np.bitwise_count(p[0][i] ^ q[0][j]), 255) for p, q in columns]
    for k, ((x, has), (y, has2)) in enumerate(both):
        at, at2 = np.flatnonzero(has), np.flatnonzero(has2)
        for i, j in near_pairs(x[at], y[at2], threshold):
            i, j = at[i], at2[j]
            keep = i < j if same else g[i] != g2[j]
            for d in apart(i, j, both[:k]):  # given by a column before
                keep &= d > threshold
            i, j = i[keep], j[keep]
            d = np.min(apart(i, j, both), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(g[i], g2[j])), pa.array(np.maximum(g[i], g2[j])), pa.array(d.astype(np.int32))], names=["a", "b", "d"])


def _joined(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of some size, of many small ones."""
    held, n = [], 0
    for batch in found:
        held, n = [*held, batch] if n else [batch], n + batch.num_rows
        if n >= AT_ONCE or len(held) >= 256:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def met_in_cells(x: DataFrame, y: DataFrame | None, columns: list[str], threshold: int, rows: int, others: int = 0, block_rows: int = 400_000) -> DataFrame:
    """a < b and d of all pairs of g (longs, each once in a table) of x and y, or within x, that are within threshold by one of the columns.

    rows and others: how many x and y have. A block has some block_rows of them at most, and a row goes to as many cells as the other
    side has blocks.
    """
    blocks = lambda n: max(BLOCKS, -(-n // block_rows))
    t, u = blocks(rows), blocks(others) if y is not None else blocks(rows)
    block = lambda n: F.pmod(F.xxhash64("g"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if y is None:  # each pair of blocks once
        dealt = x.select("g", *columns, block(t).alias("own"), every(t).alias("other"))
        side = F.when(F.col("own") == F.col("other"), BOTH).when(F.col("own") < F.col("other"), 0).otherwise(1)
        dealt = dealt.select((F.least("own", "other") * t + F.greatest("own", "other")).alias("cell"), side.alias("side"), "g", *columns)
        cells = t * (t + 1) // 2
    else:
        left = x.select("g", *columns, block(t).alias("own"), every(u).alias("other")).select((F.col("own") * u + F.col("other")).alias("cell"), F.lit(0).alias("side"), "g", *columns)
        right = y.select("g", *columns, block(u).alias("own"), every(t).alias("other")).select((F.col("other") * u + F.col("own")).alias("cell"), F.lit(1).alias("side"), "g", *columns)
        dealt, cells = left.unionAll(right), t * u

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        side, g = (table.column(c).to_numpy() for c in ("side", "g"))
        hashes = [(c.fill_null(0).cast(pa.int64()).to_numpy().view(np.uint64), c.is_valid().to_numpy()) for c in map(table.column, columns)]
        of = lambda rows: [(h[rows], has[rows]) for h, has in hashes]
        own, other = side != 1, side != 0
        yield from _joined(_links(g[own], g[other], of(own), of(other), threshold, bool((side == BOTH).any())))

    tasks = 2 * cells if cells <= 100 else max(200, cells // 4)
    return dealt.repartition(tasks, "cell").groupBy("cell").applyInArrow(meet, "a long, b long, d int")
