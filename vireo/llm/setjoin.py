"""What the similarity joins share: signatures, node comparison on sketches, and exact verification within closed clusters.

Candidates are never expanded into all pairs of a group. Nodes (leaves of chosen-path trees, or LSH buckets) give a spanning
set of links between members whose sketches agree; components of those links are closed clusters, a superset of the true
ones; and within each cluster links are decided on full sets, in cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vireo.llm.common import materialize, small_batches
from vireo.operators.components import connected_components

SLOTS = 64  # minwise values of a signature
#: Sketches hold two bits of each value. At similarity 0.8 a slot differs with probability 0.15: 24 of 64 is five standard deviations beyond.
MAX_DIFFERENT = 24
NODE_LIMIT = 512  # a node of more members is branched further
CELL = 1000  # members that are verified in one task, with their sets' bytes:
CELL_BYTES = 32 << 20
FEW = 12  # members that are compared without sketches
HASHED = 2048  # hashes of a set that is put into a hash table
PIVOTS = 16
NODE_PIVOTS = 32
#: A member this close to a pivot (similarity 0.87) is branched no further. Whoever is similar to it is, by the triangle inequality of
#: Jaccard distances, similar to the pivot at 0.67 or more, so pivots are linked with all that differ in up to PIVOT_DIFFERENT slots: at
#: 0.67 that is 4.7 standard deviations beyond the 16 that are due (two in a million), and strangers, 48 apart, come as near as seldom.
CLOSE, PIVOT_DIFFERENT = 6, 32
BUFFER_ROWS = 1 << 16
WHOLE = 1 << 20  # members of a node that a task holds at once, 24 MB
BLOCK = 256  # members that are held against others at a time
TOGETHER = 32  # members that verification holds against others at a time

_rng = np.random.Generator(np.random.PCG64(20240229))
XOR = _rng.integers(0, 1 << 32, SLOTS, dtype=np.uint32)
MUL = _rng.integers(0, 1 << 31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PAIRS = np.uint64(0x5555555555555555)

LINK = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])


def signature(values: np.ndarray) -> np.ndarray:
    """SLOTS minwise values (uint32) of a set of 64-bit hashes."""
    h = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    out = np.full(SLOTS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(h), 2048):
        np.minimum(out, ((h[None, at : at + 2048] ^ XOR[:, None]) * MUL[:, None]).min(axis=1), out=out)
    return out


def half_sketches(signatures: np.ndarray) -> np.ndarray:
    """A uint64 per row of SLOTS / 2 values or more: two bits of each of the first SLOTS / 2."""
    bits = ((signatures[:, : SLOTS // 2] * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint64)
    return np.bitwise_or.reduce(bits << (np.arange(SLOTS // 2, dtype=np.uint64) * np.uint64(2)), axis=1)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """Two uint64 per row of SLOTS values: two bits of each value."""
    return np.stack([half_sketches(signatures), half_sketches(signatures[:, SLOTS // 2 :])], axis=1)


def different(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Slots in which sketches differ, along the last axis."""
    x = a ^ b
    return np.bitwise_count((x | (x >> np.uint64(1))) & _PAIRS).sum(axis=-1)


def _flatten(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _links(key: np.ndarray, ids: np.ndarray, sk: np.ndarray, max_different: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each run of equal keys (each at most NODE_LIMIT long), all members whose sketches agree pairwise along a chain."""
    n = len(key)
    parent = np.arange(n)
    left, right = [], []
    i = np.arange(n)
    for off in range(1, NODE_LIMIT):
        i = i[: np.searchsorted(i, n - off)]
        i = i[key[i] == key[i + off]]
        if not len(i):
            break
        open_ = i[parent[i] != parent[i + off]]
        if not len(open_):
            continue
        x = open_[(different(sk[open_], sk[open_ + off]) <= max_different) & (ids[open_] != ids[open_ + off])]
        left.append(ids[x])
        right.append(ids[x + off])
        while len(x):
            p, q = parent[x], parent[x + off]
            x = x[p != q]
            p, q = parent[x], parent[x + off]
            np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
            parent = _flatten(parent)
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _spanning(ids: np.ndarray, sk: np.ndarray, max_different: int) -> tuple[np.ndarray, np.ndarray]:
    """As _links() for one node of any size. Who is linked already is compared no more with others that are, so a group costs little more than a comparison of each with one of them."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    rest = np.arange(len(ids))
    asked = rest[:0]
    while len(rest):
        if not len(asked):
            asked, rest = rest[:1], rest[1:]
        block, asked = asked[:BLOCK], asked[BLOCK:]
        for i in block if len(rest) <= BLOCK else [block[:1], block[1:]]:
            i = np.atleast_1d(i)
            if not len(i) or not len(rest):
                continue
            agree = [different(sk[rest[lo : lo + CELL, None]], sk[i]) <= max_different for lo in range(0, len(rest), CELL)]
            first = np.concatenate([np.where(x.any(axis=1), x.argmax(axis=1), -1) for x in agree])
            hit = first >= 0
            left.append(ids[rest[hit]])
            right.append(ids[i[first[hit]]])
            asked, rest = np.concatenate([asked, rest[hit]]), rest[~hit]
    a, b = np.concatenate(left), np.concatenate(right)
    return a[a != b], b[a != b]


def compare_nodes(rows: DataFrame, last: bool, max_different: int = MAX_DIFFERENT, close: int = CLOSE, pivot_different: int = PIVOT_DIFFERENT) -> DataFrame:
    """rows: key, id, s1, s2 (longs). kind 0: a link a, b. kind 1: a member b of node a, which has over NODE_LIMIT members and must be branched further.

    Members of such a node are first held against up to NODE_PIVOTS of them, and linked with those that may be similar to their close members;
    the ones that are close to a pivot go no further. So a group of near copies costs one comparison with each pivot.
    last: such nodes are branched no more, and all their members are compared. Of a node of more than WHOLE members, the ones that would be
    branched are linked with the first of them, for the exact verification to decide.
    Rows are streamed in key order; memory does not grow with a node's size beyond that.
    """

    def batch_of(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=LINK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0
        large: int | None = None  # the large node that goes on,
        first: int | None = None  # its first member that goes on,
        pivots: list[tuple[int, np.ndarray]] = []  # and its pivots with their sketches
        enough = BUFFER_ROWS

        def in_large(key: int, ids: np.ndarray, sk: np.ndarray, fresh: bool) -> Iterator[pa.RecordBatch]:
            nonlocal first, pivots
            if fresh:
                first, pivots = None, []
            least = np.full((len(ids), 0), SLOTS)
            if pivots:
                least = np.stack([different(sk, p) for _, p in pivots], axis=1)
            while len(pivots) < NODE_PIVOTS:
                far = np.flatnonzero(least.min(axis=1, initial=SLOTS) > close)
                if not len(far):
                    break
                pivots.append((int(ids[far[0]]), sk[far[0]]))
                least = np.concatenate([least, different(sk, sk[far[0]])[:, None]], axis=1)
            names = np.array([p for p, _ in pivots])
            best = least.argmin(axis=1)
            near = least <= pivot_different
            joined = near.any(axis=1)
            yield batch_of(0, ids[joined], names[best[joined]])
            row, other = np.nonzero(near)
            pairs = np.unique(np.stack([best[row], other]), axis=1)
            yield batch_of(0, names[pairs[0]], names[pairs[1]])
            far = least.min(axis=1) > close
            if last and far.any():
                first = int(ids[far][0]) if first is None else first
                yield batch_of(0, ids[far], np.full(int(far.sum()), first))
            elif far.any():
                yield batch_of(1, np.full(int(far.sum()), key), ids[far])

        def work(cols: list[np.ndarray], end: bool) -> Iterator[pa.RecordBatch]:
            """Whole runs of cols; what may go on comes back through held."""
            nonlocal large, held, count
            key, ids, s1, s2 = cols
            sk = np.stack([s1, s2], axis=1).view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            goes_on = large is not None and key[0] == large
            big = sizes > NODE_LIMIT
            big[0] |= goes_on
            keep = np.ones(len(key), bool)
            tail = 0
            on = goes_on and len(sizes) == 1
            if not end and (not big[-1] or last and not on and sizes[-1] <= WHOLE):
                tail = sizes[-1]
                keep[-tail:] = big[-1] = False
            for k in np.flatnonzero(big):
                run = slice(starts[k], starts[k] + sizes[k])
                if last and sizes[k] <= WHOLE and not (goes_on and k == 0):
                    yield batch_of(0, *_spanning(ids[run], sk[run], max_different))
                    keep[run] = False
                    continue
                yield from in_large(int(key[run][0]), ids[run], sk[run], not (goes_on and k == 0))
                keep[run] = False
            large = int(key[-1]) if big[-1] else None
            a, b = _links(key[keep], ids[keep], sk[keep], max_different)
            if len(a):
                yield batch_of(0, a, b)
            held = [[c[len(key) - tail :] for c in cols]] if tail else []
            count = tail

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
                count += batch.num_rows
            if count >= enough:
                yield from work([np.concatenate(c) for c in zip(*held)], False)
                enough = max(BUFFER_ROWS, 2 * count)
        if count:
            yield from work([np.concatenate(c) for c in zip(*held)], True)

    placed = rows.select("key", "id", "s1", "s2").repartition("key").sortWithinPartitions("key", "id")
    return placed.mapInArrow(run, "kind byte, a long, b long")


Members = frozenset | np.ndarray  # a set of hashes: as such, or sorted and distinct


def similar(a: Members, b: Members, percent: int) -> bool:
    """Jaccard of sets of hashes, at least percent / 100."""
    both = len(a & b) if isinstance(a, frozenset) and isinstance(b, frozenset) else len(np.intersect1d(_array(a), _array(b), assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _array(x: Members) -> np.ndarray:
    return np.fromiter(x, np.uint64, len(x)) if isinstance(x, frozenset) else x


def bitmaps(sets: list[Members], most: int = 1 << 14) -> np.ndarray:
    """Some uint64 per set, a bit for each hash: sets differ in as many hashes as their bits, at least. Four bits for each hash of the largest set, up to ``most``."""
    flat = np.concatenate([_array(x) for x in sets]) if sets else np.zeros(0, np.uint64)
    sizes = [len(x) for x in sets]
    words = min(most, max(128, 1 << (4 * max(sizes, default=1)).bit_length())) // 64
    out = np.zeros((len(sets), words), np.uint64)
    row = np.repeat(np.arange(len(sets)), sizes)
    np.bitwise_or.at(out, (row, (flat >> np.uint64(6) & np.uint64(words - 1)).astype(np.int64)), np.uint64(1) << (flat & np.uint64(63)))
    return out


def _verified(sets: list[Members], sk: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, small: int = 0, turn: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Exact links between left and right members (indices) with different labels; label is updated, and joined members are not compared again.

    Pairs with a set of up to small hashes are not held against sketches; all are, against a bound that loses nothing.
    turn: only pairs whose right member has a greater one are compared; the others are elsewhere.
    """
    sizes = np.array([len(s) for s in sets])
    found: list[tuple[int, int]] = []
    held: dict[int, Members] = {}

    def of(i: int) -> Members:
        if i not in held:
            held[i] = frozenset(sets[i].tolist()) if isinstance(sets[i], np.ndarray) and len(sets[i]) <= HASHED else sets[i]
        return held[i]

    both_ways = np.array_equal(left, right)  # then pairs with members before have been looked at
    if both_ways and len(left) <= FEW:
        for x, i in enumerate(left):
            for j in right[x + 1 :]:
                if label[i] != label[j] and 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]) and similar(of(i), of(j), percent):
                    found.append((i, j))
                    label[label == label[j]] = label[i]
        return found
    if both_ways:
        turn = np.arange(len(sets))
    bits = bitmaps(sets)
    at = 0
    while at < len(left):
        if (label == label[0]).all():
            break
        own = left[at : at + (TOGETHER if at else 1)]  # the first alone: it may join most of a group
        at += len(own)
        low, high = np.minimum(sizes[own, None], sizes[right]), np.maximum(sizes[own, None], sizes[right])
        open_ = (label[own, None] != label[right]) & (100 * low >= percent * high)
        if turn is not None:
            open_ &= turn[right] > turn[own, None]
        x, y = np.nonzero(open_)
        i, j = own[x], right[y]
        agree = (different(sk[i], sk[j]) <= MAX_DIFFERENT) | (low[x, y] <= small)
        i, j = i[agree], j[agree]
        for lo in range(0, len(i), CELL):
            p, q = i[lo : lo + CELL], j[lo : lo + CELL]
            open_ = label[p] != label[q]  # joined since
            p, q = p[open_], q[open_]
            near = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=-1) * (100 + percent) <= (100 - percent) * (sizes[p] + sizes[q])
            for m, n in zip(p[near].tolist(), q[near].tolist()):
                if label[m] != label[n] and similar(of(m), of(n), percent):
                    found.append((m, n))
                    label[label == label[n]] = label[m]
    return found


_MEMBERS = "key string, d1 long, d2 long, role int, comp long, s1 long, s2 long, items binary"


Sets = Callable[[list[bytes]], list[Members]]


def stored_sets(items: list[bytes]) -> list[Members]:
    """Members that carry their sets as such: sorted distinct hashes."""
    return [np.frombuffer(x, np.uint64) for x in items]


def _verify_cells(rows: DataFrame, percent: int, sets_of: Sets, small: int = 0) -> DataFrame:
    """rows of _MEMBERS, those of a key together. Where a key has role 1, these are compared with role 0, and with those of role 3 (who are asked about elsewhere too) that come after them; else all are compared with each other, pivots (role 2) among them."""

    def of_key(held: list[tuple], sets: list[Members]) -> Iterator[tuple]:
        keep = list({(d1, d2, role): k for k, (_, d1, d2, role, *_) in enumerate(held)}.values())
        pivots = {held[k][1:3] for k in keep if held[k][3] == 2}
        if pivots:  # a pivot may also be a member of the cell
            keep = [k for k in keep if held[k][3] == 2 or held[k][1:3] not in pivots]
        if len(keep) < 2:
            return
        own = [held[k] for k in keep]
        sk = np.array([r[5:7] for r in own], np.int64).view(np.uint64)
        label = np.unique([r[4] for r in own], return_inverse=True)[1]
        everyone, role = np.arange(len(own)), np.array([r[3] for r in own])
        asked, others, turn = everyone[role == 1], everyone, None
        if len(asked):
            others, turn = everyone[role != 1], np.unique([r[1] for r in own], return_inverse=True)[1]
            turn[role == 0] = len(own)
        for i, j in _verified([sets[k] for k in keep], sk, label, asked if len(asked) else everyone, others, percent, small, turn):
            yield own[i][1], own[j][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def work(end: bool) -> Iterator[pa.RecordBatch]:
            """All whole keys of held, their sets made at once."""
            nonlocal held
            borders = [0, *(k for k in range(1, len(held)) if held[k][0] != held[k - 1][0]), *([len(held)] if end else [])]
            done, held = held[: borders[-1]], held[borders[-1] :]
            sets = sets_of([r[7] for r in done])
            out = [x for lo, hi in zip(borders, borders[1:]) for x in of_key(done[lo:hi], sets[lo:hi])]
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            if held and held[0][0] != held[-1][0]:
                yield from work(False)
        if held:
            yield from work(True)

    names = ["key", "d1", "d2", "role", "comp", "s1", "s2", "items"]
    return rows.select(*names).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def verify_clusters(members: DataFrame, percent: int, sets_of: Sets = stored_sets, small: int = 0) -> DataFrame:
    """d1 and root for all members that have an exact link; members (a written table): cluster, d1, d2, least_doc, n, s1, s2, items.

    sets_of makes sets of items; n is a set's size or a bound of it.
    Sketches are not asked about sets of up to small hashes.

    A cluster of up to CELL members is compared as a whole. A larger one is dealt to cells: each cell compares its own
    members and the cluster's pivots, which joins nearly everything that belongs together. What then lies outside the
    cluster's largest component is compared with every cell, each pair of it once. So every link is found or already implied, no task holds more
    than two cells, and copies of one text cost one comparison each.
    """
    spark = members.sparkSession
    small_batches(spark)
    sizes = members.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("items_n"))
    cells = F.greatest(F.ceil(F.col("m") / CELL), F.ceil(F.col("items_n") * 8 / CELL_BYTES)).cast("long")
    sizes = materialize(sizes.filter("m > 1").select("cluster", cells.alias("cells")))
    rows = members.hint("merge").join(sizes, "cluster").withColumn("cell", F.pmod(F.xxhash64("d2"), F.col("cells")))
    key = lambda *c: F.concat_ws(":", *c)
    cols = ["key", "d1", "d2", "role", "comp", "s1", "s2", "items"]
    base = rows.withColumn("key", key("cluster", "cell")).withColumn("role", F.lit(0)).withColumn("comp", F.col("d1"))
    large = sizes.filter("cells > 1")
    if not large.limit(1).count():
        return connected_components(materialize(_verify_cells(base.select(*cols), percent, sets_of, small)))
    big = members.join(large, "cluster")
    tops = big.groupBy("cluster", "cells").agg(*(F.min(F.struct(F.xxhash64("d2", F.lit(k)).alias("h"), "d1", "d2")).alias(f"p{k}") for k in range(PIVOTS)))
    picked = tops.select("cluster", "cells", F.explode(F.array_distinct(F.array(*(F.struct(F.col(f"p{k}.d1"), F.col(f"p{k}.d2")) for k in range(PIVOTS))))).alias("p"))
    picked = picked.select("cluster", F.col("p.d1").alias("d1"), F.col("p.d2").alias("d2"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"))
    pivots = members.join(picked, ["cluster", "d1", "d2"]).withColumn("key", key("cluster", "cell")).withColumn("role", F.lit(2)).withColumn("comp", F.col("d1"))
    links = materialize(_verify_cells(base.select(*cols).unionByName(pivots.select(*cols)), percent, sets_of, small))
    found = materialize(connected_components(links))
    big = big.join(found.select(F.col("node").alias("d1"), F.col("root").alias("comp")), "d1", "left").withColumn("comp", F.coalesce("comp", "d1"))
    big = materialize(big.withColumn("cell", F.pmod(F.xxhash64("d2"), F.col("cells"))))
    main = big.groupBy("cluster", "comp").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"))
    big = big.join(main, "cluster").withColumn("role", F.when(F.col("comp") == F.col("main"), 0).otherwise(3)).drop("main")
    rest = big.filter("role = 3")
    weight = rest.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("n") * 8 / CELL_BYTES)).cast("long").alias("blocks"))
    weight = materialize(weight)
    if not weight.limit(1).count():
        return found
    zero = F.lit(0).cast("long")
    asked = rest.join(weight, "cluster").withColumn("block", F.pmod(F.xxhash64("d1"), F.col("blocks"))).drop("cell").withColumn("cell", F.explode(F.sequence(zero, F.col("cells") - 1)))
    asked = asked.withColumn("key", key("cluster", "cell", "block")).withColumn("role", F.lit(1))
    against = big.join(weight, "cluster").withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1))).withColumn("key", key("cluster", "cell", "block"))
    more = materialize(_verify_cells(asked.select(*cols).unionByName(against.select(*cols)), percent, sets_of, small))
    return connected_components(links.unionAll(more))
