import random

import numpy as np

from vireo.operators import cells, dupes
from vireo.plans.tables import materialize


def drawn(seed, n):
    """Hashes of which many are near each other, some with few bits."""
    draw = random.Random(seed)
    out = []
    while len(out) < n:
        h = draw.getrandbits(64) if draw.random() < 0.5 else sum(1 << draw.randrange(64) for _ in range(4)) & (1 << 64) - 1
        for _ in range(draw.randrange(1, 6)):
            out.append(h ^ sum({1 << draw.randrange(64) for _ in range(draw.randrange(16))}))
    return np.unique(np.array(out[:n], dtype=np.uint64))


def test_near_pairs_equal_brute_force(monkeypatch):
    monkeypatch.setattr(cells, "AT_ONCE", 64)  # many parts
    h = drawn(1, 700)
    x, y = h[::2], h[1::2]
    apart = np.bitwise_count(x[:, None] ^ y)
    for threshold in (0, 1, 4, 5, 12, 15, 40, 64):
        found = [pair for i, j in cells.near_pairs(x, y, threshold) for pair in zip(i.tolist(), j.tolist())]
        assert sorted(found) == list(map(tuple, np.argwhere(apart <= threshold).tolist()))
    assert list(cells.near_pairs(x, y[:0], 12)) == list(cells.near_pairs(x, y, -1)) == []


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    context, store = spark.sparkContext, spark.sparkContext._jsc.sc().statusStore()
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_bands_shuffle_few_rows_a_hash(spark):
    h = drawn(2, 1500).view(np.int64).tolist()
    hashes = materialize(spark.createDataFrame(list(enumerate(h)), "key long, dh long"))
    before = shuffled(spark)
    banded = sorted(map(tuple, dupes.pair_edges(hashes, 12, ["dh"], "banded").collect()))
    assert 0 < shuffled(spark) - before < 50 * len(h)
    assert banded == sorted(map(tuple, dupes.pair_edges(hashes, 12, ["dh"], "broadcast").collect())) and len(banded) > 500


def test_bands_over_columns_with_nulls(spark):
    h = drawn(3, 500).view(np.int64).tolist()
    rows = [(k, None if k % 5 == 0 else a, None if k % 7 == 0 else b) for k, (a, b) in enumerate(zip(h, h[::-1]))]
    hashes = spark.createDataFrame(rows, "key long, ph long, dh long").cache()
    edges = lambda s: sorted(map(tuple, dupes.pair_edges(hashes, 10, ["ph", "dh"], s).collect()))
    assert edges("banded") == edges("broadcast") != []
    known, fresh = hashes.filter("key % 3 > 0"), hashes.filter("key % 3 = 0")
    more = lambda s: sorted(map(tuple, dupes.new_edges(fresh, known, 10, ["ph", "dh"], s).collect()))
    assert more("banded") == more("broadcast") != []
