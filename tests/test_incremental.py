"""Edges and families step by step, page and total of one scan, the families table function, and an executor that resumes."""

import os
import random

import pytest
from pyspark.sql import functions as F

from vireo.functions import tables
from vireo.operators import catalog, components, dupes, review


def drawn(seed, n, spread=4):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(n // 6)]
    out = []
    for k in range(n):
        h = r.choice(centres)
        for _ in range(r.randint(0, spread)):
            h ^= 1 << r.randrange(64)
        out.append((k * 7 % n, h - (1 << 64) if h >> 63 else h))
    return out


def members(df):
    return sorted(map(tuple, df.select("family_id", "key", "min_dist").collect()))


@pytest.mark.parametrize("strategy", ["broadcast", "banded", "tiled"])
def test_new_edges_give_the_families_of_a_full_run(spark, monkeypatch, strategy):
    monkeypatch.setattr(dupes, "CELL", 5)
    rows = drawn(1, 240)
    every = spark.createDataFrame(rows, "key long, dh long").cache()
    threshold = 6
    full = members(dupes.families(dupes.pair_edges(every, threshold, ["dh"]), threshold))
    assert members(dupes.families(dupes.pair_edges(every, threshold, ["dh"], strategy), threshold)) == full
    part = F.pmod(F.xxhash64("key"), F.lit(3))
    known = every.filter(part == 0)
    edges = dupes.pair_edges(known, threshold, ["dh"])
    roots = components.connected_components(edges)
    for step in (1, 2):
        fresh = every.filter(part == step)
        links = dupes.new_edges(fresh, known, threshold, ["dh"], strategy).cache()
        assert links.join(known, links["a"] == known["key"], "left_semi").join(known, links["b"] == known["key"], "left_semi").count() == 0  # none between known ones
        roots, edges, known = dupes.merged_roots(roots, links), edges.unionByName(links), known.unionByName(fresh)
    assert members(dupes.members_of(roots, edges)) == full


def test_new_edges_of_nothing(spark):
    none = spark.createDataFrame([], "key long, dh long")
    some = spark.createDataFrame([(1, 5), (2, 5), (3, 4)], "key long, dh long")
    assert dupes.new_edges(none, some, 3, ["dh"]).count() == 0
    links = dupes.new_edges(some, none, 3, ["dh"])
    assert sorted(map(tuple, links.collect())) == [(1, 2, 0), (1, 3, 1)]
    assert dupes.merged_roots(spark.createDataFrame([], "node long, root long"), links).count() == 3
    assert {r["key"]: r["matches"] for r in dupes.perceptual_matches(some, spark.createDataFrame([(9, 4)], "key long, dh long"), ["dh"]).collect()} == {1: [2], 2: [1], 3: [9]}


def test_page_and_total_of_one_scan(spark, tmp_path):
    spark.range(500).select("id", (F.col("id") % 6).cast("int").alias("rating"), F.lit(0).alias("rejected"), F.when(F.col("id") % 2 == 0, F.col("id") * 1.0).alias("file_modified")).write.parquet(str(tmp_path / "t"))
    images = spark.read.parquet(str(tmp_path / "t"))
    query = catalog.CatalogQuery(min_rating=2, limit=7, offset=3)
    rows, total = query.answer(images)
    assert rows == query.page(images).collect() and total == query.total(images).first()["total"]
    got = query.answer_rows(images).collect()
    assert [r["place"] for r in got] == list(range(7)) and {r["total"] for r in got} == {total} and '"file_modified":null' in query.answer_rows(images.withColumn("file_modified", F.lit(None).cast("double"))).first()["row"]
    assert list(map(tuple, catalog.CatalogQuery(min_rating=2, offset=10_000).answer_rows(images).collect())) == [(None, None, total)]


def test_families_in_sql(spark):
    tables.register(spark)
    edges = spark.createDataFrame([(1, 2, 3), (2, 3, 9), (5, 6, 0), (6, 7, 12), (8, 9, 13), (4, 4, 0)], "a long, b long, d int")
    edges.createOrReplaceTempView("edges")
    for threshold in (0, 9, 12, 40):
        assert members(spark.sql(f"SELECT * FROM families(TABLE(edges), {threshold})")) == members(dupes.families(edges, threshold))
    with pytest.raises(Exception, match="columns a, b and d"):
        spark.sql("SELECT * FROM families(TABLE(SELECT 1 AS x), 3)").collect()


def put(root, *names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)


def test_an_executor_that_died_is_taken_up(spark, tmp_path, monkeypatch):
    names = [f"in/{k:02}.png" for k in range(20)]
    put(tmp_path, *names, "out/03.png")
    plan = spark.createDataFrame([(str(tmp_path / n), None if n.endswith("7.png") else str(tmp_path / "out" / os.path.basename(n)), "move") for n in names] + [(str(tmp_path / "gone.png"), str(tmp_path / "out/x.png"), "move")], "origin string, dest string, action string")
    monkeypatch.setattr(review, "JOURNAL_ROWS", 4)
    real, count = review.shutil.move, []

    def dies(origin, dest):
        count.append(origin)
        if len(count) == 11:
            real(origin, dest)  # moved, but not written down
            raise KeyboardInterrupt
        return real(origin, dest)

    monkeypatch.setattr(review.shutil, "move", dies)
    with pytest.raises(KeyboardInterrupt):
        review.execute(plan, str(tmp_path / "journal"))
    done = {os.path.basename(r["origin"]): r for r in review.execute(plan, str(tmp_path / "journal")).collect()}
    assert len(count) == len(set(count)) + (count.count(str(tmp_path / "gone.png")) > 1)  # nothing was moved twice
    assert {n for n, r in done.items() if not r["ok"]} == {"03.png", "gone.png"} and "out/03.png" in done["03.png"]["error"]
    assert sorted(p.name for p in (tmp_path / "in").iterdir()) == ["03.png"]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(os.path.basename(n) for n in names if not n.endswith("7.png"))
    again = review.execute(plan, str(tmp_path / "journal"))
    assert again.filter("NOT ok").count() == 2 and again.columns == ["origin", "dest", "action", "ok", "error"]
