"""Every catalog query against its SQL in DuckDB, and the small operators by hand."""

import glob
import math
import os
import time

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vireo.functions import images
from vireo.operators import catalog, components, dupes, pool, review
from vireo.plans import adapters, registry, schema
from vireo.streaming.incremental import edges_are_stale, fold_review
from vireo.streaming.jobs import Jobs

SF = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rel = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


def test_pair_strategies_agree(spark, monkeypatch):
    hashes = adapters.text_hashes(spark, SF).cache()
    for threshold in (9, 20):
        monkeypatch.setattr(dupes, "BRUTE_ROWS", 40)
        monkeypatch.setattr(dupes, "TILE_ROWS", 40)  # several blocks
        found = {s: sorted(tuple(r) for r in dupes.pair_edges(hashes, threshold, ["dh"], s).collect()) for s in ("broadcast", "tiled", *(["banded"] if threshold < 16 else []))}
        assert len({repr(x) for x in found.values()}) == 1 and len(found["tiled"]) > 10
    assert [dupes.choose_pair_strategy(n, t) for n, t in ((40, 40), (41, 15), (41, 16))] == ["broadcast", "banded", "tiled"]


def test_copies_cost_one_link_each_and_families_are_those_of_all_pairs(spark):
    rows = [(k, [5, 5, 5, 7, 1 << 40, 1 << 40, 0x7FFFFFFF][k]) for k in range(7)]
    edges = sorted(tuple(r) for r in dupes.pair_edges(spark.createDataFrame(rows, "key long, dh long"), 2, ["dh"]).collect())
    assert edges == [(0, 1, 0), (0, 2, 0), (0, 3, 1), (4, 5, 0)]
    pairs = [(a, b, (x ^ y).bit_count()) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 2]
    full, star = ({tuple(r) for r in dupes.families(spark.createDataFrame(e, "a long, b long, d int"), 2).collect()} for e in (pairs, edges))
    assert full == star


def test_stars_agree_with_one_task(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(0, 300) if k % 50] + [(1000, 2), (7, 7), (1000, 2)], "a long, b long")
    one, stars = ({tuple(r) for r in components.connected_components(pairs, n).collect()} for n in (10_000, 0))
    assert one == stars and (300, 251) in one and (2, 1) in one


def test_uniquified_never_repeats(spark):
    plan = spark.createDataFrame([("/a", "/d", "x.png"), ("/b", "/d", "x.png"), ("/c", "/d", "y")], "origin string, folder string, name string")
    taken = spark.createDataFrame([("/d/x.png",)], "dest string")
    assert {r["dest"] for r in review.uniquified(plan, taken).collect()} == {"/d/x_1.png", "/d/x_2.png", "/d/y"}


def test_uniquified_passes_over_names_that_end_in_a_number(spark):
    names = ["x.png"] * 4 + ["x_1.png", "x_1.png", "x_3.png", ".png", ".png", "_1.png", "n.", "n.", "n._1", "y", "y", "y_1", "x_1_1.png"]
    plan = spark.createDataFrame([(f"/{k:02}", "/d", n) for k, n in enumerate(names)], "origin string, folder string, name string")
    for held in ([], ["/d/x_2.png", "/d/x.png", "/d/x_5.png", "/d/x_99999999999999999999.png", "/e/x_6.png", "/d/y_2"]):
        used, want, plain = set(held), {}, {f"/d/{n}" for n in names}
        for k, n in enumerate(names):
            stem, dot, ext = n.rpartition(".") if n in ("x.png", "x_1.png", "x_3.png", "_1.png", "x_1_1.png") else (n, "", "") if n != "n._1" else ("n", ".", "_1")
            tries = [f"/d/{n}"] + [f"/d/{stem}_{i}{dot}{ext}" for i in range(1, 99)]
            want[f"/{k:02}"] = next(t for i, t in enumerate(tries) if t not in used and (i == 0 or t not in plain))
            used.add(want[f"/{k:02}"])
        taken = spark.createDataFrame([(x,) for x in held], "dest string") if held else None
        got = review.uniquified(plan, taken).collect()
        assert {r["origin"]: r["dest"] for r in got} == want and len({r["dest"] for r in got}) == len(names) == len(got)
        assert not held or not {r["dest"] for r in got} & set(held)


def test_ids_follow_path_order(spark):
    fresh = spark.createDataFrame([(f"/p{k:03}",) for k in range(57)], "filepath string")
    got = {r["filepath"]: r["id"] for r in catalog.with_ids(fresh, 100).collect()}
    assert got == {f"/p{k:03}": 100 + k for k in range(57)}


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["x.png", "x_1.png", "x_2.png", "x_1_1.png", "y", "y_1", ".z", "n."]), min_size=1, max_size=12), st.sets(st.sampled_from(["x.png", "x_1.png", "x_3.png", "y", "y_2"])))
def test_no_dest_repeats_or_is_taken(spark, names, held):
    plan = spark.createDataFrame([(f"/{k:02}", "/d", n) for k, n in enumerate(names)], "origin string, folder string, name string")
    taken = {f"/d/{x}" for x in held}
    got = [r["dest"] for r in review.uniquified(plan, spark.createDataFrame([(x,) for x in taken], "dest string")).collect()]
    assert len(got) == len(set(got)) == len(names) and not set(got) & taken


def test_manifest_and_tables_are_saved_and_loaded(spark, tmp_path):
    rows = [("/s/a.png", "/p/a.png", None, "d1", 3, 1.5, None), ("/t/b.png", None, "/s/a.png", "d1", 3, None, 2.0)]
    files = spark.createDataFrame(rows, schema.MANIFEST["files"].dataType.elementType)
    path = str(tmp_path / "manifest")
    assert pool.load_manifest(spark, path) is None
    pool.save_manifest(files, path, "2024")
    assert sorted(map(tuple, pool.load_manifest(spark, path).collect())) == rows
    (tmp_path / "bad.json").write_text("{no json")
    assert pool.load_manifest(spark, str(tmp_path / "bad.json")) is None
    edges = spark.createDataFrame([(1, 2, 0)], schema.EDGES)
    at = str(tmp_path / "edges")
    assert pool.load_table(spark, at, schema.EDGES) is None
    for _ in range(2):
        pool.save_table(edges, at)
    assert pool.load_table(spark, at, schema.EDGES).collect() == edges.collect() and pool.load_table(spark, at, schema.HASHES) is None
    assert tuple(pool.pool_status(edges, None, None, edges).first()) == (1, False, 0, 0, True)


def test_sql_functions(spark):
    images.register(spark)
    row = spark.sql("SELECT hamming64(-1, 0) h, confidence_to_threshold(70) t, threshold_to_confidence(12) c, quality_score(300.0, 0.5, 0.7, NULL) q, graph_metadata('{\"1\": {\"inputs\": {\"seed\": 4}}}').seed s, phash(binary('x')) p").first()
    q = round(math.log10(300) / 4.5 * 35 + 10 + 0.7 * 25, 1)
    assert tuple(row) == (64, 12, 70, q, "4", None)


def test_jobs_run_one_at_a_time_and_stop(spark):
    jobs = Jobs(spark)
    slow = spark.range(4, numPartitions=4).select(F.udf(lambda k: time.sleep(60) or k, "long")("id"))
    first = jobs.start("cluster", slow.collect)
    assert jobs.start("cluster", slow.collect) is None
    for _ in range(100):
        if first.progress()["tasks"]:
            break
        time.sleep(0.1)
    assert first.progress() == {"state": "running", "jobs": 1, "tasks_done": 0, "tasks": 4}
    first.stop()
    assert first.join(50) == "stopped" and first.should_stop()
    assert jobs.start("cluster", lambda: spark.range(3).count()).join(60) == "done" and jobs.get("cluster").result == 3
    assert jobs.start("cluster", lambda: spark.sql("SELECT no_such_column")).join(60) == "failed" and "no_such_column" in jobs.get("cluster").error


def test_states_and_stale_edges(spark):
    flags = spark.createDataFrame([(x,) for x in ("true", "0", "", "no", None, "FALSE")], "v string").select(review.flag_of(F.col("v"))).collect()
    assert [r[0] for r in flags] == [1, 0, 0, 1, 1, 0]
    assert [edges_are_stale(*x) for x in ((None, None), (None, 1), (1, 1), (1, 2))] == [False, True, False, True]
    log = spark.createDataFrame([(1, 5, 1), (1, 3, 2), (2, 4, 1)], "id long, rating int, at int")
    assert sorted(tuple(r) for r in fold_review(log, "id", "rating", ["at"]).collect()) == [(1, 3), (2, 4)]
    rejected = spark.createDataFrame([(1, "a", 1), (2, "b", 0)], "id long, filepath string, rejected int")
    assert [tuple(r) for r in review.rejected_files(rejected).collect()] == [(1, "a")]
