"""Tables that change by whole steps, and the vault over them: failed writes, conflicts, compaction, look-ups and review."""

import pytest
from pyspark.sql import functions as F

from vireo.operators import vault
from vireo.plans import schema
from vireo.plans.schema import _of
from vireo.plans.store import Conflict, Table

ROW = _of(k=schema._L, v=schema._S)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, str(tmp_path / "t"), ROW)


def made(spark, *pairs):
    return spark.createDataFrame(pairs, ROW)


def test_steps(spark, table):
    assert not table.exists() and rows(table.read()) == []
    table.create()
    assert table.exists() and rows(table.read()) == [] and table.number() == 1
    table.create()
    assert table.number() == 1
    assert table.append(made(spark, (1, "a"))) == 2
    table.append(made(spark, (2, "b"), (1, "c")))
    assert rows(table.changes()) == [(1, "a", 2), (1, "c", 3), (2, "b", 3)] and rows(table.changes(since=2)) == [(1, "c", 3), (2, "b", 3)]
    table.compact(lambda df: df.groupBy("k").agg(F.max_by("v", "batch").alias("v")))
    assert rows(table.read()) == [(1, "c"), (2, "b")] and rows(table.changes(since=3)) == []
    table.replace(table.read().filter("k = 1"))  # reads what it replaces
    assert rows(table.read()) == [(1, "c")]
    assert table.vacuum() == 3 and rows(table.read()) == [(1, "c")] and table.vacuum() == 0


def test_a_failed_write_leaves_the_table(spark, table):
    table.append(made(spark, (1, "a")))
    bad = spark.range(4).repartition(4).select(F.col("id").alias("k"), F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise("x").alias("v"))
    for write in (table.append, table.replace):
        with pytest.raises(Exception, match="lost"):
            write(bad)
        assert rows(table.read()) == [(1, "a")] and table.number() == 1
    table.append(made(spark, (2, "b")))
    assert rows(table.read()) == [(1, "a"), (2, "b")]
    assert table.vacuum() >= 2


def test_two_writers(spark, table):
    table.append(made(spark, (1, "a")))
    other = Table(spark, table.path, ROW)

    def meanwhile(df):
        other.append(made(spark, (9, "z")))
        return df

    with pytest.raises(Conflict):
        table.compact(meanwhile)
    assert rows(table.read()) == [(1, "a"), (9, "z")]


def listing(spark, *names):
    return spark.createDataFrame([(f"/v/{n}", k, 1.0 * k, 2.0) for k, n in enumerate(names)], "filepath string, size long, mtime double, ctime double")


def test_vault(spark, tmp_path):
    v = vault.Vault(spark, str(tmp_path / "v"))
    assert v.index(listing(spark, "b/x.png", "a.png", "c.png")) == {"indexed": 3, "skipped": 0, "errors": 0}
    assert v.index(listing(spark, "a.png", "d.png", "d.png")) == {"indexed": 1, "skipped": 1, "errors": 0}
    ids = {r["filename"]: r["id"] for r in v.catalog().collect()}
    assert ids == {"a.png": 1, "x.png": 2, "c.png": 3, "d.png": 4}
    v.set(1, "rating", 9)
    v.set(1, "tags", "x,y")
    v.set(2, "rejected", "true")
    v.set(3, "flag", None)
    v.set(1, "rating", 3)
    v.set(77, "rating", 2)
    with pytest.raises(ValueError):
        v.set(1, "filename", "z")
    v.measured(spark.createDataFrame([(1, 50.0, "[1,2,3]"), (3, 60.0, None)], "id long, quality_score double, mean_color string"))
    seen = lambda: {r["id"]: (r["rating"], r["flag"], r["rejected"], r["tags"], r["quality_score"], r["analyzed_at"] is not None) for r in v.catalog().collect()}
    now = {1: (3, 0, 0, "x,y", 50.0, True), 2: (0, 0, 1, "", None, False), 3: (0, 1, 0, "", 60.0, True), 4: (0, 0, 0, "", None, False)}
    assert seen() == now
    v.compact()
    assert seen() == now and v.log.read().count() == 0
    v.measured(spark.createDataFrame([(1, 51.0)], "id long, quality_score double"))
    v.set(1, "rating", "junk")
    assert seen()[1] == (0, 0, 0, "x,y", 51.0, True)
    done = spark.createDataFrame([("/v/a.png", "/n/r3_a.png", "move", True), ("/v/c.png", "/n/c.png", "move", False), ("/v/d.png", "/t/d.png", "trash", True)], "origin string, dest string, action string, ok boolean")
    v.apply(done)
    assert {r["filepath"] for r in v.catalog().collect()} == {"/n/r3_a.png", "/v/c.png", "/v/b/x.png"}
    assert [r["filepath"] for r in v.drop_rejected().collect()] == ["/v/b/x.png"]
    assert set(seen()) == {1, 3}
    # ids don't come back
    assert v.index(listing(spark, "e.png"))["indexed"] == 1 and max(seen()) == 5


def test_full_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"bytes of a")
    v = vault.Vault(spark, str(tmp_path / "v"))
    v.index(spark.createDataFrame([(str(tmp_path / "a.png"), 10, 1.0, 1.0), (str(tmp_path / "b.png"), 10, 1.0, 1.0)], "filepath string, size long, mtime double, ctime double"))
    got = {r["id"]: (r["filepath"], None if r["content"] is None else bytes(r["content"])) for r in v.full_images(spark.createDataFrame([(1,), (2,), (9,)], "id long")).collect()}
    assert got == {1: (str(tmp_path / "a.png"), b"bytes of a"), 2: (str(tmp_path / "b.png"), None), 9: (None, None)}


def test_lookups_skip_row_groups(spark, tmp_path):
    v = vault.Vault(spark, str(tmp_path / "v"), {"parquet.block.size": "20000"})
    many = spark.range(20_000).select(F.concat(F.lit("/v/"), F.sha1(F.col("id").cast("string")), F.lit(".png")).alias("filepath"), F.lit(1).alias("size"), F.lit(1.0).alias("mtime"), F.lit(1.0).alias("ctime"))
    v.index(many)
    v.images.compact()
    path = "/v/" + __import__("hashlib").sha1(b"777").hexdigest() + ".png"
    for df in (v.by_path(path), v.images.read().filter(F.col("id") == 4321)):
        assert df.count() == 1
        df.collect()
    found = v.by_path(path)
    assert [r["filepath"] for r in found.collect()] == [path]
    scans = []

    def walk(node):
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            scans.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())

    walk(found._jdf.queryExecution().executedPlan())
    assert scans and sum(scans) < 5_000, scans
