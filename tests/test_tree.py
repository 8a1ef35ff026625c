"""The image_tree source: what a listing holds, one partition a folder, and streams that resume."""

import os

import pytest
from pyspark.sql import functions as F

from vireo.sources import tree

FILES = ["a.png", "UPPER.PNG", "note.txt", ".hidden.png", "_y.png", "_Incoming/x.jpg", "_Incoming/deep/_z/z.webp", ".dupe-trash/junk.png", "sub/.dot/q.png", "sub/b.bmp", "sub/c.jpeg", "sub/.png", "empty/readme.md"]
KEPT = ["UPPER.PNG", "_Incoming/deep/_z/z.webp", "_Incoming/x.jpg", "_y.png", "a.png", "sub/b.bmp", "sub/c.jpeg"]


def put(root, *names):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())


@pytest.fixture
def root(tmp_path):
    put(tmp_path / "vault", *FILES)
    return tmp_path / "vault"


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    tree.register(spark)


def rels(df):
    return sorted(r["rel"] for r in df.select("rel").collect())


def test_listing(spark, root):
    found = spark.read.format("image_tree").load(str(root))
    assert rels(found) == KEPT
    # a folder a partition: the root, _Incoming, deep, _z, sub, empty
    assert found.rdd.getNumPartitions() == 6
    row = found.filter("rel = 'sub/b.bmp'").first()
    stat = os.stat(root / "sub/b.bmp")
    assert (row["filepath"], row["size"]) == (str(root / "sub/b.bmp"), stat.st_size) and abs(row["mtime"] - stat.st_mtime) < 1e-3 and abs(row["ctime"] - stat.st_ctime) < 1e-3
    assert rels(spark.read.format("image_tree").load(root.as_uri())) == KEPT


def test_few_partitions_walk_the_rest(spark, root):
    found = spark.read.format("image_tree").option("partitions", "2").load(str(root))
    assert rels(found) == KEPT and found.rdd.getNumPartitions() <= 4


def test_contents_and_filters(spark, root):
    found = spark.read.format("image_tree").option("content", "true").load(str(root))
    assert {r["rel"]: bytes(r["content"]) for r in found.collect()} == {k: k.encode() for k in KEPT}
    below = spark.read.format("image_tree").load(str(root)).filter(F.col("rel").startswith("_Incoming/deep/"))
    assert rels(below) == ["_Incoming/deep/_z/z.webp"] and below.rdd.getNumPartitions() < 6
    assert rels(spark.read.format("image_tree").load(str(root)).filter("rel = 'a.png'")) == ["a.png"]


def test_empty_and_missing(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert spark.read.format("image_tree").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="path"):
        spark.read.format("image_tree").load().count()


def run(spark, root, tmp_path, sink):
    stream = spark.readStream.format("image_tree").option("log", str(tmp_path / "log")).load(str(root))
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"checkpoint-{sink}")).option("path", str(tmp_path / sink)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / sink))


def test_stream_resumes(spark, root, tmp_path):
    assert rels(run(spark, root, tmp_path, "out")) == KEPT
    assert rels(run(spark, root, tmp_path, "out")) == KEPT  # nothing new
    put(root, "_Incoming/new.png", "later/_n/n.png", "a.png", ".dupe-trash/more.png")
    moved = tmp_path / "elsewhere"
    put(moved, "old.png")
    os.utime(moved / "old.png", (1, 1))
    moved.rename(root / "moved")  # an old file in a folder that is moved in
    assert rels(run(spark, root, tmp_path, "out")) == sorted([*KEPT, "_Incoming/new.png", "later/_n/n.png", "moved/old.png"])


def test_a_scan_that_is_run_again_gives_the_same(root, tmp_path):
    reader = tree._StreamReader(tree.StructType.fromDDL(tree.LISTING), {"path": str(root), "log": str(tmp_path / "log")})
    first = reader.latestOffset()
    assert first == {"scan": 1} and reader.latestOffset() == first
    give = lambda a, b: sorted(x for p in reader.partitions(a, b) for batch in reader.read(p) for x in batch.column(1).to_pylist())
    assert give({"scan": 0}, first) == KEPT
    put(root, "sub/d.png")
    second = reader.latestOffset()
    assert second == {"scan": 2} and give(first, second) == ["sub/d.png"]
    put(root, "sub/e.png")
    assert give(first, second) == ["sub/d.png"]  # as a run after a crash
    assert give({"scan": 0}, first) == KEPT
    assert give(second, reader.latestOffset()) == ["sub/e.png"]
