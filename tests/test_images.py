"""Image trees from end to end: listing, ingest, hashing, families, resolution, metadata and metrics."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vireo.functions import images, kernels, metadata
from vireo.operators import dupes, pull, review
from vireo.sources import files, png
from vireo.streaming import incremental


def scene(seed, w=256, h=256):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w] / h
    out = np.zeros((h, w, 3))
    for _ in range(6):
        cx, cy, r, c = rng.random(), rng.random(), rng.random() * 0.3 + 0.05, rng.random(3) * 255
        out[(x - cx) ** 2 + (y - cy) ** 2 < r * r] = c
    return np.clip(out + (y * 60)[:, :, None], 0, 255).astype(np.uint8)


@pytest.fixture
def tree(tmp_path):
    base = scene(1)
    edited = base.copy()
    edited[20:60, 100:140] = 128
    for rel, px in {"output/a.png": base, "output/a_edit.png": edited, "output/a_copy.png": edited, "_Incoming/a_small.PNG": kernels.resize(base, 128, 128), "output/b.png": scene(9), ".hidden.png": base, ".dupe-trash/t.png": base}.items():
        p = tmp_path / "src" / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(png.encode(px))
    (tmp_path / "src/output/a.txt").write_text("no image")
    return tmp_path


def test_pull_cluster_and_resolve(spark, tree):
    found = files.listing(spark, str(tree / "src"))
    assert sorted(r["rel"] for r in found.collect()) == ["_Incoming/a_small.PNG", "output/a.png", "output/a_copy.png", "output/a_edit.png", "output/b.png"]
    content = files.with_content(found).select(F.col("filepath").alias("origin"), F.lit("src").alias("source"), "rel", "sha256", "size")
    manifest = spark.createDataFrame([], "origin string, pool_path string, sha256 string")
    plan = pull.pull_plan(content, manifest, str(tree / "pool"))
    assert {r["action"]: r["n"] for r in pull.summary(plan).collect()} == {"move": 4, "exact_dupe": 1}
    done = review.execute(plan.filter("action = 'move'").select("origin", "dest", "sha256", "size", "action"))
    assert done.filter("NOT ok").count() == 0
    pool = files.with_content(files.listing(spark, str(tree / "pool")))
    hashed = pool.select("rel", images.image_hashes("content").alias("h")).select("rel", F.xxhash64("rel").alias("key"), "h.ph", "h.dh").cache()
    members = dupes.families(dupes.pair_edges(hashed, 14, ["ph", "dh"]), 14).join(hashed, "key")
    family = {r["rel"] for r in members.collect()}
    assert {"src/output/a.png", "src/_Incoming/a_small.PNG"} <= family and "src/output/b.png" not in family
    keep = spark.createDataFrame([("src/output/a.png",)], "rel string")
    resolved = review.execute(review.resolve_plan(members.select("rel"), keep, str(tree / "pool"), str(tree / "pool_curated")).select("origin", "dest", "action"))
    assert resolved.filter("ok").count() == len(family) and (tree / "pool_curated/src/output/a.png").exists()
    assert files.listing(spark, str(tree / "pool")).count() == 4 - len(family)


def test_png_round_trip_and_metrics(spark):
    for px in (scene(3), scene(3)[:, :, 0], np.dstack([scene(3), np.full((256, 256), 9, np.uint8)])):
        assert np.array_equal(png.decode(png.encode(px)), px)
    assert png.decode(png.encode(scene(3))[:200]) is None and png.decode(b"") is None
    m = kernels.metrics(scene(3))
    assert m["width"] == 256 and m["is_grayscale"] == 0 and 0 < m["entropy"] < 1.1 and m["unique_colors"] > 5
    assert kernels.metrics(np.full((4, 4), 7, np.uint8))["sharpness"] == 0 and kernels.metrics(None)["file_corrupt"] == 1
    rows = spark.createDataFrame([(bytearray(png.encode(scene(3))),), (bytearray(b"junk"),), (None,)], "content binary")
    got = rows.select(images.image_metrics("content").alias("m")).select("m.*").collect()
    assert got[0]["sharpness"] == m["sharpness"] and got[0]["mean_color"] == m["mean_color"] and got[1]["file_corrupt"] == got[2]["file_corrupt"] == 1


def test_metadata_rules():
    graph = {"9": {"class_type": "CLIPTextEncode", "inputs": {"text": "short"}}, "10": {"class_type": "CLIPTextEncode", "inputs": {"text": "a longer one"}}, "3": {"class_type": "CLIPTextEncode", "inputs": {"text": ["4", 0]}},
             "1": {"class_type": "CheckpointLoaderSimple", "inputs": {"ckpt_name": "m.ckpt"}}, "2": {"class_type": "LoraLoader", "inputs": {"lora_name": "l"}}, "7": {"class_type": "KSamplerAdvanced", "inputs": {"noise_seed": 18446744073709551616}}}
    got = metadata.extract(png.encode(scene(1, 8, 8), {"prompt": json.dumps(graph), "workflow": "{}" * 30_000}))
    assert got["prompt"] == "a longer one" and got["model"] == "m.ckpt" and got["seed"] == "18446744073709551616" and len(got["workflow"]) == 50_000 and got["width"] == 8
    assert metadata.extract(png.encode(scene(1, 8, 8), {"prompt": "[1]"}))["prompt"] == "" and metadata.extract(b"x")["width"] is None


@pytest.mark.parametrize(
    "graph, want",
    [
        ({"a": 3, "b": None, "c": {"class_type": "CLIPTextEncode", "inputs": {"text": "x"}}}, ("x", "", "")),
        ({"a": {"inputs": {"seed": [1, None, "b", [2], {"c": 1}, True, 1.5]}}}, ("", "", "1, , b, True, 1.5")),
        ({"a": {"class_type": "LoraLoader", "inputs": {"lora_name": "l1"}}, "b": {"class_type": "LoraLoader", "inputs": {"lora_name": "l2"}}}, ("", "l1", "")),
        ({"a": {"class_type": "my MODEL", "inputs": {"ckpt_name": "c", "unet_name": "u"}}, "b": {"class_type": "UNETLoader", "inputs": {"unet_name": "v"}}}, ("", "v", "")),
        ({"a": {"class_type": "UNETLoader", "inputs": {"unet_name": {}}}, "b": {"class_type": "LoraLoader", "inputs": {"lora_name": "l"}}}, ("", "l", "")),
        ({"a": {"class_type": "KSampler", "inputs": {"noise_seed": 7}}, "b": {"class_type": "Other", "inputs": {"noise_seed": 8}}}, ("", "", "7")),
        ({"a": {"inputs": ["x"]}}, ("", "", "")),
        ([], ("", "", "")),
        ([1], None),
        ({"a": {"inputs": 5}}, None),
        ({"a": {"class_type": None}}, None),
        ({"a": {"class_type": "CLIPTextEncode", "inputs": ["text"]}}, None),
        ({"a": {"inputs": "seed"}}, None),
    ],
)
def test_graph_rules(graph, want):
    assert metadata.graph_text_fields(json.dumps(graph)) == (None if want is None else dict(zip(("prompt", "model", "seed"), want)))
    found = metadata.extract(png.encode(scene(1, 8, 8), {"prompt": json.dumps(graph), "workflow": "w"}))
    assert found["workflow"] == ("" if want is None else "w")


def plain_unfilter(kinds, rows, step):
    """Filters undone byte by byte, from the format's definition."""
    out, up = [], [0] * rows.shape[1]
    for kind, row in zip(kinds.tolist(), rows.tolist()):
        now = []
        for i, v in enumerate(row):
            a, b, c = now[i - step] if i >= step else 0, up[i], up[i - step] if i >= step else 0
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            now.append((v + (0, a, b, (a + b) // 2, guess)[kind]) & 255)
        out.append(now)
        up = now
    return np.array(out, np.uint8)


def test_png_filters_interlacing_and_broken_files():
    rng = np.random.default_rng(5)
    for step, stride in ((1, 7), (3, 21), (4, 40), (6, 30), (1, 1)):
        kinds, rows = rng.integers(0, 5, 19), rng.integers(0, 256, (19, stride)).astype(np.uint8)
        assert np.array_equal(png.unfiltered(kinds, rows, step), plain_unfilter(kinds, rows, step))
    px = scene(2, 21, 13)
    raw = b"".join(b"".join(b"\0" + r.tobytes() for r in np.ascontiguousarray(px[y::dy, x::dx])) for x, y, dx, dy in png.PASSES if px[y::dy, x::dx].size)
    whole = png.encode(px)
    head = struct.pack(">IIBBBBB", 21, 13, 8, 2, 0, 0, 1)
    piece = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"crc4"
    assert np.array_equal(png.decode(png.SIGNATURE + piece(b"IHDR", head) + piece(b"IDAT", zlib.compress(raw))), px)
    for bad in (piece(b"IHDR", head[:5]), piece(b"IHDR", head) + piece(b"PLTE", b"1234"), piece(b"IHDR", head) + piece(b"IDAT", b"zz")):
        assert png.decode(png.SIGNATURE + bad) is None
    for cut in range(0, len(whole), 37):
        png.decode(whole[:cut])


def test_stream_hashes_once(spark, tree, tmp_path):
    run = lambda: incremental.hash_new_images(spark, str(tree / "src"), str(tmp_path / "hashes"), str(tmp_path / "cp")).awaitTermination()
    for _ in range(2):
        run()
    assert sorted(r["rel"] for r in spark.read.parquet(str(tmp_path / "hashes")).collect()) == ["_Incoming/a_small.PNG", "output/a.png", "output/a_copy.png", "output/a_edit.png", "output/b.png"]
    (tree / "src/_Later").mkdir()
    (tree / "src/_Later/n.bmp").write_bytes(b"no image")
    run()
    rows = {r["rel"]: r for r in spark.read.parquet(str(tmp_path / "hashes")).collect()}
    assert len(rows) == 6 and rows["_Later/n.bmp"]["error"] and rows["_Later/n.bmp"]["ph"] is None
    assert rows["output/a_copy.png"]["ph"] == rows["output/a_edit.png"]["ph"] and rows["output/a.png"]["error"] is None


def test_families_grow_with_a_stream(spark, tmp_path):
    rows = [(k, [0, 1, 7, 0xFF00FF00, 0xFF00FF01, -1, -2, 0x123456789ABCDEF, 0, 1 << 40][k]) for k in range(10)]
    every = spark.createDataFrame(rows, "key long, dh long")
    state = incremental.FamilyState(spark, str(tmp_path / "state"), 3, ["dh"])
    for part in (0, 1, 2):
        every.filter(every["key"] % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        state.add_stream(spark.readStream.schema("key long, dh long").parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    whole = dupes.families(dupes.pair_edges(every, 3, ["dh"]), 3)
    order = lambda df: sorted(map(tuple, df.select("family_id", "key", "min_dist").collect()))
    assert order(state.families()) == order(whole)
    state.add(every)  # nothing new
    assert order(state.families()) == order(whole) and state.hashes.read().count() == 10
