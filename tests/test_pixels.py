"""Images decoded by Spark's image source, measured and hashed in built-in expressions: against NumPy, on every kind of file."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vireo.functions import kernels, pixels, scalar
from vireo.sources import png, tree


def scene(seed, w=96, h=96):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w] / max(h, w)
    out = np.zeros((h, w, 3))
    for _ in range(6):
        cx, cy, r, c = rng.random(), rng.random(), rng.random() * 0.3 + 0.05, rng.random(3) * 255
        out[(x - cx) ** 2 + (y - cy) ** 2 < r * r] = c
    return np.clip(out + (y * 60)[:, :, None], 0, 255).astype(np.uint8)


def save_as(spark, source, target, kind):
    """An image file in another format, by the JVM's own writer."""
    io, jfile = spark._jvm.javax.imageio.ImageIO, spark._jvm.java.io.File
    image = io.read(jfile(str(source)))
    plain = spark._jvm.java.awt.image.BufferedImage(image.getWidth(), image.getHeight(), 1)
    plain.getGraphics().drawImage(image, 0, 0, None)
    assert io.write(plain, kind, jfile(str(target)))


def with_exif(jpeg, turn, order):
    head = {">": b"MM\0*", "<": b"II*\0"}[order]
    tiff = head + struct.pack(order + "IHHHIHHI", 8, 1, 0x0112, 3, 1, turn, 0, 0)
    body = b"Exif\0\0" + tiff
    return jpeg[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + jpeg[2:]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    (root / "_Incoming").mkdir()
    base, wide = scene(1), scene(4, 700, 90)
    files = {
        "base.png": base, "grey.png": base[:, :, 0], "alpha.png": np.dstack([base, np.full(base.shape[:2], 9, np.uint8)]), "wide.png": wide, "one.png": base[:1, :1],
        "_hidden name.png": base, "_Incoming/half [1].png": kernels.resize(base, 48, 48), "other.png": scene(9), "flat.png": np.full((20, 30, 3), 77, np.uint8),
    }
    for name, px in files.items():
        (root / name).write_bytes(png.encode(px))
    for kind in ("jpg", "bmp"):
        save_as(spark, root / "base.png", root / f"base.{kind}", kind)
    (root / "junk.jpg").write_bytes(b"junk")
    (root / "none.png").write_bytes(b"")
    (root / "cut.png").write_bytes(png.encode(base)[:300])
    (root / "later.webp").write_bytes(b"RIFF")
    tree.register(spark)
    return root, files


def close(got, want):
    return all(math.isclose(got[c], want[c], rel_tol=0.002, abs_tol=0.002) for c in ("sharpness", "brightness", "contrast", "saturation", "entropy"))


def test_metrics_of_all_kinds(spark, folder):
    root, files = folder
    rows = {r["rel"]: r for r in pixels.file_metrics(spark.read.format("image_tree").load(str(root))).collect()}
    assert len(rows) == len(files) + 6
    for name, px in files.items():
        r, want = rows[name], kernels.metrics(px)
        assert (r["width"], r["height"], r["file_corrupt"], r["error"], r["aspect_ratio"]) == (want["width"], want["height"], 0, None, want["aspect_ratio"]), name
        assert r["is_grayscale"] == want["is_grayscale"] and (name != "grey.png" or r["unique_colors"] is None)
        if max(px.shape[:2]) <= pixels.SIDE:
            assert close(r, want) and r["mean_color"] == want["mean_color"] and r["unique_colors"] == want["unique_colors"], name
        else:  # another filter brings it down
            assert abs(r["brightness"] - want["brightness"]) < 0.01 and abs(r["saturation"] - want["saturation"]) < 0.02
    base = rows["base.png"]
    assert close(rows["base.bmp"], base) and rows["base.bmp"]["unique_colors"] == base["unique_colors"]
    assert rows["base.jpg"]["file_corrupt"] == 0 and abs(rows["base.jpg"]["brightness"] - base["brightness"]) < 0.01
    assert {n for n, r in rows.items() if r["file_corrupt"]} == {"junk.jpg", "none.png", "cut.png"} and all(rows[n]["error"] and rows[n]["sharpness"] is None for n in ("junk.jpg", "none.png", "cut.png"))
    assert rows["later.webp"]["file_corrupt"] == 0 and rows["later.webp"]["error"] == "no decoder for this kind"


def no_python(df):
    plan = df._jdf.queryExecution().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_no_python_in_the_plans(spark):
    images = spark.createDataFrame([], "filepath string, height int, width int, channels int, data binary, turn int")
    images.write.mode("overwrite").format("noop").save()
    empty = spark.read.schema(images.schema).parquet
    table = spark.range(1).select(F.lit("a").alias("filepath"), F.lit(1).alias("height"), F.lit(1).alias("width"), F.lit(1).alias("channels"), F.unhex(F.lit("07")).alias("data"), F.lit(1).alias("turn"))
    assert empty and no_python(pixels.metrics(pixels.packed(table, "filepath"), "filepath")) and no_python(pixels.hashes(pixels.packed(table, "filepath", turn="turn"), "filepath"))


def triangle(grey, width, height):
    """The grid of resized(), with whole numbers."""

    def weights(n, out):
        reach = 2 * max(n, out)
        return np.maximum(0, reach - np.abs((2 * np.arange(n)[None, :] + 1) * out - (2 * np.arange(out)[:, None] + 1) * n)).astype(object)

    wy, wx = weights(grey.shape[0], height), weights(grey.shape[1], width)
    v, u = wy @ grey.astype(object) @ wx.T, wy.sum(axis=1)[:, None] * wx.sum(axis=1)[None, :]
    return ((2 * v + u) // (2 * u)).astype(np.int64)


def ph_of(grid):
    cos = np.array(pixels.cosines(), dtype=object)
    low = (cos @ grid.astype(object) @ cos.T).ravel()
    o = sorted(low)
    bits = sum(1 << (63 - k) for k in range(64) if 2 * low[k] > o[31] + o[32])
    return bits - (1 << 64) if bits >> 63 else bits


def test_hashes_equal_whole_number_numpy(spark, folder):
    root, files = folder
    names = ["base.png", "grey.png", "alpha.png", "one.png", "_hidden name.png", "_Incoming/half [1].png", "flat.png"]
    found = spark.read.format("image_tree").option("content", "true").load(str(root)).filter(F.col("rel").isin(*names))
    rows = {r["rel"]: r for r in pixels.file_hashes(found).collect()}
    assert set(rows) == set(names)
    for name in names:
        grey = kernels.luma(files[name])
        flat = triangle(grey, 9, 8)
        dh = sum(1 << (63 - k) for k in range(64) if flat[k // 8, k % 8 + 1] > flat[k // 8, k % 8])
        assert rows[name]["ph"] == ph_of(triangle(grey, 32, 32)), name
        assert rows[name]["dh"] == (dh - (1 << 64) if dh >> 63 else dh), name
    distance = lambda a, b: min((rows[a][h] ^ rows[b][h]) & (1 << 64) - 1 for h in ("ph",)).bit_count()
    assert distance("base.png", "_Incoming/half [1].png") <= 4


def test_kernels_agree_in_kind():
    """The whole-number hash is the hash of the cosine transform in floats, but for bits at the median."""
    for seed in range(20):
        grid = triangle(kernels.luma(scene(seed)), 32, 32)
        k, x = np.arange(32)[:, None], np.arange(32)[None, :]
        m = np.cos(np.pi * (2 * x + 1) * k / 64)
        m[0] *= math.sqrt(0.5)
        low = (m @ grid @ m.T)[:8, :8].ravel()
        bits = sum(1 << (63 - k) for k in range(64) if low[k] > np.median(low))
        assert ((ph_of(grid) ^ bits) & (1 << 64) - 1).bit_count() <= 1


@pytest.mark.parametrize("order", "<>")
def test_orientation(spark, folder, tmp_path, order):
    root, files = folder
    small = scene(2, 40, 24)
    (tmp_path / "s.png").write_bytes(png.encode(small))
    save_as(spark, tmp_path / "s.png", tmp_path / "s.jpg", "jpg")
    jpeg = (tmp_path / "s.jpg").read_bytes()
    turns = range(1, 9)
    (tmp_path / "t").mkdir()
    for t in turns:
        (tmp_path / f"t/{t}.jpg").write_bytes(with_exif(jpeg, t, order))
    (tmp_path / "t/0.jpg").write_bytes(jpeg)
    found = spark.read.format("image_tree").option("content", "true").load(str(tmp_path / "t")).withColumn("turn", pixels.orientation(F.col("content")))
    images = pixels.decoded(found.drop("content"))
    assert {r["rel"]: r["turn"] for r in images.collect()} == {"0.jpg": 1, **{f"{t}.jpg": t for t in turns}}
    px = {r["rel"]: r for r in pixels.packed(images, "rel", turn="turn").collect()}
    plain = np.array(px["0.jpg"]["px"]).reshape(24, 40)
    for t in turns:
        want = kernels.oriented(plain, t)
        r = px[f"{t}.jpg"]
        assert (r["h"], r["w"], r["height"], r["width"]) == (*want.shape, *want.shape) and np.array_equal(np.array(r["px"]).reshape(want.shape), want), t
    assert spark.sql("select 1").select(pixels.orientation(F.lit(None).cast("binary")).alias("o")).first()["o"] == 1


def test_nothing_to_decode(spark):
    none = spark.createDataFrame([], "filepath string, content binary")
    assert pixels.file_metrics(none.drop("content")).count() == 0 and pixels.file_hashes(none).count() == 0
    kinds = spark.createDataFrame([("/x/a.webp",), ("/x/gone.png",)], "filepath string")
    got = {r["filepath"]: (r["file_corrupt"], r["error"]) for r in pixels.file_metrics(kinds.filter("filepath LIKE '%webp'")).collect()}
    assert got == {"/x/a.webp": (0, "no decoder for this kind")}
    assert scalar.EXTENSIONS
