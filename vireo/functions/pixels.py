"""Pixels in built-in expressions: images as Spark's image source decodes them, their metrics, and grids to hash.

An image is a row with an array of packed pixels (red, green and blue, eight bits each), of at most ``SIDE`` pixels a side: larger
images are averaged down line by line as they are read, so no array outgrows SIDE x SIDE. Sums run over exploded indices, which
Spark compiles, and are sums of whole numbers wherever a result is compared bit by bit; so they don't depend on the order of rows.
Rows are dealt by image once, and every aggregation after that stays in its partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vireo.functions.scalar import basename, bits64, dhash_grid, dirname, suffix
from vireo.plans.tables import materialize, scratch_dir

SIDE = 512  # pixels a side that metrics and hashes are taken from, at most
NAMED_FILES = 5_000  # files that are handed to the image source by name; more are read by their folders
#: Endings of files that the JVM has a decoder for.
DECODABLE = (".png", ".jpg", ".jpeg", ".bmp")

_div = lambda x, y: F.call_function("div", x.cast("long"), y.cast("long") if isinstance(y, Column) else F.lit(y).cast("long"))


def decoded(files: DataFrame) -> DataFrame:
    """files (filepath, and others) with height, width, channels and data (bytes in order blue, green, red, as Spark's image source has them)
    and error: null, or why there are no pixels.

    The source hides files whose names begin with ``_``: of those, copies under other names are made in the shared scratch folder,
    by tasks. Which files or folders are read is known to the driver, the fewer of both.
    """
    spark = files.sparkSession
    files = materialize(files.withColumn("_known", F.lower(suffix(F.col("filepath"))).isin(*DECODABLE)))
    able = files.filter("_known")
    hidden = basename(F.col("filepath")).startswith("_")
    staged = able.filter(hidden).select("filepath")
    if not staged.isEmpty():
        staged = materialize(_staged(staged, scratch_dir(spark)))
        able = able.join(staged, "filepath", "left").withColumn("_read", F.coalesce("staged", "filepath"))
    else:
        able = able.withColumn("_read", F.col("filepath"))
    names = able.select("_read").limit(NAMED_FILES + 1).collect()
    if len(names) > NAMED_FILES:
        names = able.select(dirname(F.col("_read"))).distinct().collect()
    empty = able.select("filepath", *(F.lit(None).cast(t).alias(c) for c, t in (("height", "int"), ("width", "int"), ("channels", "int"), ("data", "binary")))).limit(0)
    found = empty
    if names:
        image = spark.read.format("image").option("dropInvalid", "false").load([_literal(r[0]) for r in names]).select("image.*")
        # origins are URIs: the path is what follows the authority, decoded but for plus signs, which URIs keep
        path = F.url_decode(F.replace(F.regexp_replace("origin", "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
        image = image.filter("height > 0").select(path.alias("_read"), "height", "width", F.col("nChannels").alias("channels"), "data")
        found = able.select("filepath", "_read").join(image, "_read").drop("_read")
    out = files.join(found, "filepath", "left")
    error = F.when(F.col("data").isNotNull(), F.lit(None)).when(F.col("_known"), "can't be decoded").otherwise("no decoder for this kind")
    return out.withColumn("error", error).drop("_known")


def _literal(path: str) -> str:
    """A path in which no sign is a pattern."""
    return "".join(f"\\{c}" if c in "\\{}[]*?^" else c for c in path)


def _staged(files: DataFrame, folder: str) -> DataFrame:
    """filepath and staged: copies of files under names that aren't hidden. A copy is put in place whole, so a task may run twice."""

    def copy(batches: Iterator) -> Iterator:
        import hashlib
        import os
        import shutil
        import uuid

        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            out = []
            for path in pdf["filepath"]:
                target = os.path.join(folder, hashlib.sha256(path.encode()).hexdigest() + os.path.splitext(path)[1])
                try:
                    shutil.copyfile(path, part := f"{folder}/.{uuid.uuid4().hex}")
                    os.replace(part, target)
                except OSError:
                    target = None
                out.append(target)
            yield pdf.assign(staged=out)

    return files.mapInPandas(copy, "filepath string, staged string")


def orientation(content: Column) -> Column:
    """The EXIF orientation (1 to 8) in the first bytes of a JPEG or PNG; 1 where there is none. The tag is looked for at whole bytes, in either byte order."""
    head = F.hex(F.substring(content, 1, 1 << 16))
    big = F.regexp_extract(head, r"457869660000(?:..)*?4D4D002A(?:..)*?01120003000000010{3}([1-8])", 1)
    little = F.regexp_extract(head, r"457869660000(?:..)*?49492A00(?:..)*?12010300010000000([1-8])00", 1)
    return F.coalesce(F.when(big != "", big), F.when(little != "", little), F.lit("1")).cast("int")


def upright(y: Column, x: Column, height: Column, width: Column, turn: Column) -> tuple[Column, Column]:
    """Where a stored pixel comes to lie when an image is turned as its orientation asks."""
    ny = F.when(turn.isin(3, 4), height - 1 - y).when(turn.isin(5, 6), x).when(turn.isin(7, 8), width - 1 - x).otherwise(y)
    nx = F.when(turn.isin(2, 3), width - 1 - x).when(turn.isin(5, 8), y).when(turn.isin(6, 7), height - 1 - y).otherwise(x)
    return ny.cast("int"), nx.cast("int")


def _bgr(data: Column, place: Column, channels: Column) -> Column:
    """Blue, green, red of the pixel at a place as one number; grey pixels count thrice."""
    number = lambda n: F.conv(F.hex(F.substring(data, place * channels + 1, F.lit(n))), 16, 10).cast("int")
    return F.when(channels == 1, number(1) * 0x010101).otherwise(number(3))


def packed(images: DataFrame, key: str, side: int = SIDE, turn: str | None = None) -> DataFrame:
    """key, height, width, grey (one channel), h, w and px of decoded images: h x w packed pixels, at most side a side, row by row.

    turn: a column with the orientation; height, width, h and w are those of the upright image then. Images that weren't decoded are
    left out.
    """
    turned = F.col(turn) if turn else F.lit(1)
    long, scale = F.greatest("height", "width"), F.lit(side)
    fit = lambda c: F.when(long <= scale, F.col(c)).otherwise(F.greatest(F.lit(1), F.round(F.col(c) * scale / long).cast("int")))
    rows = images.filter("data IS NOT NULL").select(F.col(key).alias("key"), "height", "width", "channels", "data", turned.alias("turn"), fit("height").alias("h"), fit("width").alias("w"))
    lines = rows.filter((long > scale) | (F.col("turn") != 1)).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    size = F.col("width") * F.col("channels")
    lines = lines.withColumn("line", F.substring("data", F.col("y") * size + 1, size)).drop("data").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    ty, tx = upright(_div(F.col("y") * F.col("h"), F.col("height")), _div(F.col("x") * F.col("w"), F.col("width")), F.col("h"), F.col("w"), F.col("turn"))
    across = F.col("turn") > 4
    swapped = lambda a, b: F.when(across, F.col(b)).otherwise(F.col(a))
    bgr = _bgr(F.col("line"), F.col("x"), F.col("channels"))
    cells = lines.select("key", swapped("height", "width").alias("height"), swapped("width", "height").alias("width"), (F.col("channels") == 1).alias("grey"), swapped("h", "w").alias("h"), swapped("w", "h").alias("w"), ty.alias("ty"), tx.alias("tx"), bgr.alias("bgr"))
    channel = lambda shift: F.shiftright("bgr", shift).bitwiseAND(F.lit(255))
    mean = lambda c: _div(2 * F.sum(c) + F.count("*"), 2 * F.count("*"))
    at = ["key", "height", "width", "grey", "h", "w"]
    cells = cells.groupBy(*at, "ty", "tx").agg(*(mean(channel(s)).alias(n) for n, s in (("r", 0), ("g", 8), ("b", 16))))
    whole = cells.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct(F.col("ty") * F.col("w") + F.col("tx"), (F.shiftleft("r", 16) + F.shiftleft("g", 8) + F.col("b")).cast("int").alias("v")))).alias("s"))
    large = whole.select(*at, F.transform("s", lambda s: s["v"]).alias("px"))

    flip = lambda v: F.shiftleft(v.bitwiseAND(F.lit(255)), 16) + v.bitwiseAND(F.lit(0xFF00)) + F.shiftright(v, 16)
    pixel = F.transform(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1), lambda k: F.transform(F.array(_bgr(F.col("data"), k, F.col("channels"))), flip)[0])
    small = rows.filter((long <= scale) & (F.col("turn") == 1)).select("key", "height", "width", (F.col("channels") == 1).alias("grey"), "h", "w", pixel.alias("px"))
    return small.unionByName(large).withColumnRenamed("key", key)


def metrics(images: DataFrame, key: str) -> DataFrame:
    """key, sharpness, brightness, contrast, saturation, entropy, is_grayscale, mean_r, mean_g, mean_b and unique_colors of images (key, h, w, px).

    Grey is the plain mean of the channels, kept as their sum. unique_colors counts colours of four bits a channel.
    """
    dealt = images.select(key, "h", "w", "px").repartition(F.col(key))  # what follows is grouped by key and more, and stays where it is
    each = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("px") - 1)))
    y, x = _div(F.col("k"), F.col("w")).cast("int"), (F.col("k") % F.col("w")).cast("int")
    inside = lambda v, n: F.greatest(F.lit(0), F.least(n - 1, v))
    at = lambda dy, dx: F.get("px", inside(y + dy, F.col("h")) * F.col("w") + inside(x + dx, F.col("w")))
    parts = lambda v: (F.shiftright(v, 16), F.shiftright(v, 8).bitwiseAND(F.lit(255)), v.bitwiseAND(F.lit(255)))
    total = lambda v: sum(parts(v)[1:], parts(v)[0])
    named = each.select(key, *(c.alias(n) for n, c in zip("rgb", parts(F.get("px", F.col("k"))))), (total(at(-1, 0)) + total(at(1, 0)) + total(at(0, -1)) + total(at(0, 1))).alias("around"))
    m, top, spread = F.col("r") + F.col("g") + F.col("b"), F.greatest(*"rgb"), F.greatest(*"rgb") - F.least(*"rgb")
    named = named.select(
        key, "r", "g", "b", m.cast("long").alias("m"), (F.col("around") - 4 * m).cast("long").alias("lap"), spread.alias("spread"), (spread / (top + 1e-8)).alias("sat"),
        F.least(F.lit(63), F.floor(m / (3 * 255) * 64)).cast("int").alias("bin"), (F.shiftright("r", 4) * 256 + F.shiftright("g", 4) * 16 + F.shiftright("b", 4)).alias("colour"),
    )
    sums = {"n": F.lit(1).cast("long"), "sm": F.col("m"), "smm": F.col("m") * F.col("m"), "sl": F.col("lap"), "sll": F.col("lap") * F.col("lap"), "ss": F.col("sat"), "sr": F.col("r").cast("long"), "sg": F.col("g").cast("long"), "sb": F.col("b").cast("long")}
    cells = named.groupBy(key, "bin", "colour").agg(*(F.sum(c).alias(n) for n, c in sums.items()), F.max("spread").alias("spread"))
    bins = cells.groupBy(key, "bin").agg(*(F.sum(n).alias(n) for n in sums), F.max("spread").alias("spread"), F.collect_set("colour").alias("colours"))
    one = bins.groupBy(key).agg(*(F.sum(n).alias(n) for n in sums), F.max("spread").alias("spread"), F.collect_list("n").alias("bars"), F.size(F.array_distinct(F.flatten(F.collect_list("colours")))).alias("unique_colors"))
    n = F.col("n")
    variance = lambda s, ss: (n * F.col(ss) - F.col(s) * F.col(s)) / (9 * n * n)
    share = lambda v: v / (n + 1e-8)
    entropy = F.aggregate(F.array_sort("bars"), F.lit(0.0), lambda acc, v: acc - share(v) * F.log2(share(v) + 1e-8)) / 6
    gray = F.col("spread") < 10
    return one.select(
        key, F.round(variance("sl", "sll"), 1).alias("sharpness"), F.round(F.col("sm") / (3 * n) / 255, 3).alias("brightness"), F.round(F.sqrt(variance("sm", "smm")) / 128, 3).alias("contrast"),
        F.when(gray, 0.0).otherwise(F.round(F.col("ss") / n, 3)).alias("saturation"), F.round(entropy, 3).alias("entropy"), gray.cast("int").alias("is_grayscale"),
        *(_div(F.col(f"s{c}"), n).cast("int").alias(f"mean_{c}") for c in "rgb"), "unique_colors",
    )


def resized(images: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """key and grid: ITU-R 601 grey, 0 to 255, of images (key, h, w, px) brought to width x height by a triangle filter that widens with the reduction.

    Weights are whole numbers, first along lines and then across them: so the result is exact.
    """
    dealt = images.select(key, "h", "w", "px").repartition(F.col(key))
    each = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("px") - 1)))
    v = F.get("px", F.col("k"))
    r, g, b = (F.shiftright(v, s).bitwiseAND(F.lit(255)) for s in (16, 8, 0))
    grey = F.shiftright(r * 19595 + g * 38470 + b * 7471 + 0x8000, 16)
    rows = each.select(key, "h", "w", _div(F.col("k"), F.col("w")).cast("int").alias("y"), (F.col("k") % F.col("w")).cast("int").alias("x"), grey.cast("long").alias("v"))

    def along(df: DataFrame, place: str, n: str, out: int, kept: list[str]) -> DataFrame:
        """Sums of v with the weights that place (of n) has for each of out targets."""
        i, size = F.col(place), F.col(n)
        reach = F.greatest(size, F.lit(out)) * 2
        low = F.greatest(F.lit(0), F.floor(((2 * i + 1) * out - reach) / (2 * size) - 0.5).cast("int"))
        high = F.least(F.lit(out - 1), F.ceil(((2 * i + 1) * out + reach) / (2 * size) - 0.5).cast("int"))
        df = df.withColumn("t", F.explode(F.sequence(low, high)))
        weight = (reach - F.abs((2 * i + 1) * out - (2 * F.col("t") + 1) * size)).cast("long")
        df = df.withColumn("weight", weight).filter("weight > 0")
        return df.groupBy(*kept, "t").agg(F.sum(F.col("weight") * F.col("v")).alias("v"), F.sum(F.col("weight") * F.col("u")).alias("u"))

    lines = along(rows.withColumn("u", F.lit(1).cast("long")), "x", "w", width, [key, "h", "y"]).withColumnRenamed("t", "tx")
    cells = along(lines, "y", "h", height, [key, "tx"]).withColumnRenamed("t", "ty")
    cells = cells.select(key, (F.col("ty") * width + F.col("tx")).alias("at"), _div(2 * F.col("v") + F.col("u"), 2 * F.col("u")).cast("int").alias("v"))
    return cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("s")).select(key, F.transform("s", lambda s: s["v"]).alias("grid"))


GRID = 32  # a side of what is transformed
LOW = 8  # frequencies a side that are kept
UNIT = 1 << 14


def cosines() -> list[list[int]]:
    """The first LOW rows of the cosine transform over GRID places, in UNITs; the constant row is an even root of two lower."""
    row = lambda k: [math.cos(math.pi / GRID * (x + 0.5) * k) for x in range(GRID)]
    return [[round(UNIT * c / (math.sqrt(2) if k == 0 else 1)) for c in row(k)] for k in range(LOW)]


def low_frequencies(grid: Column) -> Column:
    """The LOW x LOW lowest coefficients of GRID x GRID values, in whole numbers: the matrix product of cosines, values and cosines.

    A cosine row is the same from both ends, or the same with its sign turned: so values are first added to, and taken from, those at
    the other end, and products have half the terms.
    """
    half = GRID // 2
    table = lambda first: F.array(*(F.array(*(F.lit(c).cast("long") for c in row[:half])) for row in cosines()[first::2]))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0).cast("long"), lambda acc, v: acc + v)

    def transformed(values: Column, held: Column) -> Column:
        """LOW coefficients of GRID values."""
        ends = lambda v: F.struct(F.slice(v, 1, half).alias("a"), F.reverse(F.slice(v, half + 1, half)).alias("b"))
        folded = F.transform(F.transform(F.array(values), ends), lambda e: F.struct(F.zip_with(e["a"], e["b"], lambda p, q: p + q).alias("sum"), F.zip_with(e["a"], e["b"], lambda p, q: p - q).alias("less")))
        each = F.transform(folded, lambda f: F.zip_with(held["even"], held["odd"], lambda c, d: F.array(dot(f["sum"], c), dot(f["less"], d))))
        return F.flatten(each[0])

    # functions of an array's one element: what they take is worked out once. [line][v], then for each v the column over lines
    made = F.transform(F.array(F.struct(table(0).alias("even"), table(1).alias("odd"), grid.alias("grid"))), lambda s: F.struct(s["even"].alias("even"), s["odd"].alias("odd"), F.transform(F.sequence(F.lit(0), F.lit(GRID - 1)), lambda y: transformed(F.slice(s["grid"], y * GRID + 1, F.lit(GRID)), s)).alias("part")))
    columns = F.transform(made, lambda s: F.transform(F.sequence(F.lit(0), F.lit(LOW - 1)), lambda v: transformed(F.transform(s["part"], lambda p: F.get(p, v)), s)))
    # [v][u], by rows u
    return F.transform(columns, lambda c: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LOW - 1)), lambda u: F.transform(c, lambda v: F.get(v, u)))))[0]


def phash_grid(grid: Column) -> Column:
    """The perceptual hash of GRID x GRID values: a bit for each low frequency, set where it is above their median (mean of the middle two)."""
    both = F.transform(F.array(low_frequencies(grid)), lambda c: F.struct(c.alias("c"), F.array_sort(c).alias("o")))
    middle = LOW * LOW // 2
    both = F.transform(both, lambda s: F.struct(s["c"].alias("c"), (F.element_at(s["o"], middle) + F.element_at(s["o"], middle + 1)).alias("m")))
    return F.transform(both, lambda s: bits64(s, lambda t, k: 2 * F.get(t["c"], k) > t["m"]))[0]


def hashes(images: DataFrame, key: str) -> DataFrame:
    """key, ph and dh of images (key, h, w, px)."""
    large, flat = resized(images, key, GRID, GRID), resized(images, key, 9, 8)
    return large.select(key, phash_grid(F.col("grid")).alias("ph")).join(flat.select(key, dhash_grid(F.col("grid")).alias("dh")), key)


def file_metrics(files: DataFrame) -> DataFrame:
    """files (filepath, and others) with size, aspect, metrics and error. file_corrupt is 1 where an image of a known kind can't be decoded; kinds
    that have no decoder here aren't called corrupt: their metrics are null, and error says why."""
    images = materialize(decoded(files))
    found = metrics(packed(images, "filepath"), "filepath")
    out = images.withColumn("grey", F.col("channels") == 1).drop("data", "channels").join(found, "filepath", "left")
    flat = F.coalesce(F.col("grey"), F.lit(False))
    out = out.withColumn("aspect_ratio", F.round(F.col("width") / F.col("height"), 3)).withColumn("file_corrupt", (F.col("error") == "can't be decoded").cast("int"))
    out = out.withColumn("file_corrupt", F.coalesce("file_corrupt", F.lit(0))).withColumn("mean_color", F.when(F.col("mean_r").isNotNull(), F.array("mean_r", "mean_g", "mean_b")))
    out = out.withColumn("unique_colors", F.when(~flat, F.col("unique_colors"))).withColumn("is_grayscale", F.when(flat, 1).otherwise(F.col("is_grayscale")))
    return out.drop("grey", "mean_r", "mean_g", "mean_b")


def file_hashes(files: DataFrame) -> DataFrame:
    """files (filepath, content, and others) with ph, dh and error, the images upright."""
    images = materialize(decoded(files.withColumn("turn", orientation(F.col("content"))).drop("content")))
    found = hashes(materialize(packed(images, "filepath", turn="turn")), "filepath")
    return images.drop("data", "channels", "height", "width", "turn").join(found, "filepath", "left")
