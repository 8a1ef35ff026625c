"""The shared test tables seen as a media catalog: documents as images, events as a review log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.functions.scalar import dhash_grid, median_hash
from vireo.plans.tables import read_table

SUFFIXES = (".png", ".JPG", ".jpeg", ".webp", ".bmp", ".txt")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    row = docs.join(labels, "doc_id", "left")
    k = (F.col("doc_id") % 6).cast("int")
    name = F.concat(F.lit("img_"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, SUFFIXES)), k + 1))
    folder = F.concat_ws("/", F.lit("/vault"), "source", "lang")
    return row.select(
        F.col("doc_id").alias("id"), F.concat_ws("/", folder, name).alias("filepath"), name.alias("filename"), folder.alias("directory"), F.col("n_chars").alias("filesize"),
        F.col("text").alias("prompt"), F.col("source").alias("model"), (F.coalesce("quality", F.lit(0)) * k).cast("int").alias("rating"),
        (F.col("doc_id") % 7 == 0).cast("int").alias("flag"), F.coalesce("toxic", F.lit(0)).alias("rejected"),
        F.when(F.col("quality").isNotNull(), (F.col("n_chars") % 1000) / 10).alias("quality_score"), (F.col("doc_id") * 60.0).alias("file_modified"),
        F.when(F.col("quality").isNotNull(), F.col("doc_id") * 1.0).alias("analyzed_at"), (F.col("n_chars") % 11 == 0).cast("int").alias("file_corrupt"),
    )


#: The letters whose share of a slice of text is its brightness, and its red, green and blue.
GREY = "abcdefghijklm"
COLOURS = ("abcdefgh", "ijklmnopq", "rstuvwxyz")


def text_slices(text: Column, size: int, groups: tuple[str, ...], value) -> Column:
    """A whole text as size equal slices: value() of each one's shares (0 to 255) of groups of letters, as an array; null counts as empty.

    The text is put into one byte a character first (each group's letters become its first), so that a slice is cut in no more
    time than it is long.
    """
    ascii_ = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7F]", "~")
    classed = F.translate(ascii_, "".join(g[1:] for g in groups), "".join(g[0] * (len(g) - 1) for g in groups)).cast("binary")
    div = lambda x, y: F.call_function("div", x, y)

    def cut(t: Column, i: Column) -> Column:
        begin, end = (div(x.cast("long") * F.length(t), F.lit(size).cast("long")) for x in (i, i + 1))
        return F.substr(t, (begin + 1).cast("int"), (end - begin).cast("int")).cast("string")

    def share(part: Column, letter: str) -> Column:
        held = F.length(part) - F.length(F.replace(part, F.lit(letter), F.lit("")))
        return div((held * 255).cast("long"), F.greatest(F.length(part), F.lit(1)).cast("long"))

    # functions of an array's one element: what they take is worked out once
    shares = lambda part: value(*(share(part, g[0]) for g in groups))
    return F.transform(F.array(classed), lambda t: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.transform(F.array(cut(t, i)), shares)[0]))[0]


def text_grid(text: Column, size: int) -> Column:
    """A whole text as size brightness values."""
    return text_slices(text, size, (GREY,), lambda grey: grey)


def text_pixels(text: Column, size: int) -> Column:
    """A whole text as size pixels r, g, b."""
    return text_slices(text, size, COLOURS, lambda *rgb: F.struct(*(x.alias(n) for n, x in zip("rgb", rgb))))


def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), dhash_grid(text_grid(F.col("text"), 72)).alias("dh"))


def vector_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select("vec_id", median_hash(F.transform("embedding", lambda x: x.cast("double"))).alias("ph"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their sources; names repeat across folders."""
    docs = read_table(spark, sf_dir, "documents")
    rel = F.concat(F.col("lang"), F.lit("/f"), (F.col("doc_id") % 50).cast("string"), F.lit(".png"))
    origin = F.concat_ws("/", F.lit("/src"), "source", F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    return docs.select(origin.alias("origin"), "source", rel.alias("rel"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size"), "doc_id")
