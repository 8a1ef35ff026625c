"""Catalog queries: filters, sorts, pages, counts and distinct lists over the images table, and incremental indexing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from vireo.functions.scalar import contains_like
from vireo.plans.tables import materialize

#: The columns that a listing may be sorted by.
SORTABLE = ("file_modified", "file_created", "filesize", "filename", "rating", "indexed_at", "quality_score", "sharpness", "saturation", "brightness", "contrast")


@dataclass(frozen=True)
class CatalogQuery:
    """What a listing may ask for. Ranges apply only where they exclude something; unknown sorts fall back to file_modified, descending."""

    min_rating: int = 0
    max_rating: int = 999
    min_quality: float = 0
    max_quality: float = 999
    unrated: bool = False
    include_rejected: bool = False
    prompt: str = ""
    model: str = ""
    directory: str = ""
    sort: str = "file_modified"
    direction: str = "desc"
    limit: int = 50
    offset: int = 0

    def predicates(self) -> list[Column]:
        out = []
        if self.unrated:
            out += [F.col("rating") == 0, F.col("rejected") == 0]
        elif not self.include_rejected:
            out.append(F.col("rejected") == 0)
        for low, high, name in ((self.min_rating, self.max_rating, "rating"), (self.min_quality, self.max_quality, "quality_score")):
            if low > 0:
                out.append(F.col(name) >= low)
            if high < 999:
                out.append(F.col(name) <= high)
        out += [contains_like(F.col(name), text) for name, text in (("prompt", self.prompt), ("model", self.model), ("directory", self.directory)) if text]
        return out

    def rows(self, images: DataFrame) -> DataFrame:
        for p in self.predicates():
            images = images.filter(p)
        return images

    def order(self) -> list[Column]:
        """Nulls are least; id breaks ties."""
        column = F.col(self.sort if self.sort in SORTABLE else "file_modified")
        return [column.asc_nulls_first() if self.direction == "asc" else column.desc_nulls_last(), F.col("id").asc()]

    def page(self, images: DataFrame) -> DataFrame:
        return self.rows(images).orderBy(*self.order()).offset(max(0, self.offset)).limit(max(0, min(self.limit, 200)))

    def total(self, images: DataFrame) -> DataFrame:
        return self.rows(images).agg(F.count("*").alias("total"))

    def answer(self, images: DataFrame) -> tuple[list[Row], int]:
        """The page's rows and the number of all that match, of one scan: rows are counted as they pass to the sort."""
        seen = Observation()
        counted = self.rows(images).observe(seen, F.count(F.lit(1)).alias("total"))
        page = counted.orderBy(*self.order()).offset(max(0, self.offset)).limit(max(0, min(self.limit, 200)))
        return page.collect(), seen.get["total"]

    def answer_rows(self, images: DataFrame) -> DataFrame:
        """answer() as rows: place (from 0), row (JSON, nulls included) and total; a row with null place and row where the page is empty."""
        rows, total = self.answer(images.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("_json"), "*"))
        made = [(k, r["_json"], total) for k, r in enumerate(rows)] or [(None, None, total)]
        return images.sparkSession.createDataFrame(made, "place int, row string, total long")


def vault_stats(images: DataFrame) -> DataFrame:
    """All counts in one pass."""
    return images.agg(
        F.count("*").alias("total"), F.count_if(F.col("rating") > 0).alias("rated"), F.count_if(F.col("rejected") == 1).alias("rejected"),
        F.count_if(F.col("flag") == 1).alias("flagged"), F.count_if((F.col("rating") == 0) & (F.col("rejected") == 0)).alias("unrated"),
    )


def distinct_models(images: DataFrame) -> DataFrame:
    return images.filter("model <> ''").select("model").distinct().orderBy("model")


def distinct_directories(images: DataFrame) -> DataFrame:
    return images.select("directory").distinct().orderBy("directory")


def by_id(images: DataFrame, image_id: int) -> DataFrame:
    return images.filter(F.col("id") == image_id)


def by_path(images: DataFrame, path: str) -> DataFrame:
    return images.filter(F.col("filepath") == path)


def work_list(images: DataFrame) -> DataFrame:
    """Images still to be measured: never analysed, and not known to be corrupt."""
    return images.filter("analyzed_at IS NULL AND file_corrupt = 0").select("id", "filepath")


def top_scores(images: DataFrame, n: int = 20) -> DataFrame:
    return images.filter("quality_score IS NOT NULL").orderBy(F.desc("quality_score"), "filename").limit(n)


def new_files(listing: DataFrame, images: DataFrame) -> DataFrame:
    """Files that the catalog doesn't hold, one row per path."""
    return listing.dropDuplicates(["filepath"]).join(images.select("filepath"), "filepath", "left_anti")


def index_plan(listing: DataFrame, images: DataFrame, force: bool = False) -> DataFrame:
    """listing (filepath, size; size null where a file couldn't be read), one row per path, with its action.

    new: the catalog lacks the path. skipped: it has it. refreshed: it has it, and force asks for it anew. error: unreadable.
    A forced run says refreshed of rows that the catalog has, and not that it indexed them.
    """
    known = images.select("filepath").distinct().withColumn("_known", F.lit(True))
    held = F.lit("refreshed" if force else "skipped")
    action = F.when(F.col("_known") & F.lit(not force), held).when(F.col("size").isNull(), "error").when(F.col("_known"), held).otherwise("new")
    return listing.dropDuplicates(["filepath"]).join(known, "filepath", "left").withColumn("action", action).drop("_known")


def index_counts(plan: DataFrame) -> DataFrame:
    """One row: indexed (new and refreshed), skipped and errors."""
    return plan.agg(F.count_if(F.col("action").isin("new", "refreshed")).alias("indexed"), F.count_if(F.col("action") == "skipped").alias("skipped"), F.count_if(F.col("action") == "error").alias("errors"))


def with_ids(fresh: DataFrame, first_id: int) -> DataFrame:
    """fresh with ids from first_id on, in path order: a range sort and one count per partition, no single task."""
    placed = fresh.repartitionByRange("filepath").sortWithinPartitions("filepath").withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed)  # places are told from a written table: range borders are sampled anew at each evaluation
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
    out = placed.withColumn("_p", part).join(F.broadcast(before), "_p")  # a row per partition
    return out.withColumn("id", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + first_id).drop("_p", "_at", "_before")


def changed_files(listing: DataFrame, cache: DataFrame, version: int = 2) -> DataFrame:
    """Files whose hash is missing, of another version, or of another mtime or size."""
    return listing.join(cache.filter(F.col("v") == version).select("rel", "mtime", "size"), ["rel", "mtime", "size"], "left_anti")


def merge_metrics(images: DataFrame, metrics: DataFrame) -> DataFrame:
    """images with the metric columns of metrics (by id) where there are any: the catalog stays append-only, metrics are a side table."""
    names = [c for c in metrics.columns if c != "id"]
    joined = images.join(metrics.select("id", *(F.col(c).alias(f"_m_{c}") for c in names)), "id", "left")
    return joined.select(*(F.coalesce(F.col(f"_m_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in images.columns))
